from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from devicelode import functions as S


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [
    ("battery_type", "Battery Type"), ("2g bands", "2G Bands"), ("o'neil x", "O'Neil X"), ("", ""), ("ABC_dEF", "Abc Def")])
def test_readable_key_is_title_case(spark, text, want):
    assert value(spark, S.readable_key(F.lit(text))) == want == text.replace("_", " ").title()


@pytest.mark.parametrize("text", ["  a\xa0", "\n\tb c\r\n", "", " "])
def test_strip(spark, text):
    assert value(spark, S.strip(F.lit(text))) == text.strip()


@pytest.mark.parametrize("text, want", [("12 devices", 12), ("a1b2", 12), ("none", 0), ("", 0), ("9" * 30, 0)])
def test_digits(spark, text, want):
    assert value(spark, S.digits_int(F.lit(text))) == want


@pytest.mark.parametrize("url, want", [
    ("https://x.test/fine_phone_5g-123.php", ("123", "fine_phone_5g")), ("https://x.test/plain.php", ("https://x", "plain")),
    ("a-b-7.php", ("7", "a-b"))])
def test_url_parts(spark, url, want):
    assert (url.split("-")[-1].split(".")[0], value(spark, S.url_base(F.lit(url)))) == want
    assert value(spark, S.url_id(F.lit(url))) == want[0]


@pytest.mark.parametrize("seconds, want, expired", [
    (0, "0 seconds ago", False), (59, "59 seconds ago", False), (60, "1 minutes ago", False), (3599, "59 minutes ago", False),
    (3600, "1 hours ago", False), (86399, "23 hours ago", False), (86400, "1 days ago", False), (86401, "1 days ago", True)])
def test_age(spark, seconds, want, expired):
    now = datetime(2025, 1, 10)
    ts, at = F.lit(now - timedelta(seconds=seconds)), F.lit(now)
    assert value(spark, S.age_text(ts, at)) == want
    assert value(spark, S.is_expired(ts, at)) is expired


def test_iso(spark):
    whole, part = datetime(2025, 4, 24, 7, 54, 13), datetime(2025, 4, 24, 7, 54, 13, 198855)
    for t in (whole, part):
        assert value(spark, S.ts_iso(F.lit(t))) == t.isoformat()
        assert value(spark, S.iso_ts(F.lit(t.isoformat()))) == t
    assert value(spark, S.iso_ts(F.lit("no time"))) is None


def test_mask_percent_tier(spark):
    key = "0123456789abcdef"
    assert value(spark, S.mask_key(F.lit(key))) == key[:8] + "..." + key[-4:]
    assert value(spark, S.percent(F.lit(3), F.lit(0))) == 100
    assert value(spark, S.percent(F.lit(1), F.lit(4))) == 25
    assert value(spark, S.valid_tier(F.lit("gold"))) == "basic"
    assert value(spark, S.valid_tier(F.lit(None).cast("string"))) == "basic"
    assert value(spark, S.tier_limit(F.lit("premium"))) == 300


def test_fill_leaves_values_alone(spark):
    assert value(spark, S.fill("{a} and {b}", a=F.lit("{b}"), b=F.lit(2))) == "{b} and 2"


def test_lookup_takes_first_name(spark):
    m = F.create_map(F.lit("Display"), F.lit("big"))
    assert value(spark, S.lookup(m, "display", "Display")) == "big"
    assert value(spark, S.lookup(m, "x")) is None


def test_json_quote(spark):
    assert value(spark, S.json_quote(F.lit('a"b\\c\n'))) == '"a\\"b\\\\c\\n"'
