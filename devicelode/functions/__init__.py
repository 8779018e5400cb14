"""Column -> Column helpers built only on Spark's own functions."""

from devicelode.functions.text import (  # noqa: F401
    age_text, device_key, digits_int, fill, full_name, gallery_url, is_expired,
    iso_ts, join_list, json_quote, let, lookup, mask_key, normalise, percent,
    readable_key, resolve_url, snake_key, strip, tier_limit, title_case, ts_iso,
    url_base, url_id, valid_tier,
)
