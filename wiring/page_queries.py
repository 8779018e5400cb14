"""Extraction from pages: stored ones, and ones rendered from the part table.

A rendered page holds what the part row says, so its SQL reads the part table
and knows nothing about HTML.
"""

from pyspark.sql import functions as F

from devicelode.functions import strip
from devicelode.operators import extract as E
from devicelode.plans.harvest import harvest, harvest_new
from devicelode.session import scratch_path
from wiring import tables as T
from wiring.registry import ctes, query

LISTED = 100  # part numbers on one listing page


def _cat(*xs):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])


# ---- rendered pages ------------------------------------------------------------

def brand_index(spark, d):
    """A brand index of one brand for each page, between links that do not count."""
    b = T.brand_rows(spark, d)
    low = F.lower("name")
    return b.select(F.col("pos").alias("page_id"), F.lit("index").alias("url"), _cat(
        '<html><a href="no.php">Outside 9 devices</a><div class="plain st-text" id="x"><div><div>A note</div></div><table><td><a title="a > b" href=\'', low, "-phones.php'>",
        F.col("name"), "<br><span>", F.col("device_count"), ' devices</span></a></td><td><a href="">No link</a></td>',
        '<td><a class="x" href="n.php">77 devices</a></td><!-- <a href="c.php">Comment 1 devices</a> --></table></div></html>').alias("html"))


def brand_indexes(spark, d):
    """Brand indexes of a hundred entries each, one for each part; every entry stands in a block of its own, its link quoted in one of three ways."""
    p = T.table(spark, d, "part")
    k = F.col("p_partkey")
    href = F.when(k % 3 == 0, _cat("'b-", k, ".php'")).when(k % 3 == 1, _cat('"b-', k, '.php"')).otherwise(_cat("b-", k, ".php"))
    entry = _cat("<div><a class='x y' href=", href, ">", F.col("p_name"), " &amp; fr&egrave;res<br><span>", F.col("p_size"), " devices</span></a></div>")
    grouped = p.groupBy(F.floor(k / LISTED).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(k, entry.alias("e")))).alias("entries"))
    return grouped.select("page_id", F.lit("index").alias("url"), _cat(
        "<div class='st-text'>", F.array_join(F.transform("entries", lambda e: e["e"]), "<div></div>"), "</div><a href=no.php>Out 1 devices</a>").alias("html"))


def brand_menu(spark, d):
    b = T.brand_rows(spark, d)
    return b.select(F.col("pos").alias("page_id"), F.lit("menu").alias("url"), _cat(
        '<div class="brandmenu-v2"><ul><li><a href="', F.lower("name"), '.php">', F.col("name"), "<span> (", F.col("device_count"),
        ")</span></a></li></ul></div>").alias("html"))


def listings(spark, d, per_page=LISTED):
    """Listing pages of a brand, a hundred part numbers to a page."""
    cat = T.named_catalogue(spark, d)
    pages = cat.agg(F.floor(F.max("pos") / per_page)).scalar()
    k = F.col("pos")
    href = F.replace("device_url", F.lit(T.BASE), F.lit(""))
    image = F.when(k % 3 == 1, _cat('<img src="img/', k, '.jpg">')).when(k % 3 == 2, _cat("<img src=img/", k, ".jpg alt='x'>")).otherwise(F.lit(""))
    item = F.when(k % 10 == 9, _cat("<li>", F.col("device_name"), "</li>")).otherwise(
        _cat('<li class="d"><a href="', href, '">', image, "<strong><span>", F.col("device_name"), " </span></strong></a></li>"))
    page = F.floor(k / per_page)
    grouped = cat.groupBy("brand_name", page.alias("page")).agg(
        F.min("pos").alias("page_id"), F.array_sort(F.collect_list(F.struct(k, item.alias("li")))).alias("items"))
    base = F.lower("brand_name")
    next_href = F.when(F.col("page") < pages, _cat(base, "-f-", F.col("page") + 1, ".php")).otherwise(F.lit("#"))
    heading = F.when(F.col("page") % 2 == 0, _cat('<div class="review-header"><h1>', F.col("brand_name"), " &amp; ",
                                                  F.col("page") + 7, " phones</h1></div>")).otherwise(F.lit(""))
    return grouped.select(
        "page_id", _cat(T.BASE, base, "-f-", F.col("page"), ".php").alias("url"), _cat(
            "<html>", heading, '<script>var s="<li><a href=x>no</a></li>";</script><div class="makers"><ul>',
            F.array_join(F.transform("items", lambda i: i["li"]), '<div class="ad"><div>Advert</div></div>'), '</ul></div><div class="nav-pages"><a href="first.php">1</a><strong>',
            F.col("page"), '</strong> <a class="n" href="', next_href, '">next</a></div></html>').alias("html"))


LISTINGS = f"""listed AS (SELECT *, pos // {LISTED} AS page FROM named),
listing AS (
  SELECT brand_name, page, min(pos) AS page_id, count(*) AS items, '{T.BASE}' || lower(brand_name) || '-f-' || page || '.php' AS url
  FROM listed GROUP BY brand_name, page)"""


def spec_pages(spark, d):
    """One specification page for each part."""
    p = T.wide_table(spark, d, "part")
    k, s, t = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    row = lambda f, v, spec="": _cat('<tr><td class="ttl"><a href="g.php">', f, '</a></td><td class="nfo"', spec, ">", v, "</td></tr>")
    more = lambda v: _cat('<tr><td class="ttl">&nbsp;</td><td class="nfo">', v, "</td></tr>")
    table = lambda name, *rows: _cat(f'<table cellspacing="0"><tr><th rowspan="3" scope="row">{name}</th></tr>', *rows, "</table>")
    even = k % 2 == 0
    tables = _cat(
        table("Network", row("Technology", _cat("GSM / LTE ", s), ' data-spec="nettech"'),
              row("2G bands", _cat("GSM ", s, " - International - GSM 900 - USA")),
              row("3G bands", _cat("HSDPA ", s, "<br>HSDPA 2<br> ")), row("4G bands", _cat("LTE ", s))),
        table("Body", row("Dimensions", _cat(s, " x 2 mm")), '<tr><td colspan="2">alone</td></tr>', row("SIM-type", "Nano")),
        table("Display", row("Type", _cat("<b>", t, "</b> LCD"), " data-spec='displaytype'"),
              F.when(k % 4 > 0, row("Size", _cat(s, " in"))).otherwise(row("Size", _cat(s, " in<table><tr><th>Inner</th></tr><tr><td class=ttl>Area</td><td>9", s, " cm</td></tr></table>"))),
              row("Build", _cat("&eacute;tui &#x27;", s, "&#39; &lt;&euro;&gt;"), F.when(k % 16 == 1, ' title="a > b"').otherwise(" title='a'"))),
        table("Platform", F.when(even, row("OS", _cat("os ", s), " data-spec=os")).otherwise(row("OS", _cat("os ", s))),
              row("Chipset", _cat(t, " &lt;chip&gt;"))),
        table("Memory", more("ignored"), row("Internal", _cat(s, "GB")), more("UFS"), more(_cat("eMMC ", s))),
        table("Main Camera", F.when(even, row("Dual", _cat(s, " MP<br>5 MP"), ' data-spec="cam1modules"')).otherwise(
            row("Triple", _cat(s, " MP")))),
        F.when(k % 3 == 0, table("Selfie camera", row("Video", "1080p"), row("Single", _cat(s, " MP")))).otherwise(F.lit("")),
        table("Features", row("Sensors", _cat("sensor ", s)), row("Other", "Siri<br>Pay", ' data-spec="featuresother"')),
        F.when(k % 3 == 0, table("Battery", row("Type", _cat("Li ", s)))).otherwise(F.lit("")),
        table("Misc", row("Colors", F.lower(t)), row("Price", F.when(even, _cat('<a href="price-', k, '.php">About ', s, " EUR</a>"))
                                                     .otherwise(_cat("About ", s, " EUR")), ' data-spec="price"')),
        "<table><tr><td>x</td><td>no heading</td></tr></table>")
    html = _cat('<html><!-- <table><th>No</th></table> --><h1 class="specs-phone-name-title"> ', F.col("p_name"), " &amp; ", k, "\n</h1>",
                '<div class="specs-photo-main"><a href="pics/', k, '.jpg"><img src="a"></a></div><div class="specs-photo-sub"><a href="pics/', k,
                '-2.jpg">2</a><a href="gallery.php">all</a></div><script>var t="</table><table>";</script>', tables, "</html>")
    return p.select(k.alias("page_id"), T.part_url().alias("url"), html.alias("html"))


def gallery_pages(spark, d):
    """Galleries of the even parts, under the address made from the page's own."""
    p = T.table(spark, d, "part").filter("p_partkey % 2 = 0")
    k = F.col("p_partkey")
    url = _cat(T.BASE, F.replace("p_name", F.lit(" "), F.lit("_")), "-pictures-", k, ".php")
    return p.select((k + 1_000_000_000).alias("page_id"), url.alias("url"), _cat(
        "<div id='pictures-list'><h2>Pictures</h2><div><img src='cdn/", k, "-a.jpg'></div>", '<img alt="" src="', T.BASE, "pics/", k,
        '.jpg"><img src="cdn/placeholder.jpg"><img src="x.php"><img src="cdn/', k, '-a.jpg"></div>').alias("html"))


# ---- queries ---------------------------------------------------------------------

@query("E1_extract_links", r"""
SELECT page_id, n - 1 AS pos, href[n] AS href, text[n] AS text FROM (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS href, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS text FROM pages)
CROSS JOIN LATERAL (SELECT unnest(range(1, len(href) + 1)) AS n)""")
def extract_links(spark, d):
    return E.extract_links(T.wide_table(spark, d, "pages")).withColumn("pos", F.col("pos").cast("bigint"))


@query("E2_extract_brands", ctes(T.CAT, T.NAMED, T.BRAND_ROWS) + "SELECT name, url, device_count FROM brands")
def extract_brands(spark, d):
    return E.extract_brands(brand_index(spark, d)).select("name", "url", "device_count").orderBy("name")


@query("E2_extract_brand_index", f"""
SELECT p_partkey // {LISTED} AS page_id, p_name || ' & frères' AS name, '{T.BASE}b-' || p_partkey || '.php' AS url, CAST(p_size AS BIGINT) AS device_count FROM part""")
def extract_brand_index(spark, d):
    return E.extract_brands(brand_indexes(spark, d)).select("page_id", "name", "url", "device_count")


@query("E2_extract_brand_menu", ctes(T.CAT, T.NAMED, T.BRAND_ROWS) + f"""
SELECT name || ' (' || device_count || ')' AS name, '{T.BASE}' || lower(name) || '.php' AS url, device_count FROM brands""")
def extract_brand_menu(spark, d):
    return E.extract_brand_menu(brand_menu(spark, d)).select("name", "url", "device_count")


@query("E3_extract_listing", ctes(T.CAT, T.NAMED, LISTINGS) + """
SELECT page_id, device_name AS name, device_url AS url, CASE WHEN pos % 3 > 0 THEN 'img/' || pos || '.jpg' ELSE '' END AS image_url
FROM listed JOIN listing USING (brand_name, page) WHERE pos % 10 <> 9""")
def extract_listing(spark, d):
    return E.extract_listing(listings(spark, d)).select("page_id", "name", "url", "image_url")


@query("E4_next_page", ctes(T.CAT, T.NAMED, LISTINGS) + f"""
SELECT url, CASE WHEN page < (SELECT max(page) FROM listed) THEN '{T.BASE}' || lower(brand_name) || '-f-' || (page + 1) || '.php' ELSE '-' END AS next_url FROM listing""")
def next_page(spark, d):
    return E.next_page(listings(spark, d)).select("url", F.coalesce("next_url", F.lit("-")).alias("next_url"))


@query("E4_page_chain", ctes(T.CAT, T.NAMED, LISTINGS.replace(f"// {LISTED}", "// 400").replace("listed AS", "listed AS")) + f"""
SELECT '{T.BASE}' || lower(brand_name) || '-f-0.php' AS start_url, page AS step, url FROM (
  SELECT *, count(*) OVER (PARTITION BY brand_name ORDER BY page) AS n FROM listing) WHERE n = page + 1""")
def page_chain(spark, d):
    """Chains from the first page of each brand; a page with no devices is not stored and ends one."""
    pages = listings(spark, d, per_page=400)
    return E.page_chain(pages, pages.filter(F.col("url").endswith("-f-0.php")).select("url"))


HARVESTED = ctes(T.CAT, T.NAMED, LISTINGS) + f"""
, reached AS (SELECT brand_name, page, url FROM (SELECT *, count(*) OVER (PARTITION BY brand_name ORDER BY page) AS n FROM listing) WHERE n = page + 1)
SELECT brand_name, page AS step, device_name, device_url, CASE WHEN pos % 3 > 0 THEN 'img/' || pos || '.jpg' ELSE '' END AS device_image
FROM listed JOIN reached USING (brand_name, page) WHERE pos % 10 <> 9""".replace("\n, reached", ", reached")


def stored_pages(spark, d):
    """The brand index, the listing pages of all brands, and the specification pages, in one table."""
    brands = T.brand_rows(spark, d)
    entry = _cat("<div><a href='", F.lower("name"), "-f-0.php'>", F.col("name"), "<br><span>", F.col("device_count"), " devices</span></a></div>")
    index = brands.agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("list")).select(
        F.lit(2_000_000_000).cast("bigint").alias("page_id"), F.lit("makers").alias("url"), _cat("<div class='st-text'>", F.col("list"), "</div>").alias("html"))
    lists = listings(spark, d).withColumn("page_id", F.col("page_id").cast("bigint") + 1_000_000_000)
    path = scratch_path(spark, "pages")
    index.unionByName(lists).unionByName(spec_pages(spark, d).withColumn("page_id", F.col("page_id").cast("bigint"))).write.parquet(path)
    return spark.read.parquet(path)


@query("E3_E4_harvest", HARVESTED)
def harvest_devices(spark, d):
    """Brand index, listing chains and items in one plan."""
    return harvest(stored_pages(spark, d), "makers", T.BASE).select("brand_name", F.col("step").cast("bigint").alias("step"), "device_name", "device_url", "device_image")


@query("J5_harvest_new", "SELECT brand_name, device_name, device_url, device_image FROM (" + HARVESTED + ") WHERE device_url NOT IN (SELECT device_url FROM (" + ctes(
    T.CAT, T.NAMED) + "SELECT device_url FROM named WHERE pos % 2 = 0))")
def harvest_new_devices(spark, d):
    """The harvested devices that are not among the even ones of the catalogue."""
    cat = T.named_catalogue(spark, d).filter("pos % 2 = 0")
    return harvest_new(stored_pages(spark, d), "makers", cat, T.BASE).select("brand_name", "device_name", "device_url", "device_image")


# What the tables of a page say; r orders the features, lists are their items joined.
PAGE_ROWS = r"""page_rows AS (
  SELECT p_partkey AS page_id, u.* FROM part, LATERAL (VALUES
    (0, 'Network', 1, 'Technology', ['GSM / LTE ' || p_size], false, true),
    (0, 'Network', 2, '2G bands', ['GSM ' || p_size || ' - International', 'GSM 900 - USA'], true, true),
    (0, 'Network', 3, '3G bands', ['HSDPA ' || p_size, 'HSDPA 2'], true, true),
    (0, 'Network', 4, '4G bands', ['LTE ' || p_size], false, true),
    (1, 'Body', 1, 'Dimensions', [p_size || ' x 2 mm'], false, true),
    (1, 'Body', 3, 'SIM-type', ['Nano'], false, true),
    (2, 'Display', 1, 'Type', [p_type || ' LCD'], false, true),
    (2, 'Display', 2, 'Size', [p_size || ' in' || CASE WHEN p_partkey % 4 = 0 THEN 'InnerArea9' || p_size || ' cm' ELSE '' END], false, true),
    (2, 'Display', 3, 'Build', ['étui ''' || p_size || ''' <€>'], false, true),
    (2.5, 'Inner', 1, 'Area', ['9' || p_size || ' cm'], false, p_partkey % 4 = 0),
    (3, 'Platform', 1, 'OS', ['os ' || p_size], false, true),
    (3, 'Platform', 2, 'Chipset', [p_type || ' <chip>'], false, true),
    (4, 'Memory', 2, 'Internal', [p_size || 'GB', 'UFS', 'eMMC ' || p_size], true, true),
    (5, 'Main Camera', 1, 'Dual', [p_size || ' MP5 MP'], false, p_partkey % 2 = 0),
    (5, 'Main Camera', 1, 'Triple', [p_size || ' MP'], false, p_partkey % 2 = 1),
    (6, 'Selfie camera', 1, 'Video', ['1080p'], false, p_partkey % 3 = 0),
    (6, 'Selfie camera', 2, 'Single', [p_size || ' MP'], false, p_partkey % 3 = 0),
    (7, 'Features', 1, 'Sensors', ['sensor ' || p_size], false, true),
    (7, 'Features', 2, 'Other', ['SiriPay'], false, true),
    (8, 'Battery', 1, 'Type', ['Li ' || p_size], false, p_partkey % 3 = 0),
    (9, 'Misc', 1, 'Colors', [lower(p_type)], false, true),
    (9, 'Misc', 2, 'Price', ['About ' || p_size || ' EUR'], false, true)
  ) u(t, cat, r, feature, items, listed, present) WHERE u.present)"""


@query("E5_extract_spec_rows", ctes(PAGE_ROWS) + r"""
SELECT page_id, cat, CAST(r AS BIGINT) AS row_pos, feature, lower(translate(feature, ' -', '__')) AS key,
  CASE feature WHEN '2G bands' THEN items[1] || ' - ' || items[2] WHEN '3G bands' THEN items[1] || items[2] WHEN 'Internal' THEN items[1] ELSE items[1] END AS value,
  false AS more FROM page_rows
UNION ALL SELECT page_id, cat, r + i, '', '', CASE i WHEN -1 THEN 'ignored' ELSE items[i + 1] END, true
FROM page_rows, (VALUES (-1), (1), (2)) v(i) WHERE feature = 'Internal'""")
def extract_spec_rows(spark, d):
    rows = E.extract_spec_rows(spec_pages(spark, d))
    return rows.select("page_id", "cat", F.col("row_pos").cast("bigint").alias("row_pos"), "feature", "key", "value", "more")


@query("E6_fold_continuations", ctes(PAGE_ROWS) + r"""
SELECT page_id, cat, feature, listed, n - 1 AS item_pos, items[n] AS item FROM page_rows CROSS JOIN LATERAL (SELECT unnest(range(1, len(items) + 1)) AS n)""")
def fold_continuations(spark, d):
    rows = E.fold_continuations(spec_pages(spark, d))
    return rows.select("page_id", "cat", "feature", "listed", F.col("item_pos").cast("bigint").alias("item_pos"), "item")


@query("E7_split_bands", """
SELECT p_partkey AS pos, CASE p_partkey % 5
  WHEN 0 THEN 'GSM ' || p_size || ' - International|GSM 900 - USA'
  WHEN 1 THEN 'A ' || p_size || '|B' WHEN 2 THEN '-' WHEN 3 THEN 'x - y - ' || p_size ELSE 'EU - 1 - USA|' || p_size END AS bands FROM part""")
def split_bands(spark, d):
    """Cells of five forms: dashes with regions, lines, plain, dashes without a region, regions first."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    cell = (F.when(k % 5 == 0, _cat("GSM ", s, " - International - GSM 900 - USA")).when(k % 5 == 1, _cat("A ", s, "\n B \n"))
            .when(k % 5 == 2, _cat("LTE ", s)).when(k % 5 == 3, _cat("x - y - ", s)).otherwise(_cat("EU - 1 - USA - ", s)))
    p = T.table(spark, d, "part").select(k.alias("pos"), strip(cell).alias("cell"))
    bands = E.split_bands(F.col("cell"), F.replace("cell", F.lit("\n"), F.lit("")))
    return p.select("pos", F.coalesce(F.array_join(bands, "|"), F.lit("-")).alias("bands"))


PROMOTED = """p_partkey AS page_id, 'GSM / LTE ' || p_size AS technology, p_type || ' LCD' AS display_type, p_size || ' x 2 mm' AS dimensions,
  'os ' || p_size AS os, lower(p_type) AS colors, CASE WHEN p_partkey % 3 = 0 THEN 'Li ' || p_size ELSE '' END AS battery_type,
  'sensor ' || p_size AS sensors"""
CAMERAS = """p_size || ' MP' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '5 MP' ELSE '' END AS main_camera,
  CASE WHEN p_partkey % 3 = 0 THEN p_size || ' MP' ELSE '' END AS selfie_camera"""
PRICE = f"""'{{"text":"About ' || p_size || ' EUR"' || CASE WHEN p_partkey % 2 = 0 THEN ',"url":"{T.BASE}price-' || p_partkey || '.php"' ELSE '' END || '}}' AS price_info"""


@query("E8_promote_fields", f"SELECT {PROMOTED} FROM part")
def promote_fields(spark, d):
    return E.promote_fields(spec_pages(spark, d)).drop("url", "html")


@query("E9_promote_cameras", f"SELECT p_partkey AS page_id, {CAMERAS} FROM part")
def promote_cameras(spark, d):
    return E.promote_cameras(spec_pages(spark, d)).drop("url", "html")


@query("E10_price_info", f"SELECT p_partkey AS page_id, {PRICE}, 'Siri' || chr(10) || 'Pay' AS features_other FROM part")
def price_info(spark, d):
    return E.price_info(spec_pages(spark, d)).select("page_id", "price_info", "features_other")


PICTURES = f"""CASE WHEN p_partkey % 2 = 0 THEN ['{T.BASE}pics/' || p_partkey || '.jpg', '{T.BASE}pics/' || p_partkey || '-2.jpg', 'cdn/' || p_partkey || '-a.jpg']
  ELSE ['{T.BASE}pics/' || p_partkey || '.jpg', '{T.BASE}pics/' || p_partkey || '-2.jpg'] END"""


@query("E11_picture_list", f"SELECT p_partkey AS page_id, array_to_string({PICTURES}, ' ') AS pictures FROM part")
def picture_list(spark, d):
    rows = E.picture_list(spec_pages(spark, d), gallery_pages(spark, d))
    return rows.select("page_id", F.array_join("pictures", " ").alias("pictures"))


@query("E12_page_title", r"""
SELECT page_id, trim(replace(replace(replace(regexp_replace(coalesce(regexp_extract(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g'),
  '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&amp;', '&')) AS title FROM pages""")
def page_title(spark, d):
    return E.page_title(T.wide_table(spark, d, "pages")).select("page_id", "title")


@query("E13_listing_count", ctes(T.CAT, T.NAMED, LISTINGS) + "SELECT page_id, CASE WHEN page % 2 = 0 THEN page + 7 ELSE items END AS devices FROM listing")
def listing_count(spark, d):
    return E.listing_count(listings(spark, d)).select("page_id", "devices")


@query("E14_assemble_records", ctes(PAGE_ROWS, r"""
features AS (
  SELECT page_id, t, cat, string_agg('"' || feature || '":' || CASE WHEN listed THEN '["' || array_to_string(items, '","') || '"]' ELSE '"' || items[1] || '"' END, ',' ORDER BY r) AS body
  FROM page_rows GROUP BY page_id, t, cat),
docs AS (
  SELECT page_id, '{' || string_agg('"' || cat || '":{' || body || '}' || CASE WHEN t = 0 THEN ',"technology":"' || (SELECT items[1] FROM page_rows r WHERE r.page_id = f.page_id AND feature = 'Technology') || '"' ELSE '' END, ',' ORDER BY t) || '}' AS specifications
  FROM features f GROUP BY page_id)""") + f"""
SELECT device_url, name, pictures, d.specifications, x.* FROM (
  SELECT {PROMOTED}, {CAMERAS}, {PRICE}, p_name || ' & ' || p_partkey AS name, '["' || array_to_string({PICTURES}, '","') || '"]' AS pictures,
         '{T.BASE}' || replace(p_name, ' ', '_') || '-' || p_partkey || '.php' AS device_url FROM part) x JOIN docs d USING (page_id)""".replace(
    "SELECT device_url, name, pictures, d.specifications, x.*", "SELECT x.*, d.specifications"))
def assemble_records(spark, d):
    return E.assemble_records(spec_pages(spark, d), gallery_pages(spark, d)).drop("detailed_specs")


@query("E14_detailed_specs", f"""
SELECT p_partkey AS page_id, 'GSM / LTE ' || p_size AS technology, 'HSDPA ' || p_size || '|HSDPA 2' AS bands, p_type || ' LCD' AS displaytype,
       p_size || 'GB' AS internal, 'Nano' AS sim_type, CASE WHEN p_partkey % 2 = 0 THEN p_size || ' MP' || chr(10) || '5 MP' ELSE p_size || ' MP' END AS modules,
       'Siri' || chr(10) || 'Pay' AS other, 'About ' || p_size || ' EUR' AS price FROM part""")
def detailed_specs(spark, d):
    """The record's second document, its keys by cell mark or in snake case."""
    doc = F.col("detailed_specs")
    at = lambda p: F.get_json_object(doc, p)
    return E.assemble_records(spec_pages(spark, d)).select(
        "page_id", at("$.network.technology").alias("technology"),
        F.concat(at("$.network.3g_bands[0]"), F.lit("|"), at("$.network.3g_bands[1]")).alias("bands"),
        at("$.display.displaytype").alias("displaytype"), at("$.memory.internal").alias("internal"), at("$.body.sim_type").alias("sim_type"),
        at("$.main_camera.modules").alias("modules"), at("$.features.other").alias("other"), at("$.price.text").alias("price"))
