import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from devicelode.llm import maintext
from devicelode.llm.queries import QUERIES

LONG = ["The first paragraph of the story, with a good many words, says what happened; the rest says why it did.",
        "A second paragraph follows, as long as the first one, and it ends here, after a number of further words.",
        "Third, the reasons: there were two, and neither of them is known to anybody but the teller of the story."]
P = "".join(f"<p>{x}</p>" for x in LONG)
NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News and weather</a></li></ul></nav>"
FOOT = "<footer><p>All rights reserved, 2020, by the firm that runs this, and by nobody else at all, as far as we know.</p></footer>"

LAYOUTS = {
    "semantic": (f"<body>{NAV}<main><article><header><h1>Title</h1></header>{P}</article></main><aside><p>{LONG[0]}</p></aside>{FOOT}</body>", ["Title", *LONG]),
    "named parts": (f"<div id=nav><a href=/>Start</a></div><div class='content with-sidebar'><h1>Title</h1>{P}</div><div class='sidebar-left'><p>{LONG[1]}</p></div>"
                    f"<div id='cookie-notice'><p>{LONG[2]}</p></div>", ["Title", *LONG]),
    "no names": (f"<body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><h1>Title</h1><div>{P}</div></div><div>Imprint 2020</div></body>", ["Title", *LONG]),
    "bare body": (f"<body>{NAV}<h1>Title</h1><p>{LONG[0]}<p>{LONG[1]}<ul><li>short item<li>next</ul><p>{LONG[2]}{FOOT}", ["Title", LONG[0], LONG[1], "short item", "next", LONG[2]]),
    "comments": (f"<article><h1>Title</h1>{P}<section class='comments'><article class='comment'><p>{LONG[0]} Says a reader.</p></article></section></article>", ["Title", *LONG]),
    "comments apart": (f"<article>{P}</article><ol id=comment-list><li><p>{LONG[1]} I agree.</p></li></ol>", LONG),
    "inline": ("<article><p>A <b>bold</b> and a <a href='x'>linked word</a>, H<sub>2</sub>O,\n\t two&nbsp;words<br>and more &lt;tags&gt; &#233;&#x20AC; &am</p></article>",
               ["A bold and a linked word, H2O, two words and more <tags> é€ &am"]),
    "form": (f"<article>{P}<form><p>{LONG[0]}</p><label>Mail</label><input><button>Send it</button></form></article>", LONG),
    "table": ("<article><h2>Sizes</h2><table><tr><th>Name<th>Size<tr><td>box<td>3 cm</table><blockquote>Said so.</blockquote><pre>a  b\n c</pre></article>",
              ["Sizes", "Name", "Size", "box", "3 cm", "Said so.", "a b c"]),
    "scripts": (f"<script>x = \"<article><p>no</p></article>\" + '<div class=\\'' ;</script ><style>p > a {{}}</style><article><!-- <p>no</p> -->{P}<script>y</script></article>", LONG),
    "unclosed": (f"<article><h1>Title<p><b>{LONG[0]}<br><p>{LONG[1]}", ["Title", LONG[0], LONG[1]]),
    "quotes": (f"<div class=\"ad\" title='a > b'>{LONG[0]}</div><div data-x=\"</div>\" class=text>{P}</div>", LONG),
    "hidden": (f"<article><p hidden>{LONG[0]}</p><div style='display: none'>{LONG[1]}</div><p>{LONG[2]}</p></article>", LONG[2:]),
    "empty": ("<html><head><title>T</title></head><body></body></html>", []),
    "only parts": (NAV + FOOT, []),
    "text": ("Just a line of text, no tags", ["Just a line of text, no tags"]),
    "open end": (f"<article>{P}<p>the end <a href='", [*LONG, "the end"]),
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert maintext.main_text(page).split("\n") == (want or [""])


def simple(page):
    """The article of the generated pages by splitting at block tags."""
    parts = re.split(r"<(?:h1|/h1|p|/p)>", re.search(r"<article>(.*?)</article>", page, re.S).group(1))
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_query_over_all_pages(spark):
    sf = "/root/testdata/sf0.01"
    want = sorted((r["page_id"], r["url"], simple(r["html"]), len(simple(r["html"]))) for r in spark.read.parquet(f"{sf}/pages.parquet").collect())
    assert sorted(map(tuple, QUERIES["op12_main_text"](spark, sf).collect())) == want
    assert len(want) > 200


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (None, None, LAYOUTS["semantic"][0]), (3, "u", "<p>x"), (3, "u", "<p>x"), (4, "u", "<>< p>&#0;&bogus; <3")]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in maintext.extracted(table).collect()), key=repr)
    want = [(i, u, maintext.main_text(h), len(maintext.main_text(h))) for i, u, h in rows]
    assert got == sorted(want, key=repr)
    assert want[0][2] == want[1][2] == "" and want[3][2] == "x" and want[2][2].startswith("Title\n")
    assert maintext.extracted(table.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x", "<p>" + "a<b>" * 60_000, '<a b="' * 40_000, "<!--" * 60_000, "<" * 200_000, "<script>" * 30_000, "x" * 2_000_000,
                                  "<li>y" * 40_000, "<a href=x>y" * 30_000])
def test_long_and_malformed_pages_take_linear_time(page):
    start = time.process_time()
    maintext.main_text(page)
    assert time.process_time() - start < 10


def test_smoothing_against_plain_sums():
    values = np.array([1.0, 5.0, 0.0, 2.0, 9.0, 4.0, 4.0])
    for n in range(1, 8):
        weights = lambda i: [(np.exp(-0.5 * (i - j) ** 2), values[j]) for j in range(n) if abs(i - j) <= 2]
        want = [sum(w * v for w, v in weights(i)) / sum(w for w, _ in weights(i)) for i in range(n)]
        assert np.allclose(maintext.smooth(values[:n]), want)
