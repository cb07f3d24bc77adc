"""Pages read as lines: no visible character is lost, nesting is told, odd markup has a result."""

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from passagelake.operators import layout
from passagelake.sources import html

FOLDER = "/root/testdata/sf0.001"


class Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def shown(page):
    parser = Visible()
    parser.feed(page)
    parser.close()
    return re.sub(r"[\s\xa0]+", "", "".join(parser.text))


def test_no_visible_character_is_lost(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    lines = {}
    for r in html.layout_lines(pages).orderBy("page_idx", "block_no").collect():
        lines.setdefault(r.page_idx, []).append(r.text)
    for r in pages.collect():
        assert re.sub(r"\s+", "", "".join(lines[r.page_id])) == shown(r.html)


CASES = {
    "inline tags stay in a line": ("<p>a <a href='x'>b <i>c</i></a> d</p>e", [("p", "a b c d"), ("p", "e")]),
    "nested blocks": ("<div>a<div class='x'>b<p>c</div>d</div>", [("p", "a"), ("p", "b"), ("p", "c"), ("p", "d")]),
    "lists in lists": ("<ul><li>a<ul><li><b>b</b></li></ul></li></ul>z", [("li", "a"), ("li", "b"), ("p", "z")]),
    "table cells": ("<table><tr><td>a</td><th>b</th></tr></table>", [("p", "a"), ("p", "b")]),
    "bold to the line's end": ("<p><b>a<br>b</p><p><strong>c</strong> d</p>", [("b", "a"), ("p", "b"), ("p", "c d")]),
    "hidden": ("<head><title>t</title></head><!-- <p>no</p> -->a<script>x('<p>')</script><style>p{}</style>b", [("p", "ab")]),
    "never closed": ("a<!-- b", [("p", "a")]),
    "a closing tag too many": ("</li></h1>a<h1>b</h1>c", [("p", "a"), ("h1", "b"), ("p", "c")]),
    "less than": ("1 < 2 &lt; 3 <b>x", [("p", "1 < 2 < 3 x")]),
    "capitals": ("<H1 ID=a>A</H1><FOOTER>f</FOOTER>", [("h1", "A"), ("footer", "f")]),
    "nothing": ("", []),
    "blank": ("<p> &nbsp; </p>", []),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_markup(spark, name):
    page, want = CASES[name]
    got = html._numbered(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("block_no").collect()
    assert [(r.tag, r.text) for r in got] == want


def test_boxes_of_nested_elements(spark):
    page = "<div>a<div>bb</div>c</div><div></div><ul><li>x<ul><li>yyyy</li></ul></ul><div>open"
    got = html.element_boxes(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("box_no").collect()
    assert [(r.tag, r.depth, r.y0, r.y1) for r in got] == [("div", 1, 0.0, 52.0), ("div", 2, 20.0, 32.0), ("ul", 1, 60.0, 92.0), ("ul", 2, 80.0, 92.0), ("div", 1, 100.0, 112.0)]
    assert got[1].x1 == 50.0 and got[3].x0 == 60.0


def brute_outermost(boxes):
    def holds(o, a):
        return o[2:] != a[2:] and o[2] <= a[2] + 1 and o[3] <= a[3] + 1 and o[4] >= a[4] - 1 and o[5] >= a[5] - 1

    return {a[:2] for a in boxes if not any(o[0] == a[0] and holds(o, a) for o in boxes)}


def test_outermost_boxes_of_all_sizes(spark):
    import random

    r = random.Random(8)
    rows = []
    for i in range(400):
        x, y, w, h = r.uniform(-500, 500), r.uniform(-500, 500), r.choice([0, 0.5, 3, 30, 300, 3000]) * r.random(), r.choice([0, 1, 10, 1000]) * r.random()
        rows.append((i % 3, i, x, y, x + w, y + h))
        if i % 4 == 0:
            rows.append((i % 3, 1000 + i, x + r.uniform(-1.5, 1), y + 0.2, x + w - 0.1, y + h + r.uniform(-1, 1.5)))
    got = layout.outermost(spark.createDataFrame(rows, "page_idx int, box_no int, x0 double, y0 double, x1 double, y1 double"), ["page_idx"])
    assert {(b.page_idx, b.box_no) for b in got.collect()} == brute_outermost(rows)


def test_many_boxes_on_one_page(spark):
    """A hundred thousand boxes of one page, few of which meet: all pairs would be ten thousand million."""
    n = F.col("id")
    x, y = (n % 400) * 25.0, F.floor(n / 400) * 25.0
    side = F.when(n % 10 == 0, 20.0).otherwise(4.0)
    boxes = spark.range(100_000).select(F.lit(0).alias("page_idx"), n.alias("box_no"), x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side).alias("y1"))
    inner = boxes.filter("box_no % 10 = 0").select("page_idx", (F.col("box_no") + 200_000).alias("box_no"), (F.col("x0") + 5).alias("x0"), (F.col("y0") + 5).alias("y0"), (F.col("x0") + 9).alias("x1"), (F.col("y0") + 9).alias("y1"))
    assert layout.outermost(boxes.union(inner), ["page_idx"]).agg(F.count("*"), F.max("box_no")).first()[:] == (100_000, 99_999)
    bands = boxes.filter("box_no % 400 = 0").select("page_idx", "box_no", F.col("y0").alias("top"), (F.col("y0") + 20).alias("bottom"))
    blocks = boxes.select("page_idx", F.col("box_no").alias("block_no"), "y0", "y1")
    assert layout.in_band(blocks, bands, ["page_idx"]).count() == 100_000
