"""Layout queries over web pages and over boxes made from parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout
from ..sources import html
from .retrieval import table


def _lines(spark, d) -> DataFrame:
    return html.layout_lines(table(spark, d, "pages"))


def layout_lines(spark, d):
    return _lines(spark, d).select(F.col("page_idx").alias("page_id"), F.col("block_no").cast("long"), F.sha2("text", 256).alias("text_sha256"), "size", "bold", "x0", "y0")


def element_boxes(spark, d):
    """Boxes of a page's lists, navigation, blocks and tables."""
    return html.element_boxes(table(spark, d, "pages")).select(F.col("page_idx").alias("page_id"), F.col("box_no").cast("long"), "tag", F.col("depth").cast("long"), "x0", "y0", "x1", "y1")


def chrome_filter(spark, d):
    return layout.content_blocks(layout.marked(_lines(spark, d))).select(F.col("page_idx").alias("page_id"), F.col("block_no").cast("long"), "marker", "section", "subheading")


def block_elements(spark, d):
    """Each page as one block: headings, lists and paragraphs of neighbouring lines."""
    whole = _lines(spark, d).withColumn("line_no", F.col("block_no")).withColumn("block_no", F.lit(0)).filter("size > 8.5")
    out = layout.block_elements(layout.marked(whole))
    return out.select(F.col("page_idx").alias("page_id"), F.col("seq.run").cast("long").alias("run"), F.when(F.col("kind") == "section", "section").otherwise(F.col("kind")).alias("kind"), F.sha2("text", 256).alias("text_sha256"))


def banner_name(spark, d):
    """Large lines that run through a unit's pages; twenty pages make a unit, the lang its name."""
    lines = _lines(spark, d)
    own = lines.withColumn("unit_id", F.floor(F.col("page_idx") / 20).cast("string")).withColumn("page", F.col("page_idx")).withColumn("bold", F.lit(False)).withColumn("size", F.when(F.col("size") > 11, 14.0).otherwise(F.col("size")))
    return layout.banners(own).select("unit_id", "banner")


def reading_order(spark, d):
    """Lines dealt to two columns by their place, then put in reading order."""
    lines = _lines(spark, d).withColumn("y0", F.floor(F.col("block_no") / 2) * 20.5).withColumn("y1", F.col("y0") + 12).withColumn("x0", (F.col("block_no") % 2) * -30.0 + 60.5)
    return layout.reading_order(lines).select(F.col("page_idx").alias("page_id"), F.col("block_no").cast("long"), "y", "x", "place")


def table_split(spark, d):
    """List items of each page, cut where a marker stands."""
    lines = layout.marked(_lines(spark, d).withColumn("line_no", F.col("block_no")).withColumn("block_no", F.lit(0)))
    out = layout.list_items(lines, ["page_idx"])
    return out.select(F.col("page_idx").alias("page_id"), F.col("item").cast("long"), "kind", F.sha2("text", 256).alias("text_sha256"))


def _boxes(spark, d) -> DataFrame:
    """A box for each part, forty boxes a page."""
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    x, y = (key * 37 % 200).cast("double"), (key * 53 % 300).cast("double")
    w, h = (F.col("p_size") * 7).cast("double"), (key % 11 * 20 + 5).cast("double")
    return p.select(F.floor(key / 40).alias("page_idx"), key.alias("box_no"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def box_outermost(spark, d):
    return layout.outermost(_boxes(spark, d), ["page_idx"]).select("page_idx", "box_no")


def band_join(spark, d):
    blocks = _boxes(spark, d).select("page_idx", F.col("box_no").alias("block_no"), "y0", "y1")
    bands = _boxes(spark, d).filter("box_no % 4 = 0").select("page_idx", "box_no", F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    return layout.in_band(blocks, bands, ["page_idx"]).select("page_idx", "block_no", "box_no")


def page_runs(spark, d):
    """Orders as footers: a customer is a unit, its orders by number the pages; one in five has lost its first page."""
    o = table(spark, d, "orders")
    c = F.col("o_custkey")
    pages = o.groupBy(c.alias("unit")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    each = pages.select(F.col("unit").cast("int"), F.posexplode("k").alias("pos", "page_idx"))
    page = F.when(F.col("unit") % 7 == 3, F.col("pos") * 2 + 1).otherwise(F.col("pos") + 1)
    found = each.select(F.lit("pilot").alias("source"), "page_idx", "unit", F.when(F.col("unit") % 6 == 0, "A").otherwise("").alias("variant"), page.alias("page"))
    found = found.filter("not (unit % 5 = 1 and page = 1)")
    wanted = table(spark, d, "customer").select(F.lit("pilot").alias("source"), F.col("c_custkey").cast("string").alias("unit_id"))
    out = layout.page_runs(found, wanted)
    kind = F.when(F.col("error").isNull(), "ok").when(F.col("error").contains("split"), "split").when(F.col("error").contains("consecutive"), "gap").otherwise("absent")
    return out.select("unit_id", kind.alias("outcome"), F.when(F.col("error").isNull(), F.size("pages")).cast("long").alias("n_pages"))


QUERIES = {
    "layout_lines": layout_lines,
    "element_boxes": element_boxes,
    "chrome_filter": chrome_filter,
    "block_elements": block_elements,
    "banner_name": banner_name,
    "reading_order": reading_order,
    "table_split": table_split,
    "box_outermost": box_outermost,
    "band_join": band_join,
    "page_runs": page_runs,
}

_BLOCK_LIST = ", ".join(f"'{t}'" for t in html.BLOCKS)
_VISIBLE = "html"
for _pattern in html.HIDDEN:
    _VISIBLE = f"regexp_replace({_VISIBLE}, '{_pattern}', '', 'g')"
_NESTED = [f"sum(CASE WHEN tag = '{t}' THEN CASE WHEN closes THEN -1 ELSE 1 END ELSE 0 END) OVER w AS {t}_" for t in html.INSIDE]
_FULL = r"FILTER (WHERE regexp_matches(m, '\S'))"
#: The tokens of a page, with the counts that tell lines and nesting.
_TOKENS = f"""tk AS (
  SELECT page_id, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all({_VISIBLE}, '{html.TOKEN}') AS ms FROM pages)
), tg AS (
  SELECT page_id, pos, m, mk, CASE WHEN mk THEN lower(regexp_extract(m, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) ELSE '' END AS tag, mk AND starts_with(m, '</') AS closes FROM (SELECT *, regexp_matches(m, '^<[/!?A-Za-z]') AS mk FROM tk)
), td AS (
  SELECT *, sum((tag IN ({_BLOCK_LIST}))::INT) OVER w AS line, {", ".join(_NESTED)} FROM tg WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), te AS (
  SELECT *, sum(CASE WHEN tag IN ('b', 'strong') THEN CASE WHEN closes THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id, line ORDER BY pos ROWS UNBOUNDED PRECEDING) > 0 AS bold,
    {", ".join(f"{t}_ > least(0, min({t}_) OVER v) AS in_{t}" for t in html.INSIDE)} FROM td WINDOW v AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), tx AS (
  SELECT page_id, line, min(pos) AS first_, string_agg(m, '' ORDER BY pos) AS raw, bool_and(bold) {_FULL} AS b, {", ".join(f"bool_or(in_{t}) {_FULL} AS {t}" for t in html.INSIDE)} FROM te WHERE NOT mk GROUP BY page_id, line
)"""
_TEXT = "raw"
for _code, _char in html.ENTITIES:
    _TEXT = f"replace({_TEXT}, '{_code}', '{_char.replace(chr(39), 2 * chr(39))}')"
_LINES = _TOKENS + r""", l AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY line) - 1 AS block_no, first_, CASE WHEN h1 THEN 'h1' WHEN li THEN 'li' WHEN footer THEN 'footer' WHEN b THEN 'b' ELSE 'p' END AS tag, text FROM (
    SELECT *, trim(regexp_replace(@TEXT@, '\s+', ' ', 'g')) AS text FROM tx) WHERE text <> ''
), li AS (
  SELECT page_id, block_no, tag, text, CASE tag WHEN 'h1' THEN 16.0::DOUBLE WHEN 'b' THEN 12.0::DOUBLE WHEN 'footer' THEN 8.0::DOUBLE ELSE 10.0::DOUBLE END AS size, tag IN ('h1', 'b') AS bold,
    CASE tag WHEN 'li' THEN 60.0::DOUBLE ELSE 40.0::DOUBLE END AS x0, block_no * 20.0::DOUBLE AS y0, first_,
    CASE WHEN tag = 'li' OR regexp_matches(text, '^[•●]( |$)') THEN 'bullet' WHEN text = 'o' THEN 'subbullet' WHEN regexp_matches(text, '^\d{1,2}\.$') THEN 'ordered' END AS marker FROM l WHERE text <> ''
)""".replace("@TEXT@", _TEXT)
_BODY = r"regexp_replace(text, '^(?:•(?: |$))?(?:●(?: |$))?(?:o(?: |$))?', '')"
_BOX = "b AS (SELECT p_partkey // 40 AS page_idx, p_partkey AS box_no, (p_partkey * 37 % 200)::DOUBLE AS x0, (p_partkey * 53 % 300)::DOUBLE AS y0, (p_partkey * 37 % 200 + p_size * 7)::DOUBLE AS x1, (p_partkey * 53 % 300 + p_partkey % 11 * 20 + 5)::DOUBLE AS y1 FROM part)"

ORACLES = {
    "layout_lines": f"WITH {_LINES} SELECT page_id, block_no, sha256(text) AS text_sha256, size, bold, x0, y0 FROM li",
    "element_boxes": f"""WITH {_LINES}, eo AS (
  SELECT *, sum(CASE WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS UNBOUNDED PRECEDING) + closes::INT AS depth FROM tg WHERE tag IN ('table', 'ul', 'ol', 'nav', 'div')
), es AS (SELECT *, min(CASE WHEN closes THEN pos END) OVER (PARTITION BY page_id, tag, depth ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_ FROM eo),
bx AS (
  SELECT es.page_id, es.pos, es.tag, es.depth, min(li.x0) AS x0, min(li.y0) AS y0, max(li.x0 + length(li.text) * 5.0::DOUBLE) AS x1, max(li.y0 + 12.0::DOUBLE) AS y1
  FROM es JOIN li ON li.page_id = es.page_id AND li.first_ > es.pos AND (es.end_ IS NULL OR li.first_ < es.end_) WHERE NOT es.closes GROUP BY ALL
) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS box_no, tag, CAST(depth AS BIGINT) AS depth, x0, y0, x1, y1 FROM bx""",
    "chrome_filter": f"WITH {_LINES} SELECT page_id, block_no, marker, tag = 'h1' AS section, tag = 'b' AS subheading FROM li WHERE size > 8.5 AND NOT (marker IS NULL AND regexp_matches(text, '^Unit\\s+\\d+\\s*[A-Z]?\\s*([-–].*)?$'))",
    "block_elements": f"""WITH {_LINES}, k AS (
  SELECT *, CASE WHEN marker IS NOT NULL THEN 'marker' WHEN tag = 'h1' THEN 'section' WHEN tag = 'b' THEN 'sub' ELSE 'plain' END AS what FROM li WHERE size > 8.5
), g AS (
  SELECT *, lag(what) OVER w AS bef, lag(marker) OVER w AS bm, last_value(CASE WHEN what <> 'plain' THEN what END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS las FROM k WINDOW w AS (PARTITION BY page_id ORDER BY block_no)
), r AS (
  SELECT *, sum((NOT coalesce((what = 'plain' AND (bef = 'plain' OR las = 'marker')) OR (what = 'section' AND bef = 'section') OR (what = 'sub' AND (bef = 'sub' OR (bef = 'marker' AND bm = 'ordered'))), false))::INT) OVER (PARTITION BY page_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS run FROM g
), e AS (
  SELECT page_id, run, first(what ORDER BY block_no) AS fw, first(marker ORDER BY block_no) AS fm, bool_or(what = 'sub') AS sub,
    string_agg(text, ' ' ORDER BY block_no) AS raw, coalesce(string_agg(CASE WHEN what = 'marker' AND marker <> 'ordered' THEN nullif({_BODY}, '') ELSE text END, ' ' ORDER BY block_no), '') AS body FROM r GROUP BY ALL
)
SELECT page_id, CAST(run AS BIGINT) AS run, CASE WHEN fw = 'section' THEN 'section' WHEN sub THEN 'subheading' WHEN fw = 'marker' THEN fm ELSE 'paragraph' END AS kind,
  sha256(CASE WHEN fw = 'section' THEN '## ' || raw || chr(10) || '<!-- content_type: unknown -->' WHEN sub THEN '### ' || raw ELSE body END) AS text_sha256 FROM e""",
    "banner_name": f"""WITH {_LINES}, c AS (SELECT CAST(page_id // 20 AS VARCHAR) AS unit_id, page_id, block_no, trim(text) AS banner FROM li WHERE size > 11),
n AS (SELECT unit_id, banner, count(DISTINCT page_id) AS n, min(page_id * 100000 + block_no) AS first_at FROM c GROUP BY ALL HAVING count(DISTINCT page_id) >= 2)
SELECT unit_id, banner FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, first_at) AS k FROM n) WHERE k = 1""",
    "reading_order": f"WITH {_LINES}, p AS (SELECT page_id, block_no, round_even((block_no // 2) * 20.5, 0) AS y, round_even((block_no % 2) * -30.0 + 60.5, 0) AS x FROM li) SELECT page_id, block_no, y::DOUBLE AS y, x::DOUBLE AS x, row_number() OVER (PARTITION BY page_id ORDER BY y, x, block_no) AS place FROM p",
    "table_split": f"""WITH {_LINES}, g AS (SELECT *, sum((marker IS NOT NULL)::INT) OVER (PARTITION BY page_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS item FROM li)
SELECT page_id, CAST(item AS BIGINT) AS item, coalesce(first(marker ORDER BY block_no), 'paragraph') AS kind, sha256(coalesce(string_agg(CASE WHEN marker IS NOT NULL THEN nullif({_BODY}, '') ELSE text END, ' ' ORDER BY block_no), '')) AS text_sha256 FROM g GROUP BY page_id, item""",
    "box_outermost": f"WITH {_BOX} SELECT a.page_idx, a.box_no FROM b a WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.page_idx = a.page_idx AND NOT (o.x0 = a.x0 AND o.y0 = a.y0 AND o.x1 = a.x1 AND o.y1 = a.y1) AND o.x0 <= a.x0 + 1 AND o.y0 <= a.y0 + 1 AND o.x1 >= a.x1 - 1 AND o.y1 >= a.y1 - 1)",
    "band_join": f"WITH {_BOX} SELECT a.page_idx, a.box_no AS block_no, o.box_no FROM b a JOIN b o ON a.page_idx = o.page_idx AND o.box_no % 4 = 0 AND (a.y0 + a.y1) / 2 BETWEEN o.y0 - 1 AND o.y1 + 1",
    "page_runs": """WITH f AS (SELECT o_custkey AS unit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
g AS (SELECT unit, CASE WHEN unit % 7 = 3 THEN pos * 2 + 1 ELSE pos + 1 END AS page FROM f),
h AS (SELECT * FROM g WHERE NOT (unit % 5 = 1 AND page = 1)),
r AS (SELECT unit, list_sort(list(page)) AS p FROM h GROUP BY 1), s AS (SELECT unit, CASE WHEN p[1] = 2 THEN list_prepend(1, p) ELSE p END AS p FROM r)
SELECT CAST(c_custkey AS VARCHAR) AS unit_id, CASE WHEN p IS NULL THEN 'absent' WHEN unit % 6 = 0 THEN 'split' WHEN p <> range(1, len(p) + 1) THEN 'gap' ELSE 'ok' END AS outcome, CASE WHEN p IS NOT NULL AND unit % 6 <> 0 AND p = range(1, len(p) + 1) THEN CAST(len(p) AS BIGINT) END AS n_pages FROM customer LEFT JOIN s ON s.unit = c_custkey""",
}
