"""Layout queries over booklets: every supplier is a unit of two pages, with the cases that layouts have.

The lines are made from a supplier's number and name; the SQL says what must come of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import corpus, layout
from ..operators.vocabulary import HEADERS
from ..scratch import scratch_path
from ..sources.files import read_markdown_tree
from .retrieval import table

U = F.lit  # a plain text
_UNMAPPED, _GAP, _LOST = 7, 9, 4


def _units(spark, d) -> DataFrame:
    u = table(spark, d, "supplier").select((F.col("s_suppkey") + 1).cast("int").alias("u"), F.col("s_name").alias("name"))
    return u.select("u", "name", F.when(F.col("u") % 2 == 0, "pilot").otherwise("trainer").alias("source"), F.when(F.col("u") % 12 == 5, "A").otherwise("").alias("variant"))


def _lines(spark, d) -> DataFrame:
    u, name = F.col("u"), F.col("name")
    n = u.cast("string")
    shown = F.when(u == 38, "37").otherwise(n)
    title = F.when(u % 9 == 3, F.concat(name, U(" basics"))).otherwise(F.concat(U("Unit "), n, "variant", U(" – "), name, U(" handling")))
    out: list[Column] = []

    def block(page: int, no: int, y: float, lines: list, size=10.0, bold=False, x=50.0, where: Column | None = None) -> None:
        for i, text in enumerate(lines):
            b = bold[i] if isinstance(bold, list) else bold
            z = size if not isinstance(size, Column) else size
            s = F.struct(
                (u * 2 + page - 1).alias("page_idx"), F.lit(no).alias("block_no"), F.lit(i).alias("line_no"), (text if isinstance(text, Column) else U(text)).alias("text"),
                (z if isinstance(z, Column) else F.lit(z)).alias("size"), F.lit(b).alias("bold"), U("Arial").alias("font"), F.lit(x[i] if isinstance(x, list) else x).alias("x0"), F.lit(y + 12 * i).alias("y0"),
            )
            out.append(s if where is None else F.when(where, s))

    def foot(page: int, label: Column, no: int) -> None:
        block(page, no, 800.0, [F.concat(U("Revision 1."), (u % 10).cast("string")), label], size=8.0)

    label = lambda p: F.concat(U("Page "), shown, "variant", U(f" - {p}"))
    for page in (1, 2):
        block(page, 0, 60.0, [title], size=14.0)
    block(1, 1, 80.0, ["PILOT GUIDE"])
    block(1, 2, 150.0, ["KEY MESSAGES"], size=F.when((F.col("source") == "trainer") & (u % 4 == 1), 11.0).otherwise(14.0), bold=True)
    block(1, 3, 170.0, [F.concat(name, U(" is kept")), "in good order."])
    block(1, 4, 200.0, ["•", F.concat(U("first point "), n), "runs on"])
    block(1, 5, 240.0, ["o", "nested"])
    block(1, 6, 270.0, [F.concat(U("● inline "), n)])
    block(1, 7, 290.0, ["1.", F.concat(U("Awareness "), n)], size=11.0, bold=[False, True])
    block(1, 8, 320.0, ["Suggested Patter:"], size=11.0, bold=True)
    block(1, 9, 340.0, [F.concat(U("Say "), name, U("."))])
    block(1, 10, 360.0, ["WSSSSSS"], where=F.col("source") == "pilot")
    foot(1, F.when(u % 10 == _LOST, "nothing").otherwise(label(1)), 11)
    block(2, 1, 150.0, ["THREAT AND ERROR", "MANAGEMENT"], size=14.0, bold=True)
    block(2, 2, 176.0, ["Look out."])
    block(2, 3, 190.0, ["COMMON PROBLEMS"], size=14.0, bold=True)
    block(2, 4, 210.0, ["Problem", "Probable Cause"], x=[50.0, 300.0])
    block(2, 5, 240.0, [F.concat(U("Too fast "), n)])
    block(2, 6, 240.0, ["● nose low", "too far"], x=300.0)
    block(2, 7, 280.0, ["Too slow"])
    block(2, 8, 293.0, ["and wobbly"])
    block(2, 9, 305.0, ["Plain cause"], x=300.0)
    block(2, 10, 330.0, ["Stalls", "• early", "• late"])
    block(2, 11, 400.0, ["right"], x=200.0)
    block(2, 12, 400.2, ["left"])
    block(2, 13, 420.0, [F.concat(U("NOT A HEADER "), n)], size=14.0, bold=True, where=u % 10 == _UNMAPPED)
    foot(2, F.when(u % 10 == _GAP, label(3)).otherwise(label(2)), 14)
    each = _units(spark, d).select("source", F.explode(F.array_compact(F.array(*out))).alias("l")).select("source", "l.*")
    return each.withColumn("x1", F.col("x0") + 40.0).withColumn("y1", F.col("y0") + 10.0)


def _boxes(spark, d) -> DataFrame:
    two = F.array(*[F.struct(F.lit(i).alias("box_no"), *[F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), b)]) for i, b in enumerate([(40.0, 205.0, 500.0, 370.0), (45.0, 230.0, 400.0, 300.0)])])
    return _units(spark, d).select("source", (F.col("u") * 2 + 1).alias("page_idx"), F.explode(two).alias("b")).select("source", "page_idx", "b.*")


def _wanted(spark, d) -> DataFrame:
    return _units(spark, d).select("source", F.concat(F.col("u").cast("string"), "variant").alias("unit_id"))


def booklet_footers(spark, d):
    return layout.footers(_lines(spark, d)).select("source", F.col("page_idx").cast("long"), F.col("unit").cast("long"), "variant", F.col("page").cast("long"))


def _own(spark, d):
    return layout.unit_lines(_lines(spark, d), layout.page_runs(layout.footers(_lines(spark, d)), _wanted(spark, d)))


def booklet_metadata(spark, d):
    return layout.metadata(_own(spark, d))


def booklet_roles(spark, d):
    """Every known header, of either source, written with other case and spacing, looked up for each source."""
    headers = [(s, h) for s, known in HEADERS.items() for h in known]
    rows = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(h).alias("h")) for i, (_, h) in enumerate(headers)])).alias("x")).select("r", "x.i", "x.h")
    rows = rows.withColumn("source", F.when(F.col("r") % 2 == 0, "pilot").otherwise("trainer"))
    text = F.when(F.col("r") == 0, F.col("h")).when(F.col("r") == 1, F.concat(F.lit("  "), F.lower("h"))).when(F.col("r") == 2, F.concat(F.lit("• "), F.replace("h", F.lit(" "), F.lit(" \t")))).when(F.col("r") == 3, F.concat(F.replace("h", F.lit(" "), F.lit("\u00a0")), F.lit("\u00a0"))).otherwise(F.concat("h", F.lit("!")))
    return rows.select("r", "i", layout.role(F.col("source"), text).alias("role"))


def _marked(spark, d):
    return layout.marked(_lines(spark, d))


def booklet_tables(spark, d):
    _, elements = layout.table_regions(_marked(spark, d), _boxes(spark, d))
    return elements.select("source", F.col("page_idx").cast("long"), F.col("box_no").cast("long"), F.col("seq.block_no").cast("long").alias("block_no"), F.col("seq.cell").cast("long").alias("cell"), F.col("seq.item").cast("long").alias("item"), "kind", "text")


def booklet_order(spark, d):
    regions, _ = layout.table_regions(_marked(spark, d), _boxes(spark, d))
    out = layout.reading_order(_marked(spark, d), regions)
    return out.select("source", F.col("page_idx").cast("long"), F.col("block_no").cast("long"), F.col("box_no").cast("long"), "y", "x", "place")


def booklet_units(spark, d):
    return layout.render_units(_lines(spark, d), _boxes(spark, d), _wanted(spark, d))


def booklet_corpus(spark, d):
    """All units and one that is not there, rendered, written as files and read back."""
    root = scratch_path(spark, "booklets")
    wanted = _units(spark, d).select("source", "u").union(spark.createDataFrame([("pilot", 0)], "source string, u int")).withColumnRenamed("u", "unit")
    done = corpus.build_corpus(_lines(spark, d), _boxes(spark, d), wanted, root)
    back = read_markdown_tree(spark, root).select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("content_sha256"))
    return done.join(back, "path", "left").select("source", "unit_id", "path", "error", "content_sha256")


QUERIES = {q.__name__: q for q in (booklet_footers, booklet_metadata, booklet_roles, booklet_tables, booklet_order, booklet_units, booklet_corpus)}

_U = """un AS (
  SELECT CAST(s_suppkey + 1 AS BIGINT) AS u, s_name AS name, CASE WHEN s_suppkey % 2 = 1 THEN 'pilot' ELSE 'trainer' END AS source, CASE WHEN (s_suppkey + 1) % 12 = 5 THEN 'A' ELSE '' END AS variant FROM supplier
)"""
_META = "CASE WHEN u % 9 = 3 THEN name || ' basics' ELSE name || ' handling' END"
_ERROR = f"""CASE WHEN u % 10 = {_GAP} THEN 'pages of unit ' || u || variant || ' of ' || source || ' are not consecutive: 1, 3'
  WHEN u % 10 = {_UNMAPPED} THEN 'unmapped section heading: NOT A HEADER ' || u END"""


def _text(*parts: str) -> str:
    return " || ".join(p if p.startswith(("u ", "name", "variant", "source", "CASE", "(")) or p == "u" else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in parts)


_PAGES = _text(
    "# Unit ", "u", "variant", " — ", f"({_META})", "\n\n<!-- page: ", "u", "variant", "-1 -->\n\n## KEY MESSAGES\n<!-- content_type: key_messages -->\n\n", "name", " is kept in good order.\n\n- first point ", "u",
    " runs on\n  - nested\n- inline ", "u", "\n\n### 1. Awareness ", "u", "\n\n#### Suggested Patter\n<!-- content_type: reference_patter -->\n\nSay ", "name", ".\n\n",
    "CASE WHEN source = 'pilot' AND u <> 34 THEN 'WSSSSSS' || chr(10) || chr(10) ELSE '' END", "<!-- page: ", "u", "variant",
    "-2 -->\n\n## THREAT AND ERROR MANAGEMENT\n<!-- content_type: airmanship -->\n\nLook out.\n\n## COMMON PROBLEMS\n<!-- content_type: common_problems -->\n\n### Too fast ", "u",
    "\n\n- nose low too far\n\n### Too slow and wobbly\n\nPlain cause\n\n### Stalls\n\n- early\n- late\n\nleft\n\nright\n",
)
_CONTENT = _text("---\nsource: ", "source", "\nunit: ", "u", "variant", "\nunit_name: ", f"({_META})", "\nrevision: \"1.", "(u % 10)", "\"\n---\n\n") + " || " + _PAGES
_RENDERED = f"SELECT source, u || variant AS unit_id, CASE WHEN ({_ERROR}) IS NULL THEN {_CONTENT} END AS content, {_ERROR} AS error FROM un"
_CELLS = [(5, 1, -1, "subheading", "'### Too fast ' || u"), (6, 1, 1, "bullet", "'nose low too far'"), (8, 1, -1, "subheading", "'### Too slow and wobbly'"), (9, 1, 0, "paragraph", "'Plain cause'"), (10, 1, -1, "subheading", "'### Stalls'"), (10, 1, 1, "bullet", "'early'"), (10, 1, 2, "bullet", "'late'")]
_PLACES = [(0, b, None, y, 50, place, "true") for place, (b, y) in enumerate([(0, 60), (1, 80), (2, 150), (3, 170), (4, 200), (5, 240), (6, 270), (7, 290), (8, 320), (9, 340)], 1)]
_PLACES += [(0, 10, None, 360, 50, 11, "source = 'pilot'"), (0, 11, None, 800, 50, "CASE WHEN source = 'pilot' THEN 12 ELSE 11 END", "true")]
_PLACES += [(1, b, None, y, 50, place, "true") for place, (b, y) in enumerate([(0, 60), (1, 150), (2, 176), (3, 190)], 1)] + [(1, b, 0, 210, 40, 5, "true") for b in range(4, 11)]
_PLACES += [(1, 12, None, 400, 50, 6, "true"), (1, 11, None, 400, 200, 7, "true"), (1, 13, None, 420, 50, 8, f"u % 10 = {_UNMAPPED}"), (1, 14, None, 800, 50, f"CASE WHEN u % 10 = {_UNMAPPED} THEN 9 ELSE 8 END", "true")]
_KNOWN = ", ".join(f"({i}, '{s}', '{h}', '{r}')" for i, (s, h, r) in enumerate((s, h.replace("'", "''"), r) for s, known in HEADERS.items() for h, r in known.items()))

ORACLES = {
    "booklet_footers": f"""WITH {_U}, p AS (SELECT *, unnest([1, 2]) AS p FROM un)
SELECT source, u * 2 + p - 1 AS page_idx, u AS unit, variant, CAST(CASE WHEN p = 2 AND u % 10 = {_GAP} THEN 3 ELSE p END AS BIGINT) AS page FROM p WHERE NOT (p = 1 AND u % 10 = {_LOST})""",
    "booklet_metadata": f"WITH {_U} SELECT source, u || variant AS unit_id, {_META} AS unit_name, '1.' || (u % 10) AS revision FROM un WHERE u % 10 <> {_GAP}",
    "booklet_roles": f"""WITH k(i, s, h, role) AS (VALUES {_KNOWN}), q AS (SELECT CAST(r_regionkey AS BIGINT) AS r, CASE WHEN r_regionkey % 2 = 0 THEN 'pilot' ELSE 'trainer' END AS source FROM region)
SELECT q.r, CAST(k.i AS BIGINT) AS i, CASE WHEN q.r < 4 THEN (SELECT o.role FROM k o WHERE o.s = q.source AND o.h = k.h) END AS role FROM q, k""",
    "booklet_tables": f"WITH {_U}, c AS (" + " UNION ALL ".join(f"SELECT source, u * 2 + 1 AS page_idx, 0::BIGINT AS box_no, {b}::BIGINT AS block_no, {c}::BIGINT AS cell, {i}::BIGINT AS item, '{kind}' AS kind, {text} AS text FROM un" for b, c, i, kind, text in _CELLS) + ") SELECT * FROM c",
    "booklet_order": f"WITH {_U}, c AS (" + " UNION ALL ".join(f"SELECT source, u * 2 + {p} AS page_idx, {b}::BIGINT AS block_no, {'NULL' if box is None else box}::BIGINT AS box_no, {y}::DOUBLE AS y, {x}::DOUBLE AS x, CAST({place} AS BIGINT) AS place FROM un WHERE {where}" for p, b, box, y, x, place, where in _PLACES) + ") SELECT * FROM c",
    "booklet_units": f"WITH {_U} {_RENDERED}",
    "booklet_corpus": f"""WITH {_U}, r AS ({_RENDERED}), p AS (SELECT *, source || '/unit-' || CASE WHEN length(regexp_extract(unit_id, '[0-9]+')) < 2 THEN '0' ELSE '' END || unit_id || '.md' AS file FROM r)
SELECT source, unit_id, CASE WHEN error IS NULL THEN file END AS path, error, CASE WHEN error IS NULL THEN sha256(content) END AS content_sha256 FROM p
UNION ALL SELECT 'pilot', '0', NULL, 'no pages of unit 0 in pilot', NULL""",
}
