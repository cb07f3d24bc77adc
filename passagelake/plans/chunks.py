"""Chunking queries: Markdown is written from the documents' lines, the same way in Spark and in SQL.

The lines of a document become sections, sub-sections, paragraphs, lists and page marks by their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, slug
from ..operators import chunking
from ..operators.listsplit import LIMIT
from ..scratch import materialize
from .retrieval import table

_KINDS = chunking.CONTENT_TYPES


def _headed(t: Column) -> Column:
    return F.regexp_extract(t, r"^(\S+(?: \S+){0,3})", 1)


def _written(t: Column, i: Column) -> Column:
    """The Markdown lines that line i (from 0) of a document becomes."""
    place = i % 10
    nth = F.floor(i / 10)
    head = F.coalesce(F.nullif(_headed(t), F.lit("")), F.lit("Untitled 1"))
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.pmod(F.col("doc_id") + nth, F.lit(len(_KINDS))) + 1).cast("int"))
    page = F.concat(F.lit("<!-- page: "), F.col("doc_id").cast("string"), F.lit("-"), (nth + 1).cast("string"), F.lit(" -->"))
    return (
        F.when(place == 0, F.array(F.concat(F.lit("## "), head), F.concat(F.lit("<!-- content_type: "), kind, F.lit(" -->")), page, F.lit(""), t))
        .when(place == 3, F.array(F.concat(F.lit("### "), head), F.lit(""), t))
        .when(place.isin(4, 5), F.array(F.concat(F.lit("- "), t)))
        .when(place == 6, F.array(F.concat(F.lit("  - "), head), head))
        .when(place == 7, F.array(F.lit(""), F.concat(head, F.lit(":"))))
        .when(place == 8, F.array(F.lit("1. Do this."), F.concat(F.lit("- "), head, F.lit(".")), F.concat(F.lit("- "), head)))
        .otherwise(F.array(t, F.lit("")))
    )


def units(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    body = F.array_join(F.flatten(F.transform(lines(F.col("text")), _written)), "\n")
    front = F.concat(F.lit("---\nsource: "), "source", F.lit("\nunit: \""), F.col("doc_id").cast("string"), F.lit("\"\nunit_name: About "), "lang", F.lit("\nrevision: \"1.0\"\n---\n# Unit\n\n"))
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(front, body).alias("content"))


def _records(spark, d, kinds=("parent", "child")):
    return chunking.chunk_units(units(spark, d), strict=False, kinds=kinds)


def line_explode(spark, d):
    rows = chunking.classified(units(spark, d))
    return rows.select("path", F.col("pos").cast("long"), F.when(F.col("page_mark").isNotNull(), "page").when(F.col("type_mark").isNotNull(), "type").when(F.col("level").isNotNull(), "heading").otherwise("body").alias("kind"), F.length("line").cast("long").alias("chars"))


def page_of_line(spark, d):
    return chunking.body_lines(chunking.classified(units(spark, d))).select("path", F.col("pos").cast("long"), "page")


def slugify(spark, d):
    return table(spark, d, "pages").select("page_id", slug(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("slug"))


def heading_tree(spark, d):
    rows = chunking.classified(units(spark, d))
    return chunking.section_nodes(units(spark, d), rows).select("path", F.col("owner").cast("long").alias("pos"), F.col("level").cast("long"), "id_path", F.array_join("heading_path", " > ").alias("heading_path"), "content_type")


def slug_dedupe(spark, d):
    return chunking.heading_tree(chunking.classified(units(spark, d))).select("path", F.col("pos").cast("long"), "slug", "own_slug")


def chunk_parents(spark, d):
    return _records(spark, d, ("parent",)).select("id", "content_type", F.array_join("heading_path", " > ").alias("heading_path"), F.array_join("pages", ",").alias("pages"), F.sha2("text", 256).alias("text_sha256"), "content_hash")


def chunk_children(spark, d):
    lined = chunking.blocks(chunking.body_lines(chunking.classified(units(spark, d))))
    return chunking.children(lined).select("path", F.col("owner").cast("long"), F.col("ordinal").cast("long"), "kind", F.sha2("text", 256).alias("text_sha256"), F.array_join("pages", ",").alias("pages"))


def chunk_blocks(spark, d):
    lined = chunking.blocks(chunking.body_lines(chunking.classified(units(spark, d))))
    return lined.select("path", F.col("owner").cast("long"), F.col("pos").cast("long"), F.col("block").cast("long"), "kind")


def chunk_records(spark, d):
    own = _records(spark, d)
    return own.select("id", "kind", "parent_id", "content_hash", F.sha2("embedding_text", 256).alias("embedding_sha256"), F.array_join("pages", ",").alias("pages"))


def _split_pieces(spark, d, line):
    """Every document as one list, split at the word limit; line(text, i): what its line i (from 0) becomes."""
    docs = table(spark, d, "documents").filter("text is not null")
    each = docs.select("doc_id", F.posexplode(chunking.split_places(F.transform(lines(F.col("text")), line))).alias("piece", "p"))
    return each.select("doc_id", F.col("piece").cast("long"), F.size("p.at").cast("long").alias("n_lines"), F.col("p.words").alias("n_words"))


def list_split_500(spark, d):
    """A line an item."""
    return _split_pieces(spark, d, lambda x, i: F.concat(F.lit("- "), x))


def list_split_nested(spark, d):
    """Items of 90 lines with nested items of 45 and plain lines between them: in long texts both are over the limit, so items
    are packed from nested ones, and those from lines, each with its head."""
    return _split_pieces(spark, d, lambda x, i: F.concat(F.when(i % 90 == 0, "- ").when(i % 45 == 1, "  - ").otherwise("    "), x))


def _faulty(spark, d):
    """Units with a fault by their number."""
    own = units(spark, d)
    n = F.col("path").cast("long") % 6
    c = F.col("content")
    bad = F.when(n == 0, F.expr("substring(content, 5)")).when(n == 1, F.regexp_replace(c, "\nrevision: \"1.0\"", "")).when(n == 2, F.regexp_replace(c, "content_type: [a-z_]+", "content_type: nothing")).when(n == 3, F.regexp_replace(c, "# Unit\n", "# Unit\nearly\n")).when(n == 4, F.concat(c, F.lit("\n# Late")))
    return own.select("path", F.coalesce(bad, c).alias("content"))


def chunk_violations(spark, d):
    faulty = _faulty(spark, d)
    rows = materialize(chunking.classified(faulty), "chunk-lines")
    return chunking.violations(faulty, rows).groupBy("path", "rule").agg(F.count("*").alias("n"))


QUERIES = {
    "line_explode": line_explode,
    "page_of_line": page_of_line,
    "slugify": slugify,
    "slug_dedupe": slug_dedupe,
    "heading_tree": heading_tree,
    "chunk_blocks": chunk_blocks,
    "chunk_parents": chunk_parents,
    "chunk_children": chunk_children,
    "chunk_records": chunk_records,
    "list_split_500": list_split_500,
    "list_split_nested": list_split_nested,
    "chunk_violations": chunk_violations,
}

_KIND_LIST = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"
_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"

#: Lines as the operator sees them: the title and a blank line come first.
LINES = rf"""src AS (
  SELECT doc_id, source, lang, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS t, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL
), hd AS (
  SELECT *, coalesce(nullif(regexp_extract(t, '^(\S+(?: \S+){{0,3}})', 1), ''), 'Untitled 1') AS h, i // 10 AS nth,
         {_KIND_LIST}[(doc_id + i // 10) % {len(_KINDS)} + 1] AS ct FROM src
), wr AS (
  SELECT doc_id, source, lang, i, CASE i % 10
    WHEN 0 THEN ['## ' || h, '<!-- content_type: ' || ct || ' -->', '<!-- page: ' || doc_id || '-' || (nth + 1) || ' -->', '', t]
    WHEN 3 THEN ['### ' || h, '', t]
    WHEN 4 THEN ['- ' || t] WHEN 5 THEN ['- ' || t]
    WHEN 6 THEN ['  - ' || h, h]
    WHEN 7 THEN ['', h || ':']
    WHEN 8 THEN ['1. Do this.', '- ' || h || '.', '- ' || h]
    ELSE [t, ''] END AS ls FROM hd
), al AS (
  SELECT doc_id, source, lang, i, 0 AS j, unnest(ls) AS line, generate_subscripts(ls, 1) AS jj FROM wr
  UNION ALL SELECT DISTINCT doc_id, source, lang, -1, 0, '# Unit', 0 FROM src UNION ALL SELECT DISTINCT doc_id, source, lang, -1, 1, '', 1 FROM src
), nb AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, jj) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS many FROM al
), ln AS (
  SELECT CAST(doc_id AS VARCHAR) AS path, source, lang, p AS pos, line,
    nullif(regexp_extract(line, '^<!-- page: (\S+) -->\s*$', 1), '') AS page_mark,
    nullif(regexp_extract(line, '^<!-- content_type: (\S+) -->\s*$', 1), '') AS type_mark,
    nullif(length(regexp_extract(line, '^(#{{1,6}}) (.+?)\s*$', 1)), 0) AS level,
    nullif(regexp_extract(line, '^(#{{1,6}}) (.+?)\s*$', 2), '') AS heading
  FROM nb WHERE NOT (line = '' AND p = many - 1)
), cl AS (
  SELECT *, last_value(page_mark IGNORE NULLS) OVER w AS page,
    max(CASE WHEN level = 2 THEN pos END) OVER w AS h2, max(CASE WHEN level = 3 THEN pos END) OVER w AS h3, max(CASE WHEN level >= 2 THEN pos END) OVER w AS owner
  FROM ln WINDOW w AS (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING)
)"""
_TREE = f"""{LINES}, hn AS (
  SELECT path, source, lang, pos, level, heading, CASE WHEN level = 3 THEN h2 END AS parent_pos, {_SLUG.format('heading')} AS slug FROM cl WHERE level >= 2
), ho AS (
  SELECT *, CASE WHEN slug = '' THEN '' WHEN nth > 1 THEN slug || '-' || nth ELSE slug END AS own_slug
  FROM (SELECT *, row_number() OVER (PARTITION BY path, parent_pos, slug ORDER BY pos) AS nth FROM hn)
), ot AS (SELECT path, owner AS pos, max_by(type_mark, cl.pos) AS own_type FROM cl WHERE type_mark IS NOT NULL GROUP BY path, owner
), nd AS (
  SELECT c.path, c.source, c.lang, c.pos, c.level, coalesce(ot.own_type, op.own_type) AS content_type,
    CASE WHEN c.own_slug = '' THEN '' WHEN c.level = 3 THEN c.source || ':' || c.path || ':' || p.own_slug || ':' || c.own_slug ELSE c.source || ':' || c.path || ':' || c.own_slug END AS id_path,
    CASE WHEN c.level = 3 THEN p.heading || ' > ' || c.heading ELSE c.heading END AS heading_path,
    coalesce(p.own_slug = '', false) AS under_empty
  FROM ho c LEFT JOIN ho p ON p.path = c.path AND p.pos = c.parent_pos LEFT JOIN ot ON ot.path = c.path AND ot.pos = c.pos LEFT JOIN ot op ON op.path = c.path AND op.pos = c.parent_pos
)"""
_BODY = r""", bl AS (
  SELECT path, owner, pos, line, page, NOT regexp_matches(line, '\S') AS blank FROM cl WHERE page_mark IS NULL AND type_mark IS NULL AND level IS NULL AND owner IS NOT NULL
), bd AS (
  SELECT * FROM (SELECT *, bool_or(NOT blank) OVER (PARTITION BY path, owner ORDER BY pos ROWS UNBOUNDED PRECEDING) AS began FROM bl) WHERE began
)"""
_BLOCKS = _BODY + r""", f1 AS (
  SELECT *, sum(blank::INT) OVER (PARTITION BY path, owner ORDER BY pos ROWS UNBOUNDED PRECEDING) AS blanks FROM bd
), f2 AS (
  SELECT *, regexp_replace(lag(line) OVER w, '\s+$', '') AS prev, lag(blanks) OVER w AS blanks_before,
    regexp_matches(line, '^\s*(?:-|\d+\.)\s|^[a-z]\.\s|^[a-z]\s[A-Z]') AS marker FROM f1 WHERE NOT blank WINDOW w AS (PARTITION BY path, owner ORDER BY pos)
), f3 AS (
  SELECT *, last_value(CASE WHEN marker THEN 'list' WHEN prev IS NOT NULL AND (NOT regexp_matches(prev, '[.!?:]$') OR regexp_matches(line, '^\s*\p{Ll}')) THEN NULL ELSE 'para' END IGNORE NULLS)
    OVER (PARTITION BY path, owner ORDER BY pos ROWS UNBOUNDED PRECEDING) AS kind FROM f2
), f4 AS (
  SELECT *, coalesce(kind <> lag(kind) OVER (PARTITION BY path, owner ORDER BY pos), true) AS turn FROM f3
), f5 AS (
  SELECT *, sum(turn::INT) OVER (PARTITION BY path, owner ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run,
    kind = 'list' AND NOT turn AND starts_with(line, '- ') AND coalesce(regexp_matches(prev, '[.!?]$'), false) AS dash, regexp_matches(line, '^\d+\.\s') AS number FROM f4
), f6 AS (
  SELECT *, coalesce(max(CASE WHEN number THEN pos END) OVER w, -1) AS ln_, coalesce(max(CASE WHEN dash THEN pos END) OVER w, -1) AS ld
  FROM f5 WINDOW w AS (PARTITION BY path, owner, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f7 AS (
  SELECT path, owner, pos, kind, sum((turn OR (kind = 'para' AND coalesce(blanks > blanks_before, false)) OR (dash AND ln_ > ld))::INT) OVER (PARTITION BY path, owner ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM f6
), fb AS (
  SELECT * FROM (SELECT bd.path, bd.owner, bd.pos, bd.line, bd.page, bd.blank,
    last_value(f7.block IGNORE NULLS) OVER w AS block, last_value(f7.kind IGNORE NULLS) OVER w AS kind
    FROM bd LEFT JOIN f7 USING (path, owner, pos) WINDOW w AS (PARTITION BY path, owner ORDER BY pos ROWS UNBOUNDED PRECEDING)) WHERE NOT blank OR kind = 'list'
)"""
_CHILDREN = _BLOCKS + r""", ag AS (
  SELECT path, owner, block, kind, string_agg(line, chr(10) ORDER BY pos) AS raw, regexp_replace(last(line ORDER BY pos), '\s+$', '') AS tail FROM fb GROUP BY ALL
), jo AS (
  SELECT *, lag(kind = 'para' AND ends_with(tail, ':')) OVER w AS was_intro, lag(raw) OVER w AS before, lag(block) OVER w AS before_block, lead(kind) OVER w AS next_kind FROM ag WINDOW w AS (PARTITION BY path, owner ORDER BY block)
), kc AS (
  SELECT path, owner, block, kind, CASE WHEN kind = 'list' AND was_intro THEN before_block END AS intro, CASE WHEN kind = 'list' AND was_intro THEN before END AS lead_in
  FROM jo WHERE NOT (kind = 'para' AND ends_with(tail, ':') AND coalesce(next_kind = 'list', false))
), lw AS (
  SELECT path, owner, block, pos, line, page, blank, len(regexp_extract_all(line, '\S+')) AS nw, regexp_matches(line, '^(?:-|\d+\.)\s') AS top,
    regexp_matches(line, '^\s+(?:(?:-|\d+\.)\s|[a-z]\.\s|[a-z]\s[A-Z])') AS nested FROM fb WHERE kind = 'list'
), @SPLIT@, pc AS (
  SELECT kc.path, kc.owner, kc.block, 0 AS piece, kc.kind, kc.intro, kc.lead_in, fb.pos, fb.line, fb.page, fb.blank, fb.pos AS ord FROM kc JOIN fb USING (path, owner, block)
  WHERE (kc.path, kc.owner, kc.block) NOT IN (SELECT (path, owner, block) FROM big)
  UNION ALL SELECT kc.path, kc.owner, kc.block, sp.piece, kc.kind, CASE WHEN sp.piece = 1 THEN kc.intro END, CASE WHEN sp.piece = 1 THEN kc.lead_in END, sp.pos, sp.line, sp.page, sp.blank, sp.ord FROM kc JOIN sp USING (path, owner, block)
), ch AS (
  SELECT path, owner, block, piece, kind, any_value(intro) AS intro, trim(coalesce(any_value(lead_in) || chr(10) || chr(10), '') || string_agg(line, chr(10) ORDER BY ord), chr(10)) AS text,
    row_number() OVER (PARTITION BY path, owner ORDER BY block, piece) AS ordinal
  FROM pc GROUP BY path, owner, block, piece, kind
), pg AS (
  SELECT path, owner, ordinal, string_agg(page, ',' ORDER BY part, ord) AS pages FROM (
    SELECT *, lag(page) OVER (PARTITION BY path, owner, ordinal ORDER BY part, ord) AS prev_page FROM (
      SELECT ch.path, ch.owner, ch.ordinal, 1 AS part, pc.ord, pc.page FROM ch JOIN pc USING (path, owner, block, piece) WHERE NOT pc.blank AND pc.page IS NOT NULL
      UNION ALL SELECT ch.path, ch.owner, ch.ordinal, 0, fb.pos, fb.page FROM ch JOIN fb ON fb.path = ch.path AND fb.owner = ch.owner AND fb.block = ch.intro WHERE NOT fb.blank AND fb.page IS NOT NULL))
  WHERE prev_page IS NULL OR prev_page <> page GROUP BY ALL
)"""

def _split(lines: str) -> str:
    """CTEs, the last called sp: the pieces (path, owner, block, piece from 1, pos, line, page, blank, ord) of the big blocks
    of `lines`, a CTE (path, owner, block, pos, line, page, blank, nw, top, nested): a greedy packing of a segment's parts."""
    block = "path, owner, block"
    return f"""big AS (SELECT {block} FROM {lines} GROUP BY ALL HAVING sum(nw) > {LIMIT}),
s1 AS (SELECT l.*, sum((top OR pos = first_pos)::INT) OVER (PARTITION BY {block} ORDER BY pos) AS item FROM (SELECT *, min(pos) OVER (PARTITION BY {block}) AS first_pos FROM {lines}) l JOIN big USING ({block})),
s2 AS (SELECT *, row_number() OVER (PARTITION BY {block}, item ORDER BY pos) AS rn, sum(nw) OVER (PARTITION BY {block}, item) > {LIMIT} AS large FROM s1),
s3 AS (SELECT *, max(rn) OVER (PARTITION BY {block}, item) AS most, first_value(nw) OVER (PARTITION BY {block}, item ORDER BY pos) AS head_nw,
  CASE WHEN rn > 1 THEN sum((nested OR rn = 2)::INT) OVER (PARTITION BY {block}, item, rn > 1 ORDER BY pos) END AS inner_, sum((large AND rn = 1)::INT) OVER (PARTITION BY {block} ORDER BY pos) AS larges FROM s2),
s4 AS (SELECT *, sum(nw) OVER (PARTITION BY {block}, item, inner_) + head_nw > {LIMIT} AS over_, inner_ IS DISTINCT FROM lag(inner_) OVER (PARTITION BY {block}, item ORDER BY pos) AS opens FROM s3),
s5 AS (SELECT *, large AND most > 1 AS cut, sum((over_ AND rn > 1 AND opens)::INT) OVER (PARTITION BY {block}, item ORDER BY pos) AS overs FROM s4),
s6 AS (SELECT *, CASE WHEN NOT cut AND large THEN [item, 0, 0] WHEN NOT cut THEN [0, 0, larges] WHEN over_ THEN [item, 2, inner_] ELSE [item, 1, overs] END AS seg,
  CASE WHEN NOT cut THEN item WHEN over_ THEN pos ELSE inner_ END AS part FROM s5 WHERE NOT (cut AND rn = 1)),
s7 AS (SELECT {block}, seg, part, min(pos) AS at_, sum(nw) AS size, any_value(CASE WHEN cut THEN head_nw ELSE 0 END) AS head_nw, bool_or(cut) AS headed, bool_or(cut AND over_) AS keep, any_value(item) AS item FROM s6 GROUP BY {block}, seg, part),
s8 AS (SELECT *, row_number() OVER (PARTITION BY {block}, seg ORDER BY at_) AS i, min(at_) OVER (PARTITION BY {block}, seg) AS seg_at FROM s7),
pk AS (
  SELECT {block}, seg, i, part, CASE WHEN keep AND head_nw + size > {LIMIT} THEN 1 ELSE 0 END AS p, CAST(head_nw + size AS BIGINT) AS total FROM s8 WHERE i = 1
  UNION ALL SELECT s8.path, s8.owner, s8.block, s8.seg, s8.i, s8.part, pk.p + CASE WHEN pk.total + s8.size > {LIMIT} THEN 1 ELSE 0 END, CAST(CASE WHEN pk.total + s8.size > {LIMIT} THEN s8.head_nw ELSE pk.total END + s8.size AS BIGINT)
  FROM pk JOIN s8 ON s8.path = pk.path AND s8.owner = pk.owner AND s8.block = pk.block AND s8.seg = pk.seg AND s8.i = pk.i + 1
), pn AS (SELECT {block}, seg, any_value(item) AS item, any_value(seg_at) AS seg_at, bool_or(headed) AS headed, unnest(range(max(p) + 1)) AS p FROM pk JOIN s8 USING ({block}, seg, i) GROUP BY {block}, seg),
pr AS (SELECT *, row_number() OVER (PARTITION BY {block} ORDER BY seg_at, p) AS piece FROM pn),
sp AS (
  SELECT pr.path, pr.owner, pr.block, pr.piece, s6.pos, s6.line, s6.page, s6.blank, s6.pos AS ord FROM pr JOIN pk USING ({block}, seg, p) JOIN s6 ON s6.path = pk.path AND s6.owner = pk.owner AND s6.block = pk.block AND s6.seg = pk.seg AND s6.part = pk.part
  UNION ALL SELECT pr.path, pr.owner, pr.block, pr.piece, s3.pos, s3.line, s3.page, s3.blank, -1 FROM pr JOIN s3 USING ({block}, item) WHERE pr.headed AND s3.rn = 1
)"""


def _split_sql(mark: str, top: str, nested: str) -> str:
    return rf"""WITH RECURSIVE dl AS (
  SELECT doc_id AS path, 0 AS owner, 0 AS block, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS t, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL
), lw AS (
  SELECT path, owner, block, i + 1 AS pos, {mark} || t AS line, '1-1' AS page, false AS blank, len(regexp_extract_all({mark} || t, '\S+')) AS nw, {top} AS top, {nested} AS nested FROM dl
), {_split('lw')}, al AS (
  SELECT path, piece, line FROM sp UNION ALL SELECT path, 1, line FROM lw WHERE path NOT IN (SELECT path FROM big)
)
SELECT path AS doc_id, CAST(piece - 1 AS BIGINT) AS piece, count(*) AS n_lines, CAST(sum(len(regexp_extract_all(line, '\S+'))) AS BIGINT) AS n_words FROM al GROUP BY ALL"""


_VIOLATED = """, vio AS (
  SELECT path FROM nd WHERE under_empty OR content_type IS NULL
  UNION SELECT nd.path FROM nd JOIN bd ON bd.path = nd.path AND bd.owner = nd.pos WHERE nd.id_path = '' AND NOT bd.blank
  UNION SELECT path FROM nd WHERE id_path <> '' GROUP BY path, id_path HAVING count(*) > 1
)"""
_PREFIX = "upper(substr(source, 1, 1)) || lower(substr(source, 2)) || ' Guide, Unit ' || nd.path || ' — About ' || lang || ', revision 1.0 > ' || heading_path || ' [' || content_type || ']'"

ORACLES = {
    "line_explode": f"WITH {LINES} SELECT path, pos, CASE WHEN page_mark IS NOT NULL THEN 'page' WHEN type_mark IS NOT NULL THEN 'type' WHEN level IS NOT NULL THEN 'heading' ELSE 'body' END AS kind, length(line) AS chars FROM cl",
    "page_of_line": f"WITH {LINES}{_BODY} SELECT path, pos, page FROM bd",
    "slugify": f"SELECT page_id, {_SLUG.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '<h1>([^<]*)</h1>' + chr(39) + ', 1)')} AS slug FROM pages",
    "slug_dedupe": f"WITH {_TREE} SELECT path, pos, slug, own_slug FROM ho",
    "heading_tree": f"WITH {_TREE} SELECT path, pos, level, id_path, heading_path, content_type FROM nd",
    "chunk_blocks": f"WITH {LINES}{_BLOCKS} SELECT path, owner, pos, CAST(block AS BIGINT) AS block, kind FROM fb",
    "chunk_children": f"WITH RECURSIVE {LINES}{_CHILDREN.replace('@SPLIT@', _split('lw'))} SELECT ch.path, ch.owner, ch.ordinal, ch.kind, sha256(ch.text) AS text_sha256, coalesce(pg.pages, '') AS pages FROM ch LEFT JOIN pg USING (path, owner, ordinal)",
    "chunk_parents": f"""WITH {_TREE}{_BODY}{_VIOLATED}, tx AS (
  SELECT path, owner, trim(string_agg(line, chr(10) ORDER BY pos), chr(10)) AS text FROM bd GROUP BY ALL
), pp AS (
  SELECT path, owner, string_agg(page, ',' ORDER BY pos) AS pages FROM (SELECT *, lag(page) OVER (PARTITION BY path, owner ORDER BY pos) AS prev_page FROM bd WHERE NOT blank AND page IS NOT NULL) WHERE prev_page IS NULL OR prev_page <> page GROUP BY ALL
)
SELECT nd.id_path AS id, content_type, heading_path, coalesce(pp.pages, '') AS pages, sha256(tx.text) AS text_sha256, sha256({_PREFIX} || chr(10) || chr(10) || tx.text) AS content_hash
FROM nd JOIN tx ON tx.path = nd.path AND tx.owner = nd.pos LEFT JOIN pp ON pp.path = nd.path AND pp.owner = nd.pos
WHERE nd.id_path <> '' AND tx.text <> '' AND nd.path NOT IN (SELECT path FROM vio)""",
    "chunk_violations": f"""WITH {_TREE}{_BODY}, fault AS (SELECT DISTINCT path, CAST(path AS BIGINT) % 6 AS n FROM cl), full_ AS (SELECT DISTINCT path, owner FROM bd WHERE NOT blank), br AS (
  SELECT path, 'no frontmatter' AS rule FROM fault WHERE n = 0
  UNION ALL SELECT path, 'missing frontmatter key' FROM fault WHERE n = 1
  UNION ALL SELECT path, 'unknown content type' FROM cl JOIN fault USING (path) WHERE n = 2 AND type_mark IS NOT NULL
  UNION ALL SELECT path, 'body before the first section' FROM fault WHERE n = 3
  UNION ALL SELECT path, 'title below a section' FROM fault WHERE n = 4
  UNION ALL SELECT path, 'heading under an empty slug' FROM nd JOIN fault USING (path) WHERE n > 0 AND under_empty
  UNION ALL SELECT path, 'no content type' FROM nd JOIN fault USING (path) WHERE n > 0 AND content_type IS NULL
  UNION ALL SELECT nd.path, 'empty slug with body' FROM nd JOIN fault USING (path) JOIN full_ ON full_.path = nd.path AND full_.owner = nd.pos WHERE n > 0 AND id_path = ''
  UNION ALL SELECT path, 'repeated id' FROM (SELECT path, id_path FROM nd WHERE id_path <> '' GROUP BY ALL HAVING count(*) > 1) JOIN fault USING (path) WHERE n > 0
) SELECT path, rule, count(*) AS n FROM br GROUP BY ALL""",
    "list_split_500": _split_sql("'- '", "true", "false"),
    "list_split_nested": _split_sql("CASE WHEN i % 90 = 0 THEN '- ' WHEN i % 45 = 1 THEN '  - ' ELSE '    ' END", "i % 90 = 0", "i % 90 <> 0 AND i % 45 = 1"),
    "chunk_records": f"""WITH RECURSIVE {_TREE}{_CHILDREN.replace('@SPLIT@', _split('lw'))}{_VIOLATED}, pt AS (
  SELECT path, owner, trim(string_agg(line, chr(10) ORDER BY pos), chr(10)) AS text FROM bd GROUP BY ALL
), pp AS (
  SELECT path, owner, string_agg(page, ',' ORDER BY pos) AS pages FROM (SELECT *, lag(page) OVER (PARTITION BY path, owner ORDER BY pos) AS prev_page FROM bd WHERE NOT blank AND page IS NOT NULL) WHERE prev_page IS NULL OR prev_page <> page GROUP BY ALL
), tx AS (
  SELECT path, owner, 0 AS ordinal, text, coalesce(pages, '') AS pages FROM pt LEFT JOIN pp USING (path, owner) WHERE text <> ''
  UNION ALL SELECT path, owner, ordinal, text, coalesce(pages, '') FROM ch LEFT JOIN pg USING (path, owner, ordinal)
)
SELECT nd.id_path || CASE WHEN ordinal > 0 THEN ':c' || ordinal ELSE '' END AS id, CASE WHEN ordinal > 0 THEN 'child' ELSE 'parent' END AS kind, CASE WHEN ordinal > 0 THEN nd.id_path END AS parent_id,
  sha256({_PREFIX} || chr(10) || chr(10) || tx.text) AS content_hash, CASE WHEN ordinal > 0 THEN sha256({_PREFIX} || chr(10) || chr(10) || tx.text) END AS embedding_sha256, tx.pages
FROM nd JOIN tx ON tx.path = nd.path AND tx.owner = nd.pos WHERE nd.id_path <> '' AND nd.path NOT IN (SELECT path FROM vio)""",
}
