"""Markdown units -> parent and child chunk records, by windows over lines.

The nearest heading above a line, the ancestors of a heading, the page of a line and the block of a
line are running values over a unit's lines, so a unit is never folded row by row: all windows share one
exchange by unit. Only lists over the token limit, few rows, go through a Python fold.

Structure without a rule is never chunked silently: `violations` lists what is wrong, and strict
chunking raises the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import SPACE, content_hash, lines, rstrip, slug, word_count
from ..scratch import materialize, small_batches
from . import listsplit
from .listsplit import LIMIT

#: The content types; the first seven are retrieved by default.
PRIMARY = ("key_messages", "theory", "briefing", "exercise", "reference_patter", "common_problems", "airmanship")
SECONDARY = ("aim", "competency", "self_check", "admin")
CONTENT_TYPES = PRIMARY + SECONDARY
FRONTMATTER = ("source", "unit", "unit_name", "revision")
#: Line patterns of a unit.
PAGE_LINE = r"^<!-- page: (\S+) -->\s*$"
TYPE_LINE = r"^<!-- content_type: (\S+) -->\s*$"
HEADING_LINE = r"^(#{1,6}) (.+?)\s*$"
LIST_LINE = r"^\s*(?:-|\d+\.)\s|^[a-z]\.\s|^[a-z]\s(?=[A-Z])"
#: What the first two characters of a list line match: a pattern that fails is tried at every place of a long line.
LIST_BEGIN = r"^(?:[\s\d-]|[a-z][.\s])"
LEVELS = (2, 3, 4, 5, 6)


def _over(*keys: str, upto: bool = False):
    """A window over a unit's (or section's) lines in order; with upto, from the first line to this one."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return w.rowsBetween(Window.unboundedPreceding, 0) if upto else w


def _unit(upto: bool = False):
    return _over("path", upto=upto)


def _owner(upto: bool = False):
    return _over("path", "owner", upto=upto)


def _last(value: Column, where: Column) -> Column:
    return F.last(F.when(where, value), ignorenulls=True).over(_unit(upto=True))


def _blank(line: Column) -> Column:
    return ~line.rlike(f"[^{SPACE}]")


def frontmatter(units: DataFrame) -> DataFrame:
    """units (path, content) -> (path, opened, meta, body); meta (a map) and body are null without closed frontmatter."""
    parts = F.split("content", "---\n", 3)
    good = F.col("content").startswith("---\n") & (F.size(parts) == 3)
    strip = lambda c: F.btrim(F.btrim(c), F.lit('"'))
    pairs = F.filter(lines(F.element_at(parts, 2)), lambda x: ~_blank(x))
    entries = F.transform(pairs, lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1)), strip(F.when(F.instr(x, ":") > 0, F.substring(x, F.instr(x, ":") + 1, F.length(x))).otherwise(""))))
    # A key given twice keeps its last value.
    keys = F.transform(entries, lambda e: e["col1"])
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(keys, i + 2, F.size(keys)), lambda k: k == e["col1"]))
    opened = F.coalesce(F.col("content").startswith("---\n"), F.lit(False)).alias("opened")
    return units.select("path", opened, F.when(good, F.map_from_entries(last)).alias("meta"), F.when(good, F.element_at(parts, 3)).alias("body"))


def classified(units: DataFrame) -> DataFrame:
    """A row a line: (path, pos, line, page_mark, type_mark, level, heading, page, owner, open_2..open_6).

    Whole units are dealt by path before they are cut into lines, so what follows within units or sections moves no line.

    owner: the position of the nearest heading above (its own for a heading), null above the first section.
    """
    rows = frontmatter(units).filter("body is not null").repartition("path").select("path", F.posexplode(lines(F.col("body"))).alias("pos", "line"))
    mark = lambda p, begin, g=1: F.when(F.col("line").startswith(begin), F.nullif(F.regexp_extract("line", p, g), F.lit("")))
    rows = rows.withColumn("page_mark", mark(PAGE_LINE, "<!-- ")).withColumn("type_mark", mark(TYPE_LINE, "<!-- "))
    rows = rows.withColumn("level", F.length(mark(HEADING_LINE, "#", 1))).withColumn("heading", mark(HEADING_LINE, "#", 2))
    rows = rows.withColumn("page", F.last("page_mark", ignorenulls=True).over(_unit(upto=True)))
    for k in LEVELS:
        rows = rows.withColumn(f"last_{k}", _last(F.col("pos"), F.col("level") == k))
    for k in LEVELS:
        outer = [F.coalesce(F.col(f"last_{j}"), F.lit(-1)) for j in LEVELS if j < k]
        above = reduce(lambda a, b: F.greatest(a, b), outer) if outer else F.lit(-1)
        rows = rows.withColumn(f"open_{k}", F.when(F.col(f"last_{k}") > above, F.col(f"last_{k}")))
    return rows.withColumn("owner", F.greatest(*[F.col(f"open_{k}") for k in LEVELS])).drop(*[f"last_{k}" for k in LEVELS])


def heading_tree(rows: DataFrame) -> DataFrame:
    """classified rows -> a row a heading: (path, pos, level, heading, ancestors, parent_pos, slug, own_slug,
    own_type). ancestors: positions of the open headings around it, outermost first."""
    own_type = rows.filter("type_mark is not null and owner is not null").groupBy("path", F.col("owner").alias("pos")).agg(F.max_by("type_mark", "pos").alias("own_type"))
    heads = rows.filter("level >= 2")
    around = F.array_compact(F.array(*[F.when((F.col("level") > k), F.col(f"open_{k}")) for k in LEVELS]))
    heads = heads.select("path", "pos", "level", "heading", around.alias("ancestors"), slug(F.col("heading")).alias("slug"))
    heads = heads.withColumn("parent_pos", F.try_element_at("ancestors", F.lit(-1)))
    w = Window.partitionBy("path", "parent_pos", "slug").orderBy("pos")
    heads = heads.withColumn("nth", F.row_number().over(w))
    heads = heads.withColumn("own_slug", F.when(F.col("slug") == "", "").when(F.col("nth") > 1, F.concat_ws("-", "slug", F.col("nth").cast("string"))).otherwise(F.col("slug")))
    return heads.join(own_type, ["path", "pos"], "left").drop("nth")


def section_nodes(units: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a heading with id_path (empty for a heading without letters and digits), heading_path, content_type
    (its own, else the nearest around it) and the unit's metadata."""
    tree = heading_tree(rows)
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct("heading", "own_slug", "own_type")
    around = F.array_compact(F.array(*[F.when(F.array_contains("ancestors", F.max(F.when(F.col("level") == k, F.col("pos"))).over(w)), F.last(F.when(F.col("level") == k, own), ignorenulls=True).over(w)) for k in LEVELS]))
    each = tree.withColumn("around", around).withColumn("chain", F.concat("around", F.array(own)))
    each = each.join(frontmatter(units).select("path", *[F.try_element_at("meta", F.lit(k)).alias(k) for k in FRONTMATTER]), "path")
    path = F.concat_ws(":", "source", "unit", F.array_join(F.transform("chain", lambda c: c["own_slug"]), ":"))
    kinds = F.filter(F.transform("chain", lambda c: c["own_type"]), lambda x: x.isNotNull())
    return each.select(
        "path",
        F.col("pos").alias("owner"),
        "level",
        "heading",
        F.when(F.col("own_slug") == "", "").otherwise(path).alias("id_path"),
        F.transform("chain", lambda c: c["heading"]).alias("heading_path"),
        F.try_element_at(kinds, F.lit(-1)).alias("content_type"),
        F.exists("around", lambda c: c["own_slug"] == "").alias("under_empty"),
        *FRONTMATTER,
    )


def body_lines(rows: DataFrame) -> DataFrame:
    """The lines under headings: (path, owner, pos, line, page, blank), without a section's leading blanks."""
    body = rows.filter("page_mark is null and type_mark is null and level is null and owner is not null")
    body = body.select("path", "owner", "pos", "line", "page", _blank(F.col("line")).alias("blank"))
    return body.withColumn("began", F.max(~F.col("blank")).over(_owner(upto=True))).filter("began").drop("began")


def pages_of(body: Column) -> Column:
    """Pages of the lines (struct line, page, blank), each once where it changes; blank lines have none."""
    own = F.transform(F.filter(body, lambda x: ~x["blank"] & x["page"].isNotNull()), lambda x: x["page"])
    return F.filter(F.transform(own, lambda p, i: F.when((i == 0) | (F.try_element_at(own, i) != p), p)), lambda p: p.isNotNull())


def words_of(body: Column) -> Column:
    """Words of the lines: counted in one text, as a call a line costs several times as much."""
    return word_count(F.array_join(F.transform(body, lambda x: x["line"]), "\n"))


def _joined(body: Column) -> Column:
    return F.btrim(F.array_join(F.transform(body, lambda x: x["line"]), "\n"), F.lit("\n"))


def blocks(body: DataFrame) -> DataFrame:
    """body_lines -> the same lines with block (from 1, in each section) and kind (para or list).

    Lines run on from a list when the line before is not ended or they begin in lower case; a blank line ends
    a paragraph and stays inside a list; a dash after an ended line begins a new list if a numbered line
    came since the last such dash.
    """
    before, upto = _owner().rowsBetween(Window.unboundedPreceding, -1), _owner(upto=True)
    full = ~F.col("blank")
    last = lambda c, w: F.last(F.when(full, c), ignorenulls=True).over(w)  # noqa: E731  of the lines that aren't blank
    body = body.withColumn("blanks", F.sum(F.col("blank").cast("int")).over(upto))
    body = body.withColumn("prev", rstrip(last(F.col("line"), before))).withColumn("gap", F.col("blanks") > last(F.col("blanks"), before))
    body = body.withColumn("stopped", F.right("prev", F.lit(1)).isin(*".!?:"))
    runs_on = F.col("stopped").isNotNull() & (~F.col("stopped") | F.col("line").rlike(r"^\s*\p{Ll}"))
    body = body.withColumn("own", F.when(full, F.when(F.substring("line", 1, 2).rlike(LIST_BEGIN) & F.col("line").rlike(LIST_LINE), "list").when(~runs_on, "para"))).withColumn("kind", F.last("own", ignorenulls=True).over(upto))
    body = body.withColumn("turn", full & F.coalesce(F.col("kind") != last(F.col("kind"), before), F.lit(True)))
    body = body.withColumn("run", F.sum(F.col("turn").cast("int")).over(upto))
    inside = Window.partitionBy("path", "owner", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    dash = full & (F.col("kind") == "list") & ~F.col("turn") & F.col("line").startswith("- ") & F.coalesce(F.right("prev", F.lit(1)).isin(*".!?"), F.lit(False))
    body = body.withColumn("dash", dash).withColumn("number", full & F.substring("line", 1, 1).between("0", "9") & F.col("line").rlike(r"^\d+\.\s"))
    number, earlier = [F.coalesce(F.max(F.when(F.col(c), F.col("pos"))).over(inside), F.lit(-1)) for c in ("number", "dash")]
    fresh = F.col("turn") | (full & (F.col("kind") == "para") & F.coalesce(F.col("gap"), F.lit(False))) | (F.col("dash") & (number > earlier))
    # A blank line belongs to the list block before it.
    body = body.withColumn("block", F.sum(fresh.cast("int")).over(upto))
    return body.filter("not blank or kind = 'list'").select("path", "owner", "pos", "line", "page", "blank", "block", "kind")


_LINES = "array<struct<line:string,page:string,blank:boolean>>"


def children(lined: DataFrame, limit: int = LIMIT) -> DataFrame:
    """blocks -> (path, owner, ordinal, text, pages, kind, tokens): a paragraph, or a list with the paragraph before
    it if that ends in a colon; lists over the limit in pieces, the introduction before the first."""
    each = lined.groupBy("path", "owner", "block", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "page", "blank"))).alias("body"))
    each = each.withColumn("body", F.transform("body", lambda x: F.struct(x["line"].alias("line"), x["page"].alias("page"), x["blank"].alias("blank"))))
    w = Window.partitionBy("path", "owner").orderBy("block")
    intro = (F.col("kind") == "para") & rstrip(F.element_at("body", -1)["line"]).endswith(":")
    each = each.withColumn("intro", intro)
    each = each.withColumn("before", F.when((F.col("kind") == "list") & F.lag("intro").over(w), F.lag("body").over(w)))
    each = each.withColumn("joins", F.coalesce(F.col("intro") & (F.lead("kind").over(w) == "list"), F.lit(False))).filter("not joins")
    each = each.withColumn("tokens", words_of(F.col("body")))
    large = (F.col("kind") == "list") & (F.col("tokens") > limit)
    # One path for all, as a union would read and group the lines twice; only large lists go to Python.
    each = each.withColumn("pieces", split_pieces(F.when(large, F.col("body")), limit))
    both = each.select("path", "owner", "block", "kind", "before", F.posexplode(F.coalesce("pieces", F.array("body"))).alias("piece", "body"))
    both = both.withColumn("before", F.when(F.col("piece") == 0, F.col("before")))
    order = Window.partitionBy("path", "owner").orderBy("block", "piece")
    text = F.when(F.col("before").isNull(), _joined(F.col("body"))).otherwise(F.btrim(F.concat(F.array_join(F.transform("before", lambda x: x["line"]), "\n"), F.lit("\n\n"), F.array_join(F.transform("body", lambda x: x["line"]), "\n")), F.lit("\n")))
    spanned = F.concat(F.coalesce("before", F.array().cast(_LINES)), "body")
    return both.withColumn("ordinal", F.row_number().over(order)).select("path", "owner", "ordinal", "kind", text.alias("text"), pages_of(spanned).alias("pages"))


def split_pieces(body: Column | str, limit: int = LIMIT) -> Column:
    """The pieces of a list (array of line, page, blank). A null list stays null."""
    body = F.col(body) if isinstance(body, str) else body
    places = split_places(F.transform(body, lambda x: x["line"]), limit)
    return F.transform(places, lambda p: F.transform(p["at"], lambda i: F.get(body, i)))


def split_places(lines: Column | str, limit: int = LIMIT) -> Column:
    """The pieces of a list by its lines (array of texts): array of (words, at), the places of a piece's lines from 0. Only lines
    go to Python and only places come back. Batches are kept small: a task's lines become Python objects, many times their size."""
    small_batches(SparkSession.active())
    return _places_udf(limit)(lines)


_PLACES = T.ArrayType(T.StructType([T.StructField("words", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType()))]))


def _places_udf(limit: int):
    @F.arrow_udf(_PLACES)
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = to_arrow_type(_PLACES)
        for b in batches:
            yield pa.array([None if lines is None else [{"words": n, "at": at} for n, at in listsplit.split_places(lines, limit)] for lines in b.to_pylist()], kind)

    return places


def context_prefix() -> Column:
    """The text before a chunk's own, from source, unit, unit_name, revision, heading_path, content_type."""
    name = F.concat(F.upper(F.substring("source", 1, 1)), F.lower(F.expr("substring(source, 2)")))
    return F.concat(name, F.lit(" Guide, Unit "), "unit", F.lit(" — "), "unit_name", F.lit(", revision "), "revision", F.lit(" > "), F.array_join("heading_path", " > "), F.lit(" ["), "content_type", F.lit("]"))


def parents(body: DataFrame) -> DataFrame:
    """body_lines -> (path, owner, text, pages): each section's text, if it has any."""
    whole = body.groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "page", "blank"))).alias("body"))
    return whole.select("path", "owner", _joined(F.col("body")).alias("text"), pages_of(F.col("body")).alias("pages")).filter("text <> ''")


def chunk_units(units: DataFrame, limit: int = LIMIT, strict: bool = True, kinds: tuple[str, ...] = ("parent", "child")) -> DataFrame:
    """units (path, content) -> chunk records with path, owner and ordinal (0: the parent), by which they are in
    document order. strict raises the first violation; else units with violations give no record. Only what
    kinds name is made.

    Sections without text and headings without letters or digits give no record. An empty table gives none.
    """
    units = materialize(units.select("path", "content"), "chunk-units")
    rows = materialize(classified(units), "chunk-lines")
    nodes = materialize(section_nodes(units, rows), "chunk-sections")
    bad = violations(units, rows, nodes)
    if strict:
        first = bad.orderBy("path", "pos", "rule").first()
        if first is not None:
            raise ValueError(f"{first.path}: {first.rule}: {first.detail}")
    else:
        nodes = nodes.join(materialize(bad.select("path").distinct(), "chunk-faulty"), "path", "left_anti")
    nodes = nodes.withColumn("prefix", context_prefix()).filter("id_path <> ''")
    body = body_lines(rows.repartition("path"))
    parts = []
    if "parent" in kinds:
        parts.append(parents(body).select("path", "owner", F.lit(0).alias("ordinal"), "text", "pages"))
    if "child" in kinds:
        parts.append(children(blocks(body), limit).select("path", "owner", "ordinal", "text", "pages"))
    both = reduce(lambda a, b: a.unionByName(b), parts).join(nodes, ["path", "owner"])
    child = F.col("ordinal") > 0
    return both.select(
        "path", "owner", "ordinal",
        F.when(child, F.concat("id_path", F.lit(":c"), F.col("ordinal").cast("string"))).otherwise(F.col("id_path")).alias("id"),
        F.when(child, "child").otherwise("parent").alias("kind"),
        *FRONTMATTER, "content_type", "heading_path", "pages", "text",
        content_hash(F.col("prefix"), F.col("text")).alias("content_hash"),
        F.when(child, F.concat("prefix", F.lit("\n\n"), "text")).alias("embedding_text"),
        F.when(child, F.col("id_path")).alias("parent_id"),
    )


def _breaches(rows: DataFrame, pos: Column, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """The rules (name, where, detail) that each row breaks, in one pass."""
    found = F.array_compact(F.array(*[F.when(where, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, where, detail in rules]))
    return rows.select("path", pos.alias("pos"), F.explode(found).alias("b")).select("path", "pos", "b.rule", "b.detail")


def violations(units: DataFrame, rows: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """All breaches of a unit's structure: (path, pos, rule, detail)."""
    front = frontmatter(units)
    nothing, has = F.lit(""), F.col("meta").isNotNull()
    lacking = [("missing frontmatter key", has & F.try_element_at("meta", F.lit(k)).isNull(), F.lit(k)) for k in FRONTMATTER]
    out = [_breaches(front, F.lit(-1), [("no frontmatter", ~F.col("opened"), nothing), ("unterminated frontmatter", F.col("opened") & ~has, nothing), *lacking])]
    rows = classified(units) if rows is None else rows
    nodes = section_nodes(units, rows) if nodes is None else nodes
    earlier = _unit().rowsBetween(Window.unboundedPreceding, -1)
    typed, body = F.col("type_mark").isNotNull(), (F.col("page_mark").isNull() & F.col("type_mark").isNull() & F.col("level").isNull()) & ~_blank(F.col("line"))
    lined = rows.withColumn("body_before", F.max(F.when(body, F.col("pos"))).over(earlier)).withColumn("open", F.max("owner").over(earlier))
    outside = F.coalesce(*[F.when(F.col("level") > k, F.col(f"open_{k}")) for k in LEVELS]).isNull()
    out.append(
        _breaches(
            lined,
            F.col("pos"),
            [
                ("unknown content type", typed & ~F.col("type_mark").isin(*CONTENT_TYPES), F.col("type_mark")),
                ("content type outside a section", typed & F.col("owner").isNull(), F.col("type_mark")),
                ("content type after body", typed & (F.col("body_before") > F.col("owner")), F.col("type_mark")),
                ("title below a section", (F.col("level") == 1) & F.col("open").isNotNull(), F.col("heading")),
                ("sub-heading without section", (F.col("level") > 2) & outside, F.col("heading")),
                ("body before the first section", body & F.col("owner").isNull(), F.btrim("line")),
            ],
        )
    )
    texts = body_lines(rows).filter("not blank").select("path", "owner").distinct().withColumn("full", F.lit(True))
    again = Window.partitionBy("path", "id_path")
    held = nodes.join(texts, ["path", "owner"], "left").withColumn("n", F.count("*").over(again)).withColumn("last", F.max("owner").over(again))
    out.append(
        _breaches(
            held,
            F.col("owner"),
            [
                ("heading under an empty slug", F.col("under_empty"), F.col("heading")),
                ("no content type", F.col("content_type").isNull(), F.col("heading")),
                ("empty slug with body", (F.col("id_path") == "") & F.col("full"), F.col("heading")),
                ("repeated id", (F.col("id_path") != "") & (F.col("n") > 1) & (F.col("owner") == F.col("last")), F.col("id_path")),
            ],
        )
    )
    return reduce(lambda a, b: a.unionByName(b), out)
