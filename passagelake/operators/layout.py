"""Page layout lines -> Markdown units, in native expressions and windows.

Lines: (source, page_idx, block_no, line_no, text, size, bold, font, x0, y0, x1, y1), in reading order of the
extractor. A block's elements are runs of its lines, found with lags and running sums; the only fold is
over the lines of one section heading, within an expression. What cannot be rendered faithfully is an error
in a column, not an exception, so one bad unit doesn't stop a corpus.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import header_key, unit_number, unit_variant
from ..scratch import materialize
from . import vocabulary as V

LINE_KEYS = ["source", "page_idx", "block_no", "line_no"]
BLOCK = ["source", "page_idx", "block_no"]
#: Kinds that follow a list or mark without a blank line.
TIGHT = ("bullet", "subbullet", "ordered", "marker")


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*d.items())])


def role(source: Column, text: Column) -> Column:
    """The content type of a section header, null if it is none."""
    out = F.lit(None).cast("string")
    for name, headers in V.HEADERS.items():
        out = F.when(source == name, F.try_element_at(_lit_map(headers), header_key(text))).otherwise(out)
    return out


def _listed(source: Column, text: Column, lists: dict) -> Column:
    out = F.lit(False)
    for name, entries in lists.items():
        out = F.when(source == name, header_key(text).isin(entries)).otherwise(out)
    return out


def marker_kind(text: Column, font: Column) -> Column:
    bullet = (font == "SymbolMT") | text.rlike(r"^[•●](?: |$)")
    return F.when(bullet, "bullet").when((font == "CourierNewPSMT") | (text == "o"), "subbullet").when(text.rlike(r"^\d{1,2}\.$"), "ordered")


def marker_body(text: Column) -> Column:
    """A list line without its glyph."""
    return F.regexp_replace(text, r"^(?:•(?: |$))?(?:●(?: |$))?(?:o(?: |$))?", "")


def is_section(source: Column, text: Column, size: Column, bold: Column) -> Column:
    return F.when(size >= V.SECTION_SIZE, bold | role(source, text).isNotNull()).otherwise(bold & _listed(source, text, V.SMALL_SECTIONS))


def is_subheading(source: Column, text: Column, size: Column, bold: Column) -> Column:
    return (size < V.SECTION_SIZE) & (bold | _listed(source, text, V.PLAIN_SUBHEADINGS))


def is_patter(text: Column, bold: Column) -> Column:
    return bold & (F.rtrim(F.regexp_replace(header_key(text), ":+$", "")) == V.PATTER)


def is_chrome(source: Column, text: Column, size: Column, bold: Column, font: Column, y0: Column, first_page: Column) -> Column:
    """Running banners and unit titles; and large plain lines that are no section where such chrome is printed."""
    title = header_key(text).isin(V.BANNERS) | text.rlike(V.UNIT_TITLE)
    large = ~bold & (size >= V.SECTION_SIZE) & role(source, text).isNull() & (first_page | (y0 < V.HEADER_BAND))
    return marker_kind(text, font).isNull() & (title | large)


def marked(lines: DataFrame) -> DataFrame:
    """Lines with kind, body, section, subheading, patter and role columns. first_page is taken as false if absent."""
    s, t, z, b = F.col("source"), F.col("text"), F.col("size"), F.col("bold")
    if "first_page" not in lines.columns:
        lines = lines.withColumn("first_page", F.lit(False))
    return lines.withColumns(
        {
            "marker": marker_kind(t, F.col("font")),
            "role": role(s, t),
            "section": is_section(s, t, z, b),
            "subheading": is_subheading(s, t, z, b),
            "patter": is_patter(t, b),
            "chrome": is_chrome(s, t, z, b, F.col("font"), F.col("y0"), F.col("first_page")),
        }
    )


def footers(lines: DataFrame) -> DataFrame:
    """(source, page_idx, unit, variant, page) of the pages whose footer can be read. A listed wrong footer is
    corrected only where the page's running header says the same."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "line_no", "text"))), lambda x: x["text"]), "\n")
    pages = lines.groupBy("source", "page_idx").agg(text.alias("t"))
    number = lambda p, g: F.regexp_extract("t", p, g)
    pages = pages.withColumn("unit", number(V.FOOTER, 1).try_cast("int")).withColumn("variant", number(V.FOOTER, 2)).withColumn("page", number(V.FOOTER, 3).try_cast("int")).filter("unit is not null")
    actual = F.col("unit")
    for source, printed, real in V.FOOTER_CORRECTIONS:
        actual = F.when((F.col("source") == source) & (F.col("unit") == printed) & (F.col("variant") == "") & (number(V.HEADER_UNIT, 1).try_cast("int") == real), F.lit(real)).otherwise(actual)
    return pages.select("source", "page_idx", actual.alias("unit"), "variant", "page")


def variants(found: DataFrame) -> DataFrame:
    """(source, unit, letters): the sorted variant letters of each unit."""
    return found.groupBy("source", "unit").agg(F.array_sort(F.collect_set(F.when(F.col("variant") != "", F.col("variant")))).alias("letters"))


def page_runs(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (source, unit_id) -> (source, unit_id, pages: array<struct<page_idx, label, page>>, error).

    The unreadable first page is taken as the one before a run that begins with page 2. A run must count 1 to n.
    """
    w = wanted.select("source", "unit_id", unit_number(F.col("unit_id")).try_cast("int").alias("unit"), unit_variant(F.col("unit_id")).alias("variant"))
    own = found.groupBy("source", "unit", "variant").agg(F.array_sort(F.collect_list(F.struct("page_idx", "page"))).alias("p"))
    j = w.join(own, ["source", "unit", "variant"], "left").join(variants(found), ["source", "unit"], "left")
    first = F.element_at("p", 1)
    inferred = F.array(F.struct((first["page_idx"] - 1).alias("page_idx"), F.lit(1).alias("page")))
    j = j.withColumn("p", F.when(F.col("p").isNotNull() & (first["page"] == 2), F.concat(inferred, "p")).otherwise(F.col("p")))
    nums = F.transform("p", lambda x: x["page"])
    letters = F.coalesce(F.size("letters"), F.lit(0))
    error = (
        F.when(F.col("unit").isNull(), F.concat(F.lit("not a unit: "), "unit_id"))
        .when(F.col("p").isNull() & (F.col("variant") != ""), F.concat(F.lit("no pages of variant "), "unit_id", F.lit(" in "), "source"))
        .when(F.col("p").isNull() & (letters > 0), F.concat(F.lit("unit "), "unit_id", F.lit(" of "), "source", F.lit(" is split into variants "), F.array_join("letters", ", ")))
        .when(F.col("p").isNull(), F.concat(F.lit("no pages of unit "), "unit_id", F.lit(" in "), "source"))
        .when(nums != F.sequence(F.lit(1), F.size(nums)), F.concat(F.lit("pages of unit "), "unit_id", F.lit(" of "), "source", F.lit(" are not consecutive: "), F.array_join(nums.cast("array<string>"), ", ")))
    )
    pages = F.transform("p", lambda x: F.struct(x["page_idx"].alias("page_idx"), F.concat("unit_id", F.lit("-"), x["page"].cast("string")).alias("label"), x["page"].alias("page")))
    return j.select("source", "unit_id", pages.alias("pages"), error.alias("error"))


def unit_lines(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """Lines of the units' pages, with unit_id, page, label and first_page."""
    each = runs.filter("error is null").select("source", "unit_id", F.explode("pages").alias("p")).select("source", "unit_id", "p.page_idx", "p.label", "p.page")
    return lines.join(each, ["source", "page_idx"]).withColumn("first_page", F.col("page") == 1)


def metadata(own: DataFrame) -> DataFrame:
    """unit_lines -> (source, unit_id, unit_name, revision): the first plain title line, else the banner; the first revision."""
    at = F.struct("page", "block_no", "line_no")
    pattern = F.concat(F.lit(r"^Unit\s+"), unit_number(F.col("unit_id")), F.lit(r"(?!\d)\s*"), unit_variant(F.col("unit_id")), F.lit(r"\s*[-–]?\s*(.+)$"))
    name = F.call_function("regexp_extract", F.col("text"), pattern, F.lit(1))
    revision = F.regexp_extract("text", V.REVISION, 1)
    got = own.groupBy("source", "unit_id").agg(F.min_by(F.when(~F.col("bold"), F.nullif(F.trim(name), F.lit(""))), F.when(~F.col("bold") & (name != ""), at)).alias("unit_name"), F.min_by(F.nullif(revision, F.lit("")), F.when(revision != "", at)).alias("revision"))
    return got.join(banners(own), ["source", "unit_id"], "left").select("source", "unit_id", F.coalesce("unit_name", "banner", F.lit("")).alias("unit_name"), F.coalesce("revision", F.lit("")).alias("revision"))


def banners(own: DataFrame) -> DataFrame:
    """(source, unit_id, banner): the large plain line on most pages, at least two; the earlier of equals."""
    t = F.trim("text")
    big = own.filter(~F.col("bold") & (F.col("size") >= V.SECTION_SIZE) & ~header_key(t).isin(V.BANNERS) & ~t.rlike(V.UNIT_TITLE) & role(F.col("source"), t).isNull())
    counts = big.groupBy("source", "unit_id", t.alias("banner")).agg(F.countDistinct("page").alias("n"), F.min(F.struct("page", "block_no", "line_no")).alias("at")).filter("n >= 2")
    return counts.groupBy("source", "unit_id").agg(F.min_by("banner", F.struct(-F.col("n"), "at")).alias("banner"))


def content_blocks(lines: DataFrame) -> DataFrame:
    """marked lines without footer blocks, figure labels and chrome. unit_id (if there is one) scopes the labels."""
    w = Window.partitionBy(*BLOCK)
    foot = F.every(F.col("size") <= V.FOOTER_SIZE).over(w) | F.every(F.col("text").rlike(V.FOOTER_LINE)).over(w)
    lines = lines.withColumn("_foot", foot).filter("not _foot").drop("_foot")
    if "unit_id" in lines.columns:
        whole = lines.groupBy("unit_id", *BLOCK).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("whole"))
        named = F.lit(False)
        for (source, unit), labels in V.FIGURE_LABELS.items():
            named = named | ((F.col("source") == source) & (F.col("unit_id") == unit) & F.col("whole").isin(labels))
        lines = lines.join(whole.filter(named).select("unit_id", *BLOCK), ["unit_id", *BLOCK], "left_anti")
    return lines.filter(~F.col("chrome"))


def _joined(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def block_elements(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """content_blocks -> elements (keys..., seq, kind, text, error) of each block, in order.

    A marker opens an item, plain lines after it are its body; headings that follow each other join (sections only
    while what is joined is no known header); a bare number before a sub-heading belongs to it; patter stands alone;
    other lines make paragraphs.
    """
    keys = keys or BLOCK
    w = Window.partitionBy(*keys).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(F.col("marker").isNotNull(), "marker").when(F.col("patter"), "patter").when(F.col("section"), "section").when(F.col("subheading"), "sub").otherwise("plain")
    rows = lines.withColumn("what", kind)
    before = F.lag("what").over(w)
    last = F.last(F.when(F.col("what") != "plain", F.col("what")), ignorenulls=True).over(upto)
    numbered = (before == "marker") & (F.lag("marker").over(w) == "ordered")
    same = (
        ((F.col("what") == "plain") & ((before == "plain") | (last == "marker")))
        | ((F.col("what") == "section") & (before == "section"))
        | ((F.col("what") == "sub") & ((before == "sub") | numbered))
    )
    rows = rows.withColumn("run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(upto))
    text = F.when(F.col("what") == "marker", F.when(F.col("marker") == "ordered", F.col("text")).otherwise(marker_body(F.col("text")))).otherwise(F.col("text"))
    runs = rows.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.struct("line_no", "what", "marker", text.alias("t")))).alias("l"))
    parts = F.transform("l", lambda x: x["t"])
    first, has = F.element_at("l", 1), lambda k: F.exists("l", lambda x: x["what"] == k)
    source = F.col("source")
    # The lines of a section run, joined while what is joined is no known header.
    extend = lambda acc, t: F.when((F.size(acc) > 0) & role(source, F.element_at(acc, -1)).isNull(), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), t)))).otherwise(F.concat(acc, F.array(t)))
    heads = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, t: F.when(F.size(acc) == 0, F.array(t)).otherwise(extend(acc, t)))
    texts = F.when(first["what"] == "section", heads).when(has("sub"), F.array(F.array_join(parts, " "))).when(first["what"] == "patter", F.array(F.lit(""))).otherwise(F.array(_joined(parts)))
    kinds = F.when(first["what"] == "section", "section").when(has("sub"), "subheading").when(first["what"] == "patter", "patter").when(first["what"] == "marker", first["marker"]).otherwise("paragraph")
    each = runs.select(*keys, "run", kinds.alias("kind"), F.posexplode(texts).alias("part", "t"))
    kind_of = role(source, F.col("t"))
    shown = (
        F.when(F.col("kind") == "section", F.concat(F.lit("## "), "t", F.lit("\n<!-- content_type: "), F.coalesce(kind_of, F.lit("unknown")), F.lit(" -->")))
        .when(F.col("kind") == "subheading", F.concat(F.lit("### "), "t"))
        .when(F.col("kind") == "patter", F.lit("#### Suggested Patter\n<!-- content_type: reference_patter -->"))
        .otherwise(F.col("t"))
    )
    wrong = F.when((F.col("kind") == "section") & kind_of.isNull(), F.concat(F.lit("unmapped section heading: "), "t"))
    return each.select(*keys, F.struct("run", "part").alias("seq"), "kind", shown.alias("text"), wrong.alias("error"))


def list_items(lines: DataFrame, keys: list[str], order: str = "line_no") -> DataFrame:
    """Lines -> one element a list marker (keys..., item, kind, text); lines before the first marker are a paragraph."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = lines.withColumn("item", F.sum(F.col("marker").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.when(F.col("marker").isNotNull(), marker_body(F.col("text"))).otherwise(F.col("text"))
    whole = rows.groupBy(*keys, "item").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "marker", text.alias("t")))).alias("l"))
    return whole.select(*keys, "item", F.coalesce(F.element_at("l", 1)["marker"], F.lit("paragraph")).alias("kind"), _joined(F.transform("l", lambda x: x["t"])).alias("text"))


def block_boxes(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return lines.groupBy(*(keys or BLOCK)).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _level(extent: Column) -> Column:
    """The power of two that is no smaller than an extent: cells of that size lie under it in two places at most."""
    return F.greatest(F.lit(4), F.ceil(F.log2(F.greatest(extent, F.lit(1e-9))))).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def _cells(low: Column, high: Column, level: Column) -> Column:
    return F.explode(F.array_distinct(F.array(_cell(low, level), _cell(high, level))))


def outermost(boxes: DataFrame, page: list[str], tolerance: float = 1.0) -> DataFrame:
    """boxes (page..., box_no, x0, y0, x1, y1) that no other, unequal box of the page holds, within a tolerance. Two
    unequal boxes within it of each other remove each other.

    A box that holds another holds its middle, within the tolerance. So boxes are laid on grids, each on that of its own width and height, where
    it covers four cells at most, and a middle is looked up in its one cell of each grid that its page has.
    """
    t, size = F.lit(tolerance), ("x0", "y0", "x1", "y1")
    outer = boxes.select(*page, *[F.col(c).alias(f"_{c}") for c in size])
    outer = outer.withColumn("_lx", _level(F.col("_x1") - F.col("_x0") + 2 * t)).withColumn("_ly", _level(F.col("_y1") - F.col("_y0") + 2 * t)).filter("_lx is not null and _ly is not null")
    grids = outer.select(*page, "_lx", "_ly").distinct()
    outer = outer.withColumn("_ix", _cells(F.col("_x0") - t, F.col("_x1") + t, F.col("_lx"))).withColumn("_iy", _cells(F.col("_y0") - t, F.col("_y1") + t, F.col("_ly")))
    inner = boxes.select(*page, "box_no", *size).join(grids, page)
    inner = inner.withColumn("_ix", _cell((F.col("x0") + F.col("x1")) / 2, F.col("_lx"))).withColumn("_iy", _cell((F.col("y0") + F.col("y1")) / 2, F.col("_ly")))
    keys = [*page, "_lx", "_ly", "_ix", "_iy"]
    a, b = inner.alias("a"), outer.alias("b")
    on = F.lit(True)
    for c in keys:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    equal = F.lit(True)
    for c in size:
        equal = equal & (F.col(f"a.{c}") == F.col(f"b._{c}"))
    holds = (F.col("b._x0") <= F.col("a.x0") + t) & (F.col("b._y0") <= F.col("a.y0") + t) & (F.col("b._x1") >= F.col("a.x1") - t) & (F.col("b._y1") >= F.col("a.y1") - t)
    held = a.join(b, on & ~equal & holds, "left_semi").select(*page, "box_no").distinct()
    return boxes.join(held, [*page, "box_no"], "left_anti")


def in_band(blocks: DataFrame, bands: DataFrame, page: list[str], tolerance: float = 1.0) -> DataFrame:
    """Blocks (page..., block_no, y0, y1) whose middle lies in a band (page..., box_no, top, bottom).

    Bands are laid on grids by their height, where each covers two cells at most; a middle has one cell in each grid of its page.
    """
    t = F.lit(tolerance)
    laid = bands.withColumn("_level", _level(F.col("bottom") - F.col("top") + 2 * t)).filter("_level is not null")
    grids = laid.select(*page, "_level").distinct()
    laid = laid.withColumn("_cell", _cells(F.col("top") - t, F.col("bottom") + t, F.col("_level")))
    placed = blocks.withColumn("_middle", (F.col("y0") + F.col("y1")) / 2).join(grids, page).withColumn("_cell", _cell(F.col("_middle"), F.col("_level")))
    inside = (F.col("_middle") >= F.col("top") - t) & (F.col("_middle") <= F.col("bottom") + t)
    return placed.join(laid, [*page, "_level", "_cell"]).filter(inside).drop("_middle", "_level", "_cell")


def table_regions(lines: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """marked lines and ruled boxes (source, page_idx, box_no, x0, y0, x1, y1) -> (regions, elements).

    regions (source, page_idx, box_no, x0, top, bottom): boxes with two columns, cut at their greatest gap of
    line starts (the right-most of equals). elements (source, page_idx, box_no, seq, kind, text): left cells as
    sub-headings, right cells as their items. Small section headings are no part of a table; left blocks
    that abut are one label.
    """
    page = ["source", "page_idx"]
    region = [*page, "box_no"]
    bands = outermost(boxes, page).select(*region, F.col("x0").alias("left"), F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    small = F.every((F.col("size") < V.SECTION_SIZE) & F.col("section")).over(Window.partitionBy(*BLOCK))
    kept = lines.withColumn("_small", small).filter("not _small").drop("_small")
    block = block_boxes(kept).withColumnsRenamed({"x0": "bx0", "y0": "by0", "x1": "bx1", "y1": "by1"})
    inside = in_band(block.withColumnsRenamed({"by0": "y0", "by1": "y1"}), bands, page).select(*region, "block_no", "left", "bottom", F.col("y0").alias("by0"), F.col("y1").alias("by1"))
    inside = materialize(inside, "layout-inside")
    rows = materialize(kept.join(inside, [*page, "block_no"]), "layout-table-lines")
    starts = rows.select(*region, F.bround("x0", 0).alias("x")).distinct()
    w = Window.partitionBy(*region).orderBy("x")
    gaps = starts.withColumn("next", F.lead("x").over(w)).filter("next is not null").withColumn("gap", F.col("next") - F.col("x"))
    split = gaps.groupBy(*region).agg(F.max(F.struct("gap", "x", "next")).alias("g")).filter(F.col("g.gap") >= V.COLUMN_GAP).select(*region, ((F.col("g.x") + F.col("g.next")) / 2).alias("split"))
    top = inside.groupBy(*region).agg(F.min("by0").alias("top"), F.first("left").alias("x0"), F.first("bottom").alias("bottom"))
    whole = rows.groupBy(*region, "block_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "marker", "text"))).alias("l"))
    first = F.element_at("l", 1)
    joined = _joined(F.transform("l", lambda x, i: F.when((i == 0) & first["marker"].isNotNull(), marker_body(x["text"])).otherwise(x["text"])))
    head = whole.withColumn("t", joined).filter(header_key(F.col("t")).isin(V.TABLE_HEADERS)).select(*region, "block_no")
    rows = rows.join(head, [*region, "block_no"], "left_anti").join(split, region)
    # Runs of a block's lines on one side of the split are cells; a left cell ends at its first bullet.
    rows = rows.withColumn("is_left", F.col("x0") < F.col("split"))
    lw = Window.partitionBy(*region, "block_no").orderBy("line_no")
    turn = F.coalesce(F.lag("is_left").over(lw) != F.col("is_left"), F.lit(True))
    rows = rows.withColumn("turn", turn).withColumn("cell", F.sum(F.col("turn").cast("int")).over(lw.rowsBetween(Window.unboundedPreceding, 0)))
    cw = Window.partitionBy(*region, "block_no", "cell").orderBy("line_no")
    glyph = F.col("marker").isin("bullet", "subbullet") & (F.row_number().over(cw) > 1)
    rows = rows.withColumn("glyph", F.coalesce(glyph, F.lit(False)))
    rows = rows.withColumn("glued", F.col("is_left") & F.coalesce(F.max("glyph").over(cw.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    rows = materialize(rows, "layout-cell-lines")  # labels, items and regions are all read off these
    cell_keys = [*region, "block_no", "cell"]
    cells = rows.groupBy(*cell_keys, "is_left").agg(F.min("y0").alias("cy0"), F.max("y1").alias("cy1"), F.max("glued").alias("bulleted"), F.array_sort(F.collect_list(F.when(~F.col("glued"), F.struct("line_no", "marker", "text")))).alias("l"))
    rw = Window.partitionBy(*region).orderBy("block_no", "cell")
    fresh = F.col("is_left") & ~F.coalesce(F.lag("is_left").over(rw) & ~F.lag("bulleted").over(rw) & (F.col("cy0") - F.lag("cy1").over(rw) <= V.WRAP_GAP), F.lit(False))
    cells = cells.withColumn("label", F.when(F.col("is_left"), F.sum(fresh.cast("int")).over(rw.rowsBetween(Window.unboundedPreceding, 0))))
    labelled = cells.filter("is_left").withColumn("t", joined).groupBy(*region, "label").agg(F.array_sort(F.collect_list(F.struct("block_no", "cell", "t"))).alias("l"))
    at = lambda block, cell, item: F.struct(block.alias("block_no"), cell.alias("cell"), item.alias("item"))
    labels = labelled.select(*region, at(F.element_at("l", -1)["block_no"], F.element_at("l", -1)["cell"], F.lit(-1).cast("bigint")).alias("seq"), F.lit("subheading").alias("kind"), F.concat(F.lit("### "), F.array_join(F.transform("l", lambda x: x["t"]), " ")).alias("text"))
    items = list_items(rows.filter(~F.col("is_left") | F.col("glued")), cell_keys)
    items = items.select(*region, at(F.col("block_no"), F.col("cell"), F.col("item").cast("bigint")).alias("seq"), "kind", "text")
    elements = labels.unionByName(items)
    regions = top.join(rows.select(*region).distinct(), region, "left_semi")  # each line lies in a label or an item
    return regions.select(*region, "x0", "top", "bottom"), elements


def reading_order(lines: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Blocks (source, page_idx, block_no) with the table they lie in (box_no, or null) and their place: from the
    top, then from the left, in whole points (half to even), then in the extractor's order. A table is one
    unit at its top."""
    boxes = block_boxes(lines)
    page = ["source", "page_idx"]
    if regions is None:
        placed = boxes.withColumn("box_no", F.lit(None).cast("long")).withColumn("top", F.lit(None).cast("double")).withColumn("left", F.lit(None).cast("double"))
    else:
        bands = regions.select(*page, "box_no", "top", "bottom", F.col("x0").alias("left"))
        hit = in_band(boxes, bands, page).groupBy(*BLOCK).agg(F.min(F.struct("box_no", "top", "left")).alias("r"))
        placed = boxes.join(hit, BLOCK, "left").withColumn("box_no", F.col("r.box_no")).withColumn("top", F.col("r.top")).withColumn("left", F.col("r.left")).drop("r")
    y, x = F.bround(F.coalesce("top", "y0"), 0), F.bround(F.coalesce("left", "x0"), 0)
    anchor = F.when(F.col("box_no").isNull(), F.col("block_no")).otherwise(F.min("block_no").over(Window.partitionBy(*page, "box_no")))
    placed = placed.withColumn("y", y).withColumn("x", x).withColumn("anchor", anchor)
    w = Window.partitionBy(*page).orderBy("y", "x", "anchor")
    return placed.withColumn("place", F.dense_rank().over(w).cast("long")).select(*BLOCK, "box_no", "y", "x", "place")


def assemble(elements: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Elements (keys..., kind, text and order columns) -> (keys..., markdown). A blank line stands before all but list
    items and page marks that follow such."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag("kind").over(w)
    gap = F.when(before.isNull(), "").when(F.col("kind").isin(*TIGHT) & before.isin(*TIGHT), "\n").otherwise("\n\n")
    shown = F.when(F.col("kind") == "marker", F.concat(F.lit("<!-- page: "), "text", F.lit(" -->"))).when(F.col("kind") == "bullet", F.concat(F.lit("- "), "text")).when(F.col("kind") == "subbullet", F.concat(F.lit("  - "), "text")).otherwise(F.col("text"))
    rows = elements.withColumn("_s", F.concat(gap, shown)).withColumn("_n", F.row_number().over(w))
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "_s"))).alias("l"))
    return whole.select(*keys, F.concat(F.array_join(F.transform("l", lambda x: x["_s"]), ""), F.lit("\n")).alias("markdown"))


def frontmatter() -> Column:
    return F.concat(F.lit("---\nsource: "), "source", F.lit("\nunit: "), "unit_id", F.lit("\nunit_name: "), "unit_name", F.lit('\nrevision: "'), "revision", F.lit('"\n---\n'))


def render_units(lines: DataFrame, boxes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (source, unit_id) -> (source, unit_id, content, error): one of the two is null.

    A unit with an unresolved page run or an unmapped section heading has an error; the others are rendered.
    """
    runs = materialize(page_runs(footers(lines), wanted), "layout-runs")
    own = materialize(marked(unit_lines(lines, runs)), "layout-lines")
    meta = materialize(metadata(own), "layout-units")
    regions, cells = table_regions(own, boxes)
    cells = materialize(cells, "layout-cells")
    place = materialize(reading_order(own, materialize(regions, "layout-tables")), "layout-order")
    unit = own.select("source", "unit_id", "page_idx", "page").distinct()
    outside = content_blocks(own.join(place.filter("box_no is not null").select(*BLOCK), BLOCK, "left_anti"))
    found = block_elements(outside, ["unit_id", *BLOCK]).join(place.select(*BLOCK, "place"), BLOCK).join(unit.select("unit_id", "source", "page_idx", "page"), ["unit_id", "source", "page_idx"])
    first = F.lit(0).cast("long")
    plain = found.select("source", "unit_id", "page", F.col("place"), F.struct(F.col("seq.run").cast("long").alias("a"), F.col("seq.part").cast("long").alias("b"), first.alias("c")).alias("seq"), "kind", "text", "error")
    anchored = place.filter("box_no is not null").select("source", "page_idx", "box_no", "place").distinct()
    inner = cells.join(anchored, ["source", "page_idx", "box_no"]).join(unit, ["source", "page_idx"])
    tables = inner.select("source", "unit_id", "page", "place", F.struct(F.col("seq.block_no").cast("long").alias("a"), F.col("seq.cell").cast("long").alias("b"), F.col("seq.item").cast("long").alias("c")).alias("seq"), "kind", "text", F.lit(None).cast("string").alias("error"))
    zero = F.struct(first.alias("a"), first.alias("b"), first.alias("c"))
    marks = runs.filter("error is null").select("source", "unit_id", F.explode("pages").alias("p")).select("source", "unit_id", "p.page", F.lit(-1).cast("long").alias("place"), zero.alias("seq"), F.lit("marker").alias("kind"), F.col("p.label").alias("text"), F.lit(None).cast("string").alias("error"))
    title = meta.select("source", "unit_id", F.lit(0).alias("page"), F.lit(-2).cast("long").alias("place"), zero.alias("seq"), F.lit("h1").alias("kind"), F.concat(F.lit("# Unit "), "unit_id", F.lit(" — "), "unit_name").alias("text"), F.lit(None).cast("string").alias("error"))
    every = title.unionByName(marks).unionByName(plain).unionByName(tables)
    every = materialize(every, "layout-elements")
    bad = every.filter("error is not null").groupBy("source", "unit_id").agg(F.min("error").alias("unmapped"))
    body = assemble(every, ["source", "unit_id"], ["page", "place", "seq"])
    done = meta.join(body, ["source", "unit_id"]).join(bad, ["source", "unit_id"], "left")
    content = done.select("source", "unit_id", F.concat(frontmatter(), F.lit("\n"), "markdown").alias("content"), "unmapped")
    out = runs.select("source", "unit_id", "error").join(content, ["source", "unit_id"], "left")
    wrong = F.coalesce("error", "unmapped", F.when(F.col("content").isNull(), F.concat(F.lit("no lines of unit "), "unit_id")))
    return out.select("source", "unit_id", F.when(wrong.isNull(), F.col("content")).alias("content"), wrong.alias("error"))


def expand_variants(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (source, unit: int) -> (source, unit_id): a variant-split unit becomes its variants."""
    j = wanted.join(variants(found), ["source", "unit"], "left")
    letters = F.when(F.coalesce(F.size("letters"), F.lit(0)) > 0, F.col("letters")).otherwise(F.array(F.lit("")))
    return j.select("source", F.explode(letters).alias("v"), "unit").select("source", F.concat(F.col("unit").cast("string"), "v").alias("unit_id"))
