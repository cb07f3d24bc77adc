"""A layout extractor over raw web pages: a stream of tags and texts, native, with one exchange of whole pages.

A page becomes tokens, each a tag or a text; what head, scripts, styles and comments hold is no text. Opening or closing a block
element, or a break, ends a line; other tags (links, emphasis) don't. So every visible character lies in one line.
Nesting is read off running counts: a line is inside an element while more of its tags were opened than closed,
and an element's end is the next closing tag at the depth of its own opening.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Styles: size, bold, font and left edge of a line. The first that holds of: in h1, in li, in footer, bold; else p.
STYLES = {"h1": (16.0, True, "Sans", 40.0), "li": (10.0, False, "SymbolMT", 60.0), "footer": (8.0, False, "Serif", 40.0), "b": (12.0, True, "Sans", 40.0), "p": (10.0, False, "Serif", 40.0)}
INSIDE = ("h1", "li", "footer")
#: Elements that end a line where they open or close; all others are inline.
BLOCKS = ("html", "body", "article", "section", "header", "footer", "main", "nav", "aside", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tr", "td", "th", "blockquote", "pre", "form", "figure", "br", "hr")
BOLD = ("b", "strong")
#: What is no text: comments, head, scripts, styles; an unclosed one reaches to the page's end.
HIDDEN = [r"(?is)<!--.*?(?:-->|\z)", *[rf"(?is)<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("head", "script", "style")]]
TOKEN = "<[/!?A-Za-z][^>]*>?|<[^<]*|[^<]+"
LINE_HEIGHT = 20.0


#: The named characters that are read; the ampersand last, so that none is read twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for code, char in ENTITIES:
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _upto(*keys: str):
    return Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def _depth(tags: tuple[str, ...], *keys: str) -> Column:
    """How many more of the tags were opened than closed."""
    return F.sum(F.when(F.col("tag").isin(*tags), F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)).over(_upto(*keys))


def tokens(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> (page_idx, pos, tag, closes, raw, line), a row a tag or text; line counts the blocks' edges so far.

    raw: a text, null for a tag. A < that begins no tag is text with what follows up to the next <. A null page has no token.
    """
    text = F.col("html")
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, "")
    own = pages.select(F.col("page_id").alias("page_idx"), text.alias("html")).repartition("page_idx")
    each = own.select("page_idx", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "m"))
    markup = F.col("m").rlike("^<[/!?A-Za-z]")
    tag = F.when(markup, F.lower(F.regexp_extract("m", "^</?([A-Za-z][A-Za-z0-9]*)", 1))).otherwise("")
    each = each.select("page_idx", "pos", tag.alias("tag"), (markup & F.col("m").startswith("</")).alias("closes"), F.when(~markup, F.col("m")).alias("raw"))
    return each.withColumn("line", F.sum(F.col("tag").isin(*BLOCKS).cast("int")).over(_upto("page_idx")))


def _numbered(pages: DataFrame) -> DataFrame:
    """(page_idx, first, block_no, tag, text): the lines with text, numbered in each page; first: the place of its first text."""
    rows = tokens(pages)
    for t in INSIDE:  # a closing tag too many counts for nothing after it
        rows = rows.withColumn(t, _depth((t,), "page_idx")).withColumn(t, F.col(t) > F.least(F.lit(0), F.min(t).over(_upto("page_idx"))))
    rows = rows.withColumn("bold", _depth(BOLD, "page_idx", "line") > 0).filter("raw is not null")
    full = F.col("raw").rlike(r"\S")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "")
    inside = [F.bool_or(F.when(full, F.col(t))).alias(t) for t in INSIDE]
    held = rows.groupBy("page_idx", "line").agg(whole.alias("text"), F.min("pos").alias("first"), *inside, F.bool_and(F.when(full, F.col("bold"))).alias("b"))
    held = held.withColumn("text", F.trim(F.regexp_replace(unescaped(F.col("text")), r"\s+", " "))).filter("text <> ''")
    tag = F.when(F.col("h1"), "h1").when(F.col("li"), "li").when(F.col("footer"), "footer").when(F.col("b"), "b").otherwise("p")
    number = F.row_number().over(Window.partitionBy("page_idx").orderBy("line")) - 1
    return held.select("page_idx", "first", number.alias("block_no"), tag.alias("tag"), "text")


def layout_lines(pages: DataFrame, source: str = "web") -> DataFrame:
    """pages (page_id, html) -> layout lines, a block of one line for each line with text. A null page has no line."""
    return _styled(_numbered(pages), source).drop("first")


def _styled(lines: DataFrame, source: str) -> DataFrame:
    def style(i: int) -> Column:
        out = F.lit(None)
        for t, s in STYLES.items():
            out = F.when(F.col("tag") == t, F.lit(s[i])).otherwise(out)
        return out

    y = F.col("block_no") * F.lit(LINE_HEIGHT)
    return lines.select(F.lit(source).alias("source"), "page_idx", F.col("block_no").cast("int"), F.lit(0).alias("line_no"), "text", style(0).alias("size"), style(1).alias("bold"), style(2).alias("font"), style(3).alias("x0"), y.alias("y0"), (style(3) + F.char_length("text") * 5.0).alias("x1"), (y + 12.0).alias("y1"), "first")


def element_boxes(pages: DataFrame, tags: tuple[str, ...] = ("table", "ul", "ol", "nav", "div")) -> DataFrame:
    """pages -> (page_idx, box_no, tag, depth, x0, y0, x1, y1): a box round the lines of each element, nested ones each their own.

    depth: how many elements of the same tag are open with it. An element that isn't closed reaches to the page's end. Elements
    without text have no box.
    """
    rows = tokens(pages).filter(F.col("tag").isin(*tags)).select("page_idx", "pos", "tag", "closes")
    rows = rows.withColumn("depth", _depth(tags, "page_idx", "tag") + F.col("closes").cast("int"))  # that of its opening
    after = Window.partitionBy("page_idx", "tag", "depth").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    spans = rows.withColumn("end", F.min(F.when(F.col("closes"), F.col("pos"))).over(after)).filter("not closes")
    met = spans.join(_styled(_numbered(pages), "web"), "page_idx").filter((F.col("first") > F.col("pos")) & (F.col("end").isNull() | (F.col("first") < F.col("end"))))
    boxes = met.groupBy("page_idx", "pos", "tag", "depth").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    number = F.row_number().over(Window.partitionBy("page_idx").orderBy("pos")) - 1
    return boxes.select("page_idx", number.cast("int").alias("box_no"), "tag", F.col("depth").cast("int"), "x0", "y0", "x1", "y1")
