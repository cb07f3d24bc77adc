"""Layout lines from extracted spans: what a page extractor yields is turned to lines natively.

Spans: (source, page_idx, block_no, line_no, span_no, text, size, bold, font, x0, y0, x1, y1), the box being its line's.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


class Extractor(Protocol):
    """Reads a file's pages as spans, and its ruled boxes; runs on the executors. Ports for page formats implement it."""

    def spans(self, content: bytes) -> list[tuple]: ...

    def boxes(self, content: bytes) -> list[tuple]: ...


def lines_of(spans: DataFrame) -> DataFrame:
    """A line's text is all its spans' text, stripped; size the largest, bold if all, font the first, of its spans that
    aren't blank. Lines without such a span are dropped, and with them blocks without lines."""
    full = strip(F.col("text")) != ""
    keys = ["source", "page_idx", "block_no", "line_no"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "")
    out = spans.groupBy(*keys).agg(strip(text).alias("text"), F.bround(F.max(F.when(full, F.col("size"))), 1).alias("size"), F.every(F.when(full, F.col("bold"))).alias("bold"), F.min_by(F.when(full, F.col("font")), F.when(full, F.col("span_no"))).alias("font"), *[F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return out.filter("size is not null and text <> ''")


def extracted(files: DataFrame, extractor: Extractor, source: str) -> DataFrame:
    """files (path, content: binary) -> spans, by an extractor port."""

    def read(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                rows = [(source, *r) for r in extractor.spans(content)]
                yield pd.DataFrame(rows, columns=["source", "page_idx", "block_no", "line_no", "span_no", "text", "size", "bold", "font", "x0", "y0", "x1", "y1"])

    return files.select("content").mapInPandas(read, "source string, page_idx int, block_no int, line_no int, span_no int, text string, size double, bold boolean, font string, x0 double, y0 double, x1 double, y1 double")


def extracted_boxes(files: DataFrame, extractor: Extractor, source: str) -> DataFrame:
    """files (path, content: binary) -> the ruled boxes of their pages (source, page_idx, box_no, x0, y0, x1, y1), by an
    extractor port, whose boxes are (page_idx, x0, y0, x1, y1); a box without extent is none."""

    def read(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                rows = [(source, p, i, *box) for i, (p, *box) in enumerate(extractor.boxes(content))]
                yield pd.DataFrame(rows, columns=["source", "page_idx", "box_no", "x0", "y0", "x1", "y1"])

    found = files.select("content").mapInPandas(read, "source string, page_idx int, box_no int, x0 double, y0 double, x1 double, y1 double")
    return found.filter("x1 > x0 and y1 > y0")
