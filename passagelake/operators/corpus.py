"""A corpus in one call: which units there are, each rendered and written, each failure told."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..scratch import materialize
from ..sources.files import write_markdown_tree
from .layout import expand_variants, footers, render_units


def build_corpus(lines: DataFrame, boxes: DataFrame, wanted: DataFrame, root: str) -> DataFrame:
    """wanted (source, unit: int) -> the outcomes (source, unit_id, path, error), a row a unit or variant.

    A unit that is split into variants becomes its variants. Units that render are written below root, a URI that
    all executors reach; the others have an error and no path, and stop nothing.
    """
    units = materialize(expand_variants(footers(lines), wanted), "corpus-units")
    return materialize(write_markdown_tree(render_units(lines, boxes, units), root), "corpus-outcomes")
