"""Mixing sources to target weights: hash-random order, prefix sums by range, an exact cut a source.

Every row gets a hash-random key. Rows are counted by (source, key, size), so rows that repeat one another are one group however many
they are. A range exchange on (source, key) deals the groups evenly, however
large one source is; sums of words by (part, source) give each part's offset, so only the one part a
source in which the budget ends is looked at group by group. The outcome is a plan with a row a source
(epochs, the key at which the last epoch is cut, the words left for the row at the cut), which any
reader of the documents applies to its rows alone: texts are never moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, before, materialize, range_parts, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, text: Column, seed: str) -> Column:
    """A row's place in the hash-random order; rows without an id are told apart by their texts."""
    none = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), none)))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size) -> with `target`, by water-filling.

    Sources in code-point order, null last, take `weights` in turn. Sorted by cap over weight, the
    sources that reach their cap come first, so sums before and after a source tell the level at
    which the rest share. The windows see a row a source, all
    sources in one task: some millions of them at most.
    """
    w = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    t = sizes.withColumn("nth", F.row_number().over(w))
    t = t.withColumn("weight", F.element_at(cycle, (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    up = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    t = t.withColumn("filled", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("weights_left", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    every = Window.partitionBy()
    t = t.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.col("filled"))
    t = t.withColumn("full", F.col("most") * F.col("weights_left") <= F.col("left") * F.col("weight"))
    t = t.withColumn("level", F.max(F.when(~F.col("full"), F.col("left") / F.col("weights_left"))).over(every))
    return t.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """-> (rows, plan): rows (doc_id, source, size, key) of all docs; plan, a row a source:
    source, source_size, target, epochs, cut_key, cut_size, cut_words.

    Null texts have size 0; the null source is a source of its own, last in order; a row with
    a null id takes its key from its text. Rows that repeat an id (or, without one, a text) and a size lie together in the order; if the cut
    falls among them, each takes an equal part of the words left (rounded down). A source of
    size 0 has target 0. An empty table gives an empty plan. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), _key(F.col(id_col), F.col(text_col), seed).alias("key"))
    rows = materialize(rows, "mix-rows")
    groups = rows.groupBy("source", "key", "size").agg(F.count("*").alias("n"))
    parted = range_parts(groups, [F.col("source").isNull(), F.col("source"), F.col("key"), F.col("size")], "mix-groups")
    by_part = materialize(parted.groupBy("source", "_part").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "mix-parts")
    sizes = by_part.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sizes, weights, share, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-targets")
    ends = before(by_part, ["source"], "words", "offset").alias("o")
    cut = ends.join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source"))).filter("rest > 0 and offset <= rest and rest < offset + words")
    cut = materialize(cut.select("o.source", "o._part", "o.offset", "p.rest"), "mix-cut-parts")
    inside = parted.alias("r").join(cut.alias("c"), same_alias("r", "c") & (F.col("r._part") == F.col("c._part"))).select("r.source", "r.key", "r.size", "r.n", "c.offset", "c.rest")
    run = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    groups = inside.withColumn("upto", F.col("offset") + F.sum(F.col("size") * F.col("n")).over(run)).filter("upto > rest")
    at = groups.groupBy("source").agg(F.min(F.struct("key", "size", "n", "upto", "rest")).alias("x"))
    at = at.select("source", F.col("x.key").alias("cut_key"), F.col("x.size").alias("cut_size"), F.floor((F.col("x.rest") - (F.col("x.upto") - F.col("x.size") * F.col("x.n"))) / F.col("x.n")).cast("long").alias("cut_words"))
    full = plan.alias("p").join(at.alias("a"), same_alias("p", "a"), "left")
    return rows, materialize(full.select("p.source", "p.source_size", "p.target", "p.epochs", "a.cut_key", "a.cut_size", "a.cut_words"), "mix-plan")


def same_alias(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _last_epoch(key: Column, size: Column) -> Column:
    """Words that the last, cut epoch takes of a row."""
    earlier = (key < F.col("p.cut_key")) | ((key == F.col("p.cut_key")) & (size < F.col("p.cut_size")))
    there = (key == F.col("p.cut_key")) & (size == F.col("p.cut_size"))
    return F.when(F.col("p.cut_key").isNull(), F.lit(0)).when(earlier, size).when(there, F.col("p.cut_words")).otherwise(F.lit(0)).cast("long")


def mix_counts(docs: DataFrame, **how) -> DataFrame:
    """docs -> (doc_id, source, size, source_size, target, taken), a row for each row of docs."""
    rows, plan = mix_plan(docs, **how)
    joined = rows.alias("r").join(plan.alias("p"), same_alias("r", "p"))
    taken = F.col("r.size") * F.col("p.epochs") + _last_epoch(F.col("r.key"), F.col("r.size"))
    return joined.select("r.doc_id", "r.source", "r.size", "p.source_size", "p.target", taken.alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", seed: str = SEED, **how) -> DataFrame:
    """The mix itself: each row as often as epochs take it whole, and the row at its source's cut
    once more with the words that the cut leaves of it (its own white space kept; chars_col, where
    there is one, follows). All columns are kept, whatever their names. Rows without words have
    size 0: they stay as often as whole epochs take them, and once if they lie before the cut.
    """
    _, plan = mix_plan(docs, id_col, text_col, source_col, seed=seed, **how)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), _key(F.col(id_col), F.col(text_col), seed).alias("key"))
    joined = rows.alias("r").join(plan.alias("p"), same_alias("r", "p"))
    size, last = F.col("r.size"), _last_epoch(F.col("r.key"), F.col("r.size"))
    whole = F.col("p.cut_key").isNotNull() & ((F.col("r.key") < F.col("p.cut_key")) | ((F.col("r.key") == F.col("p.cut_key")) & (size < F.col("p.cut_size"))))
    copies = F.col("p.epochs").cast("int") + whole.cast("int")
    part = F.when(~F.coalesce(whole, F.lit(False)), last).otherwise(F.lit(0))
    each = F.concat(F.array_repeat(F.lit(-1).cast("long"), copies), F.array_repeat(part, (part > 0).cast("int")))
    out = joined.select("r.row", F.explode(each).alias("upto"))
    pieces = F.regexp_extract_all(F.col(f"row.`{text_col}`"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(F.col("upto") < 0, F.col(f"row.`{text_col}`")).otherwise(F.array_join(F.slice(pieces, 1, F.col("upto").cast("int")), ""))
    cols = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == text_col:
            value = text
        elif chars_col and c == chars_col:
            value = F.when(F.col("upto") < 0, value).otherwise(F.char_length(text).cast(docs.schema[c].dataType))
        cols.append(value.alias(c))
    return out.select(*cols)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most, nth,
         CASE (nth - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS nth FROM s)
), f AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total
  FROM w
), g AS (
  SELECT *, most * weights_left <= (total - filled) * weight AS full_ FROM f
), l AS (
  SELECT *, max(CASE WHEN NOT full_ THEN (total - filled) / weights_left END) OVER () AS level FROM g
), t AS (
  SELECT source, source_size, CASE WHEN full_ THEN most ELSE level * weight END AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT d.*, p.source_size, p.target, p.epochs, CAST(floor(p.target) AS BIGINT) - p.epochs * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         count(*) OVER (PARTITION BY d.source, d.key, d.size) AS n
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * epochs + greatest(0, least(size, CAST(floor((rest - (upto - size * n)) / n) AS BIGINT))) AS BIGINT) AS taken
FROM r
"""
