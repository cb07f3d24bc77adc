"""SimHash near-duplicates: fingerprints, BK-tree search of sharded fingerprints, components.

Shards. Two fingerprints that differ in at most r of 64 bits agree on one of r + 1 blocks of bits,
and of the bits left on one of r + 1 sub-blocks (Manku et al., WWW 2007). Each pair (block,
sub-block) is a table; a shard is the set of distinct fingerprints that agree on a table's bits. Each
shard's BK-tree goes, with the queries that can have a match in it, to one place, so a tree is never
sent where no query can match. A shard of more than SHARD fingerprints is dealt into parts by hash,
a tree each, and each part's tree meets the queries of every part: that loses no pair and bounds
both a tree and a task. A shard of n fingerprints is so dealt n / SHARD times; that matters only where very many
distinct fingerprints agree on a table's 28 bits or so.

dedup() looks for exact Jaccard similarity of distinct five-word shingles, SIMILARITY or more. Fingerprints
of such texts are some ten bits apart (12, deviation 3.1, for the shortest texts), so it searches its trees
with NEAR_RADIUS, which loses 3e-5 of them. Blocks of bits can't shard at that radius (each would have to be
two bits), so its shards are MinHash bands: two texts at SIMILARITY share one of BANDS bands of ROWS values but
for (1 - 0.8^5)^24 = 7e-5. In each shard every fingerprint first meets the root of the shard's BK-tree; where
the links found so far leave a shard apart, all its fingerprints search the whole tree, in parts of SHARD
fingerprints or PART_SHINGLES shingles, so that very long texts fill a task no more than short ones. Each pair within the
radius is checked by its exact similarity before it is a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bktree import Forest, spanning_links
from .common import discard, materialize, small_batches, table
from .components import components
from .sqlhash import hashed

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of one tree at most.
SHARD = 1024
#: Shingles of one tree's texts at most, in expectation, where the texts' sets go with their fingerprints.
PART_SHINGLES = 1 << 21
#: What dedup() takes for near-duplicates: Jaccard similarity of distinct shingles of so many words.
SIMILARITY = 0.8
NEAR_SHINGLE = 5
NEAR_RADIUS = 24
BANDS, ROWS = 24, 5
#: Bytes of row keys up to which they are sent to all tasks.
BROADCAST = 64 << 20
_MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle of one text, in order; none for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, n)


def _majority(h: np.ndarray) -> int:
    n, ones = len(h), np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # a very long text takes bounded memory
        part = h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, unsigned; 0 for a null text or one without words."""
    return _majority(shingle_hashes(text, shingle))


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        codes = np.fromiter((fingerprint(t if isinstance(t, str) else None) for t in texts), np.uint64, len(texts))
        yield pd.Series(codes.view(np.int64))


def hex16(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def _tables(radius: int) -> list[int]:
    """The bit masks of the tables, as signed longs: a block and a sub-block of the bits left."""
    cut = lambda bits, n: [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]
    every, masks = list(range(64)), []
    for block in cut(every, radius + 1):
        for sub in cut([b for b in every if b not in block], radius + 1):
            mask = sum(1 << b for b in [*block, *sub])
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def hamming_links(codes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """codes (fp: long, distinct) -> (a, b): links whose components are those of all pairs within
    the radius. A shard part gives a spanning set of its links, not all its pairs."""
    masks = _tables(radius)
    keyed = codes.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("s"),
    ).select("fp", "s.t", "s.k")
    full = materialize(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-shards")
    parts = F.ceil(F.col("n") / shard).cast("long")
    member = keyed.join(full, ["t", "k"]).withColumn("s", parts).withColumn("i", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("s")))
    met = member.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    rows = met.select("t", "k", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") <= F.col("j")).alias("tree"), "fp")
    dealt = rows.repartition("t", "k", "x", "y").sortWithinPartitions("t", "k", "x", "y", "fp")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for now, group in _groups(batches, ["t", "k", "x", "y"]):
            fp = now["fp"].to_numpy(np.int64)
            root = spanning_links(fp.view(np.uint64), group, now["tree"].to_numpy(bool), radius)
            apart = root != np.arange(len(root))
            yield pd.DataFrame({"a": fp[apart], "b": fp[root[apart]]})

    return dealt.mapInPandas(link, "a long, b long").distinct()


def _and_end(batches):
    yield from batches
    yield None


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs -> (doc_id, text_key, fp, component_id, first), a row for each row of docs.

    text_key is xxhash64 of the text; fp the fingerprint as a signed long; component_id the smallest
    id that can be reached over links of at most `radius` differing bits, itself included.
    Null or wordless texts have fingerprint 0 and link like any other. Null ids: such a row gets its
    component's smallest non-null id, null if there is none. Repeated rows and ids: each row is
    returned. Other columns of docs are not read. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), _fingerprints(F.col(text_col)).alias("fp"))
    own = materialize(own, "simhash-fingerprints")
    classes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    labels = materialize(components(hamming_links(classes.select("fp"), radius), "simhash-components"), "simhash-labels")
    joined = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    joined = materialize(joined, "simhash-joined")
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    of = materialize(joined.join(least, "label").select("fp", "label", "component_id"), "simhash-of")
    for table_ in (classes, labels, joined):
        discard(table_)
    return own.join(of, "fp").select("doc_id", "text_key", "fp", "label", "component_id")


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each MinHash band of a set of shingle hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (_MULTIPLIERS[:, None] * h[None, at : at + 4096]).min(1))
    rows = np.column_stack([np.arange(BANDS, dtype=np.uint64), least.reshape(BANDS, ROWS)])
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), SEED) for r in rows), np.uint64, BANDS)


@F.pandas_udf(T.StructType([T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
def _sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        sets = [np.unique(shingle_hashes(t if isinstance(t, str) else None, NEAR_SHINGLE)) for t in texts]
        node = np.fromiter((xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets), np.uint64, len(sets))
        fp = np.fromiter(map(_majority, sets), np.uint64, len(sets))
        yield pd.DataFrame({"node": node.view(np.int64), "fp": fp.view(np.int64), "size": [len(h) for h in sets], "bands": [band_keys(h).view(np.int64) for h in sets]})


@F.pandas_udf(T.BinaryType())
def _shingle_set(texts: pd.Series) -> pd.Series:
    return pd.Series([np.unique(shingle_hashes(t if isinstance(t, str) else None, NEAR_SHINGLE)).tobytes() for t in texts], dtype=object)


@F.pandas_udf(T.DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0)
    return pd.Series(out)


def within(queries: np.ndarray, nodes: np.ndarray, radius: int) -> np.ndarray:
    """Which nodes lie within the radius of which queries, by a search of the nodes' BK-tree."""
    codes, at = np.unique(nodes, return_inverse=True)
    forest = Forest(codes, np.zeros(len(codes), np.int64))
    asked, row = np.unique(queries, return_inverse=True)
    out = np.zeros((len(asked), len(codes)), bool)
    for q, n in forest.search(asked, np.zeros(len(asked), np.int64), radius):
        out[q, n] = True
    return out[row][:, at]


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (of left, of right) of sets with the Jaccard similarity or more, by products of incidence matrices."""
    used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    sets, of_left, of_right = [sets[i] for i in used], place[: len(left)], place[len(left) :]
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    row, (_, column) = row[shared], np.unique(column[shared], return_inverse=True)
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    wide = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        part = np.zeros((len(sets), wide), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        both += part[of_left] @ part[of_right].T
    whole = sizes[of_left][:, None] + sizes[of_right][None, :] - both
    q, t = np.nonzero(both >= np.float64(similarity) * whole - 1e-9)
    return left[q], right[t]


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(one, "a").join(two, "b").withColumn("like", _jaccard("sa", "sb"))
    return met.filter(F.col("like") >= similarity - 1e-12).select("a", "b")


def _cross_links(members: DataFrame, similarity: float) -> DataFrame:
    """members (k, s, node, fp, label, shingles) -> distinct (a, b): a shard's similar pairs with unlike labels.
    s: into how many parts the shard is dealt."""
    dealt = members.withColumn("i", F.pmod(F.xxhash64("node", F.lit("part")), F.col("s")))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    rows = dealt.select("k", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") <= F.col("j")).alias("tree"), "node", "fp", "label", "shingles")
    rows = rows.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y", "node")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for now, group in _groups(batches, ["k", "x", "y"]):
            fp, label, tree = now["fp"].to_numpy(np.int64).view(np.uint64), now["label"].to_numpy(np.int64), now["tree"].to_numpy(bool)
            sets = [np.frombuffer(x, np.uint64) for x in now["shingles"]]
            for rows in np.split(np.arange(len(now)), np.flatnonzero(np.diff(group)) + 1):
                right = np.flatnonzero(tree[rows])
                if not len(right) or (label[rows] == label[rows[0]]).all():
                    continue
                near = within(fp[rows], fp[rows[right]], NEAR_RADIUS) & (label[rows][:, None] != label[rows[right]][None])
                left, far = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if not len(left):
                    continue
                a, b = similar_pairs([sets[r] for r in rows], left, right[far], similarity)
                met = near[a, np.searchsorted(right, b)]
                links = pd.DataFrame({"a": label[rows[a[met]]], "b": label[rows[b[met]]]})
                yield links.assign(a=links.max(axis=1), b=links.min(axis=1)).drop_duplicates()

    return rows.mapInPandas(meet, "a long, b long").distinct()


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches, cut anew so that no group is parted: (rows, dense group numbers)."""
    carry = None
    for batch in _and_end(batches):
        now = batch if carry is None else carry if batch is None else pd.concat([carry, batch], ignore_index=True)
        if now is None or not len(now):
            continue
        group = now.groupby(by, sort=False).ngroup().to_numpy()
        whole = np.ones(len(now), bool) if batch is None else group != group[-1]
        carry = now[~whole].reset_index(drop=True)
        if whole.any():
            yield now[whole].reset_index(drop=True), group[whole]


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shard: int = SHARD, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """docs -> (doc_id, text_key, label), a row for each row: texts linked by pairs of at least the similarity
    have the same label. Texts with the same set of shingles are one node; null and wordless texts are such."""
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), _sketches(text).alias("s"))
    own = materialize(own.select("doc_id", "text_key", "s.node", "s.fp", "s.size", "s.bands"), "near-sketches")
    classes = materialize(own.groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")), "near-classes")
    keyed = classes.select("node", "fp", "size", F.explode("bands").alias("k"))
    parts = F.greatest(F.ceil(F.count("*") / shard), F.ceil(F.sum("size") / part_shingles)).cast("long")
    full = keyed.groupBy("k").agg(F.count("*").alias("n"), parts.alias("s"), F.min(F.struct("node", "fp")).alias("root")).filter("n > 1")
    members = materialize(keyed.drop("size").join(full, "k"), "near-members")
    wanted = members.select("node").distinct().join(classes.select("node", "text_key"), "node")
    texts = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")).join(wanted, "text_key")
    texts = texts.groupBy("node").agg(F.min("text").alias("text"))
    sets = materialize(texts.select("node", _shingle_set("text").alias("shingles")), "near-sets")
    near_root = F.bit_count(F.col("fp").bitwiseXOR(F.col("root.fp"))) <= NEAR_RADIUS
    star = members.filter((F.col("node") != F.col("root.node")) & near_root).select(F.col("node").alias("a"), F.col("root.node").alias("b")).distinct()
    labels = materialize(components(_similar(star, sets, similarity), "near-components"), "near-labels")
    wide = members.filter("n > 2").drop("root").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    wide = materialize(wide, "near-wide")
    mixed = wide.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("k")
    more = _cross_links(wide.join(mixed, "k").join(sets, "node"), similarity)
    links = labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)
    labels = materialize(components(links, "near-components"), "near-labels")
    for table_ in (classes, members, sets, wide):
        discard(table_)
    return own.join(labels, "node", "left").select("doc_id", "text_key", F.coalesce("label", "node").alias("label"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays.

    Near-duplicates share at least `similarity` of their distinct five-word shingles (Jaccard).
    All columns of docs are kept, whatever their names. Of a component without any id the row with
    the smallest text_key stays; of rows that repeat an id and text, one stays (which of rows that
    differ only in other columns: the smallest by those columns' hash). Texts are moved only if the keys of the
    rows that go, or of repeated rows, take over BROADCAST bytes.
    """
    of = materialize(near_components(docs, id_col, text_col, similarity), "near-rows")
    best = of.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    best = best.select(_row_key(F.col("best.doc_id"), F.col("best.text_key")).alias("key"), F.lit(True).alias("kept"))
    each = of.groupBy(_row_key(F.col("doc_id"), F.col("text_key")).alias("key")).agg(F.count("*").alias("n")).join(best, "key", "left")
    flagged = each.withColumn("once", F.coalesce("kept", F.lit(False))).filter("not once or n > 1").select("key", "once")
    flagged = materialize(flagged, "near-flags")
    discard(of)
    size = flagged.agg(F.sum(F.octet_length("key") + 64), F.max("once")).first()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _row_key(F.col(id_col), F.xxhash64(F.col(text_col))).alias("key"))
    rows = rows.join(F.broadcast(flagged) if (size[0] or 0) <= BROADCAST else flagged, "key", "left")
    out = rows.filter("once is null").select("row.*")
    if not size[1]:
        return out
    w = Window.partitionBy("key").orderBy(F.xxhash64("row"))
    again = rows.filter("once").withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    return out.union(again.select("row.*"))


def _row_key(doc_id: Column, text_key: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("none")), text_key.cast("string"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = simhash_components(table(spark, sf_dir, "documents"))
    return of.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_, CAST(doc_id AS BIGINT) AS doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT row_, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
                      ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS t
  FROM d
), u AS (SELECT DISTINCT t FROM g), {hashed("z", "u", "t", str(SEED)).strip()}, f AS (
  SELECT row_, {" + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0 END" for b in range(64))} AS fp
  FROM g JOIN z USING (t) GROUP BY row_
), o AS (SELECT doc_id, coalesce(CAST(fp AS UBIGINT), 0::UBIGINT) AS fp FROM d LEFT JOIN f USING (row_)),
p AS (SELECT DISTINCT fp FROM o),
l AS (SELECT x.fp AS a, y.fp AS b FROM p x JOIN p y ON bit_count(CAST(xor(x.fp, y.fp) AS HUGEINT)) <= {RADIUS}),
reach AS (SELECT fp AS a, fp AS b FROM p UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS fp, min(o.doc_id) AS component_id FROM reach JOIN o ON o.fp = reach.b GROUP BY reach.a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM o JOIN c USING (fp)
"""
