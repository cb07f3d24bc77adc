"""Target-distribution importance resampling over hashed n-grams, by external sort-count.

1. Streams. A task turns each batch of texts into one packed stream of 16-bit bucket numbers, a number
   a feature in text order, with the offset at which each document begins. The streams are a table in
   the shared folder: two bytes a word, written once and read twice.
2. Counts. Each stream is sorted and run-length encoded, so a batch gives a row a bucket it holds; Spark
   sums those by bucket. What comes to the driver is a number a bucket, whatever the corpus holds.
3. Gains. The log ratio of target to corpus share of each bucket, in thousandths, rounded down.
4. Gather. The streams are read again; a document's weight is the floored mean of its features' gains, summed
   between offsets by np.add.reduceat.
5. Draw. Weight plus Gumbel noise drawn from the document's id is its score; the highest scores are a sample without
   replacement with probabilities in proportion to exp(weight / 1000). Ranks are prefix sums over
   ranges of the score, so no task sees all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import before, discard, materialize, range_parts, small_batches, table

BUCKETS = 10_000
GRAM = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Words whose bucket a worker remembers at most.
KNOWN = 1_000_000
#: Bytes of words: digits, letters (capitals become small) and all that is not ASCII; the rest parts words.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class _Buckets(dict):
    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def feature_buckets(text: bytes | None, of: dict, gram: int = GRAM) -> tuple[int, list[int]]:
    """(words, the bucket of each run of 1 to `gram` words: shorter runs first, each in text order)."""
    words = (text or b"").translate(_TABLE).split()
    found = [of[w] for w in words]
    for n in range(2, gram + 1):
        found += [of[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
    return len(words), found


def bucket_streams(docs: DataFrame, id_col: str | None, text_col: str, buckets: int = BUCKETS, gram: int = GRAM) -> DataFrame:
    """docs -> (ids, words, sizes: arrays with an entry a document; stream: binary, packed uint16), a row a batch of documents.

    A document's features are the next sizes[i] numbers of the stream. A null text has none.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("bucket numbers take 16 bits")
    small_batches(docs.sparkSession)
    own = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    rows = docs.select(own.alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Buckets(buckets)
        for b in batches:
            if not b.num_rows:
                continue
            words, sizes, parts = [], [], []
            for text in b.column(1):
                n, found = feature_buckets(text.as_py(), of, gram)
                words.append(n)
                sizes.append(len(found))
                parts.append(np.array(found, np.uint16))
            ends = pa.array([0, b.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, a) for a in (b.column(0), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([np.concatenate(parts).astype("<u2").tobytes()], pa.binary())], ["ids", "words", "sizes", "stream"])

    return rows.mapInArrow(pack, "ids array<long>, words array<long>, sizes array<long>, stream binary")


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a stream, in order, and how often each occurs: sorted, then run-length encoded."""
    s = np.sort(stream)
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[starts], np.diff(np.append(starts, len(s)))


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features lie in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream in b.column(0):
                values, many = run_lengths(np.frombuffer(stream.as_py(), "<u2"))
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), pa.array(many.astype(np.int64))], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in streams.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) a bucket, each count smoothed by one."""
    s, t = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log(((b + 1.0) * s) / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weights_of(stream: np.ndarray, sizes: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The floored mean of the gains of each document's features; 0 for a document without any."""
    out = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.add.reduceat(gains[stream], starts) // sizes[some]
    return out


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, gram: int = GRAM, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """docs -> (doc_id, n_features, weight, score, rank), a row for each row of docs; rank is null for rows not drawn.

    Drawn are floor(percent * N / 100) of the N rows with least_words words or more: the highest scores, ties to the
    smaller id (null first; rows equal in both in any order). Null and empty texts have no feature and weight 0. A row
    without an id draws its noise from the text "null". A very long text is a batch of its own and is
    used whole. An empty target leaves smoothed counts; an empty docs gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    streams = materialize(bucket_streams(docs, id_col, text_col, buckets, gram), "importance-streams")
    wanted = bucket_counts(bucket_streams(target, None, target_text_col, buckets, gram), buckets)
    gains = bucket_gains(bucket_counts(streams, buckets), wanted)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, words, sizes = (pc.list_flatten(b.column(c).slice(i, 1)) for c in range(3))
                n = sizes.to_numpy()
                found = weights_of(np.frombuffer(b.column(3)[i].as_py(), "<u2"), n, gains)
                yield pa.RecordBatch.from_arrays([ids, words, sizes, pa.array(found)], ["doc_id", "n_words", "n_features", "weight"])

    scored = streams.mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = scored.withColumn("score", F.col("weight") + noise).withColumn("out", F.col("n_words") < least_words)
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("out"), F.col("score").desc(), F.col("doc_id"), F.col("row")]
    parted = range_parts(scored.drop("n_words"), order, "importance-ranges")
    totals = parted.groupBy("_part").agg(F.count("*").alias("n"), F.count_if(~F.col("out")).alias("m"))
    drawn = percent * (totals.agg(F.sum("m")).first()[0] or 0) // 100
    offsets = before(totals, [], "n", "offset").select("_part", "offset")  # a row a partition
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = parted.join(F.broadcast(offsets), "_part").withColumn("rank", (F.col("offset") + nth).cast("long"))
    out = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    discard(streams)
    return out


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH e AS (
  SELECT 0 AS side, row_number() OVER () AS row_, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT side, row_, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM e
), f AS (SELECT side, row_, unnest(w) AS f FROM w),
-- crc32, bit by bit, of each distinct word
u AS (SELECT f, encode(f) AS b, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
t8 AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
c AS (SELECT f, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT))),
        lambda h, v: xor(h >> 8, tab[CAST(xor(h & 255, v) + 1 AS BIGINT)]))) % {BUCKETS} AS bucket FROM u, t8),
k AS (SELECT bucket, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS t FROM f JOIN c USING (f) GROUP BY bucket),
n AS (SELECT coalesce(sum(s), 0)::DOUBLE + {BUCKETS} AS s_all, coalesce(sum(t), 0)::DOUBLE + {BUCKETS} AS t_all FROM k),
g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * s_all) / ((s + 1)::DOUBLE * t_all))) AS BIGINT) AS gain FROM k, n),
m AS (SELECT row_, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN c USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY row_),
r AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS UBIGINT)::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN m USING (row_) WHERE side = 0
), o AS (
  SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS nth,
         {PERCENT} * count(*) FILTER (WHERE n_features >= {LEAST_WORDS}) OVER () // 100 AS drawn
  FROM r
)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN nth <= drawn THEN nth END AS BIGINT) AS rank FROM o
"""
