"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken, SIGMOD 2003), in SQL functions only.

The k-grams are K words of the lower-cased text. Windows compare their rolling hash, the polynomial
sum of word codes times BASE powers modulo PRIME. All offsets' hashes are made at once, by doubling: those of 2j words
from two of j words that lie j apart. So are the windows' minima. Of each window of WINDOW neighbouring hashes the
least is kept, the rightmost of equals, with its position; a mark carries the 64-bit hash of its k-gram's words. So
any run of K + WINDOW - 1 words that two texts share gives them a common mark, and no run of fewer than K words does.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, table
from .sqlhash import hashed

K = 5
WINDOW = 16
#: Bytes of the documents at bucket ends up to which they are sent to all tasks; beyond, they are joined by bucket.
BROADCAST = 64 << 20
#: Of the rolling hash. Products of two residues, and a hash beside a position, fit 62 bits.
PRIME, BASE = (1 << 31) - 1, 1_000_003
_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda's variable is bound, not expanded again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _doubled(a: Column, n: int, join: Callable[[Column, Column, int], Column], body: Callable[[Column], Column]) -> Column:
    """body(array of the joins of n neighbours of a, at every offset), each level of halves computed once.

    join(x, y, w): of the join of neighbours and that of the next w neighbours, the join of all.
    """

    def paired(left: Column, right: Column, apart: int, w: int) -> Column:
        """left[i] joined with right[i + apart], of width w."""
        return F.transform(F.slice(left, 1, F.greatest(F.size(right) - F.lit(apart), F.lit(0))), lambda x, i: join(x, F.get(right, i + F.lit(apart)), w))

    def step(level: Column, width: int, held: Column | None, held_width: int) -> Column:
        if n & width:
            both = level if held is None else paired(held, level, held_width, width)
            if held_width + width == n:
                return let(both, body)
            return let(both, lambda h: let(paired(level, level, width, width), lambda up: step(up, 2 * width, h, held_width + width)))
        return let(paired(level, level, width, width), lambda up: step(up, 2 * width, held, held_width))

    return step(a, 1, None, 0)


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The fingerprint: array<struct<hash: long, position: int>>, by position.

    hash: xxhash64 over the k-gram's words in turn; position: of its first word, from 0. A text of
    fewer than k words has one k-gram, all its words; a null text or one without words an empty array.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")
    low = F.lit(PRIME).cast("long")

    def rolled(x: Column, y: Column, w: int) -> Column:
        return (x * F.lit(pow(BASE, w, PRIME)).cast("long") + y) % low

    def marks(w: Column, grams: Column) -> Column:
        # a hash and, below it, the position from the end: the least is the rightmost of the least hashes
        packed = F.transform(grams, lambda h, i: h * F.lit(1 << 31).cast("long") + (low - i))
        few = lambda p: F.array(F.array_min(p))
        chosen = lambda p: F.when(F.size(p) < window, few(p)).otherwise(_doubled(p, window, lambda x, y, _: F.least(x, y), F.array_distinct))
        at = lambda x: (low - x % F.lit(1 << 31).cast("long")).cast("int")
        return F.transform(let(packed, chosen), lambda x: F.struct(F.xxhash64(F.slice(w, at(x) + 1, k)).alias("hash"), at(x).alias("position")))

    codes = lambda w: F.transform(w, lambda x: F.pmod(F.xxhash64(x), low))
    empty = F.array().cast("array<struct<hash:bigint,position:int>>")
    alone = lambda w: F.array(F.struct(F.xxhash64(w).alias("hash"), F.lit(0).alias("position")))
    return let(words, lambda w: F.when(F.size(w) == 0, empty).when(F.size(w) <= k, alone(w)).otherwise(let(codes(w), lambda c: _doubled(c, k, rolled, lambda g: marks(w, g)))))


def shown(marks: Column) -> Column:
    """A fingerprint as a string: hex hash, colon, position, for each mark."""
    return F.lower(F.array_join(F.transform(marks, lambda m: F.concat(F.hex(m["hash"]), F.lit(":"), m["position"].cast("string"))), " "))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda m: m["hash"]))


def _searched(cuts: list[int], value: Column, ok: Callable[[Column, Column], Column]) -> Column:
    """How many of the sorted cuts are ok(cut, value), by binary search."""
    table = F.lit(np.array(cuts or [0], np.int64))
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(max(1, len(cuts)).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(ok(F.get(table, at + s - F.lit(1)), value), at + s).otherwise(at))
    return found if cuts else F.lit(0)


def _bucket(cuts: list[int]) -> Column:
    """A bucket number that rises along descending ids. An id that is several of the cuts, as so many rows
    have it, fills as many buckets, by its texts' hashes."""
    below = _searched(cuts, F.col("doc_id"), lambda c, v: c < v)
    upto = _searched(cuts, F.col("doc_id"), lambda c, v: c <= v)
    share = F.col("text_key") / F.lit(2.0**64) + F.lit(0.5)
    inside = F.least(F.floor(share * (upto - below)).cast("int"), upto - below - F.lit(1)) + F.lit(1)
    return (F.lit(len(cuts)) - F.when(upto - below < 2, below).otherwise(upto - inside)).cast("int")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    -> (doc_id, text, edited, marks, edited_marks, next_hashes), a row for each row of docs. edited:
    the last half of the text's code points replaced by the first as many of the next document in
    descending id order (equal ids by text hash; after the last comes the first). A row without an id is
    compared with the first document. A null text is empty. Rows equal in id and text follow each other.
    Other columns are not read. An empty table gives no row; without any id a row is compared with itself.

    Ids are dealt in order into a bucket for each shuffle partition, of equally many rows, so texts move once; where
    a bucket ends, the first document of the next bucket follows, one a bucket. Rows without an id are
    dealt evenly, whatever their text.
    """
    spark = docs.sparkSession
    many = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    narrow = materialize(rows.select("doc_id", "text_key"), "winnow-ids")
    found = narrow.agg(F.percentile_approx("doc_id", F.lit(np.arange(1, max(2, many)) / max(2, many)), 20 * many).alias("cuts")).first()
    bucket = _bucket(sorted(found.cuts or []))
    first = F.min(F.struct(F.bitwise_not("doc_id").alias("down"), "text_key", "doc_id"))
    heads = narrow.filter("doc_id is not null").groupBy(bucket.alias("bucket")).agg(first.alias("x")).orderBy("bucket").collect()  # a row a bucket
    discard(narrow)
    if not heads:
        return rows.withColumn("marks", winnow(F.col("text"), k, window)).select("doc_id", "text", F.col("text").alias("edited"), "marks", F.col("marks").alias("edited_marks"), hashes(F.col("marks")).alias("next_hashes"))
    after = [(h.bucket, *heads[(i + 1) % len(heads)].x[1:]) for i, h in enumerate(heads)] + [(-1, *heads[0].x[1:])]
    ends = spark.createDataFrame(after, "bucket int, k long, i long")
    texts = rows.join(F.broadcast(ends.select("i", "k").distinct()), (F.col("doc_id") == F.col("i")) & (F.col("text_key") == F.col("k"))).dropDuplicates(["i", "k"])
    at_ends = ends.join(texts.select("i", "k", F.col("text").alias("end_text")), ["i", "k"])
    at_ends = materialize(at_ends.select("bucket", "end_text", hashes(winnow(F.col("end_text"), k, window)).alias("end_hashes")), "winnow-bucket-ends")
    size = at_ends.agg(F.sum(F.octet_length("end_text") + 8 * F.size("end_hashes") + 64)).first()[0]
    lost = F.pmod(F.xxhash64("text_key", F.monotonically_increasing_id()), F.lit(many)).cast("int")
    dealt = rows.withColumn("place", F.coalesce(bucket, lost)).repartitionById(max(2, many), F.col("place"))
    dealt = dealt.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("place")))
    dealt = dealt.withColumn("marks", winnow(F.col("text"), k, window)).withColumn("own", hashes(F.col("marks")))
    w = Window.partitionBy("place", "bucket").orderBy(F.col("doc_id").desc(), "text_key")
    next_ = lambda c: F.when(F.col("bucket") >= 0, F.lead(c).over(w))
    both = dealt.withColumn("next_text", next_("text")).withColumn("next_hashes", next_("own")).join(F.broadcast(at_ends) if size <= BROADCAST else at_ends, "bucket")
    half = F.floor(F.char_length("text") / 2).cast("int")
    head = F.left(F.coalesce("next_text", "end_text"), half)
    out = both.select("doc_id", "text", "marks", F.coalesce("next_hashes", "end_hashes").alias("next_hashes"), F.concat(F.left("text", F.char_length("text") - half), head).alias("edited"))
    return out.withColumn("edited_marks", winnow(F.col("edited"), k, window))


def op6_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compared(table(spark, sf_dir, "documents"))
    out = out.withColumn("own", hashes(F.col("marks"))).withColumn("other", hashes(F.col("edited_marks")))
    return out.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("marks")).alias("fingerprint"),
        shown(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_hashes")).alias("near_next"),
    )


def _sql(k: int = K, window: int = WINDOW) -> str:
    rolled = "c0"
    for j in range(1, k):
        rolled = f"(({rolled}) * {BASE} + c{j}) % {PRIME}"
    chain = [f"h0 AS (SELECT DISTINCT {', '.join(f'w{j}' for j in range(k))}, 42::UBIGINT AS hash FROM m)"]
    for j in range(k):
        chain.append(hashed(f"z{j}", f"h{j}", f"w{j}", "hash").strip())
        chain.append(f"h{j + 1} AS (SELECT * EXCLUDE (h) REPLACE (coalesce(h, hash) AS hash) FROM z{j})")
    return rf"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS row_, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT *, CASE WHEN doc_id IS NULL OR row_ = (SELECT count(doc_id) FROM d) THEN 1 ELSE row_ + 1 END AS next_ FROM d
), b AS (
  SELECT n.*, left(n.text, length(n.text) - length(n.text) // 2) || left(o.text, length(n.text) // 2) AS edited FROM n JOIN d o ON o.row_ = n.next_
), t AS (
  SELECT row_, 0 AS e, text FROM b UNION ALL SELECT row_, 1, edited FROM b
), s AS (
  SELECT row_, e, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM t
), w AS (
  SELECT row_, e, unnest(ws) AS w, unnest(range(len(ws))) AS pos, len(ws) AS many FROM s
), u AS (SELECT DISTINCT w FROM w), {hashed("z", "u", "w", "42").strip()}, v AS (
  SELECT w.*, CAST(((CAST(h AS HUGEINT) - CASE WHEN h >= {1 << 63}::UBIGINT THEN {1 << 64}::HUGEINT ELSE 0 END) % {PRIME} + {PRIME}) % {PRIME} AS BIGINT) AS c FROM w JOIN z USING (w)
), r AS (
  SELECT row_, e, pos, many, {", ".join(f"lead(c, {j}) OVER x AS c{j}, lead(w, {j}) OVER x AS w{j}" for j in range(k))} FROM v WINDOW x AS (PARTITION BY row_, e ORDER BY pos)
), q AS (
  SELECT *, coalesce({rolled}, 0) * {1 << 31} + ({PRIME} - pos) AS packed, greatest(many - {k - 1}, 1) AS grams FROM r WHERE pos < greatest(many - {k - 1}, 1)
), a AS (
  SELECT *, min(packed) OVER (PARTITION BY row_, e ORDER BY pos ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS least FROM q
), m AS (
  SELECT q.row_, q.e, q.pos, {", ".join(f"q.w{j}" for j in range(k))} FROM q
  JOIN (SELECT DISTINCT row_, e, least FROM a WHERE pos < greatest(grams - {window - 1}, 1)) l ON q.row_ = l.row_ AND q.e = l.e AND q.packed = l.least
), {", ".join(chain)}, k AS (
  SELECT row_, e, pos, hash FROM m JOIN h{k} ON {" AND ".join(f"m.w{j} IS NOT DISTINCT FROM h{k}.w{j}" for j in range(k))}
), y AS (
  SELECT row_, e, string_agg(lower(to_hex(hash)) || ':' || pos, ' ' ORDER BY pos) AS shown, list(DISTINCT hash) AS hashes FROM k GROUP BY row_, e
), f AS (
  SELECT b.*, coalesce(own.shown, '') AS fingerprint, coalesce(other.shown, '') AS edited_fingerprint, coalesce(own.hashes, []) AS ho, coalesce(other.hashes, []) AS he, coalesce(nxt.hashes, []) AS hn
  FROM b LEFT JOIN y own ON own.row_ = b.row_ AND own.e = 0 LEFT JOIN y other ON other.row_ = b.row_ AND other.e = 1 LEFT JOIN y nxt ON nxt.row_ = b.next_ AND nxt.e = 0
)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       {_like("ho", "he")} AS near_edited, {_like("ho", "hn")} AS near_next
FROM f
"""


def _like(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE CAST({both} AS DOUBLE) / (len({a}) + len({b}) - {both}) END"


SQL = _sql()
