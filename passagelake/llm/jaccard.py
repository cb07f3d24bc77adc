"""Jaccard self-join of shingle sets: size-aware, with a light and a heavy way.

After Deng, Tao and Li, "Overlap set similarity joins with theoretical guarantees" (SIGMOD 2018): small sets enumerate subsets
of a fixed size and meet where they share one; large sets scan inverted lists; the boundary is where the cost is least.

Two sets link when |A & B| * 100 >= percent * |A | B|, so they share c = ceil(percent / 100 * |A|) elements at least. In any one order of all
elements, the first |A| - c + k elements of A and those of B share k. With the rare elements first, that is the signature of a set:

- Light sets, of `boundary` elements or fewer, enumerate the subsets of k = 2 elements of their signature. (The subsets of c elements of
  the whole set, as in the paper, are too many at this similarity.)
- Heavy sets read the inverted lists of their signature for k = 1. The lists hold sets large enough to link with a heavy one.
- A light set of n costs its subsets; a heavy one its signature and the lists it reads, whose length the counts below
  tell. Sums by size class tell the boundary at which both together are least; the driver sees a row a class.

Rarity is read off counters of hashed elements, SLOTS and more for a larger corpus, up to MOST: an order need not be exact, only the same
everywhere. A counter holds many elements, so what it counts is no list's length: a list of the rarest is as much longer than one entry as their
counters are above the least ones. Equal sets are one node. A subset or a list is a bucket. Entries (bucket, node) are moved once, packed by shares of the keys,
and where they arrive those that are alone in their bucket, most of them, go. First a node meets the least node of all its buckets. Where the links
found leave a bucket apart, each set then meets its most alike set of another component, and at last all sets of different
components that may link meet, in parts of PART sets. So no link that joins two components is lost, and a bucket of copies
does not give all its pairs. May link: their sizes allow it, and so does a sketch of 1,024 bits in which each element flips
one bit (two sketches differ in no more bits than the sets do in elements). Each pair that meets is decided by the sets themselves.

Elements are 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import CHUNK, chunks, tree_sum, unpacked
from .common import discard, materialize, partitions, small_batches, table
from .components import components
from .perfecthash import mix
from .simhash import BROADCAST, _groups

SHINGLE = 5
PERCENT = 80
SEED = 42
#: Counters of elements, a power of two: doubled while more than LOAD words come to one, up to MOST.
SLOTS, LOAD, MOST = 1 << 20, 32, 1 << 24
#: Bytes of a word with the white space after it, for an estimate of the words.
WORD_BYTES = 6
#: Sets of a bucket that one task compares with as many others.
PART = 1024
#: Bits of a small set's sketch, and of a larger one's fold: a power of two.
BITS = 1024
#: What reading an entry of an inverted list costs, in subsets written.
READ = 0.05
#: Rows of an inverted list or of subsets that a task hands on at once, and pairs that it compares at once.
ENTRIES = 1 << 17
#: Shares of the keys: the entries of a share are sorted in one place, some 270,000 of 6 GB of texts.
DEALT = 1024
#: Bytes whose words are hashed at once.
SPAN = 1 << 16
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A number for each byte, A-Z as a-z, white space as 0, and an odd base: a word's hash is its polynomial modulo 2 ** 64, mixed.
_LETTER = mix(np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64), SEED)
_LETTER[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(_BASE)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_POWERS, _INVERSE = _powers(_BASE, SPAN), _powers(pow(_BASE, -1, 1 << 64), SPAN)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of these bytes starts, and its hash, in which A-Z count as a-z."""
    word = ~_SPACE[data]
    start = np.flatnonzero(word & np.append(True, ~word[:-1])) if len(data) else np.zeros(0, np.int64)
    out, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):  # the words that start within SPAN bytes; the last one may be longer
        first = start[at]
        upto = int(np.searchsorted(start, first + SPAN))
        last = start[upto] if upto < len(start) else len(data)
        if last - first > SPAN and upto - at > 1:
            upto -= 1
            last = start[upto]
        powers = _POWERS[: last - first] if last - first <= SPAN else _powers(_BASE, last - first)
        own = start[at:upto] - first
        out[at:upto] = np.add.reduceat(_LETTER[data[first:last]] * powers, own) * _INVERSE[own]
        at = upto
    return start, mix(out)


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The hashes of each text's distinct shingles, sorted; a text of fewer words is one shingle, one without words none."""
    texts = [t or b"" for t in texts]
    start, h = word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
    ends = np.searchsorted(start, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)).tolist()
    factors = mix(np.arange(1, shingle + 1, dtype=np.uint64)) | np.uint64(1)
    rolled = np.zeros(max(0, len(h) - shingle + 1), np.uint64)
    for c in range(shingle):
        rolled += factors[c] * h[c : c + len(rolled)]
    rolled = mix(rolled)
    out, at = [], 0
    for end in ends:
        n = end - at
        if n >= shingle:
            s = np.sort(rolled[at : end - shingle + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(mix((factors[:n] * h[at:end]).sum(keepdims=True, dtype=np.uint64), n) if n else np.zeros(0, np.uint64))
        at = end
    return out


def slot(elements: np.ndarray, slots: int) -> np.ndarray:
    return (elements >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


def counters(size: int) -> int:
    """How many counters texts of so many bytes get."""
    slots = SLOTS
    while size > LOAD * WORD_BYTES * slots and slots < MOST:
        slots *= 2
    return slots


def list_length(counted: np.ndarray) -> float:
    """How many entries the inverted list of an element of a signature holds, the rarest fifth of a set, from the counters. The least
    ones, at a hundredth, hold what comes to any counter by chance."""
    least, rare = np.quantile(counted, [0.01, 0.1])
    return 1 + float(rare - least)


def signature(elements: np.ndarray, counts: np.ndarray, percent: int, k: int) -> np.ndarray:
    """The rarest elements of a set, of which any set that links with it holds k among its own."""
    n = len(elements)
    least = -(-percent * n // 100)
    rare = counts[slot(elements, len(counts))].astype(np.uint64) << np.uint64(32) | elements & np.uint64(0xFFFFFFFF)
    return elements[np.argsort(rare, kind="stable")[: min(n, n - least + k)]]  # elements come sorted: ties are the same everywhere


def subsets(elements: np.ndarray) -> np.ndarray:
    """A key for each subset of two elements; for the set itself where it has only one."""
    if len(elements) < 2:
        return mix(elements)
    s = np.sort(elements)
    i, j = np.triu_indices(len(s), 1)
    return mix(mix(s[i]) * _STEP + s[j])


def sketch(elements: np.ndarray) -> bytes:
    bits = max(BITS, 1 << (2 * max(1, len(elements)) - 1).bit_length())
    flips = np.bincount((mix(elements, 7) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int = BITS // 8) -> bytes:
    """A sketch as one of fewer bits, what the smaller one of the same set would be."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """The bits in which two sketches differ, at the size of the smaller."""
    if len(a) != len(b):
        size = min(len(a), len(b))
        a, b = folded(a, size), folded(b, size)
    return int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum(dtype=np.int64))


def largest(c: int) -> int:
    """The largest size of a class."""
    return max(1, math.ceil(2 ** ((c + 1) / 6)) - 1)


def boundary(classes: list[tuple[int, int]], entries: float, percent: int = PERCENT) -> int:
    """The size of the largest light set at which subsets and lists together cost least.

    classes: (class, sets); entries: how many entries a list holds.
    """
    each = [(largest(c), n) for c, n in classes]
    best = (math.inf, 1)
    for x in [1, *sorted(s for s, _ in each)]:
        cost = 0.0
        for s, n in each:
            spare = s - -(-percent * s // 100)
            cost += n * math.comb(spare + 2, 2) * (s <= x) + n * (spare + 1) * ((100 * s >= percent * x) + READ * entries * (s > x))
        best = min(best, (cost, x))
    return best[1]


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch, whose last column is the text, with its texts' sets."""
    for b in batches:
        yield b, shingle_sets(b.column(b.num_columns - 1).to_pylist(), shingle)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text_key", F.col("text").cast("binary").alias("text"))


def node_of(elements: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(elements.tobytes(), SEED), np.uint64).view(np.int64))


_SIZED = "doc_id long, text_key long, node long, size long, chunk int, at binary, n binary"


def _sized(docs: DataFrame, shingle: int, slots: int) -> DataFrame:
    """A row for each row of docs (doc_id, text_key, node, size), and rows (chunk, at, n) of each task's counts of elements by slot."""

    def size_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros(slots, np.uint32), _SIZED.replace(",", "").split()[::2]
        for b, sets in _sets(batches, shingle):
            np.add.at(total, slot(np.concatenate([np.zeros(0, np.uint64), *sets]), slots), np.uint32(1))
            own = pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
            none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *own, *none], names)
        for c in chunks(total):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(c.num_rows, pa.int64())] * 4, *c.columns], names)

    return _read(docs).mapInArrow(size_up, _SIZED)


def _few(keys: DataFrame) -> DataFrame:
    """keys (two longs a row or so), to be sent to all tasks if they take BROADCAST bytes at most."""
    return F.broadcast(keys) if 24 * keys.count() <= BROADCAST else keys


def _firsts(docs: DataFrame, own: DataFrame) -> DataFrame:
    """docs without those whose set another row stands for. Texts are moved only if the rows that go are very many."""
    best = own.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    joined = own.join(best, "node")
    other = ~F.struct("doc_id", "text_key").eqNullSafe(F.col("best"))
    gone = materialize(joined.filter(other).select(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).distinct(), "jaccard-copies")
    return docs.join(_few(gone), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left_anti")


def may_link(size_a: np.ndarray, size_b: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes, whose sketches differ in so many bits, may link. Of sets that link at most
    (100 - percent) / (100 + percent) of both sizes together lie in one only."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return (100 * small >= percent * large) & ((100 + percent) * differ <= (100 - percent) * (size_a + size_b))


def _bits(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _linked(pairs: DataFrame, known: DataFrame, docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes that link: by sizes and sketches first, then, where those allow it, by the sets themselves."""

    @F.pandas_udf("boolean")
    def may(na: pd.Series, nb: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        differ = np.array([differing(x, y) for x, y in zip(a, b)], np.int64)
        return pd.Series(may_link(na.to_numpy(), nb.to_numpy(), differ, percent), dtype=bool)

    @F.pandas_udf("boolean")
    def links(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "elements"])

    of = {c: known.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("wide").alias(f"k{c}")) for c in "ab"}
    some = pairs.join(of["a"], "a").join(of["b"], "b").filter(may("na", "nb", "ka", "kb")).select("a", "b")
    some = materialize(some, "jaccard-candidates")
    wanted = some.select(F.col("a").alias("node")).union(some.select(F.col("b").alias("node"))).distinct()
    sets = materialize(_of_nodes(docs, known.join(wanted, "node")).select("node", F.col("text").cast("binary")).mapInArrow(make, "node long, elements binary").dropDuplicates(["node"]), "jaccard-sets")
    of = {c: sets.select(F.col("node").alias(c), F.col("elements").alias(f"s{c}")) for c in "ab"}
    first = of["a"].join(_few(some), "a")  # a set goes to its partners' place, those to one place each
    out = materialize(first.join(of["b"].join(_few(some.select("b").distinct()), "b", "left_semi"), "b").filter(links("sa", "sb")).select("a", "b"), "jaccard-links")
    discard(some)
    discard(sets)
    return out


def _of_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the rows that stand for these nodes (node, i, k: id and text key); repeated rows repeat."""
    nodes = materialize(nodes.select("node", "i", "k"), "jaccard-nodes")
    return docs.join(_few(nodes), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))).select("node", "text")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, node) of buckets with more than one component, with `label`."""
    labelled = members.select("key", "node").join(_few(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("many")).filter("lo <> hi")
    mixed = materialize(mixed.select("key", "many"), "jaccard-mixed")
    return materialize(labelled.join(_few(mixed), "key"), "jaccard-apart")


def _met(members: DataFrame, known: DataFrame, percent: int, nearest: bool, part: int) -> DataFrame:
    """members (key, node, label, many) -> distinct (a, b) of a bucket's sets of different components that may link.

    nearest: for each set only the one whose sketch is most alike. A bucket of more than `part` sets is dealt into
    parts, and each pair of parts is met in one place: only sizes and sketches go there. Rows come by size, and only those
    of sizes that may link are paired.
    """
    wide = members.join(known.select("node", "size", "sketch"), "node").withColumn("parts", F.ceil(F.col("many") / part).cast("long"))
    dealt = wide.withColumn("i", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = dealt.select("key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") <= F.col("j")).alias("left"), "node", "size", "sketch", "label")
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "size")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for now, group in _groups(batches, ["key", "x", "y"]):
            label, left = now["label"].to_numpy(), now["left"].to_numpy()
            _, node = np.unique(now["node"].to_numpy(), return_inverse=True)
            first = np.zeros(node.max() + 1, np.int64)
            first[node] = np.arange(len(node))  # a row of each node
            same, sizes = now["x"].to_numpy() == now["y"].to_numpy(), now["size"].to_numpy()
            bits, size, name = _bits(now["sketch"].iloc[first].to_list()), sizes[first], now["node"].to_numpy()[first]
            best: dict = {}
            for i, j in _crossed(group, left, same, sizes, percent):
                apart = label[i] != label[j]
                a, b = node[i[apart]].astype(np.uint64), node[j[apart]].astype(np.uint64)
                pair = np.unique(np.maximum(a, b) << np.uint64(32) | np.minimum(a, b))  # met in many buckets, compared once
                a, b = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
                differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
                ok = may_link(size[a], size[b], differ, percent)
                a, b, differ = a[ok], b[ok], differ[ok]
                if nearest:
                    for x, y in ((a, b), (b, a)):
                        order = np.lexsort((differ, x))
                        one, at = np.unique(x[order], return_index=True)
                        for o, d, z in zip(one.tolist(), differ[order][at].tolist(), y[order][at].tolist()):
                            best[o] = min(best.get(o, (1 << 30, 0)), (d, z))
                elif len(a):
                    yield _named(name[a], name[b])
            if best:
                yield _named(name[list(best)], name[[z for _, z in best.values()]])

    return rows.mapInPandas(meet, "a long, b long").distinct()


def _named(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def _crossed(group: np.ndarray, left: np.ndarray, same: np.ndarray, size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows that meet in each group, some ENTRIES at a time: all of a group of one part (same), else left rows with the others.

    group: dense numbers, rising; size: rising in each group. Each row is paired with the rows of its group that come after it and
    are not too large to link with it, in blocks of rows.
    """
    at_size = group.astype(np.int64) << 40 | size
    ends = np.searchsorted(at_size, group.astype(np.int64) << 40 | 100 * size // percent, side="right")
    many = ends - np.arange(len(group)) - 1
    upto, at = np.cumsum(many), 0
    while at < len(group):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ENTRIES, side="right")))
        n = many[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        met = same[i] | (left[i] != left[j])
        yield i[met], j[met]
        at = end


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, part: int = PART, light: int | None = None) -> DataFrame:
    """docs -> (doc_id, n_shingles, component_id), a row for each row of docs.

    component_id: the smallest id that can be reached over links, its own included. Sets without elements (null
    or wordless texts) link with nothing: such a row's component is its own id. Texts of fewer than `shingle` words are
    one shingle, the whole sequence. A row without an id gets its component's smallest id, null if there is none. Repeated rows
    and ids: each row is returned; rows that share an id are not linked by it. A very long text is one set, made in one task.
    Other columns of docs are not read. An empty table gives an empty table. light: the boundary, if it is not to be chosen by cost.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent from 50 to 100")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    slots = counters(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    sized = materialize(_sized(docs, shingle, slots), "jaccard-rows")
    own = sized.filter("chunk is null").select("doc_id", "text_key", "node", "size")
    counted = np.zeros(slots, np.uint16)  # MOST at most
    for r in materialize(tree_sum(sized.filter("chunk is not null").select("chunk", "at", "n"), CHUNK), "jaccard-counts").toLocalIterator():
        at, n = unpacked(bytes(r.at), bytes(r.n))
        counted[r.chunk * CHUNK + at] = np.minimum(n, np.iinfo(np.uint16).max)
    counts = spark.sparkContext.broadcast(counted)
    full = own.filter("size > 0")
    if light is None:
        classes = full.groupBy(F.floor(F.log2(F.col("size").cast("double")) * 6).alias("c")).agg(F.count_distinct("node").alias("n"))
        light = boundary([(r.c, r.n) for r in classes.collect()], list_length(counted), percent)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = -(-percent * (light + 1) // 100)  # of a set that links with a heavy one
        held, size = [], 0
        for _, sets in _sets(batches, shingle):
            for s in sets:
                keys = [mix(subsets(signature(s, counts.value, percent, 2)), 1)] if 0 < len(s) <= light else []
                if len(s) >= max(1, least):
                    keys.append(mix(signature(s, counts.value, percent, 1), 2))
                held += [(k.view(np.int64), node_of(s)) for k in keys]
                size += sum(map(len, keys))
                if size >= ENTRIES:
                    yield flat(held)
                    held, size = [], 0
        if held:
            yield flat(held)

    def flat(held: list) -> pa.RecordBatch:
        """The entries as packed arrays, a row for each share of the keys."""
        key = np.concatenate([k for k, _ in held])
        node = np.repeat(np.array([n for _, n in held], np.int64), [len(k) for k, _ in held])
        share = (key.view(np.uint64) % np.uint64(DEALT)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        key, node, share = key[order], node[order], share[order]
        first = np.flatnonzero(np.append(True, share[1:] != share[:-1]))
        each = list(zip(first, [*first[1:], len(share)]))
        return pa.RecordBatch.from_arrays([pa.array(share[first], pa.int32()), pa.array([key[i:j].tobytes() for i, j in each], pa.binary()), pa.array([node[i:j].tobytes() for i, j in each], pa.binary())], ["share", "keys", "nodes"])

    entries = _read(_firsts(docs, full)).mapInArrow(keyed, "share int, keys binary, nodes binary")
    dealt = entries.repartition(partitions(spark), "share").sortWithinPartitions("share")
    members = materialize(dealt.mapInArrow(_shared, "key long, node long, root long"), "jaccard-members")
    known = _sketched(docs, full, members, shingle)
    pairs = members.filter("node <> root").groupBy("node").agg(F.min("root").alias("b")).select(F.col("node").alias("a"), "b")
    links = _linked(pairs, known, docs, percent, shingle)
    labels = materialize(components(links, "jaccard-components"), "jaccard-labels")
    for nearest in (True, False):
        was, members = members, _apart(members, labels)
        discard(was)
        more = _linked(_met(members, known, percent, nearest, part), known, docs, percent, shingle)
        links = links.union(more)
        labels = materialize(components(links, "jaccard-components"), "jaccard-labels")
    discard(known)
    joined = full.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("doc_id", "size", "label")
    joined = materialize(joined, "jaccard-labelled")
    least = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = joined.join(least, "label").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return out.union(own.filter("size = 0").select("doc_id", "size", "doc_id"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed entries, sorted by share -> (key, node, root) of the buckets with more than one node; root is a bucket's least."""
    now, keys, nodes = None, [], []

    def out() -> Iterator[pa.RecordBatch]:
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.diff(np.append(first, len(key)))
        root, top = node[first], node[first + many - 1]
        some = np.repeat(root != top, many)
        columns = key[some], node[some], np.repeat(root, many)[some]
        for at in range(0, len(columns[0]), ENTRIES):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + ENTRIES]) for c in columns], ["key", "node", "root"])

    for b in batches:
        for share, key, node in zip(*(b.column(c) for c in ("share", "keys", "nodes"))):
            if share.as_py() != now:
                if keys:
                    yield from out()
                now, keys, nodes = share.as_py(), [], []
            keys.append(np.frombuffer(key.as_py(), np.int64))
            nodes.append(np.frombuffer(node.as_py(), np.int64))
    if keys:
        yield from out()


def _sketched(docs: DataFrame, own: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(node, size, sketch, wide, i, k) of the nodes that lie in a bucket with others; i, k: id and text key of a row of the node."""
    best = own.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    nodes = materialize(members.select("node").distinct().join(best, "node").select("node", F.col("best.doc_id").alias("i"), F.col("best.text_key").alias("k")), "jaccard-nodes")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, shingle):
            wide = [sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([folded(w) for w in wide], pa.binary()), pa.array(wide, pa.binary())], ["node", "size", "sketch", "wide"])

    made = _of_nodes(docs, nodes).select("node", F.col("text").cast("binary")).mapInArrow(make, "node long, size long, sketch binary, wide binary")
    return materialize(made.dropDuplicates(["node"]).join(nodes, "node"), "jaccard-sketches")


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_, CAST(doc_id AS BIGINT) AS doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT DISTINCT row_, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
                      ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS t
  FROM d
), z AS (SELECT row_, count(*) AS n FROM g GROUP BY row_),
l AS (
  SELECT x.row_ AS a, y.row_ AS b FROM g x JOIN g y ON x.t = y.t AND x.row_ <> y.row_ JOIN z p ON p.row_ = x.row_ JOIN z q ON q.row_ = y.row_
  GROUP BY x.row_, y.row_, p.n, q.n HAVING 100 * count(*) >= {PERCENT} * (p.n + q.n - count(*))
), reach AS (SELECT row_ AS a, row_ AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS row_, min(d.doc_id) AS component_id FROM reach JOIN d ON d.row_ = reach.b GROUP BY reach.a)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d JOIN c USING (row_) LEFT JOIN z USING (row_)
"""
