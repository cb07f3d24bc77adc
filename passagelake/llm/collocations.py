"""Phrase collocations: counts by minimal perfect hash over Apriori-safe candidates.

1. Words. Counts by (language, word) are summed by Spark. Words that occur often enough are the first level.
2. Streams. Texts become packed streams of 32-bit word numbers, once: a word's number is its slot in a minimal perfect
   hash over the frequent words, whose stored key tells other words; those and the ends of pieces are 0.
3. Candidates of m words are windows whose first m - 1 and last m - 1 words are both frequent, as no phrase is more
   frequent than its parts. They are hashed HASHES times to counters, and only windows all of whose counters come to the least count
   are listed (Park, Chen and Yu, SIGMOD 1995): a counter is never below the count of a window in it, so none is lost. There are
   SLOTS counters a hash, and more for more windows, so that they never fill. What a task holds of them is of a fixed size: beyond
   DENSE counters it hands on those that some windows met, and they are summed by block.
4. Counts. A perfect hash over the candidates is sent to all tasks with the candidates' keys (exact: the first
   m - 1 words' number and the last word's). A task counts its windows' slots by np.bincount; the arrays are
   summed in a tree, by blocks of CHUNK slots, so no task holds more than a few blocks of a few arrays.
5. A phrase keeps the numbers of its first and its last m - 1 words, and so finds the counts of the parts of each cut.

Tables of keys that go to all tasks hold at most BLOCK keys (some 40 MB); more keys take more passes over
the streams. Numbers of up to 2**32 - 1 phrases a level fit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, small_batches, table
from .perfecthash import PerfectHash, mix

LONGEST = 5
LEAST = 100
#: A candidate inside a longer one goes where percent * f(longer) >= INSIDE * f(candidate).
INSIDE = 100
TOP = 2000
#: Counters of a hash in the hashed pass at least, a power of two, and hashes: 48 MB in a task.
SLOTS, HASHES = 1 << 22, 3
#: Counters that a task holds as an array; of more it holds the places that windows met, MET at most.
DENSE, MET = SLOTS * HASHES, 1 << 21
BLOCK = 4_000_000
#: Slots of a block of counts that is moved as one row.
CHUNK = 1 << 14
#: Distinct words that a task counts before it hands them on, and words of a language whose key it remembers.
KNOWN = 60_000
#: A task looks at so many words of the streams at once. A stored row has some ROW words, as Spark reads thousands of rows at a time.
STREAM, ROW = 1 << 16, 1 << 10
#: A task lists so many windows before it drops the repeated ones.
LISTED = 1 << 19
#: Shares of the keys of listed windows: a task hands on one packed array for each.
DEALT = 1024
#: Small letters; ends of pieces become line ends, tabs spaces.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x0A if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))


def pieces(text: bytes | None) -> list[bytes]:
    """The words of a text in order, b"" where nothing stands between two spaces, and a line end after each piece."""
    return (text or b"").translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(_lang(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))


def _lang(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def word_key(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\0" + word)


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs -> (lang, word, n), a row each word of a language; word binary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(lang, Counter()).update(pieces(text.as_py()))
                if len(held[lang]) > KNOWN:
                    yield from out(held)
            if sum(map(len, held.values())) > 4 * KNOWN:
                yield from out(held)
        yield from out(held)

    def out(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            words.pop(b"", None)
            words.pop(b"\n", None)
            each = list(words.items())
            for at in range(0, len(each), 50_000):
                some = each[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], ["lang", "word", "n"])
        held.clear()

    return _rows(docs, text_col, lang_col).mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def key_blocks(keys: DataFrame, block: int = BLOCK) -> Iterator[tuple[int, PerfectHash]]:
    """(offset, perfect hash) of blocks of `block` keys or fewer in expectation; keys (key: long, distinct).

    Blocks are dealt by hash; numbers 1 + offset + slot tell all keys apart. One block at a time is held by the driver.
    """
    n = keys.count()
    many = max(1, -(-n // block))
    offset = 0
    for b in range(many):
        some = keys if many == 1 else keys.filter(F.pmod(F.xxhash64("key"), F.lit(many)) == b)
        parts = [np.frombuffer(bytes(r[0]), np.int64) for r in some.mapInArrow(_packed, "keys binary").toLocalIterator()]
        mph = PerfectHash(np.concatenate(parts).view(np.uint64) if parts else np.zeros(0, np.uint64))
        yield offset, mph
        offset += mph.size


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary())], ["keys"])


def tree_sum(arrays: DataFrame, width: int, levels: int = 2) -> DataFrame:
    """(chunk, at: packed uint16, n: packed, of the least width that holds them) rows of any number of arrays -> one such row a chunk.

    Two levels: salted, then by chunk; one for arrays of so many chunks that few rows meet. A task adds rows as they come, into one array a chunk.
    """
    spread = max(2, math.isqrt(max(4, arrays.sparkSession.sparkContext.defaultParallelism)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for chunk, at, n in zip(*(b.column(c) for c in ("chunk", "at", "n"))):
                if chunk.as_py() != now:
                    if now is not None:
                        yield _chunk(now, total)
                    now, total = chunk.as_py(), np.zeros(width, np.int64)
                at, n = unpacked(at.as_py(), n.as_py())
                total[at] += n
        if now is not None:
            yield _chunk(now, total)

    n = partitions(arrays.sparkSession)
    if levels == 1:
        return arrays.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, at binary, n binary")
    salted = arrays.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(spread)))
    once = salted.repartition(n, "chunk", "salt").sortWithinPartitions("chunk").select("chunk", "at", "n").mapInArrow(add, "chunk int, at binary, n binary")
    return once.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, at binary, n binary")


def _chunk(chunk: int, total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    n = total[at].astype(np.min_scalar_type(int(total.max())))
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["chunk", "at", "n"])


def unpacked(at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places in a chunk, and their counts."""
    at = np.frombuffer(at, np.uint16).astype(np.int64)
    return at, np.frombuffer(n, f"u{len(n) // max(1, len(at)) or 1}").astype(np.int64)


def chunks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for c in range(0, -(-len(total) // CHUNK)):
        part = total[c * CHUNK : (c + 1) * CHUNK]
        if part.any():
            yield _chunk(c, part)


def _counted(streams: DataFrame, slots, size: int) -> DataFrame:
    """The tree-summed counts of the slots (size of them) that slots(words, prev) gives for each stream."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for (words, prev), _ in _grouped(batches):
            np.add.at(total, slots(words, prev), np.uint32(1))
        yield from chunks(total)

    return tree_sum(streams.mapInArrow(count, "chunk int, at binary, n binary"), CHUNK)


def _met(streams: DataFrame, slots) -> DataFrame:
    """The same for any number of slots: a task holds MET places, not an array of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (words, prev), _ in _grouped(batches):
            held.append(slots(words, prev).astype(np.uint32))
            size += len(held[-1])
            if size >= MET:
                yield from out(held)
                held, size = [], 0
        yield from out(held)

    def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
        if len(at):
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            at, n = at[new], np.diff(np.append(new, len(at)))
            chunk = at // CHUNK
            cuts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            most = np.maximum.reduceat(n, cuts)
            inside, each = (at % CHUNK).astype(np.uint16), list(zip(cuts, [*cuts[1:], len(at)], most))
            counts = pa.array([n[i:j].astype(np.min_scalar_type(int(top))).tobytes() for i, j, top in each], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(chunk[cuts].astype(np.int32)), pa.array([inside[i:j].tobytes() for i, j, _ in each], pa.binary()), counts], ["chunk", "at", "n"])

    return tree_sum(streams.mapInArrow(count, "chunk int, at binary, n binary"), CHUNK, levels=1)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """(the columns of some rows of streams, joined, of STREAM words or so; the rows' lengths). Rows end where no window does."""
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        start, total, sizes = 0, 0, [len(x) // 4 for x in columns[0]]
        for i, n in enumerate(sizes, 1):
            total += n
            if total >= STREAM or i == len(sizes):
                yield [np.frombuffer(b"".join(c[start:i]), np.uint32) for c in columns], sizes[start:i]
                start, total = i, 0


def counters(total: int, least: int, slots: int) -> int:
    """Counters of a hash for so many windows: `slots`, doubled until their mean stays below two fifths of the least count."""
    while total > slots * max(1, 2 * least // 5) and HASHES * slots < 1 << 31:
        slots *= 2
    return slots


def windows(words: np.ndarray, prev: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, last part's number) of the windows of m words whose first and last m - 1 words are frequent.

    prev: at each place the number of the frequent m - 1 words that begin there, or 0.
    """
    n = max(0, len(words) - m + 1)
    first, last = prev[:n], prev[1 : n + 1]
    at = np.flatnonzero((first > 0) & (last > 0))
    key = first[at].astype(np.uint64) << np.uint64(32) | words[at + m - 1].astype(np.uint64)
    return at, key, last[at]


def encoded(docs: DataFrame, vocabulary: DataFrame, text_col: str, lang_col: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """-> (vocabulary with `id`; (words, prev: binary, packed uint32) streams of those numbers, a run of others one 0).

    A vocabulary of more than one block keeps the words' keys in the streams until the last block is numbered.
    """
    spark = docs.sparkSession
    single = vocabulary.count() <= block
    names = ["words", "prev"] if single else ["words", "prev", "keys"]
    schema = ", ".join(f"{c} binary" for c in names)
    out, numbered = None, None
    for offset, mph in key_blocks(vocabulary.select("key"), block):
        sent = spark.sparkContext.broadcast(mph)

        def numbers(keys: np.ndarray, sent=sent, offset=offset) -> np.ndarray:
            slot = sent.value.slots(keys)
            return np.where((slot >= 0) & (keys > 1), slot + 1 + offset, 0).astype(np.uint32)

        def first(batches: Iterator[pa.RecordBatch], numbers=numbers) -> Iterator[pa.RecordBatch]:
            known: dict[str, _Keys] = {}
            for keys in _cut(batches, known):
                words = numbers(keys)
                if single:
                    words = words[np.append(True, (words[1:] > 0) | (words[:-1] > 0))]
                ends = np.append(np.flatnonzero((words if single else keys) == 0) + 1, len(words))
                cuts = np.unique(np.append(ends[np.searchsorted(ends, np.arange(ROW, len(words), ROW))], len(words)))
                yield _binary(names, np.diff(cuts, prepend=0), words, words, keys)

        def more(batches: Iterator[pa.RecordBatch], numbers=numbers) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for words, keys in zip(b.column(0), b.column(2)):
                    keys = np.frombuffer(keys.as_py(), np.uint64)
                    words = np.maximum(np.frombuffer(words.as_py(), np.uint32), numbers(keys))
                    yield _binary(names, [len(words)], words, words, keys)

        was, rows = out, _rows(docs, text_col, lang_col) if out is None else out
        out = materialize(rows.mapInArrow(first if was is None else more, schema), "collocation-words")
        if was is not None:
            discard(was)
        part = _with_id(vocabulary, sent, offset)
        numbered = part if numbered is None else numbered.union(part)
    return numbered, _streams(out, "prev")


def _streams(written: DataFrame, prev: str) -> DataFrame:
    """The written table's words and numbers, still to be discarded by its path."""
    out = written.select("words", F.col(prev).alias("prev"))
    out._passagelake_path = written._passagelake_path
    return out


def _cut(batches: Iterator[pa.RecordBatch], known: dict[str, _Keys]) -> Iterator[np.ndarray]:
    """The words' keys of (lang, text) rows, texts parted by a 0, in arrays of STREAM or so."""
    held, size = [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            if lang not in known:
                if len(known) >= 16:
                    known.clear()
                known[lang] = _Keys(lang)
            of, each = known[lang], pieces(text.as_py())
            keys = np.fromiter(map(of.__getitem__, each), np.uint64, len(each))
            held.append(np.append(keys[keys != 1], np.uint64(0)))
            size += len(held[-1])
            if size >= STREAM:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _with_id(rows: DataFrame, sent, offset: int) -> DataFrame:
    """The rows whose key is in the block's perfect hash, with `id`."""

    @F.pandas_udf("long")
    def number(keys: pd.Series) -> pd.Series:
        slot = sent.value.slots(keys.to_numpy(np.int64).view(np.uint64))
        return pd.Series(np.where(slot >= 0, slot + 1 + offset, 0))

    return rows.withColumn("id", number("key")).filter("id > 0")


def _binary(names: list[str], sizes: list[int], *each: np.ndarray) -> pa.RecordBatch:
    """Rows of so many words each."""
    ends = np.cumsum(sizes)
    return pa.RecordBatch.from_arrays([pa.array([x[i - n : i].tobytes() for i, n in zip(ends, sizes)], pa.binary()) for x in each[: len(names)]], names)


class _Keys(dict):
    """A word's key; 0 for the end of a piece, 1 for nothing."""

    def __init__(self, lang: str):
        self.lang = lang

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = key = 0 if word == b"\n" else 1 if word == b"" else word_key(self.lang, word)
        return key


def _once(keys: list[np.ndarray], suffixes: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each key once; equal keys have equal suffixes."""
    key, at = np.unique(np.concatenate(keys), return_index=True)
    return [key], [np.concatenate(suffixes)[at]]


def level(streams: DataFrame, m: int, least: int, slots: int = SLOTS, block: int = BLOCK, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """-> (phrases of m words that occur `least` times or more: id, pre, suffix, a; streams with their numbers as prev). Streams that
    were read are discarded. The last level's phrases have no numbers and no streams."""
    spark = streams.sparkSession
    shift = np.uint64(64 - (slots.bit_length() - 1))

    def place(key: np.ndarray, h: int) -> np.ndarray:
        return (mix(key, h) >> shift).astype(np.int64) + h * slots

    def hashed(words: np.ndarray, prev: np.ndarray) -> np.ndarray:
        key = windows(words, prev, m)[1]
        return np.concatenate([place(key, h) for h in range(HASHES)])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, at, n in zip(*(b.column(c) for c in ("chunk", "at", "n"))):
                at, n = unpacked(at.as_py(), n.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int32()), pa.array([at[n >= least].astype(np.uint16).tobytes()], pa.binary())], ["chunk", "at"])

    heavy = np.zeros(-(-HASHES * slots // CHUNK) * (CHUNK // 8), np.uint8)  # a bit a counter
    met = _counted(streams, hashed, HASHES * slots) if HASHES * slots <= DENSE else _met(streams, hashed)
    for r in met.mapInArrow(reached, "chunk int, at binary").collect():
        one = np.zeros(CHUNK, bool)
        one[np.frombuffer(bytes(r.at), np.uint16)] = True
        heavy[r.chunk * (CHUNK // 8) : (r.chunk + 1) * (CHUNK // 8)] = np.packbits(one, bitorder="little")
    flags = spark.sparkContext.broadcast(heavy)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = flags.value
        keys, suffixes, size = [], [], 0
        for (words, prev), _ in _grouped(batches):
            _, key, last = windows(words, prev, m)
            for h in range(HASHES):
                at = place(key, h)
                some = (heavy[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                key, last = key[some], last[some]
            key, at = np.unique(key, return_index=True)
            keys.append(key)
            suffixes.append(last[at])
            size += len(key)
            if size >= LISTED:
                keys, suffixes = _once(keys, suffixes)
                size = len(keys[0])
                if size >= LISTED // 2:
                    yield from pairs(keys[0], suffixes[0])
                    keys, suffixes, size = [], [], 0
        if keys:
            keys, suffixes = _once(keys, suffixes)
            yield from pairs(keys[0], suffixes[0])

    def pairs(key: np.ndarray, suffix: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The windows as packed arrays, one for each of DEALT shares of the keys."""
        share = (mix(key, 99) % np.uint64(DEALT)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        key, suffix, share = key[order], suffix[order].astype(np.uint32), share[order]
        cuts = np.flatnonzero(np.append(True, share[1:] != share[:-1])) if len(share) else np.zeros(0, np.int64)
        each = list(zip(cuts, [*cuts[1:], len(share)]))
        columns = pa.array(share[cuts].astype(np.int32)), pa.array([key[i:j].tobytes() for i, j in each], pa.binary()), pa.array([suffix[i:j].tobytes() for i, j in each], pa.binary())
        yield pa.RecordBatch.from_arrays(list(columns), ["share", "keys", "suffixes"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window of a share once; a share's arrays come together."""
        now, keys, suffixes = None, [], []

        def out() -> pa.RecordBatch:
            key, suffix = _once(keys, suffixes)
            return pa.RecordBatch.from_arrays([pa.array(key[0].view(np.int64)), pa.array(suffix[0].astype(np.int64))], ["key", "suffix"])

        for b in batches:
            for share, key, suffix in zip(*(b.column(c) for c in ("share", "keys", "suffixes"))):
                if share.as_py() != now:
                    if keys:
                        yield out()
                    now, keys, suffixes = share.as_py(), [], []
                keys.append(np.frombuffer(key.as_py(), np.uint64))
                suffixes.append(np.frombuffer(suffix.as_py(), np.uint32))
                if len(keys) >= 64:
                    keys, suffixes = _once(keys, suffixes)
        if keys:
            yield out()

    packed = streams.mapInArrow(listed, "share int, keys binary, suffixes binary").repartition(partitions(spark), "share").sortWithinPartitions("share")
    candidates = materialize(packed.mapInArrow(merged, "key long, suffix long"), "collocation-candidates")
    found = None
    for _, mph in key_blocks(candidates.select("key"), block):
        sent = spark.sparkContext.broadcast(mph)

        def of(words: np.ndarray, prev: np.ndarray, sent=sent) -> np.ndarray:
            at = sent.value.slots(windows(words, prev, m)[1])
            return at[at >= 0]

        def frequent(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for chunk, at, n in zip(*(b.column(c) for c in ("chunk", "at", "n"))):
                    at, n = unpacked(at.as_py(), n.as_py())
                    at, n = at[n >= least] + chunk.as_py() * CHUNK, n[n >= least]
                    yield pa.RecordBatch.from_arrays([pa.array(sent.value.keys[at].view(np.int64)), pa.array(n)], ["key", "a"])

        part = materialize(_counted(streams, of, mph.size).mapInArrow(frequent, "key long, a long"), "collocation-counts")
        found = part if found is None else found.union(part)
    phrases = materialize(found.join(candidates, "key").select("key", "suffix", "a"), "collocation-phrases")
    low = F.lit((1 << 32) - 1)
    parts = F.shiftrightunsigned("key", 32).alias("pre"), F.col("key").bitwiseAND(low).alias("word"), "suffix", "a"
    if last:
        discard(streams)
        return phrases.select(F.lit(0).cast("long").alias("id"), *parts), None
    marked, numbered = streams, None
    for offset, mph in key_blocks(phrases.select("key"), block):
        sent = spark.sparkContext.broadcast(mph)

        def mark(batches: Iterator[pa.RecordBatch], sent=sent, offset=offset) -> Iterator[pa.RecordBatch]:
            for (words, prev, *now), sizes in _grouped(batches):
                out = now[0].copy() if now else np.zeros(len(words), np.uint32)
                at, key, _ = windows(words, prev, m)
                slot = sent.value.slots(key)
                out[at[slot >= 0]] = (slot[slot >= 0] + 1 + offset).astype(np.uint32)
                yield _binary(["words", "prev", "next"], sizes, words, prev, out)

        was, marked = marked, materialize(marked.mapInArrow(mark, "words binary, prev binary, next binary"), "collocation-streams")
        discard(was)
        part = _with_id(phrases, sent, offset)
        numbered = part if numbered is None else numbered.union(part)
    numbered = materialize(numbered.select("id", *parts), "collocation-level")
    return numbered, _streams(marked, "next")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, slots: int = SLOTS, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """-> (lang, n: occurrences of words; [(lang, phrase, a, ls, rs, longer) for each length from 2 on]).

    ls, rs: how often the first, and the last, 1, 2, ... words of the phrase occur; longer: the most
    occurrences of a longer phrase that holds it, null if none is frequent (the longest length has none).
    """
    small_batches(docs.sparkSession)
    counts = materialize(word_counts(docs, text_col, lang_col), "collocation-word-counts")

    @F.pandas_udf("long")
    def key(langs: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((word_key(g, w) for g, w in zip(langs, words)), np.uint64, len(words)).view(np.int64))

    vocabulary = materialize(counts.filter(F.col("n") >= least).withColumn("key", key("lang", "word")), "collocation-vocabulary")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words, streams = encoded(docs, vocabulary, text_col, lang_col, block)
    none = F.array().cast("array<long>")
    word = F.col("word").cast("string")
    below = materialize(words.select("id", "lang", word.alias("phrase"), word.alias("end"), F.col("n").alias("a"), none.alias("ls"), none.alias("rs")), "collocation-phrases-1")
    levels = []
    shorter = vocabulary.select(F.col("n").alias("a"))
    for m in range(2, longest + 1):
        total = shorter.agg(F.sum("a")).first()[0] or 0  # no fewer than there are windows
        phrases, streams = level(streams, m, least, counters(total, least, slots), block, m == longest)
        shorter = phrases.select("a")
        first = below.select(F.col("id").alias("pre"), "lang", "phrase", F.concat("ls", F.array("a")).alias("ls"))
        last = below.select(F.col("id").alias("suffix"), "end", F.concat("rs", F.array("a")).alias("rs"))
        now = phrases.join(first, "pre").join(last, "suffix")
        now = materialize(now.select("id", "pre", "suffix", "lang", F.concat_ws(" ", "phrase", "end").alias("phrase"), "end", "a", "ls", "rs"), f"collocation-phrases-{m}")
        inside = now.select(F.col("pre").alias("id"), "a").union(now.select(F.col("suffix").alias("id"), "a")).groupBy("id").agg(F.max("a").alias("longer"))
        if m > 2:
            levels.append(below.join(inside, "id", "left"))
        below = now
    levels.append(below.withColumn("longer", F.lit(None).cast("long")))
    return totals, [x.select("lang", "phrase", "a", "ls", "rs", "longer") for x in levels]


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP, slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """docs -> (lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words.

    Cutting a phrase after its first k words gives floor(1000 a n / (l r)), exactly; the lowest score of the cuts counts, ties to
    the smallest k. A phrase goes if it lies inside a longer frequent one with 100 f(longer) >= inside * a. As no phrase is
    more frequent than one inside it, looking one word further is enough. Null and empty texts have no words; a null lang is
    "und"; each row counts, so repeated rows count again; a very long text is cut into words whole, in one task. Ties
    of score and a are in the phrase's byte order. Empty tables and languages without frequent phrases give no row. Other columns are
    not read.
    """
    if longest < 2:
        raise ValueError("phrases have two words or more")
    totals, levels = phrase_counts(docs, text_col, lang_col, longest, least, slots, block)
    every = None
    for m, phrases in enumerate(levels, 2):
        kept = phrases.filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).join(totals, "lang")
        cuts = []
        for k in range(1, m):
            score = F.expr(f"(CAST(a AS DECIMAL(18, 0)) * CAST(n AS DECIMAL(18, 0)) * CAST(1000 AS DECIMAL(4, 0))) DIV (CAST(ls[{k - 1}] AS DECIMAL(18, 0)) * CAST(rs[{m - k - 1}] AS DECIMAL(18, 0)))")
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col("ls")[k - 1].alias("l"), F.col("rs")[m - k - 1].alias("r")))
        best = kept.select("lang", "phrase", "a", "n", (F.array_min(F.array(*cuts)) if len(cuts) > 1 else cuts[0]).alias("cut"))
        every = best if every is None else every.union(best)
    flat = every.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # each task keeps its own best first
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]') AS ps FROM documents
), q AS (SELECT lang, regexp_extract_all(unnest(ps), '[^ 	]+') AS w FROM d),
o AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS p FROM q, (SELECT unnest(range(1, {LONGEST + 1})) AS m) WHERE len(w) >= m
),
f AS (SELECT lang, m, p, count(*) AS n FROM o GROUP BY lang, m, p HAVING count(*) >= {LEAST}),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM q GROUP BY lang),
g AS (SELECT x.lang, x.p FROM f x JOIN f y ON x.lang = y.lang AND y.m > x.m AND 100 * y.n >= {INSIDE} * x.n AND (
        list_contains(list_transform(range(1, y.m - x.m + 2), lambda i: y.p[i:i + x.m - 1]), x.p))),
c AS (SELECT * FROM f ANTI JOIN g USING (lang, p) WHERE m > 1),
k AS (SELECT c.lang, c.p, c.m, c.n AS a, unnest(range(1, c.m)) AS k FROM c),
s AS (
  SELECT k.*, x.n AS l, y.n AS r, t.n, (1000::HUGEINT * a * t.n) // (x.n::HUGEINT * y.n) AS score,
  FROM k JOIN f x ON x.lang = k.lang AND x.p = k.p[1:k] JOIN f y ON y.lang = k.lang AND y.p = k.p[k + 1:] JOIN t ON t.lang = k.lang
),
b AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM e WHERE rank <= {TOP}
"""
