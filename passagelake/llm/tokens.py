"""Token ids in Arrow IPC files of fixed-size-list batches.

A shard file holds rows of equal length: `ids`, a fixed-size list of unsigned integers, and `mask`, a
fixed-size list of booleans that is false on the padding of the shard's last row. Nothing in it is
compressed, so a reader maps the file and reaches row i of batch b without a copy. Beside it lies a
small Arrow file with each document's id, place and length. Shards are ranges of ascending id; a
manifest, written through Spark, names the files that count, so files of lost or repeated tasks are
never read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, scratch_path, small_batches, table

LENGTH = 2048
END = 2
#: Rows of a record batch.
BATCH = 128
#: Bytes that the pieces known to one worker take, about.
CACHE_BYTES = 64 << 20
#: Bytes that a known piece takes beside its string: a place in a table, a number, its ids.
PIECE_BYTES = 160
#: Pieces that are encoded together, about; a longer text is encoded in parts.
RUN = 1 << 17
#: White space as the pre-tokenizer's \s has it, letters that it surely takes as such, common marks.
_SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_LETTER = "A-Za-z" + "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
_MARK = r".,;:!?#$%&*|"
#: A piece is white space and what follows up to the next white space, without the marks that end it after a
#: letter; those are a piece too. No pre-token crosses such a boundary, so a text's ids are its pieces' ids
#: in a row.
_PIECE = re.compile(f"[{_SPACE}]*+[^{_SPACE}{_MARK}]++(?:(?=[{_SPACE}]|\\Z)|(?<=[{_LETTER}])(?=[{_MARK}]))|[{_MARK}]++(?=[{_SPACE}]|\\Z)|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_PLAIN = re.compile(f" ?[{_LETTER}]+")
#: The alphabet of byte-level tokenizers: printable Latin-1 stands for itself, other bytes for 256, 257, ... in turn.
_BYTE = dict(zip([b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)], map(chr, range(256, 512))))
_encoders: dict[str, "Encoder"] = {}


class _Pieces(dict):
    """piece -> its number; the ids of all pieces in one array. A new piece gets the next number and waits in `fresh`."""

    def __init__(self):
        self.fresh: list[str] = []
        self.ids, self.starts, self.uses = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(0, np.int64)
        self.done = self.used = self.bytes = 0

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        n = self[piece] = len(self)
        return n

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the next pieces, by number."""
        k, n = self.done + len(lengths), len(ids)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + n] = ids
        self.starts[self.done + 1 : k + 1] = self.used + np.cumsum(lengths)
        self.used, self.done = self.used + n, k

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """-> (the ids of pieces in a row, how many each has)."""
        starts = self.starts[at]
        lengths = self.starts[at + 1] - starts
        starts[1:] -= np.cumsum(lengths)[:-1]
        return self.ids[np.repeat(starts, lengths) + np.arange(lengths.sum())], lengths

    def count(self, at: np.ndarray) -> None:
        new = np.bincount(at, minlength=len(self))
        new[: len(self.uses)] += self.uses
        self.uses = new

    def favourites(self) -> "_Pieces":
        """The half that was used most."""
        out = _Pieces()
        at = np.sort(np.argsort(-self.uses, kind="stable")[: len(self) // 2])
        every = list(self)
        held = [every[i] for i in at.tolist()]
        out.update(zip(held, range(len(held))))
        out.add(*self.gather(at))
        out.uses, out.bytes = self.uses[at] // 2, _size(held)
        return out


def _size(pieces: list[str]) -> int:
    return sum(map(sys.getsizeof, pieces)) + PIECE_BYTES * len(pieces)


def _runs(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """The texts' pieces in runs of about RUN, each with the places in it where a text ends."""
    pieces, ends = [], []
    for t in texts:
        if t and len(t) > RUN:
            for m in _PIECE.finditer(t):
                pieces.append(m[0])
                if len(pieces) >= RUN:
                    yield pieces, ends
                    pieces, ends = [], []
        elif t:
            pieces += _PIECE.findall(t)
        ends.append(len(pieces))
        if len(pieces) >= RUN:
            yield pieces, ends
            pieces, ends = [], []
    if ends:
        yield pieces, ends


class Encoder:
    """Encodes whole texts with the tokenizers library.

    A byte-level tokenizer whose pre-tokenizer splits before white space and adds no prefix gets each
    distinct piece once, as long as it is known: at CACHE_BYTES the half of the known pieces that was
    used least is forgotten. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        split = plan.get("pre_tokenizer") or {}
        added = [t for t in plan.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or _PIECE.findall(t["content"]) != [t["content"]]]
        self.by_piece = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and plan.get("normalizer") is None and not added and not plan.get("truncation")
        special = [t for t in plan.get("added_tokens", []) if t["special"]] if self.by_piece else []
        self.parting_id, self.parting = (special[0]["id"], special[0]["content"]) if special else (None, None)
        self.known = _Pieces()

    @staticmethod
    def at(path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A piece of plain letters is one pre-token, which the library's model takes as it is, in the alphabet
        that stands for bytes. Others go to the library by the thousand, parted by a special token: it cuts
        the text before anything else does, and its id, which no other text gives, tells where a piece ends."""
        cut, each, others = self.tokenizer.model.tokenize, [], []
        for p in pieces:
            if not _PLAIN.fullmatch(p):
                others.append(len(each))
                each.append(())
            elif p.isascii():
                each.append([t.id for t in cut("\u0120" + p[1:] if p[0] == " " else p)])
            else:
                each.append([t.id for t in cut(p.encode().decode("latin-1").translate(_BYTE))])
        for at in range(0, len(others), 20_000):
            part = others[at : at + 20_000]
            for i, ids in zip(part, self._parted([pieces[i] for i in part])):
                each[i] = ids
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _parted(self, pieces: list[str]) -> list[list[int]]:
        if self.parting and not any(self.parting in p for p in pieces):
            ids = self.tokenizer.encode_batch_fast([self.parting.join(pieces)], add_special_tokens=False)[0].ids
            ends = [-1, *(i for i, x in enumerate(ids) if x == self.parting_id), len(ids)]
            return [ids[i + 1 : j] for i, j in zip(ends, ends[1:])]
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.known.bytes > CACHE_BYTES:
            self.known = self.known.favourites()
        known = self.known
        at = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        if known.fresh:
            known.add(*self._learn(known.fresh))
            known.bytes += _size(known.fresh)
            known.fresh = []
        known.count(at)
        return known.gather(at)

    def encode(self, texts: list[str | None], end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """-> (ids of all texts in a row, ids of each text), each text ended with `end`."""
        ids, counts, begun = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        if not self.by_piece:
            for t in texts:
                ids.append(np.asarray(self.tokenizer.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end]), np.uint32))
            return np.concatenate(ids), np.array([len(x) for x in ids[1:]], np.int64)
        for pieces, ends in _runs(texts):
            got, lengths = self._ids(pieces)
            cuts = np.concatenate([[0], np.cumsum(lengths)])[ends].astype(np.int64)
            n = np.diff(cuts, prepend=-begun)
            begun = len(got) - int(cuts[-1]) if len(cuts) else begun + len(got)
            if end is not None:
                got, n = np.insert(got, cuts, end), n + 1
            ids.append(got)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)


def _schema(length: int, dtype: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(dtype, length)), pa.field("mask", pa.list_(pa.bool_(), length))])


class _ShardWriter:
    def __init__(self, fs: pafs.FileSystem, path: str, length: int, dtype: pa.DataType):
        self.length, self.dtype, self.schema = length, dtype, _schema(length, dtype)
        self.file = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.file, self.schema)
        self.rest, self.rows = np.zeros(0, np.uint32), 0

    def add(self, ids: np.ndarray, last: bool = False) -> None:
        ids = np.concatenate([self.rest, ids])
        step = self.length * BATCH
        whole = len(ids) if last else len(ids) // step * step
        for at in range(0, whole, step):
            self._batch(ids[at : min(at + step, whole)])
        self.rest = ids[whole:]

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        full = np.zeros(rows * self.length, self.dtype.to_pandas_dtype())
        full[: len(ids)] = ids
        mask = np.zeros(rows * self.length, bool)
        mask[: len(ids)] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))
        self.rows += rows

    def close(self) -> None:
        self.add(np.zeros(0, np.uint32), last=True)
        self.writer.close()
        self.file.close()


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "part long, ids_path string, docs_path string, n_docs long, n_tokens long, n_rows long"


def write_tokens(docs: DataFrame, root: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Encode docs in ascending id order into shards below `root`, a URI that all executors reach;
    returns the manifest, a row a shard.

    A null text is empty and gives the end id alone; null ids come last; rows that repeat an id are
    all written, in the order of their texts' hashes. Other columns are not read. An empty table
    gives an empty manifest and no file. Ids take 16 bits where the vocabulary allows it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = Encoder.at(tokenizer)
            if out is None:
                fs, base = pafs.FileSystem.from_uri(root)
                fs.create_dir(base, recursive=True)
                name = f"{base}/shard-{uuid.uuid4().hex}"
                dtype = pa.uint16() if encoder.vocabulary <= 1 << 16 and end < 1 << 16 else pa.uint32()
                out, index, part, total, n = _ShardWriter(fs, f"{name}.ids.arrow", length, dtype), [], batch["part"][0].as_py(), 0, 0
            ids, counts = encoder.encode(batch["text"].to_pylist(), end)
            starts = total + np.concatenate([[0], np.cumsum(counts)[:-1]])
            index.append(pa.record_batch([batch["doc_id"], pa.array(starts), pa.array(counts)], schema=_DOCS))
            out.add(ids)
            total, n = total + len(ids), n + len(counts)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{name}.docs.arrow") as f, pa.ipc.new_file(f, _DOCS) as w:
                for b in index:
                    w.write_batch(b)
            scheme = root[: root.index(":") + 1] + "//" if root.startswith("file:") else None
            full = (lambda p: f"{scheme}{p}") if scheme else (lambda p: f"{root.rstrip('/')}/{p.rsplit('/', 1)[1]}")
            yield pa.RecordBatch.from_pydict({"part": [part], "ids_path": [full(f"{name}.ids.arrow")], "docs_path": [full(f"{name}.docs.arrow")], "n_docs": [n], "n_tokens": [total], "n_rows": [out.rows]})

    return materialize(dealt.mapInArrow(shard, _MANIFEST), "token-manifest")


def open_shard(uri: str):
    """An IPC file reader; a local file is mapped, so batches are views of it."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(path))
    return pa.ipc.open_file(fs.open_input_file(path))


def sequence(uri: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Row `row` of a shard, by random access: (ids, a view of the file; mask)."""
    reader = open_shard(uri)
    batch = reader.get_batch(row // BATCH)
    ids = batch.column("ids")
    length, at = ids.type.list_size, row % BATCH
    values = ids.values.slice((ids.offset + at) * length, length).to_numpy(zero_copy_only=True)
    mask = batch.column("mask")
    return values, mask.values.slice((mask.offset + at) * length, length).to_numpy(zero_copy_only=False)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """The documents as the shards hold them: doc_id, start (ids of all documents before), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers), shard."""
    spark = manifest.sparkSession
    placed = manifest.withColumn("offset", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = materialize(placed, "token-shards")  # a row a shard
    dealt = placed.repartitionByRange(partitions(spark), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # a worker that wrote before needs its pieces no more
        for batch in batches:
            for s in batch.to_pylist():
                yield from _read_shard(s)

    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def _read_shard(s: dict) -> Iterator[pa.RecordBatch]:
    index = open_shard(s["docs_path"])
    reader = open_shard(s["ids_path"])
    batches = (reader.get_batch(i) for i in range(reader.num_record_batches))
    held = np.zeros(0, np.uint32)

    def take(n: int) -> Iterator[np.ndarray]:
        nonlocal held
        while n:
            if not len(held):
                b = next(batches)
                ids, mask = b.column("ids").flatten().to_numpy(), b.column("mask").flatten().to_numpy(zero_copy_only=False)
                held = ids[mask].astype("<u4")
            part, held = held[:n], held[n:]
            n -= len(part)
            yield part

    for i in range(index.num_record_batches):
        docs = index.get_batch(i)
        crcs = []
        for n in docs["n_tokens"].to_pylist():
            crc = 0
            for part in take(n):
                crc = zlib.crc32(part.tobytes(), crc)
            crcs.append(crc)
        starts = docs["start"].to_numpy() + s["offset"]
        yield pa.RecordBatch.from_pydict({"doc_id": docs["doc_id"], "start": pa.array(starts), "n_tokens": docs["n_tokens"], "ids_crc32": pa.array(crcs, pa.int64()), "shard": pa.array([s["part"]] * len(crcs), pa.int64())})


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs' tokens below the session's shared folder and read the files back."""
    return read_tokens(write_tokens(docs, scratch_path(docs.sparkSession, "tokens"), tokenizer))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
