"""WARC archives with a two-level capture index.

Archives hold a gzip member for each record, so a byte range is a record. The index sorts captures by
reversed-host URL key; each index part is a file of compressed blocks of lines, and its sparse directory
has a block's first key and byte range. A look-up binary-searches the parts' first keys, then one
part's directory, reads a block by its range, binary-searches its lines and reads records by theirs.
Keys are dealt by range over (key, page id), so one host, however large, fills many parts.

Of records with the same payload of at least REVISIT bytes, the one with the smallest page id is a
response and the others revisit it (identical-payload-digest); smaller ones are responses all.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, partitions, scratch_path, small_batches, table

REVISIT = 100
BLOCK_LINES = 200
LEVEL = 3
#: Records of a file with no more bytes between them are read at once, up to so many bytes.
GAP, READ = 64 << 10, 8 << 20
#: The pages have no capture time; records carry this one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:page:(-?\d+|none):[0-9a-f]{20}>")


def url_key(url: str | None) -> str:
    """Reversed-host key: host labels in reverse, comma-joined, then `)`, path and query; no fragment, no
    scheme, no default port. What cannot be split as a URL is its own key."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return text
    if not host:
        return text
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _page_urn(page_id: int | None, digest: str) -> str:
    """A record's name: only rows equal in id and payload share one. A revisit's response has the revisit's digest."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest[:20]}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit has the response's HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_page_urn(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_page_urn(refers_to, digest)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers (lower-case names) with `payload` and `http`, the HTTP headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    out["http"], _, out["payload"] = block.partition(b"\r\n\r\n")
    return out


def _full(root: str, base: str, path: str) -> str:
    """A file's URI, given that root is base's."""
    return root.rstrip("/") + path[len(base) :]


def with_types(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """pages -> (page_id, url, html, digest, refers_to). Null html is an empty payload.

    Only digests that repeat are joined; a payload that very many pages share makes one large key,
    whose rows the skew join splits. Of rows that repeat the smallest id, all are responses. Rows
    without an id revisit an identified row if there is one, else they are responses.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2("html", 256))
    many = own.filter(F.octet_length("html") >= REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    many = materialize(many, "warc-repeats")
    joined = own.join(many, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


_CAPTURES = "key string, page_id long, file string, offset long, length long, type string"


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of pages into archives below root, a URI that all executors reach.

    Returns the captures (key, page_id, file, offset, length, type), a row a record. They name only
    files that Spark has committed, so archives of lost or repeated tasks are never read. Other columns
    are not read. An empty table gives no archive and no capture.
    """
    small_batches(pages.sparkSession)
    typed = with_types(pages, id_col, url_col, html_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, base = pafs.FileSystem.from_uri(root)
                fs.create_dir(base, recursive=True)
                path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                out, at = fs.open_output_stream(path, compression=None), 0
            rows = []
            for r in b.to_pylist():
                payload = r["html"].encode("utf-8", "surrogatepass")
                gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = gz.compress(record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"])) + gz.flush()
                out.write(raw)
                rows.append((url_key(r["url"]), r["page_id"], _full(root, base, path), at, len(raw), "response" if r["refers_to"] is None else "revisit"))
                at += len(raw)
            key, page, file, offset, length, kind = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(page, pa.int64()), pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(kind, pa.string())], names=["key", "page_id", "file", "offset", "length", "type"])
        if out is not None:
            out.close()

    return materialize(typed.mapInArrow(write, _CAPTURES), "warc-captures")


_DIRECTORY = pa.schema([("first", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])
_PARTS = "part long, first string, blocks_path string, directory_path string, n_blocks long, n_lines long"


def build_index(captures: DataFrame, root: str) -> DataFrame:
    """Write the index of captures below root; returns its parts, a row a part, in key order."""
    order = [F.col("key"), F.col("page_id"), F.col("file"), F.col("offset")]
    dealt = captures.repartitionByRange(partitions(captures.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, directory = None, [], []

        def block() -> None:
            nonlocal at
            raw = zlib.compress("\n".join(line for _, line in held).encode(), 6)
            out.write(raw)
            directory.append((held[0][0], at, len(raw), len(held)))
            at += len(raw)
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, base = pafs.FileSystem.from_uri(root)
                fs.create_dir(base, recursive=True)
                name, at, part = f"{base}/{uuid.uuid4().hex}", 0, b["part"][0].as_py()
                out = fs.open_output_stream(f"{name}.blocks")
            for r in b.to_pylist():
                held.append((r["key"], json.dumps([r["key"], r["page_id"], r["file"], r["offset"], r["length"], r["type"]])))
                if len(held) == BLOCK_LINES:
                    block()
        if out is not None:
            if held:
                block()
            out.close()
            with fs.open_output_stream(f"{name}.directory.arrow") as f, pa.ipc.new_file(f, _DIRECTORY) as w:
                w.write_batch(pa.record_batch([list(x) for x in zip(*directory)], schema=_DIRECTORY))
            yield pa.RecordBatch.from_pydict({"part": [part], "first": [directory[0][0]], "blocks_path": [_full(root, base, f"{name}.blocks")], "directory_path": [_full(root, base, f"{name}.directory.arrow")], "n_blocks": [len(directory)], "n_lines": [sum(d[3] for d in directory)]})

    return materialize(dealt.mapInArrow(write, _PARTS), "warc-index")


class Ranges:
    """Byte ranges of files, with the last few files kept open."""

    def __init__(self, most: int = 64):
        self.files, self.most = {}, most

    def read(self, uri: str, offset: int, length: int) -> bytes:
        f = self.files.get(uri)
        if f is None:
            if len(self.files) >= self.most:
                self.files.pop(next(iter(self.files))).close()
            fs, path = pafs.FileSystem.from_uri(uri)
            f = self.files[uri] = fs.open_input_file(path)
        return f.read_at(length, offset)

    def lines(self, uri: str, offset: int, length: int) -> list[list]:
        return [json.loads(x) for x in zlib.decompress(self.read(uri, offset, length)).decode().split("\n")]

    def record(self, file: str, offset: int, length: int) -> dict:
        return parse(zlib.decompress(self.read(file, offset, length), 31))

    def records(self, captures: list[list]) -> Iterator[tuple[list, dict]]:
        """Captures with their records, by file and place; what lies close together is read at once."""
        held: list[list] = []
        for c in [*sorted(captures, key=lambda x: (x[2], x[3])), None]:
            near = held and c and c[2] == held[0][2] and c[3] - (held[-1][3] + held[-1][4]) <= GAP and c[3] + c[4] - held[0][3] <= READ
            if held and not near:
                start = held[0][3]
                raw = self.read(held[0][2], start, held[-1][3] + held[-1][4] - start)
                for x in held:
                    yield x, parse(zlib.decompress(raw[x[3] - start : x[3] - start + x[4]], 31))
                held = []
            if c:
                held.append(c)


class CaptureIndex:
    """Look-ups by URL. parts: the rows of build_index, few, in order; directories are read when first needed."""

    def __init__(self, parts: list):
        self.parts = sorted(parts, key=lambda p: p["part"])
        self.firsts = [p["first"] for p in self.parts]
        self.directories: dict[int, tuple[list, list]] = {}
        self.ranges = Ranges()

    def _directory(self, i: int) -> tuple[list, list]:
        if i not in self.directories:
            fs, path = pafs.FileSystem.from_uri(self.parts[i]["directory_path"])
            with fs.open_input_file(path) as f:
                rows = pa.ipc.open_file(f).read_all().to_pylist()
            self.directories[i] = [r["first"] for r in rows], rows
        return self.directories[i]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(path, offset, length) of the blocks that can hold a key, by two binary searches."""
        i = max(0, bisect_left(self.firsts, key) - 1)
        while i < len(self.parts) and (self.firsts[i] <= key):
            firsts, rows = self._directory(i)
            j = max(0, bisect_left(firsts, key) - 1)
            while j < len(rows) and firsts[j] <= key:
                yield self.parts[i]["blocks_path"], rows[j]["offset"], rows[j]["length"]
                j += 1
            i += 1

    def captures(self, url: str) -> list[list]:
        """The captures of a URL, [key, page_id, file, offset, length, type] each, by page id."""
        key = url_key(url)
        return [x for block in self.blocks(key) for x in with_key(self.ranges.lines(*block), key)]

    def records(self, url: str) -> list[dict]:
        return [self.ranges.record(*c[2:5]) for c in self.captures(url)]


def with_key(lines: list[list], key: str) -> list[list]:
    """The lines of a block that have a key, by binary search."""
    first = lambda x: x[0]
    return lines[bisect_left(lines, key, key=first) : bisect_right(lines, key, key=first)]


@F.pandas_udf(T.StringType())
def _url_key(urls: pd.Series) -> pd.Series:
    return pd.Series([url_key(u if isinstance(u, str) else None) for u in urls], dtype=object)


def looked_up(urls: DataFrame, parts: DataFrame, url_col: str = "url") -> DataFrame:
    """The records of all captures of the URLs, each capture once, whatever URLs repeat: (page_id, key, type, refers_to,
    payload_bytes, payload_digest). A null URL has the empty key; a URL without a capture gives no row.

    Keys are dealt by range, so a task's look-ups share directories and neighbouring blocks. A block found is a
    row, dealt anew, so the captures of one URL, however many, are read by many tasks. The index's parts, a row for
    each shuffle partition at most, go to every task; directories are read where they are needed.
    """
    n = partitions(parts.sparkSession)
    known = [r.asDict() for r in parts.collect()]
    keys = urls.select(_url_key(F.col(url_col).cast("string")).alias("key")).distinct()
    dealt = keys.repartitionByRange(n, "key").sortWithinPartitions("key")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CaptureIndex(known)
        for b in batches:
            out: list[tuple] = []
            for key in b["key"]:
                for block in index.blocks(key):
                    if out and out[-1][:3] == block:
                        out[-1][3].append(key)
                    else:
                        out.append((*block, [key]))
            yield pd.DataFrame(out, columns=["path", "offset", "length", "keys"])

    blocks = dealt.mapInPandas(find, "path string, offset long, length long, keys array<string>")
    return _records(blocks.repartition(n, "path", "offset"))


def read_archives(parts: DataFrame) -> DataFrame:
    """All records, read back through the whole index, with the columns of looked_up()."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b.to_dict("records"):
                fs, path = pafs.FileSystem.from_uri(p["directory_path"])
                with fs.open_input_file(path) as f:
                    d = pa.ipc.open_file(f).read_all().to_pandas()
                d["path"], d["keys"] = p["blocks_path"], None
                yield d[["path", "offset", "length", "keys"]]

    n = partitions(parts.sparkSession)
    blocks = parts.repartitionByRange(n, "part").mapInPandas(entries, "path string, offset long, length long, keys array<string>")
    return _records(blocks)


def _records(blocks: DataFrame) -> DataFrame:
    """blocks (path, offset, length, keys; null keys: all) -> the records of their captures.

    A response's figures come from its payload; a revisit's from the payload of the response it refers to.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = Ranges()
        for b in batches:
            for path, offset, length, keys in zip(b["path"], b["offset"], b["length"], b["keys"]):
                lines = ranges.lines(path, offset, length)
                wanted = lines if keys is None else [x for k in keys for x in with_key(lines, k)]
                out = []
                for capture, r in ranges.records(wanted):
                    page = _ID.fullmatch(r["warc-record-id"])[1]
                    refers = _ID.fullmatch(r["warc-refers-to"])[1] if r["warc-type"] == "revisit" else None
                    own = refers is None
                    out.append((None if page == "none" else int(page), capture[0], r["warc-type"], None if own else int(refers), len(r["payload"]) if own else None, hashlib.sha256(r["payload"]).hexdigest() if own else r["warc-payload-digest"].removeprefix("sha256:")))
                frame = pd.DataFrame(out, columns=["page_id", "key", "type", "refers_to", "bytes", "digest"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64", "bytes": "Int64"})

    back = materialize(blocks.mapInPandas(read, "page_id long, key string, type string, refers_to long, bytes long, digest string"), "warc-back")
    base = back.filter("type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("to"), F.col("digest").alias("same")).agg(F.max("bytes").alias("to_bytes"))
    base = materialize(base, "warc-responses")
    responses = back.filter("type = 'response'").select("page_id", "key", "type", "refers_to", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    revisits = back.filter("type = 'revisit'").join(base, (F.col("refers_to") == F.col("to")) & (F.col("digest") == F.col("same")), "left").select("page_id", "key", "type", "refers_to", F.col("to_bytes").alias("payload_bytes"), F.col("same").alias("payload_digest"))
    return responses.unionByName(revisits)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    captures = write_archives(pages, root)
    parts = build_index(captures, f"{root}/index")
    discard(captures)
    return looked_up(pages, parts).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


SQL = f"""
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
         min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT} AND page_id <> first THEN first END AS refers_to
FROM q
"""
