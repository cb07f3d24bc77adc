"""Retrieval: exact kNN, BM25, rank fusion, expansion to parents, reranking.

Queries come as a table and are all answered in one job. Rank is a column, never an order of rows;
scores are rounded and ties go to the smaller id, so results don't depend on how rows are dealt.
A search keeps the best n of each query within each task, so what is shuffled is n rows a query and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SINGLE, TOKEN, tokens
from ..scratch import materialize, small_batches, spread

#: Channel width and parents kept; fusion and term-weight constants of the papers.
CHILDREN, PARENTS = 70, 10
FUSION = 60
K1, B = 1.2, 0.75
#: Queries, and words of queries, that one pass over the rows takes; more take more passes.
QUERY_BLOCK = 2000
WORD_BLOCK = 20_000
DIGITS = 6
#: Scores, and term counts, that are worked on at once in a task: rows are cut so that a table of them has no more.
CELLS = 1 << 22
#: Bytes up to which ranks are sent to all tasks.
BROADCAST = 64 << 20
_TOKEN, _SINGLE = regex.compile(TOKEN), regex.compile(f"([{SINGLE}])")


def analyze(text: str | None) -> list[str]:
    return _TOKEN.findall(_SINGLE.sub(r" \1 ", text or "").lower())


def ranked(hits: DataFrame, n: int, by: str = "score", query: str = "query_id", item: str = "id") -> DataFrame:
    """The best n items of each query, with `rank` from 1: higher score first, then the smaller id."""
    w = Window.partitionBy(query).orderBy(F.col(by).desc(), F.col(item))
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def _blocks(queries: DataFrame, order: str) -> Iterator[pd.DataFrame]:
    """The query table in bounded blocks, through an iterator on the driver."""
    held = []
    for r in queries.orderBy(order).toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            yield pd.DataFrame(held, columns=queries.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=queries.columns)


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the best n, by rounded score, then id. -inf marks what doesn't count."""
    order = np.lexsort((ids, -scores))[: n]
    return order[np.isfinite(scores[order])]


def _top(held: dict, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, n: int) -> None:
    """Merge a batch's scores (row, query) into the best n of each query held so far."""
    for j, q in enumerate(queries):
        column = scores[:, j]
        if len(column) > n:
            least = np.partition(column, len(column) - n)[len(column) - n]
            some = np.flatnonzero(column >= least)
        else:
            some = np.arange(len(column))
        i, s = ids[some], column[some]
        if q in held:
            i, s = np.concatenate([held[q][0], i]), np.concatenate([held[q][1], s])
        keep = _best(s, i, n)
        held[q] = i[keep], s[keep]


def _cuts(rows: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def _emit(held: dict) -> pd.DataFrame:
    rows = [(q, i, s) for q, (ids, scores) in held.items() for i, s in zip(ids, scores)]
    return pd.DataFrame(rows, columns=["query_id", "id", "score"])


def knn(vectors: DataFrame, queries: DataFrame, n: int = CHILDREN, where: Column | None = None) -> DataFrame:
    """vectors (id, embedding), queries (query_id, embedding) -> (query_id, id, score, rank).

    Exact cosine over all rows for which `where` holds; the filter comes before the ranking. A null or
    zero vector, or one of another length than the query's, is no hit.
    """
    small_batches(vectors.sparkSession)
    rows = spread((vectors.filter(where) if where is not None else vectors).select("id", "embedding"))
    out = None
    for block in _blocks(queries.select("query_id", "embedding").filter("embedding is not null"), "query_id"):
        asked = block["query_id"].to_numpy()
        sizes = {len(e) for e in block["embedding"]}
        tables = {d: (np.array([len(e) == d for e in block["embedding"]]), _units(np.array([e for e in block["embedding"] if len(e) == d], np.float64))) for d in sizes}

        def search(batches: Iterator[pd.DataFrame], asked=asked, tables=tables) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for b in batches:
                length = b["embedding"].map(lambda e: -1 if e is None else len(e)).to_numpy()
                for d, (mine, unit) in tables.items():
                    own = length == d
                    ids, vectors = b["id"].to_numpy()[own], b["embedding"][own]
                    for cut in _cuts(len(ids), max(d, len(unit))):
                        x = np.stack(vectors.iloc[cut].to_list()).astype(np.float64)
                        with np.errstate(invalid="ignore", divide="ignore"):
                            s = np.round(_units(x) @ unit.T, DIGITS) + 0.0
                        _top(held, asked[mine], ids[cut], np.where(np.isfinite(s), s, -np.inf), n)
            yield _emit(held)

        part = rows.mapInPandas(search, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.limit(0).join(queries.select("query_id").limit(0)).select("query_id", "id", F.lit(0.0).alias("score"))
    return ranked(out, n)


def _units(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def term_statistics(docs: DataFrame) -> DataFrame:
    """docs (id, text) -> (term, df, tf): documents and occurrences of each term, over all documents.

    A document's terms are sorted within its row, so one that differs from the term before it is a new one: both counts are
    combined in each task, and what is shuffled is a row a term and task.
    """
    held = spread(docs).select(F.array_sort(tokens(F.col("text"))).alias("w"))
    each = held.select(F.explode(F.arrays_zip("w", F.concat(F.array(F.lit(None).cast("string")), "w").alias("before"))).alias("t")).select(F.col("t.w").alias("term"), F.col("t.before").alias("before"))
    return each.filter("term is not null").groupBy("term").agg(F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("df"), F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, n: int = CHILDREN, where: Column | None = None) -> DataFrame:
    """docs (id, text, ...), queries (query_id, text) -> (query_id, id, score, rank).

    Distinct query terms, any of which suffices. Statistics come from all documents with a text; `where`
    filters afterwards which can be hits. Texts are cut into terms natively, once: for more than one block of queries, into a table
    that all blocks read. A block's own terms are looked up in each text and written as places and counts, so that its statistics and
    scores come of numbers, not words. Scores are summed inside a task: postings are never shuffled. A block's statistics come to the
    driver as a row a term, WORD_BLOCK or so, and what a task gets is a block's terms and, for each query, the places of its own. For
    many queries over one corpus, textindex.TextIndex reads the queries' own terms only.
    """
    small_batches(docs.sparkSession)
    rows = docs.withColumn("_hit", F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)).select("id", "text", "_hit").filter("text is not null")
    rows = spread(rows).select("id", "_hit", tokens(F.col("text")).alias("w"))
    kind = docs.schema["id"].dataType.simpleString()
    out, sizes = None, None
    blocks = _word_blocks(queries)
    block, after = next(blocks, None), next(blocks, None)
    if after:
        rows = materialize(rows, "bm25-terms")
    while block:
        terms = pd.Index(sorted({t for _, words in block for t in words}))
        asked = np.array([q for q, _ in block], dtype=object if isinstance(block[0][0], str) else None)
        first = np.cumsum([0, *(len(words) for _, words in block)])[:-1]
        places = terms.get_indexer([t for _, words in block for t in words])
        counted = materialize(rows.mapInArrow(_counts(terms), f"id {kind}, _hit boolean, size int, at array<int>, tf array<int>"), "bm25-counts")

        if sizes is None:
            sizes = counted.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
        held = counted.select(F.explode("at").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # a row a term
        df = np.zeros(len(terms))
        df[[r.term for r in held]] = [r.df for r in held]
        idf = np.log(1 + (sizes.n - df + 0.5) / (df + 0.5))
        mean = sizes["size"] / sizes.n if sizes["size"] else 1.0

        def score(batches: Iterator[pd.DataFrame], places=places, first=first, idf=idf, mean=mean, asked=asked) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for b in batches:
                b = b[b["_hit"] & (b["at"].map(len) > 0)]
                for cut in _cuts(len(b), len(places)):
                    part = b.iloc[cut]
                    row = np.repeat(np.arange(len(part)), part["at"].map(len))
                    at, tf = np.concatenate(part["at"].to_list()), np.concatenate(part["tf"].to_list())
                    impact = np.zeros((len(part), len(idf)))
                    impact[row, at] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * part["size"].to_numpy()[row] / mean)) * idf[at]
                    s = np.round(np.add.reduceat(impact[:, places], first, axis=1), DIGITS)
                    _top(held, asked, part["id"].to_numpy(), np.where(s > 0, s, -np.inf), n)
            yield _emit(held)

        part = counted.mapInPandas(score, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
        block, after = after, next(blocks, None)
    if out is None:
        out = rows.limit(0).join(queries.select("query_id").limit(0)).select("query_id", "id", F.lit(0.0).alias("score"))
    return ranked(out, n)


def _counts(terms: pd.Index) -> Callable:
    """A map of rows (id, _hit, w) to (id, _hit, size, at, tf): their words, and the places of the terms they hold with their counts."""
    known, many = pa.array(terms, pa.string()), len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("w")
            size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
            place = pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            own = place >= 0
            key, tf = np.unique(np.repeat(np.arange(len(size), dtype=np.int64), size)[own] * many + place[own], return_counts=True)
            ends = pa.array(np.cumsum([0, *np.bincount(key // many, minlength=len(size))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % many, tf)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("_hit"), pa.array(size), *lists], ["id", "_hit", "size", "at", "tf"])

    return count


def _word_blocks(queries: DataFrame) -> Iterator[list]:
    held, words = [], 0
    for r in queries.select("query_id", "text").orderBy("query_id").toLocalIterator():
        own = sorted(set(analyze(r["text"])))
        if held and (words + len(own) > WORD_BLOCK or len(held) == QUERY_BLOCK):
            yield held
            held, words = [], 0
        if own:
            held.append((r["query_id"], own))
        words += len(own)
    if held and words:
        yield held


def fuse(vector: DataFrame, text: DataFrame, n: int = CHILDREN, constant: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of two ranked channels -> (query_id, id, score, rank).

    A channel that lacks an item adds nothing for it.
    """
    a = vector.select("query_id", "id", F.col("rank").alias("a"))
    b = text.select("query_id", "id", F.col("rank").alias("b"))
    part = lambda c: F.coalesce(1.0 / (F.lit(constant) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", "id"], "full_outer").withColumn("score", F.round(part("a") + part("b"), 9))
    return ranked(both.select("query_id", "id", "score"), n)


def expand(hits: DataFrame, parents: DataFrame | None = None, p: int | None = None) -> DataFrame:
    """Ranked children -> their parents, once each, in the order of their best child: (query_id, parent_id,
    best_child, rank). parents (id, parent_id) gives the parent, unless hits have it."""
    rows = hits if parents is None else hits.join(parents.select("id", "parent_id"), "id")
    best = rows.filter("parent_id is not null").groupBy("query_id", "parent_id").agg(F.min("rank").alias("best_child"))
    w = Window.partitionBy("query_id").orderBy("best_child", "parent_id")
    out = best.withColumn("rank", F.row_number().over(w).cast("long"))
    return out if p is None else out.filter(F.col("rank") <= p)


def fetch(ranks: DataFrame, parents: DataFrame) -> DataFrame:
    """Ranked parent ids with the parents' columns (id, ...); ids without a row are dropped, order stays. The ranks are written
    first: while they are few, they are sent to the parents, whose texts then don't move."""
    ranks = materialize(ranks, "ranks")
    size = ranks.agg(F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in ("query_id", "parent_id")), F.lit(64)))).first()[0] or 0
    return (F.broadcast(ranks) if size <= BROADCAST else ranks).join(parents.withColumnRenamed("id", "parent_id"), "parent_id")


def overlap_scores(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """The offline reranker's score: distinct query terms that the parent text holds."""
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("_asked"))
    return candidates.join(asked, "query_id").withColumn("overlap", F.size(F.array_intersect("_asked", tokens(F.col("text")))).cast("long")).drop("_asked")


def rerank(candidates: DataFrame, queries: DataFrame, p: int = PARENTS, reranker=None) -> DataFrame:
    """Candidate parents (query_id, parent_id, rank, text) -> the best p, with a new rank.

    Whole parent texts are scored. Without a reranker the native overlap score decides, ties by the
    former rank. A reranker's places beyond the candidates are ignored.
    """
    if reranker is None:
        scored = overlap_scores(candidates, queries)
        w = Window.partitionBy("query_id").orderBy(F.col("overlap").desc(), F.col("rank"))
        return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= p)
    asked = candidates.join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    return rerank_function(reranker, p)(asked.asTable())


def rerank_function(reranker, p: int = PARENTS):
    """A table function over rows (query_id, rank, text, _query, ...): of each query's rows the reranker's best p, with a new
    rank and without _query. It asks for its rows by query, in order of rank; a query has as many as a channel's width.
    Its key has a second part, a hash, so that no join by query below can stand in for its own exchange: an adaptive plan may
    turn that join into a broadcast and leave a query's rows in several tasks.

    SQL calls it once it is registered (spark.udtf.register): SELECT * FROM name(TABLE(candidates)).
    """

    class Rerank:
        @staticmethod
        def analyze(rows):
            from pyspark.sql import types as T
            from pyspark.sql.udtf import AnalyzeResult, OrderingColumn, PartitioningColumn

            fields = [T.StructField(f.name, T.LongType()) if f.name == "rank" else f for f in rows.dataType.fields if f.name != "_query"]
            return AnalyzeResult(schema=T.StructType(fields), partitionBy=[PartitioningColumn("query_id"), PartitioningColumn("xxhash64(query_id)")], orderBy=[OrderingColumn("rank")])

        def __init__(self):
            self.rows = []

        def eval(self, row):
            self.rows.append(row)

        def terminate(self):
            if self.rows:
                places = [i for i in reranker.rerank(self.rows[0]["_query"], [r["text"] for r in self.rows], p) if 0 <= i < len(self.rows)][:p]
                for rank, i in enumerate(places, 1):
                    r = self.rows[i].asDict()
                    yield tuple(rank if c == "rank" else v for c, v in r.items() if c != "_query")

    return F.udtf(Rerank)


def token_filter(kind: str | None = None, content_types: Sequence[str] | None = None) -> Column:
    """The filter on kind and content type, both lower-cased on either side; what is not given does not filter."""
    out = F.lit(True)
    if kind is not None:
        out = out & (F.lower("kind") == kind.lower())
    if content_types is not None:
        out = out & F.lower("content_type").isin([c.lower() for c in content_types])
    return out


def query_vectors(queries: DataFrame, embedder) -> DataFrame:
    """queries (query_id, text) with `embedding`, each text embedded once, as a query, in batches on the executors."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            got = embedder.embed(texts.tolist(), "query")
            if len(got) != len(texts):
                raise ValueError(f"{len(texts)} queries gave {len(got)} vectors")
            yield pd.Series(list(got))

    return queries.withColumn("embedding", embed("text"))


#: The retrieval steps, in order.
STEPS = ("vector", "hybrid", "hybrid_rerank")


def retrieve(step: str, vectors: DataFrame, texts: DataFrame, queries: DataFrame, parents: DataFrame, n: int = CHILDREN, p: int = PARENTS, where: Column | None = None, reranker=None, embedder=None, held: dict | None = None) -> DataFrame:
    """One retrieval step for all queries (query_id, text, and embedding unless an embedder makes it) -> parents with
    their columns and rank. held: a dict for steps over the same inputs and settings; what a step searches is written and kept there, and others read it."""
    if step not in STEPS:
        raise ValueError(f"unknown retrieval step {step!r}")

    def once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if held is None:
            return make()
        if name not in held:
            held[name] = materialize(make(), f"hits-{name}")
        return held[name]

    if embedder is not None:
        asked = queries
        queries = once("queries", lambda: query_vectors(asked, embedder)) if held is not None else materialize(query_vectors(asked, embedder), "query-vectors")
    hits = once("vector", lambda: knn(vectors, queries, n, where))
    if step != "vector":
        found = hits
        hits = once("fused", lambda: fuse(found, bm25(texts, queries, n, where), n))
    ranks = expand(hits, vectors)
    if step == "hybrid_rerank":
        return rerank(fetch(ranks, parents), queries, p, reranker)
    return fetch(ranks.filter(F.col("rank") <= p), parents)
