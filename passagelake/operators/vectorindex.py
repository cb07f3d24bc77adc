"""Approximate kNN over inverted lists: k-means centroids, rows in folders by nearest centroid, probes by folder, exact scores.

Training takes a bounded sample by hash of the id (SAMPLE rows a list at most, in expectation); every row is indexed. Lloyd's steps run as
a map with a partial sum a task and list. How many lists a search must probe is measured on the sample: of ASKED of its vectors,
the nearest neighbours' lists are ranked by their centroids' nearness, and the share of lists that holds TARGET of the neighbours is kept. A search
probes that many lists of each query, or more until they hold max(10 n, 50) candidates, reads those lists' folders only and scores each row
exactly. A share measured on all says nothing of one query, so then each query is made sure of: from the angle between a list's
centroid and its farthest row follows a score that no row of the list exceeds, and the lists that may still hold one of a query's
first RECALL n hits are probed too. So every query has RECALL of its true hits at least. Vectors without structure need most lists;
clustered ones few.

Writes add segments, as in textindex: rows by list, and the dead rows of earlier segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, scratch_path, spread
from .search import CHILDREN, DIGITS, _blocks, _cuts, _emit, _top, _units, ranked
from .segments import Segments
from .textindex import BUCKETS, _few

SAMPLE, STEPS = 64, 8
#: Numbers in all centroids together at most: 32 MB.
CENTROIDS = 1 << 22
ASKED, TARGET = 200, 0.97
#: The share of each query's true hits that a search finds at least, in per cent.
RECALL = 90


def _shares(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` of the rows, in expectation, chosen by hash of their id."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return _units(np.array(vectors.to_list(), np.float64))


def _near(units: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, by cosine; ties to the smaller number."""
    return np.concatenate([(units[cut] @ centers.T).argmax(1) for cut in _cuts(len(units), len(centers))] or [np.zeros(0, np.int64)])


class VectorIndex(Segments):
    """Tables of a segment: lists (list, id, embedding), places (bucket, id, list), dead (of, list, id), reach (list, least: the
    least cosine between the list's centroid and a row). Vectors that are null,
    zero, not finite or of another length than the centroids' are not indexed, as no search can hit them."""

    TABLES = {"lists": "id {id}, embedding array<double>, list int", "places": "id {id}, place int, bucket int", "dead": "of long, list int, id {id}", "reach": "list int, least double"}

    def train(self, vectors: DataFrame, lists: int | None = None, n: int = CHILDREN) -> None:
        """Fit centroids and the share of lists to probe for n neighbours, and write them. lists: by default the root of the number of rows."""
        rows = self._sound(vectors)
        total = rows.count()
        size = len(rows.first()["embedding"]) if total else 1
        k = max(1, min(lists or round(total**0.5), CENTROIDS // size, max(total, 1)))
        sample = materialize(_shares(rows.filter(F.size("embedding") == size), SAMPLE * k), "ivf-sample")
        start = sample.orderBy(F.xxhash64("id", F.lit("start"))).limit(k).toPandas() if total else pd.DataFrame({"embedding": []})  # k rows
        centers = _matrix(start["embedding"]) if len(start) else np.zeros((1, size))
        for _ in range(STEPS):
            centers = self._step(sample, centers)
        probes = self._measured(sample, centers, max(1, round(n * min(1.0, sample.count() / max(1, total)))))
        spark = self.spark
        out = [(i, c.tolist(), probes) for i, c in enumerate(centers)]
        spark.createDataFrame(out, "list int, center array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")

    @staticmethod
    def _sound(vectors: DataFrame) -> DataFrame:
        e = F.transform("embedding", lambda x: x.cast("double"))
        rows = vectors.filter("id is not null and embedding is not null").select("id", e.alias("embedding"))
        fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
        return rows.filter(fine)

    @staticmethod
    def _step(sample: DataFrame, centers: np.ndarray) -> np.ndarray:
        """One of Lloyd's steps: the sums of each list's vectors, scaled to length one; a list without any stays."""

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, many = np.zeros_like(centers), np.zeros(len(centers), np.int64)
            for b in batches:
                units = _matrix(b["embedding"])
                near = _near(units, centers)
                np.add.at(total, near, units)
                many += np.bincount(near, minlength=len(centers))
            some = np.flatnonzero(many)
            yield pd.DataFrame({"list": some, "total": pd.Series(list(total[some]), dtype=object)})

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"list": rows["list"].iloc[:1], "total": [np.sum(rows["total"].to_list(), axis=0)]})

        sums = sample.select("embedding").mapInPandas(add, "list int, total array<double>").groupBy("list").applyInPandas(merge, "list int, total array<double>")
        out = centers.copy()
        for r in sums.toLocalIterator():  # a row a list
            length = np.linalg.norm(r.total)
            if length > 0:
                out[r.list] = np.array(r.total) / length
        return out

    @staticmethod
    def _measured(sample: DataFrame, centers: np.ndarray, n: int) -> int:
        """How many lists, nearest first, hold TARGET of the n neighbours of ASKED of the sample's vectors."""
        asked = sample.orderBy(F.xxhash64("id", F.lit("asked"))).limit(ASKED).toPandas()
        if not len(asked):
            return 1
        units, names = _matrix(asked["embedding"]), np.arange(len(asked))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for b in batches:
                own = _matrix(b["embedding"])
                _top(held, names, _near(own, centers) * len(b) + np.arange(len(b)), np.round(own @ units.T, DIGITS), n)  # a place tells rows of a list apart
                held = {q: (i // len(b), s) for q, (i, s) in held.items()} if len(b) else held
            yield _emit(held)

        hits = ranked(sample.mapInPandas(search, "query_id long, id long, score double"), n).select("query_id", "id").toPandas()
        nearest = np.argsort(np.argsort(-(units @ centers.T), axis=1, kind="stable"), axis=1)  # each list's place for each vector
        places = np.sort(nearest[hits["query_id"].to_numpy(), hits["id"].to_numpy()])
        return int(places[min(len(places) - 1, int(TARGET * len(places)))]) + 1 if len(places) else 1

    def centroids(self) -> tuple[np.ndarray, int]:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        return np.array([r.center for r in rows], np.float64), rows[0].probes

    def write(self, vectors: DataFrame, touched: DataFrame | None = None) -> None:
        """Add vectors (id, embedding) in place of what the index holds for their ids, and take away what it holds for touched (id).
        Of repeated ids one row counts, that with the least vector."""
        centers, _ = self.centroids()
        live, number = self.live(), self.next_segment()
        width = centers.shape[1]
        kept = self._sound(vectors).filter(F.size("embedding") == width).groupBy("id").agg(F.min("embedding").alias("embedding"))
        kind = kept.schema["id"].dataType.simpleString()

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"list": _near(_matrix(b["embedding"]), centers), "id": b["id"], "embedding": b["embedding"]})

        rows = materialize(spread(kept).mapInPandas(assign, f"list int, id {kind}, embedding array<double>"), "ivf-rows")
        gone = vectors.select("id") if touched is None else vectors.select("id").union(touched.select("id"))
        dead = materialize(self._dead(gone.filter("id is not null").distinct(), [r.segment for r in live]), "ivf-dead") if live else None
        self._put(rows, number)
        self.put(dead if dead is not None else rows.select(F.lit(0).cast("long").alias("of"), "list", "id").limit(0), number, "dead")
        n = rows.count()
        self.commit([tuple(r) for r in live] + [(number, n, n - (dead.count() if dead is not None else 0), 0)])
        due = self.smallest()
        if due:
            self.merge(due)

    def _put(self, rows: DataFrame, number: int) -> None:
        centers, _ = self.centroids()

        @F.pandas_udf("double")
        def cosine(lists: pd.Series, vectors: pd.Series) -> pd.Series:
            return pd.Series((_matrix(vectors) * centers[lists.to_numpy()]).sum(1) if len(lists) else [], dtype=float)

        self.put(rows.groupBy("list").agg(F.min(cosine("list", "embedding")).alias("least")).coalesce(1), number, "reach")
        self.put(rows.hint("rebalance", "list").sortWithinPartitions("list", "id"), number, "lists", "list")
        places = rows.select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"), "id", F.col("list").alias("place"))
        self.put(places.repartition("bucket").sortWithinPartitions("bucket", "id"), number, "places", "bucket")

    def _dead(self, ids: DataFrame, segments: list[int]) -> DataFrame:
        ids = ids.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
        buckets = [r.bucket for r in ids.select("bucket").distinct().collect()]  # BUCKETS at most
        held = self.read("places", F.col("bucket").isin(buckets), segments).select(F.col("segment").alias("of"), F.col("place").alias("list"), "id")
        return held.join(_few(ids.select("id")), "id", "left_semi").join(self.read("dead", segments=segments).select("of", "list", "id"), ["of", "list", "id"], "left_anti").select("of", "list", "id")

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """(list, id, embedding) of the live rows of these lists: only their folders are read."""
        held = self.read("lists", F.col("list").isin(lists) if lists is not None else None).withColumnRenamed("segment", "of")
        dead = self.read("dead").select("of", "list", "id")
        return held.join(dead, ["of", "list", "id"], "left_anti").select("list", "id", "embedding")

    def merge(self, segments: list[int]) -> None:
        """One segment in place of these, without the rows that are dead in them."""
        live, number = self.live(), self.next_segment()
        own = F.col("of").isin(segments)
        dead = self.read("dead").select("of", "list", "id")
        held = self.read("lists", segments=segments).withColumnRenamed("segment", "of").join(dead.filter(own), ["of", "list", "id"], "left_anti")
        rows = materialize(held.select("list", "id", "embedding"), "ivf-merged")
        self._put(rows, number)
        self.put(self.read("dead", segments=segments).select("of", "list", "id").filter(~own), number, "dead")
        self.commit([tuple(r) for r in live if r.segment not in segments] + [(number, rows.count(), sum(r.n for r in live if r.segment in segments), 0)])

    def search(self, queries: DataFrame, n: int = CHILDREN, allowed: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """queries (query_id, embedding) -> (query_id, id, score, rank), scores and ties as in search.knn.

        allowed (id): the rows that can be hits; they are what the candidates of a query are counted by. probes: lists to probe of each query,
        or more until there are candidates; then no query is made sure of.
        A block of queries is answered and written before the next is read.
        """
        centers, least = self.centroids()
        kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id "
        if not self.live():
            return ranked(self.spark.createDataFrame([], f"{kind}long, score double"), n)
        rows = self.rows() if allowed is None else self.rows().join(allowed.select("id").distinct(), "id", "left_semi")
        held = rows.groupBy("list").count().collect()  # a row a list
        sizes = np.zeros(len(centers), np.int64)
        sizes[[r.list for r in held]] = [r["count"] for r in held]
        schema = f"{kind}{rows.schema['id'].dataType.simpleString()}, score double"
        asked, path = self._asked(queries, centers.shape[1]), scratch_path(self.spark, "ivf-hits")
        self.spark.createDataFrame([], schema).write.parquet(path)
        few = lambda units: self._chosen(units, centers, sizes, max(10 * n, 50), probes or least)
        self._probe(asked, lambda block, units: few(units), allowed, n, path, schema)
        if probes is None:
            sure = -(-RECALL * n // 100)
            floor = ranked(self.spark.read.schema(schema).parquet(path), sure).filter(F.col("rank") == sure).select("query_id", F.col("score").alias("floor"))
            asked = materialize(asked.join(floor, "query_id", "left"), "ivf-floors")
            angles = np.arccos(np.clip(self._reach(len(centers)), -1, 1))

            def rest(block: pd.DataFrame, units: np.ndarray) -> np.ndarray:
                """The other lists whose best possible score comes to the last hit that a query must be sure of."""
                best = np.cos(np.maximum(np.arccos(np.clip(units @ centers.T, -1, 1)) - angles, 0))
                reached = best + 2 * 10.0**-DIGITS >= block["floor"].astype(float).fillna(-2.0).to_numpy()[:, None]
                return reached & (sizes > 0) & ~few(units)

            self._probe(asked, rest, allowed, n, path, schema)
        return ranked(self.spark.read.schema(schema).parquet(path), n)

    def _reach(self, lists: int) -> np.ndarray:
        """Each list's least cosine, over all live segments; rows that have died since may only make it less."""
        out = np.ones(lists)
        for r in self.read("reach").groupBy("list").agg(F.min("least").alias("least")).collect():  # a row a list
            out[r.list] = r.least
        return out

    def _probe(self, queries: DataFrame, choose, allowed: DataFrame | None, n: int, path: str, schema: str) -> None:
        """Append to the path the best n rows of each query (query_id, embedding, ...) among the lists that choose(block, units) names."""
        for block in _blocks(queries, "query_id"):
            asked, units = block["query_id"].to_numpy(), _matrix(block["embedding"])
            chosen = choose(block, units)
            lists = np.flatnonzero(chosen.any(0)).tolist()
            if not lists:
                continue
            there = self.rows(lists) if allowed is None else self.rows(lists).join(allowed.select("id").distinct(), "id", "left_semi")

            def search(batches: Iterator[pd.DataFrame], asked=asked, units=units, chosen=chosen) -> Iterator[pd.DataFrame]:
                held: dict = {}
                for b in batches:
                    for name, own in b.groupby("list"):
                        mine = np.flatnonzero(chosen[:, name])
                        for cut in _cuts(len(own), max(len(mine), units.shape[1])):
                            part = own.iloc[cut]
                            s = np.round(_matrix(part["embedding"]) @ units[mine].T, DIGITS) + 0.0
                            _top(held, asked[mine], part["id"].to_numpy(), s, n)
                yield _emit(held)

            there.mapInPandas(search, schema).write.mode("append").parquet(path)

    def _asked(self, queries: DataFrame, width: int) -> DataFrame:
        sound = self._sound(queries.select(F.col("query_id").alias("id"), "embedding"))
        return sound.filter(F.size("embedding") == width).select(F.col("id").alias("query_id"), "embedding")

    @staticmethod
    def _chosen(units: np.ndarray, centers: np.ndarray, sizes: np.ndarray, candidates: int, least: int) -> np.ndarray:
        """Which lists each query probes: the nearest, `least` or more, until they hold so many candidates."""
        order = np.argsort(-(units @ centers.T), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        take = (before < candidates) | (np.arange(order.shape[1])[None] < least)
        out = np.zeros_like(take)
        np.put_along_axis(out, order, take, axis=1)
        return out
