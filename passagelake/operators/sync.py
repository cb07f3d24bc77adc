"""Incremental maintenance of the chunk index: plan by content hash, embed what changed, write a new version.

An index is a folder of versions: a base, which is whole, and deltas, which hold the documents written and the
ids touched since. A version counts once its last table is complete, so a failed embedding or a lost driver
leaves the index as it was. A sync writes what changed; after DELTAS deltas a new base is written.

Documents and touched ids lie in folders by the id's hash, sorted by id, with Bloom filters on the id. A look-up names the folders, and the
ids if they are few, in each scan's filter, so of every version only the asked ids' folders and row groups are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize

#: Texts of one embedding request at most.
REQUEST = 128
#: Deltas after which an index is written whole again.
DELTAS = 8
#: Folders of ids in each version, and ids up to which a look-up names them one by one.
BUCKETS, NAMED = 32, 1000
#: Columns that only children have.
CHILD_ONLY = ("parent_id", "embedding_text", "embedding")


def plan_sync(records: DataFrame, indexed: DataFrame) -> DataFrame:
    """records (id, content_hash, pos), indexed (id, content_hash) -> (id, action, pos).

    insert: an id that the index lacks; update: another hash; delete: an indexed id that no record has.
    pos orders inserts and updates; deletes, which have none, go by id.
    """
    new = records.select("id", F.col("content_hash").alias("fresh"), "pos", F.lit(True).alias("is_new"))
    old = indexed.select("id", F.col("content_hash").alias("held"), F.lit(True).alias("is_old"))
    both = new.join(old, "id", "full_outer")
    action = F.when(F.col("is_old").isNull(), "insert").when(F.col("is_new").isNull(), "delete").when(~F.col("fresh").eqNullSafe(F.col("held")), "update")
    return both.withColumn("action", action).filter("action is not null").select("id", "action", "pos")


def embedded(records: DataFrame, embedder, text_col: str = "embedding_text", kind: str = "document") -> DataFrame:
    """records with `embedding`, by requests of at most REQUEST texts; a wrong number of vectors is an error.
    Filter first: every row given is embedded."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = []
            for at in range(0, len(texts), REQUEST):
                part = texts.iloc[at : at + REQUEST].tolist()
                got = embedder.embed(part, kind)
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(got)} vectors")
                out += got
            yield pd.Series(out)

    return records.withColumn("embedding", embed(F.col(text_col)))


def to_documents(records: DataFrame) -> DataFrame:
    """Records (with embedding) as index documents. A child without parent, text or vector is an error; a parent has
    none of the three."""
    child = F.col("kind") == "child"
    out = records
    for c in CHILD_ONLY:
        value = F.col(c)
        if c != "embedding" or "embedding" in records.columns:
            guarded = F.when(child & value.isNull(), F.raise_error(F.concat(F.lit(f"child without {c}: "), F.col("id"))).cast(records.schema[c].dataType)).when(child, value)
            out = out.withColumn(c, guarded)
    return out


class Index:
    """A versioned table of index documents at a path, with a registry of search definitions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._file("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, bool]]:
        """(number, whether it is a base) of the complete versions, in order."""
        fs, out = self._fs(), []
        if fs.exists(self._file("versions")):
            for s in fs.listStatus(self._file("versions")):
                n = s.getPath().getName()
                base = fs.exists(self._file(f"versions/{n}/base/_SUCCESS"))
                if base or fs.exists(self._file(f"versions/{n}/touched/_SUCCESS")):
                    out.append((int(n), base))
        return sorted(out)

    def version(self) -> int:
        return max([v for v, _ in self._versions()], default=0)

    @staticmethod
    def _bucket() -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")

    def _put(self, rows: DataFrame, path: str) -> None:
        """rows in folders by the id's hash; a table without rows keeps its columns in one file."""
        rows = rows.withColumn("_b", self._bucket())
        out = rows.repartition("_b").sortWithinPartitions("_b", "id").write.mode("overwrite").option("parquet.bloom.filter.enabled#id", "true")
        (out if rows.isEmpty() else out.partitionBy("_b")).parquet(path)

    def read(self, where: Column | None = None) -> DataFrame | None:
        """The documents: of each id those of the last version that touched it. where is over id and `_b` and goes to each scan."""
        known = self._versions()
        if not known:
            return None
        whole = max([v for v, base in known if base], default=0)
        deltas = [v for v, _ in known if v > whole]

        def at(v: int, t: str) -> DataFrame:
            rows = self.spark.read.parquet(f"{self.path}/versions/{v:08d}/{t}")
            return (rows if where is None else rows.filter(where)).drop("_b")

        parts = ([at(whole, "base").withColumn("_v", F.lit(0))] if whole else []) + [at(v, "documents").withColumn("_v", F.lit(v)) for v in deltas]
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        if not deltas:
            return rows.drop("_v")
        touched = reduce(lambda a, b: a.unionByName(b), [at(v, "touched").withColumn("_t", F.lit(v)) for v in deltas])
        last = touched.groupBy("id").agg(F.max("_t").alias("_t"))
        return rows.join(last, "id", "left").filter("_t is null or _t = _v").select([c for c in parts[0].columns if c != "_v"])

    def hashes(self) -> DataFrame:
        """{id: content_hash}, two columns of the table; empty where there is no version."""
        held = self.read()
        return held.select("id", "content_hash") if held is not None else self.spark.createDataFrame([], "id string, content_hash string")

    def lookup(self, ids: DataFrame, columns: list[str]) -> DataFrame:
        """Point look-ups by a table of ids (repeated and absent ids are no matter): only their folders are read, and with
        NAMED ids or fewer only row groups that may hold one."""
        wanted = ids.select("id").filter("id is not null").distinct()
        few = wanted.limit(NAMED + 1).collect()
        if len(few) <= NAMED:
            named = [r.id for r in few]
            buckets = self.spark.createDataFrame(few, wanted.schema).select(self._bucket().alias("b")).distinct().collect() if few else []
            return self.read(F.col("_b").isin([r.b for r in buckets]) & F.col("id").isin(named)).select("id", *columns)
        buckets = wanted.select(self._bucket().alias("b")).distinct().collect()  # BUCKETS at most
        return self.read(F.col("_b").isin([r.b for r in buckets])).join(wanted, "id", "left_semi").select("id", *columns)

    def write(self, documents: DataFrame, touched: DataFrame) -> None:
        """Add a delta: documents, and the ids (id) that they replace or that are gone. The first version, and the one
        after DELTAS deltas, is a base; versions that no reader of the last base needs are deleted. What a write that
        failed has left of its version is replaced."""
        known = self._versions()
        bases = [v for v, base in known if base]
        folder = f"{self.path}/versions/{self.version() + 1:08d}"
        if not known:
            self._put(documents, f"{folder}/base")
            return
        self._put(documents, f"{folder}/documents")
        self._put(touched.select("id").distinct(), f"{folder}/touched")
        if len([v for v, _ in known if v > max(bases, default=0)]) + 1 >= DELTAS:
            self._put(self.read(), f"{self.path}/versions/{self.version() + 1:08d}/base")
            for v, _ in known:
                if v < max(bases, default=0):
                    self._fs().delete(self._file(f"versions/{v:08d}"), True)

    def definitions(self) -> dict[str, dict]:
        fs = self._fs()
        if not fs.exists(self._file("definitions")):
            return {}
        rows = self.spark.read.text(f"{self.path}/definitions", wholetext=True).collect()
        return {d["name"]: d for d in (json.loads(r.value) for r in rows)}

    def ensure(self, name: str, kind: str, definition: dict | None) -> bool:
        """Register a search definition: True if it was new; nothing if it agrees; an error if it doesn't."""
        if definition is None:
            raise ValueError(f"index {name} has no definition")
        held = self.definitions().get(name)
        if held is not None:
            if canonical(held["kind"], held["definition"]) != canonical(kind, definition):
                raise ValueError(f"index {name} exists with another definition")
            return False
        line = json.dumps({"name": name, "kind": kind, "definition": definition})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/definitions")
        return True


def canonical(kind: str, definition: dict) -> str:
    """A definition's comparable form: order of fields and keys doesn't matter, and of a vector index only
    type, path, dimensions and similarity count; of a text index analyzers and mappings."""
    if kind == "vector":
        fields = [{k: f.get(k) for k in ("type", "path", "numDimensions", "similarity") if f.get(k) is not None} for f in definition.get("fields", [])]
        return json.dumps(sorted(fields, key=lambda f: (f.get("type", ""), f.get("path", ""))), sort_keys=True)
    return json.dumps({k: definition.get(k) for k in ("analyzers", "mappings")}, sort_keys=True)


def apply_plan(records: DataFrame, index: Index, plan: DataFrame, embedder) -> DataFrame:
    """Carry a plan out: embed inserted and updated children, write the new version, unless nothing changes; returns
    one row of counts (inserted, updated, deleted, embedded)."""
    spark = index.spark
    plan = materialize(plan, "sync-plan")
    fresh = records.join(plan.filter("action <> 'delete'").select("id"), "id", "left_semi")
    vectors = materialize(embedded(fresh.filter("kind = 'child'"), embedder), "sync-embedded")
    parents = fresh.filter("kind <> 'child'").withColumn("embedding", F.lit(None).cast("array<float>"))
    written = to_documents(vectors.unionByName(parents))
    if not plan.isEmpty():
        index.write(written, plan)
    return report(plan).crossJoin(vectors.agg(F.count("*").alias("embedded")))  # a row each


def report(plan: DataFrame) -> DataFrame:
    return plan.agg(*[F.count_if(F.col("action") == a).alias(b) for a, b in (("insert", "inserted"), ("update", "updated"), ("delete", "deleted"))])


def ingest(records: DataFrame, index: Index, embedder, definitions: dict[str, tuple[str, dict]] | None = None) -> DataFrame:
    """Ensure the search definitions, then bring the index to the records. An empty table of records, which would
    delete all, is refused."""
    for name, (kind, definition) in (definitions or {}).items():
        index.ensure(name, kind, definition)
    if records.isEmpty():
        raise ValueError("no chunk records: refusing to empty the index")
    return apply_plan(records, index, plan_sync(records, index.hashes()), embedder)
