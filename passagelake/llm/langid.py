"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of 1 to 3 code points of the lower-cased text, where everything but letters is one space, go to
BUCKETS hash buckets. Document frequencies are counted over all learning documents. The weights are
trained with follow-the-regularised-leader (McMahan et al., KDD 2013) under an elastic net, then one
temperature is fitted on a part of the sample that was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, materialize, partitions, small_batches, table

BUCKETS = 1 << 16
#: Learning documents of each language that the weights are fitted on, at most (in expectation; by hash).
PER_LANGUAGE = 2000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
EPOCHS = 3
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)]))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of the whole text's n-grams; None if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32).astype(np.uint64)
    codes = np.concatenate([[np.uint64(32)], codes, [np.uint64(32)]])
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
    h, all_h = np.zeros(len(codes), np.uint64), []
    for n in range(3):
        h = (h[: len(codes) - n] + codes[n:] + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        all_h.append((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48))
    counts = np.bincount(np.concatenate(all_h).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        self.z = np.zeros((BUCKETS, len(languages)))
        self.n = np.zeros((BUCKETS, len(languages)))
        self.temperature = 1.0
        self.weights = None

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[at]
        return v / max(np.sqrt(v @ v), 1e-12)

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ (self._weights(at) if self.weights is None else self.weights[at])

    def learn(self, at: np.ndarray, v: np.ndarray, y: int) -> None:
        w = self._weights(at)
        p = _softmax(v @ w)
        p[y] -= 1
        g = v[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def fix(self) -> None:
        """Keep the weights alone; most are exactly zero."""
        self.weights = self._weights(np.arange(BUCKETS)).astype(np.float32)
        self.z = self.n = None

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text)
        if found is None or not self.languages:
            return UNDETERMINED, 0.0
        p = _softmax(self.logits(found[0], self.vector(*found)) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(languages: list[str], idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 0) -> Model:
    """rows: (buckets, counts, language index), in a reproducible order. Every fifth is kept for the temperature."""
    model = Model(languages, idf)
    ready = [(at, model.vector(at, c), y) for at, c, y in rows]
    kept, taught = ready[::5], [r for i, r in enumerate(ready) if i % 5]
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(taught)):
            model.learn(*taught[i])
    model.fix()
    if kept:
        logits, y = np.stack([model.logits(at, v) for at, v, _ in kept]), np.array([r[2] for r in kept])

        def loss(t: float) -> float:
            x = logits / t
            x = x - x.max(1, keepdims=True)
            return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(y)), y]).mean())

        model.temperature = float(min(np.geomspace(0.02, 10, 200), key=loss))
    return model


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """texts (text) -> documents that have each bucket, and documents with a letter; counted over all rows.

    A task sums its rows; sums of tasks are summed in groups, then once more: each is one array.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for t in b["text"]:
                found = grams(t if isinstance(t, str) else None)
                if found is not None:
                    df[found[0]] += 1
                    df[BUCKETS] += 1
        yield pd.DataFrame({"df": [df.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for x in b["df"]:
                df += np.frombuffer(x, np.int64)
        yield pd.DataFrame({"df": [df.tobytes()]})

    counted = materialize(texts.mapInPandas(count, "df binary"), "langid-counts")
    groups = max(1, int(partitions(texts.sparkSession) ** 0.5))
    sums = counted.coalesce(groups).mapInPandas(add, "df binary").collect()  # a row a group
    total = sum((np.frombuffer(r.df, np.int64) for r in sums), np.zeros(BUCKETS + 1, np.int64))
    return total[:BUCKETS], int(total[BUCKETS])


@F.pandas_udf(T.StructType([T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())]))
def _grams(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        out = [grams(t if isinstance(t, str) else None) for t in texts]
        yield pd.DataFrame({"at": [None if g is None else g[0].astype(np.uint16).tobytes() for g in out], "n": [None if g is None else g[1].astype(np.uint32).tobytes() for g in out]})


def train(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on docs for which `learnable` holds and whose language is not null.

    Rows without a letter teach nothing. Of each language a bounded hash sample of the documents
    is fitted on; document frequencies come from all learning rows.
    Without learning rows every text is undetermined.
    """
    small_batches(docs.sparkSession)
    rows = docs.filter(learnable & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    df, n = _document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    key = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 40))
    shares = F.map_from_arrays(F.lit(languages or [""]), F.lit([int(min(1.0, per_language / sizes[x]) * (1 << 40)) for x in languages] or [0]))
    limit = F.element_at(shares, F.col("lang")).cast("long")
    got = rows.withColumn("key", key).filter(F.col("key") < limit).withColumn("g", _grams("text")).select("key", "lang", "g.at", "g.n").filter("at is not null").toPandas()
    got = got.sort_values("key", kind="stable")
    place = {lang: i for i, lang in enumerate(languages)}
    sample = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(c, np.uint32), place[lang]) for a, c, lang in zip(got["at"], got["n"], got["lang"])]
    return fit(languages, idf, sample)


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score appended; columns of docs that have these names give way, others stay.
    Text alone decides: null or without a letter gives `und`, 0. A very long text's n-grams are counted over all of it, in one task. Rows
    that repeat are predicted each; an empty table gives an empty one."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang_pred", "score"])

    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    out = docs.select(F.struct(*own).alias("row"), predict(F.col(f"`{text_col}`").cast("string")).alias("said"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("lang_pred", "score")], "said.lang_pred", "said.score")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(F.col("doc_id"), 4, 2))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
