"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Kiryo et al., NeurIPS 2017. Trusted positives are rows labelled good; the unlabelled set is plain
documents; rows labelled bad are never trained on. The class prior is estimated from the two sets
alone, by the best-bin estimator (Garg et al., NeurIPS 2021): the share of unlabelled over the share
of positives above a score, at the score where its upper confidence bound is least.

A text becomes a vector of shares (letters, symbols, repeats, ...) of the whole text and of its worst
fifth, and of hashed word shapes. The model is a network with one hidden layer, in numpy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, materialize, small_batches, table

#: Labelled positives, and unlabelled documents, that a fit takes at most (in expectation): rows are drawn by
#: hash, with a share that follows from counts over all rows.
POSITIVES = 6000
UNLABELLED = 12000
THRESHOLD = 0.3
SHAPES = 64
HIDDEN = 24
#: Words of a segment; a rest of under a quarter of it belongs to the segment before.
SEGMENT = 200
#: Code points of texts that are looked at together; a longer text is looked at alone.
CHUNK = 1 << 18
_PART = 11
WIDTH = 2 * _PART + SHAPES + 2
_ALPHA, _UPPER, _LOWER, _DIGIT, _ALNUM, _END, _COMMA, _SPACE = (1 << i for i in range(8))
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its flags, and its class in a word's shape (a category for letters and numbers, else itself)."""
    if not _tables:
        flags, shape = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32) + 64
        kinds = {k: i for i, k in enumerate(("Lu", "Ll", "Lt", "Lm", "Lo", "N"))}
        for c in range(0x110000):
            x = chr(c)
            kind = unicodedata.category(x)
            if kind[0] in "LN":
                shape[c] = kinds[kind if kind[0] == "L" else "N"]
            if kind[0] in "LNMSo" or c < 128:
                flags[c] = _ALPHA * x.isalpha() | _UPPER * x.isupper() | _LOWER * (x.islower() or x.istitle() and not x.isupper()) | _DIGIT * x.isdigit() | _ALNUM * x.isalnum()
        for x, f in ((".!?", _END), (",;:", _COMMA), (" \t\n\v\f\r", _SPACE)):
            for c in x:
                flags[ord(c)] |= f
        _tables.append((flags, shape))
    return _tables[0]


#: Random odd factors of a hash by place.
_FACTORS = np.random.default_rng(3).integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)


def _factor(place: np.ndarray) -> np.ndarray:
    return _FACTORS[place & 1023]


def features(texts: list[str | None]) -> np.ndarray:
    """A row for each text, over all of it; zeros (but for the first column) where there are no words.

    Shares of letters, capitals, digits, marks, distinct words, repeats and so on in each segment of words: their
    mean and spread over the text's segments; and the roots of the shares of hashed word shapes.
    """
    out, held, size = [], [], 0
    for t in texts:
        codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        if held and size + len(codes) > CHUNK:
            out.append(_block(held))
            held, size = [], 0
        held.append(codes)
        size += len(codes) + 1
    if held:
        out.append(_block(held))
    return np.concatenate(out) if out else np.zeros((0, WIDTH))


def _block(texts: list[np.ndarray]) -> np.ndarray:
    every_flag, every_shape = _classes()
    out = np.zeros((len(texts), WIDTH))
    blank = np.array([32], np.uint32)
    codes = np.concatenate([x for t in texts for x in (t, blank)])
    flags = every_flag[codes]
    inside = (flags & _SPACE) == 0
    edge = np.diff(inside.view(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # of words
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(text_ends, begin, side="right")
    words = np.bincount(doc, minlength=len(texts))
    out[:, 0] = words == 0
    if not len(begin):
        return out
    out[:, 1] = np.log1p(words) / 10
    long = end - begin
    nth = np.arange(len(begin)) - np.repeat(np.cumsum(words) - words, words)  # in its text
    parts = np.maximum(1, words // SEGMENT + (words % SEGMENT >= SEGMENT // 4))
    part = np.minimum(nth // SEGMENT, parts[doc] - 1) + (np.cumsum(parts) - parts)[doc]
    _, part = np.unique(part, return_inverse=True)  # texts without words have no segment
    n = np.bincount(part).astype(float)


    def by_word(f: int) -> np.ndarray:
        upto = np.cumsum((flags & f) > 0, dtype=np.int32)
        return upto[end - 1] - np.where(begin > 0, upto[begin - 1], 0)

    by_part = lambda x: np.bincount(part, weights=x, minlength=len(n))
    alpha, upper, digit, alnum = (by_word(f) for f in (_ALPHA, _UPPER, _DIGIT, _ALNUM))
    last = flags[end - 1]
    at = np.repeat(begin, long)
    chars = np.concatenate([[0], np.cumsum(long)])
    pos = np.arange(chars[-1]) - np.repeat(chars[:-1], long)  # of a character in its word
    own = codes[at + pos]
    word_hash = np.add.reduceat((own + np.uint32(1)) * _factor(pos), chars[:-1])
    order = np.lexsort((word_hash, part))
    new = np.ones(len(order), bool)
    new[1:] = (word_hash[order][1:] != word_hash[order][:-1]) | (part[order][1:] != part[order][:-1])
    same = np.zeros(len(begin))
    same[1:] = (word_hash[1:] == word_hash[:-1]) & (part[1:] == part[:-1])
    n_chars, n_alpha, n_digit = by_part(long), by_part(alpha), by_part(digit)
    each = np.stack([
        n_alpha / n_chars,
        by_part(upper) / np.maximum(1, n_alpha),
        n_digit / n_chars,
        (n_chars - n_alpha - n_digit) / n_chars,
        by_part(np.where(new, 1, 0)[np.argsort(order)]) / n,
        by_part(same) / np.maximum(1, n - 1),
        by_part(alnum == 0) / n,
        by_part((upper > 0) & (by_word(_LOWER) == 0) & (long > 1)) / n,
        by_part((last & _END) > 0) / n,
        by_part((last & _COMMA) > 0) / n,
        np.minimum(n_chars / n, 30) / 10,
    ], 1)
    of = doc[np.flatnonzero(np.diff(part, prepend=-1))]
    weight = (n / words[of])[:, None]
    mean, square = np.zeros((len(texts), _PART)), np.zeros((len(texts), _PART))
    np.add.at(mean, of, weight * each)
    np.add.at(square, of, weight * each**2)
    out[:, 2 : 2 + _PART] = mean
    out[:, 2 + _PART : 2 + 2 * _PART] = np.sqrt(np.maximum(square - mean**2, 0))
    shape = every_shape[own]
    keep = np.ones(len(pos), bool)
    keep[1:] = (pos[1:] == 0) | (shape[1:] != shape[:-1])
    step = np.cumsum(keep) - 1
    step -= np.repeat(step[chars[:-1]], long)
    marks = np.where(keep, (shape + np.uint32(1)) * _factor(step), np.uint64(0))
    bucket = (np.add.reduceat(marks, chars[:-1]) >> np.uint64(40)).astype(np.int64) % SHAPES
    counts = np.bincount(doc * SHAPES + bucket, minlength=len(texts) * SHAPES).reshape(-1, SHAPES)
    out[:, 2 + 2 * _PART :] = np.sqrt(counts / np.maximum(1, words)[:, None])
    return out


class Model:
    """score = sigmoid(v . relu(W z + b) + c), z the standardised vector."""

    def __init__(self, mean, scale, w, b, v, c, prior):
        self.mean, self.scale, self.w, self.b, self.v, self.c, self.prior = mean, scale, w, b, v, c, prior

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.maximum(z @ self.w + self.b, 0) @ self.v + self.c

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, least: float = 0.5) -> float:
    """The class prior of the unlabelled scores, given scores of positives that were not trained on."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.sort(positive)[: max(1, int(len(positive) * (1 - least)))]
    qp = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    qu = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    i = np.argmin((qu + slack) / qp)
    return float(np.clip(qu[i] / qp[i], 0.02, 0.98))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0, epochs: int = 40, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4) -> Model:
    """Minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) with the logistic loss, by Adam.

    Where the negative part falls below 0, the step ascends it instead, as the estimator's authors do.
    """
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, WIDTH))
    mean, scale = every.mean(0), np.maximum(every.std(0), 1e-3)
    m = Model(mean, scale, rng.normal(0, (2 / WIDTH) ** 0.5, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), 0.0, prior)
    if not len(positive) or not len(unlabelled):
        m.v[:] = 0
        m.c = float(np.log(prior / (1 - prior)))
        return m
    zp, zu = [np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled)]
    state = {k: [np.zeros_like(np.asarray(getattr(m, k), float))] * 2 for k in "wbvc"}
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
    t, steps = 0, max(1, -(-len(zu) // batch))
    for epoch in range(epochs):
        pick_u, pick_p = rng.permutation(len(zu)), rng.permutation(max(len(zp), 1))
        lr = rate * (1 - epoch / epochs) + 1e-5
        for s in range(steps):
            t += 1
            xu = zu[pick_u[s * batch : (s + 1) * batch]]
            xp = zp[np.take(pick_p, np.arange(s * batch, (s + 1) * batch), mode="wrap")]
            hp, hu = xp @ m.w + m.b, xu @ m.w + m.b
            gp, gu = np.maximum(hp, 0) @ m.v + m.c, np.maximum(hu, 0) @ m.v + m.c
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if negative >= 0:
                dp, du = prior * (sig(gp) - 1) - prior * sig(gp), sig(gu)
            else:
                dp, du = prior * sig(gp), -sig(gu)
            dp, du = dp / len(gp), du / len(gu)
            grad = {"c": np.asarray(dp.sum() + du.sum()), "v": np.maximum(hp, 0).T @ dp + np.maximum(hu, 0).T @ du + decay * m.v}
            bp, bu = dp[:, None] * m.v * (hp > 0), du[:, None] * m.v * (hu > 0)
            grad |= {"b": bp.sum(0) + bu.sum(0), "w": xp.T @ bp + xu.T @ bu + decay * m.w}
            for k, g in grad.items():
                a, b = state[k]
                a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
                state[k] = [a, b]
                setattr(m, k, getattr(m, k) - lr * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8))
    return m


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Estimate the prior with a first model (halves for training and for estimating), then fit on all."""
    prior = 0.5
    for _ in range(2):
        first = fit_nnpu(positive[::2], unlabelled[::2], prior, epochs=15)
        prior = best_bin_prior(first.logits(positive[1::2]), first.logits(unlabelled[1::2]))
    return fit_nnpu(positive, unlabelled, prior)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(list(_features(texts)))


def _features(texts: pd.Series) -> np.ndarray:
    return features([t if isinstance(t, str) else None for t in texts]).astype(np.float32)


def _drawn(rows: DataFrame, most: int, seed: str) -> np.ndarray:
    """Vectors of about `most` rows (doc_id, text), all if there are fewer; the choice and order are by hash."""
    n = rows.count()
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40))
    if n > most:
        rows = rows.filter(key < F.lit(int(most / n * (1 << 40))))
    got = rows.withColumn("key", key).withColumn("v", _vectors("text")).select("key", "v").toPandas()
    got = got.sort_values("key", kind="stable")
    return np.array(got["v"].tolist(), np.float64).reshape(-1, WIDTH)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on positives (label 1) and unlabelled documents, each a bounded hash sample. The held-out fold
    (crc32(id as text) mod 5 = 0) gives neither labels nor unlabelled texts.

    Null ids and null labels are never positives; null texts are empty; a document labelled twice is a positive
    if any label is 1. Without positives the model answers its prior, 0.5, for every text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(~held_out(F.col("doc_id"), 5, 0))
    good = labels.filter(F.col(label_col) == 1).select(F.col(label_id_col).alias("doc_id")).filter("doc_id is not null").filter(~held_out(F.col("doc_id"), 5, 0)).distinct()
    # The positives' ids are drawn before texts are read, so the join that fetches texts is small on one side.
    n = good.count()
    key = F.pmod(F.xxhash64(F.lit("positive"), "doc_id"), F.lit(1 << 40))
    if n > positives:
        good = good.filter(key < F.lit(int(positives / n * (1 << 40))))
    good = materialize(good, "quality-positives")
    return fit(_drawn(rows.join(good, "doc_id", "left_semi"), 2 * positives, "p"), _drawn(rows, unlabelled, "u"))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with _score appended; a null text is scored as an empty one. A very long text's features are taken over all of
    it, as a block alone; rows that repeat are scored each; an empty table gives an empty one."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(_features(texts).astype(np.float64)))

    return docs.withColumn("_score", score(F.col(text_col).cast("string")))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs that the classifier doesn't reject; all columns stay, whatever their names, and no row is moved."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return scored(packed, model).filter(F.col("_score") >= threshold).select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
