"""Secret scan: fixed patterns, and a character convolutional network over wider candidates.

The base patterns' findings always stay. The network looks at every candidate and its surrounding context, and
adds the spans (kind `model`) that it takes for secrets. A candidate is a token (a run of ASCII without spaces, quotes, brackets, commas and
semicolons) that a base finding does not touch and whose characters are not those of a plain word: see `worth`. A token longer than a
window is looked at in windows that overlap by half; the greatest score counts.

It is trained on all labelled findings of the table: the values that base patterns find against candidates they
leave. Each distinct window is learned from, none is drawn. They are dealt by hash into shards of some SHARD; in a round each shard makes a pass
of Adam over its rows, in its task, and the weights are averaged by rows. A shard adds EXAMPLES made-up ones of each kind (each shard
others), so their share is the same at any size and there is a network whatever the texts hold. Candidates left pass as
harmless, though a secret that no pattern finds is among them; so those that a first network, taught without them, takes
for secrets are left out. In half of the rows the context is blanked, so that a token counts for itself. A quarter of the
windows, by hash, is not trained on: all of it, each window as often as it occurs, calibrates the scores. Of the thresholds that keep RECALL of its
findings the most precise is taken, the lowest of equals: recall is the constraint, precision the aim.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

#: The base patterns, least lengths of what must match, and the order of kinds.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same spans as [0-9a-f]+ of 24 characters or more
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "model")
_CUES = ("passw", "secret", "token", "api")

#: A token's characters: printable ASCII but for quotes, brackets, commas and semicolons.
_IN = r"!#-&*+\-./0-9:=?-Z\\^-z|~"
#: A token, unless it is a word of lower-case letters but for the first, full stops and hyphens: such is none, if it is short.
_TOKEN = re.compile(rf"(?<![{_IN}])(?:[A-Za-z]?+[a-z.-]*+[^\x00-\x20a-z.\x22'(),;<>\[\]{{}}\x7f-\U0010ffff-][{_IN}]*+|[a-z]{{20,}}+)")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_MIXED = re.compile(r"[a-z].*[A-Z]|[+/_=@]")
_SWITCH = re.compile("[a-z](?=[A-Z])")
_MARK = re.compile(r"[!#$%&*?^`|~\\+=@]")
CANDIDATE_LEAST, WORDLIKE_LEAST = 8, 12
#: What a token loses at its end.
_TAIL = re.compile(r"(?:[.:?-]|([^A-Za-z0-9=])\1+|(?<![0-9])!)+$")
#: Least lengths of candidates with a digit, a letter and a mark, with two marks, and of digits, capitals or small letters alone.
MARKED_LEAST, MARKS_LEAST, DIGITS_LEAST, UPPER_LEAST, LOWER_LEAST = 6, 8, 13, 16, 20
#: Distinct windows of a shard, as expected. Shards, and what follows from them, depend on the table alone.
SHARD = 6000
#: Made-up findings, and as many harmless tokens, that each shard takes besides.
EXAMPLES = 2000
#: Rounds over all rows, and shards whose weights are averaged in one task.
ROUNDS, FAN = 6, 64
#: Of every so many windows one is kept to calibrate.
KEPT = 4
#: Steps of a logit by which rows are counted for the threshold, and the greatest logit told apart.
STEPS, MOST = 1024, 32
#: Score of a first network from which a candidate is no sure example of a harmless token.
DOUBT = 0.9
LEFT, HEAD, TAIL, RIGHT = 24, 32, 16, 12
LENGTH = LEFT + HEAD + TAIL + RIGHT
RECALL = 0.95


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, by start, then kind as listed; ends exclusive."""
    out = []
    low = text.lower()
    if any(c in low for c in _CUES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def values(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Where the secrets themselves lie in base findings: of an assignment what is assigned, else the whole finding."""
    return [(s + ASSIGN.match(text[s:e]).start(2), e) if kind == "assign" else (s, e) for s, e, kind in spans]


def worth(t: str) -> bool:
    """Whether a token is shown to the network: letters with digits, mixed cases, marks, or a long run of one kind."""
    n = len(t)
    digit, letter = _DIGIT.search(t), _LETTER.search(t)
    if digit and letter and (n >= CANDIDATE_LEAST or n >= MARKED_LEAST and _MARK.search(t)):
        return True
    if n >= CANDIDATE_LEAST and len(_SWITCH.findall(t)) >= 2 or n >= WORDLIKE_LEAST and _MIXED.search(t) or n >= MARKS_LEAST and letter and len(_MARK.findall(t)) >= 2:
        return True
    return n >= DIGITS_LEAST and t.isdigit() or n >= UPPER_LEAST and t.isalpha() and t.isupper() or n >= LOWER_LEAST and t.isalpha() and t.islower()


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens worth a look, without what ends a sentence or decorates a word: full stops, colons, runs of one mark, and
    a ! that no digit stands before."""
    out = []
    for m in _TOKEN.finditer(text):
        t = _TAIL.sub("", m[0])
        if len(t) >= MARKED_LEAST and worth(t):
            out.append((m.start(), m.start() + len(t)))
    return out


def touched(spans: list[tuple[int, int, str]], start: int, end: int) -> bool:
    """Whether a finding overlaps start to end. A kind's findings don't overlap, so few can lie that near."""
    at = bisect_left(spans, (end,))
    last = {}
    for s, e, kind in reversed(spans[:at]):  # the last finding of each kind before the end decides
        if e > start:
            return True
        last[kind] = s
        if len(last) == 3:
            break
    return False


def window(text: str, start: int, end: int) -> str:
    """The token and its context as LENGTH characters. Of a longer token this is its first window."""
    token = text[start:end][: HEAD + TAIL]
    return text[max(0, start - LEFT) : start].rjust(LEFT, "\0") + token.ljust(HEAD + TAIL, "\0") + text[start + len(token) : start + len(token) + RIGHT].ljust(RIGHT, "\0")


def windows(text: str, start: int, end: int) -> list[str]:
    """Windows over a whole token, each half a window on; the last one ends with the token."""
    wide = HEAD + TAIL
    at = [*range(start, max(start + 1, end - wide), wide // 2)]
    if end - wide > at[-1]:
        at.append(end - wide)
    return [window(text, a, min(end, a + wide)) for a in at]


def _codes(windows: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, LENGTH)
    return np.minimum(raw, 128).astype(np.int64)


class Network:
    """Embedding, convolution, ReLU, the greatest and mean over the token, the greatest over the context, a linear layer."""

    EMBED, FILTERS, WIDE = 12, 24, 5

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.3, (129, self.EMBED)),
            "k": rng.normal(0, (2 / (self.WIDE * self.EMBED)) ** 0.5, (self.WIDE * self.EMBED, self.FILTERS)),
            "b": np.zeros(self.FILTERS),
            "v": rng.normal(0, 0.2, 3 * self.FILTERS),
            "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.0

    def _forward(self, codes: np.ndarray):
        p, n = self.p, len(codes)
        x = p["e"][codes]
        places = LENGTH - self.WIDE + 1
        cols = np.lib.stride_tricks.sliding_window_view(x, self.WIDE, axis=1).transpose(0, 1, 3, 2).reshape(n, places, -1)
        h = np.maximum(cols @ p["k"] + p["b"], 0)
        token = slice(LEFT, LEFT + HEAD + TAIL - self.WIDE + 1)
        inside, outside = h[:, token], np.concatenate([h[:, : token.start], h[:, token.stop :]], axis=1)
        pooled = np.concatenate([inside.max(1), inside.mean(1), outside.max(1)], axis=1)
        return cols, h, inside, outside, pooled, pooled @ p["v"] + p["c"][0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 512])[-1] for i in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def scores(self, windows: list[str]) -> np.ndarray:
        return _sigmoid(self.logits(_codes(windows)) * self.scale + self.shift) if windows else np.zeros(0)

    def train(self, codes: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, seed: int = 0) -> None:
        state = self.begun()
        for i in range(rounds):
            state = self.taught(state, codes, y, np.random.default_rng((seed, i)))

    def begun(self) -> np.ndarray:
        """The state of a training: weights, both moments, steps, in one row of numbers."""
        flat = np.concatenate([v.reshape(-1) for v in self.p.values()])
        return np.concatenate([flat, np.zeros(2 * len(flat) + 1)])

    def load(self, state: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = state[at : at + v.size].reshape(v.shape).copy()
            at += v.size

    def taught(self, state: np.ndarray, codes: np.ndarray, y: np.ndarray, rng: np.random.Generator, batch: int = 64, rate: float = 3e-3) -> np.ndarray:
        """A pass of Adam on the logistic loss. In half of the rows the context is blanked, so that the token counts too."""
        self.load(state)
        first, second = np.split(state[:-1], 3)[1:]
        t = float(state[-1])
        first, second = first.copy(), second.copy()
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = codes[rows].copy()
            blank = rng.random(len(rows)) < 0.5
            x[blank, :LEFT] = 0
            x[blank, LENGTH - RIGHT :] = 0
            t += 1
            gradient = self._gradient(x, y[rows])
            g = np.concatenate([gradient[k].reshape(-1) for k in self.p])
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            self.load(np.concatenate([v.reshape(-1) for v in self.p.values()]) - step)
        return np.concatenate([*(v.reshape(-1) for v in self.p.values()), first, second, [t]])

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        p, n = self.p, len(x)
        cols, h, inside, outside, pooled, out = self._forward(x)
        d = (_sigmoid(out) - y) / n
        dp = d[:, None] * p["v"]
        f = self.FILTERS
        dh = np.zeros_like(h)
        token = np.arange(LEFT, LEFT + inside.shape[1])
        rest = np.setdiff1d(np.arange(h.shape[1]), token)
        i, j = np.arange(n)[:, None], np.arange(f)[None, :]
        dh[i, token[inside.argmax(1)], j] += dp[:, :f]
        dh[:, token] += dp[:, None, f : 2 * f] / len(token)
        dh[i, rest[outside.argmax(1)], j] += dp[:, 2 * f :]
        dh *= h > 0
        dcols = (dh @ p["k"].T).reshape(n, h.shape[1], self.WIDE, self.EMBED)
        dx = np.zeros((n, LENGTH, self.EMBED))
        for w in range(self.WIDE):
            dx[:, w : w + h.shape[1]] += dcols[:, :, w]
        de = (x.reshape(-1) == np.arange(len(p["e"]))[:, None]).astype(float) @ dx.reshape(-1, self.EMBED)
        return {"v": pooled.T @ d, "c": np.array([d.sum()]), "k": np.einsum("npc,npf->cf", cols, dh), "b": dh.sum((0, 1)), "e": de}

    def counted(self, codes: np.ndarray, y: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        """(at, y, n): how many rows have a logit of `at` steps, rounded down. Every row counts twice, with its context and without."""
        bare = codes.copy()
        bare[:, :LEFT] = 0
        bare[:, LENGTH - RIGHT :] = 0
        z = self.logits(np.concatenate([codes, bare]))
        at = np.floor(np.clip(z, -MOST, MOST) * STEPS).astype(np.int64)
        return pd.DataFrame({"at": at, "y": np.tile(y, 2).astype(np.int64), "n": np.tile(n, 2).astype(np.int64)}).groupby(["at", "y"], as_index=False).sum()

    def calibrate(self, codes: np.ndarray, y: np.ndarray) -> None:
        self.settle(self.counted(codes, y, np.ones(len(y))))

    def settle(self, counts: pd.DataFrame) -> None:
        """Platt scaling over counted rows, then the threshold: of those that keep RECALL of the findings the most precise, the
        lowest of equals."""
        counts = counts.sort_values(["at", "y"])
        z, y, n = counts["at"].to_numpy() / STEPS, counts["y"].to_numpy(float), counts["n"].to_numpy(float)
        yes, no = (n * y).sum(), (n * (1 - y)).sum()
        soft = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            q = _sigmoid(a * z + b)
            w = n * np.maximum(q * (1 - q), 1e-6)
            d = n * (q - soft)
            g = np.array([(d * z).sum() + 1e-3 * (a - 1), d.sum()])
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        self.scale, self.shift = max(float(a), 1e-3), float(b)
        cuts, where = np.unique(z, return_inverse=True)
        above = lambda v: np.bincount(where, v, len(cuts))[::-1].cumsum()[::-1]
        found, right = above(n * y) / yes, above(n * y) / above(n)
        able = (found >= RECALL) & (np.bincount(where, n * y, len(cuts)) > 0)
        self.threshold = float(_sigmoid(self.scale * cuts[able & (right == right[able].max())].min() + self.shift))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def made_up(n: int = EXAMPLES, seed: int = 11) -> tuple[list[str], list[str]]:
    """(findings, harmless tokens) as windows without context: random keys of several alphabets, and words, numbers,
    dates, names and addresses of the kinds that texts hold."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5)))
    every = lower + upper + digits
    part = lambda: rng.choice("b c d f g l m n p r s t v w th ch st tr pl str gr qu".split()) + rng.choice("a e i o u ou ea io ie".split()) + rng.choice(["", "", "n", "r", "l", "s", "ct", "nt", "st", "ng", "tion"])
    long = lambda n: "".join(part() for _ in range(20))[:n]
    keys = [
        lambda: pick(every, rng.randrange(8, 13)),
        lambda: pick(every, rng.randrange(12, 25)),
        lambda: pick(every, rng.randrange(25, 65)),
        lambda: pick(every + "+/", rng.randrange(20, 65)) + "=" * rng.randrange(3),
        lambda: pick(every + "-_", rng.randrange(16, 49)),
        lambda: pick("0123456789abcdef", rng.randrange(16, 65)),
        lambda: pick(upper + digits, rng.randrange(16, 33)),
        lambda: f"{word()[:2]}_{pick(every, rng.randrange(16, 41))}",
        lambda: pick(every + "!#$%^&*", rng.randrange(10, 25)),
        lambda: pick(every, 5) + pick("!#$%^&*@", 1) + pick(digits, 1) + pick(every, rng.randrange(2, 7)),
        lambda: f"{rng.choice([str, str.title])(word())}{rng.randrange(1950, 2030)}{pick('!#$%&*@', rng.randrange(1, 3))}",
        lambda: pick(lower, rng.randrange(20, 49)),
        lambda: pick(upper, rng.randrange(16, 41)),
        lambda: pick(digits, rng.randrange(14, 25)),
    ]
    plain = [
        lambda: f"{word()}{rng.randrange(2030)}",
        lambda: f"{rng.randrange(1900, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}T{rng.randrange(24):02d}",
        lambda: f"{word()}.{rng.randrange(100):02d}@{word()}{rng.randrange(10)}.example",
        lambda: f"{word()}-{word()}_{rng.randrange(99)}",
        lambda: f"{word()}/{word()}/{word()}{rng.randrange(99)}.html",
        lambda: f"www.{word()}{rng.randrange(99)}.example/{word()}?{word()}={rng.randrange(999)}",
        lambda: word().title() + word().title() + word().title(),
        lambda: f"{word()}_{word()}_{word()}",
        lambda: f"{rng.randrange(99)}.{rng.randrange(99)}.{rng.randrange(99)}-{word()}{rng.randrange(9)}",
        lambda: long(rng.randrange(20, 33)),
        lambda: long(rng.randrange(16, 25)).upper(),
        lambda: f"{long(rng.randrange(4, 12)).title()}{long(rng.randrange(4, 12)).title()}/{long(6).title()}",
        lambda: f"{word()}@{long(rng.randrange(5, 12))}.{rng.choice(['com', 'org', 'example'])}",
        lambda: f"{long(4)}{rng.randrange(99)}_{rng.randrange(99)}-{long(5)}-{long(3)}",
        lambda: f"{word()}://{word()}.example/{word()}?{word()}={word()}&{word()}={rng.randrange(99)}",
        lambda: f"{rng.choice('xyz')}{rng.choice('^=+')}{rng.randrange(9)}{rng.choice('+=*')}{rng.randrange(99)}",
        lambda: f"#{word()}{rng.randrange(2030)}",
        lambda: "/".join(pick(lower, rng.randrange(3, 8)) for _ in range(rng.randrange(2, 4))) + f"{rng.randrange(99)}.{rng.choice(['html', 'php', 'txt', 'pdf'])}",
        lambda: f"{rng.choice(['http', 'www', 'docs', 'img'])}/{pick(lower, rng.randrange(3, 8))}/{word()}{rng.randrange(99)}.{rng.choice(['html', 'png', 'xml'])}",
        lambda: f"{pick(lower, rng.randrange(3, 9))}.{rng.randrange(99)}@{pick(lower, rng.randrange(3, 9))}{rng.randrange(9)}.{rng.choice(['com', 'org', 'example'])}",
        lambda: f"{pick(lower, rng.randrange(4, 9))}{rng.choice('-_.')}{pick(lower, rng.randrange(3, 7))}{rng.choice('-_.')}{rng.randrange(999)}",
        lambda: f"{word().title()}&{word().title()}{rng.randrange(99)}",
        lambda: f"{rng.randrange(1900, 2030)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}{rng.randrange(24):02d}{rng.randrange(60):02d}{rng.randrange(60):02d}",
        lambda: pick("0", 1) * rng.randrange(13, 20),
    ]
    return tuple([window(t, 0, len(t)) for t in (kinds[i % len(kinds)]() for i in range(n))] for kinds in (keys, plain))


@functools.lru_cache(maxsize=4)
def _examples(shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, y) of a shard's made-up ones, findings first."""
    keys, plain = made_up(seed=11 + shard)
    return _codes([*keys, *plain]), np.repeat([1.0, 0.0], [len(keys), len(plain)])


def _part(shard: int, rows: pd.DataFrame, kept: bool | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, y, n) of a shard's rows (w, y, n, kept) with its made-up ones; kept or not kept ones only, unless None."""
    rows = rows[rows["w"].notna()].sort_values(["w", "y"])
    codes, y = _examples(shard)
    own = np.random.default_rng(shard).random(len(y)) < 1 / KEPT  # of every kind some
    if kept is not None:
        rows = rows[rows["kept"].astype(bool) == kept]
        codes, y = codes[own == kept], y[own == kept]
    windows = _codes(rows["w"].tolist()) if len(rows) else codes[:0]
    return np.concatenate([windows, codes]), np.concatenate([rows["y"].to_numpy(float), y]), np.concatenate([rows["n"].to_numpy(float), np.ones(len(y))])


def _averaged(states: list[np.ndarray], weights: list[float]) -> np.ndarray:
    """The average by rows, in the order given; the last number, the steps made, is the greatest."""
    out = sum(w * s for s, w in zip(states, weights)) / sum(weights)
    out[-1] = max(s[-1] for s in states)
    return out


def _passed(shard: int, rows: pd.DataFrame, state: np.ndarray, turn: int, kept: bool | None) -> tuple[np.ndarray, int]:
    """A shard's pass over its rows in a round: its new state, and its rows."""
    codes, y, _ = _part(shard, rows, kept)
    return Network().taught(state, codes, y, np.random.default_rng((shard, turn))), len(y)


class Shards:
    """The distinct windows of a table in shards (shard, w, y, n, kept); a row without a window stands for each shard, so none is missed."""

    def __init__(self, windows: DataFrame):
        """windows: (w, y), a row an occurrence."""
        spark = windows.sparkSession
        each = materialize(windows.groupBy("w", "y").agg(F.count("*").alias("n")), "secret-windows")
        self.many = max(1, math.ceil(each.count() / SHARD))
        key = F.xxhash64(F.lit("secrets"), "w")
        dealt = each.select(F.pmod(key, F.lit(self.many)).alias("shard"), "w", "y", "n", (F.pmod(F.xxhash64(F.lit("kept"), "w"), F.lit(KEPT)) == 0).alias("kept"))
        none = spark.range(self.many).select(F.col("id").alias("shard"), F.lit(None).cast("string").alias("w"), F.lit(None).cast("int").alias("y"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("kept"))
        self.rows = dealt.unionByName(none)

    def _each(self, job: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        return self.rows.repartition(self.many, "shard").groupBy("shard").applyInPandas(lambda key, rows: job(int(key[0]), rows), schema)

    def round(self, state: np.ndarray, turn: int, kept: bool | None) -> np.ndarray:
        schema = "shard long, state array<double>, n long"

        def learn(shard: int, rows: pd.DataFrame) -> pd.DataFrame:
            new, n = _passed(shard, rows, state, turn, kept)
            return pd.DataFrame({"shard": [shard], "state": [new.tolist()], "n": [n]})

        def merge(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
            some = some.sort_values("shard")
            one = _averaged([np.array(s) for s in some["state"]], some["n"].tolist())
            return pd.DataFrame({"shard": [int(key[0])], "state": [one.tolist()], "n": [int(some["n"].sum())]})

        states, many = self._each(learn, schema), self.many
        while many > 1:
            states, many = states.groupBy(F.floor(F.col("shard") / FAN).alias("shard_")).applyInPandas(merge, schema), math.ceil(many / FAN)
        return np.array(states.first()["state"])  # one row

    def without(self, doubtful: Network) -> None:
        """Leaves out others that a network takes for secrets at DOUBT or more."""

        def sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                other = (b["w"].notna() & (b["y"] == 0)).to_numpy()
                ok = np.ones(len(b), bool)
                if other.any():
                    ok[other] = _sigmoid(doubtful.logits(_codes(b["w"][other].tolist()))) < DOUBT
                yield b[ok]

        self.rows = materialize(self.rows.mapInPandas(sure, self.rows.schema), "secret-examples")

    def counts(self, net: Network) -> pd.DataFrame:
        """At most a row a step of a logit and label, whatever the table's size."""
        got = self._each(lambda shard, rows: net.counted(*_part(shard, rows, True)), "at long, y long, n long")
        return got.groupBy("at", "y").agg(F.sum("n").alias("n")).toPandas()


class _AtHand(Shards):
    """Windows at hand as one shard, without Spark."""

    def __init__(self, findings: list[str], others: list[str]):
        windows = [*findings, *others]
        kept = np.arange(len(windows)) % KEPT == 0
        self.rows = pd.DataFrame({"w": pd.Series(windows, dtype=object), "y": np.repeat([1, 0], [len(findings), len(others)]), "n": 1, "kept": kept})

    def round(self, state: np.ndarray, turn: int, kept: bool | None) -> np.ndarray:
        return _passed(0, self.rows, state, turn, kept)[0]

    def without(self, doubtful: Network) -> None:
        ok = (self.rows["y"] == 1).to_numpy()
        if not ok.all():
            ok[~ok] = _sigmoid(doubtful.logits(_codes(self.rows["w"][~ok].tolist()))) < DOUBT
        self.rows = self.rows[ok]

    def counts(self, net: Network) -> pd.DataFrame:
        return net.counted(*_part(0, self.rows, True))


def fit(findings: list[str], others: list[str]) -> Network:
    """A network of windows at hand."""
    return fitted(_AtHand(findings, others))


def fitted(shards: Shards) -> Network:
    """The first network is taught the findings and the made-up ones alone; the second all but those others that the first doubts."""
    first = Network()
    state = first.begun()
    every = shards.rows
    shards.rows = every[every["y"] == 1] if isinstance(every, pd.DataFrame) else every.filter("w is null or y = 1")
    for turn in range(ROUNDS):
        state = shards.round(state, turn, None)
    first.load(state)
    shards.rows = every
    shards.without(first)
    net = Network()
    state = net.begun()
    for turn in range(ROUNDS):
        state = shards.round(state, turn, False)
    net.load(state)
    net.settle(shards.counts(net))
    return net


_SCHEMA = "doc_id long, base array<struct<s:int,e:int,kind:string>>, found array<string>, wide array<struct<s:int,e:int,windows:array<string>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, base, found, wide): the base findings, their windows, and the candidates that no base
    finding touches. One pass over the whole texts; a row for each row of docs, null texts are empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base, found, wide = [], [], []
            for t in b["text"]:
                spans = base_spans(t)
                base.append([{"s": s, "e": e, "kind": k} for s, e, k in spans])
                found.append([w for s, e in values(t, spans) for w in windows(t, s, e)])
                loose = []
                for s, e in candidates(t):
                    if not touched(spans, s, e):
                        loose.append({"s": s, "e": e, "windows": windows(t, s, e)})
                wide.append(loose)
            yield pd.DataFrame({"doc_id": b["doc_id"], "base": base, "found": found, "wide": wide})

    return rows.mapInPandas(look, _SCHEMA)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, base, spans): arrays of structs (s, e, kind), a row for each row of docs.

    base: the base findings; spans: those and the network's. A null or empty text has none; a very long text is searched whole, in
    one task; repeated rows give a row each; a null id is returned as null. Other columns are not read. An empty table gives no row.
    """
    seen = materialize(scan(docs, id_col, text_col), "secret-candidates")
    labelled = lambda column, y: seen.select(F.explode(column).alias("w"), F.lit(y).alias("y"))
    net = fitted(Shards(labelled(F.col("found"), 1).unionByName(labelled(F.flatten("wide.windows"), 0))))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            loose = [c for w in b["wide"] for c in w]
            flat = [x for c in loose for x in c["windows"]]
            first = np.cumsum([0, *(len(c["windows"]) for c in loose)])[:-1]
            yes = iter(np.maximum.reduceat(net.scores(flat), first) >= net.threshold if flat else ())
            spans = []
            for base, wide in zip(b["base"], b["wide"]):
                own = [dict(x) for x in base] + [{"s": c["s"], "e": c["e"], "kind": "model"} for c in wide if next(yes)]
                spans.append(sorted(own, key=lambda x: (x["s"], KINDS.index(x["kind"]))))
            yield pd.DataFrame({"doc_id": b["doc_id"], "base": [[dict(x) for x in y] for y in b["base"]], "spans": spans})

    return seen.select("doc_id", "base", "wide").mapInPandas(judge, "doc_id long, base array<struct<s:int,e:int,kind:string>>, spans array<struct<s:int,e:int,kind:string>>")


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    many = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
