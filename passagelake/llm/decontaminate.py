"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact check.

An item matches a document where some run of the document's words is within (1 - similarity) x (words
of the item) word edits of the item. Words compare in lower case and without ASCII punctuation. Scripts
that set no spaces between words (Chinese, Japanese, Thai, Lao, Khmer, Burmese and others) are cut into
characters, each a word. An item of under five words allows no edit: it is looked up as it stands.

1. Windows. k edits spoil at most k of k + 1 runs of an item's words that don't overlap, so any match holds
   one of them. Of all such choices of runs of min(SEED, ceil((n - k) / (k + 1))) words the one that fewest
   other items share is taken, so openings that thousands of items have in common are not looked for.
   Each run found anchors the item-sized window that lies as the item would around it. Windows without
   a run cannot match, so leaving them out loses nothing.
2. CGK (Chakraborty, Goldenberg, Koucky, STOC 2016). From the run outwards, to either end of the window or for SIDE words, the words
   are walked through; each step writes the word under the pointer, and a random bit of (repetition, step, word) says whether the
   pointer moves. Strings at a small edit distance get embeddings at a small Hamming distance. The chance that a walk stays in step falls with
   length, so the sides of a long item's windows are short, and each of its runs has its own: a match of a
   long item holds many runs, any of which may make it meet.
3. Bit sampling. A repetition hashes SAMPLES positions of a side's embedding. A window meets its item if a
   repetition's hash agrees on either side of a run. REPEATS repetitions, each with its own walk and positions, with the runs
   reach the target recall: the tests measure 0.95 or more of matches at the bound of edits, for 10 to 800 words, by this alone.
4. Counting, for what sampling has missed. An edit spoils at most g of an item's n - g + 1 runs of g words, so
   a match holds n - g + 1 - k g of them at least. An anchored item with so many around its window is
   met too: that loses no match, whatever the item's length.
5. Each pair (document, item) met is verified by exact edit distance of the item to the best run of
   words around the window (Myers' bit-vector algorithm), so nothing wrong is reported.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

SIMILARITY = 0.8
#: Items of fewer words are not looked for: by default only those without any.
MIN_WORDS = 1
SEED = 3
SAMPLES = 3
REPEATS = 24
#: Words on either side of a run that are walked through at most.
SIDE = 16
#: Words of the items that one pass over the documents takes; more items take more passes.
BLOCK_WORDS = 1_000_000
#: Words of the documents that are looked at together.
CHUNK = 400_000
_DROP = string.punctuation.encode()
#: Characters of scripts without spaces between words, and the punctuation that goes with them.
_UNSPACED = re.compile(
    "([\u0e00-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17d3\u17db-\u17ff\u1950-\u19df\u1a20-\u1aad\u2e80-\u2fd5\u3005-\u3007\u3021-\u302f\u3031-\u3035\u3038-\u303c\u3041-\u309f\u30a1-\u30fa\u30fc-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\ua4cf\ua9e0-\ua9fe\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff])"
)
_STOPS = re.compile("[\u0f0b-\u0f14\u104a-\u104f\u17d4-\u17da\u3000-\u3003\u3008-\u3020\u3030\u303d\u30a0\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def normal_words(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:  # only then can it hold such a script
        text = _UNSPACED.sub(r" \1 ", _STOPS.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(None, _DROP).split()


def most_edits(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cgk_hashes(windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bit-sampling hashes of all repetitions, an array (window, repetition).

    windows: a row each, of ids, with -1 past its end; sizes: how many words of the item each stands for.
    Positions are drawn, for each size, from the first 2n of the embedding's 3n: the walk is then past
    the window's end as often as not, and later positions tell windows apart no more.
    """
    out = np.empty((len(sizes), REPEATS), np.uint64)
    order = np.argsort(sizes, kind="stable")
    for at in range(0, len(order), 2048):
        part = order[at : at + 2048]
        out[part] = _walk(windows[part, : sizes[part].max()], sizes[part])
    return out


def _walk(windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n, wide = windows.shape
    codes = np.concatenate([windows, np.full((n, 1), -1)], axis=1).astype(np.int64) + 2
    shares = np.stack([np.sort(np.random.default_rng(1000 + r).random(SAMPLES)) for r in range(REPEATS)])
    picks = np.minimum((shares[None] * 2 * sizes[:, None, None]).astype(np.int64), 2 * sizes[:, None, None] - 1)
    repeat = np.arange(1, REPEATS + 1, dtype=np.uint64)[None, :]
    row, at = np.arange(n)[:, None], np.zeros((n, REPEATS), np.int64)
    out = np.repeat(repeat, n, axis=0)
    for step in range(int(picks.max()) + 1):
        word = codes[row, at].astype(np.uint64)
        for p in range(SAMPLES):
            chosen = picks[:, :, p] == step
            if chosen.any():
                out[chosen] = _mix(out[chosen] * np.uint64(0x9E3779B97F4A7C15) + word[chosen])
        bit = _mix((word << np.uint64(24)) ^ (np.uint64(step << 8) | repeat)) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), wide)
    return out


def outwards(words: np.ndarray, start: np.ndarray, step: int, size: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Rows of size words from start, forward (step 1) or backward (-1), -1 past the size and past the limit (exclusive)."""
    ahead = np.arange(SIDE)[None, :]
    at = start[:, None] + step * ahead
    inside = (ahead < size[:, None]) & (at < limit[:, None] if step > 0 else at > limit[:, None])
    return np.where(inside, words[np.clip(at, 0, len(words) - 1)], -1)


def best_run(item: list, region: list) -> tuple[int, int]:
    """The least edit distance of item to a run of region, and the first end (exclusive) of such a run."""
    n, peq = len(item), {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(region):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full  # a run may start anywhere: no carry into row 0
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _slices(n: np.ndarray, most: int = 1 << 21) -> Iterator[slice]:
    """Consecutive slices of rows, of so many elements together at most; a larger row is a slice alone."""
    upto, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield slice(at, end)
        at = end


def rarest(cost: np.ndarray, width: int, many: int) -> list[int]:
    """The starts of `many` runs of `width` that don't overlap and cost least together; cost: of the run at each place."""
    best, chosen = np.zeros(len(cost) + width), []
    for _ in range(many):  # best[i]: the least that so many runs cost inside the first i places; chosen: the last run's start
        ends = best[: len(cost)] + cost
        low = np.minimum.accumulate(ends)
        at = np.maximum.accumulate(np.where(np.append(True, low[1:] < low[:-1]), np.arange(len(cost)), 0))
        chosen.append(at)
        best = np.concatenate([np.full(width, np.inf), low])
    out, upto = [], len(cost)
    for at in reversed(chosen):
        out.append(int(at[upto - 1]))
        upto = out[-1] - width + 1
    return out[::-1]


class Items:
    """A block of benchmark items, ready for search."""

    def __init__(self, ids: list, texts: list, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, backstop: bool = True):
        self.backstop = backstop
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.words, self.edits = [], [], []
        for i, t in zip(ids, texts):
            w = normal_words(t)
            if len(w) >= max(1, min_words):
                self.ids.append(i)
                self.words.append([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w])
                self.edits.append(most_edits(len(w), similarity))
        self.seeds, self.own, least = {}, {}, []
        every: list[np.ndarray] = []
        self.run = [min(SEED, -(-(len(w) - k) // (k + 1))) for w, k in zip(self.words, self.edits)]
        for w, k, g in zip(self.words, self.edits, self.run):
            least.append(len(w) - g + 1 - k * g)
            every.append(self._gram(np.lib.stride_tricks.sliding_window_view(np.array(w), g)))
        for g in sorted(set(self.run)):
            own = [t for t, x in enumerate(self.run) if x == g]
            keys, shared = np.unique(np.concatenate([np.unique(every[t]) for t in own]), return_counts=True)
            self.own[g] = np.unique(np.concatenate([self._of_item(every[t], np.full(len(every[t]), t)) for t in own]))
            place = {t: rarest(shared[np.searchsorted(keys, every[t])], g, self.edits[t] + 1) for t in own}
            r = sorted((int(every[t][q]), t, q) for t in own for q in place[t])
            grams = np.array([x[0] for x in r], np.uint64)
            keys, first = np.unique(grams, return_index=True)
            near = np.zeros(1 << 18, bool)
            near[(keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
            self.seeds[g] = keys, np.append(first, len(r)), np.array([x[1] for x in r]), np.array([x[2] for x in r]), near
        self.sizes, self.run = np.array([len(w) for w in self.words], np.int64), np.array(self.run, np.int64)
        self.spare, self.least = np.array(self.edits, np.int64), np.maximum(1, np.array(least, np.int64))
        flat = np.array([x for w in self.words for x in w] or [0], np.int64)
        begin = np.cumsum(self.sizes) - self.sizes
        self.sides: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for g, (_, _, item, place, _) in self.seeds.items():  # of each run, to the right and to the left: the words walked through, and the hashes
            right, left = np.minimum(self.sizes[item] - place - g, SIDE), np.minimum(place, SIDE)
            at = begin[item] + place
            self.sides[g] = [
                (right, cgk_hashes(outwards(flat, at + g, 1, right, begin[item] + self.sizes[item]), right)),
                (left, cgk_hashes(outwards(flat, at - 1, -1, left, begin[item] - 1), left)),
            ]

    @staticmethod
    def _gram(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for c in range(rows.shape[1]):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, c].astype(np.uint64))
        return h

    def hits(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, item, begin, met) of each run that an item shares: where the item would start, where its document does, and
        whether a repetition's hashes agree on a side of the run.

        words: ids of the vocabulary, 0 elsewhere; doc: which document each word is of.
        """
        found = [np.zeros((4, 0), np.int64)]
        for g, (keys, first, item, place, near) in self.seeds.items():
            if len(words) < g:
                continue
            known = words > 0
            ok = known[: len(words) - g + 1].copy()
            for c in range(1, g):
                ok &= known[c : len(words) - g + 1 + c]
            ok &= doc[: len(words) - g + 1] == doc[g - 1 :]
            at = np.flatnonzero(ok)
            h = self._gram(np.stack([words[at + c] for c in range(g)], axis=1))
            some = near[(h & np.uint64((1 << 18) - 1)).astype(np.int64)]
            at, h = at[some], h[some]
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            same = keys[slot] == h
            at, slot = at[same], slot[same]
            n = first[slot + 1] - first[slot]
            row = np.repeat(first[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
            at = np.repeat(at, n)
            begins, ends = np.searchsorted(doc, doc[at]), np.searchsorted(doc, doc[at], side="right")
            found.append(np.stack([at - place[row], item[row], begins, self._alike(g, words, at, row, begins, ends)]))
        return tuple(np.concatenate(found, axis=1))

    def _alike(self, g: int, words: np.ndarray, at: np.ndarray, row: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a repetition's hashes agree to the right or left of each run; where neither side has two words, the exact check decides."""
        (right, right_hashes), (left, left_hashes) = self.sides[g]
        out = (right[row] < 2) & (left[row] < 2)
        for size, own, start, step, limit in ((right, right_hashes, at + g, 1, ends), (left, left_hashes, at - 1, -1, begins - 1)):
            some = np.flatnonzero(size[row] >= 2)
            for cut in (some[i : i + (1 << 15)] for i in range(0, len(some), 1 << 15)):
                (place, many), window = np.unique(np.stack([start[cut], size[row[cut]]]), axis=1, return_inverse=True)
                edge = np.empty(len(place), np.int64)
                edge[window] = limit[cut]
                hashes = cgk_hashes(outwards(words, place, step, many, edge), many)
                out[cut] |= (hashes[window] == own[row[cut]]).any(1)
        return out

    def counted(self, words: np.ndarray, doc: np.ndarray, start: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Distinct (start, item) of hits around which as many of the item's runs lie as a match must hold."""
        item, start, begin = np.unique(np.stack([item, np.maximum(start, begin), begin]), axis=1)
        end = np.minimum(start + self.sizes[item] + self.spare[item], np.searchsorted(doc, doc[start], side="right"))
        lo = np.maximum(begin, start - self.spare[item])
        enough = np.zeros(len(start), bool)
        for g in self.seeds:
            rows = np.flatnonzero(self.run[item] == g)
            runs = self._gram(np.lib.stride_tricks.sliding_window_view(words, g)) if len(rows) else None
            n = end[rows] - g + 1 - lo[rows]
            for cut in _slices(n):
                part, many = rows[cut], n[cut]
                first = np.cumsum(many) - many
                at = np.repeat(lo[part] - first, many) + np.arange(many.sum())
                keys = self._of_item(runs[at], np.repeat(item[part], many))
                slot = np.minimum(np.searchsorted(self.own[g], keys), len(self.own[g]) - 1)
                enough[part] = np.add.reduceat(self.own[g][slot] == keys, first, dtype=np.int64) >= self.least[item[part]]
        return np.stack([start, item])[:, enough]

    @staticmethod
    def _of_item(runs: np.ndarray, item: np.ndarray) -> np.ndarray:
        return _mix(runs + item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def meet(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (start, item), by item, of windows that agree in a repetition or, of the others, share enough runs with their item.
        A window that would begin before its document begins at the document's first word."""
        start, item, begin, met = self.hits(words, doc)
        met = met.astype(bool)
        out = [np.stack([np.maximum(start, begin), item])[:, met]]
        if self.backstop and not met.all():
            out.append(self.counted(words, doc, start[~met], item[~met], begin[~met]))
        item, start = np.unique(np.concatenate(out, axis=1)[::-1], axis=1)
        return start, item

    def regions(self, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, from, to): what must be verified, where regions of an item overlap as one."""
        start, item = self.meet(words, doc)
        if not len(start):
            return
        k, n = self.spare[item], self.sizes[item]
        lo = np.maximum(np.searchsorted(doc, doc[start]), start - k)
        hi = np.minimum(np.searchsorted(doc, doc[start], side="right"), start + n + k)
        new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (doc[start[1:]] != doc[start[:-1]]) | (lo[1:] > hi[:-1])]))
        yield from zip(doc[start[new]].tolist(), item[new].tolist(), lo[new].tolist(), np.maximum.reduceat(hi, new).tolist())

    def search(self, texts: list) -> list[tuple[int, int, int, int]]:
        """-> (row, item, edits, end word) of the best match of each item in each text."""
        get, best = self.vocabulary.get, {}
        held, size = [], 0

        def flush():
            if held and self.ids:
                words = np.concatenate([w for _, w in held])
                rows = np.repeat(np.array([r for r, _ in held]), [len(w) for _, w in held])
                for row, t, lo, hi in self.regions(words, rows):
                    k, n = self.edits[t], len(self.words[t])
                    if best.get((row, t), (1, 0))[0] == 0:  # regions go forward: no better match, no earlier end
                        continue
                    d, end = best_run(self.words[t], words[lo:hi].tolist())
                    if d <= k:
                        best[row, t] = min(best.get((row, t), (n + 1, 0)), (d, lo - int(np.searchsorted(rows, row)) + end))
            held.clear()

        for i, text in enumerate(texts):
            w = [get(x, 0) for x in normal_words(text)]
            if w:
                held.append((i, np.array(w, np.int64)))
                size += len(w)
            if size >= CHUNK:
                flush()
                size = 0
        flush()
        return sorted((row, t, d, end) for (row, t), (d, end) in best.items())


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[tuple[list, list]]:
    """The items, as blocks of a bounded number of words. An item of more words is a block alone."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null").orderBy("i", "t").toLocalIterator()
    ids, texts, n = [], [], 0
    for r in rows:
        w = len(normal_words(r.t))
        if ids and n + w > block_words:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        n += w
    if ids:
        yield ids, texts


_prepared: dict[str, "Items"] = {}


def _scan(block: tuple[list, list], similarity: float, min_words: int):
    """A function that searches a worker's texts; a worker prepares a block of items once and keeps the last one."""
    mark = hashlib.sha256(repr((block, similarity, min_words)).encode("utf-8", "surrogatepass")).hexdigest()

    def run(texts: list) -> tuple[Items, list]:
        from passagelake.llm import decontaminate as home

        if mark not in home._prepared:
            home._prepared.clear()
            home._prepared[mark] = Items(*block, similarity, min_words)
        return home._prepared[mark], home._prepared[mark].search(texts)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """-> (doc_id, item_id, edits, similarity, end_word), a row for each document and item it holds.

    The best match counts: the fewest word edits, then the earliest end. Null or empty texts hold
    nothing; null items, those without words and those under min_words are not looked for; repeated items and documents give a row
    each; a null id is returned as null. Other columns are not read. Empty tables give no row.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits long, similarity double, end_word long"
    out = None
    for block in item_blocks(benchmark, item_col, item_text_col):
        run = _scan(block, similarity, min_words)

        def find(batches: Iterator[pd.DataFrame], run=run) -> Iterator[pd.DataFrame]:
            for b in batches:
                items, hits = run(b["text"].tolist())
                if hits:
                    row, t, d, end = zip(*hits)
                    yield pd.DataFrame({"doc_id": b["doc_id"].iloc[list(row)].array, "item_id": [items.ids[x] for x in t], "edits": d, "similarity": [1 - e / len(items.words[x]) for e, x in zip(d, t)], "end_word": end})

        part = rows.mapInPandas(find, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the rows that hold an item; all columns stay, and no row is moved."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_col, item_text_col):
        run = _scan(block, similarity, min_words)

        def keep(batches: Iterator[pa.RecordBatch], run=run) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, hits = run(b.column(place).to_pylist())
                stay = np.ones(b.num_rows, bool)
                stay[[h[0] for h in hits]] = False
                yield b.filter(pa.array(stay))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
