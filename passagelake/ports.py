"""Ports to outside models, and deterministic offline stand-ins for them.

A port is a plain object with the method named; operators call it in batches on the executors.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


class Embedder(Protocol):
    """Texts to vectors, in order; `kind` tells documents from queries."""

    def embed(self, texts: list[str], kind: str) -> list[list[float]]: ...


class Reranker(Protocol):
    """Places of the best top_k documents, best first."""

    def rerank(self, query: str, documents: list[str], top_k: int) -> list[int]: ...


class Completer(Protocol):
    """An answer in text, from instructions and a prompt; judges have the same shape."""

    def complete(self, system: str, user: str) -> str: ...


class Tracer(Protocol):
    """Hears of an evaluation's steps; scores come as a table (step, item_id, metric, value)."""

    def start(self, step: str) -> None: ...

    def end(self, step: str, scores: DataFrame) -> None: ...


class NoTracer:
    """Hears and does nothing."""

    def start(self, step: str) -> None:
        pass

    def end(self, step: str, scores: DataFrame) -> None:
        pass


class TableTracer:
    """Appends each step's scores to a table at a path, as the executors have them, with the seconds the step took."""

    def __init__(self, path: str):
        self.path, self.began = path, {}

    def start(self, step: str) -> None:
        self.began[step] = time.time()

    def end(self, step: str, scores: DataFrame) -> None:
        scores.withColumn("seconds", F.lit(time.time() - self.began.pop(step))).write.mode("append").parquet(self.path)


class HashEmbedder:
    """Signed feature hashing of words, scaled to unit length."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for w in _WORD.findall((text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                row[h % self.dimensions] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class OverlapReranker:
    """By the number of distinct query words that a document holds, then by place."""

    def rerank(self, query: str, documents: list[str], top_k: int) -> list[int]:
        asked = set(_WORD.findall(query.lower()))
        score = [len(asked & set(_WORD.findall(d.lower()))) for d in documents]
        return sorted(range(len(documents)), key=lambda i: (-score[i], i))[:top_k]


class QuotingCompleter:
    """Answers with the first passage's first sentence and its first page, or says it has no ground."""

    def complete(self, system: str, user: str) -> str:
        head = re.search(r"source=(\S+) unit=(\S+) pages=\[([^\]]*)\]", user)
        page = re.search(r"-(\d+)", head[3]) if head else None
        if not page:
            return json.dumps({"grounded": False})
        body = user[head.end() :].partition("\n")[2].strip().partition("\n")[0]
        return json.dumps({"grounded": True, "answer": body, "citations": [{"source": head[1], "unit": head[2], "page": int(page[1])}]})


class AgreeingJudge:
    """Says yes to what has an answer in its prompt."""

    def complete(self, system: str, user: str) -> str:
        yes = bool(user.strip())
        return json.dumps({"faithful": yes, "grounded": yes, "correct": yes, "rationale": "offline"})
