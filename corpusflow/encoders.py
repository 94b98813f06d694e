"""Places where models plug in, each with a deterministic stand-in that needs no download.

The stand-ins make every operator testable offline; they are not as good as trained models and don't pretend to be.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class TokenEncoder(Protocol):
    name: str

    def encode_tokens(self, texts: list[str]) -> list[np.ndarray]: ...


class Reranker(Protocol):
    def score(self, question: str, passages: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, system: str, prompt: str, timeout: float = 60.0) -> str: ...

    def ping(self) -> str: ...


class HashingEncoder:
    """Feature hashing of lower-case words to ``width`` signed sums, as a unit vector; blank texts give zeros."""

    def __init__(self, width: int = 256):
        self.width, self.name = width, f"hashing-{width}"

    def _features(self, text: str) -> list[tuple[int, float]]:
        hashes = [xxhash.xxh3_64_intdigest(w) for w in text.lower().split()]
        return [(h % self.width, 1.0 if h >> 63 else -1.0) for h in hashes]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), dtype=np.float32)
        for i, text in enumerate(texts):
            for at, sign in self._features(text or ""):
                out[i, at] += sign
        return out / (np.sqrt((out * out).sum(axis=1, keepdims=True)) + 1e-9)

    def encode_tokens(self, texts: list[str], most: int = 256) -> list[np.ndarray]:
        """One unit vector per word, of the first ``most`` words."""
        found = []
        for text in texts:
            words = (text or "").split()[:most]
            found.append(self.encode(words) if words else np.zeros((0, self.width), dtype=np.float32))
        return found


class RemoteEncoder:
    """An HTTP endpoint that takes {"input": [...], "model": ...} and returns {"data": [{"embedding": [...]}]}."""

    def __init__(self, url: str, model: str, key_variable: str = "EMBEDDING_API_KEY", timeout: int = 60):
        self.url, self.name, self.key_variable, self.timeout = url, model, key_variable, timeout

    def encode(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, 0), dtype=np.float32)
        reply = _post(self.url, {"input": texts, "model": self.name}, os.environ[self.key_variable], self.timeout)
        return np.array([d["embedding"] for d in reply["data"]], dtype=np.float32)


class OfflineGenerator:
    """Returns the first sentence of every context block with its number."""

    def generate(self, system: str, prompt: str, timeout: float = 60.0) -> str:
        context = prompt.split("Context:\n", 1)[-1]
        lines = [b for b in context.split("\n\n") if b.startswith("[")]
        said = []
        for block in lines:
            number, _, text = block.partition("] ")
            first = text.replace("\n", " ").split(". ")[0].strip().rstrip(".")
            said.append(f"{first} {number}].")
        return " ".join(said) or "I do not know."

    def ping(self) -> str:
        return "ok"


class RemoteGenerator:
    """A chat-completion endpoint; address and key come from the environment only."""

    def __init__(self, model: str | None = None):
        self.url, self.key = os.environ["GENERATOR_BASE_URL"], os.environ["GENERATOR_API_KEY"]
        self.model = model or os.environ.get("GENERATOR_MODEL", "default")

    def generate(self, system: str, prompt: str, timeout: float = 60.0) -> str:
        messages = [dict(zip(("role", "content"), part)) for part in (("system", system), ("user", prompt)) if part[1]]
        reply = _post(f"{self.url.rstrip('/')}/chat/completions", {"model": self.model, "messages": messages}, self.key, timeout)
        choice = (reply.get("choices") or [{}])[0]
        return ((choice.get("message") or {}).get("content") or choice.get("text") or "").strip()

    def ping(self) -> str:
        try:
            return self.generate("", "Say ok.", 10)
        except Exception as error:  # a smoke call reports instead of raising
            return f"Error: {error}"


def _post(url: str, body: dict, key: str, timeout: int) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def document_prefix(model: str) -> str:
    """Models of some families want to be told what a text is."""
    return "passage: " if any(x in model.lower() for x in ("e5", "bge")) else ""


QUERY_PREFIX = "query: "
BATCH = 64


def encode_column(encoder: Encoder, text: Column, prefix: str | None = None) -> Column:
    """``text`` as vectors, in batches; the encoder is made once per worker and never sees more than ``BATCH`` texts.

    Each text that isn't empty follows ``prefix``, by default that of the encoder's documents.
    """
    prefix = document_prefix(encoder.name) if prefix is None else prefix

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [prefix + (t or "") if t else "" for t in batch.tolist()]
            rows: list = []
            for start in range(0, len(texts), BATCH):
                rows += list(encoder.encode(texts[start : start + BATCH]))
            yield pd.Series(rows, index=batch.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)


def encode_tokens_column(encoder: TokenEncoder, text: Column) -> Column:
    """``text`` as one vector per token."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[list(map(float, v)) for v in m] for m in encoder.encode_tokens(batch.fillna("").tolist())], index=batch.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<array<float>>")(text)


def rerank(ranked: DataFrame, reranker: Reranker, pool: int, topn: int) -> DataFrame:
    """``ranked`` (query_id, item, rank, question, passage) by the scores of a model, one call per query."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        scores = reranker.score(group["question"].iloc[0], [p[:2000] for p in group["passage"].fillna("")])
        group = group.assign(score=np.asarray(scores, dtype=float)).sort_values(["score", "rank"], ascending=[False, True]).head(topn)
        return group.assign(rank=np.arange(1, len(group) + 1, dtype=np.int32))[["query_id", "item", "rank", "score"]]

    rows = ranked.where(F.col("rank") <= pool).select("query_id", "item", "rank", "question", "passage")
    return rows.groupBy("query_id").applyInPandas(run, "query_id bigint, item bigint, rank int, score double")
