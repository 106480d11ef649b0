"""Vectors of texts: a pluggable embedder, and one that needs no model."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: What stands before a text, by what it is for; longest text embedded.
PREFIX = {"query": "search_query: ", "document": "search_document: "}
LONGEST = 7000

#: Texts to vectors of one length.
Embedder = Callable[[Sequence[str]], np.ndarray]


def hashing_embedder(dim: int = 768) -> Embedder:
    """Signed counts of words and of their groups of three characters, hashed to ``dim`` places, of length 1."""
    word = re.compile(r"[A-Za-z_]\w*|\d+")

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in word.findall(text):
                w = f"<{w.lower()}>"
                for part, weight in ((w, 1.0), *((w[i : i + 3], 0.3) for i in range(len(w) - 2))):
                    h = crc32(part.encode())
                    row[h % dim] += weight if h >> 31 else -weight
            length = np.linalg.norm(row)
            if length:
                row /= length
        return out

    return embed


def embed(text: Column | str, embedder: Embedder, kind: str = "document") -> Column:
    """array<float> of each text; a null text gives null."""
    prefix = PREFIX[kind]

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        there = texts.notna()
        vectors = iter(embedder([(prefix + t)[:LONGEST] for t in texts[there]]))
        return pd.Series([next(vectors).tolist() if x else None for x in there], index=texts.index, dtype=object)

    return run(text)


def embed_one(text: str, embedder: Embedder, kind: str = "query") -> list[float]:
    return [float(x) for x in embedder([(PREFIX[kind] + text)[:LONGEST]])[0]]
