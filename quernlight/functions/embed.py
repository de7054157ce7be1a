"""Embedding providers by name; the default hashes tokens, offline."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = (384, 512, 768, 1024, 1536, 3072)
PROVIDERS: dict[str, Callable[[list[str], int], np.ndarray]] = {}


def provider(name: str):
    def add(f):
        PROVIDERS[name] = f
        return f

    return add


@provider("hashing")
def hashing(texts: list[str], dim: int) -> np.ndarray:
    """Signed hashes of words, summed and normalised."""
    import re

    from xxhash import xxh3_64_intdigest

    out = np.zeros((len(texts), dim), np.float32)
    for k, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = xxh3_64_intdigest(w)
            out[k, h % dim] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed(text: Column, dim: int = 384, name: str = "hashing") -> Column:
    """array<float> of each text, in Arrow batches."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}; there are {sorted(PROVIDERS)}")
    model = PROVIDERS[name]

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model(texts.fillna("").tolist(), dim)))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<float>")(text)
