"""Extension points: models as functions over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.functions import text as T

TokenCounter = Callable[[Column], Column]
DEFAULT_COUNTER: TokenCounter = T.token_count


def embedder(load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 64):
    """A column function from texts to vectors; ``load`` runs once in each Python worker."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch_size)


def hashing_embedder(dim: int = 64):
    """A stand-in embedder without a model: hashed bags of words of unit length."""

    def load():
        import zlib

        def embed(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, text in enumerate(texts):
                for word in str(text).lower().split():
                    out[i, zlib.crc32(word.encode()) % dim] += 1
            return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)

        return embed

    return load


def text_hook(fn: Callable[[list[str]], list[str]]):
    """A column function from prompts to texts: summarizers, compressors, answerers."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(fn(texts.fillna("").tolist()), index=texts.index, dtype=object)

    return run


def judge_hook(fn: Callable[[pd.DataFrame], list[tuple[bool, str]]]):
    """``judge(question, answer, reference)`` as a column (correct, reason); a failing batch counts as false."""

    @F.pandas_udf("correct boolean, reason string")
    def run(question: pd.Series, answer: pd.Series, reference: pd.Series) -> pd.DataFrame:
        frame = pd.DataFrame({"question": question, "answer": answer, "reference": reference})
        try:
            found = fn(frame)
        except Exception as problem:  # the hook's own failures become verdicts
            found = [(False, f"{type(problem).__name__}: {problem}")] * len(frame)
        return pd.DataFrame(found, columns=["correct", "reason"])

    return run


def batch_hook(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any function over batches of rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield fn(part)

    return rows.mapInPandas(run, schema)
