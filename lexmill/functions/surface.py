"""The user-function surface: named transforms, scorers and error-safe batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]
TRANSFORMS: dict[str, Transform] = {}


def transform(name: str) -> Callable[[Transform], Transform]:
    """Register a DataFrame step under a name."""

    def add(f: Transform) -> Transform:
        TRANSFORMS[name] = f
        return f

    return add


def apply(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.transform(TRANSFORMS[n])
    return df


class Scorer(Protocol):
    """Scores batches: a pandas frame in, one with the declared columns out."""

    schema: str

    def score(self, batch: pd.DataFrame) -> pd.DataFrame: ...


class LexiconScorer:
    """Labels by words: (text) -> label, confidence."""

    schema = "label string, confidence double"

    def __init__(self, words: dict[str, list[str]]):
        self.words = words

    def score(self, batch: pd.DataFrame) -> pd.DataFrame:
        def one(t: str | None) -> tuple[str, float]:
            low = (t or "").lower()
            hits = {k: sum(w in low for w in ws) for k, ws in self.words.items()}
            best = max(hits, key=hits.get, default="none")
            return (best, min(1.0, 0.5 + 0.25 * hits[best])) if hits and hits[best] else ("none", 0.0)

        return pd.DataFrame([one(t) for t in batch["text"]], columns=["label", "confidence"])


def run_scorer(df: DataFrame, scorer: Scorer, keys: list[str]) -> DataFrame:
    """Keys, the scorer's columns and an error. A batch that fails is scored again row by row, so only the rows
    that fail by themselves have nulls and an error; a scorer that returns another number of rows has failed."""
    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    names = [c.split()[0] for c in scorer.schema.split(", ")]

    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        out = scorer.score(rows).reset_index(drop=True)
        if len(out) != len(rows):
            raise ValueError(f"{len(out)} scores for {len(rows)} rows")
        return out.assign(error=None)

    def one(row: pd.DataFrame) -> pd.DataFrame:
        try:
            return scored(row)
        except Exception as e:  # noqa: BLE001  a user's scorer may raise anything
            return pd.DataFrame(None, index=range(1), columns=names).assign(error=repr(e))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            try:
                out = scored(b)
            except Exception:  # noqa: BLE001
                out = pd.concat([one(b.iloc[i : i + 1].reset_index(drop=True)) for i in range(len(b))], ignore_index=True)
            yield pd.concat([b[keys], out[[*names, "error"]]], axis=1)

    return df.mapInPandas(run, ", ".join([*fields, scorer.schema, "error string"]))
