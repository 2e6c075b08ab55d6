"""Model calls: any Python callable, run on the executors; a rule stub when offline."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

DEFAULT_CONTEXT = 40960


def context_length(served: int | None, default: int = DEFAULT_CONTEXT) -> int:
    """The context that a server reports, or the default."""
    return served if served and served > 0 else default


def structured_call(model: Callable[[str], str], prompt: str, required: tuple[str, ...]) -> tuple[dict, int]:
    """The model's JSON answer and the attempts it took; one retry, then the error is raised."""
    for attempt in (1, 2):
        try:
            answer = json.loads(model(prompt))
            if missing := [k for k in required if k not in answer]:
                raise ValueError(f"answer lacks {missing}")
            return answer, attempt
        except ValueError:
            if attempt == 2:
                raise
    raise AssertionError


def call_model(df: DataFrame, model: Callable[[str], str], prompt_column: str = "prompt", concurrency: int = 8) -> DataFrame:
    """``df`` with answer; at most ``concurrency`` calls run at once.

    The rows are dealt anew, so that what made them keeps its own parallelism.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(answer=[model(p) for p in f[prompt_column]])

    schema = ", ".join(f"`{k}` {v}" for k, v in df.dtypes) + ", answer string"
    return df.repartition(concurrency).mapInPandas(run, schema)


def route_model(purpose: str, policy: dict[str, str], local: str, private: bool) -> str:
    """The model for a purpose; private books never leave the local one."""
    return local if private else policy.get(purpose, local)
