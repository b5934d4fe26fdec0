"""Calls to outside models, as interfaces with deterministic stand-ins. None of them is an implementation of a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Completer(Protocol):
    """What answers a prompt; made once a task."""

    def __call__(self, prompt: str) -> str: ...


def echo() -> Completer:
    """Stand-in: the prompt's last line."""
    return lambda prompt: prompt.strip().rsplit("\n", 1)[-1]


def completed(df: DataFrame, prompt: str, make: Callable[[], Completer] = echo, tries: int = 3) -> DataFrame:
    """``df`` with ``completion`` and ``error``: one client a task; a call that keeps failing is an error of its row, not of the job."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for p in parts:
            out: list[tuple[str | None, str | None]] = []
            for text in p[prompt]:
                err: str | None = None
                for _ in range(max(1, tries)):
                    try:
                        out.append((call(text or ""), None))
                        break
                    except Exception as e:  # noqa: BLE001
                        err = str(e)[:500]
                else:
                    out.append((None, err))
            yield p.assign(completion=[a for a, _ in out], error=[b for _, b in out])

    return df.mapInPandas(run, f"{kinds}, completion string, error string")
