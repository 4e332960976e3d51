"""Text generation as an interface (U-1..U-4). The default backend is a deterministic mock; nothing here needs a network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mock_backend(prompts: list[str]) -> list[str]:
    """A boxed number by hash of the prompt."""
    return [f"Therefore \\boxed{{{int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % 7}}}" for p in prompts]


def yes_no_backend(prompts: list[str]) -> list[str]:
    """Yes or No by hash of the prompt."""
    return ["No" if int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % 2 else "Yes" for p in prompts]


def generator(backend: Callable[[list[str]], list[str]] = mock_backend, retries: int = 2, wait: float = 0.0):
    """An iterator UDF over a backend that is set up once per task. A failing batch is retried after ``wait`` seconds, twice as
    long each time, then halved; a prompt that fails alone gives null, never a missing row. Calls at one time are as many
    as tasks run at one time."""

    def call(prompts: list[str]) -> list[str | None]:
        for n in range(retries):
            try:
                return backend(prompts)
            except Exception:  # noqa: BLE001  the backend's own failures, reported as null
                time.sleep(wait * 2**n)
        if len(prompts) <= 1:
            return [None] * len(prompts)
        mid = len(prompts) // 2
        return call(prompts[:mid]) + call(prompts[mid:])

    @F.pandas_udf("string")
    def generate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(call(s.tolist()), index=s.index, dtype=object)

    return generate


def fan_out(df: DataFrame, n: int) -> DataFrame:
    """U-3: ``n`` samples per row."""
    return df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def ask(df: DataFrame, prompt, generate, parse: dict) -> DataFrame:
    """U-2: one prompt -> generate -> parse step: ``df`` with ``reply`` and a column for every parser of the reply."""
    out = df.withColumn("reply", generate(prompt))
    return out.withColumns({name: f(F.col("reply")) for name, f in parse.items()})


def hash_vectors(texts: list[str], dim: int = 16) -> list[list[float]]:
    """A mock embedding: bytes of a digest, centred."""
    return [[b - 127.5 for b in hashlib.shake_128(t.encode()).digest(dim)] for t in texts]


def embedder(backend: Callable[[list[str]], list[list[float]]] = hash_vectors, dim: int = 16, batch: int = 256):
    """O-42: an iterator UDF from texts to vectors of length 1. A failing batch is halved; a text that fails alone, like a null
    one, gives the zero vector. Rows done before are left out by an anti join (`writers.remaining`)."""
    import numpy as np

    def call(texts: list[str]) -> list[list[float]]:
        try:
            return backend(texts)
        except Exception:  # noqa: BLE001  the backend's own failures, reported as zero vectors
            if len(texts) == 1:
                return [[0.0] * dim]
            mid = len(texts) // 2
            return call(texts[:mid]) + call(texts[mid:])

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            there, out = [i for i, t in enumerate(s) if t is not None], [[0.0] * dim for _ in range(len(s))]
            for at in range(0, len(there), batch):
                for i, v in zip(there[at : at + batch], call([s.iloc[i] for i in there[at : at + batch]])):
                    n = float(np.linalg.norm(v))
                    out[i] = [x / n for x in v] if n else [0.0] * dim
            yield pd.Series(out, index=s.index, dtype=object)

    return embed


def plugin(path: str, name: str, kind: str = "double", batched: bool = True):
    """R-16 / U-7: a UDF of the function ``name`` in a Python file of the caller's own; ``path:name`` is how users give it.

    The source travels to the workers, which need not see the file. Batched, the function takes lists of its arguments and
    returns a list; otherwise it is called row by row.
    """
    with open(path, encoding="utf-8") as f:
        source = f.read()
    made: dict = {}

    def function():
        if not made:
            exec(compile(source, path, "exec"), made)  # noqa: S102  the caller's own code, as asked
        return made[name]

    if name not in {x.split("(")[0].removeprefix("def ").strip() for x in source.splitlines() if x.startswith("def ")}:
        raise AttributeError(f"{path} has no function {name}")

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        f = function()
        values = [c.tolist() for c in columns]
        return pd.Series(f(*values) if batched else [f(*row) for row in zip(*values)])

    return run
