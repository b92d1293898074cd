"""Model ports: embeddings and chat are callables; the defaults are deterministic and offline."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame

from .conf import DEFAULT, EngineConf

Embedder = Callable[[list[str]], list[list[float]]]
Chat = Callable[[str], str]


@lru_cache(maxsize=1 << 17)
def _word_hash(w: str) -> int:
    return int(hashlib.md5(w.encode()).hexdigest()[:8], 16)


def hash_embedder(dims: int) -> Embedder:
    """Words hashed into `dims` cells, unit length: equal texts, equal vectors.  A worker hashes a common word once."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            hashes = np.fromiter(map(_word_hash, re.findall(r"[a-z0-9]+", t.lower())), np.int64)
            out[i] = np.bincount(hashes % dims, minlength=dims)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0).tolist()

    return embed


def extractive_chat(prompt: str) -> str:
    """The first passage of the prompt with its number: a stand-in for generation in tests."""
    m = re.search(r"^\[(\d+)\] [^\n]*\n([^\n]+)", prompt, re.M)
    return f"{m[2].strip()} [{m[1]}]" if m else "I do not know."


def extractive_stream(prompt: str) -> Iterator[str]:
    """`extractive_chat` piece by piece: each word with the blanks after it."""
    yield from re.findall(r"\S+\s*|\s+", extractive_chat(prompt))


def is_rate_limit(message: str) -> bool:
    return re.search(r"(?i)429|rate.?limit|quota|resource.?exhausted|empty embedding", message) is not None


def with_retry(fn: Callable, retries: int, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[float, float], float] = random.uniform) -> Callable:
    """Calls again, after growing delays, only on rate limits; other errors pass through at once.

    A delay is up to a quarter longer than its turn's, so that many tasks do not come back together.
    """

    def call(*args):
        for attempt in range(retries + 1):
            try:
                return fn(*args)
            except Exception as error:
                if attempt == retries or not is_rate_limit(str(error)):
                    raise
                sleep(min(30_000, 500 * 2**attempt) / 1000 * jitter(1, 1.25))

    return call


#: Texts that one embedding task takes: what a lost task repeats.
EMBED_TASK_ROWS = 2_048


def dealt(df: DataFrame, rows: int, conf: EngineConf = DEFAULT, by: str | None = None) -> DataFrame:
    """`df` of so many rows over tasks that embed some thousand texts each; by the hash of `by`, which needs no sort of the rows."""
    return df.repartition(max(conf.embed_concurrency, -(-rows // EMBED_TASK_ROWS)), *([by] if by else []))


def embed_column(df: DataFrame, text: str, embedder: Embedder, conf: EngineConf = DEFAULT, out: str = "embedding", errors: str | None = None, rows: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """`df` with an embedding of `text`: batches of embed_batch_size texts, vectors checked and conformed.

    The `rows` (where told) are dealt to tasks of some thousand texts, so a lost task repeats few
    calls; a task keeps embed_concurrency calls in flight, and `profile` is Spark's own bound of how
    many tasks of this stage an executor runs at a time.  Empty vectors are counted over a batch and
    raise as a rate limit, so that the call is tried again.

    With `errors`, a column of that name holds why a text has no embedding: a batch that fails is
    tried again text by text, and only the texts that fail alone are marked.  Without it they raise.
    """

    def full(texts: list[str]) -> list[list[float]]:
        got = embedder(texts)
        if none := sum(not len(v) for v in got):
            raise ValueError(f"rate limit: {none} empty embeddings of {len(got)}")
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
        return [conformed(v) for v in got]

    size, dims, call = conf.embed_batch_size, conf.embedding_dimensions, with_retry(full, conf.embed_max_retries)
    if rows is not None:
        df = dealt(df, rows, conf)
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    schema = f"{fields}, `{out}` array<float>" + (f", `{errors}` string" if errors else "")

    def conformed(v: list[float]) -> list[float]:
        if len(v) < dims:
            raise ValueError(f"vector of {len(v)} is shorter than {dims}")
        x = np.asarray(v[:dims], dtype=np.float64)
        n = np.linalg.norm(x)
        return (x / n if n else x).tolist()

    def tried(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(v, None) for v in call(texts)]
        except Exception as error:
            if not errors:
                raise
            return [(None, str(error))] if len(texts) == 1 else [r for t in texts for r in tried([t])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max_workers=conf.embed_concurrency) as pool:
            for batch in batches:
                texts = [t or "" for t in batch[text].to_pylist()]
                got = [r for part in pool.map(tried, [texts[lo : lo + size] for lo in range(0, len(texts), size)]) for r in part]
                more = [pa.array([v for v, _ in got], pa.list_(pa.float32()))] + ([pa.array([e for _, e in got], pa.string())] if errors else [])
                yield pa.RecordBatch.from_arrays([*(batch[k] for k in names), *more], names=[*names, out] + ([errors] if errors else []))

    return df.mapInArrow(run, schema, profile=profile)
