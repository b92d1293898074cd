"""Shared plumbing of the training-data operators: folds, row identity, names, scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many short rows of ids are sent to every task; beyond, both sides of a join shuffle.
BROADCAST_ROWS = 500_000
#: What holds while an operator runs, where the session has Spark's own default: small Arrow
#: batches (a batch exists several times over between the JVM and a worker), and shuffle files
#: that go when the step that wrote them is over.
_WHILE = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("false", "true"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null ids fall in no fold (null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def row_key(*columns: str | Column) -> Column:
    """64-bit key of a row's content.  A row is known by its id and this key together (`same_row`)."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in columns])


def same_row(left: DataFrame, right: DataFrame, key: str = "rk", of: str = "id") -> Column:
    """Rows with equal content keys and equal ids (null equals null)."""
    return (left[key] == right[key]) & left[of].eqNullSafe(right[of])


class Columns:
    """A table under positional names c0, c1, ...: no name of the user's can clash with one of an operator.

    A column is found by its exact name, else by the only one that equals it but for case.  Names
    with dots, repeated names and names that differ in case alone are kept as they are.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.schema = df.schema
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def index(self, name: str) -> int:
        found = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if len(found) != 1:
            raise ValueError(f"{len(found)} columns named {name!r} in {self.names}")
        return found[0]

    def has(self, name: str) -> bool:
        return any(n.lower() == name.lower() for n in self.names)

    def at(self, name: str) -> str:
        return f"c{self.index(name)}"

    def pick(self, *names: str, **more: Column) -> DataFrame:
        """Only these columns, under these names; and more, made of columns named `at(...)`."""
        return self.df.select(*[F.col(self.at(n)).alias(n) for n in names], *[c.alias(n) for n, c in more.items()])

    def back(self, df: DataFrame, *more: str) -> DataFrame:
        """The user's columns of `df` under their own names, then the columns `more`."""
        return df.select(*[f"c{i}" for i in range(len(self.names))], *more).toDF(*self.names, *more)


def pick(df: DataFrame, *names: str) -> DataFrame:
    return Columns(df).pick(*names)


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` less columns of these names, whatever their case."""
    held = Columns(df)
    low = {n.lower() for n in names}
    kept = [i for i, n in enumerate(held.names) if n.lower() not in low]
    return held.df.select(*[f"c{i}" for i in kept]).toDF(*[held.names[i] for i in kept])


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    Where none is set, a folder of our own, on a single machine only: executors elsewhere could
    not read it, so that raises.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not root and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="tessella-"))
    return root or sc._jsc.sc().getCheckpointDir().get()


class Workspace:
    """Scratch tables in the shared checkpoint folder.

    `save` writes a table as Parquet and reads it back, which cuts lineage: a lost executor
    costs a re-read, never a re-run of what came before.  `drop` removes a table that no later
    step reads.  Results that outlive the workspace go through `DataFrame.checkpoint`, whose
    files Spark's own cleaner removes.  Session settings that hold inside are put back at the end.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.before: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def __enter__(self) -> Workspace:
        for k, (usual, held) in _WHILE.items():
            if self.spark.conf.get(k, None) == usual:
                self.before[k] = usual
                self.spark.conf.set(k, held)
        return self

    def __exit__(self, *exc: object) -> None:
        for k, v in self.before.items():
            self.spark.conf.set(k, v)
        self._delete(self.root)


def near(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of short rows, broadcast only where it is counted to have BROADCAST_ROWS or fewer; else left to a shuffle."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def batch_of(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def map_texts(docs: DataFrame, fn: Callable[[pa.Array], list[pa.Array]], added: list[T.StructField], drop: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """`docs` less the columns `drop`, with columns that `fn` makes of the texts of each Arrow batch.

    Columns that are there already under the names added, in any case, are replaced.
    """
    held = Columns(without(docs, *(f.name for f in added)))
    at, gone = held.at(text), {held.at(x) for x in drop}
    kept = [c for c in held.df.columns if c not in gone]
    fields = [T.StructField(c, held.df.schema[c].dataType) for c in kept]
    names = [*kept, *(f.name for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in kept), *fn(batch[at])], names=names)

    out = held.df.mapInArrow(run, T.StructType([*fields, *added]))
    return out.toDF(*(held.names[held.df.columns.index(c)] for c in kept), *(f.name for f in added))
