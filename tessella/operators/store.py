"""Versioned keyed tables in Parquet, and the chunk store on top.

A table is a folder of data folders and of numbered pointers.  A writer writes new data in full
and then its pointer, under the next number, by a rename that fails where the number is taken
already; a reader follows the pointer of the highest number.  A failed or lost job, at whatever
point, leaves the old version as it was, and of two writers that began from one version the
second raises.  Rows are bucketed by key hash: a mutation reads and rewrites only the buckets
its keys fall into, the rest are carried over by reference.  A bucket that gets rows of new keys
alone keeps its data and gets a further folder, up to MOST_PIECES.  The number of buckets is part of
the pointer, chosen by the bytes of the first write and doubled when a table outgrows it.

Beside the versions that are kept, a mutation needs the disk of one exchange of the rows it
rewrites: old rows, new ones and keys to drop are dealt to their buckets together, and what is
left of a key is decided there.  Where keys are only dropped, a large table is rewritten some
buckets at a time, so the exchange does not grow with it.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..conf import DEFAULT, EngineConf
from . import retrieval

#: Bytes of Parquet that a bucket should hold, and buckets at most (a pointer names each).
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 1 << 16
#: Folders of a bucket at most; buckets of an upsert that are rewritten without asking which of them have its keys.
MOST_PIECES, SMALL_BYTES = 8, 16 << 20
#: Pointers that stay readable behind the current one; data that only older ones name is removed.
KEPT_VERSIONS = 2
#: A data folder that no pointer names is a running write's for so long, then an orphan; tries of a read-modify-write.
ORPHAN_SECONDS, TRIES = 24 * 3600, 20
#: Buckets that a deletion rewrites at a time hold so many bytes at least, and are so many for each core.
ROUND_BYTES, ROUND_TASKS = 1 << 30, 2
#: Parquet of tables and of scratch tables: texts take two thirds of what they do with Spark's default codec.
CODEC = "zstd"
#: Buckets are dealt over so many times their number of tasks, so that few tasks get two.
SPREAD = 2
#: What a row is to a mutation, the stronger the higher: stored, a key to drop, new, a key that no new row may have.
_OLD, _GONE, _NEW, _OUT = range(4)


class ConflictError(RuntimeError):
    """Another writer moved the table on since this one read it."""


@dataclass(frozen=True)
class Written:
    """Rows that an upsert need not write first: they read a table (at `path`) that stays as it is meanwhile.

    A row whose key is among `without` is left out, as if it were not among the rows.
    """

    rows: DataFrame
    path: str
    without: DataFrame | None = None


@contextmanager
def shuffles_go(*sessions: SparkSession) -> Iterator[None]:
    """Shuffle files of a job go when it is over, not when the driver next collects garbage; a session's own setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = [(s, s.conf.get(name)) for s in sessions]
    for s in sessions:
        s.conf.set(name, "true")
    try:
        yield
    finally:
        for s, value in reversed(before):
            s.conf.set(name, value)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16, dealt_by: str | None = None):
        """`buckets` is the least number of a new table; an existing one keeps its own.

        Rows are dealt to buckets by `dealt_by`, a column that the key determines (else by the key).
        """
        self.spark, self.path, self.key, self.buckets, self.dealt_by = spark, path.rstrip("/"), key, buckets, dealt_by or key

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/versions")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n) for n in names if n.isdigit())

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _pointer(self) -> dict | None:
        """Version, schema, number of buckets, and the folders and bytes of each bucket that has rows."""
        found = self._versions()
        return json.loads(self._text(f"{self.path}/versions/{found[-1]}")) if found else None

    @staticmethod
    def _paths(pointer: dict, only: set[int] | None = None) -> list[str]:
        """Data folders of the buckets of a version; older pointers name one for each bucket."""
        return sorted({p for k, b in pointer["buckets"].items() if only is None or int(k) in only for p in b.get("paths") or [b["path"]]})

    def _publish(self, pointer: dict, after: dict | None) -> None:
        number = (after["version"] if after else 0) + 1
        fs, fresh = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        _, to = self._fs(f"{self.path}/versions/{number}")
        out = fs.create(fresh)
        out.write(bytearray(json.dumps(pointer | {"version": number}).encode()))
        out.close()
        if fs.exists(to) or not fs.rename(fresh, to):
            fs.delete(fresh, False)
            raise ConflictError(f"version {number} of {self.path} is there already")
        self._expire(number)

    def _expire(self, number: int) -> None:
        """Remove old pointers, and data folders that no kept one names."""
        fs, _ = self._fs(self.path)
        old = [v for v in self._versions() if v <= number - KEPT_VERSIONS - 1]
        if not old:
            return
        kept = [json.loads(self._text(f"{self.path}/versions/{v}")) for v in self._versions() if v not in old]
        used = {p for k in kept for p in self._paths(k)}
        for v in old:
            for p in self._paths(json.loads(self._text(f"{self.path}/versions/{v}"))):
                if p not in used:
                    fs.delete(self._fs(p)[1], True)
            fs.delete(self._fs(f"{self.path}/versions/{v}")[1], False)
        self._collect_orphans({p.rsplit("/", 1)[0] for p in used})

    def _collect_orphans(self, used: set[str]) -> None:
        """Remove folders of writes that broke off or lost a race: named by no kept pointer, and older than any running write."""
        fs, root = self._fs(self.path)
        young = time.time() * 1000 - ORPHAN_SECONDS * 1000
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            if name[:2] in ("v-", "s-") and f"{self.path}/{name}" not in used and f.getModificationTime() < young:
                fs.delete(f.getPath(), True)

    def exists(self) -> bool:
        return self._pointer() is not None

    def read(self, schema: str | None = None) -> DataFrame:
        """Current rows; a table never written is empty (with `schema`)."""
        at = self._pointer()
        if at is None:
            if schema is None:
                raise FileNotFoundError(self.path)
            return self.spark.createDataFrame([], schema)
        return self._in(at, None)

    def snapshot(self, schema: str | None = None, **only: object) -> tuple[DataFrame, dict | None]:
        """Current rows and the version they are of, to be handed to the write that they lead to.

        `only` is the value of the column that rows are dealt by: then one bucket is read.
        """
        at = self._pointer()
        if at is None or not only:
            return (self.read(schema) if at is None else self._in(at, None)), at
        ((name, value),) = only.items()
        if name != self.dealt_by:
            raise ValueError(f"rows are dealt by {self.dealt_by}, not by {name}")
        kind = next(f.dataType for f in StructType.fromJson(at["schema"]) if f.name == name)
        number = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(value).cast(kind)), F.lit(at["n"]))).first()[0]
        return self._in(at, {int(number)}).where(F.col(name) == F.lit(value)), at

    def update(self, change: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]], schema: str | None = None, **only: object) -> None:
        """Read, change, write: `change` makes rows to upsert (and keys to drop) of the current ones, again after another writer came first."""
        for attempt in range(TRIES):
            rows, at = self.snapshot(schema, **only)
            made = change(rows)
            rows, drop = made if isinstance(made, tuple) else (made, None)
            try:
                return self.upsert(rows, drop=drop, after=at or {})
            except ConflictError:
                if attempt == TRIES - 1:
                    raise
                time.sleep(random.uniform(0, 0.05 * 2 ** min(attempt, 6)))

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.dealt_by), F.lit(n)).cast("int")

    def _in(self, at: dict, touched: set[int] | None) -> DataFrame:
        kind = StructType.fromJson(at["schema"])
        paths = self._paths(at, touched)
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def _bytes(self, path: str) -> int:
        fs, p = self._fs(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def _rewrite(self, rows: DataFrame | list[DataFrame], touched: set[int] | None, at: dict | None, n: int, into: int | None = None, left: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Write `rows` as the buckets `touched` (None: all) of n, and move the pointer; rows of other buckets come beside what these have.

        `into` is the number of buckets that get rows at a time, where it is not that of `touched`; `left`
        takes the rows once they lie with their buckets (_bucket).  Several `rows`, each of buckets
        of its own, are written one after another.
        """
        folder = f"{self.path}/v-{uuid.uuid4().hex}"
        into = into or (n if touched is None else len(touched))
        for some in rows if isinstance(rows, list) else [rows]:
            dealt = some.withColumn("_bucket", self._bucket(n)).repartition(SPREAD * into if into > 1 else 1, "_bucket")
            dealt = left(dealt) if left else dealt
            dealt.write.mode("append").option("compression", CODEC).partitionBy("_bucket").parquet(folder)
        kept = {} if touched is None or at is None else {k: v for k, v in at["buckets"].items() if int(k) not in touched}
        fs, root = self._fs(folder)
        for f in fs.listStatus(root) if fs.exists(root) else []:
            name = f.getPath().getName()
            if name.startswith("_bucket="):
                k, path = name.removeprefix("_bucket="), f"{folder}/{name}"
                beside = kept.get(k)
                kept[k] = {"paths": [*(self._paths({"buckets": {k: beside}}) if beside else []), path], "bytes": (beside["bytes"] if beside else 0) + self._bytes(path)}
        self._publish({"schema": dealt.drop("_bucket").schema.jsonValue(), "n": n, "buckets": kept}, at)

    def _together(self, old: DataFrame | None, new: DataFrame | None, gone: DataFrame | None, out: DataFrame | None = None) -> DataFrame:
        """Old and new rows, and keys that are `gone` or `out`, with what they are to `_left` (_is)."""
        rows = [df.withColumn("_is", F.lit(k)) for df, k in ((old, _OLD), (new, _NEW)) if df is not None]
        both = rows[0].unionByName(rows[1]) if len(rows) > 1 else rows[0]
        kinds = {f.name: f.dataType for f in both.schema}
        for keys, k in ((gone, _GONE), (out, _OUT)):
            if keys is not None:
                named = [F.col(c).cast(kinds[c]).alias(c) for c in dict.fromkeys([self.key, self.dealt_by])]
                both = both.unionByName(keys.select(*named, F.lit(k).alias("_is")), allowMissingColumns=True)
        return both

    def _left(self, order: str | None = None, out: bool = False) -> Callable[[DataFrame], DataFrame]:
        """What is left of each key: a new row (the last by `order`, else any) unless the key is `out`, or else the old one unless it is `gone`."""
        by = Window.partitionBy("_bucket", self.key).orderBy(F.col("_is").desc(), *([F.col(order).desc()] if order else []))

        def left(dealt: DataFrame) -> DataFrame:
            if out:
                dealt = dealt.withColumn("_n", F.first("_is").over(by)).where(f"_n < {_OUT} or _is < {_NEW}")
            return dealt.withColumn("_n", F.row_number().over(by)).where(f"_n = 1 and _is <> {_GONE}").drop("_n", "_is")

        return left

    def _rounds(self, at: dict, touched: set[int]) -> list[set[int]]:
        """`touched` in groups to be rewritten one after another."""
        rounds, size, least = [set()], 0, ROUND_TASKS * self.spark.sparkContext.defaultParallelism
        for k in sorted(touched):
            if rounds[-1] and size >= ROUND_BYTES and len(rounds[-1]) >= least:
                rounds, size = [*rounds, set()], 0
            rounds[-1].add(k)
            size += at["buckets"][str(k)]["bytes"]
        return rounds

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """The rows written once: whatever made them (an embedder, say) runs once, and every later step reads the same."""
        path = f"{self.path}/s-{uuid.uuid4().hex}"
        rows.write.option("compression", CODEC).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def upsert(self, rows: DataFrame | Written, order: str | None = None, drop: DataFrame | None = None, after: dict | None = None) -> None:
        """Insert or replace by key; of rows with one key the last by `order` (else any) stays.

        Keys of `drop` (rows with the key, and the column rows are dealt by) that are not among the
        new ones go in the same version.  With `after`, what `snapshot` told (an empty one: no table
        yet), it raises ConflictError unless that is still the current version.
        """
        if isinstance(rows, Written):
            return self._apply(rows.rows, order, drop, self._bytes(rows.path), after, rows.without)
        staged, path = self._staged(rows)
        try:
            self._apply(staged, order, drop, self._bytes(path), after)
        finally:
            self._fs(path)[0].delete(self._fs(path)[1], True)

    def _apply(self, rows: DataFrame, order: str | None, drop: DataFrame | None, size: int, after: dict | None, out: DataFrame | None = None) -> None:
        at = self._pointer()
        if after is not None and (at or {}).get("version") != after.get("version"):
            raise ConflictError(f"{self.path} is no longer at the version that was read")
        have = sum(b["bytes"] for b in at["buckets"].values()) if at else 0
        n = at["n"] if at else self.buckets
        while n * BUCKET_BYTES < have + size and n < MOST_BUCKETS:
            n *= 2
        touched = into = None
        if at is not None and at["n"] == n:
            keys = rows.select(self.dealt_by)
            if drop is not None:
                keys = keys.unionByName(drop.select(F.col(self.dealt_by).cast(rows.schema[self.dealt_by].dataType).alias(self.dealt_by)))
            touched = {r[0] for r in keys.select(self._bucket(n).alias("b")).distinct().collect()}  # buckets at most
            if not touched:
                return
            into, touched = len(touched), self._met(at, touched, rows, drop)
        elif at is None and rows.isEmpty():
            return
        both = self._together(None if at is None else self._in(at, touched), rows, drop, out)
        self._rewrite(both, touched, at, n, into, self._left(order, out is not None))

    def _met(self, at: dict, touched: set[int], rows: DataFrame, drop: DataFrame | None) -> set[int]:
        """Buckets of `touched` that must be rewritten: they have a key of `rows` or `drop`, or many folders.  Small ones are not asked."""
        held = {int(k): b for k, b in at["buckets"].items() if int(k) in touched}
        if sum(b["bytes"] for b in held.values()) <= SMALL_BYTES:
            return touched
        many = {k for k, b in held.items() if len(b.get("paths") or [0]) >= MOST_PIECES}
        keys = rows.select(self.key)
        if drop is not None:
            keys = keys.unionByName(drop.select(F.col(self.key).cast(rows.schema[self.key].dataType).alias(self.key)))
        old = self._in(at, set(held) - many).select(self._bucket(at["n"]).alias("_b"), F.col(self.key).alias("_k"))
        return many | {r[0] for r in old.join(keys, F.col("_k").eqNullSafe(F.col(self.key)), "left_semi").select("_b").distinct().collect()}

    def delete(self, condition: Column) -> None:
        """Remove rows for which `condition` is true."""
        at = self._pointer()
        if at is None:
            return
        touched = {r[0] for r in self.read().where(condition).select(self._bucket(at["n"]).alias("b")).distinct().collect()}
        if touched:
            self._rewrite(self._in(at, touched).where(~F.coalesce(condition, F.lit(False))), touched, at, at["n"])

    def delete_matching(self, values: DataFrame, column: str) -> None:
        """Remove rows whose `column` is among those of `values`: one pass, however many there are."""
        at = self._pointer()
        if at is None:
            return
        gone = values.select(column).distinct()
        named = list(dict.fromkeys([self.key, self.dealt_by]))
        # Only keys meet `values`; the rows themselves are dealt once, to their buckets.
        keys, path = self._staged(self.read().select(*dict.fromkeys([*named, column])).join(gone, column, "left_semi").select(*named))
        try:
            touched = {r[0] for r in keys.select(self._bucket(at["n"]).alias("b")).distinct().collect()}
            if touched:
                rounds = self._rounds(at, touched)
                some = [self._together(self._in(at, r), None, keys.where(self._bucket(at["n"]).isin(*r))) for r in rounds]
                self._rewrite(some, touched, at, at["n"], max(map(len, rounds)), self._left())
        finally:
            self._fs(path)[0].delete(self._fs(path)[1], True)


CHUNK_SCHEMA = (
    "id string, document_id string, ordinal int, text string, kind string, heading_path array<string>, anchor string, question string, "
    "part_index int, part_count int, source_url string, source_title string, embedding array<float>"
)


class VectorStore(Protocol):
    """What retrieval and ingestion need of a store."""

    def upsert(self, chunks: DataFrame | Written) -> None: ...
    def search(self, queries: DataFrame, k: int, document_id: str | None = None) -> DataFrame: ...
    def get_by_ids(self, ids: DataFrame) -> DataFrame: ...
    def get_by_ordinal_range(self, document_id: str, lo: int, hi: int) -> DataFrame: ...
    def delete_by_document(self, document_id: str) -> None: ...
    def delete_by_documents(self, documents: DataFrame) -> None: ...
    def count(self) -> int: ...
    def dimensions(self) -> int | None: ...


class ParquetVectorStore:
    def __init__(self, spark: SparkSession, path: str, conf: EngineConf = DEFAULT):
        self.conf, self.table = conf, VersionedTable(spark, path, "id")

    def rows(self) -> DataFrame:
        return self.table.read(CHUNK_SCHEMA)

    def upsert(self, chunks: DataFrame | Written) -> None:
        """Insert or replace chunks by id.  Vectors of another length than the settings ask raise, and no version is written."""
        kinds = dict(x.split(" ", 1) for x in CHUNK_SCHEMA.split(", "))
        typed = lambda df: retrieval.assert_dimensions(df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in kinds]), self.conf.embedding_dimensions)
        self.table.upsert(replace(chunks, rows=typed(chunks.rows)) if isinstance(chunks, Written) else typed(chunks))

    def search(self, queries: DataFrame, k: int | None = None, document_id: str | None = None) -> DataFrame:
        where = None if document_id is None else F.col("document_id") == document_id
        rows = self.rows()
        found = retrieval.search(queries, rows, k, where, self.conf)
        asked = queries.select("qid").limit(retrieval.HIT_ROWS + 1).count() * (self.conf.top_k if k is None else k)
        return retrieval.with_hits(found, rows.drop("embedding"), asked)

    def get_by_ids(self, ids: DataFrame) -> DataFrame:
        return self.rows().join(ids.select("id"), "id", "left_semi")

    def get_by_ordinal_range(self, document_id: str, lo: int, hi: int) -> DataFrame:
        return self.rows().where((F.col("document_id") == document_id) & F.col("ordinal").between(lo, hi)).orderBy("ordinal")

    def delete_by_document(self, document_id: str) -> None:
        self.table.delete(F.col("document_id") == document_id)

    def delete_by_documents(self, documents: DataFrame) -> None:
        """Chunks of all documents named in `document_id`, in one pass."""
        self.table.delete_matching(documents, "document_id")

    def count(self) -> int:
        return self.rows().count()

    def dimensions(self) -> int | None:
        """Length of the stored vectors, by the first found; null when there are none.  Writing refuses other lengths."""
        r = self.rows().where("embedding is not null").select(F.size("embedding").alias("n")).first()
        return r["n"] if r else None


#: Adapters by name of the setting vector_store.
STORES = {"parquet": ParquetVectorStore}


def open_store(spark: SparkSession, path: str, conf: EngineConf = DEFAULT) -> VectorStore:
    return STORES[conf.vector_store](spark, path, conf)


def to_row(chunks: DataFrame) -> DataFrame:
    """Chunks as null-free rows: '' and -1 for what is absent, the heading path as JSON."""
    texts, numbers = ("anchor", "question", "source_url"), ("part_index", "part_count")
    out = chunks.withColumn("meta_json", F.to_json(F.struct("heading_path"))).drop("heading_path")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {c: F.coalesce(c, F.lit(-1)) for c in numbers})


def from_row(rows: DataFrame) -> DataFrame:
    texts, numbers = ("anchor", "question", "source_url"), ("part_index", "part_count")
    out = rows.withColumn("heading_path", F.from_json("meta_json", "heading_path array<string>")["heading_path"]).drop("meta_json")
    return out.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts} | {c: F.when(F.col(c) >= 0, F.col(c)) for c in numbers})
