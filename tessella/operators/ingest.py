"""Ingestion: content-hash dedup, replacement of changed documents, manifest, events, outcomes."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, EngineConf
from ..functions import text as X
from ..plugins import Embedder, dealt, embed_column, hash_embedder
from . import chunking
from .store import CODEC, ORPHAN_SECONDS, ParquetVectorStore, VersionedTable, Written, shuffles_go

#: Row numbers of a batch that are sent to every task; beyond, they and the texts they pick shuffle.
SENT_ROWS = 500_000

MANIFEST_SCHEMA = (
    "id string, filename string, title string, source_url string, content_hash string, status string, "
    "chunk_count int, error string, created_at timestamp, updated_at timestamp"
)


def first_of_hash(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Rows with content_hash and is_first: of equal contents the first in input order is taken.

    The first is an aggregate of hashes and order values; the contents themselves are not gathered.
    Rows that have a content_hash already need no contents.
    """
    hashed = docs if "content_hash" in docs.columns else docs.withColumn("content_hash", X.content_hash(F.col("markdown")))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias("_first"))
    joined = hashed.join(first.withColumnRenamed("content_hash", "_h"), F.col("content_hash").eqNullSafe(F.col("_h")))
    return joined.withColumn("is_first", F.col(order).eqNullSafe(F.col("_first"))).drop("_h", "_first")


def skip_known(docs: DataFrame, manifest: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(to ingest, skipped): contents that are ready already, or come earlier in this batch, are skipped."""
    marked = first_of_hash(docs)
    ready = manifest.where("status = 'ready'").select(F.col("content_hash").alias("_h")).distinct()
    known = marked.join(ready, F.col("content_hash") == F.col("_h"), "left").withColumn("known", F.col("_h").isNotNull() & F.lit(not force)).drop("_h")
    return known.where("is_first and not known").drop("known", "is_first"), known.where("known or not is_first").drop("known", "is_first")


def prior_versions(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id, prior_id: the manifest row that a document replaces.

    By source_url where it has one, else by file name among rows without one; the oldest of several.
    """
    m = manifest.select(F.col("id").alias("prior_id"), F.col("source_url").alias("u"), F.col("filename").alias("f"), "created_at")
    by_url = docs.where("source_url is not null").join(m, F.col("source_url") == F.col("u"))
    by_name = docs.where("source_url is null").join(m.where("u is null"), F.col("filename") == F.col("f"))
    both = by_url.select("doc_id", "prior_id", "created_at").unionByName(by_name.select("doc_id", "prior_id", "created_at"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("created_at", "prior_id"))
    return both.withColumn("_n", first).where("_n = 1").select("doc_id", "prior_id")


def patch(manifest: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """`changes` (id and some columns) laid over the manifest, with updated_at; unknown ids change nothing.

    A null in a change leaves the value, except for `error`, which a null clears.
    """
    new = [c for c in changes.columns if c != "id"]
    laid = manifest.join(changes.select("id", *[F.col(c).alias(f"_{c}") for c in new], F.lit(True).alias("_hit")), "id", "left")
    value = lambda c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) if c == "error" else F.coalesce(f"_{c}", c)
    out = {c: value(c) for c in new} | {"updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))}
    return laid.withColumns(out).select(*manifest.columns)


def find(manifest: DataFrame, content_hash: str | None = None, source_url: str | None = None, filename: str | None = None) -> DataFrame:
    """Manifest rows by content hash (ready ones only), source URL or file name; the oldest first."""
    rows = manifest
    if content_hash is not None:
        rows = rows.where((F.col("content_hash") == content_hash) & (F.col("status") == "ready"))
    if source_url is not None:
        rows = rows.where(F.col("source_url") == source_url)
    if filename is not None:
        rows = rows.where(F.col("filename") == filename)
    return rows.orderBy("created_at", "id")


def manifest_json(manifest: DataFrame) -> DataFrame:
    """Manifest rows as JSON texts (value), a document each, fields in order; absent ones are null."""
    return manifest.select(F.to_json(F.struct(*manifest.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "timeZone": "UTC"}).alias("value"))


def documents_with_chunks(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Manifest rows with `chunks`: those of each document in order, without their vectors; none is an empty list."""
    kept = [c for c in chunks.columns if c not in ("embedding", "document_id")]
    item = F.struct("ordinal", *[c for c in kept if c != "ordinal"])
    per = chunks.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    kind = per.schema["chunks"].dataType.simpleString()
    return manifest.join(per, "id", "left").withColumn("chunks", F.coalesce("chunks", F.expr(f"cast(array() as {kind})")))


def outcome(error: Column, skipped: Column) -> Column:
    refused = error.rlike(r"(?i)error page|HTTP 4\d\d")
    return F.when(F.coalesce(skipped, F.lit(False)), "skipped").when(refused, "refused").when(error.isNotNull(), "failed").otherwise("ok")


def seed_totals(results: DataFrame) -> DataFrame:
    return results.groupBy(outcome(F.col("error"), F.col("skipped")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"))


#: What ingestion tells while it runs; a document's `seq` rises with its stages.
INGEST_EVENT = "doc_id string, seq long, type string, stage string, done long, total long, chunks long, reason string, message string"
Tell = Callable[[str, DataFrame], None]


def told(rows: DataFrame, seq: int, type_: str, stage: str | None = None, **more: str | Column) -> DataFrame:
    """(doc_id, ...) as events of one kind; `more` are expressions of the event's other columns."""
    kinds = dict(x.split(" ") for x in INGEST_EVENT.split(", "))
    own = {"seq": F.lit(seq), "type": F.lit(type_), "stage": F.lit(stage)} | {k: F.expr(v) if isinstance(v, str) else v for k, v in more.items()}
    return rows.select(*[(F.col(c) if c == "doc_id" else own.get(c, F.lit(None))).cast(t).alias(c) for c, t in kinds.items()])


def last_of_batch(docs: DataFrame, order: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(kept, superseded): of the documents of one URL, or of one file name without a URL, the last in order is kept.

    Documents with neither are versions of nothing.  `superseded` has `by`, the order value of the one that is kept.
    """
    key = F.when(F.col("source_url").isNotNull(), F.concat(F.lit("u "), F.col("source_url"))).otherwise(F.concat(F.lit("f "), F.col("filename")))
    keyed = docs.withColumn("_k", key)
    last = keyed.where("_k is not null").groupBy(F.col("_k").alias("_key")).agg(F.max(order).alias("by"))
    marked = keyed.join(last, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")
    late = F.coalesce(F.col(order) == F.col("by"), F.lit(True))
    return marked.where(late).drop("by"), marked.where(~late)


class Ingestor:
    """Runs a batch of parsed documents into a chunk store and a manifest under one folder.

    The new chunks of a changed document are written before the old version's go, and the
    manifest says `ready` last: a failed run leaves the old version readable.  A document whose
    texts the model refuses fails alone; the others of its batch are stored.
    """

    def __init__(self, spark: SparkSession, path: str, conf: EngineConf = DEFAULT, embedder: Embedder | None = None):
        self.spark, self.path, self.conf = spark, path.rstrip("/"), conf
        self.embedder = embedder or hash_embedder(conf.embedding_dimensions)
        self.store = ParquetVectorStore(spark, f"{path}/chunks", conf)
        self.manifest = VersionedTable(spark, f"{path}/manifest", "id", buckets=4)

    def documents(self) -> DataFrame:
        return self.manifest.read(MANIFEST_SCHEMA)

    def ingest(self, parsed: DataFrame, force: bool = False, now: str = "2024-01-01 00:00:00", tell: Tell | None = None) -> DataFrame:
        """parsed: doc_id, markdown, title, filename, source_url, error (null when parsed) -> one result row each.

        Results: id, chunks, skipped, error.  A skipped document has the id and chunk count of the
        identical one; one that a later version of the same batch replaces is skipped for that.
        Every text is embedded once: chunks are written with their vectors before anything else
        reads them.  All documents that are replaced go in one pass.  Results are a written table.

        `tell` gets each stage's name and events (INGEST_EVENT) as soon as the stage is written, so
        what a later failure leaves behind are the events up to it.  It has to read them at once: the
        tables they come from go as the run goes on.

        Disk: each step's table goes as soon as the next one is written, and its shuffle files when
        it is over, so a run holds one copy of its texts, the exchange and the outcome of one step.
        """
        with shuffles_go(self.spark, parsed.sparkSession):
            return self._ingest(parsed, force, now, tell or (lambda stage, events: None))

    def _ingest(self, parsed: DataFrame, force: bool, now: str, tell: Tell) -> DataFrame:
        at = F.lit(now).cast("timestamp")
        run = f"{self.path}/runs/{uuid.uuid4().hex}"

        def write(df: DataFrame, name: str) -> tuple[DataFrame, int]:
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", CODEC).parquet(f"{run}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{run}/{name}"), int(seen.get["n"])

        def drop(*names: str) -> None:
            for name in names:
                fs, p = self.manifest._fs(f"{run}/{name}")
                fs.delete(p, True)

        known = self.documents()
        text = F.when(F.col("error").isNull(), X.normalize_markdown(F.col("markdown")))
        parsed = parsed.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("markdown", text).withColumn("content_hash", X.content_hash(F.col("markdown")))
        parsed, n_parsed = write(parsed.withColumn("_row", F.monotonically_increasing_id()), "parsed")
        # What is to be done is found on rows without their texts; those of the rows to be ingested are met once, by row number.
        texts, parsed = parsed, parsed.drop("markdown")
        bad, _ = write(parsed.where("error is not null").select("doc_id", "error"), "bad")
        good, superseded = last_of_batch(parsed.where("error is null"))
        tell("parse", told(parsed.where("error is null"), 0, "status", "parsing").unionByName(told(bad, 0, "error", message="error")))
        fresh, skipped = skip_known(good, known, force)
        new_id = F.concat_ws("-", "doc_id", F.substring("content_hash", 1, 12))
        fresh, n_fresh = write(fresh.withColumn("new_id", new_id), "fresh")
        skipped, _ = write(self._identical(skipped, known, fresh).unionByName(superseded.select("doc_id", F.col("by").alias("same_id"), F.lit(0).alias("same_chunks"), F.lit("replaced within the batch").alias("reason"))), "skipped")
        tell("skip", told(skipped, 1, "skipped", reason="reason"))

        picked = fresh.select("_row")
        source = texts if n_fresh == n_parsed else texts.join(F.broadcast(picked) if n_fresh <= SENT_ROWS else picked, "_row", "left_semi")
        source, _ = write(source.select(new_id.alias("doc_id"), "markdown", "title", "source_url"), "source")
        drop("parsed")
        chunks, n = write(chunking.chunk_documents(source, self.conf), "chunks")
        drop("source")
        counts = chunks.groupBy(F.col("document_id").alias("new_id")).agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        counts, _ = write(fresh.select("doc_id", "new_id").join(counts, "new_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))), "counts")
        tell("chunk", told(counts.where("chunk_count > 0"), 2, "status", "chunking", chunks="chunk_count"))

        asked = dealt(chunks, n, self.conf, "id").withColumn("_t", X.embedding_text(F.col("heading_path"), F.col("text")))
        ready, _ = write(embed_column(asked, "_t", self.embedder, self.conf, errors="_error").drop("_t"), "embedded")
        drop("chunks")
        why = ready.where("_error is not null").groupBy(F.col("document_id").alias("new_id")).agg(F.min_by("_error", "ordinal").alias("why"))
        state = counts.join(why, "new_id", "left").withColumn("why", F.coalesce("why", F.when(F.col("chunk_count") == 0, "document produced no chunks")))
        state, _ = write(state, "state")
        tell("embed", told(state.where("why is null"), 3, "status", "embedding", done="chunk_count", total="chunk_count"))
        failed, n_failed = write(state.where("why is not null"), "failed")
        # Only ids meet the failed documents; the chunks themselves are dealt once, to their buckets.
        out = ready.where("_error is null").select("id", "document_id").join(failed.select(F.col("new_id").alias("document_id")), "document_id", "left_semi")
        self.store.upsert(Written(ready.where("_error is null").drop("_error"), f"{run}/embedded", out.select("id") if n_failed else None))
        drop("embedded")

        ok = F.col("why").isNull()
        rows = fresh.join(state.drop("doc_id"), "new_id").select(
            F.col("new_id").alias("id"), "filename", "title", "source_url", "content_hash", F.when(ok, "ready").otherwise("failed").alias("status"), F.when(ok, F.col("chunk_count")).otherwise(0).alias("chunk_count"),
            F.col("why").alias("error"), at.alias("created_at"), at.alias("updated_at"),
        )
        none = F.lit(None).cast("string")
        results = rows.select("id", F.col("chunk_count").alias("chunks"), F.lit(False).alias("skipped"), "error")
        results = results.unionByName(skipped.select(F.col("same_id").alias("id"), F.col("same_chunks").alias("chunks"), F.lit(True).alias("skipped"), none.alias("error")))
        results = results.unionByName(bad.select(F.col("doc_id").alias("id"), F.lit(0).alias("chunks"), F.lit(False).alias("skipped"), "error"))
        results, _ = write(results, "results")  # before the manifest says that these contents are known
        gone: list[tuple[DataFrame, int]] = []

        def publish(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
            # What is replaced is told by the version that this write follows; a failed document replaces nothing.
            stored = fresh.join(state.where("why is null").select("new_id"), "new_id", "left_semi")
            old = prior_versions(stored, manifest).join(stored.select("doc_id", "new_id"), "doc_id").where("prior_id <> new_id")
            old, n_old = write(old.select(F.col("prior_id").alias("id"), F.col("prior_id").alias("document_id")).distinct(), f"gone-{len(gone)}")
            gone.append((old, n_old))
            return rows, old.select("id")

        self.manifest.update(publish, MANIFEST_SCHEMA)
        if gone[-1][1]:
            self.store.delete_by_documents(gone[-1][0])
        tell("done", told(state.where("why is null"), 4, "done", "ready", chunks="chunk_count").unionByName(told(failed, 4, "error", message="why")))
        drop("bad", "fresh", "skipped", "counts", "state", "failed", *(f"gone-{k}" for k in range(len(gone))))
        self._forget_runs()
        return results

    def _identical(self, skipped: DataFrame, known: DataFrame, fresh: DataFrame) -> DataFrame:
        """Skipped documents with the id and chunk count of the ready document, or the one of this batch, that is identical."""
        ready = known.where("status = 'ready'").groupBy(F.col("content_hash").alias("_h")).agg(F.min_by(F.struct("id", "chunk_count"), F.struct("created_at", "id")).alias("r"))
        now = fresh.select(F.col("content_hash").alias("_g"), "new_id").dropDuplicates(["_g"])
        both = skipped.join(ready, F.col("content_hash") == F.col("_h"), "left").join(now, F.col("content_hash") == F.col("_g"), "left")
        same = F.coalesce("r.id", "new_id", "doc_id")
        return both.select("doc_id", same.alias("same_id"), F.coalesce("r.chunk_count", F.lit(0)).alias("same_chunks"), F.lit("already indexed (identical content)").alias("reason"))

    def _forget_runs(self) -> None:
        """Remove what runs left that broke off, or whose results are old."""
        fs, root = self.manifest._fs(f"{self.path}/runs")
        old = (time.time() - ORPHAN_SECONDS) * 1000
        for f in fs.listStatus(root) if fs.exists(root) else []:
            if f.getModificationTime() < old:
                fs.delete(f.getPath(), True)

    def mark_failed(self, document_id: str, error: str, now: str = "2024-01-01 00:00:00") -> None:
        """Roll a document back: its chunks go first, then the manifest says why."""
        self.store.delete_by_document(document_id)
        change = self.spark.createDataFrame([(document_id, "failed", error, 0)], "id string, status string, error string, chunk_count int")
        self.manifest.update(lambda rows: patch(rows, change, F.lit(now).cast("timestamp")), MANIFEST_SCHEMA, id=document_id)

    def export(self, path: str) -> None:
        """The manifest as lines of JSON."""
        manifest_json(self.documents().orderBy("created_at", "id")).write.mode("overwrite").text(path)

    def remove(self, document_id: str) -> None:
        """Chunks first, then the manifest row."""
        self.store.delete_by_document(document_id)
        self.manifest.delete(F.col("id") == document_id)
