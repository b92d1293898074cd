"""Event streams: frames, progress state, incremental ingestion, conversation turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import text as X

EVENT = "upload_id string, seq long, doc_id string, type string, stage string, done int, total int, chunks int, error string, ms long"


def parse_frames(streams: DataFrame, schema: str = EVENT) -> DataFrame:
    """(stream_id, body) of `event:`/`data:` frames -> stream_id, frame, event, data; malformed frames are skipped."""
    frames = streams.select("stream_id", F.posexplode(F.split("body", "\n\n")).alias("frame", "f"))
    event, data = F.regexp_extract("f", r"(?m)^event: (.*)$", 1), F.regexp_extract("f", r"(?m)^data: (.*)$", 1)
    parsed = frames.select("stream_id", "frame", event.alias("event"), F.from_json(data, schema).alias("data"), data.alias("raw"))
    return parsed.where("event <> '' and try_parse_json(raw) is not null").drop("raw")


def write_frames(events: DataFrame) -> DataFrame:
    """Rows with `type` and other columns -> frame text."""
    return events.select(X.sse_frame(F.col("type"), F.struct(*[c for c in events.columns if c != "type"])).alias("frame"))


def accumulate_answers(frames: DataFrame) -> DataFrame:
    """(qid, seq, event, text) -> qid, answer: tokens in order, replaced by a final answer event."""
    tokens = F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == "token", F.struct("seq", "text")))), lambda s: s["text"])
    final = F.max_by("text", F.when(F.col("event") == "answer", F.col("seq")))
    has = F.max(F.when(F.col("event") == "answer", F.lit(1)))
    return frames.groupBy("qid").agg(F.array_join(tokens, "").alias("_t"), final.alias("_a"), has.alias("_h")).select("qid", F.when(F.col("_h") == 1, F.col("_a")).otherwise(F.col("_t")).alias("answer"))


def answer_events(answers: DataFrame) -> DataFrame:
    """(qid, meta, answer, citations) -> qid, seq, event, text: meta, a token for each word with the blanks after it, answer, citations, done."""
    event = lambda name, text: F.struct(F.lit(name).alias("event"), text.cast("string").alias("text"))
    words = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"(\S+\s*|\s+)"))
    tokens = F.transform(words, lambda w: event("token", w))
    rows = F.concat(F.array(event("meta", F.col("meta"))), tokens, F.array(event("answer", F.col("answer")), event("citations", F.col("citations")), event("done", F.lit(""))))
    return answers.select("qid", F.posexplode(rows).alias("seq", "e")).select("qid", F.col("seq").cast("long").alias("seq"), "e.event", "e.text")


class BatchSink:
    """A folder with one part for each batch number: a batch that is written again replaces itself, whatever broke off before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def tell(self, batch: int) -> Callable[[str, DataFrame], None]:
        """A stage's events of this batch, appended when the stage is done; a batch that runs again replaces them stage by stage."""
        return lambda stage, events: events.write.mode("overwrite").parquet(f"{self.path}/batch={batch}/part={stage}")

    def read(self, schema: str) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.path)


def latest_progress(events: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The last event of each key, all columns."""
    other = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*other), F.struct(seq))
    return events.groupBy(key).agg(last.alias("e")).select(key, "e.*")


def progress_stream_agg(events: DataFrame) -> DataFrame:
    """Streaming (key, seq, stage, value) -> the latest row of each key by Spark's own aggregation (update or complete mode)."""
    return events.groupBy("key").agg(F.max_by(F.struct("seq", "stage", "value"), "seq").alias("e")).select("key", "e.*")


def ingest_stream(spark: SparkSession, landing: str, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each new file of a landing folder goes through `batch` once; batches run one after another.

    `batch` must be idempotent by its batch number: a batch whose commit was lost runs again.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(landing)
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Windowed event counts with a watermark: an extension for event tables, batch or streaming."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
