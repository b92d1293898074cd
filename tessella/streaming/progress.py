"""Progress of uploads as keyed streaming state, and conversations numbered as they arrive.

Uploads hold their state in a value state of `transformWithState`, chats theirs in map and value states of
`transformWithStateInPandas`, under the sequence numbers or message ids that they have seen: a batch that is played again, or an event
that is sent twice, changes nothing.  State lives in RocksDB on the executors and in the
checkpoint folder, so a lost executor's keys are read back, not recomputed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a shown row of an upload holds.
_SHOWN = "label string, stage string, done long, total long, chunks long, skipped string, error string, ms long"
SHOWN = ("label", "stage", "done", "total", "chunks", "skipped", "error", "ms")
#: Events of uploads; `files` are the names the upload was sent with, on each of its events.
UPLOAD_EVENT = "upload long, seq long, files array<string>, doc_id string, type string, stage string, done long, total long, chunks long, reason string, message string, ms long"
_EVENT = tuple(c.split(" ")[0] for c in UPLOAD_EVENT.split(", "))
_NONE = dict.fromkeys(_EVENT)
PROGRESS = f"upload long, key string, seq long, gone boolean, {_SHOWN}"


def _value(x: object) -> object:
    """A pandas cell as a plain value: a missing one is None, a whole float an integer."""
    if x is None or (not isinstance(x, (list, tuple)) and pd.isna(x)):
        return None
    return int(x) if isinstance(x, float) else x


def take_over(rows: dict[str, tuple], active: str, label: str, migrated: bool, files: set[str], e: dict) -> tuple[str, str, bool, set[str]]:
    """One event laid over the rows of its upload: the new active key, file label and flag, and the keys that changed.

    An event under a file name opens that file.  The first other id after it takes over the row
    of the active key; later ones get rows of their own under the file's label.  An event without an
    id is about the active key.  An event of another type changes nothing.
    """
    if e["type"] not in ("status", "done", "skipped", "error"):
        return active, label, migrated, set()
    doc = e["doc_id"]
    if doc is not None and doc in files:
        active, label, migrated = doc, doc, False
    key = active if doc is None else doc
    changed = {key}
    row = rows.get(key)
    if row is None:
        if not migrated and active in rows:
            row, migrated = rows.pop(active), True
            changed.add(active)
        else:
            row = (label, "queued", None, None, None, None, None, None)
    r = dict(zip(SHOWN, row, strict=True))
    if e["type"] == "status":
        r |= {"stage": e["stage"] if e["stage"] is not None else r["stage"], "done": e["done"], "total": e["total"], "chunks": e["chunks"] if e["chunks"] is not None else r["chunks"]}
    elif e["type"] == "done":
        r |= {"stage": "ready", "chunks": e["chunks"], "ms": e["ms"]}
    elif e["type"] == "skipped":
        r |= {"stage": "skipped", "skipped": e["reason"]}
    else:
        r |= {"stage": "failed", "error": e["message"]}
    rows[key] = tuple(r[k] for k in SHOWN)
    return key, label, migrated, changed


class UploadProgress(StatefulProcessor):
    """Rows shown for each upload, and where it stands, as one value state: a batch of an upload reads it once and writes it once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", f"seq long, active string, label string, migrated boolean, rows array<struct<key:string,{_SHOWN.replace(' ', ':').replace(',:', ',')}>>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer: object) -> Iterator[Row]:  # noqa: N802
        events = sorted((_NONE | json.loads(r[1]) for r in rows), key=itemgetter("seq"))
        names = [] if events[0]["files"] is None else [str(x) for x in events[0]["files"]]
        if (stood := self.at.get()) is not None:
            seen, active, label, migrated, known = stood
            held = {r[0]: tuple(r[1:]) for r in known}
            changed: set[str] = set()
        else:
            seen, active, migrated = -(1 << 63), names[0] if names else "document", False
            label = active
            held = {n: (n, "queued", None, None, None, None, None, None) for n in names}
            changed = set(held)
        before, files = (seen, bool(changed)), set(names)
        for e in events:
            if e["seq"] > seen:
                seen = e["seq"]
                active, label, migrated, now = take_over(held, active, label, migrated, files, e)
                changed |= now
        if before != (seen, False):
            self.at.update((seen, active, label, migrated, [(k, *r) for k, r in held.items()]))
        for k in sorted(changed):
            yield Row(upload=key[0], key=k, seq=seen, gone=k not in held, **dict(zip(SHOWN, held.get(k, (None,) * 8), strict=True)))

    def close(self) -> None:
        pass


def upload_progress(events: DataFrame) -> DataFrame:
    """A stream of UPLOAD_EVENT rows -> changed rows (PROGRESS); `gone` says that another id took the row over.

    Order is by `seq` within an upload; what comes late (a `seq` not above the last) is ignored.
    """
    # A row is handed to Python cell by cell, so an event is one text.
    packed = events.select("upload", F.to_json(F.struct(*[c for c in _EVENT if c != "upload"])).alias("event"))
    return packed.groupBy("upload").transformWithState(UploadProgress(), outputStructType=PROGRESS, outputMode="Update", timeMode="None")


def shown_rows(changes: DataFrame) -> DataFrame:
    """The latest of each row, without those taken over: what a reader of the changes sees now."""
    last = F.max_by(F.struct("gone", *SHOWN), "seq")
    return changes.groupBy("upload", "key").agg(last.alias("r")).where("not r.gone").select("upload", "key", *[F.col(f"r.{c}").alias(c) for c in SHOWN])


#: Messages of conversations; `seq` orders those that arrive together.
MESSAGE = "chat_id string, message_id string, seq long, role string, content string"
NUMBERED = "chat_id string, turn long, message_id string, role string, content string"


class NumberedTurns(StatefulProcessor):
    """Numbers the messages of each chat from 0; a message id that was numbered before is not numbered again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "message_id string", "turn long")
        self.next = handle.getValueState("next", "turn long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        turn = self.next.get()[0] if self.next.exists() else 0
        new = []
        for r in pd.concat(list(rows)).sort_values(["seq", "message_id"]).to_dict("records"):
            if not self.seen.containsKey((r["message_id"],)):
                self.seen.updateValue((r["message_id"],), (turn,))
                new.append((key[0], turn, r["message_id"], _value(r["role"]), _value(r["content"])))
                turn += 1
        self.next.update((turn,))
        if new:
            yield pd.DataFrame(new, columns=["chat_id", "turn", "message_id", "role", "content"])

    def close(self) -> None:
        pass


def numbered_turns(messages: DataFrame) -> DataFrame:
    """A stream of MESSAGE rows -> each message once, with its turn (NUMBERED).  Null message ids raise."""
    ident = F.coalesce("message_id", F.raise_error(F.lit("a message needs an id")).cast("string"))
    return messages.withColumn("message_id", ident).groupBy("chat_id").transformWithStateInPandas(NumberedTurns(), outputStructType=NUMBERED, outputMode="Append", timeMode="None")


def sessions_of(turns: DataFrame) -> DataFrame:
    """chat_id, n_turns, last_role of numbered turns."""
    return turns.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max_by("role", "turn").alias("last_role"))


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Stateful streams that start inside keep their state in RocksDB, which map states need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_to_end(changes: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Everything that is there now goes through the stream; `sink` gets each batch and its number, twice after a failure."""
    with _rocks(changes.sparkSession):
        query = changes.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query
