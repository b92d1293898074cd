"""Conversations: history for condensation, sessions, turns, prompts and answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, EngineConf
from ..functions import text as X
from ..plugins import with_retry
from .store import VersionedTable

REFUSAL = "I have nothing about that in the knowledge base."
SYSTEM_PROMPT = "Answer only from the numbered passages. Cite each statement with its passage number in square brackets. Say plainly what the passages do not answer."


def render_history(turns: DataFrame, questions: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """(chat_id, turn, role, content) and (chat_id, turn, question) -> chat_id, turn, history (null on a first turn).

    The last non-blank turns before the question, cut to a length, each with a speaker; every
    role but `user` speaks as the assistant.
    """
    said = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring("content", 1, conf.history_turn_chars))
    line = F.when(F.coalesce(X.trimmed(F.col("content")) != "", F.lit(False)), F.struct("turn", F.coalesce(said, F.lit("")).alias("line")))
    # Turns and questions in one order; a question stands before its own turn and sees the last lines only.
    rows = turns.where("turn is not null").select("chat_id", F.col("turn").alias("at"), F.lit(1).alias("kind"), line.alias("line"), F.lit(None).cast(questions.schema["question"].dataType).alias("question"))
    rows = rows.unionByName(questions.select("chat_id", F.col("turn").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["line"].dataType).alias("line"), "question"))
    run = Window.partitionBy("chat_id").orderBy("at", "kind")
    rows = rows.withColumn("_n", F.count("line").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    # Lines are numbered by what stands before them: those above n - k are the last k.
    lines = rows.where("line is not null").select("chat_id", F.col("_n").alias("i"), "line")
    asked_ = rows.where("kind = 0").select("chat_id", F.col("at").alias("turn"), "question", "_n")
    wanted = asked_.where("_n > 0").select("chat_id", "turn", F.explode(F.sequence(F.greatest(F.col("_n") - F.lit(conf.condense_history_turns - 1), F.lit(1)), F.col("_n"))).alias("i")).distinct()
    told = wanted.join(lines, ["chat_id", "i"]).groupBy("chat_id", "turn")
    told = told.agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda s: s["line"]), "\n").alias("history"))
    return questions.join(told, ["chat_id", "turn"], "left")


def checked_questions(questions: DataFrame) -> DataFrame:
    """Questions with `error`: a null or blank one is refused, and no model or search sees it."""
    blank = F.coalesce(X.trimmed(F.col("question")) == "", F.lit(True))
    return questions.withColumn("error", F.when(blank, "a question is required"))


def debug_record(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, record: what led to an answer, as JSON with its fields in order: question, condensed, top score, gate, hits."""
    kept = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "score"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
    per = hits.groupBy("qid").agg(kept.alias("hits"))
    return queries.join(per, "qid", "left").select("qid", F.to_json(F.struct("question", "condensed", "top_score", "gated", "hits"), {"ignoreNullFields": "false"}).alias("record"))


def condense_prompt(history: Column, question: Column) -> Column:
    return F.concat(F.lit("Below is a dialogue. State what its final message asks for, in one line that can be searched on its own.\n\n"), history, F.lit("\n\nFinal message: "), question, F.lit("\n\nSearch line:"))


def asked(chat: Callable[[str], str], conf: EngineConf, fallible: bool = False):
    """Column function of prompts to replies: a batch at a time, again after rate limits; with `fallible` a failed call is null."""
    call = with_retry(chat, conf.embed_max_retries)

    def reply(prompt: str) -> str | None:
        try:
            return call(prompt)
        except Exception:
            if not fallible:  # condensation is an optimisation, an answer is not
                raise
            return None

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else reply(p))

    return ask


def condensed(reply: Column, question: Column) -> Column:
    """First line of the model's reply without quotes; the question where that is too short or missing."""
    line = F.split(X.trimmed(reply), "\n")[0]
    line = X.trimmed(F.regexp_replace(line, "^[\"']|[\"']\\z", ""))
    return F.when(F.length(line) >= 3, line).otherwise(question)


def condense(turns: DataFrame, questions: DataFrame, chat: Callable[[str], str], conf: EngineConf = DEFAULT) -> DataFrame:
    """questions with `condensed`; first turns skip the model, and a failing model leaves the question."""
    rows = render_history(turns, questions, conf)

    ask = asked(chat, conf, fallible=True)
    first = rows.where("history is null").withColumn("condensed", F.col("question"))
    later = rows.where("history is not null").withColumn("condensed", condensed(ask(condense_prompt(F.col("history"), F.col("question"))), F.col("question")))
    return first.unionByName(later)


def titles(turns: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """chat_id, title: the first turn's opening characters when a user wrote it, else a stock title."""
    first = F.min_by(F.struct("role", "content"), "turn")
    t = turns.groupBy("chat_id").agg(first.alias("f"))
    return t.select("chat_id", F.when(F.col("f.role") == "user", F.substring("f.content", 1, conf.chat_title_chars)).otherwise("New conversation").alias("title"))


def sessions(turns: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """chat_id, title, n_turns, last_turn; most recent activity first is orderBy(last_turn desc, chat_id)."""
    head = turns.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max("turn").alias("last_turn"))
    return head.join(titles(turns, conf), "chat_id")


def rename(sessions_: DataFrame, chat_id: str, title: str, conf: EngineConf = DEFAULT) -> DataFrame:
    """Trimmed, cut title; a blank one raises."""
    title = title.strip()[: conf.chat_title_chars]
    if not title:
        raise ValueError("a title must not be blank")
    return sessions_.withColumn("title", F.when(F.col("chat_id") == chat_id, F.lit(title)).otherwise(F.col("title")))


def append_turn(turns: DataFrame, new: DataFrame) -> DataFrame:
    """Turns after the last of each chat, numbered on; chat ids that are not well formed raise."""
    bad = F.raise_error(F.lit("malformed chat id")).cast("string")
    new = new.withColumn("chat_id", F.when(X.is_chat_id(F.col("chat_id")), F.col("chat_id")).otherwise(bad))
    last = turns.groupBy("chat_id").agg(F.max("turn").alias("_last"))
    n = F.row_number().over(Window.partitionBy("chat_id").orderBy("seq"))
    rows = new.withColumn("_n", n).join(last, "chat_id", "left").withColumn("turn", (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast(turns.schema["turn"].dataType))
    return turns.unionByName(rows.select(*turns.columns))


def user_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Context passages:\n\n"), context, F.lit("\n\n---\n\nQuestion: "), question)


def answer(contexts: DataFrame, chat: Callable[[str], str], conf: EngineConf = DEFAULT) -> DataFrame:
    """(qid, question, gated, context) -> qid, answer; gated questions get the refusal and no model call."""

    ask = asked(chat, conf)
    refused = contexts.where("gated").select("qid", F.lit(REFUSAL).alias("answer"))
    told = contexts.where("not gated").select("qid", ask(F.concat(F.lit(SYSTEM_PROMPT + "\n\n"), user_prompt(F.col("question"), F.col("context")))).alias("answer"))
    return told.unionByName(refused)


#: A generator port: a prompt to the pieces of its answer, as they come.
Generate = Callable[[str], Iterator[str]]
#: Rows of tokens that leave a task at a time.
TOKEN_ROWS = 256


def stream_answers(contexts: DataFrame, generate: Generate) -> DataFrame:
    """(qid, question, gated, context, valid) -> qid, seq, event, text: the events of each answer, in order.

    `meta` (gated or open), a `token` for each piece as the generator gives it, then the `answer`
    with markers outside `valid` (the context's citation numbers) removed, the `citations` that it
    uses, and `done`.  A gated question gets the refusal and a blank one an `error`; neither calls
    the generator.  A generator that fails ends its answer with an `error` after the tokens so far;
    other answers are not affected.  Tokens leave the task in small batches while it runs.
    """
    names = ["qid", "seq", "event", "text", "valid"]
    rows = checked_questions(contexts).select("qid", "error", "gated", F.coalesce("valid", F.expr("cast(array() as array<int>)")).alias("valid"), F.concat(F.lit(SYSTEM_PROMPT + "\n\n"), user_prompt(F.col("question"), F.coalesce("context", F.lit("")))).alias("prompt"))
    kind = rows.schema["qid"].dataType.simpleString()

    def of(r: dict) -> Iterator[tuple]:
        if r["error"] is not None:
            yield (r["qid"], 0, "error", r["error"], None)
            return
        yield (r["qid"], 0, "meta", "gated" if r["gated"] else "open", None)
        if r["gated"]:
            yield (r["qid"], 1, "whole", REFUSAL, [])
            return
        said, n = [], 0
        try:
            for n, piece in enumerate(generate(r["prompt"]), 1):
                said.append(piece)
                yield (r["qid"], n, "token", piece, None)
        except Exception as error:
            yield (r["qid"], n + 1, "error", str(error), None)
            return
        yield (r["qid"], n + 1, "whole", "".join(said), r["valid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events = (e for r in batch.to_pylist() for e in of(r))
            while held := list(islice(events, TOKEN_ROWS)):
                cols = zip(*held, strict=True)
                types = [batch.schema.field("qid").type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    out = rows.mapInArrow(run, f"qid {kind}, seq long, event string, text string, valid array<int>")
    event = lambda name, text: F.struct(F.lit(name).alias("event"), text.alias("text"))
    used = F.array_join(F.array_sort(F.array_intersect("valid", X.cited_numbers(F.col("text")))).cast("array<string>"), ",")
    ending = F.array(event("answer", X.clean_citations(F.col("text"), F.col("valid"))), event("citations", used), event("done", F.lit("")))
    told = out.select("qid", "seq", F.posexplode(F.when(F.col("event") == "whole", ending).otherwise(F.array(F.struct("event", "text")))).alias("k", "e"))
    return told.select("qid", (F.col("seq") + F.col("k")).alias("seq"), "e.event", "e.text")


def validate(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(qid, answer) and (qid, n, ...) -> qid, answer (cleaned), used (numbers in citation order)."""
    valid = citations.groupBy("qid").agg(F.array_sort(F.collect_set(F.col("n").cast("int"))).alias("valid"))
    rows = answers.join(valid, "qid", "left").withColumn("valid", F.coalesce("valid", F.expr("cast(array() as array<int>)")))
    return rows.select("qid", X.clean_citations(F.col("answer"), F.col("valid")).alias("answer"), F.array_sort(F.array_intersect("valid", X.cited_numbers(F.col("answer")))).alias("used"))


def resume(turns: DataFrame) -> DataFrame:
    """Top score and gate of stored answers: first retrieved score (0 without), nothing retrieved is gated."""
    return turns.select("chat_id", "turn", F.coalesce(F.try_element_at("retrieved", F.lit(1))["score"], F.lit(0.0)).alias("top_score"), (F.coalesce(F.size("retrieved"), F.lit(0)) <= 0).alias("gated"))


def retrieval_meta(hits: DataFrame) -> DataFrame:
    """qid, retrieved: hits by falling score with the first 160 characters."""
    item = F.struct((-F.col("score")).alias("s"), F.col("id"), "score", "kind", "heading_path", F.substring("text", 1, 160).alias("snippet"))
    kept = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"), x["kind"].alias("kind"), x["heading_path"].alias("heading_path"), x["snippet"].alias("snippet")))
    return hits.groupBy("qid").agg(kept.alias("retrieved"))


TURN_SCHEMA = "key string, chat_id string, turn int, role string, content string, at timestamp"
TITLE_SCHEMA = "chat_id string, title string, at timestamp"


class ChatStore:
    """Conversations as two keyed tables: turns, dealt by chat, and titles that were given by hand."""

    def __init__(self, spark: SparkSession, path: str, conf: EngineConf = DEFAULT):
        self.spark, self.conf = spark, conf
        self.turns = VersionedTable(spark, f"{path}/turns", "key", buckets=8, dealt_by="chat_id")
        self.titles = VersionedTable(spark, f"{path}/titles", "chat_id", buckets=4)

    def _checked(self, chat_id: str) -> str:
        if not re.fullmatch(X.CHAT_ID, chat_id):
            raise ValueError(f"malformed chat id {chat_id!r}")
        return chat_id

    def append(self, chat_id: str, role: str, content: str, at: str) -> int:
        """Adds a turn after the last one of its chat; returns its number.

        The number holds for the version it was read from: where another writer came first, it is read again.
        """
        chat_id, said = self._checked(chat_id), {}

        def next_turn(rows: DataFrame) -> DataFrame:
            last = rows.agg(F.max("turn")).first()[0]
            said["turn"] = -1 if last is None else last
            said["turn"] += 1
            row = [(f"{chat_id}:{said['turn']}", chat_id, said["turn"], role, content, at)]
            return self.spark.createDataFrame(row, "key string, chat_id string, turn int, role string, content string, at string").withColumn("at", F.col("at").cast("timestamp"))

        self.turns.update(next_turn, TURN_SCHEMA, chat_id=chat_id)
        return said["turn"]

    def get(self, chat_id: str) -> DataFrame:
        return self.turns.snapshot(TURN_SCHEMA, chat_id=self._checked(chat_id))[0].orderBy("turn")

    def rename(self, chat_id: str, title: str, at: str) -> None:
        title = title.strip()[: self.conf.chat_title_chars]
        if not title:
            raise ValueError("a title must not be blank")
        row = self.spark.createDataFrame([(self._checked(chat_id), title)], "chat_id string, title string")
        self.titles.upsert(row.withColumn("at", F.lit(at).cast("timestamp")))

    def delete(self, chat_id: str) -> None:
        self.turns.delete(F.col("chat_id") == self._checked(chat_id))
        self.titles.delete(F.col("chat_id") == chat_id)

    def list(self) -> DataFrame:
        """chat_id, title, n_turns, updated_at; the latest first."""
        turns = self.turns.read(TURN_SCHEMA)
        own = self.titles.read(TITLE_SCHEMA).select("chat_id", F.col("title").alias("own"), F.col("at").alias("named_at"))
        when = turns.groupBy("chat_id").agg(F.max("at").alias("said_at"))
        out = sessions(turns, self.conf).join(when, "chat_id").join(own, "chat_id", "left")
        return out.select("chat_id", F.coalesce("own", "title").alias("title"), "n_turns", F.greatest("said_at", "named_at").alias("updated_at")).orderBy(F.col("updated_at").desc(), "chat_id")
