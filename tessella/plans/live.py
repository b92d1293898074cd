"""Registered queries of what happens while it runs: uploads, archives, ingestion, conversations, answers.

Each is a stream over a given table, run to its end, or the operator that a stream calls for each
of its batches.  Inputs are declared as in `catalogue`.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import replace
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import DEFAULT
from ..functions import text as X
from ..operators import chats, ingest, retrieval
from ..plugins import extractive_stream, hash_embedder
from ..sources import files, pdf, uploads
from ..streaming import events as E
from ..streaming import progress as P
from . import sql as S
from .catalogue import _BUDGET, _CH, _EXP, _KNN, _TEXTS, _root, _scored_texts, _t, query


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = _t(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


# ---------------------------------------------------------------- progress of uploads

_FILES = ("file-0", "file-1", "file-2")


def upload_events(events: DataFrame) -> DataFrame:
    """events as those of uploads: a user's are one upload of three files; `props` says which document each is about."""
    k = F.get_json_object("props", "$.k").cast("long")
    doc = F.when(k % 10 == 0, F.concat(F.lit("file-"), (k % 3).cast("string"))).when(k % 10 > 2, F.concat(F.lit("doc-"), (k % 7).cast("string")))
    kind = F.when(F.col("event_type").isin("view", "click"), "status").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "skipped").otherwise("error")
    view, click, done = (F.col("event_type") == x for x in ("view", "click", "purchase"))
    none = F.lit(None).cast("string")
    return events.select(
        F.col("user_id").alias("upload"), F.col("event_id").alias("seq"), F.array(*[F.lit(x) for x in _FILES]).alias("files"), doc.alias("doc_id"), kind.alias("type"),
        F.when(view, "embedding").when(click & (k % 2 == 0), "chunking").alias("stage"), F.when(view, k).alias("done"), F.when(view, F.lit(100)).cast("long").alias("total"), F.when(click | done, k).alias("chunks"),
        F.when(F.col("event_type") == "signup", F.lit("same content")).otherwise(none).alias("reason"), F.when(F.col("event_type") == "error", F.concat(F.lit("failed at "), k.cast("string"))).alias("message"), F.when(done, F.col("event_id")).alias("ms"),
    )


@query("""WITH RECURSIVE k AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
e AS (SELECT user_id AS upload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id,
  CASE WHEN k % 10 = 0 THEN 'file-' || (k % 3) WHEN k % 10 > 2 THEN 'doc-' || (k % 7) END AS doc, k % 10 = 0 AS is_file, event_type AS t, k FROM k),
s AS (
  SELECT DISTINCT upload, 0::BIGINT AS n, 'file-0' AS active, 'file-0' AS label, false AS migrated, map_from_entries(list_transform(['file-0', 'file-1', 'file-2'],
    lambda f: (f, {'label': f, 'stage': 'queued', 'done': NULL::BIGINT, 'total': NULL::BIGINT, 'chunks': NULL::BIGINT, 'skipped': NULL::VARCHAR, 'error': NULL::VARCHAR, 'ms': NULL::BIGINT}))) AS rows FROM e
  UNION ALL
  SELECT upload, n, key, label, migrated OR take, map_from_entries(list_append(list_filter(map_entries(rows), lambda x: x.key <> key AND NOT (take AND x.key = active)), (key,
    CASE WHEN t IN ('view', 'click') THEN {'label': prev.label, 'stage': coalesce(CASE WHEN t = 'view' THEN 'embedding' WHEN k % 2 = 0 THEN 'chunking' END, prev.stage), 'done': CASE WHEN t = 'view' THEN k END,
        'total': CASE WHEN t = 'view' THEN 100::BIGINT END, 'chunks': coalesce(CASE WHEN t = 'click' THEN k END, prev.chunks), 'skipped': prev.skipped, 'error': prev.error, 'ms': prev.ms}
      WHEN t = 'purchase' THEN {'label': prev.label, 'stage': 'ready', 'done': prev.done, 'total': prev.total, 'chunks': k, 'skipped': prev.skipped, 'error': prev.error, 'ms': event_id}
      WHEN t = 'signup' THEN {'label': prev.label, 'stage': 'skipped', 'done': prev.done, 'total': prev.total, 'chunks': prev.chunks, 'skipped': 'same content', 'error': prev.error, 'ms': prev.ms}
      ELSE {'label': prev.label, 'stage': 'failed', 'done': prev.done, 'total': prev.total, 'chunks': prev.chunks, 'skipped': prev.skipped, 'error': 'failed at ' || k, 'ms': prev.ms} END)))
  FROM (
    SELECT *, CASE WHEN map_contains(rows, key) THEN rows[key] WHEN take THEN rows[active]
      ELSE {'label': label, 'stage': 'queued', 'done': NULL::BIGINT, 'total': NULL::BIGINT, 'chunks': NULL::BIGINT, 'skipped': NULL::VARCHAR, 'error': NULL::VARCHAR, 'ms': NULL::BIGINT} END AS prev
    FROM (SELECT *, coalesce(doc, active) AS key, NOT map_contains(rows, coalesce(doc, active)) AND NOT migrated AND map_contains(rows, active) AS take
      FROM (SELECT e.*, CASE WHEN is_file THEN doc ELSE s.active END AS active, CASE WHEN is_file THEN doc ELSE s.label END AS label, s.migrated AND NOT is_file AS migrated, s.rows FROM s JOIN e ON e.upload = s.upload AND e.n = s.n + 1))))
, last AS (SELECT upload, unnest(map_entries(rows)) AS r FROM (SELECT *, row_number() OVER (PARTITION BY upload ORDER BY n DESC) AS x FROM s) WHERE x = 1)
SELECT upload, r.key AS key, r.value.label AS label, r.value.stage AS stage, r.value.done AS done, r.value.total AS total, r.value.chunks AS chunks, r.value.skipped AS skipped, r.value.error AS error, r.value.ms AS ms FROM last""")
def upload_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows an upload shows at its end, from a stream that is played in several batches, every event of it twice."""
    root = f"{_root(spark)}/uploads-{uuid.uuid4().hex}"
    sink = E.BatchSink(spark, f"{root}/changes")
    twice = upload_events(_stream(spark, sf_dir, "events"))
    P.run_to_end(P.upload_progress(twice.unionByName(twice)), f"{root}/checkpoint", sink)
    return P.shown_rows(sink.read(P.PROGRESS))


# ---------------------------------------------------------------- archives


def write_archives(docs: DataFrame, folder: str, each: int = 200) -> int:
    """(doc_id, text) as archives of Markdown files and, every third, of JSON envelopes; the number of archives.

    A task's archives carry its number: one that runs again replaces them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = uploads._open(folder)
        fs.create_dir(root, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        rows = (r for b in batches for r in b.to_pylist())
        while some := list(islice(rows, each)):
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                for r in some:
                    md = f"# Document {r['doc_id']}\n\n{r['text'] or ''}"
                    if r["doc_id"] % 3:
                        z.writestr(f"in/{r['doc_id']}.md", md)
                    else:
                        z.writestr(f"{r['doc_id']}.json", json.dumps({"markdown": md, "metadata": {"sourceURL": f"https://example.org/{r['doc_id']}", "statusCode": 404 if r["doc_id"] % 21 == 0 else 200}}))
                    z.writestr(f"__MACOSX/{r['doc_id']}.md", "x")
                    z.writestr(f"{r['doc_id']}.bin", "x")
            with fs.open_output_stream(f"{root}/docs-{part:06d}-{n:06d}.zip") as out:
                out.write(packed.getvalue())
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


@query("""SELECT doc_id, CASE WHEN doc_id % 21 <> 0 THEN 'Document ' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 AND doc_id % 21 <> 0 THEN 'https://example.org/' || doc_id END AS source_url,
  CASE WHEN doc_id % 21 <> 0 THEN sha256('# Document ' || doc_id || chr(10) || chr(10) || coalesce(text, '')) END AS digest, CASE WHEN doc_id % 21 = 0 THEN doc_id || '.json: HTTP 404, an error page' END AS error
FROM documents WHERE doc_id IS NOT NULL""")
def archive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents packed into archives and read back member by member through the data source of uploads."""
    folder = f"{_root(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(_t(spark, sf_dir, "documents"), folder)
    rows = uploads.read_uploads(spark, folder)
    ident = F.regexp_extract("filename", r"^(-?\d+)\.", 1).cast("long")
    return rows.select(ident.alias("doc_id"), "title", "source_url", F.sha2("markdown", 256).alias("digest"), "error")


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(page_id || ' page!.html', '[^\w.\- ]+', '_', 'g'), ''), 'upload') AS name, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS length FROM pages""")
def raw_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages kept as raw uploads; the second upload of the same bytes under the same name adds nothing."""
    folder = f"{_root(spark)}/raw-{uuid.uuid4().hex}"
    body = F.coalesce("html", F.lit("")).cast("binary")
    uploads_ = _t(spark, sf_dir, "pages").select(F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.lit(" page!.html")).alias("path"), F.octet_length(body).cast("long").alias("length"), body.alias("content"))
    files.archive_raw(uploads_, folder)
    kept = files.archive_raw(uploads_, folder)
    return kept.select(F.regexp_extract("name", r"^(-?\d+) ", 1).cast("long").alias("page_id"), "name", "digest", "length")


@query("""SELECT doc_id, '{"id":"' || doc_id || '","title":"Document ' || doc_id || '","status":"' || CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'ready' END || '","chunk_count":' || n_chars || ',"error":' ||
  CASE WHEN doc_id % 7 = 0 THEN '"refused"' ELSE 'null' END || ',"created_at":"2024-01-0' || (doc_id % 9 + 1) || 'T00:00:00.000Z"}' AS value FROM documents""")
def manifest_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows of all documents as JSON."""
    name = F.col("doc_id").cast("string")
    bad = F.col("doc_id") % 7 == 0
    rows = _t(spark, sf_dir, "documents").select(
        name.alias("id"), F.concat(F.lit("Document "), name).alias("title"), F.when(bad, "failed").otherwise("ready").alias("status"), F.col("n_chars").alias("chunk_count"), F.when(bad, "refused").alias("error"),
        F.to_timestamp(F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"))).alias("created_at"),
    )
    return ingest.manifest_json(rows).select(F.get_json_object("value", "$.id").cast("long").alias("doc_id"), "value")


@query(f"""WITH t AS (SELECT doc_id, {S.trim("regexp_replace(coalesce(text, ''), '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN length(text) >= 40 THEN 'Document ' || doc_id END AS title, CASE WHEN length(text) >= 40 THEN sha256('# Document ' || doc_id || chr(10) || chr(10) || text) END AS digest,
  CASE WHEN length(text) < 40 THEN doc_id || '.pdf: no extractable text' END AS error FROM t""")
def pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents written as PDF files, with packed streams and a font of their own characters, and read back as text."""
    d = _t(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                body = [pdf.write([t or ""], f"Document {i}") for i, t in zip(some["doc_id"].to_pylist(), some["text"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([f"in/{i}.pdf" for i in some["doc_id"].to_pylist()]), pa.array([len(b) for b in body], pa.int64()), pa.array(body, pa.binary())], names=["path", "length", "content"])

    d = d.repartition(4 * spark.sparkContext.defaultParallelism)  # a table of one row group is one task otherwise
    rows = files.parse_files(d.mapInArrow(run, "path string, length long, content binary"))
    return rows.select(F.regexp_extract("filename", r"^(-?\d+)\.", 1).cast("long").alias("doc_id"), "title", F.sha2("markdown", 256).alias("digest"), "error")


@query("""WITH t AS (SELECT doc_id, source, regexp_extract(coalesce(text, ''), '^[^ \\n]*( [^ \\n]*)?') AS title FROM documents WHERE doc_id IS NOT NULL)
SELECT coalesce(source, '') AS qid, doc_id AS id, CAST(row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY CASE WHEN doc_id % 3 = 0 THEN upper(title) ELSE title END COLLATE en_us, doc_id // 10, doc_id % 10) AS INTEGER) AS n FROM t""".replace("\\\\", "\\"))
def collated_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in the reading order of their titles, which differ in case and accents: the first words of texts."""
    d = _t(spark, sf_dir, "documents").where("doc_id is not null")
    title = F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^ \n]*( [^ \n]*)?", 0)
    rows = d.select(F.coalesce("source", F.lit("")).alias("qid"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, X.simple_upper(title)).otherwise(title).alias("source_title"), F.floor(F.col("doc_id") / 10).alias("document_id"), (F.col("doc_id") % 10).alias("ordinal"))
    return retrieval.number_citations(rows).select("qid", "id", "n")


# ---------------------------------------------------------------- ingestion


def _refusing(dims: int):
    """A model that refuses each text that ends with the closing line of a seventh document."""
    embed = hash_embedder(dims)

    def call(texts: list[str]) -> list[list[float]]:
        for t in texts:
            if (m := re.search(r"closing line of document (\d+)", t)) and int(m[1]) % 7 == 0:
                raise ValueError("the model refuses this text")
        return embed(texts)

    return call


def closed_documents(d: DataFrame, ident: Column, mark: Column) -> DataFrame:
    """documents to be ingested: a heading, the whole text, and a closing line that names the document; `mark` ends it."""
    name = F.col("doc_id").cast("string")
    text = F.concat(F.lit("# Document "), name, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\nThis is the closing line of document "), name, F.lit(", long enough for a chunk to be kept"), mark)
    url = F.concat(F.lit("https://example.org/d/"), name)
    return d.where("doc_id is not null").select(ident.alias("doc_id"), text.alias("markdown"), F.concat(F.lit("Document "), name).alias("title"), F.lit(None).cast("string").alias("filename"), url.alias("source_url"), F.lit(None).cast("string").alias("error"))


_SMALL = replace(DEFAULT, embedding_dimensions=8)


@query("""WITH v AS (SELECT doc_id, unnest(CASE WHEN doc_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS version FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CAST(version AS INTEGER) AS version, CASE WHEN doc_id % 5 = 0 AND version = 0 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS outcome,
  CASE WHEN doc_id % 5 = 0 AND version = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'the model refuses this text' END AS error,
  CAST(NOT (doc_id % 5 = 0 AND version = 0) AS BIGINT) AS n_manifest, CAST(NOT (doc_id % 5 = 0 AND version = 0) AND doc_id % 7 <> 0 AS BIGINT) AS n_stored FROM v""")
def ingest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch in which a model refuses every seventh document and every fifth comes twice under one URL.

    A refused document fails alone and leaves no chunk; of two versions the last is stored.
    """
    d = _t(spark, sf_dir, "documents")
    ident = lambda v: F.concat(F.lpad(F.col("doc_id").cast("string"), 19, "0"), F.lit(f"v{v}"))
    batch = closed_documents(d, ident(0), F.lit(".")).unionByName(closed_documents(d.where("doc_id % 5 = 0"), ident(1), F.lit(", and changed.")))
    eng = ingest.Ingestor(spark, f"{_root(spark)}/kb-{uuid.uuid4().hex}", _SMALL, _refusing(8))
    results = eng.ingest(batch)
    own = lambda c: F.split(c, "-")[0]
    manifest = eng.documents().groupBy(own("id").alias("own")).agg(F.count(F.lit(1)).alias("n_manifest"))
    stored = eng.store.rows().select(own("document_id").alias("own"), "document_id").distinct().groupBy("own").agg(F.count(F.lit(1)).alias("n_stored"))
    # A version that was replaced within the batch is told under the id of the one that replaced it.
    kept = results.select(own("id").alias("own"), ingest.outcome(F.col("error"), F.col("skipped")).alias("outcome"), "error")
    kept = kept.withColumn("own", F.when(F.col("outcome") == "skipped", F.regexp_replace("own", "v1$", "v0")).otherwise(F.col("own")))
    rows = kept.join(manifest, "own", "left").join(stored, "own", "left")
    v = F.split("own", "v")
    return rows.select(v[0].cast("long").alias("doc_id"), v[1].cast("int").alias("version"), "outcome", "error", F.coalesce("n_manifest", F.lit(0)).alias("n_manifest"), F.coalesce("n_stored", F.lit(0)).alias("n_stored"))


@query("""WITH e AS (SELECT doc_id, unnest(CASE WHEN doc_id % 11 = 0 THEN [(0, 'error', NULL)] WHEN doc_id % 7 = 0 THEN [(0, 'status', 'parsing'), (2, 'status', 'chunking'), (4, 'error', NULL)]
  ELSE [(0, 'status', 'parsing'), (2, 'status', 'chunking'), (3, 'status', 'embedding'), (4, 'done', 'ready')] END) AS e FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CAST(e[1] AS BIGINT) AS seq, e[2] AS type, e[3] AS stage, CASE WHEN e[1] >= 2 AND e[2] <> 'error' THEN true END AS counted,
  CASE WHEN e[2] = 'error' THEN CASE WHEN e[1] = 0 THEN 'could not be read' ELSE 'the model refuses this text' END END AS message FROM e""")
def ingest_live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a running ingestion tells: documents stream in, each stage appends its events when it is written.

    Every eleventh document could not be parsed, and every seventh is refused by the model.
    """
    root = f"{_root(spark)}/live-{uuid.uuid4().hex}"
    sink = E.BatchSink(spark, f"{root}/events")
    eng = ingest.Ingestor(spark, f"{root}/kb", _SMALL, _refusing(8))
    name = F.col("doc_id").cast("string")

    def batch(rows: DataFrame, number: int) -> None:
        docs = closed_documents(rows, name, F.lit("."))
        eng.ingest(docs.withColumn("error", F.when(F.col("doc_id").cast("long") % 11 == 0, "could not be read")), tell=sink.tell(number))

    P.run_to_end(_stream(spark, sf_dir, "documents"), f"{root}/checkpoint", batch, "append")
    told = sink.read(ingest.INGEST_EVENT)
    counted = F.when(F.coalesce("chunks", "total").isNotNull(), F.coalesce("chunks", "total") > 0)
    return told.select(F.col("doc_id").cast("long").alias("doc_id"), "seq", "type", "stage", counted.alias("counted"), "message")


# ---------------------------------------------------------------- conversations and answers


@query("SELECT CAST(conv_id AS VARCHAR) AS chat_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, conv_id || ':' || turn AS message_id, role, text AS content FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages numbered as they arrive, from a stream in which each comes twice: state by chat and message id."""
    root = f"{_root(spark)}/chats-{uuid.uuid4().hex}"
    sink = E.BatchSink(spark, f"{root}/turns")
    c = _stream(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    chat = F.col("conv_id").cast("string")
    m = c.select(chat.alias("chat_id"), F.concat(chat, F.lit(":"), F.col("turn").cast("string")).alias("message_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    P.run_to_end(P.numbered_turns(m.unionByName(m)), f"{root}/checkpoint", sink, "append")
    return sink.read(P.NUMBERED)


@query(f"""WITH RECURSIVE {_CH}, {_KNN}, {_EXP}, {_TEXTS},
q AS (SELECT c.id AS qid, coalesce(max(score), 0) < 0.55 AS gated FROM ch c LEFT JOIN hits ON c.id = hits.qid WHERE c.id % 20 = 0 GROUP BY c.id),
first AS (SELECT qid, n, trim(regexp_extract(text, '^[^\\n]+'), ' ' || chr(9) || chr(13)) || ' [' || n || ']' AS said FROM kept WHERE regexp_extract(text, '^[^\\n]+') <> '' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n) = 1),
a AS (SELECT q.qid, q.gated, CASE WHEN q.gated THEN '{chats.REFUSAL}' ELSE coalesce(said, 'I do not know.') END AS answer, CASE WHEN said IS NOT NULL AND NOT q.gated THEN CAST(n AS VARCHAR) ELSE '' END AS cites FROM q LEFT JOIN first USING (qid)),
t AS (SELECT *, CASE WHEN gated THEN [] ELSE regexp_extract_all(answer, '\\S+\\s*|\\s+') END AS t FROM a)
SELECT qid, CAST(0 AS BIGINT) AS seq, 'meta' AS event, CASE WHEN gated THEN 'gated' ELSE 'open' END AS text FROM t
UNION ALL SELECT qid, k, 'token', x FROM (SELECT qid, unnest(range(1, len(t) + 1)) AS k, unnest(t) AS x FROM t)
UNION ALL SELECT qid, len(t) + 1, 'answer', trim(regexp_replace(regexp_replace(answer, '[ \\t]{{2,}}', ' ', 'g'), ' +([.,;:!?)\\]])', '\\1', 'g')) FROM t UNION ALL SELECT qid, len(t) + 2, 'citations', cites FROM t UNION ALL SELECT qid, len(t) + 3, 'done', '' FROM t""".replace("\\\\", "\\"))
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From search to events: contexts of all questions, answered piece by piece; gated ones are refused without a call."""
    from .catalogue import _asked, _hits, chunk_input

    head, _ = retrieval.gate(_hits(spark, sf_dir), _asked(chunk_input(spark, sf_dir)).select(F.col("id").alias("qid")))
    built = retrieval.build_context(_scored_texts(spark, sf_dir), _BUDGET).select("qid", "context", F.col("citations.n").alias("valid"))
    asked = head.join(built, "qid", "left").withColumn("question", F.concat(F.lit("What is like "), F.col("qid").cast("string"), F.lit("?")))
    return chats.stream_answers(asked, extractive_stream)


_BLOCKS = r"'See **this** [1] for ' || turn || chr(10) || '- ' || replace(text, chr(10), chr(10) || '* ') || chr(10) || chr(10) || text || chr(10) || chr(10) || '- only [2]' || chr(10) || '• **list [3]** [12] **open'"


@query(rf"""WITH a AS (SELECT conv_id * 1000 + turn AS qid, string_split_regex({_BLOCKS}, '\n{{2,}}') AS bs FROM conversations WHERE role = 'assistant'),
b AS (SELECT qid, unnest(range(len(bs))) AS bl, unnest(bs) AS body FROM a),
l AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: {S.trim("x")}), lambda x: x <> '') AS ls FROM b),
f AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '^\s*[*\-•]\s+')), true), 0) AS fb, len(list_filter(ls, lambda x: NOT regexp_matches(x, '^\s*[*\-•]\s+'))) AS np FROM l WHERE len(ls) > 0),
p AS (SELECT qid, bl, CASE WHEN np = 0 THEN [('list', ls)] WHEN fb > 1 THEN [('prose', [array_to_string(ls[1:fb - 1], ' ')]), ('list', ls[fb:])] ELSE [('prose', [body])] END AS ps FROM f),
u AS (SELECT qid, bl, unnest(range(len(ps))) AS part, unnest(ps) AS x FROM p),
r AS (SELECT qid, bl, part, x[1] AS kind, CASE WHEN x[1] = 'list' THEN list_transform(x[2], lambda y: regexp_replace(y, '^\s*[*\-•]\s+', '')) ELSE x[2] END AS items FROM u)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY bl, part) - 1 AS INTEGER) AS block, kind, array_to_string(items, '|') AS items, len(regexp_extract_all(array_to_string(items, '|'), '\*\*[^*]+\*\*')) AS n_bold,
  array_to_string(list_transform(regexp_extract_all(array_to_string(items, '|'), '\[(\d{{1,2}})\]', 1), lambda m: CAST(m AS INTEGER)), ',') AS markers FROM r""")
def answer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as they are shown: prose and lists, with bold pieces and citation markers as tokens."""
    c = _t(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.expr(_BLOCKS.replace("chr(10)", "char(10)")).alias("answer"))
    b = c.select("qid", F.posexplode(X.answer_blocks(F.col("answer"))).alias("block", "b")).select("qid", "block", "b.kind", F.array_join("b.items", "|").alias("items"))
    t = b.withColumn("t", X.inline_tokens(F.col("items")))
    # A bold piece with a marker inside is several tokens; pieces are counted where bold begins.
    bold = F.size(F.filter("t", lambda x, i: x["bold"] & ((i == 0) | ~F.coalesce(F.get("t", i - 1)["bold"], F.lit(False)))))
    marks = F.array_join(F.transform(F.filter("t", lambda x: x["marker"].isNotNull()), lambda x: x["marker"].cast("string")), ",")
    return t.select("qid", "block", "kind", "items", bold.cast("long").alias("n_bold"), marks.alias("markers"))
