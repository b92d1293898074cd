"""Registered queries of the retrieval engine and the SQL each is compared with.

The generated tables have no headings, questions, tables or document structure, so queries
declare an input: `markdown_input` writes structure into the lines of documents by line number,
`chunk_input` reads embeddings as split sections of ten-part documents.  The same input is
written in SQL; it is scaffolding of the comparison, not engine behaviour.  Structure is added as
lines of its own, every line of a text stays whole.  Searches ask for every row whose id is
divisible by 20, against all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT
from ..functions import text as X
from ..functions import vectors as V
from ..operators import chats, chunking, ingest, retrieval, store, structure
from ..sources import html as H
from ..streaming import events as E
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- declared inputs


def markdown_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, markdown, title, source_url: a title, a contents list, then the lines, each whole.

    Headings, questions and table rows stand before the lines as lines of their own.
    """

    def before(x: Column, i: Column) -> Column:
        n = i.cast("string")
        return F.concat(
            F.when(i % 12 == 0, F.concat(F.lit("## Section "), n, F.lit("\n\n")))
            .when((i % 24).isin(3, 5), F.concat(F.lit("What does line "), n, F.lit(" say?\n\n")))
            .when(i % 12 == 8, F.concat(F.lit("| Line |\n| "), n, F.lit(" |\n\n")))
            .when(i % 24 == 10, F.concat(n, F.lit("\\. Part "), n, F.lit("\n\n")))
            .otherwise(""),
            x,
        )

    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    title, url = F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.concat(F.lit("https://example.org/d/"), F.col("doc_id").cast("string"))
    toc = F.concat(F.lit("- [Section 0]("), url, F.lit("#s0)\n- [Section 12]("), url, F.lit("#s12)\n\n"))
    body = F.array_join(F.transform(F.split("text", "\n"), before), "\n\n")
    return d.select("doc_id", F.concat(F.lit("# "), title, F.lit("\n\n"), toc, body).alias("markdown"), title.alias("title"), url.alias("source_url"))


def chunk_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunks: ten to a document, sections of three parts, the last of ten whole."""
    e = _t(spark, sf_dir, "embeddings").where("vec_id is not null")
    ordinal = (F.col("vec_id") % 10).cast("int")
    part = F.when(ordinal < 9, ordinal % 3)
    return e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 10).cast("long").alias("document_id"), ordinal.alias("ordinal"), part.cast("int").alias("part_index"), F.when(part.isNotNull(), F.lit(3)).alias("part_count"), "embedding", "label")


_CH = """ch AS (SELECT vec_id AS id, vec_id // 10 AS document_id, CAST(vec_id % 10 AS INTEGER) AS ordinal, CASE WHEN vec_id % 10 < 9 THEN CAST((vec_id % 10) % 3 AS INTEGER) END AS part_index,
  CASE WHEN vec_id % 10 < 9 THEN 3 END AS part_count, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"""
_KNN = """sc AS (SELECT q.id AS qid, c.id, round(list_cosine_similarity(q.e, c.e), 12) AS score FROM ch q JOIN ch c ON q.id % 20 = 0 AND (q.id % 40 = 0 OR c.id <> q.id)),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 8)"""


def _asked(chunks: DataFrame) -> DataFrame:
    """Rows that are searched for: all whose id is divisible by 20."""
    return chunks.where("id % 20 = 0")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 8 of each search; vectors whose id is divisible by 40 find themselves, the others must not."""
    c = chunk_input(spark, sf_dir)
    q = _asked(c).select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    own = retrieval.search(q.where("qid % 40 = 0"), c, 8)
    other = retrieval.search(q.where("qid % 40 <> 0"), c, 9).where("id <> qid")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    other = other.withColumn("rank", F.row_number().over(order)).where("rank <= 8")
    return own.unionByName(other)


# ---------------------------------------------------------------- vector search


@query(f"WITH {_CH}, {_KNN} SELECT qid, id, rank, round(score, 6) AS score FROM hits")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top-8 by cosine, ties by id."""
    return _hits(spark, sf_dir).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_CH}, s AS (SELECT q.id AS qid, c.id, round(list_cosine_similarity(q.e, c.e), 12) AS score FROM ch q JOIN ch c ON q.id % 20 = 0 AND c.label = 3)
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 8""")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-8 among rows that a predicate admits; the predicate reaches the scan."""
    c = chunk_input(spark, sf_dir)
    q = _asked(c).select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    return retrieval.search(q, c, 8, F.col("label") == 3).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_CH}, {_KNN} SELECT c.id AS qid, round(coalesce(max(score), 0), 6) AS top_score, coalesce(max(score), 0) < 0.55 AS gated FROM ch c LEFT JOIN hits ON c.id = hits.qid WHERE c.id % 20 = 0 GROUP BY c.id")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _asked(chunk_input(spark, sf_dir)).select(F.col("id").alias("qid"))
    head, _ = retrieval.gate(_hits(spark, sf_dir), c)
    return head.select("qid", F.round("top_score", 6).alias("top_score"), "gated")


_EXP = """pass AS (SELECT h.*, c.document_id, c.ordinal, c.part_index, c.part_count FROM hits h JOIN ch c USING (id) WHERE h.qid IN (SELECT qid FROM hits GROUP BY qid HAVING max(score) >= 0.55)),
pull AS (SELECT p.qid, c.id, c.document_id, c.ordinal, max(p.score) * 0.95 AS score FROM pass p JOIN ch c ON p.part_index IS NOT NULL AND c.document_id = p.document_id
  AND c.ordinal BETWEEN greatest(0, p.ordinal - p.part_index) AND greatest(0, p.ordinal - p.part_index) + p.part_count - 1 GROUP BY ALL),
exp AS (SELECT qid, id, document_id, ordinal, score, true AS direct FROM pass UNION ALL
  SELECT qid, id, document_id, ordinal, score, false FROM pull WHERE NOT EXISTS (SELECT 1 FROM pass WHERE pass.qid = pull.qid AND pass.id = pull.id))"""


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_input(spark, sf_dir)
    _, hits = retrieval.gate(_hits(spark, sf_dir), c.select(F.col("id").alias("qid")))
    placed = hits.join(c.select("id", "document_id", "ordinal", "part_index", "part_count"), "id")
    return retrieval.expand_siblings(placed, c)


@query(f"WITH {_CH}, {_KNN}, {_EXP} SELECT qid, id, document_id, ordinal, round(score, 6) AS score, direct FROM exp")
def sibling_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir).withColumn("score", F.round("score", 6))


_TEXTS = """x AS (SELECT exp.*, coalesce(d.text, '') AS text, 'Title ' || (exp.document_id % 7) AS source_title, CASE WHEN exp.document_id % 3 > 0 THEN 'https://example.org/' || exp.document_id END AS source_url,
  CASE WHEN exp.ordinal % 2 = 0 THEN 'a' || exp.ordinal END AS anchor, ['Title ' || (exp.document_id % 7), 'Part ' || exp.ordinal] AS heading_path FROM exp LEFT JOIN documents d ON d.doc_id = exp.id),
r AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) + 40 AS cost, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM x),
fold AS (SELECT qid, id, k, cost AS used, true AS kept FROM r WHERE k = 1 UNION ALL
  SELECT r.qid, r.id, r.k, CASE WHEN used + r.cost > 3000 THEN used ELSE used + r.cost END, used + r.cost <= 3000 FROM fold JOIN r ON r.qid = fold.qid AND r.k = fold.k + 1),
kept AS (SELECT r.*, CAST(row_number() OVER (PARTITION BY r.qid ORDER BY source_title, document_id, ordinal) AS INTEGER) AS n FROM r JOIN fold USING (qid, id) WHERE fold.kept)"""
_BUDGET = replace(DEFAULT, context_token_budget=3000)


def _scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _expanded(spark, sf_dir).join(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "left")
    title = F.concat(F.lit("Title "), (F.col("document_id") % 7).cast("string"))
    return x.select(
        "qid", "id", "document_id", "ordinal", "score", F.coalesce("text", F.lit("")).alias("text"), title.alias("source_title"),
        F.when(F.col("document_id") % 3 > 0, F.concat(F.lit("https://example.org/"), F.col("document_id").cast("string"))).alias("source_url"),
        F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("a"), F.col("ordinal").cast("string"))).alias("anchor"),
        F.array(title, F.concat(F.lit("Part "), F.col("ordinal").cast("string"))).alias("heading_path"),
    )


@query(f"WITH RECURSIVE {_CH}, {_KNN}, {_EXP}, {_TEXTS} SELECT qid, id, n FROM kept")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-fit within 3000 tokens, numbered in reading order."""
    return retrieval.number_citations(retrieval.select_budget(_scored_texts(spark, sf_dir), _BUDGET)).select("qid", "id", "n")


@query(f"""WITH RECURSIVE {_CH}, {_KNN}, {_EXP}, {_TEXTS}, b AS (SELECT *, CASE WHEN source_url IS NOT NULL THEN source_url || coalesce('#' || anchor, '') END AS url FROM kept)
SELECT qid, string_agg('[' || n || '] ' || array_to_string(heading_path, ' › ') || coalesce('  (' || url || ')', '') || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context,
  string_agg(n || '=' || id || ':' || substr(text, 1, 400), '|' ORDER BY n) AS citations FROM b GROUP BY qid""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = retrieval.build_context(_scored_texts(spark, sf_dir), _BUDGET)
    cite = F.transform("citations", lambda c: F.concat(c["n"].cast("string"), F.lit("="), c["chunk_id"].cast("string"), F.lit(":"), c["snippet"]))
    return built.select("qid", "context", F.array_join(cite, "|").alias("citations"))


@query(f"WITH RECURSIVE {_CH}, {_KNN}, {_EXP}, {_TEXTS}, f AS (SELECT qid, document_id, min(n) AS n FROM kept GROUP BY ALL) SELECT qid, string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY n) AS documents FROM f GROUP BY qid")
def cited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a context, each once, in the order of their first citation."""
    rows = retrieval.number_citations(retrieval.select_budget(_scored_texts(spark, sf_dir), _BUDGET))
    order = F.transform(F.array_sort(F.collect_list(F.struct("n", "document_id"))), lambda s: s["document_id"].cast("string"))
    return rows.groupBy("qid").agg(F.array_join(F.array_distinct(order), ",").alias("documents"))


@query(f"""WITH {_CH}, {_KNN}, h AS (SELECT hits.qid, hits.id, hits.score, d.text FROM hits JOIN documents d ON d.doc_id = hits.id)
SELECT qid, string_agg(id || ':' || substr(text, 1, 160), '|' ORDER BY score DESC, id) AS retrieved FROM h GROUP BY qid""")
def retrieval_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each query by falling score with the opening of their text."""
    texts = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = _hits(spark, sf_dir).join(texts, "id").withColumns({"kind": F.lit("clause"), "heading_path": F.array(F.lit("T"))})
    item = F.transform("retrieved", lambda r: F.concat(r["id"].cast("string"), F.lit(":"), r["snippet"]))
    return chats.retrieval_meta(hits).select("qid", F.array_join(item, "|").alias("retrieved"))



@query(f"""WITH {_CH} SELECT id, 'clause' || CASE WHEN part_index IS NOT NULL THEN ' · part ' || (part_index + 1) || '/' || part_count ELSE '' END || CASE WHEN ordinal % 4 = 0 THEN ' · #s' || ordinal ELSE '' END AS label,
  CASE WHEN ordinal = 0 THEN 'T' ELSE 'S' || ordinal || ' › P' END AS chip FROM ch""")
def chunk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("ordinal").cast("string")
    path = F.when(F.col("ordinal") == 0, F.array(F.lit("T"))).otherwise(F.array(F.lit("T"), F.concat(F.lit("S"), o), F.lit("P")))
    anchor = F.when(F.col("ordinal") % 4 == 0, F.concat(F.lit("s"), o))
    return chunk_input(spark, sf_dir).select("id", X.chunk_label(F.lit("clause"), F.col("part_index"), F.col("part_count"), anchor).alias("label"), X.chip_label(path).alias("chip"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:32] AS h FROM embeddings), n AS (SELECT vec_id, h, sqrt(list_dot_product(h, h)) AS l FROM v)
SELECT vec_id, len(h) AS dims, round(h[1] / l, 6) AS first, round(list_sum(h) / l, 6) AS total FROM n""")
def conform_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 32 components at unit length."""
    v = _t(spark, sf_dir, "embeddings").select("vec_id", V.conform(F.col("embedding"), 32).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("dims"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS min_dims, CAST(max(len(embedding)) AS INTEGER) AS max_dims FROM embeddings")
def dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dimensions(_t(spark, sf_dir, "embeddings"))


@query("SELECT label, count(*) AS n, round(sum(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS self FROM embeddings GROUP BY label")
def cosine_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in cosine expression: 1 with itself."""
    e = _t(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(V.cosine(F.col("embedding"), F.col("embedding"))), 6).alias("self"))


# ---------------------------------------------------------------- keyed tables


@query(f"WITH {_CH} SELECT id, document_id, ordinal FROM ch WHERE id IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def ids_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _t(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    return chunk_input(spark, sf_dir).join(ids, "id", "left_semi").select("id", "document_id", "ordinal")


@query(f"WITH {_CH} SELECT id, document_id, ordinal, part_index FROM ch WHERE document_id = 7 AND ordinal BETWEEN 2 AND 6")
def ordinal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_input(spark, sf_dir).where((F.col("document_id") == 7) & F.col("ordinal").between(2, 6))
    return rows.select("id", "document_id", "ordinal", "part_index").orderBy("ordinal")


def _root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where Spark runs on this machine alone."""
    import tempfile

    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return root or tempfile.mkdtemp(prefix="tessella-")


def _scratch(spark: SparkSession, key: str) -> store.VersionedTable:
    return store.VersionedTable(spark, f"{_root(spark)}/table-{uuid.uuid4().hex}", key)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ok' ELSE 'skipped' END AS outcome, CAST(1 AS BIGINT) AS n_manifest, CAST(1 AS BIGINT) AS n_versions FROM documents""")
def ingest_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ingested, then again with every fourth one changed: what became of each, and what is left of it.

    Each text is a document of its own by a line with its id.  One manifest row and the chunks of
    one version are left of each, changed or not.
    """
    d = _t(spark, sf_dir, "documents").where("doc_id is not null")
    name, url = F.col("doc_id").cast("string"), F.concat(F.lit("https://example.org/d/"), F.col("doc_id").cast("string"))

    def version(mark: Column) -> DataFrame:
        text = F.concat(F.lit("# Document "), name, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\nThis is the closing line of document "), name, F.lit(", long enough for a chunk to be kept"), mark)
        return d.select(name.alias("doc_id"), text.alias("markdown"), F.concat(F.lit("Document "), name).alias("title"), F.lit(None).cast("string").alias("filename"), url.alias("source_url"), F.lit(None).cast("string").alias("error"))

    eng = ingest.Ingestor(spark, f"{_root(spark)}/kb-{uuid.uuid4().hex}", replace(DEFAULT, embedding_dimensions=8, embed_concurrency=8))
    eng.ingest(version(F.lit(".")))
    second = eng.ingest(version(F.when(F.col("doc_id") % 4 == 0, F.lit(", and changed.")).otherwise(F.lit("."))))
    own = F.split("id", "-")[0]
    kept = eng.documents().groupBy(own.alias("doc_id")).agg(F.count(F.lit(1)).alias("n_manifest"))
    left = eng.store.rows().select(F.split("document_id", "-")[0].alias("doc_id"), "document_id").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_versions"))
    told = second.select(own.alias("doc_id"), ingest.outcome(F.col("error"), F.col("skipped")).alias("outcome"))
    return told.join(kept, "doc_id", "left").join(left, "doc_id", "left").withColumn("doc_id", F.col("doc_id").cast("long"))


@query(f"""WITH {_CH} SELECT document_id AS id, count(*) AS n, string_agg(ordinal || ':' || id, ',' ORDER BY ordinal, id) AS chunks FROM ch GROUP BY document_id
UNION ALL SELECT -1, 0, ''""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their chunks in order; one without any has an empty list."""
    c = chunk_input(spark, sf_dir).select("id", "document_id", "ordinal", "embedding")
    m = c.select(F.col("document_id").alias("id")).distinct().unionByName(spark.createDataFrame([(-1,)], "id long"))
    item = F.transform("chunks", lambda x: F.concat(x["ordinal"].cast("string"), F.lit(":"), x["id"].cast("string")))
    return ingest.documents_with_chunks(m, c).select("id", F.size("chunks").cast("long").alias("n"), F.array_join(item, ",").alias("chunks"))


@query(f"WITH {_CH} SELECT id, document_id, ordinal FROM ch WHERE document_id <> 3")
def delete_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table after the chunks of one document were deleted."""
    t = _scratch(spark, "id")
    t.upsert(chunk_input(spark, sf_dir).select("id", "document_id", "ordinal"))
    t.delete(F.col("document_id") == 3)
    return t.read()


@query(f"WITH {_CH} SELECT id, document_id, CASE WHEN id % 5 = 0 THEN ordinal + 100 ELSE ordinal END AS ordinal FROM ch UNION ALL SELECT -1, -1, -1")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table after an upsert that replaces every fifth row and adds one."""
    rows = chunk_input(spark, sf_dir).select("id", "document_id", "ordinal")
    t = _scratch(spark, "id")
    t.upsert(rows)
    new = rows.where("id % 5 = 0").withColumn("ordinal", F.col("ordinal") + 100)
    t.upsert(new.unionByName(spark.createDataFrame([(-1, -1, -1)], "id long, document_id long, ordinal int")))
    return t.read()


@query(f"WITH {_CH} SELECT id, coalesce(part_index, -1) AS part_index, coalesce(part_count, -1) AS part_count, part_index AS back FROM ch")
def row_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-free rows and back: absence survives the sentinels."""
    c = chunk_input(spark, sf_dir).select("id", "part_index", "part_count", F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("source_url"), F.array(F.lit("h")).alias("heading_path"))
    flat = store.to_row(c)
    back = store.from_row(flat).select(F.col("id").alias("i"), F.col("part_index").alias("back"))
    return flat.join(back, flat["id"] == back["i"]).select("id", "part_index", "part_count", "back")


@query("SELECT doc_id, sha256(text) AS content_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS is_first FROM documents")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown"))
    return ingest.first_of_hash(d).select("doc_id", "content_hash", "is_first")


_OLD = "CASE WHEN doc_id % 4 = 0 THEN text || ' old' ELSE text END"


@query(f"""WITH m AS (SELECT doc_id AS id, sha256({_OLD}) AS h, 'https://example.org/' || source || '/' || doc_id AS u FROM documents WHERE doc_id % 2 = 0),
n AS (SELECT doc_id, sha256(text) AS h, 'https://example.org/' || source || '/' || doc_id AS u, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS f FROM documents)
SELECT n.doc_id, CASE WHEN NOT f OR n.h IN (SELECT h FROM m) THEN 'skip' WHEN m.id IS NOT NULL THEN 'replace' ELSE 'new' END AS action FROM n LEFT JOIN m ON m.u = n.u""")
def replace_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ingestion does with each document against a manifest of every second one, half of them changed since."""
    d = _t(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://example.org/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    docs = d.select("doc_id", F.col("text").alias("markdown"), url.alias("source_url"), F.lit(None).cast("string").alias("filename"))
    old = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    manifest = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.sha2(old, 256).alias("content_hash"), F.lit("ready").alias("status"), url.alias("source_url"), F.lit(None).cast("string").alias("filename"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    fresh, skipped = ingest.skip_known(docs, manifest)
    prior = ingest.prior_versions(fresh, manifest)
    done = fresh.join(prior, "doc_id", "left").select("doc_id", F.when(F.col("prior_id").isNotNull(), "replace").otherwise("new").alias("action"))
    return done.unionByName(skipped.select("doc_id", F.lit("skip").alias("action")))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN doc_id % 10 = 0 THEN 'x' END AS error FROM documents")
def manifest_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some columns of some rows laid over a manifest; an unknown id changes nothing."""
    d = _t(spark, sf_dir, "documents")
    m = d.select(F.col("doc_id").alias("id"), F.lit("ready").alias("status"), F.lit(None).cast("string").alias("error"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    change = d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("id"), F.lit("failed").alias("status"), F.lit("x").alias("error"))
    change = change.unionByName(spark.createDataFrame([(-5, "failed", "x")], "id long, status string, error string"))
    return ingest.patch(m, change, F.lit("2024-02-01").cast("timestamp")).select(F.col("id").alias("doc_id"), "status", "error")


@query("""WITH r AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'HTTP 404, an error page' WHEN doc_id % 11 = 0 THEN 'no markdown' END AS error, doc_id % 5 = 0 AS skipped, CAST(n_chars // 100 AS BIGINT) AS chunks FROM documents)
SELECT CASE WHEN skipped THEN 'skipped' WHEN regexp_matches(error, '(?i)error page|HTTP 4\\d\\d') THEN 'refused' WHEN error IS NOT NULL THEN 'failed' ELSE 'ok' END AS outcome, count(*) AS n, CAST(sum(chunks) AS BIGINT) AS chunks FROM r GROUP BY 1""".replace("\\\\", "\\"))
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    error = F.when(F.col("doc_id") % 7 == 0, "HTTP 404, an error page").when(F.col("doc_id") % 11 == 0, "no markdown")
    return ingest.seed_totals(d.select(error.alias("error"), (F.col("doc_id") % 5 == 0).alias("skipped"), F.floor(F.col("n_chars") / 100).alias("chunks")))


# ---------------------------------------------------------------- text structure

_RAW = r"""CASE WHEN doc_id % 4 = 0 THEN '## Doc ' || doc_id || chr(13) || chr(10) || chr(10) || '# Doc ' || doc_id || chr(10) || 'reCAPTCHA' || chr(10) WHEN doc_id % 4 = 1 THEN 'Skip to content' || chr(10) || '### Part' || chr(10) ELSE '' END
 || text || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || ' Accept cookies ' || chr(13) || '## End' || chr(10) || 'last.'"""
_N1 = rf"regexp_replace(raw, '\r\n?', chr(10), 'g')"
_N2 = rf"array_to_string(list_filter(string_split({_N1}, chr(10)), lambda x: NOT {S.boilerplate('x')}), chr(10))"


@query(rf"""WITH a AS (SELECT doc_id, {_RAW} AS raw FROM documents), b AS (SELECT doc_id, {_N2} AS m FROM a),
c AS (SELECT doc_id, m, regexp_replace(lower(regexp_extract(m, '(?m)^\s*##\s+(.+)\n+#\s+(.+)$', 1)), '[^a-z0-9]', '', 'g') AS p, regexp_replace(lower(regexp_extract(m, '(?m)^\s*##\s+(.+)\n+#\s+(.+)$', 2)), '[^a-z0-9]', '', 'g') AS q FROM b),
e AS (SELECT doc_id, CASE WHEN p <> '' AND (contains(p, q) OR contains(q, p)) THEN regexp_replace(m, '(?m)^\s*##\s+.+\n+(#\s)', '\1') ELSE m END AS m FROM c),
f AS (SELECT doc_id, {S.trim(r"regexp_replace(regexp_replace(m, '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS m FROM e)
SELECT doc_id, CASE WHEN regexp_matches(m, '^#\s') THEN m ELSE regexp_replace(m, '(?m)^#{{2,6}}(\s+)', '#\1') END AS markdown,
  sha256(CASE WHEN regexp_matches(m, '^#\s') THEN m ELSE regexp_replace(m, '(?m)^#{{2,6}}(\s+)', '#\1') END) AS content_hash FROM f""")
def normalize_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalisation of texts with a repeated title, furniture lines, mixed line ends and blank runs."""
    i = F.col("doc_id").cast("string")
    lead = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("## Doc "), i, F.lit("\r\n\n# Doc "), i, F.lit("\nreCAPTCHA\n"))).when(F.col("doc_id") % 4 == 1, F.lit("Skip to content\n### Part\n")).otherwise("")
    raw = F.concat(lead, F.col("text"), F.lit("  \n\n\n\n Accept cookies \r## End\nlast."))
    md = _t(spark, sf_dir, "documents").select("doc_id", X.normalize_markdown(raw).alias("markdown"))
    return md.withColumn("content_hash", X.content_hash(F.col("markdown")))


@query(S.chain(S.LINES, "SELECT d.doc_id, (SELECT count(*) FROM toc WHERE toc.doc_id = d.doc_id) AS n_toc, (SELECT string_agg(title || ' ' || url, ';' ORDER BY i) FROM toc WHERE toc.doc_id = d.doc_id) AS toc, (SELECT count(*) FROM lines WHERE lines.doc_id = d.doc_id) AS n_rest FROM d"))
def toc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = structure.mark_toc(markdown_input(spark, sf_dir).select("doc_id", "markdown"))
    per = lines.groupBy("doc_id").agg(F.count_if("is_toc").alias("n_toc"), F.count_if(~F.col("is_toc")).alias("n_rest"))
    item = F.struct("i", F.concat("title", F.lit(" "), "url").alias("t"))
    told = structure.toc_entries(lines).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), ";").alias("toc"))
    return per.join(told, "doc_id", "left")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.doc_lines(markdown_input(spark, sf_dir).select("doc_id", "markdown"))


@query(S.chain(S.CANDIDATES, "SELECT doc_id, pos, key, in_fence, alone, followed, candidate FROM cand"))
def heading_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_candidates(_lines(spark, sf_dir)).select("doc_id", "pos", "key", "in_fence", "alone", "followed", "candidate")


@query(S.chain(S.PROMOTED, "SELECT doc_id, pos, promoted, line FROM prom"))
def promote_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.promote(structure.heading_candidates(_lines(spark, sf_dir))).select("doc_id", "pos", "promoted", "line")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.sections(structure.section_lines(structure.promote(structure.heading_candidates(_lines(spark, sf_dir)))))


@query(S.chain(S.SECTIONS, "SELECT doc_id, section, array_to_string(heading_path, ' > ') AS heading_path, body FROM sec"))
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).select("doc_id", "section", F.array_join("heading_path", " > ").alias("heading_path"), "body")


@query(S.chain(S.PARAGRAPHS, "SELECT doc_id, section, CAST(ppos AS INTEGER) AS ppos, p, tokens, is_q, is_table FROM par"))
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.paragraphs(_sections(spark, sf_dir)).select("doc_id", "section", "ppos", "p", "tokens", "is_q", "is_table")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.marked(structure.paragraphs(_sections(spark, sf_dir)))


#: A smaller bound, so that the runs of the declared input need several chunks.
_SMALL = replace(DEFAULT, max_chunk_tokens=120)
_D = "doc_id, section, run, slot, part, kind, text, question, part_index, part_count"


@query(S.chain(S.DRAFTS, f"SELECT {_D} FROM qa"))
def qa_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.drafts(_marked(spark, sf_dir)).where("kind in ('qa', 'prose')").select(*_D.split(", "))


@query(S.chain(S.DRAFTS, f"SELECT {_D} FROM tab"))
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.drafts(_marked(spark, sf_dir)).where("kind = 'table'").select(*_D.split(", "))


@query(S.chain(S.DRAFTS, f"SELECT {_D} FROM packed"))
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.drafts(_marked(spark, sf_dir), _SMALL).where("kind = 'clause'").select(*_D.split(", "))


@query(S.chain(S.CHUNKS, "SELECT id, document_id, ordinal, text, kind, array_to_string(heading_path, ' > ') AS heading_path, anchor, question, part_index, part_count, source_url, source_title FROM chunks"))
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks, end to end."""
    c = chunking.chunk_documents(markdown_input(spark, sf_dir), _SMALL)
    return c.withColumn("document_id", F.col("document_id").cast("string")).withColumn("heading_path", F.array_join("heading_path", " > "))


@query(S.chain(S.CHUNKS, "SELECT kind, count(*) AS n FROM chunks GROUP BY kind"))
def chunk_kind_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.kind_histogram(chunking.chunk_documents(markdown_input(spark, sf_dir), _SMALL))


@query(S.chain(S.CHUNKS, f"SELECT count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents, max({S.tokens('text')}) AS max_tokens, CAST(sum({S.tokens('text')}) AS BIGINT) AS sum_tokens FROM chunks"))
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_stats(chunking.chunk_documents(markdown_input(spark, sf_dir), _SMALL))


@query(S.chain(S.CHUNKS, """SELECT document_id, ordinal - part_index AS first_ordinal, count(*) AS n, max(part_count) AS part_count,
  count(*) = max(part_count) AND min(part_index) = 0 AND max(part_index) = max(part_count) - 1 AND count(DISTINCT heading_path) = 1 AS whole FROM chunks WHERE part_index IS NOT NULL GROUP BY 1, 2"""))
def family_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = chunking.family_integrity(chunking.chunk_documents(markdown_input(spark, sf_dir), _SMALL))
    return f.withColumn("document_id", F.col("document_id").cast("string"))


@query(S.chain(S.CHUNKS, "SELECT id, array_to_string(heading_path, ' › ') || chr(10) || chr(10) || text AS embedding_text FROM chunks"))
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.chunk_documents(markdown_input(spark, sf_dir), _SMALL)
    return c.select("id", X.embedding_text(F.col("heading_path"), F.col("text")).alias("embedding_text"))




@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT *, trim(line) AS key, regexp_matches(trim(line), '^#{1,6}\s') OR length(trim(line)) >= 25 AS worth FROM l)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM k QUALIFY NOT worth OR row_number() OVER (PARTITION BY doc_id, worth, key ORDER BY pos) = 1""")
def page_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of each repeated heading or long line of a text."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("key", F.trim("line"))
    rows = rows.withColumn("worth", F.col("key").rlike(r"^#{1,6}\s") | (F.length("key") >= 25))
    first = Window.partitionBy("doc_id", "worth", "key").orderBy("pos")
    return rows.withColumn("n", F.row_number().over(first)).where("not worth or n = 1").select("doc_id", "pos", "line")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
SELECT doc_id, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS INTEGER) AS cell, count(*) AS n FROM w GROUP BY ALL""")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the stand-in embedding: words hashed into 64."""
    w = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"))).alias("w"))
    # Words of a document are counted first, and hashed once each.
    cell = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(64)).cast("int")
    return w.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", cell.alias("cell")).agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- pages


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


@query(r"""WITH s AS (SELECT page_id, nullif(string_split(regexp_replace(string_split(url, '?')[1], '/$', ''), '/')[-1], '') AS s FROM pages)
SELECT page_id, array_to_string(list_transform(string_split(regexp_replace(s, '[-_]+', ' ', 'g'), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM s""")
def url_slug_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", X.slug_title(F.col("url")).alias("title"))


@query("SELECT page_id, url || CASE WHEN page_id % 3 > 0 THEN '#p' || page_id ELSE '' END AS link FROM pages")
def citation_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("p"), F.col("page_id").cast("string")))
    return _t(spark, sf_dir, "pages").select("page_id", X.citation_url(F.col("url"), anchor).alias("link"))


@query()
def refuse_short_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages that are no documents, judged by the Markdown of the whole page (no SQL equivalent)."""
    from ..sources.files import refuse_pages

    return refuse_pages(H.with_markdown(_t(spark, sf_dir, "pages"))).select("page_id", "skipped")



@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown without their furniture (no SQL equivalent)."""
    return H.with_markdown(_t(spark, sf_dir, "pages")).select("page_id", "markdown")


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(url, '[^/]*$'), '[^\\w.\\- ]+', '_', 'g'), ''), 'upload') AS name, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS ext FROM pages")
def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", X.safe_upload_name(F.col("url")).alias("name"), X.extension(F.col("url")).alias("ext"))


# ---------------------------------------------------------------- conversations

_TURNS = "t AS (SELECT conv_id AS chat_id, turn, role, text AS content FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), "turn", "role", F.col("text").alias("content"))


@query(rf"""WITH {_TURNS}, q AS (SELECT chat_id, turn, content AS question FROM t WHERE role = 'user'),
h AS (SELECT q.chat_id, q.turn AS qt, t.turn, CASE WHEN t.role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr(t.content, 1, 500) AS line FROM q JOIN t ON t.chat_id = q.chat_id AND t.turn < q.turn AND {S.trim("t.content")} <> ''
  QUALIFY row_number() OVER (PARTITION BY q.chat_id, q.turn ORDER BY t.turn DESC) <= 6)
SELECT q.chat_id, q.turn, q.question, (SELECT string_agg(line, chr(10) ORDER BY h.turn) FROM h WHERE h.chat_id = q.chat_id AND h.qt = q.turn) AS history FROM q""")
def condense_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return chats.render_history(t, t.where("role = 'user'").select("chat_id", "turn", F.col("content").alias("question")))


@query(f"WITH {_TURNS} SELECT chat_id, turn, CASE WHEN turn = 0 THEN content ELSE CASE WHEN length(trim(string_split(trim(content), chr(10))[1])) >= 3 THEN trim(string_split(trim(content), chr(10))[1]) ELSE content END END AS condensed FROM t WHERE role = 'user'")
def condense_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post-processing of a model that quotes the question back; first turns skip it."""
    t = _turns(spark, sf_dir).where("role = 'user'")
    reply = F.concat(F.lit('"'), F.trim("content"), F.lit('"\n and more'))
    return t.select("chat_id", "turn", F.when(F.col("turn") == 0, F.col("content")).otherwise(chats.condensed(reply, F.col("content"))).alias("condensed"))


@query(f"WITH {_TURNS}, f AS (SELECT chat_id, arg_min(role, turn) AS r, arg_min(content, turn) AS c FROM t GROUP BY chat_id) SELECT chat_id, CASE WHEN r = 'user' THEN substr(c, 1, 70) ELSE 'New conversation' END AS title FROM f")
def chat_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.titles(_turns(spark, sf_dir))


@query(f"WITH {_TURNS}, f AS (SELECT chat_id, count(*) AS n_turns, max(turn) AS last_turn, arg_min(role, turn) AS r, arg_min(content, turn) AS c FROM t GROUP BY chat_id) SELECT chat_id, n_turns, last_turn, CASE WHEN r = 'user' THEN substr(c, 1, 70) ELSE 'New conversation' END AS title FROM f")
def chat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.sessions(_turns(spark, sf_dir)).orderBy(F.col("last_turn").desc(), "chat_id")


_ANS = r"content || ' [1] and [2, 9] , [07][2004] (' || turn || ' [8] )  end [3,1] .'"


@query(rf"""WITH {_TURNS}, a AS (SELECT chat_id * 100 + turn AS qid, {_ANS} AS s FROM t WHERE role = 'assistant'),
c AS (SELECT qid, s, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\[1\]', '[1]', 'g'), '\[2, 9\]', '[2]', 'g'), '\[07\]', '', 'g'), '\[8\]', '', 'g'), '\[3,1\]', '[3][1]', 'g') AS x FROM a)
SELECT qid, {S.trim(r"regexp_replace(regexp_replace(x, '[ \t]{2,}', ' ', 'g'), ' +([.,;:!?)\]])', '\1', 'g')")} AS answer, '1,2,3' AS used FROM c""")
def citations_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant texts with markers added, against the citations 1 to 5."""
    t = _turns(spark, sf_dir).where("role = 'assistant'")
    answer = F.concat(F.col("content"), F.lit(" [1] and [2, 9] , [07][2004] ("), F.col("turn").cast("string"), F.lit(" [8] )  end [3,1] ."))
    a = t.select((F.col("chat_id") * 100 + F.col("turn")).alias("qid"), answer.alias("answer"))
    c = a.select("qid", F.explode(F.array(*[F.lit(n) for n in range(1, 6)])).alias("n"))
    return chats.validate(a, c).withColumn("used", F.array_join("used", ","))


@query(f"WITH {_TURNS} SELECT chat_id, turn, content, 'event: turn' || chr(10) || 'data: {{\"chat_id\":' || chat_id || ',\"turn\":' || turn || '}}' || chr(10) || chr(10) AS frame FROM t".replace("{{", "{").replace("}}", "}"))
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return t.select("chat_id", "turn", "content", X.sse_frame(F.lit("turn"), F.struct("chat_id", "turn")).alias("frame"))


# ---------------------------------------------------------------- events and scalars


@query("SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS stage, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), "value")
    return E.latest_progress(e, "key", "seq")


@query(ORACLE["progress_latest"])
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over the event files, run to its end: each batch appends its changed rows, of which the last hold."""
    path, root = f"{sf_dir}/events.parquet", f"{_root(spark)}/progress-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), "value")
    sink = E.BatchSink(spark, f"{root}/changes")
    writer = E.progress_stream_agg(e).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
    writer.foreachBatch(sink).start().awaitTermination()
    return E.latest_progress(sink.read("key long, seq long, stage string, value double"), "key", "seq")


@query("SELECT event_id, CAST(least(30000, 500 * pow(2, event_id % 12)) AS INTEGER) AS ms FROM events")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long to wait before each attempt; events stand for attempts."""
    return _t(spark, sf_dir, "events").select("event_id", X.backoff_ms(F.col("event_id") % 12).alias("ms"))


@query("SELECT event_id, CAST(CASE WHEN user_id % 7 = 0 THEN 0 ELSE round(100.0 * (event_id % 50) / (user_id % 7 * 50)) END AS INTEGER) AS pct FROM events")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", X.progress_percent(F.col("event_id") % 50, F.col("user_id") % 7 * 50).alias("pct"))


@query("""SELECT conv_id AS qid, string_agg(text, '' ORDER BY turn) FILTER (WHERE role <> 'system') AS tokens,
  coalesce(arg_max(text, turn) FILTER (WHERE role = 'system'), string_agg(text, '' ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS answer FROM conversations GROUP BY conv_id""")
def answer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token events joined in order, a final answer event over them; turns stand for tokens, system turns for answers."""
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("seq"), F.when(F.col("role") == "system", "answer").otherwise("token").alias("event"), "text")
    tokens = E.accumulate_answers(c.where("event = 'token'")).withColumnRenamed("answer", "tokens")
    return E.accumulate_answers(c).join(tokens, "qid", "left")


@query("""WITH q AS (SELECT conv_id * 1000 + turn AS qid, text, turn % 3 = 0 AS gated FROM conversations WHERE role = 'assistant'),
w AS (SELECT qid, text, gated, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '\\S+\\s*|\\s+') END AS t FROM q),
e AS (SELECT qid, 0 AS seq, 'meta' AS event, CASE WHEN gated THEN 'gated' ELSE 'open' END AS text FROM w
  UNION ALL SELECT qid, k, 'token', x FROM (SELECT qid, unnest(range(1, len(t) + 1)) AS k, unnest(t) AS x FROM w)
  UNION ALL SELECT qid, len(t) + 1, 'answer', text FROM w UNION ALL SELECT qid, len(t) + 2, 'citations', '1,2' FROM w UNION ALL SELECT qid, len(t) + 3, 'done', '' FROM w)
SELECT qid, CAST(seq AS BIGINT) AS seq, event, text FROM e""".replace("\\\\", "\\"))
def answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer as it is streamed: meta, tokens, the whole answer, citations, done."""
    c = _t(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.when(F.col("turn") % 3 == 0, "gated").otherwise("open").alias("meta"), F.col("text").alias("answer"), F.lit("1,2").alias("citations"))
    return E.answer_events(rows)


@query("SELECT conv_id, turn, regexp_matches(text, '\\S') AS asked, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'a question is required' END AS error FROM conversations".replace("\\\\", "\\"))
def blank_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without a word are refused before anything is searched."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    return chats.checked_questions(c).select("conv_id", "turn", F.col("error").isNull().alias("asked"), "error")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows over events: an extension, not one of the retrieval operators."""
    return E.event_counts(_t(spark, sf_dir, "events"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END AS snippet, conv_id || '-' || turn ~ '^[A-Za-z0-9_-]{1,64}$' AS good_id FROM conversations")
def turn_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", X.snippet(F.col("text"), 100).alias("snippet"), X.is_chat_id(ident).alias("good_id"))


from . import live  # noqa: E402, F401  (registers its queries)
