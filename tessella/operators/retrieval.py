"""Exact vector search, relevance gate, sibling expansion and context assembly for batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, EngineConf
from ..functions import text as X

#: Vectors and bytes of a block; queries that are sent to every task at most, beyond which blocks are paired by partitions.
BLOCK, BLOCK_BYTES, SENT_QUERIES = 1024, 2 << 20, 16_384
#: Hits that are sent to a scan of chunks at most; more are shuffled.
HIT_ROWS = 200_000


def _dense(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dims)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def dimensions(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows, smallest and largest length of a vector column; nulls when there are no rows."""
    size = F.size(column)
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("min_dims"), F.max(size).alias("max_dims"))


def assert_dimensions(vectors: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """The same rows; reading a vector of another length raises."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {dims} dimensions, found "), F.size(column).cast("string"))).cast(vectors.schema[column].dataType)
    return vectors.withColumn(column, F.when(F.size(column) != dims, wrong).otherwise(F.col(column)))


def search(queries: DataFrame, corpus: DataFrame, k: int | None = None, where: Column | None = None, conf: EngineConf = DEFAULT) -> DataFrame:
    """(qid, qvec) x (id, embedding) -> qid, id, score, rank: the k best by cosine, ties by id.

    Exact: a block nested loop of query blocks and corpus blocks.  Both sides are packed into rows
    of some thousand vectors where they lie; one scan of the corpus meets the query blocks, which
    are sent to every task where they are few and are paired partition by partition beyond that.  A
    task scores a pair of blocks by a matrix product and keeps a running k best of each of its
    queries, so what is shuffled is k rows a task and query, whatever the corpus.  Nothing goes
    through the driver.  `where` filters the corpus before the scan.  Ids of queries and of rows are
    of any one type.  Null and empty vectors, and those with a null or not finite component, never
    match; a zero vector scores 0.
    """
    k = conf.top_k if k is None else k
    corpus = corpus if where is None else corpus.where(where)
    rows = _blocks(corpus.select("id", "embedding"), "id", "embedding", "c")
    asked = _blocks(queries.select("qid", "qvec"), "qid", "qvec", "q")
    few = queries.select("qid").limit(SENT_QUERIES + 1).count() <= SENT_QUERIES
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, score double"
    out = rows.crossJoin(F.broadcast(asked) if few else asked).mapInArrow(_score_blocks(k, kinds), kinds)
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _usable(column: str) -> Column:
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (F.size(column) > 0) & F.coalesce(finite, F.lit(False))


def _blocks(rows: DataFrame, id_: str, vector: str, side: str) -> DataFrame:
    """Usable vectors as blocks: <side>_block, <side>_dims, <side>_ids and <side>_unit (unit vectors one after the other)."""
    names = [f"{side}_{x}" for x in ("block", "dims", "ids", "unit")]
    kind = rows.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            longest = pa.compute.max(pa.compute.list_value_length(batch[vector])).as_py() or 1
            step = max(1, min(BLOCK, BLOCK_BYTES // (8 * longest)))
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                vectors = pa.concat_arrays([some[vector]])
                dims = pa.compute.unique(pa.compute.list_value_length(vectors)).to_pylist()
                if len(dims) > 1:
                    raise ValueError(f"vectors of {sorted(dims)} dimensions")
                unit = _unit(_dense(vectors, dims[0]))
                ids = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.concat_arrays([some[id_]]))
                yield pa.RecordBatch.from_arrays([pa.array([part + n]), pa.array([dims[0]], pa.int64()), ids, pa.array([unit.tobytes()], pa.binary())], names=names)
                n += 1

    return rows.where(_usable(vector)).mapInArrow(run, f"{names[0]} long, {names[1]} long, {names[2]} array<{kind}>, {names[3]} binary")


def _score_blocks(k: int, kinds: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}  # of each query block: its ids, and scores and row ids of the best so far, a column a query
        for batch in batches:
            for r in range(batch.num_rows):
                dims, block = batch["q_dims"][r].as_py(), batch["q_block"][r].as_py()
                if batch["c_dims"][r].as_py() != dims:
                    raise ValueError(f"corpus vectors must have {dims} dimensions")
                q, c = (np.frombuffer(batch[f"{x}_unit"][r].as_buffer(), dtype=np.float64).reshape(-1, dims) for x in "qc")
                score = np.round(c @ q.T, 12)
                own = np.array(batch["c_ids"][r].as_py(), dtype=object)
                at = _best(score, lambda i, j, own=own: own[i], k)
                score, ids = np.take_along_axis(score, at, 0), own[at]
                if block in best:
                    asked, s, i = best[block]
                    score, ids = np.concatenate([s, score]), np.concatenate([i, ids])
                    at = _best(score, lambda i, j, ids=ids: ids[i, j], k)
                    score, ids = np.take_along_axis(score, at, 0), np.take_along_axis(ids, at, 0)
                else:
                    asked = pa.array(batch["q_ids"][r].as_py(), schema.field("qid").type)
                best[block] = (asked, score, ids)
        for asked, score, ids in best.values():
            take = pa.array(np.repeat(np.arange(len(asked)), len(score)))
            yield pa.RecordBatch.from_arrays([asked.take(take), pa.array(ids.T.ravel().tolist(), schema.field("id").type), pa.array(score.T.ravel())], schema=schema)

    return run


def _best(score: np.ndarray, id_of: Callable[[np.ndarray, int], np.ndarray], k: int) -> np.ndarray:
    """Rows of the k best of each column; where scores tie at the edge, the smallest ids stay."""
    if len(score) <= k:
        return np.repeat(np.arange(len(score))[:, None], score.shape[1], axis=1)
    at = np.argpartition(-score, k - 1, axis=0)[:k]
    edge = np.take_along_axis(score, at, 0).min(axis=0)
    for j in np.flatnonzero((score >= edge).sum(axis=0) > k).tolist():
        above = np.flatnonzero(score[:, j] > edge[j])
        tied = np.flatnonzero(score[:, j] == edge[j])
        ids = id_of(tied, j).tolist()
        order = sorted(range(len(tied)), key=ids.__getitem__)[: k - len(above)]
        at[:, j] = np.concatenate([above, tied[order]])
    return at


def kept_hits(hits: DataFrame) -> DataFrame:
    """Hits written once, for several steps to read: a checkpoint in the shared folder that the session names.

    Where none is named, as on a single machine without one, they are left as they are.
    """
    return hits if hits.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty() else hits.checkpoint()


def with_hits(hits: DataFrame, chunks: DataFrame, asked: int | None = None) -> DataFrame:
    """Hits (qid, id, ...) with the columns of their chunks: sent to the scan where they are few.

    How many there are at most is k times the queries `asked`; where that is not told, they are counted.
    """
    few = (hits.limit(HIT_ROWS + 1).count() if asked is None else asked) <= HIT_ROWS
    return chunks.join(F.broadcast(hits) if few else hits, "id")


def gate(hits: DataFrame, queries: DataFrame, conf: EngineConf = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(per query: qid, top_score, gated; hits of queries that pass).  No hit, or a best one below the minimum, gates."""
    top = hits.groupBy("qid").agg(F.max("score").alias("top"))
    head = queries.select("qid").join(top, "qid", "left").select("qid", F.coalesce("top", F.lit(0.0)).alias("top_score"), (F.col("top").isNull() | (F.col("top") < conf.min_score)).alias("gated"))
    best = F.max("score").over(Window.partitionBy("qid"))
    return head, hits.withColumn("_top", best).where(F.col("_top") >= conf.min_score).drop("_top")


def expand_siblings(hits: DataFrame, chunks: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """Hits plus the other parts of their split sections: a range join on document and ordinal.

    hits: qid, id, score, document_id, ordinal, part_index, part_count; chunks: id, document_id,
    ordinal.  A sibling takes 0.95 of its best puller's score; hits keep theirs.
    """
    spans = hits.where("part_index is not null and part_count is not null").select(
        "qid", F.col("document_id").alias("d"), F.greatest(F.lit(0), F.col("ordinal") - F.col("part_index")).alias("lo"), "part_count", "score")
    near = spans.join(chunks.select("id", "document_id", "ordinal"), (F.col("d") == F.col("document_id")) & F.col("ordinal").between(F.col("lo"), F.col("lo") + F.col("part_count") - 1))
    pulled = near.groupBy("qid", "id", "document_id", "ordinal").agg((F.max("score") * conf.sibling_score_discount).alias("score"))
    more = pulled.join(hits.select("qid", "id"), ["qid", "id"], "left_anti")
    return hits.select("qid", "id", "document_id", "ordinal", "score", F.lit(True).alias("direct")).unionByName(more.select("qid", "id", "document_id", "ordinal", "score", F.lit(False).alias("direct")))


def retrieve(queries: DataFrame, chunks: DataFrame, conf: EngineConf = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Search, gate and expansion: (headers, chunk rows with score) for a batch of queries."""
    found = kept_hits(search(assert_dimensions(queries, conf.embedding_dimensions, "qvec"), chunks, conf=conf))
    head, hits = gate(found, queries, conf)
    asked = queries.select("qid").limit(HIT_ROWS + 1).count() * conf.top_k
    placed = with_hits(hits, chunks.select("id", "document_id", "ordinal", "part_index", "part_count"), asked)
    return head, expand_siblings(placed, chunks, conf)


def select_budget(scored: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """(qid, id, score, text, ...) -> the rows that fit: best first, one that does not fit is skipped.

    The best always stays.  The fold runs over the candidates of one query, which retrieval bounds.
    """
    one = Window.partitionBy("qid", "id").orderBy(F.col("score").desc())
    unique = scored.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    cost = (X.token_count(F.col("text")) + conf.context_header_tokens).cast("long")
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"), cost.alias("t"))))
    id_type = scored.schema["id"].dataType.simpleString()
    zero = F.expr(f"named_struct('sum', 0L, 'kept', cast(array() as array<{id_type}>))")

    def step(a: Column, x: Column) -> Column:
        over = (a["sum"] + x["t"] > conf.context_token_budget) & (F.size(a["kept"]) > 0)
        return F.struct(F.when(over, a["sum"]).otherwise(a["sum"] + x["t"]).alias("sum"), F.when(over, a["kept"]).otherwise(F.concat(a["kept"], F.array(x["id"]))).alias("kept"))

    kept = unique.groupBy("qid").agg(F.aggregate(items, zero, step, lambda a: a["kept"]).alias("kept"))
    return unique.join(kept.select("qid", F.explode("kept").alias("id")), ["qid", "id"])


def number_citations(kept: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """Rows in reading order (title, document, ordinal) with n from 1 for each query.

    Titles are ordered as the collation of the settings has them: by letters first, then by accents and case.
    """
    order = Window.partitionBy("qid").orderBy(F.collate("source_title", conf.title_collation), "document_id", "ordinal")
    return kept.withColumn("n", F.row_number().over(order))


def context_block(conf: EngineConf = DEFAULT) -> Column:
    url = X.citation_url(F.col("source_url"), F.col("anchor"))
    head = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.array_join("heading_path", " › "), F.when(url.isNotNull(), F.concat(F.lit("  ("), url, F.lit(")"))).otherwise(""))
    return F.concat(head, F.lit("\n"), F.col("text"))


def build_context(scored: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """qid, context, citations: verbatim chunks within the token budget, in reading order, numbered."""
    rows = number_citations(select_budget(scored, conf), conf).withColumn("block", context_block(conf))
    cite = F.struct("n", F.col("id").alias("chunk_id"), F.col("source_title").alias("document_title"), "heading_path", "source_url", "anchor", F.substring("text", 1, conf.citation_snippet_chars).alias("snippet"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda s: s["block"])
    return rows.groupBy("qid").agg(F.array_join(blocks, "\n\n---\n\n").alias("context"), F.array_sort(F.collect_list(cite)).alias("citations"))
