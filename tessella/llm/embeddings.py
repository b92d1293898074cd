"""Embedding near-duplicates by a pivot-permutation index.

Each vector is described by the ordered nearest of a fixed set of reference points (unit
directions, applied after the corpus mean is taken off).  Inverted lists hold, for each pivot,
the vectors that have it among their `prefix` nearest, with the whole ordered prefix.  Within a
list the pivots that two vectors share are counted; where they share `shared` or more, and their
ranks of these differ by no more than the fitted bound, the pair is verified by its cosine in
double precision.  A pair is looked at in one list only, that of its smallest common pivot.

A list longer than `list_rows` is divided by a second pivot, a third, and so on up to `shared`:
two vectors of it that qualify share those pivots too, so they meet again in the sub-list of
their smallest common ones.  What is too long after that is cut into blocks, each pair of blocks
its own task.  Memory is bounded, no pair is left out, and rows grow with vectors, not pairs.

`shared` and the rank bound are fitted on a bounded sample: up to 2,000 vectors (by a hash of
the id), each with a partner at exactly the threshold in a random direction, must be found with a
measured recall of 0.998.  Vectors that lie close about their mean are thus searched with fewer
shared pivots, or longer prefixes, than spread-out ones.  Equal vectors are one class and are posted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, batch_of, pick, table
from .components import connected_components
from .minhash import whole_groups

PIVOTS, PREFIX, SHARED, THRESHOLD, RECALL, SAMPLE = 256, 8, 4, 0.98, 0.998, 2_000


def pivots(n: int, dims: int, seed: int = 64) -> np.ndarray:
    p = np.random.Generator(np.random.PCG64(seed)).normal(size=(n, dims))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a list column, padded with zeros to `dims`, and their lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(size), dims))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square is lost or infinite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def permutation_prefix(x: np.ndarray, mean: np.ndarray, points: np.ndarray, prefix: int) -> np.ndarray:
    """Ids of the `prefix` nearest reference points of each vector, nearest first."""
    return np.argsort(-((units(x) - mean) @ points.T), axis=1, kind="stable")[:, :prefix]


def agreement(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivots that two ordered prefixes share, and by how much their ranks of these differ in all; row by row."""
    n, apart = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
    ranks = np.arange(b.shape[1])
    for r in range(a.shape[1]):
        same = a[:, r, None] == b
        n += same.sum(axis=1)
        apart += (same * np.abs(ranks - r)).sum(axis=1)
    return n, apart


def fit_index(x: np.ndarray, mean: np.ndarray, points: np.ndarray, threshold: float, prefix: int, most: int, recall: float, seed: int = 11) -> tuple[int, int, int]:
    """(prefix, shared, displacement): the strictest by which sample vectors find partners at the threshold with the recall asked.

    Where one shared pivot of `prefix` is not enough, prefixes get longer, at last all pivots: then every pair meets.
    """
    every = len(points)
    if len(x) and x.shape[1] > 1:
        x = np.repeat(units(x), -(-SAMPLE // len(x)), axis=0)  # few vectors have several partners each
        z = np.random.Generator(np.random.PCG64(seed)).normal(size=x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * units(z)
        while prefix < every:
            n, apart = agreement(*(permutation_prefix(v, mean, points, prefix) for v in (x, y)))
            for shared in range(most, 0, -1):
                found = (n >= shared).mean()
                if found >= recall:
                    ranked = np.sort(np.where(n >= shared, apart, prefix**3))
                    return prefix, shared, int(ranked[int(np.ceil(min(found, (1 + recall) / 2) * len(ranked))) - 1])
            prefix, most = 2 * prefix, 1
    return every, 1, every**3


_POSTED = pa.schema([("lab", pa.string()), ("rep", pa.int64()), ("e1", pa.int64()), ("near", pa.list_(pa.int32()))])


def _describe(mean: np.ndarray, n_pivots: int, prefix: int):
    points = pivots(n_pivots, len(mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x, _ = _matrix(pa.concat_arrays([part["embedding"]]), len(mean))
                ordered = permutation_prefix(x, mean, points, prefix).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * ordered.shape[1]), pa.array(ordered.ravel()))
                yield pa.RecordBatch.from_arrays([part["lab"], part["rep"], part["e1"], lists], schema=_POSTED)

    return run


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _verify(dims: int, n_pivots: int, shared: int, displacement: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "task", 4 << 20):
            t = t.combine_chunks()
            rep, c, own, b1, b2 = (t[k].to_numpy() for k in ("rep", "c", "b", "b1", "b2"))
            prefix = np.asarray(t["near"].combine_chunks().flatten()).reshape(len(rep), -1).astype(np.int64)
            head = np.asarray(t["head"].combine_chunks().flatten()).reshape(len(rep), -1)
            x, size = _matrix(t["embedding"].combine_chunks(), dims)
            x = units(x)
            has = np.zeros((len(rep), n_pivots), dtype=np.float32)
            has[np.arange(len(rep))[:, None], prefix] = 1
            task = t["task"].to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                h = head[lo][head[lo] >= 0]  # the list's pivots: all of a pair's smallest common ones
                count = has[lo:hi] @ has[lo:hi].T
                below = has[lo:hi, : h[-1] + 1] @ has[lo:hi, : h[-1] + 1].T
                i, j = np.nonzero(np.triu((count >= shared) & (below == len(h)), 1))
                if b1[lo] != b2[lo]:
                    other = own[lo + i] != own[lo + j]
                    i, j = i[other], j[other]
                u, v = [], []
                for at in range(0, len(i), 1 << 14):
                    a, b = lo + i[at : at + (1 << 14)], lo + j[at : at + (1 << 14)]
                    ok = (size[a] == size[b]) & (agreement(prefix[a], prefix[b])[1] <= displacement)
                    a, b = a[ok], b[ok]
                    ok = (x[a] * x[b]).sum(axis=1) >= threshold
                    u.append(a[ok])
                    v.append(b[ok])
                u, v = np.concatenate([*u, np.zeros(0, np.int64)]), np.concatenate([*v, np.zeros(0, np.int64)])
                if not len(u):
                    continue
                some, back = np.unique(np.concatenate([u, v]), return_inverse=True)
                a, b = back[: len(u)], back[len(u) :]
                n = np.bincount(a, weights=c[v], minlength=len(some)) + np.bincount(b, weights=c[u], minlength=len(some))
                low = rep[some].copy()
                while True:  # a forest of links, not all of them, is what goes on
                    fresh = low.copy()
                    np.minimum.at(fresh, a, low[b])
                    np.minimum.at(fresh, b, low[a])
                    if (fresh == low).all():
                        break
                    low = fresh
                yield batch_of(_LINKS, u=rep[some], v=low, n=n.astype(np.int64))

    return run


def _lists(described: DataFrame, shared: int, list_rows: int, ws: Workspace) -> DataFrame:
    """lab, rep, near, head (the list's pivots, smallest first), k (members): every vector in every list that it belongs to.

    Lists of up to `list_rows` members are as they are; longer ones go on with one pivot more, if `shared` allows.
    """
    none = F.expr("cast(array() as array<int>)")
    todo = described.select("lab", "rep", "e1", "near", none.alias("head"))
    done = None
    for depth in range(1, shared + 1):
        last = F.coalesce(F.try_element_at("head", F.lit(-1)), F.lit(-1))
        more = todo.withColumn("p", F.explode(F.filter("near", lambda p: p > last))).withColumn("head", F.concat("head", F.array("p"))).drop("p")
        more = ws.save(more, f"posted-{depth}")
        # Written first: a join of two plain shuffles, which AQE splits where a list is hot.
        sizes = ws.save(more.groupBy("lab", "head").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), f"sizes-{depth}")
        more = more.join(sizes, ["lab", "head"])
        short = more if depth == shared else more.where(F.col("k") <= list_rows)
        done = short if done is None else done.unionByName(short)
        todo = more.where(F.col("k") > list_rows).drop("k")
        if depth == shared or sizes.where(F.col("k") > list_rows).isEmpty():
            return done
    return done


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    n_pivots: int = PIVOTS,
    prefix: int = PREFIX,
    shared: int = SHARED,
    list_rows: int = 512,
    recall: float = RECALL,
) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept: one row per input row.

    Rows with equal non-null labels are linked when their cosine is at least `threshold`.  Null,
    empty, zero or not finite vectors, vectors with a null component and null labels link with
    nothing; vectors of different lengths never link.  A null vec_id links with nothing, has a
    null component and is kept.  Rows that share a vec_id count as one node of a component; equal
    vectors of other ids count as links each.  Very long vectors only need memory for 4 MB of them
    and one list at a time.  Ties in a permutation go to the smaller pivot.  An empty table gives
    none.  Extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, "vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    with Workspace(spark, "embeddings") as ws:
        live = F.coalesce(usable, F.lit(False))
        keyed = rows.withColumns({"live": live, "lab": F.col("label").cast("string"), "e1": F.xxhash64("embedding"), "e2": F.xxhash64(F.lit(1), "embedding")})
        # Equal vectors are found by 128 bits of hash; only these keys are kept of each row.
        named = ws.save(keyed.select("vec_id", "live", "lab", "e1", "e2"), "rows")
        classes = keyed.where("live").groupBy("lab", "e1", "e2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("c"), F.first("embedding").alias("embedding"))
        classes = ws.save(classes, "classes")
        dims = classes.agg(F.max(F.size("embedding"))).first()[0] or 1

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(dims), 0
            for batch in batches:
                x, _ = _matrix(pa.concat_arrays([batch["embedding"]]), dims)
                total += units(x).sum(axis=0) if len(x) else 0
                n += len(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(total), pa.array(np.full(dims, n))], names=["i", "s", "n"])

        parts = classes.select("embedding").mapInArrow(sums, "i int, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()  # a row a dimension
        # Drawn towards zero by as much as 64 vectors weigh: a few vectors do not lie all round their mean.
        mean = np.array([r["s"] / (r["n"] + 64) for r in parts]) if parts else np.zeros(dims)
        sample = classes.orderBy(F.xxhash64("rep", F.lit(5)), "rep").limit(SAMPLE).select("embedding").toArrow()
        x, size = _matrix(sample["embedding"].combine_chunks(), dims) if sample.num_rows else (np.zeros((0, dims)), np.zeros(0))
        prefix, shared, displacement = fit_index(x[size == dims], mean, pivots(n_pivots, dims), threshold, prefix, shared, recall)
        described = ws.save(classes.select("lab", "rep", "e1", "embedding").mapInArrow(_describe(mean, n_pivots, prefix), "lab string, rep long, e1 long, near array<int>"), "described")
        met = _lists(described, shared, list_rows, ws)
        met = met.withColumn("g", F.when(F.col("k") <= list_rows, 1).otherwise(F.ceil(F.col("k") / F.lit(max(1, list_rows // 2)))).cast("int")).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
        met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumns({"b1": F.least("b", "o"), "b2": F.greatest("b", "o")})
        pad = F.concat("head", F.array_repeat(F.lit(-1), F.lit(shared) - F.size("head")))
        met = met.select("rep", "e1", "lab", "near", pad.alias("head"), "b", "b1", "b2", F.xxhash64("lab", "head", "b1", "b2").alias("task"))
        # By id, label and key: rows that repeat an id may hold several vectors.
        full = met.join(classes.select("rep", "e1", "lab", "c", "embedding"), ["rep", "e1", "lab"]).drop("e1", "lab")
        full = full.repartition("task").sortWithinPartitions("task", "head")
        links = ws.save(full.mapInArrow(_verify(dims, n_pivots, shared, displacement, threshold), "u long, v long, n long"), "links")
        comp = connected_components(links.select("u", "v"), ws, "components")
        counts = links.groupBy("u").agg(F.sum("n").alias("n"))
        known = classes.join(counts, classes["rep"] == counts["u"], "left").join(comp, classes["rep"] == comp["node"], "left")
        known = ws.save(known.select("lab", "e1", "e2", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n"), F.coalesce("component", "rep").alias("comp")), "known")
        out = named.where("live").join(known, ["lab", "e1", "e2"]).select("vec_id", "n", "comp")
        rest = named.where("not live").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("comp"))
        out = out.unionByName(rest).select("vec_id", F.col("n").alias("n_links"), F.col("comp").alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).checkpoint()


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of `embeddings` (see `near_duplicates` for nulls, ties, repeated rows and empty tables)."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS l FROM e WHERE label IS NOT NULL AND x IS NOT NULL),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
         WHERE a.l > 0 AND b.l > 0 AND list_dot_product(a.x, b.x) / (a.l * b.l) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS v FROM e UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
comp AS (SELECT u, min(v) AS c FROM reach GROUP BY u),
deg AS (SELECT u, count(*) AS k FROM link GROUP BY u)
SELECT e.vec_id, CAST(coalesce(deg.k, 0) AS BIGINT) AS n_links, comp.c AS component_id, e.vec_id = comp.c AS kept
FROM e LEFT JOIN deg ON e.vec_id = deg.u JOIN comp ON e.vec_id = comp.u
"""
