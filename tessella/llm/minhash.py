"""MinHash near-duplicates: universal hash minima, banding, signature and exact verification, star components.

Plan
1. One Arrow pass over the texts: distinct 5-word shingles (64-bit hashes), their number, a
   128-bit digest of the set (sums of two independent hashes of each shingle) and one bucket hash
   for each band of minima.
2. Documents with equal sets form a class; only one row a class goes on, so a third of all rows
   being copies of one text costs one row.
3. Centres first: in each bucket with two or more classes, every class is compared with the
   smallest one, by signature (five standard deviations below the threshold still pass) and then
   by the full sets.  A centre with many members is dealt over tasks with its text.
   Large-star/small-star joins what was linked.
4. Buckets that still hold several components do the same with their largest class, once.
5. What is open after that, buckets with several components, is compared in full: every pair of
   different components of a family, by blocks of `block_rows` classes, every pair of blocks its
   own task, so no task holds an unbounded group and no pair is skipped.  Links between members
   of one component change nothing and are not looked for.
6. All links (a forest, not all pairs) go through large-star/small-star again.

Sets are compared by words themselves, numbered within a task, not by hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import Columns, Workspace, batch_of, near, pick, row_key, same_row, table
from .components import connected_components

BANDS, ROWS, SHINGLE, THRESHOLD = 45, 5, 5, 0.75
_RNG = np.random.Generator(np.random.PCG64(20240607))
_A = (_RNG.integers(0, 1 << 31, 1024, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, 1024, dtype=np.uint32)
_C = tk.mix(np.arange(1, 65, dtype=np.uint64))


def _hashes(w: tk.Words) -> list[np.ndarray]:
    return [w.hash, tk.key_hash(w.k1, w.k2, 1)]


def _shingled(hashes: list[np.ndarray], n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every shingle of texts of n words each, and its text, distinct and sorted by text."""
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    doc, pos = np.repeat(np.arange(len(n)), count), tk.ranges(np.cumsum(n) - n, count)
    whole = n[doc] >= size
    out = []
    for h in hashes:
        padded = np.concatenate([h, np.zeros(size, np.uint64)])
        sums = np.zeros(len(doc), dtype=np.uint64)
        for j in range(size):
            sums += np.where(whole | (j < n[doc]), padded[pos + j] * (_C[j] | np.uint64(1)), np.uint64(0))
        out.append(tk.mix(sums + np.where(whole, size, n[doc]).astype(np.uint64) * _C[-1]))
    return _distinct(*out, doc)


def _distinct(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    h, g, doc = h[order], g[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    return h[keep], g[keep], doc[keep]


def shingle_sets(chunk: tk.Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk (two hashes each) sorted by document, and where each document's begin."""
    if len(chunk) > 1 or len(chunk.data) <= tk.PIECE_BYTES:
        _, w = tk.words(chunk, "nonspace")
        h, g, doc = _shingled(_hashes(w), np.diff(w.first), size)
        return h, g, np.searchsorted(doc, np.arange(len(chunk) + 1))
    held, parts = [np.zeros(0, np.uint64)] * 2, []
    for piece in tk.pieces(chunk, "nonspace"):
        _, w = tk.words(piece, "nonspace")
        held = [np.concatenate(x) for x in zip(held, _hashes(w), strict=True)]
        if len(held[0]) >= size:  # the last words of a part go on into the next
            parts.append(_shingled(held, np.array([len(held[0])]), size))
            held = [x[1 - size :] if size > 1 else x[:0] for x in held]
    if not parts:
        parts.append(_shingled(held, np.array([len(held[0])]), size))
    h, g, doc = _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return h, g, np.array([0, len(doc)])


def exact_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, numbered by their words, sorted by text; and where each text's begin."""
    none = np.zeros(0, np.uint64)
    k1, k2, n = [none], [none], [np.zeros(0, np.int64)]
    for c in tk.chunks(texts):
        cut = [tk.words(piece, "nonspace")[1] for piece in tk.pieces(c, "nonspace")]
        k1 += [w.k1 for w in cut]
        k2 += [w.k2 for w in cut]
        n.append(np.diff(cut[0].first) if len(cut) == 1 else np.array([sum(len(w) for w in cut)]))
    n = np.concatenate(n)
    ids, kinds = tk.numbers(np.concatenate(k1), np.concatenate(k2))
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    doc, pos = np.repeat(np.arange(len(n)), count), tk.ranges(np.cumsum(n) - n, count)
    padded = np.concatenate([ids, np.full(size, kinds)])
    code = padded[pos]
    for j in range(1, size):
        there = np.where(j < n[doc], padded[pos + j], kinds)  # short texts are padded by a word that none has
        _, code = np.unique(code * np.int64(kinds + 1) + there, return_inverse=True)
    many = max(len(code), 1)
    doc, code = np.divmod(np.unique(doc * np.int64(many) + code), many)
    return code, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """(documents, k) minima of k universal hashes a*x+b mod 2^32; rows of empty sets are the maximum."""
    docs = len(first) - 1
    out = np.full((docs, k), 0xFFFFFFFF, dtype=np.uint32)
    some = np.flatnonzero(np.diff(first))
    x = (h >> np.uint64(32)).astype(np.uint32)
    step = 1 << 15
    lo = 0
    while lo < len(some):  # blocks that stay in cache; a longer set is a block of its own
        hi = max(lo + 1, int(np.searchsorted(first[some], first[some[lo]] + step)))
        a, b = first[some[lo]], first[some[hi - 1] + 1]
        part, cut = x[a:b], first[some[lo:hi]] - a
        v = np.empty_like(part)
        for j in range(k):
            np.multiply(part, _A[j], out=v)
            np.add(v, _B[j], out=v)
            out[some[lo:hi], j] = np.minimum.reduceat(v, cut)
        lo = hi
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        acc = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(rows):
            acc = tk.mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r].astype(np.uint64))
        out[:, b] = acc
    return out


_SIGNED = pa.schema([("id", pa.int64()), ("rk", pa.int64()), ("n_shingles", pa.int64()), ("set_lo", pa.int64()), ("set_hi", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                h, g, first = shingle_sets(c, size)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(tk.mix(x), dtype=np.uint64)]) for x in (h, g)]
                lo, hi = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                b = band_hashes(signatures(h, first, bands * rows), bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * bands), pa.array(b.ravel()))
                yield batch_of(_SIGNED, id=batch["id"].slice(c.lo, len(c)), rk=batch["rk"].slice(c.lo, len(c)), n_shingles=np.diff(first), set_lo=lo, set_hi=hi, bands=lists)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, max_bytes: int = 8 << 20) -> Iterator[pa.Table]:
    """Batches sorted by `key` -> tables that never cut a group; several small groups share a table."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch[key].to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1][key][-1].as_py() != k[0]:
            cut = np.concatenate([[0], cut])
        at = 0
        step = max(1, batch.nbytes // batch.num_rows)
        for c in cut:
            if size + (c - at) * step >= max_bytes:
                held.append(batch.slice(at, c - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, int(c)
        held.append(batch.slice(at))
        size += (batch.num_rows - at) * step
    if held:
        table_ = pa.Table.from_batches(held)
        if table_.num_rows:
            yield table_


class Compared:
    """Sets of one task: which of some of them are as near to one as the threshold asks."""

    def __init__(self, texts: pa.Array, size: int, threshold: float, k: int):
        h, first = [], [np.zeros(1, np.int64)]
        for c in tk.chunks(texts):
            x, _, at = shingle_sets(c, size)
            h.append(x)
            first.append(at[1:] + first[-1][-1])
        self.sig = signatures(np.concatenate([*h, np.zeros(0, np.uint64)]), np.concatenate(first), k)
        self.code, self.first = exact_sets(texts, size)
        self.n = np.diff(self.first)
        self.mark = np.zeros(int(self.code.max()) + 1 if len(self.code) else 0, dtype=bool)
        self.pct, self.least = round(threshold * 100), k * threshold - 5 * np.sqrt(k * threshold * (1 - threshold))

    def near(self, s: int, others: np.ndarray) -> np.ndarray:
        n, mine = self.n, self.code[self.first[s] : self.first[s + 1]]
        others = others[(n[others] > 0) & (n[others] * 100 >= self.pct * n[s]) & (n[others] * self.pct <= 100 * n[s])]
        others = others[(self.sig[others] == self.sig[s]).sum(axis=1) >= self.least]
        if not len(others):
            return others
        self.mark[mine] = True
        sizes = n[others]
        inter = np.add.reduceat(self.mark[self.code[tk.ranges(self.first[others], sizes)]].astype(np.int64), np.cumsum(sizes) - sizes)
        self.mark[mine] = False
        return others[100 * inter >= self.pct * (sizes + n[s] - inter)]


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _groups(key: np.ndarray) -> list[tuple[int, int]]:
    edge = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    return list(zip(edge[:-1], edge[1:], strict=True))


def _with_centre(size: int, threshold: float, k: int):
    """Rows (task, rep, centre, text) sorted by task: links between each rep and its task's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "task", 4 << 20):
            task, rep, centre = (t[c].to_numpy() for c in ("task", "rep", "centre"))
            sets = Compared(t["text"].combine_chunks(), size, threshold, k)
            u, v = [], []
            for a, b in _groups(task):
                own = np.flatnonzero(rep[a:b] == centre[a:b]) + a
                rows = np.arange(a, b)
                for o in own:  # several where rows of one id hold several texts
                    hit = sets.near(int(o), rows[rep[rows] != centre[rows]])
                    u.append(rep[hit])
                    v.append(centre[hit])
            yield batch_of(_EDGES, u=np.concatenate([*u, np.zeros(0, np.int64)]), v=np.concatenate([*v, np.zeros(0, np.int64)]))

    return run


def _all_in(size: int, threshold: float, k: int):
    """Rows (task, rep, comp, text) sorted by task: links that join different components of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "task", 4 << 20):
            task, rep, comp = (t[c].to_numpy().copy() for c in ("task", "rep", "comp"))
            sets = Compared(t["text"].combine_chunks(), size, threshold, k)
            u, v = [], []
            for a, b in _groups(task):
                for s in range(a, b):
                    rest = np.arange(s + 1, b)
                    for hit in sets.near(s, rest[comp[rest] != comp[s]]):
                        if comp[hit] != comp[s]:
                            u.append(rep[s])
                            v.append(rep[hit])
                            mine = comp[a:b]
                            mine[mine == comp[hit]] = comp[s]
            yield batch_of(_EDGES, u=u, v=v)

    return run


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    block_rows: int = 400,
) -> DataFrame:
    """(doc_id, text) -> doc_id, rk, n_shingles, component_id, kept: one row per input row.

    Two documents are linked when 100*|A∩B| >= 75*|A∪B| on their sets of distinct 5-word
    shingles (fewer words: the whole sequence is one shingle).  A pair at the threshold misses
    all 45 bands of 5 minima with probability 5e-6.

    Null or empty texts have no shingles and link with nothing; a null doc_id links with nothing
    and has a null component, kept.  Very long texts are cut into words in parts; what is held of
    one is 16 bytes for each distinct shingle.  Rows that share a doc_id are one document.  Ties
    take the smallest id.  Repeated rows each get their row.  An empty table gives an empty
    table.  Extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    with Workspace(spark, "minhash") as ws:
        slim = pick(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), "text", row_key("text").alias("rk"))
        schema = "id long, rk long, n_shingles long, set_lo long, set_hi long, bands array<long>"
        signed = ws.save(slim.mapInArrow(tk.releasing(_sign(bands, rows, shingle)), schema), "signed")
        live = signed.where("n_shingles > 0 and id is not null")
        # The text of a class is that of a row (id, rk): rows that repeat an id may hold several texts.
        classes = live.groupBy("n_shingles", "set_lo", "set_hi").agg(F.min(F.struct("id", "rk")).alias("at"), F.first("bands").alias("bands"))
        classes = ws.save(classes.select("n_shingles", "set_lo", "set_hi", F.col("at.id").alias("rep"), F.col("at.rk").alias("rk"), "bands"), "classes")
        # A class is named by its smallest id; classes that share one (rows that repeat an id) are one node.
        posted = classes.select("rep", F.explode("bands").alias("bucket")).distinct()
        # Written first: a join of two plain shuffles, which AQE splits where a bucket is hot.
        heads = ws.save(posted.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high"), "heads")
        met = ws.save(posted.join(heads.select("bucket"), "bucket"), "met")
        texts = classes.select("rep", "rk").join(slim, (classes["rep"] == slim["id"]) & (classes["rk"] == slim["rk"])).select("rep", "text").dropDuplicates(["rep", "text"])
        texts = ws.save(_only(texts, met.select("rep").distinct()), "texts")
        links = _star(met.join(heads, "bucket").select("rep", F.col("low").alias("centre")), texts, ws, "low", shingle, threshold, bands * rows)
        comp = ws.save(connected_components(links, ws, "comp-low"), "stars-low")
        for step in ("high", "rest"):
            placed = met.join(comp, met["rep"] == comp["node"], "left").select("bucket", "rep", F.coalesce("component", "rep").alias("comp"))
            placed = ws.save(placed, f"placed-{step}")
            open_ = placed.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.max(F.struct("rep", "comp")).alias("top")).where("a <> b")
            open_ = ws.save(open_.select("bucket", "top"), f"open-{step}")
            if open_.isEmpty():
                break
            left = placed.join(near(open_), "bucket")
            if step == "high":
                more = _star(left.where("comp <> top.comp").select("rep", F.col("top.rep").alias("centre")), texts, ws, step, shingle, threshold, bands * rows)
            else:
                more = _families(left.select("bucket", "rep", "comp"), texts, ws, block_rows, shingle, threshold, bands * rows)
            links = links.unionByName(more)
            comp = ws.save(connected_components(links, ws, f"comp-{step}"), f"stars-{step}")
        named = signed.select("id", "rk", "n_shingles", "set_lo", "set_hi")
        reps = classes.select("n_shingles", "set_lo", "set_hi", "rep")
        out = named.join(reps, ["n_shingles", "set_lo", "set_hi"], "left").join(comp, F.col("rep") == F.col("node"), "left")
        found = ws.save(out.select("id", "rk", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component")), "found")
        # Rows that share an id are one document: it lies where the smallest component of its rows is.
        split = found.groupBy("id").agg(F.min("component").alias("a"), F.max("component").alias("b"))
        split = split.where("a <> b")
        if split.isEmpty():
            out = found
        else:
            joined = connected_components(found.where("id is not null").select(F.col("id").alias("u"), F.col("component").alias("v")), ws, "ids")
            joined = ws.save(joined.select("node", F.col("component").alias("to")), "joined")
            out = found.join(joined, F.col("component") == F.col("node"), "left").select("id", "rk", "n_shingles", F.coalesce("to", "component").alias("component"))
        out = out.select(F.col("id").alias("doc_id"), "rk", "n_shingles", F.col("component").alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).checkpoint()


def _only(texts: DataFrame, reps: DataFrame) -> DataFrame:
    return texts.join(near(reps), "rep", "left_semi")


def _star(pairs: DataFrame, texts: DataFrame, ws: Workspace, name: str, size: int, threshold: float, k: int, most: int = 200) -> DataFrame:
    """(rep, centre) -> links of those that are near; about `most` reps a task, each task with its centre's text."""
    pairs = ws.save(pairs.where("rep <> centre").distinct(), f"pairs-{name}")
    share = ws.save(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("g")), f"centres-{name}")
    part = F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")
    members = pairs.join(share, "centre").select("rep", "centre", part.alias("part"))
    centres = share.select(F.col("centre").alias("rep"), "centre", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("part"))
    placed = ws.save(members.unionByName(centres).withColumn("task", F.xxhash64("centre", "part")), f"tasks-{name}")
    rows = texts.join(near(placed), "rep").select("task", "rep", "centre", "text").repartition("task").sortWithinPartitions("task", "centre")
    return ws.save(rows.mapInArrow(tk.releasing(_with_centre(size, threshold, k)), "u long, v long"), f"links-{name}")


def _families(placed: DataFrame, texts: DataFrame, ws: Workspace, block_rows: int, size: int, threshold: float, k: int) -> DataFrame:
    """(bucket, rep, comp) of open buckets -> links between components, all pairs of a family compared by blocks."""
    nodes = placed.select("rep", "comp").distinct()
    first = placed.groupBy("bucket").agg(F.min("comp").alias("first"))
    family = connected_components(placed.join(first, "bucket").select(F.col("comp").alias("u"), F.col("first").alias("v")), ws, "families")
    nodes = ws.save(nodes.join(family.withColumnRenamed("component", "family"), nodes["comp"] == F.col("node")).select("rep", "comp", "family"), "family")
    sizes = ws.save(nodes.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("g")), "sizes")
    b = F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")
    tasks = (
        nodes.join(sizes, "family").withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("rep", "comp", F.xxhash64("family", F.least("b", "o"), F.greatest("b", "o")).alias("task"))
    )
    tasks = ws.save(tasks, "blocks")
    rows = texts.join(near(tasks), "rep").select("task", "rep", "comp", "text").repartition("task").sortWithinPartitions("task", "rep")
    return ws.save(rows.mapInArrow(tk.releasing(_all_in(size, threshold, k)), "u long, v long"), "links-rest")


def deduplicate(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of `docs` that `near_duplicates` keeps, all columns under their names, whatever these are.

    Nulls, empty and long texts, ties and repeated rows as there: a row without words or id stays.
    """
    held = Columns(docs)
    found = near_duplicates(docs, **options)  # type: ignore[arg-type]
    gone = near(found.where(~F.col("kept")).select(F.col("doc_id").alias("id"), "rk").distinct())
    rows = held.df.withColumns({"id": F.col(held.at("doc_id")), "rk": row_key(held.at("text"))})
    return held.back(rows.join(gone, same_row(rows, gone), "left_anti"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of `documents` (see `near_duplicates` for null, empty, long and repeated texts)."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")

OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM pair JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
comp AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.c AS component_id, d.doc_id = comp.c AS kept
FROM d JOIN comp ON d.doc_id = comp.u LEFT JOIN n ON d.doc_id = n.doc_id
"""
