"""Benchmark decontamination over a distributed positional inverted index.

The index holds one row for each training document: the terms of the test vocabulary it has,
in term order, each with its positions (a document-sharded inverted index, as search engines
store it).  Terms that no test item has can never match and are not posted.  A search starts
from the postings of a phrase's rarest term, by corpus frequency; each posting, less the term's
offset, is a candidate start.  The lists of the next rarest terms, adjusted by their offsets,
are intersected with the candidates until all terms of the phrase have agreed.  Proximity
matches come from the same lists: all words of a phrase near an occurrence of its rarest.

A posting says that a document has a word, so words are compared by their keys (bytes, or a
strong digest of long words), not by the hash that finds them.

The test set is taken in blocks of a bounded number of words, so the vocabulary and the phrases
sent to the tasks stay bounded whatever its size; documents are read in whole for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import Columns, Workspace, batch_of, near, pick, row_key, same_row, table

WINDOW, SPAN = 13, 26
#: Words of test items that go out to the tasks at a time: some 50 MB of phrases at most.
BLOCK_WORDS = 400_000


@dataclass
class TestBlock:
    """A bounded block of test items: vocabulary (sorted hashes and their keys), distinct phrases."""

    vocab: np.ndarray
    k1: np.ndarray
    k2: np.ndarray
    items: list[str]
    phrases: np.ndarray  # (n, width) vocabulary indices, -1 beyond the phrase
    size: np.ndarray
    owners: list[np.ndarray]  # items of each phrase


def _test_block(rows: list[tuple[str, str]], window: int) -> TestBlock:
    texts = pa.array([t for _, t in rows], pa.string())
    items = [i for i, _ in rows]
    cut = [(w, w.first) for c in tk.chunks(texts) for _, w in [tk.words(c, "alnum")]]
    join = lambda k: np.concatenate([*(getattr(w, k) for w, _ in cut), np.zeros(0, np.uint64)])
    h, k1, k2 = join("hash"), join("k1"), join("k2")
    vocab, one = np.unique(h, return_index=True)
    if (k1[one][tk.lookup(vocab, h)] != k1).any() or (k2[one][tk.lookup(vocab, h)] != k2).any():
        raise RuntimeError("two words of the test set share a 64-bit hash")
    hashes = [w.hash[at[i] : at[i + 1]] for w, at in cut for i in range(len(at) - 1)]
    seen: dict[bytes, int] = {}
    rows_, owners = [], []
    for k, h in enumerate(hashes):
        ids = tk.lookup(vocab, h).astype(np.int64)
        for s in range(max(len(ids) - window + 1, min(len(ids), 1))):
            p = ids[s : s + window]
            at = seen.setdefault(p.tobytes(), len(rows_))
            if at == len(rows_):
                rows_.append(np.pad(p, (0, window - len(p)), constant_values=-1))
                owners.append([])
            if not owners[at] or owners[at][-1] != k:
                owners[at].append(k)
    phrases = np.array(rows_, dtype=np.int64).reshape(-1, window)
    return TestBlock(vocab, k1[one], k2[one], items, phrases, (phrases >= 0).sum(axis=1), [np.array(o) for o in owners])


def test_blocks(test: DataFrame, window: int, block_words: int) -> Iterator[TestBlock]:
    """The stated test set, a bounded block at a time; null texts have no words, null ids read `null`."""
    rows: list[tuple[str, str]] = []
    n = 0
    for r in pick(test, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        k = len(r.t) // 2 + 1
        if rows and n + k > block_words:
            yield _test_block(rows, window)
            rows, n = [], 0
        rows.append((r.i, r.t))
        n += k
    if rows:
        yield _test_block(rows, window)


_POSTED = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("n_words", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32()))])


def _terms(chunk: tk.Chunk, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and position of each word that the vocabulary has; and the number of words of each document."""
    found, total = [], np.zeros(len(chunk), dtype=np.int64)
    for piece in tk.pieces(chunk, "alnum"):
        _, w = tk.words(piece, "alnum")
        term = tk.lookup(block.vocab, w.hash)
        at = np.flatnonzero(term >= 0)
        at = at[(w.k1[at] == block.k1[term[at]]) & (w.k2[at] == block.k2[term[at]])]
        doc = w.doc[at]
        found.append((doc, term[at], at - w.first[doc] + total[doc]))
        total += np.diff(w.first)
    return *(np.concatenate(x) for x in zip(*found, strict=True)), total


def _post(block: TestBlock):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                doc, term, pos, n_words = _terms(c, block)
                order = np.lexsort((pos, term, doc))
                doc, term, pos = doc[order], term[order], pos[order]
                cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])[: len(doc)])
                lists = np.searchsorted(doc[cut], np.arange(len(c) + 1)).astype(np.int32)
                marks = np.searchsorted(doc, np.arange(len(c) + 1)).astype(np.int32)
                yield batch_of(_POSTED, doc_id=batch["doc_id"].slice(c.lo, len(c)), rk=batch["rk"].slice(c.lo, len(c)), n_words=n_words,
                               terms=pa.ListArray.from_arrays(lists, term[cut].astype(np.int32)), counts=pa.ListArray.from_arrays(lists, np.diff(np.append(cut, len(doc))).astype(np.int32)),
                               positions=pa.ListArray.from_arrays(marks, pos.astype(np.int32)))

    return run


def build_index(docs: DataFrame, block: TestBlock, ws: Workspace, name: str) -> DataFrame:
    """Postings of the block's vocabulary, one stored row for each document."""
    schema = "doc_id long, rk long, n_words long, terms array<int>, counts array<int>, positions array<int>"
    return ws.save(pick(docs, "doc_id", "text").withColumn("rk", row_key("text")).mapInArrow(_post(block), schema), name)


def term_frequencies(index: DataFrame, terms: int) -> np.ndarray:
    """Occurrences of each vocabulary term in all documents; tasks send sums, one row a term."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("n"))
    out = np.zeros(terms, dtype=np.int64)
    for r in pairs.toLocalIterator():
        out[r[0]] = r[1]
    return out


@dataclass
class Postings:
    """Postings of a batch of documents, flattened: (document, term, position) sorted, and by place."""

    docs: int
    doc: np.ndarray
    term: np.ndarray
    pos: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Postings:
        flat = lambda k: batch[k].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = flat("counts")
        lists = np.diff(np.asarray(batch["terms"].offsets))
        doc = np.repeat(np.repeat(np.arange(batch.num_rows), lists), counts)
        return cls(batch.num_rows, doc, np.repeat(flat("terms"), counts), flat("positions"))

    def __post_init__(self) -> None:
        order = np.argsort(self.term, kind="stable")
        self.by_term, self.sorted_terms = order, self.term[order]
        place = self.doc << np.int64(32) | self.pos
        order = np.argsort(place)
        self.places, self.term_at = place[order], self.term[order]

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posting indices of each term of `terms`, with the index into `terms`."""
        lo, hi = np.searchsorted(self.sorted_terms, terms), np.searchsorted(self.sorted_terms, terms, side="right")
        n = hi - lo
        which = np.repeat(np.arange(len(terms)), n)
        return self.by_term[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)], which

    def slices(self, terms: np.ndarray, most: int) -> Iterator[slice]:
        """Stretches of `terms` whose postings together are no more than `most` (a single term's: those of the batch at most)."""
        total = np.cumsum(np.searchsorted(self.sorted_terms, terms, side="right") - np.searchsorted(self.sorted_terms, terms))
        lo = 0
        while lo < len(terms):
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + most, side="right")))
            if total[hi - 1] > before:
                yield slice(lo, hi)
            lo = hi

    def has(self, doc: np.ndarray, pos: np.ndarray, term: np.ndarray) -> np.ndarray:
        at = tk.lookup(self.places, doc << np.int64(32) | pos)
        return (at >= 0) & (pos >= 0) & (self.term_at[at] == term if len(self.term_at) else False)


#: Postings of rarest terms that are held at a time, with their phrases.
CANDIDATES = 1 << 19


def _by_rarity(phrases: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    rarity = np.where(phrases >= 0, frequency[np.maximum(phrases, 0)], np.iinfo(np.int64).max)
    return np.argsort(rarity, axis=1, kind="stable")


def _in_slices(p: Postings, phrases: np.ndarray, size: np.ndarray, frequency: np.ndarray, match) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches of all phrases, from slices of bounded candidates: common terms cost time and not memory."""
    order = _by_rarity(phrases, frequency)
    rarest = phrases[np.arange(len(phrases)), order[:, 0]]
    by_term = np.argsort(rarest, kind="stable")
    found = [(np.zeros(0, np.int64),) * 3]
    for s in p.slices(rarest[by_term], CANDIDATES):
        at = by_term[s]
        doc, pos, which = match(p, phrases[at], size[at], order[at])
        found.append((doc, pos, at[which]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def match_phrases(p: Postings, phrases: np.ndarray, size: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences: (document, start, phrase).  Lists are intersected from the rarest term on."""
    return _in_slices(p, phrases, size, frequency, _match_exact)


def _match_exact(p: Postings, phrases: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hit, which = p.of(phrases[np.arange(len(phrases)), order[:, 0]])
    doc, start = p.doc[hit], p.pos[hit] - order[which, 0]
    keep = start >= 0
    doc, start, which = doc[keep], start[keep], which[keep]
    for k in range(1, phrases.shape[1]):
        offset = order[which, k]
        keep = (k >= size[which]) | p.has(doc, start + offset, phrases[which, offset])
        doc, start, which = doc[keep], start[keep], which[keep]
    return doc, start, which


def match_near(p: Postings, phrases: np.ndarray, size: np.ndarray, frequency: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, phrase) of each occurrence of a phrase's rarest word with all its other words within `span` words of it."""
    docs = max(p.docs, 1)
    code = lambda term, doc, pos: (term * docs + doc << np.int64(32)) + pos
    posted = np.sort(code(p.term, p.doc, p.pos))
    return _in_slices(p, phrases, size, frequency, lambda *of: _match_near(*of, posted, code, span))


def _match_near(p: Postings, phrases: np.ndarray, size: np.ndarray, order: np.ndarray, posted: np.ndarray, code, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hit, which = p.of(phrases[np.arange(len(phrases)), order[:, 0]])
    doc, pos = p.doc[hit], p.pos[hit]
    for k in range(1, phrases.shape[1]):
        if not len(doc):
            break
        term = phrases[which, order[which, k]]
        at = np.searchsorted(posted, code(np.maximum(term, 0), doc, np.maximum(pos - span, 0)))
        there = posted[np.minimum(at, len(posted) - 1)]
        keep = (k >= size[which]) | (at < len(posted)) & (there <= code(term, doc, pos + span)) & (there >= code(term, doc, np.int64(0)))
        doc, pos, which = doc[keep], pos[keep], which[keep]
    return doc, pos, which


_FOUND = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _search(block: TestBlock, frequency: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([batch[k].slice(lo, 2048)]) for k in batch.schema.names], schema=batch.schema)
                doc, start, which = match_phrases(Postings.read(part), block.phrases, block.size, frequency)
                order = np.lexsort((start, doc))
                doc, start, which = doc[order], start[order], which[order]
                end = start + block.size[which]
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                items: list[set] = [set() for _ in range(part.num_rows)]
                for d, s, e, k in zip(doc.tolist(), start.tolist(), end.tolist(), which.tolist(), strict=True):
                    if spans[d] and s <= spans[d][-1]["hi"]:
                        spans[d][-1]["hi"] = max(spans[d][-1]["hi"], e)
                    else:
                        spans[d].append({"lo": s, "hi": e})
                    items[d].update(block.items[i] for i in block.owners[k])
                yield batch_of(_FOUND, doc_id=part["doc_id"], rk=part["rk"], n_words=part["n_words"], spans=spans, items=[sorted(x) for x in items])

    return run


_NEAR = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("item_id", pa.string()), ("at", pa.int32())])


def _search_near(block: TestBlock, frequency: np.ndarray, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([batch[k].slice(lo, 2048)]) for k in batch.schema.names], schema=batch.schema)
                doc, pos, which = match_near(Postings.read(part), block.phrases, block.size, frequency, span)
                owners = [block.owners[k] for k in which]
                n = np.array([len(o) for o in owners], dtype=np.int64)
                items = np.concatenate([*owners, np.zeros(0, np.int64)]).astype(np.int64)
                rows = np.unique(np.stack([np.repeat(doc, n), items, np.repeat(pos, n)], axis=1), axis=0).reshape(-1, 3)
                yield batch_of(_NEAR, doc_id=part["doc_id"].take(pa.array(rows[:, 0])), rk=part["rk"].take(pa.array(rows[:, 0])), item_id=[block.items[i] for i in rows[:, 1]], at=rows[:, 2].astype(np.int32))

    return run


def proximity_matches(docs: DataFrame, test: DataFrame, span: int = SPAN, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, rk, item_id, at: places where all words of a test phrase stand near its rarest one, in any order.

    A phrase is `window` consecutive words of an item (all of a shorter one's); its rarest word is
    that with the fewest occurrences in `docs`, and the others stand within `span` words of `at`
    (0-based word number).  Every exact match is one of these.  Null texts and empty tables give no rows.
    """
    with Workspace(docs.sparkSession, "proximity") as ws:
        out = None
        for k, block in enumerate(test_blocks(test, window, block_words)):
            index = build_index(docs, block, ws, f"index-{k}")
            frequency = term_frequencies(index, len(block.vocab))
            found = ws.save(index.mapInArrow(_search_near(block, frequency, span), "doc_id long, rk long, item_id string, at int"), f"near-{k}")
            out = found if out is None else out.unionByName(found)
            ws.drop(f"index-{k}")
        if out is None:
            return docs.sparkSession.createDataFrame([], "doc_id long, rk long, item_id string, at int")
        return out.distinct().checkpoint()


def find_contamination(docs: DataFrame, test: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Exact phrase matches: one row per document with doc_id, rk, n_words, spans (word positions), items.

    A phrase is `window` consecutive words of an item, or all its words where it has fewer.
    Null and empty texts have no words; very long ones are read in parts and their positions run on.
    Rows that repeat an id or a text each get their row; overlapping matches count once a word.
    An empty test set leaves every document clean, an empty table of documents gives none.  Extra
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    with Workspace(spark, "phrases") as ws:
        parts = []
        for k, block in enumerate(test_blocks(test, window, block_words)):
            index = build_index(docs, block, ws, f"index-{k}")
            frequency = term_frequencies(index, len(block.vocab))
            parts.append(ws.save(index.mapInArrow(_search(block, frequency), _SCHEMA), f"found-{k}"))
            ws.drop(f"index-{k}")
        if not parts:
            parts = [build_index(docs, _test_block([], window), ws, "index").select("doc_id", "rk", "n_words", F.expr("cast(array() as array<struct<lo:int,hi:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))]
        if len(parts) == 1:
            return parts[0].checkpoint()
        hits = [p.where("size(items) > 0").select("doc_id", "rk", "spans", "items") for p in parts]
        more = hits[0]
        for h in hits[1:]:
            more = more.unionByName(h)
        more = more.dropDuplicates().groupBy(F.col("doc_id").alias("id"), "rk").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        all_ = parts[0].select(F.col("doc_id"), F.col("doc_id").alias("id"), "rk", "n_words")
        joined = all_.join(more, same_row(all_, more), "left").select("doc_id", all_["rk"], "n_words", "spans", "items")
        empty = F.expr("cast(array() as array<struct<lo:int,hi:int>>)")
        return joined.select("doc_id", "rk", "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")).checkpoint()


_SCHEMA = "doc_id long, rk long, n_words long, spans array<struct<lo:int,hi:int>>, items array<string>"
#: Words covered by spans in order of `lo`: what each adds beyond the furthest end so far.
_COVERED = """aggregate(array_sort(spans), named_struct('n', 0L, 'to', -1),
 (a, s) -> named_struct('n', a.n + greatest(0, s.hi - greatest(s.lo, a.to)), 'to', greatest(a.to, s.hi)), a -> a.n)"""


def contamination_report(docs: DataFrame, test: DataFrame, **options: int) -> DataFrame:
    """doc_id, rk, n_words, n_hit, n_items, items, contaminated (at least a twentieth of the words are hit).

    Without words nothing is hit and nothing contaminated; see `find_contamination`.
    """
    found = find_contamination(docs, test, **options).withColumn("n_hit", F.expr(_COVERED))
    return found.select("doc_id", "rk", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, test: DataFrame, **options: int) -> DataFrame:
    """The rows of `docs` that are not contaminated, all columns under their names, whatever these are.

    Rows without words stay; of rows that repeat an id each is judged by its own text.
    """
    held = Columns(docs)
    gone = near(contamination_report(docs, test, **options).where("contaminated").select(F.col("doc_id").alias("id"), "rk").distinct())
    rows = held.df.withColumns({"id": F.col(held.at("doc_id")), "rk": row_key(held.at("text"))})
    return held.back(rows.join(gone, same_row(rows, gone), "left_anti"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by `benchmark` (see `find_contamination` for null, empty, long and repeated texts)."""
    report = contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of `documents` and the items of `benchmark` that they have proximity matches of (see `proximity_matches`), with their number."""
    found = proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
        FROM b, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT k FROM win),
gram AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, size, unnest(generate_series(1, len(w) - k + 1)) AS t(i) WHERE len(w) >= k),
hit AS (SELECT doc_id, item_id, i, gram.k FROM gram JOIN win ON gram.k = win.k AND gram.g = win.g),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM hit, unnest(generate_series(i, i + k - 1)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items USING (doc_id)
"""
