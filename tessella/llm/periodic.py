"""Periodic runs of words, by the runs theorem, inside each document.

A run is a maximal stretch of words with smallest period q.  By the runs theorem each run of two
periods or more holds a Lyndon word of length q, for one of the two orders of the alphabet, that
is the longest Lyndon word at its start.  So:

1. Words become numbers, and the suffixes of a batch of documents are sorted by doubling; only
   suffixes that are still tied are sorted again, and suffixes of two documents are never tied.
2. The longest Lyndon word at a place ends at the next smaller value of the inverse suffix array;
   for the opposite order (the end of the text is its largest letter) at the next greater value.
   Both are found by climbing a segment tree for all places at once.
3. A word whose next occurrence one length later does not begin alike cannot be in a run of the
   wanted length.  Documents with words left get LCP arrays of their suffixes and of their
   reversed suffixes, and each word is extended to both sides by range minima: those of a sparse
   table of which one level is held at a time, as the queries of a level are answered together.

Lyndon words are unbordered, so an extension's period is its smallest, and equal (start, length)
are one run.  Everything happens inside the task that reads the text: nothing is shuffled.  A
batch is cut into chunks of a bounded size; a longer document is a chunk of its own and takes
some 200 bytes for each of its words.
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
from .common import Columns, pick, row_key, table

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Text that is sorted at a time.
STEP_BYTES = 1 << 19
_INF = np.iinfo(np.int32).max


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for each query (none empty), by a sparse table built level by level."""
    out = np.empty(len(lo), dtype=values.dtype)
    if not len(lo):
        return out
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    order = np.argsort(level, kind="stable")
    edges = np.searchsorted(level[order], np.arange(level.max() + 2))
    row = values
    for k in range(level.max() + 1):
        if k:
            half = 1 << (k - 1)
            row = np.minimum(row[:-half], row[half:])
        q = order[edges[k] : edges[k + 1]]
        out[q] = np.minimum(row[lo[q]], row[hi[q] - (1 << k)])
    return out


def suffix_order(symbol: np.ndarray, doc: np.ndarray, end: np.ndarray, with_lcp: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Inverse suffix array of documents laid end to end, and the LCP of each suffix with the one before it.

    `symbol` are numbers from 0 on, `doc` the document of each place in rising order, `end` where
    each document ends.  A suffix ends with its document; its end is smaller than any symbol.
    """
    n = len(symbol)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32) if with_lcp else None
    key = doc.astype(np.int64) * (int(symbol.max()) + 1) + symbol
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del key, ordered
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = head
    lcp = np.where(new, 0, _INF).astype(np.int32) if with_lcp else None
    depth = 1
    tied = ~new
    tied[:-1] |= ~new[1:]
    live = np.flatnonzero(tied)
    while len(live):
        at = sa[live]
        later = at + depth
        inside = later < end[doc[at]]
        second = np.where(inside, rank[np.where(inside, later, 0)] + 1, 0)
        order = np.argsort(rank[at] * (n + 1) + second, kind="stable")
        at, second, group = at[order], second[order], rank[at[order]]
        sa[live] = at
        first = np.ones(len(live), dtype=bool)
        first[1:] = group[1:] != group[:-1]
        fresh = ~first
        fresh[1:] &= second[1:] != second[:-1]
        if with_lcp:
            # Suffixes that part in this round share `depth` words, and what their later halves share.
            parted = np.flatnonzero(fresh)
            more = np.zeros(len(parted), dtype=np.int32)
            both = np.flatnonzero(second[parted - 1] > 0)
            left, right = second[parted[both] - 1] - 1, second[parted[both]] - 1
            more[both] = _range_minima(lcp, left + 1, right + 1)
            lcp[live[parted]] = depth + more
        head = np.maximum.accumulate(np.where(first | fresh, live, 0))
        rank[at] = head
        new = first | fresh
        tied = ~new
        tied[:-1] |= ~new[1:]
        live = live[tied]
        depth *= 2
    return rank, lcp


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place with a smaller value, len(values) where there is none, by a segment tree."""
    n = len(values)
    size = 1 << max(n - 1, 0).bit_length()
    levels = [np.concatenate([values, np.full(size - n, np.iinfo(values.dtype).min, values.dtype)])]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).min(axis=1))
    out = np.full(n, n, dtype=np.int64)
    live, node = np.arange(n - 1), np.arange(1, n)
    found_at, found_level = [], []
    for k, row in enumerate(levels):
        if not len(live):
            break
        hit = row[node] < values[live]
        found_at.append((live[hit], node[hit]))
        found_level.append(k)
        live, node = live[~hit], node[~hit]
        # On to the subtree that begins where this one ends; a left child's own right sibling first.
        node = node + 1
        inside = node < len(row)
        live, node = live[inside], node[inside]
        even = (node & 1) == 0
        # An odd node is looked at on its own level: keep it here, climb with the others.
        odd = np.flatnonzero(~even)
        if len(odd):
            hit = row[node[odd]] < values[live[odd]]
            found_at.append((live[odd[hit]], node[odd[hit]]))
            found_level.append(k)
            stay = np.ones(len(live), dtype=bool)
            stay[odd[hit]] = False
            node[odd] += 1
            live, node = live[stay], node[stay]
            inside = node < len(row)
            live, node = live[inside], node[inside]
        node >>= 1
    for (who, node), k in zip(found_at, found_level, strict=True):
        v = values[who]
        for row in levels[k - 1 :: -1] if k else ():
            node = node * 2
            node += row[node] >= v
        out[who] = np.minimum(node, n)
    return out


@dataclass
class Runs:
    """Runs of a batch by document, then start, then period."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray

    def of(self, k: int) -> slice:
        return slice(*np.searchsorted(self.doc, [k, k + 1]))


def find_runs(symbol: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> Runs:
    """All runs of at least `least_periods` (two or more) periods and `least_words` words.

    Document k is symbol[first[k]:first[k+1]]; starts count from a document's first word.
    """
    none = np.zeros(0, dtype=np.int64)
    n = len(symbol)
    if n < least_words:
        return Runs(none, none, none, none)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.asarray(first[1:], dtype=np.int64)
    # Where the next words are not the same, no run of the wanted length has a Lyndon root here.
    alike = min(max(least_words - 1, 1), max(least_periods - 1, 1))

    def roots(values: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nxt = next_smaller(values)
        at = np.flatnonzero(nxt < n)
        to = nxt[at]
        ok = to + alike <= end[doc[at]]
        at, to = at[ok], to[ok]
        for d in range(alike):
            ok = symbol[at + d] == symbol[to + d]
            at, to = at[ok], to[ok]
        return some[at], some[to]

    place = np.arange(n)
    rank, _ = suffix_order(symbol, doc, end)
    pairs = [roots(rank, place), roots(n - 1 - rank, place)]
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if not len(i):
        return Runs(none, none, none, none)

    # Only documents with such places are sorted again, forwards and backwards, with LCP arrays.
    some = np.unique(doc[i])
    count = np.diff(first)[some]
    own = np.concatenate([[0], np.cumsum(count)])
    picked = tk.ranges(np.asarray(first)[some], count)
    where = np.zeros(n, dtype=np.int64)
    where[picked] = np.arange(len(picked))
    i, j = where[i], where[j]
    part, who, stop = symbol[picked], np.repeat(np.arange(len(some)), count), own[1:]
    total = len(part)

    def shared(seq: np.ndarray, owner: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r, lcp = suffix_order(seq, owner, ends, with_lcp=True)
        lo, hi = np.minimum(r[a], r[b]), np.maximum(r[a], r[b])
        return _range_minima(lcp, lo + 1, hi + 1).astype(np.int64)

    ahead = shared(part, who, stop, i, j)
    behind = np.zeros(len(i), dtype=np.int64)
    left = np.flatnonzero(i > own[who[i]])
    if len(left):
        # The reversed documents, in reversed order: place x is total - 1 - x.
        behind[left] = shared(part[::-1], len(some) - 1 - who[::-1], total - own[:-1][::-1], total - i[left], total - j[left])
    start, length, period = i - behind, j - i + ahead + behind, j - i
    ok = (length >= least_words) & (length >= least_periods * period)
    d, start, length, period = who[i][ok], start[ok], length[ok], period[ok]
    start -= own[d]
    order = np.lexsort((period, start, d))
    d, start, length, period = d[order], start[order], length[order], period[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (start[1:] != start[:-1]) | (period[1:] != period[:-1])
    return Runs(some[d[new]], start[new], length[new], period[new])


def strongest(runs: Runs, at: slice) -> int:
    """Index of the run of the greatest exact length/period; ties: the smallest start, then the smallest period."""
    best = at.start
    for k in range(at.start + 1, at.stop):
        if int(runs.length[k]) * int(runs.period[best]) > int(runs.length[best]) * int(runs.period[k]):
            best = k
    return best


def dropped_words(runs: Runs, first: np.ndarray) -> np.ndarray:
    """Marks of the words (of all documents) that a run contains after its first period."""
    edge = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    base = np.asarray(first)[runs.doc] + runs.start
    np.add.at(edge, base + runs.period, 1)
    np.add.at(edge, base + runs.length, -1)
    return np.cumsum(edge)[:-1] > 0


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words joined by one space."""
    if not len(start):
        return b""
    size = end - start + 1
    out = np.full(int(size.sum()), 0x20, dtype=np.uint8)
    to = np.cumsum(size) - size
    out[tk.ranges(to, size - 1)] = data[tk.ranges(start, size - 1)]
    return out[:-1].tobytes()


_OUT = pa.schema(
    [("id", pa.int64()), ("rk", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64())]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.list_(pa.int64()))), ("collapsed", pa.string())]
)
OUT = "id long, rk long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<array<long>>, collapsed string"


def planted_order(n: int, h: int) -> np.ndarray:
    """The contract's rewriting of a text of n words under the checksum h: which original word stands at each place."""
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _collapse(with_texts: bool, planted: bool, least_words: int, least_periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"], STEP_BYTES, rows=2048):
                yield _chunk(c, batch)

    def _chunk(c: tk.Chunk, batch: pa.RecordBatch) -> pa.RecordBatch:
        _, w = tk.words(c, "nonspace", lower=False)
        symbol, _ = tk.numbers(w.k1, w.k2)
        first, start, end = w.first, w.start, w.end
        ids, rks = batch["id"].slice(c.lo, len(c)), batch["rk"].slice(c.lo, len(c))
        if planted:
            order = np.arange(len(symbol))
            for k, h in enumerate(batch["crc"].slice(c.lo, len(c)).to_pylist()):
                n = int(first[k + 1] - first[k])
                if h is not None and h % 10 == 0 and n:
                    order[first[k] : first[k + 1]] = first[k] + planted_order(n, h)
            symbol, start, end = symbol[order], start[order], end[order]
        runs = find_runs(symbol, first, least_words, least_periods)
        keep = ~dropped_words(runs, first)
        rows = []
        for k in range(len(c)):
            at = runs.of(k)
            of = slice(int(first[k]), int(first[k + 1]))
            some = keep[of]
            text = _joined(c.data, start[of][some], end[of][some])
            listed = [[int(x) for x in r] for r in zip(runs.start[at], runs.length[at], runs.period[at], strict=True)]
            told = "".join(f"{s},{n},{p}\n" for s, n, p in listed)
            top = (None,) * 4
            if listed:
                s, n, p = listed[strongest(runs, at) - at.start]
                top = (s, n, p, 1000 * n // p)
            rows.append((of.stop - of.start, len(listed), *top, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), listed if with_texts else None, text.decode() if with_texts else None))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([ids, rks, *(pa.array(list(x), f.type) for x, f in zip(cols, list(_OUT)[2:], strict=True))], schema=_OUT)

    return run


def periodic_runs(docs: DataFrame, with_texts: bool = True, planted: bool = False, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(doc_id, text) -> id, rk, n_words, n_runs, the strongest run, digests; with texts also `runs` and `collapsed`.

    One row for each row of `docs`, in any order; repeated rows give repeated rows, and rows that
    share an id are judged apart.  A null, empty or blank text has no words and no runs: nulls for
    the run, digests of nothing.  An empty table gives none.  Long texts are sorted whole.  Ties
    of the strongest run go to the smallest start, then period.  Extra columns, whatever their
    names, are ignored.  `planted` rewrites texts as the query's contract says; a null id is never rewritten.
    """
    if least_periods < 2:
        raise ValueError("the runs theorem is about runs of two periods or more")
    slim = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), row_key("text").alias("rk"), "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("crc"))
    return slim.mapInArrow(tk.releasing(_collapse(with_texts, planted, least_words, least_periods)), OUT)


def collapse_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """`docs` with each run cut to its first period; texts without a run stay as they are, byte for byte.

    Words of a changed text are joined by one space.  Rows, other columns and their names stay.
    """
    held = Columns(docs)
    text, names = held.at("text"), held.df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch[text].to_pylist()
            for c in tk.chunks(batch[text], STEP_BYTES, rows=2048):
                _, w = tk.words(c, "nonspace", lower=False)
                runs = find_runs(tk.numbers(w.k1, w.k2)[0], w.first, least_words, least_periods)
                keep = ~dropped_words(runs, w.first)
                for k in np.unique(runs.doc).tolist():
                    of = slice(int(w.first[k]), int(w.first[k + 1]))
                    out[c.lo + k] = _joined(c.data, w.start[of][keep[of]], w.end[of][keep[of]]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == text else batch[k] for k in names], names=names)

    return held.back(held.df.mapInArrow(tk.releasing(run), held.df.schema))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every text of `documents`, a tenth of which is first rewritten as the contract says.

    See `periodic_runs` for nulls, empty texts, ties, repeated rows and empty tables.
    """
    found = periodic_runs(table(spark, sf_dir, "documents"), with_texts=False, planted=True)
    return found.select(F.col("id").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
