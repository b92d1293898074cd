"""Language-model scoring with Brown class-based bigrams.

P(w | previous) = P(class(w) | class(previous)) * P(w | class(w)), both smoothed by half a count.

Exchange clustering moves words between classes while the class-bigram likelihood grows.  It
begins on the driver with bounded units: the commonest words, and the others by the last three
bytes.  From then on words move alone, each by its own contexts in all training texts: first the
words of the head, in `passes` rounds over the texts, then in a last round every training word,
however rare.  Within a round all words move at once, against the classes of the round before; a
round whose likelihood is lower than the last one's is taken back, the last one too.  Only words that training
lacks have no contexts and take the class of their last three bytes.

Passes over the texts, each over all documents of its kind:
1. counts of every training token (one shuffle of partial sums; the table grows with the corpus);
2. unit bigrams of all training tokens (bounded: units squared), clustered on the driver;
3. rounds of exchange: classes before and after each word (sparse; the head, then the vocabulary);
4. bigrams of the final classes of all training tokens;
5. scoring of all documents.  Counts and classes of the `head_words` commonest words (of equally
   common ones those of the smallest hashes) are sent to the tasks; the other words of a
   document are joined with the word table by hash.  No word is dropped: rare and unseen words
   are scored by their exact counts.

A word is known by a 64-bit hash of its bytes, or of a strong digest of its bytes where it is long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import Workspace, batch_of, fold, near, pick, table
from .minhash import whole_groups

HEAD_WORDS, WORD_UNITS, SUFFIX_UNITS, CLASSES, ROUNDS, PASSES = 1 << 18, 1000, 512, 64, 6, 2
HALF = 0.5


def suffix_units(data: np.ndarray, w: tk.Words, of: np.ndarray) -> np.ndarray:
    """Unit of the words at the places `of` by their last three bytes (fewer for shorter words)."""
    start, end = w.start[of], w.end[of]
    h = np.zeros(len(of), dtype=np.uint64)
    for j in range(3):
        at = end - 1 - j
        h |= np.where(at >= start, data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) << np.uint64(16 * j)
    return (tk.mix(h) % np.uint64(SUFFIX_UNITS)).astype(np.int64)


_COUNTS = pa.schema([("h", pa.int64()), ("c", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hs, ns = [], []
        for c in tk.chunks(batch["text"]):
            for part in tk.pieces(c, "nonspace"):
                h, n = np.unique(tk.words(part, "nonspace")[1].hash, return_counts=True)
                hs.append(h)
                ns.append(n)
        if hs:
            h, back = np.unique(np.concatenate(hs), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate(ns)).astype(np.int64) if len(h) else np.zeros(0, np.int64)
            yield batch_of(_COUNTS, h=h.view(np.int64), c=n)


@dataclass
class Units:
    """Unit 0 is the end of a text, then the word units (sorted hashes), then the suffix units."""

    words: np.ndarray

    @property
    def n(self) -> int:
        return 1 + len(self.words) + SUFFIX_UNITS

    @cached_property
    def places(self) -> tk.Places:
        return tk.Places(self.words)

    def of(self, data: np.ndarray, w: tk.Words) -> np.ndarray:
        unit = self.places.of(w.hash) + 1
        other = np.flatnonzero(unit == 0)
        unit[other] = suffix_units(data, w, other) + 1 + len(self.words)
        return unit

    def stream(self, data: np.ndarray, w: tk.Words, docs: int) -> np.ndarray:
        """Units of the words of all documents, an end before the first and after each."""
        return np.concatenate([[0], np.insert(self.of(data, w), w.first[1 : docs + 1], 0)])


_BIGRAMS = pa.schema([("u", pa.int32()), ("to", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])


def _sparse(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = np.flatnonzero(total.any(axis=1))
    at = [np.flatnonzero(total[u]) for u in rows]
    yield batch_of(_BIGRAMS, u=rows.astype(np.int32), to=[a.astype(np.int32) for a in at], n=[total[u, a].astype(np.int64) for u, a in zip(rows, at, strict=True)])


def _bigrams(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cells, size = np.zeros(units.n * units.n, dtype=np.int64), [], 0
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                data, w = tk.words(c, "nonspace")
                s = units.stream(data, w, len(c))
                cells.append(s[:-1] * units.n + s[1:])
                size += len(s)
                if size >= CTX_TOKENS:
                    total += np.bincount(np.concatenate(cells), minlength=len(total))
                    cells, size = [], 0
        if cells:
            total += np.bincount(np.concatenate(cells), minlength=len(total))
        yield from _sparse(total.reshape(units.n, units.n))

    return run


def _add_rows(n: int):
    """Rows sorted by unit -> one row for each, summed as they are read: one unit's sums are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, total = -1, np.zeros(n, dtype=np.int64)
        for batch in batches:
            for u, to, k in zip(batch["u"].to_pylist(), batch["to"], batch["n"], strict=True):
                if u != unit:
                    if unit >= 0:
                        yield _unit_row(unit, total)
                    unit, total[:] = u, 0
                total[np.asarray(to.values)] += np.asarray(k.values)
        if unit >= 0:
            yield _unit_row(unit, total)

    return run


def _unit_row(unit: int, total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return batch_of(_BIGRAMS, u=[unit], to=[at.astype(np.int32)], n=[total[at]])


def exchange_clustering(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit; unit 0 keeps class 0 to itself.  Units start dealt round by frequency.

    Each step takes one unit out and puts it where the class-bigram log-likelihood
    (sum f(n(c,d)) - sum f(n(c,.)) - sum f(n(.,c)), f(x) = x ln x) is largest; ties keep the
    lower class.  Ends when a round moves nothing.
    """
    units = len(pairs)
    pairs = pairs.astype(np.float64)
    size = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-size[1:], kind="stable") + 1
    label = np.zeros(units, dtype=np.int64)
    label[order] = np.arange(units - 1) % classes + 1
    k = classes + 1
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    member = np.zeros((units, k))
    member[np.arange(units), label] = 1
    right, left = pairs @ member, pairs.T @ member  # counts of each unit with each class
    grid = member.T @ right
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not size[u]:
                continue
            a, s = label[u], pairs[u, u]
            r, l = right[u].copy(), left[u].copy()
            r[a] -= s
            l[a] -= s
            grid[a] -= r
            grid[:, a] -= l
            grid[a, a] -= s
            fg = f(grid)
            row, col = grid.sum(axis=1), grid.sum(axis=0)
            gain = (f(grid + r) - fg).sum(axis=1) + (f(grid.T + l) - fg.T).sum(axis=1)
            d = np.diagonal(grid)
            gain += f(d + r + l + s) - f(d + r) - f(d + l) + f(d)
            gain -= f(row + r.sum() + s) - f(row) + f(col + l.sum() + s) - f(col)
            gain[0] = -np.inf
            b = a if gain.max() <= gain[a] + 1e-9 else int(gain.argmax())
            grid[b] += r
            grid[:, b] += l
            grid[b, b] += s
            if b != a:
                moved += 1
                label[u] = b
                right[:, a] -= pairs[:, u]
                right[:, b] += pairs[:, u]
                left[:, a] -= pairs[u]
                left[:, b] += pairs[u]
        if not moved:
            break
    return label


#: Rows of one word (a row for each million tokens that hold it) that a task takes; more are summed in shares first.
WORD_ROWS = 256
_CONTEXTS = pa.schema([("h", pa.int64()), ("own", pa.int32()), ("ctx", pa.list_(pa.int64()))])
_WORDS = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("cls", pa.int32())])
CTX_BITS, CTX_TOKENS, CTX_ENTRIES = 40, 1 << 20, 1 << 12
#: Cells of the head's words that a task holds, and words of a batch of rows.
CTX_CELLS, CTX_ROWS = 6 << 20, 1 << 15


def _contexts(held: Broadcast, head: Broadcast, every: bool):
    """Contexts of words: its class, and how often which class follows (0..), precedes (k..), or the word follows itself (2k).

    Of the words whose hashes are in `head`, or of `every` word.  Words of the head are summed over
    the task, a million tokens at a time; the others come out once for each million.  A row without
    a word has the class bigrams of the task.
    """

    def cells(k: int, parts: list) -> tuple[np.ndarray, np.ndarray]:
        """Distinct cells word * (2k + 1) + code, sorted, and how often each."""
        ids, _, after, before = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids = ids * (2 * k + 1)
        return np.unique(np.concatenate([ids + after, (ids + before)[before >= 0]]), return_counts=True)

    def rows(k: int, h: np.ndarray, cls: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        word, code = np.divmod(key, 2 * k + 1)
        first = np.append(np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])[: len(word)]), len(word))
        value = code << CTX_BITS | n
        for lo in range(0, len(first) - 1, CTX_ROWS):
            at = first[lo : lo + CTX_ROWS + 1]
            some = word[at[:-1]]
            ctx = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(value[at[0] : at[-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(cls[some]), ctx], schema=_CONTEXTS)

    def merged(sums: list) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*sums, strict=True))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        return key[cut], np.add.reduceat(n, cut) if len(cut) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, h_head = held.value, head.value
        k = m.k
        places = m.places if np.array_equal(h_head, m.head) else tk.Places(h_head)
        common, rare, sums, own = [], [], [], np.zeros(len(h_head), dtype=np.int32)
        grid = np.zeros(k * k, dtype=np.int64)

        def size(parts: list) -> int:
            return sum(len(p[0]) for p in parts)

        def others() -> Iterator[pa.RecordBatch]:
            h, ids = np.unique(np.concatenate([p[0] for p in rare]), return_inverse=True)
            cls = np.zeros(len(h), dtype=np.int32)
            cls[ids] = np.concatenate([p[1] for p in rare])
            first = np.cumsum([0, *(len(p[0]) for p in rare)])
            yield from rows(k, h, cls, *cells(k, [(ids[a:b], *p[1:]) for a, b, p in zip(first, first[1:], rare, strict=False)]))

        for batch in batches:
            for c in tk.chunks(batch["text"]):
                data, w = tk.words(c, "nonspace")
                at = w.first[1 : len(c) + 1]
                in_head = m.places.of(w.hash)
                cls = np.concatenate([[0], np.insert(m.of(data, w, in_head), at, 0)])
                h = np.concatenate([[np.uint64(0)], np.insert(w.hash, at, np.uint64(0))])
                word = np.concatenate([[False], np.insert(np.ones(len(w), dtype=bool), at, False)])
                grid += np.bincount(cls[:-1] * k + cls[1:], minlength=len(grid))
                at, ids = np.flatnonzero(word), in_head if places is m.places else places.of(w.hash)
                if not len(at):
                    continue
                again, before = word[at + 1] & (h[at + 1] == h[at]), word[at - 1] & (h[at - 1] == h[at])
                after, before = np.where(again, 2 * k, cls[at + 1]), np.where(before, -1, k + cls[at - 1])
                some = ids >= 0
                own[ids[some]] = cls[at[some]]
                common.append((ids[some], None, after[some].astype(np.int16), before[some].astype(np.int16)))
                if every:
                    some = ~some
                    rare.append((w.hash[some], cls[at[some]], after[some].astype(np.int16), before[some].astype(np.int16)))
                    if size(rare) >= CTX_TOKENS:
                        yield from others()
                        rare = []
                if size(common) >= CTX_TOKENS:
                    sums.append(cells(k, [(p[0], p[0], *p[2:]) for p in common]))
                    common = []
                    if size(sums) >= CTX_CELLS:
                        yield from rows(k, h_head, own, *merged(sums))
                        sums = []
        if common:
            sums.append(cells(k, [(p[0], p[0], *p[2:]) for p in common]))
        if sums:
            yield from rows(k, h_head, own, *merged(sums))
        if rare:
            yield from others()
        at = np.flatnonzero(grid)
        yield batch_of(_CONTEXTS, h=[None], own=[None], ctx=[(at << CTX_BITS | grid[at]).astype(np.int64)])

    return run


def _merge_contexts(k: int):
    """Rows sorted by word and share -> one row for each word and share, summed as they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, total = None, 0, np.zeros(2 * k + 1, dtype=np.int64)
        for batch in batches:
            for h, share, cls, ctx in zip(batch["h"].to_pylist(), batch["share"].to_pylist(), batch["own"].to_pylist(), batch["ctx"], strict=True):
                if (h, share) != at:
                    if at is not None:
                        yield _context_row(at[0], own, total)
                    at, own, total[:] = (h, share), cls, 0
                x = np.asarray(ctx.values)
                total[x >> CTX_BITS] += x & (1 << CTX_BITS) - 1  # a row has each code once
        if at is not None:
            yield _context_row(at[0], own, total)

    return run


def _context_row(h: int, own: int, total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return batch_of(_CONTEXTS, h=[h], own=[own], ctx=[at << CTX_BITS | total[at]])


def merged_contexts(ws: Workspace, contexts: DataFrame, name: str, k: int, most: int | None = None) -> DataFrame:
    """Contexts of words with at most `most` rows of each: those of commoner words are dealt into shares and summed, again until they fit."""
    most = most or WORD_ROWS
    rows, step = contexts.where("h is not null"), 0
    while True:
        hot = ws.save(rows.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > most), f"{name}-hot-{step}")
        if hot.isEmpty():
            return rows
        hot = near(hot)
        dealt = rows.join(hot, "h").withColumn("share", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("k") / most)))
        dealt = dealt.select("h", "share", "own", "ctx").repartition("h", "share").sortWithinPartitions("h", "share")
        summed = dealt.mapInArrow(_merge_contexts(k), "h long, own int, ctx array<long>")
        rows = ws.save(rows.join(hot, "h", "left_anti").unionByName(summed), f"{name}-merged-{step}")
        step += 1


def class_grid(contexts: DataFrame, k: int) -> np.ndarray:
    """Class bigrams of all tasks: classes squared at most reach the driver."""
    cell = contexts.where("h is null").select(F.explode("ctx").alias("x")).groupBy(F.shiftright("x", CTX_BITS).alias("at"))
    grid = np.zeros(k * k)
    for r in cell.agg(F.sum(F.col("x").bitwiseAND(F.lit((1 << CTX_BITS) - 1))).alias("n")).collect():
        grid[r["at"]] = r["n"]
    return grid.reshape(k, k)


def likelihood(grid: np.ndarray) -> float:
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return f(grid) - f(grid.sum(axis=0)) - f(grid.sum(axis=1))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


class OneWord:
    """Where each word alone makes the class-bigram likelihood largest, all others being where `grid` has them.

    What a few occurrences add to a cell of the grid, or to a sum of it, is computed once: most words are rare.
    """

    FEW = 8

    def __init__(self, grid: np.ndarray):
        self.grid = grid
        self.after, self.before = np.ascontiguousarray(grid.T), np.ascontiguousarray(grid)
        self.sums = grid.sum(axis=1), grid.sum(axis=0)
        n = np.arange(self.FEW + 1.0)
        self.cell_gains = [_f(cells + n[:, None, None]) - _f(cells) for cells in (self.after, self.before)]
        self.sum_gains = [_f(sums + n[:, None]) - _f(sums) for sums in self.sums]

    def _side(self, which: int, mine: np.ndarray, other: np.ndarray, own: np.ndarray, itself: np.ndarray) -> np.ndarray:
        """Gain in the cells of the classes after (0) or before (1) each word, by the class the word may go to."""
        cells = (self.after, self.before)[which]
        i, j = np.nonzero(mine)
        n, mine_ = mine[i, j], own[i]
        gain = self.cell_gains[which][np.minimum(n, self.FEW).astype(np.int64), j]
        g = cells[j, mine_] - n  # the word is taken out of its own class
        gain[np.arange(len(i)), mine_] = _f(g + n) - _f(g)
        at = np.flatnonzero((n > self.FEW) | (j == mine_))
        g = cells[j[at]]
        g[np.arange(len(at)), mine_[at]] -= n[at]
        inside = np.flatnonzero(j[at] == mine_[at])
        g[inside] -= other[i[at[inside]]]
        g[inside, mine_[at[inside]]] -= itself[i[at[inside]]]
        gain[at] = _f(g + n[at, None]) - _f(g)
        return np.add.reduceat(gain, np.searchsorted(i, np.arange(len(own))), axis=0)

    def _margin(self, which: int, mine: np.ndarray, own: np.ndarray, itself: np.ndarray) -> np.ndarray:
        n = mine.sum(axis=1) + itself  # what others have with the word stays in their sums
        gain = self.sum_gains[which][np.minimum(n, self.FEW).astype(np.int64)]
        at = np.flatnonzero(n > self.FEW)
        gain[at] = _f(self.sums[which] + n[at, None]) - _f(self.sums[which])
        x = self.sums[which][own] - n
        gain[np.arange(len(own)), own] = _f(x + n) - _f(x)
        return gain

    def best(self, own: np.ndarray, right: np.ndarray, left: np.ndarray, itself: np.ndarray) -> np.ndarray:
        """own: class of each word; right and left: counts of each word with the class after and before it,
        itself: of the word after itself (not in right and left).  Every word has a class after and before it.
        Ties as in `exchange_clustering`.
        """
        gain = self._side(0, right, left, own, itself) + self._side(1, left, right, own, itself)
        # The word's cell with its own class is counted from both sides; it differs where both have something in it.
        i, j = np.nonzero((right != 0) & (left != 0) | (itself != 0)[:, None])
        r, l, s, d = right[i, j], left[i, j], itself[i], np.diagonal(self.grid)[j]
        d = np.where(j == own[i], d - (r + l + s), d)
        gain[i, j] += _f(d + r + l + s) - _f(d + r) - _f(d + l) + _f(d)
        gain -= self._margin(0, right, own, itself) + self._margin(1, left, own, itself)
        gain[:, 0] = -np.inf
        return np.where(gain.max(axis=1) <= gain[np.arange(len(own)), own] + 1e-9, own, gain.argmax(axis=1))


def best_classes(grid: np.ndarray, own: np.ndarray, right: np.ndarray, left: np.ndarray, itself: np.ndarray) -> np.ndarray:
    return OneWord(grid).best(own, right, left, itself)


def _assign(grid: np.ndarray, stay: bool = False):
    """Words (h, c, cls) of contexts; with `stay` each keeps the class it has."""
    k = len(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exchange, wide = OneWord(grid), 2 * k + 1
        for t in whole_groups(batches, "h", 1 << 20):
            t = t.combine_chunks()
            h, ctx = t["h"].to_numpy(), pa.concat_arrays(t["ctx"].chunks)
            new = np.concatenate([[True], h[1:] != h[:-1]])  # rows are sorted by word
            one, offsets = np.flatnonzero(new), ctx.offsets.to_numpy()
            h, own = h[one], t["own"].to_numpy()[one].astype(np.int64)
            value = ctx.flatten().to_numpy()
            at = np.repeat(np.cumsum(new) - 1, np.diff(offsets)) * wide + (value >> CTX_BITS)
            n = value & (1 << CTX_BITS) - 1
            first = np.append(offsets[one], offsets[-1]) - offsets[0]
            lo = 0
            while lo < len(h):
                hi = min(max(lo + 1, int(np.searchsorted(first, first[lo] + CTX_ENTRIES, side="right")) - 1), len(h))
                e = slice(first[lo], first[hi])
                cells = np.bincount(at[e] - lo * wide, weights=n[e], minlength=(hi - lo) * wide).reshape(hi - lo, -1)
                right, left, itself = cells[:, :k], cells[:, k:-1], cells[:, -1]
                cls = own[lo:hi] if stay else exchange.best(own[lo:hi], right, left, itself)
                yield batch_of(_WORDS, h=h[lo:hi], c=(right.sum(axis=1) + itself).astype(np.int64), cls=cls.astype(np.int32))
                lo = hi

    return run


@dataclass
class Classes:
    """Classes of words: of the head exactly, of others that of their unit until the word table is joined."""

    units: Units
    label: np.ndarray  # class of each unit
    head: np.ndarray  # sorted hashes of frequent words
    head_label: np.ndarray  # class of them
    k: int

    @cached_property
    def places(self) -> tk.Places:
        return tk.Places(self.head)

    def of(self, data: np.ndarray, w: tk.Words, at: np.ndarray) -> np.ndarray:
        """Class of each word: its own in the head (where it has the place `at`), else that of its unit."""
        out, other = np.zeros(len(w), dtype=np.int64), np.flatnonzero(at < 0)
        out[at >= 0] = self.head_label[at[at >= 0]]
        out[other] = self.label[suffix_units(data, w, other) + 1 + len(self.units.words)]  # the head has all word units
        return out

    def coded(self, data: np.ndarray, w: tk.Words, docs: int) -> Coded:
        at = self.places.of(w.hash)
        code = self.head_label[at].astype(np.int64) if len(self.head) else np.zeros(len(w), np.int64)
        rest = np.flatnonzero(at < 0)
        rest = rest[np.lexsort((w.hash[rest], w.doc[rest]))]
        h, d = w.hash[rest], w.doc[rest]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)]
        cut = np.flatnonzero(new)
        lists = np.searchsorted(d[cut], np.arange(docs + 1))
        code[rest] = self.k + np.cumsum(new) - 1 - lists[d]
        fallback = self.label[suffix_units(data, w, rest[cut]) + 1 + len(self.units.words)]
        stream = np.concatenate([[0], np.insert(code, w.first[1 : docs + 1], 0)])
        doc = np.insert(w.doc, w.first[1 : docs + 1], np.arange(docs))
        apart = (stream[:-1] >= self.k) | (stream[1:] >= self.k)
        return Coded(at, stream[:-1], stream[1:], doc, apart, lists, h[cut], np.diff(np.append(cut, len(h))), fallback)

    def opened(self, x: Coded, docs: int) -> dict[str, pa.Array]:
        """Lists a document: its rare words, their classes by unit, and the bigrams that hold one."""
        lists, pairs = pa.array(x.lists.astype(np.int32)), pa.array(np.searchsorted(x.doc[x.apart], np.arange(docs + 1)).astype(np.int32))
        made = lambda at, v: pa.ListArray.from_arrays(at, pa.array(v))
        return {
            "rare": made(lists, x.rare.view(np.int64)), "own": made(lists, x.fallback.astype(np.int32)),
            "left": made(pairs, x.left[x.apart].astype(np.int32)), "right": made(pairs, x.right[x.apart].astype(np.int32)),
        }


@dataclass
class Coded:
    """Bigrams of a chunk: class, or classes + place in the document's list of rare words."""

    at: np.ndarray  # place of each word in the head
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray
    apart: np.ndarray  # whether a bigram holds a rare word
    lists: np.ndarray  # where the rare words of each document begin
    rare: np.ndarray
    tf: np.ndarray
    fallback: np.ndarray


_OPENED = [("rare", pa.list_(pa.int64())), ("own", pa.list_(pa.int32())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32()))]
OPENED = "rare array<long>, own array<int>, left array<int>, right array<int>"
_GRID = pa.schema([("rk", pa.int64()), *_OPENED, ("n", pa.list_(pa.int64()))])
_CELLS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def join_rare(rows: DataFrame, words: DataFrame) -> DataFrame:
    """rows (rk, unique; rare) with `found`: place in rare, class and count of those that `words` has."""
    rare = rows.select("rk", F.posexplode("rare").alias("i", "h"))
    found = rare.join(words, "h").groupBy("rk").agg(F.collect_list(F.struct("i", "cls", "c")).alias("found"))
    return rows.join(found, "rk", "left")


def _resolved(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row: classes of its open bigrams, and places and counts of the rare words found."""
    ints = lambda x: np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64)
    for r in range(batch.num_rows):
        table_ = np.concatenate([np.arange(k), ints(batch["own"][r])])
        f = batch["found"][r]
        i = c = np.zeros(0, np.int64)
        if f.is_valid:
            i, cls, c = (f.values.field(x).to_numpy() for x in ("i", "cls", "c"))
            table_[k + i] = cls
        yield r, table_[ints(batch["left"][r])], table_[ints(batch["right"][r])], i, c


def _class_bigrams(held: Broadcast):
    """Rows of training texts with open bigrams; closed ones are summed into one row without a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        total = np.zeros(m.k * m.k, dtype=np.int64)
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                data, w = tk.words(c, "nonspace")
                x = m.coded(data, w, len(c))
                total += np.bincount(x.left[~x.apart] * m.k + x.right[~x.apart], minlength=len(total))
                out = batch_of(_GRID, rk=batch["rk"].slice(c.lo, len(c)), **m.opened(x, len(c)), n=pa.nulls(len(c), pa.list_(pa.int64())))
                yield out.filter(pa.array(np.diff(x.lists) > 0))
        at = np.flatnonzero(total)
        yield batch_of(_GRID, rk=[None], rare=[[]], own=[[]], left=[(at // m.k).astype(np.int32)], right=[(at % m.k).astype(np.int32)], n=[total[at]])

    return run


def _cells(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            for r, a, b, _, _ in _resolved(batch, k):
                n = batch["n"][r]
                total += np.bincount(a * k + b, weights=np.asarray(n.values) if n.is_valid else None, minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield batch_of(_CELLS, a=(at // k).astype(np.int32), b=(at % k).astype(np.int32), n=total[at])

    return run


@dataclass
class BrownModel:
    classes: Classes
    transition: np.ndarray  # log10 P(class | class)
    room: np.ndarray  # log10 denominators of P(word | class)
    log_count: np.ndarray  # log10(count + 1/2) of the words of the head
    end_log_count: float
    end_known: bool
    base_room: float
    train_tokens: int

    def local(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in tk.chunks(batch["text"]):
            data, w = tk.words(c, "nonspace")
            n = np.diff(w.first)
            x = self.classes.coded(data, w, len(c))
            a, b = x.left[~x.apart], x.right[~x.apart]
            model = tk.sum_by(x.doc[~x.apart], self.transition[a, b] - self.room[b], len(c))
            some = x.at >= 0
            seen = tk.sum_by(w.doc, np.where(some, self.log_count[np.maximum(x.at, 0)] if len(self.log_count) else 0.0, np.log10(HALF)), len(c)) + self.end_log_count
            known = tk.sum_by(w.doc, some, len(c)).astype(np.int64) + int(self.end_known)
            take = lambda k: batch[k].slice(c.lo, len(c))  # noqa: B023, E731
            lists = pa.array(x.lists.astype(np.int32))
            yield batch_of(_LOCAL, doc_id=take("doc_id"), held_out=take("held_out"), rk=take("rk"), n_tokens=n + 1, n_known=known, base=seen - (n + 1) * self.base_room, model=seen + model,
                           tf=pa.ListArray.from_arrays(lists, pa.array(x.tf.astype(np.int32))), **self.classes.opened(x, len(c)))

    def joined(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Adds what the rare words of each row contribute, now that their classes and counts are known."""
        n_known, base, model = (batch[x].to_numpy().copy() for x in ("n_known", "base", "model"))
        for r, a, b, i, c in _resolved(batch, self.classes.k):
            tf = np.asarray(batch["tf"][r].values)[i]
            more = (tf * (np.log10(c + HALF) - np.log10(HALF))).sum()
            n_known[r] += tf.sum()
            base[r] += more
            model[r] += more + (self.transition[a, b] - self.room[b]).sum()
        return batch_of(_SCORES, doc_id=batch["doc_id"], held_out=batch["held_out"], n_tokens=batch["n_tokens"], n_known=n_known, base_score=base, score=model)


_KEPT = [("doc_id", pa.int64()), ("held_out", pa.bool_())]
_LOCAL = pa.schema([*_KEPT, ("rk", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("tf", pa.list_(pa.int32())), *_OPENED])
_SCORES = pa.schema([*_KEPT, ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def head_condition(counts: DataFrame, most: int) -> Column:
    """Condition on (h, c) that holds for the `most` commonest words; of equally common ones those of the smallest hashes.

    Found from histograms of some thousand rows.  Up to a sixty-fourth of `most` may be left out where very many words
    are equally common; no words at all only where there are none.
    """

    def crossing(rows: DataFrame, key: Column, falling: bool, taken: int) -> tuple[int | None, int]:
        """The first bin that does not fit any more, and how many words lie before it."""
        per = {r["b"]: r["n"] for r in rows.groupBy(key.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for b in sorted(per, reverse=falling):
            if taken + per[b] > most:
                return b, taken
            taken += per[b]
        return None, taken

    b, taken = crossing(counts, F.floor(F.log2("c")), True, 0)
    if b is None:
        return F.lit(True)
    lo, hi = 1 << b, 2 << b
    while hi - lo > 1:
        step = -(-(hi - lo) // 1024)
        b, taken = crossing(counts.where((F.col("c") >= lo) & (F.col("c") < hi)), F.floor((F.col("c") - lo) / step), True, taken)
        lo, hi = lo + b * step, min(hi, lo + (b + 1) * step)
    chosen = F.col("c") > lo
    ties, prefix = counts.where(F.col("c") == lo), 0
    for shift in (54, 44, 34, 24, 14, 4):
        part = ties if shift == 54 else ties.where(F.shiftrightunsigned("h", shift + 10) == prefix)
        b, taken = crossing(part, F.shiftrightunsigned("h", shift), False, taken)
        if b is None:
            break
        chosen, prefix = (F.col("c") > lo) | (F.col("c") == lo) & (F.shiftrightunsigned("h", shift) < b), b
        if most - taken <= most // 64:
            break
    return chosen


def final_bigrams(docs: DataFrame, made: Classes, rare: DataFrame, ws: Workspace) -> np.ndarray:
    """Class bigrams of all texts, with the classes of the words outside the head from `rare`."""
    held = docs.sparkSession.sparkContext.broadcast(made)
    opened = docs.select("text", F.monotonically_increasing_id().alias("rk")).mapInArrow(_class_bigrams(held), f"rk long, {OPENED}, n array<long>")
    cells = join_rare(ws.save(opened, "opened"), rare).select("own", "left", "right", "n", "found").mapInArrow(_cells(made.k), "a int, b int, n long")
    grid = np.zeros((made.k, made.k))
    for r in cells.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # classes squared at most
        grid[r["a"], r["b"]] = r["n"]
    held.unpersist()
    ws.drop("opened")
    return grid


def train(docs: DataFrame, counts: DataFrame, ws: Workspace, head_words: int = HEAD_WORDS, word_units: int = WORD_UNITS, classes: int = CLASSES, passes: int = PASSES) -> tuple[BrownModel, DataFrame]:
    """Training documents (text) and their token counts -> model, and the words outside its head (h, c, cls)."""
    spark = docs.sparkSession
    docs = docs.select("text")
    n_docs = docs.count()
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    in_head = head_condition(counts, head_words)
    head = counts.where(in_head).toArrow()  # head_words at most
    h, c = head["h"].to_numpy().view(np.uint64), head["c"].to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    top = np.sort(np.lexsort((h, -c))[:word_units])
    units = Units(h[top])
    parts = docs.mapInArrow(_bigrams(units), "u int, to array<int>, n array<long>")
    rows = parts.repartition("u").sortWithinPartitions("u").mapInArrow(_add_rows(units.n), "u int, to array<int>, n array<long>").toArrow()
    pairs = np.zeros((units.n, units.n), dtype=np.int64)
    for batch in rows.to_batches():
        for u, to, n in zip(batch["u"].to_pylist(), batch["to"], batch["n"], strict=True):
            pairs[u, np.asarray(to.values)] = np.asarray(n.values)
    label = exchange_clustering(pairs, classes)
    k = classes + 1
    made = Classes(units, label, h[top], label[1 : 1 + len(top)].astype(np.int16), k)
    best, before = -np.inf, made
    wanted = spark.sparkContext.broadcast(h)
    words = None
    for step in range(passes + 1):
        last = step == passes
        held = spark.sparkContext.broadcast(made)
        contexts = ws.save(docs.mapInArrow(_contexts(held, wanted, last), "h long, own int, ctx array<long>"), f"contexts-{step}")
        held.unpersist()
        grid = class_grid(contexts, k)
        if (now := likelihood(grid)) < best and not last:
            made, best = before, np.inf  # taken back; the last round goes on from there
            ws.drop(f"contexts-{step}")
            continue
        best, before = max(best, now), made
        dealt = merged_contexts(ws, contexts, f"contexts-{step}", k).repartition("h").sortWithinPartitions("h")

        def settle(name: str, dealt: DataFrame = dealt, grid: np.ndarray = grid, last: bool = last, stay: bool = False) -> tuple[DataFrame, Classes]:
            words = ws.save(dealt.mapInArrow(_assign(grid, stay), "h long, c long, cls int"), name)
            own = (words.where(in_head) if last else words).select("h", "cls").toArrow()
            head_label = np.zeros(len(h), dtype=np.int16)
            head_label[np.searchsorted(h, own["h"].to_numpy().view(np.uint64))] = own["cls"].to_numpy()
            return words, Classes(units, label, h, head_label, k)

        words, made = settle(f"words-{step}")
        if not last:
            ws.drop(f"contexts-{step}")
    rare = words.where(~in_head)
    before, grid = grid, final_bigrams(docs, made, rare, ws)
    if likelihood(grid) < likelihood(before):
        # The last round moved all words at once to where each alone would gain: taken back like the others.
        words, made = settle("words-kept", stay=True)
        rare, grid = words.where(~in_head), before
    ws.drop(f"contexts-{passes}")
    transition = np.log10((grid + HALF) / (grid.sum(axis=1, keepdims=True) + HALF * k))
    kinds = np.zeros(k)
    kinds[0] = n_docs > 0
    for r in words.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a class
        kinds[r["cls"]] += r["n"]
    room = np.log10(grid.sum(axis=0) + HALF * (kinds + 1))
    all_tokens, all_kinds = int(tokens) + n_docs, int(distinct) + (n_docs > 0)
    base_room = float(np.log10(all_tokens + HALF * (all_kinds + 1)))
    return BrownModel(made, transition, room, np.log10(c + HALF), float(np.log10(n_docs + HALF)), n_docs > 0, base_room, all_tokens), rare


def score(docs: DataFrame, training: DataFrame, **options: int) -> DataFrame:
    """docs (doc_id, held_out, text) scored by a model of `training` (text): one row per input row.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of
    the text and its end), perplexity.  Null and empty texts have one token, the end.  Very long
    texts are scored whole, with some twenty times their length of memory.  Equal texts score
    alike, and each of repeated rows has its row.  With no training documents every count is
    zero; no documents give no rows.  Ties in clustering keep the lower class.  Extra columns are
    ignored.
    """
    spark = docs.sparkSession
    schema = f"doc_id long, held_out boolean, rk long, n_tokens long, n_known long, base double, model double, tf array<int>, {OPENED}"
    with Workspace(spark, "brown") as ws:
        training = pick(training, "text")
        counts = training.mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
        counts = ws.save(counts, "counts")
        model, words = train(training, counts, ws, **options)
        ws.drop("counts")
        held = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from held.value.local(batch)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield held.value.joined(batch)

        # A key a row: written once, so it stays what it is.
        local = ws.save(pick(docs, "doc_id", "held_out", "text").select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("rk")).mapInArrow(run, schema), "local")
        rows = join_rare(local, words).mapInArrow(join, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        out = rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
        return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).checkpoint()


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of those outside the held-out fold.

    A null id is in no fold: neither held out nor learnt from.  For null, empty, long and repeated texts,
    ties and empty tables see `score`.
    """
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return score(docs.select("doc_id", "text", held_out), docs.where(fold("doc_id", 5) != 1))
