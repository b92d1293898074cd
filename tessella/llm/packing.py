"""Best-fit packing of token sequences: length patterns fitted by non-negative least squares.

1. One Arrow pass turns each text into token ids, cuts documents that are longer than a sequence,
   and numbers the pieces of equal length within small parts of the output.
2. The histogram of lengths (at most `capacity` numbers, whatever the corpus) goes to the driver.
   There all patterns of up to four length classes that fill a sequence are enumerated, and
   how often each repeats is fitted to the histogram by non-negative least squares and rounded.
   The last two places of a pattern are a pair of lengths that fills the sequence exactly.
3. Lengths that no pattern took are packed into the tightest gaps, longest first, in bulk: a group
   of equal sequences is one row, so the work depends on the number of lengths and not of pieces.
4. The plan says which pieces of a length, by number, go where.  Numbers within parts become
   numbers within the corpus by running sums over parts, and each piece looks up its place.

Pieces are never shuffled to be sorted or packed, and no length, however common, is a group.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import Workspace, near, pick, table

CAPACITY, END = 4096, 1
#: Classes of lengths that patterns are made of, and places of a pattern at most.
CLASSES, PLACES = 128, 4
#: Pieces numbered together; words whose ids a task remembers at a time.
PART_ROWS, MOST_WORDS = 100_000, 600_000


# ------------------------------------------------------------------ tokens


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of words; the first `most` different words are encoded once and remembered.

    The tokeniser's own splitting never joins what a blank (0x20, 0x09 to 0x0D) parts, so the ids
    of a text are those of its words one after the other.  Common words come early, so they are
    among the remembered; others are encoded again in each chunk that has them.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        self.tokenizer, self.most = _tokenizer(path), most
        self.known: dict[bytes, int] = {}
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[list[int]] = []
        for lo in range(0, len(words), 4096):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words[lo : lo + 4096]], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word begin and how many they are, in the ids returned last."""
        fresh = [w for w in words if w not in self.known]
        ids, sizes = self._encode(fresh)
        kept = min(len(fresh), self.most - len(self.known))
        for w in fresh[:kept]:
            self.known[w] = len(self.known)
        if kept:
            self.ids = np.concatenate([self.ids, ids[: sizes[:kept].sum()]])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes[:kept])])
        late = {w: len(self.known) + k for k, w in enumerate(fresh[kept:])}
        at = np.array([self.known[w] if w in self.known else late[w] for w in words], dtype=np.int64)
        first, all_ids = self.first, self.ids
        if late:
            all_ids = np.concatenate([all_ids, ids[sizes[:kept].sum() :]])
            first = np.concatenate([first, first[-1] + np.cumsum(sizes[kept:])])
        return first[at], first[at + 1] - first[at], all_ids

    def of(self, chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk, and where those of each begin (one entry more than texts)."""
        data, w = tk.words(chunk, "nonspace", lower=False)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(len(chunk) + 1, np.int64)
        number, n = tk.numbers(w.k1, w.k2)
        one = np.empty(n, dtype=np.int64)
        one[number] = np.arange(len(w))
        body = data.tobytes()
        first, size, ids = self._look_up([body[a:b] for a, b in zip(w.start[one].tolist(), w.end[one].tolist(), strict=True)])
        size = size[number]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids[tk.ranges(first[number], size)], total[w.first]


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    """Kept by a worker from task to task."""
    return WordIds(path)


def _documents(words: WordIds, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """Index and ids of each text, `end` last; a long text is encoded in parts that end between words."""
    for c in tk.chunks(texts, rows=2048):
        parts = list(tk.pieces(c, "nonspace")) if len(c) == 1 else [c]
        if len(parts) > 1:
            yield c.lo, np.concatenate([*(words.of(p)[0] for p in parts), [end]]).astype("<u4")
            continue
        ids, first = words.of(c)
        for k in range(len(c)):
            yield c.lo + k, np.append(ids[first[k] : first[k + 1]], end).astype("<u4")


PIECES = "id long, piece int, start long, length long, ids_crc32 long, part long, n long"


def _tokenise(path: str, capacity: int, end: int, with_ids: bool):
    fields = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("n", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        part, done, seen = TaskContext.get().partitionId() << 32, 0, np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows, doc = [], batch["id"].to_pylist()
            for row, ids in _documents(words, batch["text"], end):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    body = ids[at : at + capacity]
                    rows.append((doc[row], k, at, len(body), zlib.crc32(body.tobytes()), part, int(seen[len(body)])) + ((body.astype(np.int32),) if with_ids else ()))
                    seen[len(body)] += 1
                    done += 1
                    if done == PART_ROWS:
                        part, done = part + 1, 0
                        seen[:] = 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


# ------------------------------------------------------------------ the plan, from the histogram alone


def patterns(units: int, places: int) -> np.ndarray:
    """All falling sequences of up to `places` classes with sum `units`; unused places are 0."""
    out = [(units,) + (0,) * (places - 1)]
    for m in range(2, places + 1):
        for head in combinations_with_replacement(range(units // 2, 0, -1), m - 1):
            # `head` are the smaller classes, falling; the largest is what they leave.
            if (top := units - sum(head)) >= head[0]:
                out.append((top, *head, *(0,) * (places - m)))
    return np.array(sorted(set(out), reverse=True), dtype=np.int64)


def fit(shape: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-negative least squares by active sets: repeats of each pattern whose classes sum up to `wanted`.

    `shape` holds classes 1..len(wanted) (0: none).  Patterns are gathered, never written as a matrix.
    """
    n = len(wanted)
    w2 = np.append(0.0, weight**2)
    target = np.append(0.0, wanted.astype(np.float64))

    def column(k: int) -> np.ndarray:
        return np.bincount(shape[k], minlength=n + 1)[1:] * weight

    x, passive, matrix = np.zeros(len(shape)), [], np.zeros((n, 0))
    goal, tiny = wanted * weight, 1e-9 * max(float((wanted * weight**2).max(initial=0)), 1.0)
    for _ in range(3 * n):
        got = np.zeros(n + 1)
        for k in passive:
            np.add.at(got, shape[k], x[k])
        slope = (w2 * (target - got))[shape].sum(axis=1)
        slope[passive] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tiny or len(passive) >= n:
            break
        passive.append(best)
        matrix = np.column_stack([matrix, column(best)])
        while True:
            s = np.linalg.lstsq(matrix, goal, rcond=None)[0]
            if (s > 0).all():
                break
            now = x[passive]
            low = s <= 0
            step = np.min(now[low] / np.maximum(now[low] - s[low], 1e-300))
            now = now + step * (s - now)
            stay = now > 1e-9
            stay &= ~(low & (now <= now[low].min() + 1e-12))
            x[passive] = np.where(stay, now, 0)
            passive = [k for k, ok in zip(passive, stay, strict=True) if ok]
            matrix = matrix[:, stay]
            if not passive:
                s = np.zeros(0)
                break
        x[passive] = s
    return x


@dataclass
class Bins:
    """Equal sequences: how many, what is free in each, and (length, how often) in order."""

    count: int
    free: int
    held: tuple[tuple[int, int], ...]


def realise(shape: np.ndarray, repeats: np.ndarray, left: np.ndarray, capacity: int, width: int) -> list[Bins]:
    """Sequences of the rounded patterns, as far as pieces are left that fill them; takes those off `left`.

    All places but the last two take the longest length of their class; the last two take a pair
    that fills the sequence to the last token.  What finds no such pair is left to `best_fit`.
    """
    bins = []
    lengths = [np.arange(u * width, (u - 1) * width, -1) for u in range(1, capacity // width + 1)]

    def longest(u: int, held: list[int]) -> Iterator[int]:
        return (x for x in lengths[u - 1].tolist() if left[x] > held.count(x))

    def filling(classes: list[int]) -> list[int] | None:
        held: list[int] = []
        for u in classes[:-2]:
            if (x := next(longest(u, held), None)) is None:
                return None
            held.append(x)
        gap = capacity - sum(held)
        for x in longest(classes[-2], held) if len(classes) > 1 else ():
            if gap > x and left[gap - x] > held.count(gap - x) + (x == gap - x):
                return [*held, x, gap - x]
        return None

    for k in np.flatnonzero(repeats):
        wanted, classes = int(repeats[k]), shape[k][shape[k] > 0].tolist()
        while wanted > 0 and (held := filling(classes)):
            n = min(wanted, *(int(left[x]) // held.count(x) for x in set(held)))
            for x in held:
                left[x] -= n
            bins.append(Bins(n, 0, tuple((x, 1) for x in held)))
            wanted -= n
    return bins


def best_fit(left: np.ndarray, bins: list[Bins], capacity: int) -> list[Bins]:
    """Lengths that are left, longest first, each into the tightest gap that holds it, else into new sequences."""
    full = [b for b in bins if not b.free]
    by_free: dict[int, list[Bins]] = {}
    frees: list[int] = []

    def put(b: Bins) -> None:
        if not b.free:
            full.append(b)
        elif b.free in by_free:
            by_free[b.free].append(b)
        else:
            by_free[b.free] = [b]
            insort(frees, b.free)

    for b in bins:
        if b.free:
            put(b)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(frees, length)
            if at < len(frees):
                group = by_free[frees[at]]
                b = group.pop()
                if not group:
                    del by_free[frees[at]]
                    frees.pop(at)
            else:
                b = Bins(n, capacity, ())
            # The tightest gap stays the tightest until nothing of this length fits any more.
            each = b.free // length
            whole = min(b.count, n // each)
            if whole:
                put(Bins(whole, b.free - each * length, (*b.held, (length, each))))
                n -= whole * each
            rest = b.count - whole
            if rest and n and not (b.held == () and whole == b.count):
                some = min(n, each)
                put(Bins(1, b.free - some * length, (*b.held, (length, some))))
                n -= some
                rest -= 1
            if rest and b.held:
                put(Bins(rest, b.free, b.held))
    return full + [b for group in by_free.values() for b in group]


#: Rows of a plan: pieces lo, lo+1, ... of a length (`times` in each of `count` sequences) and where they go.
PLAN = np.dtype([("length", "i8"), ("lo", "i8"), ("count", "i8"), ("times", "i8"), ("sequence", "i8"), ("offset", "i8")])


def make_plan(counts: np.ndarray, capacity: int, classes: int = CLASSES, places: int = PLACES) -> np.ndarray:
    """The place of every piece, from counts[length]; rows by length, then lo.  At most some rows for each length."""
    left = counts.astype(np.int64).copy()
    classes = min(classes, capacity)
    while capacity % classes:
        classes -= 1
    width = capacity // classes
    bins = [Bins(int(left[capacity]), 0, ((capacity, 1),))] if left[capacity] else []
    left[capacity] = 0
    wanted = left[1:].reshape(classes, width).sum(axis=1)
    if wanted.any():
        shape = patterns(classes, places)
        x = fit(shape, wanted, np.arange(1, classes + 1) / classes)
        bins += realise(shape, np.floor(x + 0.5).astype(np.int64), left, capacity, width)
    rows, taken, sequence = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for b in best_fit(left, bins, capacity):
        offset = 0
        for length, times in b.held:
            rows.append((length, taken[length], b.count, times, sequence, offset))
            taken[length] += b.count * times
            offset += length * times
        sequence += b.count
    return np.sort(np.array(rows, dtype=PLAN), order=["length", "lo"])


# ------------------------------------------------------------------ the operator


def _place(plan: np.ndarray, names: list[str]):
    first = np.searchsorted(plan["length"], np.arange(plan["length"].max() + 2)) if len(plan) else np.zeros(2, np.int64)
    # One rising key for (length, lo): lengths apart by more than any number.
    far = int((plan["lo"] + plan["count"] * plan["times"]).max()) + 1 if len(plan) else 1
    key = plan["length"] * far + plan["lo"]
    assert not len(plan) or far * (len(first) + 1) < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, n = batch["length"].to_numpy(), batch["n"].to_numpy()
            row = plan[np.searchsorted(key, length * far + n, side="right") - 1]
            at = n - row["lo"]
            more = [pa.array(row["sequence"] + at % row["count"]), pa.array(row["offset"] + at // row["count"] * length)]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), *more], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = True, classes: int = CLASSES) -> DataFrame:
    """(doc_id, text) -> id, piece, start, length, ids_crc32, sequence_id, offset; and `ids`.

    A document is its token ids and then `end`; a null, empty or blank one is `end` alone.  One
    longer than `capacity` is cut into pieces of that length and a rest.  Rows that share an id
    are documents of their own, repeated rows too.  Pieces of equal length are alike to the plan,
    so ties need no rule.  Long texts are encoded in parts that end between words.  An empty
    table gives none.  Extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    with Workspace(spark, "packing") as ws:
        slim = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("id"), "text")
        schema = PIECES + ", ids array<int>" * with_ids
        pieces = ws.save(slim.mapInArrow(tk.releasing(_tokenise(tokenizer or default_tokenizer(), capacity, end, with_ids)), schema), "pieces")
        sizes = ws.save(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("k")), "sizes")
        counts = np.zeros(capacity + 1, dtype=np.int64)
        for r in sizes.groupBy("length").agg(F.sum("k").alias("k")).collect():
            counts[r.length] = r.k
        plan = make_plan(counts, capacity, classes)
        before = (F.sum("k").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before")
        before = ws.save(sizes.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), "before")
        numbered = pieces.join(near(before), ["part", "length"]).withColumn("n", F.col("n") + F.col("before"))
        names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        out = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
        return numbered.select(*names, "n").mapInArrow(_place(plan, names), out).checkpoint()


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with `ids` -> sequence_id, ids, documents (id, piece, offset, length); a sequence has `capacity` ids at most."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("held")).select("sequence_id", F.flatten("held.ids").alias("ids"), F.transform("held", lambda s: F.struct(s["id"].alias("id"), s["piece"].alias("piece"), s["offset"].alias("offset"), s["length"].alias("length"))).alias("documents"))


def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` as pieces of at most 4,096 tokens, in as few sequences as the patterns allow.

    See `pack` for nulls, empty and long texts, repeated rows and empty tables.
    """
    packed = pack(table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
