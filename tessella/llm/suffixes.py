"""Repeated-substring removal: anchored buckets of suffixes, refined by bucket pointers.

A 200-byte string that starts at two places has the same content, so a rule that looks only at
its content picks the same anchor in it: here the rightmost smallest of its 169 32-byte q-gram
hashes.  The suffixes (window starts) of a document therefore fall into runs that share an
anchor, and two suffixes can only be equal to depth 200 if their anchors' q-grams are equal.

1. One Arrow pass gives a row for each run: place, number of starts, anchor q-gram (the initial
   bucket) and a 128-bit BLAKE2b digest of the run's bytes.  In periodic text the anchor moves on
   once a period and the runs there have equal bytes: neighbours with equal digests are one row
   that says how many `times` the run follows itself.  So there is about one row for 75 bytes.
2. Buckets with one row are final: those suffixes are unique.  Buckets whose rows all have the
   same bytes (by digest) are final too: all those suffixes repeat.
3. The other buckets keep one row for each distinct run.  Their suffixes are refined in place:
   the bucket identifiers at depth d are sorted by the identifier found d bytes later, which
   gives depth 2d; the new identifiers are what the next round reads.  Buckets that became
   single drop out.  At depth 200 a bucket of two suffixes or more repeats.
4. A bucket with more than `hot_rows` distinct runs is dealt over tasks.  Each refines its part in
   the same way and sends on its buckets at depth 200, known by the digest of their 200 bytes
   and packed into a row for each slot of digests; a slot's rows meet in one task, and a part is
   told which of its single suffixes others repeat.
5. The spans of a document are merged and cut from its bytes.

Texts are read in parts of a bounded size that overlap by a window less a byte: a window's anchor
depends on the window alone, so the parts' runs are those of the whole, cut at more places.
Digests stand for bytes: two different strings of the corpus have equal ones with probability 2^-128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import BROADCAST_ROWS, Columns, Workspace, batch_of, near, pick, row_key, same_row, table
from .minhash import whole_groups

LENGTH, QGRAM = 200, 32
#: Text that a task works on at a time; its arrays take some hundred bytes for each byte.
STEP_BYTES = 1 << 19
#: Parts of a hot bucket for each slot of their digests, and bytes of digests that a task compares at a time.
SLOT_PARTS, SLOT_BYTES = 16, 8 << 20
#: Runs whose digests are made at a time.
DIGESTS = 1 << 16
_BYTE = tk.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_RUNS = pa.schema([("id", pa.int64()), ("rk", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("times", pa.int32()), ("anchor", pa.int64()), ("seg", pa.binary())])
RUNS = "id long, rk long, start int, n int, times int, anchor long, seg binary"


def qgram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-byte strings of `data`, q a power of two, by doubling."""
    h, d = _BYTE[data], 1
    while d < q:
        h = h[:-d] * np.uint64(0x9FB21C651E98DF25 + 2 * d) + h[d:]
        d *= 2
    return h


def window_minimum(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive keys: smaller of a block's suffix and the next one's prefix minimum."""
    n = len(key) - w + 1
    pad = np.full(-len(key) % w, np.iinfo(np.uint64).max, dtype=np.uint64)
    rows = np.concatenate([key, pad]).reshape(-1, w)
    front = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[w - 1 : w - 1 + n])


def runs(chunk: tk.Chunk, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Per run of window starts with one anchor: document, start in it, starts, times it follows itself, anchor hash, digest of its bytes."""
    size = chunk.end - chunk.start
    none = np.zeros(0, dtype=np.int64)
    if not (size >= length).any():
        return none, none, none, none, none.astype(np.uint64), np.zeros((0, 16), np.uint8)
    data = chunk.data
    h = tk.mix(qgram_hashes(data, q))
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = (h >> bits << bits) | (mask - np.arange(len(h), dtype=np.uint64))
    anchor = (mask - (window_minimum(key, length - q + 1) & mask)).astype(np.int64)
    del key
    starts = np.maximum(size - length + 1, 0)
    doc = np.repeat(np.arange(len(chunk)), starts)
    p = np.arange(len(doc)) + np.repeat(chunk.start - (np.cumsum(starts) - starts), starts)
    a = anchor[p]
    cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    n = np.diff(np.append(cut, len(a)))
    s, d, h = p[cut], doc[cut], h[a[cut]]
    # Runs of a document follow each other without a gap: where bytes repeat, so do anchor, length and digest.
    alike = np.zeros(len(s), dtype=bool)
    alike[1:] = (d[1:] == d[:-1]) & (h[1:] == h[:-1]) & (n[1:] == n[:-1])
    seg = np.empty((len(s), 16), dtype=np.uint8)
    for lo in range(0, len(s), DIGESTS):
        seg[lo : lo + DIGESTS] = tk.digests(data, s[lo : lo + DIGESTS], s[lo : lo + DIGESTS] + n[lo : lo + DIGESTS] + length - 1)
    alike[1:] &= (seg[1:] == seg[:-1]).all(axis=1)
    first = np.flatnonzero(~alike)
    times = np.diff(np.append(first, len(s)))
    return d[first], s[first] - chunk.start[d[first]], n[first], times, h[first], seg[first]


def _parts(chunk: tk.Chunk, length: int) -> Iterator[tuple[tk.Chunk, int]]:
    """A chunk, or the overlapping parts of a single long document, with the place where each begins."""
    if len(chunk) > 1 or len(chunk.data) <= 2 * STEP_BYTES:
        yield chunk, 0
        return
    size = int(chunk.end[0])
    for at in range(0, max(size - length + 1, 1), STEP_BYTES):
        to = min(at + STEP_BYTES + length - 1, size)
        yield tk.Chunk(chunk.lo, chunk.hi, chunk.data[at:to], np.array([0]), np.array([to - at])), at


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an array of binary values."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.py_buffer(np.ascontiguousarray(rows))])


def _find_runs(length: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"], STEP_BYTES):
                for part, at in _parts(c, length):
                    doc, start, n, times, anchor, seg = runs(part, length, q)
                    row = pa.array(c.lo + doc)
                    yield pa.RecordBatch.from_arrays([batch["id"].take(row), batch["rk"].take(row), pa.array((start + at).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(times.astype(np.int32)), pa.array(anchor.view(np.int64)), fixed_binary(seg)], schema=_RUNS)

    return run


_CUT = pa.schema([("anchor", pa.int64()), ("seg", pa.binary()), ("n", pa.int32()), ("c", pa.int64()), ("body", pa.binary())])
CUT = "anchor long, seg binary, n int, c long, body binary"


def _cut_bytes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                body = text.as_py().encode()
                rows = wanted.as_py()
                for lo in range(0, len(rows), 4096):
                    some = rows[lo : lo + 4096]
                    yield batch_of(_CUT, anchor=[r["anchor"] for r in some], seg=[r["seg"] for r in some], n=[r["n"] for r in some], c=[r["c"] for r in some], body=[body[r["start"] : r["start"] + r["n"] + length - 1] for r in some])

    return run


def refine(data: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifier at depth `length` of every byte position (-1 where no string of that length begins).

    Strings lie in data[first[i]:first[i+1]].  Starts from 8-gram buckets; each round sorts the
    buckets that still hold several suffixes by the identifier `step` bytes later.
    """
    end = np.repeat(first[1:], np.diff(first))
    pos = np.arange(len(data))
    ids = np.full(len(data), -1, dtype=np.int64)
    depth = min(8, length)
    gram = np.zeros(len(data), dtype=np.uint64)
    for j in range(depth):
        gram[: len(data) - j] |= data[j:].astype(np.uint64) << np.uint64(8 * j)
    live = np.flatnonzero(pos + depth <= end)
    _, ids[live], count = np.unique(gram[live], return_inverse=True, return_counts=True)
    many = count[ids[live]] > 1
    while depth < length:
        step = min(depth, length - depth)
        live = live[many]
        live = live[live + depth + step <= end[live]]
        fresh = np.full(len(data), -1, dtype=np.int64)
        # A later offset whose bucket became single has no identifier any more: no partner either.
        live = live[ids[live + step] >= 0]
        _, inverse, count = np.unique(ids[live] << np.int64(32) | ids[live + step], return_inverse=True, return_counts=True)
        fresh[live] = inverse
        many = count[inverse] > 1
        ids, depth = fresh, depth + step
    return ids


_DUP = pa.schema([("anchor", pa.int64()), ("seg", pa.binary()), ("from", pa.list_(pa.int32())), ("len", pa.list_(pa.int32()))])
DUP = "anchor long, seg binary, `from` array<int>, len array<int>"


def _refined(t: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """Suffixes of the runs of a table: their run, place in it, bucket at depth `length`, and the runs' bytes and places."""
    n = t["n"].to_numpy()
    first = np.concatenate([[0], np.cumsum(n + length - 1)])
    data = np.frombuffer(b"".join(t["body"].to_pylist()), dtype=np.uint8)
    ids = refine(data, first, length)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, at, ids[first[row] + at], data, first


def _spans(row: np.ndarray, at: np.ndarray, dup: np.ndarray, n: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Stretches of marked suffixes of each of n runs, as lists; and how many each has."""
    edge = np.flatnonzero(dup & np.concatenate([[True], ~dup[:-1] | (row[1:] != row[:-1])]))
    last = np.flatnonzero(dup & np.concatenate([~dup[1:] | (row[1:] != row[:-1]), [True]]))
    per = np.searchsorted(row[edge], np.arange(n + 1)).astype(np.int32)
    lo = pa.ListArray.from_arrays(pa.array(per), pa.array(at[edge].astype(np.int32)))
    return lo, pa.ListArray.from_arrays(pa.array(per), pa.array((last - edge + 1).astype(np.int32))), np.diff(per)


def _refine_groups(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "anchor", STEP_BYTES):
            t = t.combine_chunks()
            c = t["c"].to_numpy()
            row, at, got, _, _ = _refined(t, length)
            some = got >= 0
            weight = np.bincount(got[some], weights=c[row[some]]) if some.any() else np.zeros(1)
            lo, ln, count = _spans(row, at, (c[row] > 1) | (some & (weight[np.maximum(got, 0)] > 1)), len(c))
            out = pa.RecordBatch.from_arrays([t["anchor"].combine_chunks(), t["seg"].combine_chunks(), lo, ln], schema=_DUP)
            yield out.filter(pa.array(count > 0))

    return run


_PART = pa.schema([("part", pa.int64()), ("anchor", pa.int64()), ("slot", pa.int32()), ("keys", pa.binary()), ("cs", pa.binary())])
PART = "part long, anchor long, slot int, keys binary, cs binary"
_LONE = pa.schema([("part", pa.int64()), ("key", pa.binary())])


def _buckets(t: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """Suffixes of a part's runs: run, place, bucket; of each bucket its weight, first suffix and where that begins; the bytes."""
    row, at, got, data, first = _refined(t, length)
    # Suffixes whose bucket became single on the way are buckets of one.
    got = np.where(got < 0, got.max(initial=-1) + np.cumsum(got < 0), got)
    _, one, bucket = np.unique(got, return_index=True, return_inverse=True)
    weight = np.bincount(bucket, weights=t["c"].to_numpy()[row], minlength=len(one)).astype(np.int64)
    return row, at, bucket, weight, one, first[row[one]] + at[one], data


def _refine_part(length: int):
    """Parts of hot buckets -> digests of a part's buckets at depth `length`, packed: a row for each slot that digests fall into.

    `cs` says of each digest whether its bucket has one suffix of the part, or more (2).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "part", STEP_BYTES):
            row, at, bucket, _, _, _, data = _buckets(t := t.combine_chunks(), length)
            n = t["n"].to_numpy()
            first = np.cumsum(n + length - 1) - (n + length - 1)
            parts, part = np.unique(t["part"].to_numpy(), return_inverse=True)
            # A table may hold several parts: what they share is told by each of them.
            _, one, pair = np.unique(bucket * len(parts) + part[row], return_index=True, return_inverse=True)
            c = np.minimum(np.bincount(pair, weights=t["c"].to_numpy()[row], minlength=len(one)), 2).astype(np.uint8)
            start, of = first[row[one]] + at[one], row[one]
            keys = tk.digests(data, start, start + length)
            slot = (keys.view("<u8")[:, 0] % t["slots"].to_numpy()[of].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((slot, part[of]))
            keys, c, slot, of = keys[order], c[order], slot[order], of[order]
            cut = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (part[of[1:]] != part[of[:-1]])]))
            ends = np.append(cut[1:], len(slot))
            take = pa.array(of[cut])
            yield pa.RecordBatch.from_arrays([
                t["part"].combine_chunks().take(take), t["anchor"].combine_chunks().take(take), pa.array(slot[cut].astype(np.int32)),
                pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([c[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
            ], schema=_PART)

    return run


def _find_lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed digests of the parts, slot by slot -> for each part those of its single suffixes that another part repeats."""
    for t in whole_groups(batches, "group", SLOT_BYTES):
        blobs = t["cs"].to_pylist()
        c, key = np.frombuffer(b"".join(blobs), np.uint8), np.frombuffer(b"".join(t["keys"].to_pylist()), "<u8").reshape(-1, 2)
        row = np.repeat(np.arange(len(blobs)), [len(x) for x in blobs])
        order = np.lexsort((key[:, 1], key[:, 0]))
        new = np.concatenate([[True], (key[order[1:]] != key[order[:-1]]).any(axis=1)])
        same = np.empty(len(c), np.int64)
        same[order] = np.cumsum(new) - 1
        told = np.flatnonzero((c == 1) & (np.bincount(same, weights=c)[same] > 1))
        at = np.searchsorted(row[told], np.arange(len(blobs) + 1))
        some = np.flatnonzero(np.diff(at))
        part = t["part"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(part[some]), pa.array([key[told[at[i] : at[i + 1]]].tobytes() for i in some], pa.binary())], schema=_LONE)


def _refine_known(length: int):
    """The parts again, with the digests of suffixes that only other parts repeat (rows without a body) -> repeated stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, "part", STEP_BYTES):
            known = whole.filter(pa.compute.is_valid(whole["key"]))["key"].to_pylist()
            t = whole.filter(pa.compute.is_valid(whole["body"])).combine_chunks()
            if not t.num_rows:
                continue
            row, at, bucket, weight, _, start, data = _buckets(t, length)
            twice = weight > 1
            if known:
                single = np.flatnonzero(~twice)
                keys = tk.digests(data, start[single], start[single] + length).view("V16").ravel()
                twice[single] = np.isin(keys, np.frombuffer(b"".join(known), dtype="V16"))
            lo, ln, count = _spans(row, at, twice[bucket], t.num_rows)
            out = pa.RecordBatch.from_arrays([t["anchor"].combine_chunks(), t["seg"].combine_chunks(), lo, ln], schema=_DUP)
            yield out.filter(pa.array(count > 0))

    return run


_MERGED = pa.schema([("id", pa.int64()), ("rk", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int32())))])


def merge(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s in sorted((x["lo"], x["hi"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return out


def _kept(body: bytes, cut: list[list[int]]) -> bytes:
    edges = [0, *(x for s in cut for x in s), len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _remove(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, rk, text, spans in zip(*(batch[k] for k in ("id", "rk", "text", "spans")), strict=True):
                body, cut = text.as_py().encode(), merge(spans.as_py())
                kept = _kept(body, cut)
                rows.append((doc.as_py(), rk.as_py(), len(body) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None, cut if with_bytes else None))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, _MERGED, strict=True)], schema=_MERGED)

    return run


def _slim(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), "text", row_key("text").alias("rk"))


def _texts(slim: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (id, rk, text) of the distinct keys (id, rk), each once."""
    keys = near(keys)
    return slim.join(keys, same_row(slim, keys), "left_semi").dropDuplicates(["id", "rk"])


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that are the same, with the other columns of `right`."""
    other = [c for c in right.columns if c not in ("id", "rk")]
    return left.join(right, same_row(left, right)).select(left["*"], *other)


def repeated_spans(docs: DataFrame, length: int = LENGTH, q: int = QGRAM, hot_rows: int = 1_000) -> DataFrame:
    """(doc_id, text) -> id, rk, spans: byte spans [lo, hi) whose every byte lies in a repeated string of `length` bytes.

    One row for each distinct (doc_id, text) with a repeat; spans may touch or overlap (merge()
    joins them).  Null, empty and short texts have no spans; very long ones are read in parts; a
    row that occurs twice repeats itself; an empty table has none.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    with Workspace(spark, "suffixes") as ws:
        slim = _slim(docs).where("text is not null")
        all_runs = ws.save(slim.select("id", "rk", "text").mapInArrow(tk.releasing(_find_runs(length, q)), RUNS), "runs")
        shared = all_runs.groupBy("anchor").agg(F.sum("times").alias("k"), F.min("seg").alias("a"), F.max("seg").alias("b")).where("k > 1")
        # Written first: a join of two plain shuffles, which AQE splits where an anchor is hot.
        shared = ws.save(shared.select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "anchors")
        kept = ws.save(all_runs.join(shared, "anchor"), "shared")
        ws.drop("runs", "anchors")
        first = F.min(F.struct("id", "rk", "start")).alias("at")
        distinct = kept.where("mixed").groupBy("anchor", "seg", "n").agg(F.sum("times").alias("c"), first)
        distinct = ws.save(distinct.select("anchor", "seg", "n", "c", "at.id", "at.rk", "at.start"), "distinct")
        wanted = distinct.groupBy("id", "rk").agg(F.collect_list(F.struct("anchor", "seg", "start", "n", "c")).alias("wanted"))
        texts = _texts(slim, distinct.select("id", "rk").distinct())
        cut = ws.save(_beside(texts, wanted).select("text", "wanted").mapInArrow(tk.releasing(_cut_bytes(length)), CUT), "cut")
        hot = ws.save(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot_rows), "hot")
        few = near(hot)
        cold = cut.join(few.select("anchor"), "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
        found = cold.mapInArrow(tk.releasing(_refine_groups(length)), DUP)
        if not hot.isEmpty():
            size = F.lit(max(hot_rows, 1))
            part = F.xxhash64("anchor", F.pmod(F.xxhash64("seg"), F.ceil(F.col("k") / size)))
            slots = F.ceil(F.col("k") / (size * SLOT_PARTS)).cast("int")
            dealt = ws.save(cut.join(few, "anchor").withColumns({"part": part, "slots": slots}).drop("k"), "dealt")
            local = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(tk.releasing(_refine_part(length)), PART)
            # A suffix that is single in its part and repeated in another: its part is told.
            met = local.select(F.xxhash64("anchor", "slot").alias("group"), "part", "keys", "cs").repartition("group").sortWithinPartitions("group")
            lone = met.mapInArrow(tk.releasing(_find_lone), "part long, key binary")
            again = dealt.unionByName(lone, allowMissingColumns=True).repartition("part").sortWithinPartitions("part")
            found = found.unionByName(again.mapInArrow(tk.releasing(_refine_known(length)), DUP))
        found = ws.save(found, "found")
        ws.drop("cut")
        whole = kept.where("not mixed").select("id", "rk", F.col("start").alias("lo"), (F.col("start") + F.col("n") * F.col("times") + F.lit(length - 1)).alias("hi"))
        # A run that follows itself repeats as a whole: its one stretch goes on to its last time.
        more = ((F.col("times") - 1) * F.col("n")).alias("more")
        parts = kept.where("mixed").join(found, ["anchor", "seg"]).select("id", "rk", "start", more, F.explode(F.arrays_zip("from", "len")).alias("r"))
        parts = parts.select("id", "rk", (F.col("start") + F.col("r.from")).alias("lo"), (F.col("start") + F.col("r.from") + F.col("r.len") + F.col("more") + F.lit(length - 1)).alias("hi"))
        return whole.unionByName(parts).distinct().groupBy("id", "rk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).checkpoint()


def _bounded(spans: DataFrame) -> DataFrame:
    """Rows with their spans, sent to every task only where rows and spans together are few."""
    n = spans.agg(F.coalesce(F.sum(F.size("spans") + 2), F.lit(0))).first()[0]
    return F.broadcast(spans) if n <= BROADCAST_ROWS else spans


def removals(docs: DataFrame, length: int = LENGTH, with_bytes: bool = True, **options: int) -> DataFrame:
    """For documents with repeats only: id, rk, n_removed, n_spans, kept_sha256, kept (bytes), spans (merged)."""
    spans = repeated_spans(docs, length, **options)
    texts = _beside(_texts(_slim(docs), spans.select("id", "rk")), spans)
    return texts.select("id", "rk", "text", "spans").mapInArrow(
        _remove(with_bytes), "id long, rk long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<int>>"
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options: int) -> DataFrame:
    """`docs` with every repeated string of `length` bytes cut out of `text`; rows, columns, their names and other values stay.

    A cut may fall inside a multi-byte character; what is left of it is dropped, so `text` stays
    valid.  `n_chars`, where there is one, is counted anew.  Null texts stay null; of rows that
    repeat both id and text each is cut alike.  An empty table stays empty.
    """
    held = Columns(docs)
    spans = _bounded(repeated_spans(docs, length, **options))
    text = held.at("text")
    rows = held.df.withColumns({"id": F.col(held.at("doc_id")), "rk": row_key(text)})
    cut = rows.join(spans, same_row(rows, spans), "left").select(*held.df.columns, "spans")
    names = held.df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() if not s.is_valid else _kept(t.as_py().encode(), merge(s.as_py())).decode("utf-8", "ignore") for t, s in zip(batch[text], batch["spans"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == text else batch[k] for k in names], names=names)

    out = cut.mapInArrow(run, held.df.schema)
    if held.has("n_chars"):
        n: Column = F.length(text).cast(docs.schema.fields[held.index("n_chars")].dataType)
        out = out.withColumn(held.at("n_chars"), n)
    return held.back(out)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document of `documents` without repeated 200-byte strings.

    A null text is empty: no bytes, nothing removed, the digest of nothing.  See `repeated_spans`.
    """
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = removals(docs, with_bytes=False).select("id", "rk", "n_removed", "n_spans", "kept_sha256")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    plain = docs.select(F.col("doc_id").alias("id"), row_key("text").alias("rk"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"))
    return plain.join(found, same_row(plain, found), "left").select(
        plain["id"].alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )
