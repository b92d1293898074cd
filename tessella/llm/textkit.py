"""Vectorised text primitives on UTF-8 bytes: chunks of documents, words, keys and hashes.

Everything works on whole documents.  A batch is cut into chunks of a bounded number of bytes
between documents, so memory does not depend on the batch; a document longer than the bound
forms a chunk of its own.

A word is known by a 16-byte key: its bytes and length where it has at most 15, else 15 bytes of
a BLAKE2b digest.  Short words are thus told apart by their bytes and long ones by a strong
digest; the 64-bit hash of a word is a mix of its key and serves for search only, wherever a
match decides about a document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Bytes of one long text that are cut into words at a time.
PIECE_BYTES = 4 << 20
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _table(word: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    if word == "nonspace":  # [^\x20\x09-\x0D]+
        out[:] = True
        out[[0x20, *range(0x09, 0x0E)]] = False
    elif word == "alnum":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
        out[0x30:0x3A] = out[0x61:0x7B] = out[0x80:] = True
    elif word == "letters":  # runs of ASCII letters and of everything beyond ASCII
        out[0x61:0x7B] = out[0x80:] = True
    else:
        raise ValueError(word)
    return out


WORD = {k: _table(k) for k in ("nonspace", "alnum", "letters")}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of `data`, which goes on for eight bytes beyond the last place."""
    rows = np.lib.stride_tricks.sliding_window_view(data, 8)
    return rows[at].view("<u8").ravel()


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 16) -> np.ndarray:
    """BLAKE2b digests of byte spans, a row of `size` bytes each."""
    body = memoryview(np.ascontiguousarray(data))
    out = b"".join(blake2b(body[a:b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(out, dtype=np.uint8).reshape(-1, size)


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each span: equal if, and only if, bytes (from 16 on: digests) are equal."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    first = _eight(data, starts) & _LOW[np.minimum(n, 8)]
    more = np.flatnonzero(n > 8)
    second = np.zeros(len(n), dtype=np.uint64)
    second[more] = _eight(data, starts[more] + 8) & _LOW[np.minimum(n[more] - 8, 7)]
    second |= np.minimum(n, 16).astype(np.uint64) << np.uint64(56)
    long_ = np.flatnonzero(n > 15)
    if len(long_):
        d = digests(data, starts[long_], ends[long_])
        d = d.copy()
        d[:, 15] = 16
        d = d.view("<u8")
        first[long_], second[long_] = d[:, 0], d[:, 1]
    return first, second


def key_hash(k1: np.ndarray, k2: np.ndarray, seed: int = 0) -> np.ndarray:
    return mix(mix(k1 + _ODD[seed]) ^ (k2 * _ODD[(seed + 1) % 3]))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes, equal hash."""
    return key_hash(*span_keys(data, starts, ends))


@dataclass
class Chunk:
    """Documents lo..hi of a batch as one byte array; document i is data[start[i]:end[i]]."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def trim() -> None:
    """Give the C library's free memory back, where it can."""
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run`, after which a worker that waits for its next task gives freed memory back to the machine."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()
            trim()

    return wrapped


def chunks(texts: pa.Array, max_bytes: int | None = None, separate: bool = True, prepare: Callable[[pa.Array], pa.Array] | None = None, rows: int = 512) -> Iterator[Chunk]:
    """Cut a string array into chunks; null counts as empty.  With `separate` a newline follows each text.

    Rows are prepared and copied a few hundred at a time, whatever the size of the batch.
    """
    max_bytes = max_bytes or CHUNK_BYTES
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for base in range(0, len(texts), rows):
        part = texts.slice(base, rows)
        for c in _chunks(prepare(part) if prepare else part, max_bytes, separate):
            c.lo, c.hi = c.lo + base, c.hi + base
            yield c


def _chunks(texts: pa.Array, max_bytes: int, separate: bool) -> Iterator[Chunk]:
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes + 1)])
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(total, total[lo] + max_bytes, side="right")) - 1))
        part = texts.slice(lo, hi - lo)
        n = sizes[lo:hi]
        if separate:
            part = pc.binary_join_element_wise(part, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        _, offsets, body = part.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[part.offset : part.offset + hi - lo + 1]
        whole = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
        start = off[:-1] - off[0]
        yield Chunk(lo, hi, whole[off[0] : off[-1]], start, start + n)
        lo = hi


@dataclass
class Words:
    """Words of a chunk in text order: byte spans, key and hash, and the (chunk-relative) document of each."""

    start: np.ndarray
    end: np.ndarray
    k1: np.ndarray
    k2: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # index of the first word of each document, one entry more than documents

    def __len__(self) -> int:
        return len(self.start)


def words(chunk: Chunk, kind: str, lower: bool = True) -> tuple[np.ndarray, Words]:
    """Words of a chunk made with `separate`; also the (lower-cased) bytes."""
    data = LOWER[chunk.data] if lower else chunk.data
    edge = np.zeros(len(data) + 2, dtype=np.int8)
    edge[1:-1] = WORD[kind][data]
    step = np.flatnonzero(np.diff(edge))
    start, end = step[::2], step[1::2]
    first = np.searchsorted(start, np.append(chunk.start, len(data)))
    doc = np.repeat(np.arange(len(chunk)), np.diff(first))
    k1, k2 = span_keys(data, start, end)
    return data, Words(start, end, k1, k2, key_hash(k1, k2), doc, first)


def pieces(chunk: Chunk, kind: str) -> Iterator[Chunk]:
    """A chunk of documents as it is; a single long document in parts that end between words."""
    if len(chunk) > 1 or len(chunk.data) <= PIECE_BYTES:
        yield chunk
        return
    size, at = len(chunk.data), 0
    table = WORD[kind][LOWER]
    while at < size:
        to = min(at + PIECE_BYTES, size)
        while to < size and table[chunk.data[to - 1]]:  # on to the end of the word, however long
            stop = np.flatnonzero(~table[chunk.data[to : to + PIECE_BYTES]])
            to = min(to + (int(stop[0]) + 1 if len(stop) else PIECE_BYTES), size)
        yield Chunk(chunk.lo, chunk.hi, chunk.data[at:to], np.array([0]), np.array([to - at]))
        at = to


def numbers(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each key from 0 on, equal only for equal keys; and how many there are."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(a), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out, int(new.sum())


def lookup(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in sorted_keys, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.searchsorted(sorted_keys, values)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == values, at, -1)


class Places:
    """`lookup` of many values in one array of sorted hashes, by a table of where their leading bits begin."""

    def __init__(self, sorted_keys: np.ndarray):
        self.keys = sorted_keys
        bits = len(sorted_keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(sorted_keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        bucket = (values >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, values = at[left], end[left], values[left]
        while len(left):
            hit = self.keys[at] == values
            out[left[hit]] = at[hit]
            on = np.flatnonzero(~hit & (at + 1 < end))
            left, at, end, values = left[on], at[on] + 1, end[on], values[on]
        return out


def sum_by(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)[:n]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), then those of first[1], and so on."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def text_hashes(texts: list[str]) -> np.ndarray:
    """Hashes of whole strings, as `span_hashes` gives them."""
    body = [t.encode("utf-8", "surrogatepass") for t in texts]
    end = np.cumsum([len(b) for b in body])
    return span_hashes(np.frombuffer(b"".join(body), np.uint8), end - np.array([len(b) for b in body]), end)
