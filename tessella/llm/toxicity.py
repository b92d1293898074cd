"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme-value theory.

A token's features are the word and its prefixes of 4 to 7 characters.  Log-odds of toxic
against other documents have a Dirichlet prior (a flat part and one in proportion to the
feature's share of both), and only features whose log-odds are `z` standard deviations above
zero count; a token takes the largest of its features, and every other token costs `drift`.

A linear scan finds all maximal scoring segments of a document (each would lose by being made
longer or shorter).  For a background with these scores, lambda solves sum p exp(lambda s) = 1;
n exp(-lambda S) of a segment is then the number of segments as good that chance leaves in a
document of n tokens.  Significant segments are those for which it is small; a document's
score is a logistic function of its best and of its summed significance.

The log-odds and the calibration are fitted on a bounded sample of labelled documents (`max_docs`
of them and 64 MB of text): one half of it gives the log-odds by which the other half is
calibrated.  All features of the sample with significant log-odds are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import Workspace, batch_of, fold, pick, table
from .langid import bounded_sample, folded
from .quality import add_scores, labelled

MAX_DOCS, PREFIXES = 20_000, (4, 5, 6, 7)
FLAT, PRIOR, Z, DRIFT, EXPECT = 0.5, 100.0, 3.3, 0.15, 0.05


def prefix_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first n characters of each word that has more than n, and which words those are."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    chars = lead[end] - lead[start]
    which = np.flatnonzero(chars > n)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cut = at[lead[start[which]] + n]
    return tk.mix(tk.span_hashes(data, start[which], cut) + np.uint64(n)), which


def token_features(chunk: tk.Chunk) -> tuple[tk.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a lower-cased chunk; features of its distinct words with their word; the distinct word of each."""
    data, w = tk.words(chunk, "letters", lower=False)
    _, one, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    order = np.argsort(w.start[one])
    rank = np.empty(len(one), dtype=np.int64)
    rank[order] = np.arange(len(one))
    one, inverse = one[order], rank[inverse]
    hashes, owner = [w.hash[one]], [np.arange(len(one))]
    for n in PREFIXES:
        h, which = prefix_hashes(data, w.start[one], w.end[one], n)
        hashes.append(h)
        owner.append(which)
    return w, np.concatenate(hashes), np.concatenate(owner), inverse


_COUNTS = pa.schema([("hash", pa.int64()), ("t0", pa.int64()), ("c0", pa.int64()), ("t1", pa.int64()), ("c1", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each feature, by half of the sample and label."""
    for batch in batches:
        group = batch["half"].to_numpy(zero_copy_only=False) * 2 + (1 - batch["label"].to_numpy(zero_copy_only=False))
        for c in tk.chunks(batch["text"], prepare=folded):
            w, h, owner, inverse = token_features(c)
            keys, key = np.unique(h, return_inverse=True)
            order = np.argsort(owner, kind="stable")
            first = np.searchsorted(owner[order], np.arange(inverse.max() + 2 if len(inverse) else 1))
            pairs = np.unique(w.doc * (inverse.max() + 1 if len(inverse) else 1) + inverse)
            doc, word = np.divmod(pairs, inverse.max() + 1 if len(inverse) else 1)
            m = first[word + 1] - first[word] if len(word) else word
            flat = key[order][np.arange(m.sum()) + np.repeat(first[word] - (np.cumsum(m) - m), m)] if len(word) else word
            seen = np.unique(np.repeat(doc, m) * max(len(keys), 1) + flat)
            doc, flat = np.divmod(seen, max(len(keys), 1))
            n = np.bincount(flat * 4 + group[c.lo : c.hi][doc].astype(np.int64), minlength=4 * len(keys)).reshape(-1, 4)
            yield batch_of(_COUNTS, hash=keys.view(np.int64), t0=n[:, 0], c0=n[:, 1], t1=n[:, 2], c1=n[:, 3])


@dataclass
class Segments:
    """Maximal scoring segments of a document: word numbers [lo, hi), and their scores."""

    lo: list[int]
    hi: list[int]
    score: list[float]


def maximal_segments(pos: list[int], gain: list[float], drift: float) -> Segments:
    """All maximal scoring segments where word pos[i] gains gain[i] and every other word costs drift.

    One pass with a stack: a new gain joins the nearest earlier segment that starts lower and
    ends lower than it does, with all between.  Each segment knows the nearest one before it that
    starts lower, so the search goes from link to link and the whole scan is linear.
    """
    lo: list[int] = []
    hi: list[int] = []
    left: list[float] = []  # cumulative score before the segment
    right: list[float] = []  # and at its end
    lower: list[int] = []  # nearest earlier segment that starts lower, or -1
    total, last = 0.0, -1
    for p, g in zip(pos, gain, strict=True):
        total -= drift * (p - last - 1)
        a, l = p, total
        total += g
        r, last = total, p
        j = len(lo) - 1
        while True:
            while j >= 0 and left[j] >= l:
                j = lower[j]
            if j < 0 or right[j] >= r:
                break
            a, l = lo[j], left[j]
            del lo[j:], hi[j:], left[j:], right[j:]
            j = lower[j]
            del lower[len(lo) :]
        lo.append(a)
        hi.append(p + 1)
        left.append(l)
        right.append(r)
        lower.append(j)
    return Segments(lo, hi, [r - l for l, r in zip(left, right, strict=True)])


def karlin_lambda(score: np.ndarray, share: np.ndarray) -> float:
    """Positive root of sum share*exp(lambda*score) = 1 for scores of negative mean, by bisection."""
    if not len(score) or not (score > 0).any() or (score * share).sum() >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    f = lambda x: (share * np.exp(np.minimum(x * score, 700))).sum() - 1
    while f(hi) < 0:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


@dataclass
class ToxicityModel:
    keys: np.ndarray
    odds: np.ndarray
    lam: float
    drift: float
    weights: np.ndarray  # bias, best, sum

    def token_scores(self, chunk: tk.Chunk) -> tuple[tk.Words, np.ndarray]:
        w, h, owner, inverse = token_features(chunk)
        at = tk.lookup(self.keys, h)
        some = at >= 0
        best = np.zeros(owner.max() + 1 if len(owner) else 0)
        np.maximum.at(best, owner[some], self.odds[at[some]])
        return w, best[inverse]

    def segments(self, texts: pa.Array) -> Iterator[tuple[int, Segments]]:
        """(number of words, maximal segments) of each text, in order."""
        for c in tk.chunks(texts, prepare=folded):
            w, s = self.token_scores(c)
            hit = np.flatnonzero(s > 0)
            cut = np.searchsorted(w.doc[hit], np.arange(len(c) + 1))
            pos, gain = (hit - w.first[w.doc[hit]]).tolist(), s[hit].tolist()
            for d in range(len(c)):
                yield int(w.first[d + 1] - w.first[d]), maximal_segments(pos[cut[d] : cut[d + 1]], gain[cut[d] : cut[d + 1]], self.drift)

    def evidence(self, n: int, seg: Segments) -> tuple[float, float]:
        """-ln of the chance count of the best segment, and the sum over significant segments; 0 is none."""
        if not seg.score:
            return 0.0, 0.0
        e = [self.lam * s - np.log(max(n, 1)) for s in seg.score]
        return max(0.0, max(e)), sum(x for x in e if x > -np.log(EXPECT))

    def score(self, texts: pa.Array) -> np.ndarray:
        x = np.array([[1.0, *self.evidence(n, s)] for n, s in self.segments(texts)]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def _odds(t: np.ndarray, c: np.ndarray, nt: float, nc: float) -> tuple[np.ndarray, np.ndarray]:
    share = (t + c) / max(nt + nc, 1)
    a = FLAT + PRIOR * share
    whole = PRIOR + 2 * FLAT
    d = np.log((t + a) / (nt + whole - t - a + 1)) - np.log((c + a) / (nc + whole - c - a + 1))
    return d, d / np.sqrt(1 / (t + a) + 1 / (c + a))


def _fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Newton steps with a small ridge; without both classes the prior alone."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = -2.0
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_docs: int = MAX_DOCS) -> ToxicityModel:
    """docs (doc_id, text) and labels (doc_id, label) -> model.  No labels give a model without features.

    Null texts, ids and labels and ids with two labels teach nothing; repeated rows teach twice.
    """
    spark = docs.sparkSession
    with Workspace(spark, "toxicity") as ws:
        rows = bounded_sample(labelled(docs, labels, label), max_docs)
        rows = ws.save(rows.select("text", "label", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")), "sample")
        per = {(r["half"], r["label"]): r["n"] for r in rows.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts = rows.mapInArrow(_count, "hash long, t0 long, c0 long, t1 long, c1 long").groupBy("hash").agg(*[F.sum(k).alias(k) for k in ("t0", "c0", "t1", "c1")])
        n = lambda half, y: float(per.get((half, y), 0))
        first, both = (n(0, 1), n(0, 0)), (n(0, 1) + n(1, 1), n(0, 0) + n(1, 0))

        def significant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t0, c0, t1, c1 = (batch[k].to_numpy().astype(float) for k in ("t0", "c0", "t1", "c1"))
                keep = np.zeros(batch.num_rows, dtype=bool)
                for t, c, of in ((t0, c0, first), (t0 + t1, c0 + c1, both)):
                    d, z = _odds(t, c, *of)
                    keep |= (z >= Z) & (d > 0)
                yield batch.filter(pa.array(keep))

        top = counts.mapInArrow(significant, counts.schema).toArrow()
        h = top["hash"].to_numpy().view(np.uint64)
        t0, c0, t1, c1 = (top[k].to_numpy().astype(float) for k in ("t0", "c0", "t1", "c1"))
        trial = _select(h, t0, c0, *first)
        trial.lam = _background(rows.where("half = 1"), trial)
        xy = _measure(rows.where("half = 1"), trial)
        final = _select(h, t0 + t1, c0 + c1, *both)
        final.lam, final.weights = trial.lam, _fit_logistic(xy[:, :3], xy[:, 3])
        return final


def _select(h: np.ndarray, t: np.ndarray, c: np.ndarray, nt: float, nc: float) -> ToxicityModel:
    d, z = _odds(t, c, nt, nc)
    keep = (z >= Z) & (d > 0)
    order = np.argsort(h[keep])
    return ToxicityModel(h[keep][order], d[keep][order], 1.0, DRIFT, np.array([-2.0, 0.0, 0.0]))


def _background(rows: DataFrame, model: ToxicityModel) -> float:
    """lambda of the token scores of documents that are not toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"], prepare=folded):
                s, n = np.unique(np.round(model.token_scores(c)[1], 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64()), pa.array(n, pa.int64())], names=["s", "n"])

    got = rows.where("label = 0").select("text").mapInArrow(run, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toArrow()
    s, n = got["s"].to_numpy(), got["n"].to_numpy().astype(float)
    return karlin_lambda(np.where(s > 0, s, -model.drift), n / n.sum()) if len(s) else 1.0


def _measure(rows: DataFrame, model: ToxicityModel) -> np.ndarray:
    """(1, best, sum, label) of each document of the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([model.evidence(n, s) for n, s in model.segments(batch["text"])]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch["label"]], names=["best", "sum", "label"])

    got = rows.select("text", "label").mapInArrow(run, "best double, sum double, label int").toArrow()
    return np.stack([np.ones(got.num_rows), *(got[k].to_numpy().astype(float) for k in ("best", "sum", "label"))], axis=1)


def passages(docs: DataFrame, model: ToxicityModel, expect: float = EXPECT) -> DataFrame:
    """doc_id and every significant toxic passage of it: word numbers [lo, hi), score, chance count.

    Null and empty texts have none; each of repeated rows has its own.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, (n, seg) in zip(batch["doc_id"].to_pylist(), held.value.segments(batch["text"]), strict=True):
                for lo, hi, s in zip(seg.lo, seg.hi, seg.score, strict=True):
                    chance = float(n * np.exp(-held.value.lam * s))
                    if chance <= expect:
                        out.append((doc, lo, hi, s, chance))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "lo", "hi", "score", "chance"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lo int, hi int, score double, chance double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels outside the held-out fold.

    Null and empty texts have the score of a text without a toxic passage; very long ones are
    scored whole; equal texts have equal scores, and each of repeated rows its row; no labels
    give the prior alone; an empty table gives none.  A null id is in no fold: neither held out nor
    learnt from.
    """
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = train(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    scored = add_scores(docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text"), model, drop=("text",))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
