"""Quality classifier: supervised subword embeddings.

A document's features are its words, its word bigrams and the character 2- to 4-grams of its words,
hashed into buckets.  Each bucket has a learned vector, a document is the average of its
features' vectors, and a softmax over two classes reads it.  Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents.

As the output is linear in the average, a trained bucket acts through one number (the
difference of its two class scores); these `buckets` numbers are what scoring sends to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import Workspace, batch_of, fold, map_texts, pick, table
from .langid import bounded_sample, word_grams

#: Bounds of the fit: labelled documents and bytes of their texts; their features are what the driver gets.
MAX_DOCS, MAX_BYTES, BUCKETS, DIMS, EPOCHS, RATE, ORDERS = 2_000, 16 << 20, 1 << 18, 16, 8, 4.0, (2, 3, 4)


@dataclass
class Features:
    """Features of a chunk's distinct words (CSR), the distinct word of each word, n-grams of words and their documents."""

    bucket: np.ndarray
    first: np.ndarray
    word: np.ndarray
    words: tk.Words
    ngram: np.ndarray
    ngram_doc: np.ndarray


def features(chunk: tk.Chunk, buckets: int) -> Features:
    data, w = tk.words(chunk, "nonspace", lower=False)
    _, one, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    parts, owner = [w.hash[one]], [np.arange(len(one))]
    for k in ORDERS:
        g, which = word_grams(data, w.start[one], w.end[one], k)
        parts.append(g)
        owner.append(which)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    to = lambda h: (h % np.uint64(buckets)).astype(np.int64)
    next_ = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    ngram = to(bigram_hashes(w.hash[next_], w.hash[next_ + 1]))
    return Features(to(np.concatenate(parts)[order]), np.searchsorted(owner[order], np.arange(len(one) + 1)), inverse, w, ngram, w.doc[next_])


def bigram_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return tk.mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


_BAGS = pa.schema([("label", pa.int32()), ("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))])


def _bags(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in tk.chunks(batch["text"]):
                f = features(c, buckets)
                ngrams = np.searchsorted(f.ngram_doc, np.arange(len(c) + 1))
                ids, counts = [], []
                for d in range(len(c)):
                    word, n = np.unique(f.word[f.words.first[d] : f.words.first[d + 1]], return_counts=True)
                    m = f.first[word + 1] - f.first[word]
                    flat = np.concatenate([f.bucket[tk.ranges(f.first[word], m)], f.ngram[ngrams[d] : ngrams[d + 1]]])
                    b, back = np.unique(flat, return_inverse=True)
                    k = np.bincount(back, weights=np.concatenate([np.repeat(n, m), np.ones(ngrams[d + 1] - ngrams[d])]), minlength=len(b))
                    ids.append(b.astype(np.int32))
                    counts.append(k.astype(np.float32))
                yield batch_of(_BAGS, label=batch["label"].slice(c.lo, len(c)), bucket=ids, n=counts)

    return run


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1; a text without words has the prior's.  A long text in parts scores as it would whole."""
        out = [np.zeros(0)]
        for c in tk.chunks(texts):
            total, n, last = np.zeros(len(c)), np.zeros(len(c)), None
            for part in tk.pieces(c, "nonspace"):
                f = features(part, len(self.weights))
                if last is not None and len(f.words):  # the bigram that a part's end cuts
                    total += self.weights[int(bigram_hashes(last, f.words.hash[:1])[0] % np.uint64(len(self.weights)))]
                    n += 1
                last = f.words.hash[-1:] if len(f.words) else last
                sums = np.concatenate([[0.0], np.cumsum(self.weights[f.bucket])])
                per_word = sums[f.first[1:]] - sums[f.first[:-1]]
                total += tk.sum_by(f.words.doc, per_word[f.word], len(c)) + tk.sum_by(f.ngram_doc, self.weights[f.ngram], len(c))
                n += tk.sum_by(f.words.doc, np.diff(f.first)[f.word], len(c)) + np.bincount(f.ngram_doc, minlength=len(c))
            out.append(1 / (1 + np.exp(-(self.bias + total / np.maximum(n, 1)))))
        return np.concatenate(out)


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], buckets: int = BUCKETS, dims: int = DIMS, epochs: int = EPOCHS, rate: float = RATE, batch: int = 16, seed: int = 5) -> QualityModel:
    """Stochastic gradient descent on (label, buckets, counts); no documents give a score of 0.5."""
    rng = np.random.Generator(np.random.PCG64(seed))
    e = (rng.random((buckets, dims), dtype=np.float32) - 0.5) / dims
    out = np.zeros((dims, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    bags = [(y, b, n / n.sum()) for y, b, n in bags if len(b)]
    steps, done = max(1, epochs * (len(bags) // batch + 1)), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(bags), batch):
            rows = [bags[i] for i in order[lo : lo + batch]]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            flat = np.concatenate([b for _, b, _ in rows])
            share = np.concatenate([n for _, _, n in rows])
            cut = np.cumsum([0, *(len(b) for _, b, _ in rows)])
            mean = np.add.reduceat(e[flat] * share[:, None], cut[:-1], axis=0)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = -p
            g[np.arange(len(rows)), [y for y, _, _ in rows]] += 1
            back = g @ out.T
            out += lr / len(rows) * (mean.T @ g)
            bias += lr / len(rows) * np.float32(0.1) * g.sum(axis=0)
            for (_, b, n), step in zip(rows, lr * back, strict=True):  # a document has each bucket once
                e[b] += n[:, None] * step
    return QualityModel((e @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, buckets: int = BUCKETS) -> QualityModel:
    """docs (doc_id, text) and labels (doc_id, label) -> model.

    Null texts, ids and labels, and ids with two labels, teach nothing; repeated rows teach twice.
    """
    with Workspace(docs.sparkSession, "quality"):
        rows = bounded_sample(labelled(docs, labels, label), max_docs, max_bytes)
        got = rows.select("label", "text").mapInArrow(_bags(buckets), "label int, bucket array<int>, n array<float>").toArrow()
    bags = []
    for chunk in got.to_batches():
        bags += [(y, np.asarray(b.values), np.asarray(n.values)) for y, b, n in zip(chunk["label"].to_pylist(), chunk["bucket"], chunk["n"], strict=True)]
    bags.sort(key=lambda x: (x[0], len(x[1]), float(x[2].sum()), x[1].tobytes()))
    return fit(bags, buckets)


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, size, label) of documents with one known label of 0 or 1."""
    known = pick(labels, "doc_id", label).toDF("doc_id", "label").where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    # Sizes are taken below the join, so summing them does not send the texts through its shuffle.
    return pick(docs, "doc_id", "text").where("text is not null").withColumn("size", F.octet_length("text")).join(known, "doc_id")


def add_scores(docs: DataFrame, model: object, drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` (text, ...) less the columns `drop`, with `score`; `model` has score(texts).  Written to the shared folder.

    A column `score` (in any case) that is there already is replaced; all others stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    with Workspace(docs.sparkSession, "scores"):
        scored = map_texts(docs, lambda texts: [pa.array(held.value.score(texts), pa.float64())], [T.StructField("score", T.DoubleType())], drop)
        return scored.checkpoint()


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels outside the held-out fold.

    Null and empty texts have no features and get the prior's score; very long ones are scored
    whole; equal texts have equal scores, and each of repeated rows its row; no labels give 0.5;
    an empty table gives none.  A null id is in no fold: neither held out nor learnt from.
    """
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = train(docs.where(fold("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    scored = add_scores(docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text"), model, drop=("text",))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
