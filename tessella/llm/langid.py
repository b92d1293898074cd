"""Language identification by word-first backoff.

A known word scores its log relative frequency in each language.  An unseen word falls back to
its character 5-grams; where none of them is known, to its 4-grams, and so on to single
characters, each step down costing a constant factor.  A document's language has the largest
sum; the score is its posterior under equal priors, with the evidence tempered by the number
of words.

The model is fitted on a bounded sample of labelled documents: about `max_docs` of them, and 32 MB
of text, by a hash of the id.  All words and n-grams of the sample are in it; what is sent to
every task is bounded by the sample.  Scoring reads whole texts in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import Columns, Workspace, batch_of, fold, map_texts, pick, table

MAX_DOCS, MAX_BYTES, ORDER, BACKOFF = 5_000, 32 << 20, 5, 0.4
_LETTER = regex.compile(r"\p{L}")
_COUNTS = pa.schema([("order", pa.int32()), ("lang", pa.int32()), ("hash", pa.int64()), ("n", pa.int64())])


def folded(texts: pa.Array) -> pa.Array:
    """Lower-cased in full Unicode; null is empty."""
    return pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))


def word_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of ` word ` and the word of each; words too short have none."""
    body = end - start
    first = np.cumsum(body + 2) - body - 2
    flat = np.full((body + 2).sum(), 0x20, dtype=np.uint8)
    flat[tk.ranges(first + 1, body)] = data[tk.ranges(start, body)]
    at = np.flatnonzero((flat & 0xC0) != 0x80)  # where characters begin; a word's first is its space
    lead = np.searchsorted(at, first)
    count = np.maximum(np.diff(np.append(lead, len(at))) - n + 1, 0)
    which, c = np.repeat(np.arange(len(start)), count), tk.ranges(lead, count)
    stop = np.append(at, len(flat))
    return tk.mix(tk.span_hashes(flat, at[c], stop[c + n]) + np.uint64(n)), which


def _distinct_words(data: np.ndarray, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Index of one occurrence of each distinct word, and each word's distinct number."""
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    return first, inverse


def _count(orders: int, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = pc.index_in(batch["lang"], pa.array(langs)).to_numpy(zero_copy_only=False)
            for c in tk.chunks(batch["text"], prepare=folded):
                data, w = tk.words(c, "letters", lower=False)
                lang = code[c.lo : c.hi][w.doc].astype(np.int64)
                one, inverse = _distinct_words(data, w)
                pairs, n = np.unique(inverse * len(langs) + lang, return_counts=True)
                word, lang = np.divmod(pairs, len(langs))
                yield _emit(0, lang, w.hash[one[word]], n)
                for k in range(1, orders + 1):
                    h, which = word_grams(data, w.start[one], w.end[one], k)
                    lo, hi = np.searchsorted(which, word), np.searchsorted(which, word, side="right")
                    row = np.repeat(np.arange(len(word)), hi - lo)
                    grams, back = np.unique(h[tk.ranges(lo, hi - lo)], return_inverse=True)
                    keys, again = np.unique(back * len(langs) + lang[row], return_inverse=True)
                    yield _emit(k, keys % len(langs), grams[keys // len(langs)], np.bincount(again, weights=n[row], minlength=len(keys)).astype(np.int64))

    return run


def _emit(order: int, lang: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return batch_of(_COUNTS, order=np.full(len(h), order, dtype=np.int32), lang=lang.astype(np.int32), hash=h.view(np.int64), n=n)


@dataclass
class LanguageModel:
    """keys[o] sorted hashes, logs[o] (keys, languages) log10 relative frequencies; order 0 is words."""

    langs: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    floor: np.ndarray

    def word_scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.tile(self.floor, (len(h), 1))
        at = tk.lookup(self.keys[0], h)
        out[at >= 0] = self.logs[0][at[at >= 0]]
        todo = np.flatnonzero(at < 0)
        cost = 0.0
        for k in range(len(self.keys) - 1, 0, -1):
            if not len(todo):
                break
            cost += np.log10(BACKOFF)
            g, which = word_grams(data, start[todo], end[todo], k)
            at = tk.lookup(self.keys[k], g)
            some = at >= 0
            n = np.bincount(which[some], minlength=len(todo))
            known = n > 0
            sums = np.stack([np.bincount(which[some], weights=self.logs[k][at[some], i], minlength=len(todo)) for i in range(len(self.langs))], axis=1)
            out[todo[known]] = sums[known] / n[known, None] + cost
            todo = todo[~known]
        return out

    def score(self, texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
        """Predicted language and posterior of each text."""
        pred: list[str | None] = []
        scores = []
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        for c in tk.chunks(texts, prepare=folded):
            total, n = np.zeros((len(c), len(self.langs))), np.zeros(len(c), dtype=np.int64)
            letter = np.zeros(len(c), dtype=bool)
            for part in tk.pieces(c, "letters"):
                data, w = tk.words(part, "letters", lower=False)
                one, inverse = _distinct_words(data, w)
                table_ = self.word_scores(data, w.start[one], w.end[one], w.hash[one])
                for i in range(len(self.langs)):
                    total[:, i] += tk.sum_by(w.doc, table_[inverse, i], len(c))
                n += np.diff(w.first)
                plain = np.concatenate([[0], np.cumsum((data >= 0x61) & (data <= 0x7A))])
                letter |= plain[part.end] > plain[part.start]
            for i in np.flatnonzero((n > 0) & ~letter):
                letter[i] = bool(_LETTER.search(texts[c.lo + int(i)].as_py()))
            n = np.maximum(n, 1)
            z = (total - total.max(axis=1, keepdims=True)) * np.log(10) / np.sqrt(n)[:, None]
            p = np.exp(z)
            p = p.max(axis=1) / p.sum(axis=1)
            best = total.argmax(axis=1)
            pred += [self.langs[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
            scores.append(np.where(letter, p, 0.0))
        return pred, np.concatenate([*scores, np.zeros(0)])


def bounded_sample(docs: DataFrame, max_docs: int, max_bytes: int = 64 << 20, salt: int = 17) -> DataFrame:
    """About max_docs rows (doc_id, text, size, ...) of about max_bytes together, chosen by a hash of doc_id: the same whatever the partitions.

    Texts of over a sixteenth of max_bytes teach nothing, so that no single one can exceed the bound.
    """
    docs = docs.where(F.col("size") <= max_bytes // 16)
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    part = min(max_docs / max(n, 1), max_bytes / max(size, 1))
    if part >= 1:
        return docs
    return docs.where(F.xxhash64("doc_id", F.lit(salt)).bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(int((1 << 62) * part) * 2))


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, order: int = ORDER) -> LanguageModel:
    """(doc_id, text, lang) -> model.  Rows with null text or language teach nothing; repeated rows teach twice."""
    labelled = pick(docs, "doc_id", "text", "lang").where("lang is not null and text is not null").withColumn("size", F.octet_length("text"))
    with Workspace(docs.sparkSession, "langid") as ws:
        rows = ws.save(bounded_sample(labelled, max_docs, max_bytes), "sample")
        langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
        counts = rows.select("text", "lang").mapInArrow(_count(order, langs), "order int, lang int, hash long, n long").groupBy("order", "lang", "hash").agg(F.sum("n").alias("n"))
        per = ws.save(counts.groupBy("order", "hash").agg(F.collect_list(F.struct("lang", "n")).alias("by")), "counts")
        found = [per.where(F.col("order") == k).select("hash", "by").toArrow() for k in range(order + 1)]
    keys, logs = [], []
    for t in found:
        h = t["hash"].to_numpy().view(np.uint64)
        by = t["by"].combine_chunks()
        flat = by.flatten()
        which = np.repeat(np.arange(len(h)), np.diff(np.asarray(by.offsets)))
        lang = flat.field("lang").to_numpy(zero_copy_only=False)
        m = np.full((len(h), len(langs)), 0.5)
        m[which, lang] += flat.field("n").to_numpy(zero_copy_only=False)
        sort = np.argsort(h)
        keys.append(h[sort])
        logs.append(np.log10(m / np.maximum(m.sum(axis=0), 1e-9))[sort].astype(np.float32))
    floor = np.full(len(langs), -7.0)
    return LanguageModel(langs, keys, logs, floor)


_ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def identify(docs: DataFrame, model: LanguageModel, drop: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """`docs` (text, ...) with lang_pred and score (0 to 1) added.

    `und` with score 0: null or empty texts, texts without a letter, and all texts of a model
    that saw no labelled document.  Of languages that score alike the first by name is taken.
    Very long texts are scored whole; repeated rows alike.  An empty table stays empty.  Columns
    of these names (in any case) that are there already are replaced; all others stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> list[pa.Array]:
        pred, score = held.value.score(texts)
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

    return map_texts(docs, predict, _ADDED, drop, text)


def train_rows(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text", "lang").where(fold("doc_id", 4) != 2)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` in a recognised language: not `und`, and of a posterior of at least `least`.

    All columns stay as they are, whatever their names.  See `identify` for the other cases.
    """
    held = Columns(docs)
    model = train(train_rows(docs))
    return held.back(identify(held.df, model, text=held.at("text")).where((F.col("lang_pred") != "und") & (F.col("score") >= least)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those outside the held-out fold.

    A null id is in no fold: neither held out nor learnt from.  For null, empty, long and repeated
    texts, ties and empty tables see `identify`.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(train_rows(docs))
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    with Workspace(spark, "language"):
        return identify(rows, model, drop=("text",)).checkpoint()
