from __future__ import annotations

import gzip
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import brown, embeddings, langid, minhash, mixing, phrases, quality, registry, suffixes, toxicity, warc
from tessella.llm import textkit as tk
from tessella.llm.common import Workspace

from ..oracle import compare
from . import brute

EDGE = [None, "", " \n ", "one", "one two three four", "ünï cödé " * 3, "\x00 ctrl", "A" * 5000, "same text here to repeat", "same text here to repeat"]


def vocab(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    compare(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)


# ------------------------------------------------------------------ near duplicates


def near_texts():
    rng = random.Random(3)
    v = vocab(rng)
    texts = list(EDGE)
    for _ in range(6):
        base = [rng.choice(v) for _ in range(rng.randint(8, 120))]
        texts += [" ".join(base)] * 2
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(1, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(v)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
    return texts


@pytest.mark.parametrize("block_rows", [400, 3])
def test_minhash_is_the_exact_join(docs_of, block_rows):
    texts = near_texts()
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_of(texts), block_rows=block_rows).collect()}
    sets, comp = brute.near(dict(enumerate(texts)))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_minhash_null_ids_repeated_rows_and_empty_table(spark, docs_of):
    rows = minhash.near_duplicates(docs_of(["a b c d e f"] * 3, [None, 4, 4])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("4", "4", True), ("4", "4", True), ("None", "None", True)]
    assert minhash.near_duplicates(docs_of([])).count() == 0
    kept = minhash.deduplicate(docs_of(["a b c d e f", "a b c d e f", "x"]))
    assert {r.doc_id for r in kept.collect()} == {0, 2} and kept.columns[-2:] == ["score", "rk"]


def test_shingle_hashes_tell_sets_apart():
    import pyarrow as pa

    texts = ["a b c d e", "a b c d", "a b c d e f", "A  b\tc d E", "", "e d c b a"]
    (c,) = tk.chunks(pa.array(texts))
    h, _, first = minhash.shingle_sets(c)
    sets = [frozenset(h[first[i] : first[i + 1]].tolist()) for i in range(len(texts))]
    code, at = minhash.exact_sets(pa.array(texts))
    exact = [frozenset(code[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    assert [[len(x & y) for y in sets] for x in sets] == [[len(x & y) for y in exact] for x in exact]
    assert sets[0] == sets[3] and sets[0] < sets[2] and not sets[4] and len({sets[0], sets[1], sets[5]}) == 3


# ------------------------------------------------------------------ repeated substrings


@pytest.mark.parametrize(("hot_rows", "length"), [(1_000, 40), (2, 40), (0, 40)])
def test_suffixes_are_exact(docs_of, hot_rows, length):
    rng = random.Random(5)
    v = vocab(rng, 60)
    shared = [" ".join(rng.choice(v) for _ in range(30)) for _ in range(4)]
    texts = list(EDGE)
    for i in range(40):
        parts = [" ".join(rng.choice(v) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 20)
            parts += [s[a : rng.randint(a, len(s))], " ".join(rng.choice(v) for _ in range(rng.randint(0, 10)))]
        texts.append("é".join(parts) if i % 3 else "".join(parts))
    texts += ["ab" * 60, "x" * 100, "q" + "wertzu" * 30 + "end" + "wertzu" * 9, "abcabcab" * 20 + "x" + "abcabcab" * 7, "wertzu" * 12 + shared[0]]
    docs = docs_of(texts)
    found = {r.id: r for r in suffixes.removals(docs, length, q=8, hot_rows=hot_rows).collect()}
    want = brute.repeats([(t or "").encode() for t in texts], length)
    for i, (n, removed, spans, sha) in enumerate(want):
        if removed:
            r = found[i]
            assert (r.n_removed, r.n_spans, r.kept_sha256, len(r.kept)) == (removed, spans, sha, n - removed)
        else:
            assert i not in found
    cleaned = {r.doc_id: r for r in suffixes.remove_repeats(docs, length, q=8).collect()}
    assert len(cleaned) == len(texts) and cleaned[0].text is None and cleaned[0].score == "own"
    for i, (n, removed, _, _) in enumerate(want):
        assert len((cleaned[i].text or "").encode()) <= n - removed and (removed or cleaned[i].text == texts[i])


def test_suffixes_repeated_row_and_empty_table(docs_of):
    rows = suffixes.removals(docs_of(["q" + "wertzu" * 50] * 2, [1, 1]), 40).collect()
    assert [r.n_removed for r in rows] == [301] or [r.n_removed for r in rows] == [301, 301]
    assert suffixes.removals(docs_of([]), 40).count() == 0


def test_periodic_texts_are_few_runs(docs_of):
    """20 MB of periodic text: a row for each part and not for each byte, and all of it goes."""
    import pyarrow as pa

    for unit in ("a", "ab", "0123456789", "x" * 150 + "y"):
        (c,) = tk.chunks(pa.array([unit * (2_000_000 // len(unit))]))
        found = [suffixes.runs(p, 200, 32) for p, _ in suffixes._parts(c, 200)]
        assert sum(len(r[1]) for r in found) <= (6 + len(unit) // 40) * len(found)
    docs = docs_of(["a" * 8_000_000, "ab" * 4_000_000, "tail " + "0123456789" * 400_000 + " unlike", "a" * 199, "b" * 200])
    got = {r.id: (r.n_removed, r.n_spans) for r in suffixes.removals(docs, with_bytes=False).collect()}
    assert got == {0: (8_000_000, 1), 1: (8_000_000, 1), 2: (4_000_000, 1)}


def test_suffixes_at_the_contract_length(docs_of):
    rng = random.Random(12)
    v = vocab(rng, 3000)
    words = lambda n: " ".join(rng.choice(v) for _ in range(n))
    shared = [words(80) for _ in range(3)]
    texts = [*EDGE, *(words(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 150) :] + words(rng.randint(0, 60)) for _ in range(25)), "q" * 700, "é" * 150, shared[0], shared[0]]
    found = {r.id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removals(docs_of(texts)).collect()}
    want = brute.repeats([(t or "").encode() for t in texts], 200)
    assert found == {i: (removed, spans, sha) for i, (_, removed, spans, sha) in enumerate(want) if removed}


def test_refine_agrees_with_plain_equality():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    first = np.array([0, 150, 151, 400, 600])
    ids = suffixes.refine(data, first, 19)
    body = data.tobytes()
    for a, b in zip(first[:-1], first[1:], strict=True):
        for i in range(a, b):
            same = [j for x, y in zip(first[:-1], first[1:], strict=True) for j in range(x, y - 18) if i + 19 <= b and body[j : j + 19] == body[i : i + 19]]
            assert (len(same) > 1) == (ids[i] >= 0 and (ids == ids[i]).sum() > 1)


# ------------------------------------------------------------------ decontamination


def test_phrases_match_brute_force(spark, docs_of):
    rng = random.Random(9)
    v = vocab(rng, 30)
    items = {i: " ".join(rng.choice(v) for _ in range(rng.choice([1, 3, 12, 13, 14, 30]))) for i in range(12)} | {50: "", 51: None, 52: "!!"}
    texts = list(EDGE)
    for _ in range(30):
        w = [rng.choice(v) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            k = rng.randint(0, len(w))
            w[k:k] = (items[rng.randrange(12)] or "").split()
        texts.append(", ".join(w).upper())
    test = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute.contaminated(dict(enumerate(texts)), items)
    for block in (phrases.BLOCK_WORDS, 20):
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in phrases.contamination_report(docs_of(texts), test, block_words=block).collect()}
        assert got == want
    kept = {r.doc_id for r in phrases.decontaminate(docs_of(texts), test).collect()}
    assert kept == {i for i, x in want.items() if not x[3]}
    assert phrases.contamination_report(docs_of(texts), test.limit(0)).where("contaminated").count() == 0
    assert phrases.contamination_report(docs_of([]), test).count() == 0


def test_proximity_matches_equal_brute_force(spark, docs_of):
    rng = random.Random(12)
    v = vocab(rng, 12)
    items = {i: " ".join(rng.choice(v) for _ in range(rng.choice([1, 2, 3]))) for i in range(8)} | {50: "", 51: None}
    texts = [*EDGE, *(" ".join(rng.choice(v) for _ in range(rng.randint(0, 40))) for _ in range(30))]
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.low(t))
    docs, test = docs_of(texts), spark.createDataFrame(list(items.items()), "item_id long, text string")
    count = Counter(w for t in texts for w in word(t))
    got = {(r.doc_id, r.item_id, r["at"]) for r in phrases.proximity_matches(docs, test, span=4).collect()}
    want = set()
    for i, item in items.items():
        if not (terms := word(item)):
            continue
        rarest = min(range(len(terms)), key=lambda k: count[terms[k]])
        for d, t in enumerate(texts):
            w = word(t)
            want |= {(d, str(i), p) for p, x in enumerate(w) if x == terms[rarest] and set(terms) <= set(w[max(p - 4, 0) : p + 5])}
    assert {(d, i) for d, i, _ in got} and got == want
    assert phrases.proximity_matches(docs_of([]), test).count() == 0 and phrases.proximity_matches(docs, test.limit(0)).count() == 0


# ------------------------------------------------------------------ classifiers


def accuracy(df, spark, sf, column):
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    r = df.join(lab, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(column)).cast("double")), F.count(F.lit(1))).first()
    return r


def test_quality_and_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    assert accuracy(quality.op1_quality(spark, sf), spark, sf, "quality")[0] > 0.9
    assert accuracy(toxicity.op9_toxicity(spark, sf), spark, sf, "toxic")[0] > 0.85


def test_language_held_out_and_edges(spark, docs_of):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.op3_language_id(spark, sf).join(docs, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    model = langid.train(langid.train_rows(docs))
    assert model.score(__import__("pyarrow").array(EDGE + ["123 !!", "ДА нет"]))[0][:3] == ["und"] * 3
    assert model.score(__import__("pyarrow").array(["123 !!", None, "Ж"]))[0][:2] == ["und", "und"]
    empty = langid.train(docs_of([], []))
    assert empty.score(__import__("pyarrow").array(["abc"]))[0] == ["und"]
    kept = langid.keep_identified(docs.limit(50).withColumn("score", F.lit("own")))
    assert kept.columns == [*docs.columns, "score"] and kept.count() > 45


def test_word_backoff_prefers_known_words():
    import pyarrow as pa

    key = lambda *w: np.sort(tk.text_hashes(list(w)))
    words = key("haus", "house")
    logs = np.where((words == tk.text_hashes(["haus"])[0])[:, None], [[-1.0, -5.0]], [[-5.0, -1.0]])
    grams, _ = langid.word_grams(np.frombuffer(b"au", np.uint8), np.array([0]), np.array([2]), 2)
    m = langid.LanguageModel(["de", "en"], [words, np.zeros(0, np.uint64), np.sort(grams)], [logs, np.zeros((0, 2)), np.tile([[-1.0, -3.0]], (len(grams), 1))], np.full(2, -7.0))
    assert m.score(pa.array(["haus", "house", "au", "zzz"]))[0][:3] == ["de", "en", "de"]


def test_classifiers_without_labels_and_on_edge_texts(spark, docs_of):
    import pyarrow as pa

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    q = quality.train(docs_of(EDGE), none)
    assert np.allclose(q.score(pa.array(EDGE)), 0.5)
    t = toxicity.train(docs_of(EDGE), none)
    s = t.score(pa.array(EDGE))
    assert len(s) == len(EDGE) and ((s >= 0) & (s <= 1)).all()
    mixed = spark.createDataFrame([(0, None, None), (1, 1, 2), (3, 0, 1), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.doc_id for r in quality.labelled(docs_of(EDGE), mixed, "quality").collect()] == [1]
    assert [r.doc_id for r in quality.labelled(docs_of(EDGE), mixed, "toxic").collect()] == [3]


def maximal(x):
    """Maximal scoring subsequences by their definition: the best segment, then the same left and right of it (Ruzzo and Tompa)."""
    if not (x > 0).any():
        return []
    pre = np.concatenate([[0], np.cumsum(x)])
    best = max(pre[j] - pre[i] for i in range(len(x)) for j in range(i + 1, len(x) + 1))
    lo, hi = min(((i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if abs(pre[j] - pre[i] - best) < 1e-9), key=lambda s: s[1] - s[0])
    return [*maximal(x[:lo]), (lo, hi), *((a + hi, b + hi) for a, b in maximal(x[hi:]))]


def test_all_maximal_segments():
    rng = random.Random(1)
    for _ in range(200):
        # sums of different powers never tie
        x = np.array([rng.choice([3.0, 1.0, -1.0, -1.0, -1.0]) for _ in range(14)])
        x = np.where(x > 0, x + np.array([rng.random() for _ in x]), x)
        pos = [i for i, v in enumerate(x) if v > 0]
        seg = toxicity.maximal_segments(pos, [x[i] for i in pos], 1.0)
        assert list(zip(seg.lo, seg.hi, strict=True)) == maximal(x)
        assert all(abs(x[a:b].sum() - v) < 1e-9 for a, b, v in zip(seg.lo, seg.hi, seg.score, strict=True))


@pytest.mark.parametrize("gap", [1, 5, 40])
def test_segment_scan_is_linear(gap):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        toxicity.maximal_segments(list(range(0, n * gap, gap)), [1.0 + (i % 7) for i in range(n)], 0.15 * 4)
        took.append(time.perf_counter() - began)
    assert took[1] < 1 and took[1] < 12 * max(took[0], 0.005)


# ------------------------------------------------------------------ language model


def test_brown_base_scores_and_improvement(spark, docs_of):
    rng = random.Random(4)
    v = vocab(rng, 200)
    # two kinds of sentences that never mix: classes predict the next word
    texts = [*EDGE, *(" ".join(rng.choice(v[:100] if i % 2 else v[100:]) for _ in range(60)) for i in range(120))]
    docs = docs_of(texts).select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).alias("held_out"))
    got = {r.doc_id: r for r in brown.score(docs, docs.where("not held_out"), head_words=60, word_units=40, classes=8).collect()}
    want = brute.base_scores(dict(enumerate(texts)))
    for i, (n, known, train, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and abs(r.base_score - base) < 1e-6
    held = [got[i] for i in got if got[i].held_out and i >= len(EDGE)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    twice = docs_of(["a b", "a b"], [7, 7]).select("doc_id", "text", F.lit(False).alias("held_out"))
    assert {round(r.base_score, 9) for r in brown.score(twice, docs, head_words=1, word_units=1, classes=2).collect()}.__len__() == 1
    assert brown.score(docs.limit(0), docs.limit(0)).count() == 0
    alone = brown.score(docs.limit(3), docs.limit(0)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in alone)


def test_exchange_finds_the_classes():
    n = np.zeros((9, 9), dtype=int)
    for a in range(1, 9):
        for b in range(1, 9):
            n[a, b] = 10 if (a % 2) != (b % 2) else 0
    label = brown.exchange_clustering(n, 2)
    assert len({(int(label[u])) for u in range(1, 9, 2)}) == 1 and len({int(label[u]) for u in range(2, 9, 2)}) == 1 and label[1] != label[2]


def test_one_word_exchange_equals_the_likelihood():
    rng = np.random.default_rng(2)
    label = np.array([0, *rng.integers(1, 5, 19)])
    pairs = rng.integers(0, 6, (20, 20))
    pairs[0, 0] = 3

    def likelihood(label):
        grid = np.zeros((5, 5))
        np.add.at(grid, (label[:, None], label[None]), pairs)
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(grid) - f(grid.sum(axis=0)) - f(grid.sum(axis=1)), grid

    member, at, u = np.eye(5)[label], np.arange(1, 20), np.diagonal(pairs)[1:].astype(float)
    right, left = (pairs @ member)[1:], (pairs.T @ member)[1:]
    right[at - 1, label[1:]] -= u
    left[at - 1, label[1:]] -= u
    got = brown.best_classes(likelihood(label)[1], label[1:], right, left, u)
    for w in at:
        tries = [likelihood(np.where(np.arange(20) == w, b, label))[0] for b in range(1, 5)]
        assert abs(tries[got[w - 1] - 1] - max(tries)) < 1e-6


def test_brown_hot_words_are_summed_in_shares(spark, docs_of, monkeypatch):
    """Contexts of common words dealt into shares, several times over, give the scores of whole groups."""
    rng = random.Random(6)
    v = vocab(rng, 40)
    docs = docs_of([" ".join(rng.choice(v[: rng.choice([3, 40])]) for _ in range(30)) for _ in range(60)]).repartition(30).withColumn("held_out", F.lit(False)).cache()
    options = dict(head_words=20, word_units=5, classes=6)
    whole = {r.doc_id: r.score for r in brown.score(docs, docs, **options).collect()}
    monkeypatch.setattr(brown, "WORD_ROWS", 3)
    assert {r.doc_id: round(r.score, 9) for r in brown.score(docs, docs, **options).collect()} == {i: round(s, 9) for i, s in whole.items()}
    docs.unpersist()


def test_brown_last_round_is_taken_back_where_it_lowers_the_likelihood(spark, docs_of, monkeypatch):
    rng = random.Random(9)
    v = vocab(rng, 60)
    docs = docs_of([" ".join(rng.choice(v) for _ in range(25)) for _ in range(50)]).withColumn("held_out", F.lit(False))
    options = dict(head_words=10, word_units=4, classes=5, passes=0)
    kept = []
    assign = brown._assign  # a bad last round: words move by bigrams of chance
    monkeypatch.setattr(brown, "_assign", lambda grid, stay=False: assign(grid if stay else np.random.default_rng(0).integers(1, 50, grid.shape).astype(float), stay))
    real = brown.final_bigrams
    monkeypatch.setattr(brown, "final_bigrams", lambda *a: kept.append(real(*a)) or kept[-1])
    with Workspace(spark, "t") as ws:
        training = docs.select("text")
        counts = ws.save(training.mapInArrow(brown._count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
        model, _ = brown.train(training, counts, ws, **options)
        grid = real(training, model.classes, ws.load("words-kept", spark.createDataFrame([], "h long, c long, cls int")).where(~brown.head_condition(counts, 10)), ws)
    assert brown.likelihood(grid) > brown.likelihood(kept[0])


@pytest.mark.parametrize("head_words", [7, 1000])  # the words compared are joined, or in the head
def test_brown_words_of_one_suffix_have_classes_of_their_own(spark, docs_of, head_words):
    rng = random.Random(6)
    kinds = [[f"{a}{i}end" for i in range(20)] for a in "pq"]
    frames = [("he", "runs"), ("the", "house")]
    mid = lambda i: rng.choice([*["alpha", "omega"][i : i + 1] * 20, *kinds[i]])  # noqa: E731  a common word of each kind
    texts = [" ".join(x for _ in range(30) for x in (frames[i % 2][0], mid(i % 2), frames[i % 2][1])) for i in range(40)]
    train = docs_of(texts).select("text")
    # both texts have the same words, so only classes tell them apart
    words = [kinds[0][0], kinds[1][0]]
    asked = [f"he {a} runs the {b} house" for a, b in (words, words[::-1])]
    docs = docs_of(asked).select("doc_id", "text", F.lit(True).alias("held_out"))
    right, swapped = (r.score for r in brown.score(docs, train, head_words=head_words, word_units=6, classes=7, passes=2).orderBy("doc_id").collect())
    assert right > swapped + 1


# ------------------------------------------------------------------ archives


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/1", b"<p>x</p>"), (2, "http://a/2\r\nEvil: 1", b"<p>x</p>"), (3, None, None), (9, "u", b""), (4, "u", b"\r\n\r\nWARC/1.1\r\n\xff\x00"), (7, "u", b"\r\n\r\nWARC/1.1\r\n\xff\x00"), (8, "long", b"z" * 50_000_000), (-3, "u", b"neg"), (11, "t", b"twice"), (11, "t", b"twice")]
    recs = spark.createDataFrame([(*r, "own") for r in rows], "record_id long, uri string, payload binary, `a.b` string")
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.write_archive(recs, path, compression=compression)
        with Workspace(spark, "t") as ws:
            records, payloads = warc.content_store(warc.read_archive(spark, path), ws)
            kinds = Counter((r.record_id, r.record_type, r.refers_to) for r in records.collect())
            name = lambda i: f"<urn:record:{i}>"
            assert kinds == Counter({(2, "response", None): 1, (5, "revisit", name(2)): 1, (3, "response", None): 1, (9, "revisit", name(3)): 1, (4, "response", None): 1, (7, "revisit", name(4)): 1, (8, "response", None): 1, (-3, "response", None): 1, (11, "response", None): 2})
            assert payloads.count() == 6 and b"\r\nEvil" not in b"".join(bytes(r.header) for r in records.collect())
            back = Counter((r.record_id, bytes(r.payload)) for r in warc.reconstruct(records, payloads).collect())
            assert back == Counter((i, p or b"") for i, _, p in rows)
    warc.write_archive(recs, str(tmp_path / "least"), min_revisit_bytes=9)
    assert {r.record_id for r in warc.read_archive(spark, str(tmp_path / "least")).where("record_type = 'revisit'").collect()} == {7}
    warc.write_archive(recs.limit(0), str(tmp_path / "empty"))
    with Workspace(spark, "t") as ws:
        assert warc.content_store(warc.read_archive(spark, str(tmp_path / "empty")), ws)[0].count() == 0


def _record(name, kind, body, more=b""):
    return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: " + name + b"\r\n" + more + b"Content-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_warc_of_another_writer(spark, tmp_path):
    """A gzip member for each record, names that are no numbers, records that are no HTTP responses."""
    records = [_record(b"<urn:uuid:1>", b"warcinfo", b"software: x\r\n"), _record(b"<urn:uuid:2>", b"response", b"HTTP/1.1 200 OK\r\n\r\nbody", b"Content-Type: application/http\r\n"), _record(b"<urn:uuid:3>", b"resource", b"plain" * 300_000)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records) + b"\0" * 5)
    got = {r.record_name: (r.record_id, bytes(r.payload)) for r in warc.read_archive(spark, str(tmp_path / "x")).collect()}
    assert got == {"<urn:uuid:1>": (None, b"software: x\r\n"), "<urn:uuid:2>": (None, b"body"), "<urn:uuid:3>": (None, b"plain" * 300_000)}
    whole = gzip.compress(records[1])
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse_warc(warc.inflated(memoryview(whole[:-9]))))
    lost = _record(b"<urn:uuid:4>", b"revisit", b"", b"WARC-Refers-To: <urn:uuid:9>\r\nWARC-Payload-Digest: sha1:A\r\n")
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "a.warc").write_bytes(records[1] + lost)
    with Workspace(spark, "t") as ws, pytest.raises(Exception, match="refers to no record"):
        warc.content_store(warc.read_archive(spark, str(tmp_path / "y")), ws)


def test_warc_cut_short_and_altered():
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse_warc([b"WARC/1.1\r\nContent-Le", b"ngth: 9\r\n\r", b"\nabc\r\n\r\n"]))
    with pytest.raises(ValueError, match="no WARC"):
        list(warc.parse_warc([b"junk\r\n\r\n"]))
    altered = _record(b"<urn:record:1>", b"response", b"HTTP/1.1 200 OK\r\n\r\nbody", b"Content-Type: application/http\r\nPayload-Key: sha256:00\r\n")
    with pytest.raises(ValueError, match="does not match"):
        warc._row("f", *next(warc.parse_warc([altered])))


# ------------------------------------------------------------------ embeddings


@pytest.mark.parametrize("list_rows", [512, 2])
def test_pivot_index_equals_brute_force(spark, list_rows):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 64))
    near = np.concatenate([x[:6] + 0.11 * rng.normal(size=(6, 64)) for _ in range(8)])
    x = np.concatenate([x, near, x[:3], 2 * x[3:5]]).astype(np.float32)
    labels = [int(i) % 2 for i in range(len(x))]
    rows = [(i, v.tolist(), labels[i]) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, x[0].tolist(), None), (904, [], 1), (None, x[0].tolist(), 0), (905, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, list_rows=list_rows).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = [(i, j) for i in range(len(x)) for j in range(i) if labels[i] == labels[j] and u[i] @ u[j] >= 0.98]
    comp = brute.components(range(len(x)), links)
    deg = {i: sum(i in p for p in links) for i in range(len(x))}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items() if i is not None and i < 900} == {i: (deg[i], comp[i], comp[i] == i) for i in range(len(x))}
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 906)) and got[None].component_id is None
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("mean_norm", [0.0, 0.8, 0.9, 0.95])
def test_pivot_recall_at_the_threshold(mean_norm):
    """Pairs at exactly cosine 0.98, spread out or close about a mean: found by the fitted index, fitted on others."""
    rng = np.random.default_rng(1)

    def vectors(n):
        x = embeddings.units(rng.normal(size=(n, 64))) * np.sqrt(1 - mean_norm**2)
        x[:, 0] += mean_norm
        return embeddings.units(x)

    x = vectors(3000)
    mean, p = x.mean(axis=0), embeddings.pivots(embeddings.PIVOTS, 64)
    prefix, shared, apart = embeddings.fit_index(vectors(2000), mean, p, 0.98, embeddings.PREFIX, embeddings.SHARED, embeddings.RECALL)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * embeddings.units(z)
    n, d = embeddings.agreement(*(embeddings.permutation_prefix(v, mean, p, prefix) for v in (x, y)))
    assert ((n >= shared) & (d <= apart)).mean() > 0.99


# ------------------------------------------------------------------ mixing


def test_mixing_limits_and_edges(spark, docs_of):
    texts = ["w " * 10] * 90 + ["w " * 10] * 9 + ["w " * 10] + [None, ""]
    docs = docs_of(texts).withColumn("source", F.when(F.col("doc_id") < 90, "big").when(F.col("doc_id") < 99, "mid").when(F.col("doc_id") == 99, F.lit(None)).otherwise("void"))
    out = mixing.mix(docs, entropy_share=1.0, repeats=4.0)
    per = {r.source: r for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("mix_epoch").alias("e"), F.first("mix_weight").alias("w")).collect()}
    assert per[None].n == 4 and "void" not in per  # the smallest source meets the repetition limit exactly
    assert abs(sum(r.w for r in per.values()) - 1) < 1e-6 and per["big"].n < 90 and per["mid"].n > 9
    copies = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mix_epoch").alias("e"))
    assert copies.where("n <> e").count() == 0
    plain = mixing.mix(docs.where("doc_id < 100"), entropy_share=0.0)
    assert plain.count() == 100 and plain.columns[: len(docs.columns)] == docs.columns
    half = mixing.mix(docs.where("source = 'big'"), budget=0.5)
    assert half.count() == 45
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("source = 'void'")).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300")
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    names = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.columns[: len(names)] == names and (k == 4 or out.columns == names)
        out.write.parquet(str(tmp_path / name))
        seen[name], docs = docs, spark.read.parquet(str(tmp_path / name))
        texts = {r.doc_id: r.text for r in seen[name].collect()}
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "near_duplicates":
            _, comp = brute.near(texts)
            assert set(after) == {i for i in comp if comp[i] == i}
        elif name == "repeated_passages":
            want = brute.repeats([t.encode() for t in texts.values()], 200)
            assert set(after) == set(texts)
            for (i, t), (n, removed, _, _) in zip(texts.items(), want, strict=True):
                assert (after[i] == t) if not removed else len(after[i].encode()) <= n - removed
        elif name == "contamination":
            want = brute.contaminated(texts, bench)
            assert set(after) == {i for i in texts if not want[i][3]}
        elif name == "mixture":
            assert {"mix_epoch", "mix_weight", "mix_key"} <= set(docs.columns) and set(after) <= set(texts)


def test_workspace_uses_the_shared_folder(spark):
    with Workspace(spark, "t") as ws:
        saved = ws.save(spark.range(3).toDF("a"), "x")
        assert saved.count() == 3 and ws.root


# ------------------------------------------------------------------ exactness, names, long texts


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_that_polynomial_hashes_confuse(spark, docs_of):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    docs = docs_of([f"one two three four {a}", f"one two three four {b}"])
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {0, 1}
    test = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert [r.n_hit for r in phrases.contamination_report(docs, test).orderBy("doc_id").collect()] == [1, 0]
    split = docs.select("doc_id", "text", (F.col("doc_id") == 1).alias("held_out"))
    got = {r.doc_id: r.n_known for r in brown.score(split, split.where("doc_id = 0")).collect()}
    assert got == {0: 6, 1: 5}


def test_keys_tell_spans_apart():
    spans = [b"", b"\0", b"\0\0", b"a", b"a\0", b"a" * 7, b"a" * 8, b"a" * 9, b"a" * 15, b"a" * 16, b"a" * 17, b"a" * 15 + b"b", b"x" * 5000, b"x" * 5001]
    data = np.frombuffer(b"".join(spans), np.uint8)
    end = np.cumsum([len(x) for x in spans])
    k = list(zip(*(x.tolist() for x in tk.span_keys(data, end - [len(x) for x in spans], end)), strict=True))
    assert len(set(k)) == len(spans)
    again = list(zip(*(x.tolist() for x in tk.span_keys(data, end[3:4] - 1, end[3:4])), strict=True))
    assert again == [k[3]]


CLASH = ["_rk", "_n", "_block", "_cut_key", "Score", "a.b", "rk", "id", "gone", "c0", "c1", "component", "mix", "spans", "block", "LANG_PRED", "n", "held"]


@pytest.fixture(scope="module")
def clashing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    texts = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (901, "", "en", "s", 0)], docs.schema))
    return texts.select(*docs.columns, *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, sf, clashing, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, clashing, sf)
    assert out.columns[: len(clashing.columns)] == clashing.columns
    rows = out.limit(50).toArrow()
    assert rows.num_rows and all(set(rows[c].to_pylist()) == {f"own {c}"} for c in CLASH)
    empty = dict(corpus_pipeline.STAGES)[stage](spark, clashing.limit(0), sf)
    assert empty.count() == 0 and empty.columns == out.columns


def test_operators_take_columns_of_any_name(spark, sf, clashing):
    assert minhash.near_duplicates(clashing).count() == suffixes._slim(clashing).count() == clashing.count()
    assert phrases.contamination_report(clashing, spark.read.parquet(f"{sf}/benchmark.parquet").withColumn("rk", F.lit(1))).count() == clashing.count()
    suffixes.removals(clashing).count()
    held = clashing.withColumn("held_out", F.lit(False))
    assert brown.score(held, clashing).count() == clashing.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("text", F.lit("x")).withColumn("a.b", F.lit(1))
    for model in (quality.train(clashing, labels), toxicity.train(clashing, labels)):
        scored = quality.add_scores(clashing, model)
        assert scored.columns == [c for c in clashing.columns if c != "Score"] + ["score"] and scored.count() == clashing.count()
    found = langid.identify(clashing, langid.train(clashing))
    assert found.columns[-2:] == ["lang_pred", "score"] and not {"Score", "LANG_PRED"} & set(found.columns)
    toxicity.passages(clashing, model).count()
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.01], 1, "x")], "vec_id long, embedding array<float>, label int, `a.b` string").withColumn("rep", F.lit(1))
    assert [r.n_links for r in embeddings.near_duplicates(vectors).collect()] == [1, 1]


def test_session_settings_are_put_back(spark, docs_of):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    before = [spark.conf.get(k) for k in keys]
    minhash.near_duplicates(docs_of(["a b c"])).collect()
    assert [spark.conf.get(k) for k in keys] == before


def long_text(n):
    rng = random.Random(n)
    v = vocab(rng, 5000)
    return " ".join(rng.choices(v, k=n // 5))[:n]


def test_long_texts_in_parts_equal_whole_ones(monkeypatch):
    import pyarrow as pa

    text = long_text(60_000) + " " + "z" * 9_000 + " end of it"
    (c,) = tk.chunks(pa.array([text]))
    block = phrases._test_block([("a", " ".join(text.split()[5:40]))], 13)
    m = langid.LanguageModel(["x", "y"], [np.sort(tk.text_hashes(text.split()[:50]))], [np.random.default_rng(0).random((50, 2))], np.full(2, -7.0))
    whole = minhash.shingle_sets(c), minhash.exact_sets(pa.array([text])), phrases._terms(c, block), m.score(pa.array([text]))
    sizes = [len(x) for x in suffixes.runs(c, 200, 32)]
    monkeypatch.setattr(tk, "PIECE_BYTES", 1000)
    monkeypatch.setattr(suffixes, "STEP_BYTES", 5000)
    parts = minhash.shingle_sets(c), minhash.exact_sets(pa.array([text])), phrases._terms(c, block), m.score(pa.array([text]))
    for x, y in zip(whole[:3], parts[:3], strict=True):
        assert all((a == b).all() for a, b in zip(x, y, strict=True))
    assert np.allclose(whole[3][1], parts[3][1])
    found = [suffixes.runs(p, 200, 32) for p, _ in suffixes._parts(c, 200)]
    assert sum(len(r[1]) for r in found) >= sizes[1] and sum((r[2] * r[3]).sum() for r in found) == len(text) - 199


def test_phrases_of_common_words_are_matched_in_bounded_slices(monkeypatch):
    """Thousands of phrases over a few common words: candidates are held a slice at a time, and matches are the same."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(8)
    v = [f"w{k}" for k in range(12)]
    texts = [" ".join(rng.choices(v, k=400)) for _ in range(40)]
    items = [(str(k), " ".join(rng.choices(v, k=60))) for k in range(30)] + [("in", " ".join(texts[3].split()[7:40]))]
    block = phrases._test_block(items, 4)
    (c,) = tk.chunks(pa.array(texts))
    doc, term, pos, _ = phrases._terms(c, block)
    order = np.lexsort((pos, term, doc))
    p = phrases.Postings(len(texts), doc[order], term[order], pos[order])
    frequency = np.bincount(term, minlength=len(block.vocab))
    got, peak = [], []
    for most in (1 << 40, 2_000):
        monkeypatch.setattr(phrases, "CANDIDATES", most)
        for match in (lambda: phrases.match_phrases(p, block.phrases, block.size, frequency), lambda: phrases.match_near(p, block.phrases, block.size, frequency, 6)):
            tracemalloc.start()
            got.append(sorted(zip(*(x.tolist() for x in match()), strict=True)))
            peak.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert got[0] == got[2] and got[1] == got[3] and got[0] and peak[2] < peak[0] / 4


def test_a_text_of_fifty_megabytes(spark, docs_of):
    import pyarrow as pa

    text = long_text(5_000_000) * 10
    (c,) = tk.chunks(pa.array([text]))
    h, _, first = minhash.shingle_sets(c)
    assert 900_000 < first[1] == len(h) < 1_100_000
    found = [suffixes.runs(p, 200, 32) for p, _ in suffixes._parts(c, 200)]
    assert sum(int((r[2] * r[3]).sum()) for r in found) == len(text) - 199
    assert phrases._terms(c, phrases._test_block([("a", text[:300])], 13))[3][0] == len(text.split())
    q = quality.QualityModel(np.zeros(1 << 10), 0.0)
    assert q.score(pa.array([text])) == 0.5


# ------------------------------------------------------------------ models against plain versions


def grams(word, n):
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def gram_hash(g, n):
    return int(tk.mix(tk.text_hashes([g]) + np.uint64(n))[0])


def test_language_scores_equal_a_plain_backoff(spark, sf):
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = langid.train(langid.train_rows(docs.limit(60)))
    tables = [dict(zip(k.tolist(), v.astype(float), strict=True)) for k, v in zip(m.keys, m.logs, strict=True)]
    texts = [r.text for r in docs.limit(30).collect() if r.text and len(r.text) < 4000] + ["ünïcödé новый текст qqqq", "Zzz x"]
    pred, score = m.score(pa.array(texts))
    for t, p, s in zip(texts, pred, score, strict=True):
        total = np.zeros(len(m.langs))
        words = re.findall("[a-z\x80-\U0010ffff]+", t.lower())
        for w in words:
            if (h := int(tk.text_hashes([w])[0])) in tables[0]:
                total += tables[0][h]
                continue
            for step, k in enumerate(range(5, 0, -1), 1):
                if known := [tables[k][h] for g in grams(w, k) if (h := gram_hash(g, k)) in tables[k]]:
                    total += np.mean(known, axis=0) + step * np.log10(langid.BACKOFF)
                    break
            else:
                total += m.floor
        z = np.exp((total - total.max()) * np.log(10) / np.sqrt(max(len(words), 1)))
        assert m.langs[int(total.argmax())] == p and abs(z.max() / z.sum() - s) < 1e-6


def test_quality_scores_equal_a_plain_average(spark, sf):
    import pyarrow as pa

    m = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), max_docs=60)
    size, mixed = len(m.weights), lambda x: int(tk.mix(np.array([x], dtype=np.uint64))[0])
    texts = ["A b b b cd", "ünï x ünï x", "one", "", None, "w " * 50 + "End."]
    for t, s in zip(texts, m.score(pa.array(texts)), strict=True):
        words = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        h = [int(x) for x in tk.text_hashes(words)] if words else []
        f = list(h) + [gram_hash(g, k) for w in words for k in quality.ORDERS for g in grams(w, k)]
        f += [mixed((a * 0x9E3779B97F4A7C15 + b) % (1 << 64)) for a, b in zip(h, h[1:], strict=False)]
        mean = np.mean([m.weights[x % size] for x in f]) if f else 0.0
        assert abs(1 / (1 + np.exp(-(m.bias + mean))) - s) < 1e-6


def test_quality_of_a_text_in_parts_is_that_of_the_whole(monkeypatch):
    import pyarrow as pa

    m = quality.QualityModel(np.random.default_rng(1).normal(size=1 << 12), 0.1)
    texts = [long_text(30_000), " ".join("ab cd".split() * 800), "x" * 5000 + " y", "   "]
    whole = m.score(pa.array(texts))
    monkeypatch.setattr(tk, "PIECE_BYTES", 700)
    monkeypatch.setattr(tk, "CHUNK_BYTES", 100)
    assert np.allclose(m.score(pa.array(texts)), whole)


def test_toxicity_scores_equal_plain_segments(spark, sf):
    import pyarrow as pa

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    odds = dict(zip(m.keys.tolist(), m.odds.tolist(), strict=True))
    texts = [r.text for r in docs.limit(200).collect() if r.text and len(r.text) < 1500][:40] + ["", None]
    for t, s in zip(texts, m.score(pa.array(texts)), strict=True):
        words = re.findall("[a-z\x80-\U0010ffff]+", (t or "").lower())
        feats = [[int(tk.text_hashes([w])[0]), *(int(tk.mix(tk.text_hashes([w[:n]]) + np.uint64(n))[0]) for n in toxicity.PREFIXES if len(w) > n)] for w in words]
        x = np.array([max(odds.get(h, 0.0) for h in f) or -m.drift for f in feats])
        e = [m.lam * x[a:b].sum() - np.log(max(len(words), 1)) for a, b in maximal(x)] if len(x) < 120 else None
        if e is not None:
            z = m.weights @ [1.0, max([0.0, *e]), sum(v for v in e if v > -np.log(toxicity.EXPECT))]
            assert abs(1 / (1 + np.exp(-np.clip(z, -40, 40))) - s) < 1e-6


def test_brown_scores_equal_a_plain_class_model(spark, docs_of):
    rng = random.Random(8)
    v = vocab(rng, 80)
    texts = [None, "", "one", *(" ".join(rng.choice(v) for _ in range(rng.randint(1, 60))) for _ in range(60))]
    docs = docs_of(texts).select("doc_id", "text", F.lit(False).alias("held_out"))
    training = docs.where("doc_id % 3 > 0")
    options = {"head_words": 20, "word_units": 10, "classes": 6}
    got = {r.doc_id: r.score for r in brown.score(docs, training, **options).collect()}
    tok = lambda t: re.findall(r"[^\x20\x09-\x0d]+", brute.low(t))
    with Workspace(spark, "t") as ws:
        counts = ws.save(training.select("text").mapInArrow(brown._count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")
        model, rare = brown.train(training, counts, ws, **options)
        m = model.classes
        cls = dict(zip(m.head.tolist(), m.head_label.tolist(), strict=True)) | {r.h % (1 << 64): r.cls for r in rare.collect()}
    heard = [[*tok(t), None] for i, t in enumerate(texts) if i % 3]
    c = Counter(w for ws_ in heard for w in ws_)
    assert len(cls) == len(c) - 1 and len(m.head) == 20

    def class_of(w):
        if w is None:
            return 0
        (chunk,) = tk.chunks(__import__("pyarrow").array([w]))
        data, words = tk.words(chunk, "nonspace")
        return cls[int(words.hash[0])] if int(words.hash[0]) in cls else int(m.label[m.units.of(data, words)][0])

    k = 7
    grid, kinds = np.zeros((k, k)), np.zeros(k)
    for ws_ in heard:
        for a, b in zip([None, *ws_], ws_, strict=False):
            grid[class_of(a), class_of(b)] += 1
    for w in c:
        kinds[class_of(w)] += 1
    for i, t in enumerate(texts):
        want, last = 0.0, 0
        for w in [*tok(t), None]:
            b = class_of(w)
            want += np.log10((grid[last, b] + 0.5) / (grid[last].sum() + 0.5 * k)) + np.log10((c[w] + 0.5) / (grid[:, b].sum() + 0.5 * (kinds[b] + 1)))
            last = b
        assert abs(want - got[i]) < 1e-6


@pytest.mark.parametrize(("most", "least"), [(400, 300), (200, 190), (7, 7), (0, 0)])
def test_head_of_words_that_are_equally_common(spark, most, least):
    rng = np.random.default_rng(3)
    h = rng.integers(-(1 << 63), 1 << 63, 300)
    counts = spark.createDataFrame([(int(x), 100_000) for x in h], "h long, c long")
    got = counts.where(brown.head_condition(counts, most)).count()
    assert least <= got <= max(most, 0)
    more = counts.unionByName(spark.createDataFrame([(5, 10**12), (6, 3)], "h long, c long"))
    assert 5 in {r.h for r in more.where(brown.head_condition(more, max(most, 1))).collect()}


def test_parts_of_a_hot_bucket_send_on_fewer_rows_than_they_have_runs():
    import numpy as np
    import pyarrow as pa

    from tessella.llm import suffixes

    rng, m, n, length = np.random.default_rng(1), 60, 20, 40
    same = rng.bytes(n + length - 1)
    bodies = [rng.bytes(n + length - 1) for _ in range(m - 2)] + [same, same]
    parts = [0] * (m // 2) + [1] * (m // 2 - 1) + [0]
    rows = sorted(zip(parts, bodies, strict=True), key=lambda x: x[0])
    batch = pa.RecordBatch.from_arrays([
        pa.array([p for p, _ in rows]), pa.array([7] * m), pa.array([b[:16] for _, b in rows]), pa.array([n] * m, pa.int32()), pa.array([1] * m), pa.array([b for _, b in rows]), pa.array([2] * m, pa.int32()),
    ], names=["part", "anchor", "seg", "n", "c", "body", "slots"])
    out = [r for b in suffixes._refine_part(length)(iter([batch])) for r in b.to_pylist()]
    assert len(out) <= 4 and sum(len(r["keys"]) for r in out) == 16 * n * (m - 2 + 2)
    met = sorted(({"group": r["slot"], "part": r["part"], "keys": r["keys"], "cs": r["cs"]} for r in out), key=lambda r: r["group"])
    told = [r for b in suffixes._find_lone(iter([pa.RecordBatch.from_pylist(met)])) for r in b.to_pylist()]
    assert {p: sum(len(r["key"]) for r in told if r["part"] == p) for p in (0, 1)} == {0: 16 * n, 1: 16 * n}
