"""op11 to op13: prefix trie, pattern packing, periodic runs."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import packing, periodic, prefixtrie

from .test_operators import EDGE

# ------------------------------------------------------------------ periodic runs


def plain_runs(w, least=6, times=4):
    found = set()
    for s in range(len(w)):
        for q in range(1, len(w) // times + 1):
            if s and s - 1 + q < len(w) and w[s - 1] == w[s - 1 + q]:
                continue
            e = s + q
            while e < len(w) and w[e] == w[e - q]:
                e += 1
            if e - s >= max(least, times * q) and not any(all(w[k] == w[k - r] for k in range(s + r, e)) for r in range(1, q)):
                found.add((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_periodic(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {k for s, n_, q in runs for k in range(s + q, s + n_)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    told = sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs))
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, told, sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=5), st.sampled_from([(6, 4), (4, 2), (1, 2), (2, 3)]))
def test_runs_are_those_of_the_definition(docs, least):
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    got = periodic.find_runs(np.array([x for d in docs for x in d], dtype=np.int64), first, *least)
    listed = [[(int(got.start[i]), int(got.length[i]), int(got.period[i])) for i in range(got.of(k).start, got.of(k).stop)] for k in range(len(docs))]
    assert listed == [plain_runs(d, *least) for d in docs]


def run_texts():
    rng = random.Random(5)
    texts = list(EDGE)
    for k in range(250):
        p, a = rng.randint(1, 12), rng.choice([1, 2, 5, 300])
        w = [f"w{rng.randrange(a)}" for _ in range(rng.randint(0, 70))]
        if k % 2:
            w[5:5] = [f"v{i % p}" for i in range(rng.randint(0, 60))]
        texts.append(rng.choice([" ", "\t", "  \n"]).join(w))
    return texts


def test_periodic_runs_equal_the_plain_version(docs_of):
    texts = run_texts()
    ids = [None, 7, 7, *range(3, len(texts))]
    got = sorted(tuple(r[c] for c in ("id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in periodic.periodic_runs(docs_of(texts, ids), planted=True).collect() if r.id is not None)
    assert got == sorted((i, *plain_periodic(i, t)) for i, t in zip(ids, texts, strict=True) if i is not None)


def test_periodic_null_id_empty_table_and_collapsed_texts(spark, docs_of):
    assert periodic.periodic_runs(docs_of([])).count() == 0
    assert periodic.periodic_runs(docs_of(["a " * 9], [None]), planted=True).first().n_runs == 1
    rows = docs_of(["x " + "a b " * 6 + "y", "p  q", None, "", "x " + "a b " * 6 + "y"], [1, 2, 3, 4, 1])
    assert [r.text for r in periodic.collapse_runs(rows).orderBy("doc_id", "text").collect()] == ["x a b y"] * 2 + ["p  q", None, ""]
    assert periodic.collapse_runs(rows).columns == rows.columns
    with pytest.raises(ValueError):
        periodic.periodic_runs(rows, least_periods=1)


def test_periodic_long_texts_in_near_linear_time(docs_of):
    began = time.perf_counter()
    texts = ["a " * 400_000, "ab cd ef " * 100_000, " ".join(f"u{i}" for i in range(300_000))]
    got = {r.id: (r.n_runs, r.length, r.period, r.collapsed[:9]) for r in periodic.periodic_runs(docs_of(texts)).collect()}
    assert got == {0: (1, 400_000, 1, "a"), 1: (1, 300_000, 3, "ab cd ef"), 2: (0, None, None, "u0 u1 u2 ")}
    assert time.perf_counter() - began < 60


# ------------------------------------------------------------------ packing


def test_ids_of_words_are_the_ids_of_the_text():
    rng = random.Random(2)
    bits = [" ", "\n", "a", "B", "é", "́", "'s", "'", "Ⅷ", "漢", "ﬁ", "​", "!", "<|endoftext|>", "Σ", "\x0b", "\x85", "don't", "12"]
    texts = [None, "", " \n", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500))]
    path = packing.default_tokenizer()
    for most in (10, 100_000):
        for (_, ids), t in zip(packing._documents(packing.WordIds(path, most), pa.array(texts), 1), texts, strict=True):
            assert ids.tolist() == [*packing._tokenizer(path).encode(t or "", add_special_tokens=False).ids, 1]


def plan_is_exact(counts, plan, capacity):
    filled, seen = {}, np.zeros(capacity + 1, dtype=np.int64)
    for r in plan:
        assert r["lo"] == seen[r["length"]]
        seen[r["length"]] += r["count"] * r["times"]
        for s in range(r["count"]):
            filled.setdefault(int(r["sequence"]) + s, []).append((int(r["offset"]), int(r["length"]) * int(r["times"])))
    assert (seen == counts).all()
    for held in filled.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return len(filled)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.sampled_from([1, 3]))
def test_plan_places_every_piece_once(lengths, each):
    counts = np.bincount(np.repeat(np.array(lengths, dtype=np.int64), each), minlength=65)
    n = plan_is_exact(counts, packing.make_plan(counts, 64, classes=16), 64)
    assert n <= sum(b.count for b in packing.best_fit(counts.copy(), [], 64)) * 1.1 + 1


def test_plan_is_near_the_least_number_and_small_whatever_the_corpus():
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(6.3, 1.1, 40_000).astype(int), 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    plan = packing.make_plan(counts, 4096)
    least = -(-int((counts * np.arange(4097)).sum()) // 4096)
    assert plan_is_exact(counts, plan, 4096) <= 1.001 * least + 1
    many = packing.make_plan(counts * 1_000_000, 4096)
    assert len(many) < 60_000 and (many["count"] * many["times"]).sum() == 40_000_000_000
    assert (many["sequence"] + many["count"]).max() <= 1.001 * least * 1_000_000


def test_patterns_are_all_of_them_and_the_fit_is_the_least_squares():
    shape = packing.patterns(12, 3)
    assert {tuple(r) for r in shape} == {tuple(sorted((a, b, 12 - a - b), reverse=True)) for a in range(13) for b in range(13 - a)}
    x = np.zeros(len(shape))
    x[[1, 4, 7]] = 5, 2, 9
    wanted = np.bincount(shape.ravel(), weights=np.repeat(x, 3), minlength=13)[1:]
    got = packing.fit(shape, wanted, np.ones(12))
    assert np.allclose(np.bincount(shape.ravel(), weights=np.repeat(got, 3), minlength=13)[1:], wanted, atol=1e-6)
    assert (got >= 0).all()


def test_packing_edges_and_round_trip(docs_of):
    texts = [*EDGE, "word " * 10_000, "kbwqzx" * 20_000, "tie a", "tie b"]
    docs = docs_of(texts, [None, *range(1, len(texts) - 1), 1])
    rows = packing.pack(docs, capacity=64, classes=16).collect()
    by_doc = {}
    for r in rows:
        assert r.length == len(r.ids) <= 64 and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and r.start == 64 * r.piece
        by_doc.setdefault(r.id, []).append(r)
    tok = packing._tokenizer(packing.default_tokenizer())
    for i, t in zip([r.doc_id for r in docs.collect()], texts, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        if i != 1:
            assert [x for r in sorted(by_doc[i], key=lambda r: r.piece) for x in r.ids] == ids
    for s in packing.sequences(packing.pack(docs, capacity=64, classes=16)).collect():
        assert len(s.ids) == sum(d.length for d in s.documents) <= 64
    assert packing.pack(docs_of([])).count() == 0


def test_packing_numbers_pieces_across_parts(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    docs = docs_of([f"a b c {'d ' * (i % 5)}" for i in range(200)]).repartition(7)
    rows = packing.pack(docs, capacity=32, classes=8, with_ids=False).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 200


# ------------------------------------------------------------------ prefix trie

TURNS = "conv_id long, turn long, role string, text string, k1 string, depth string"


def plain_trie(rows):
    convs = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            label = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs.setdefault(c, []).append(((t is not None, t or 0), label, role, text))
    seqs = {c: tuple((r, x) for _, _, r, x in sorted(v)) for c, v in convs.items()}
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = {}
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = lambda q: sum(1 for x in nodes if len(x) == len(q) + 1 and x[: len(q)] == q)
        ends = ",".join(str(c) for c in sorted(members) if seqs[c] == p)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        out[min(members), len(p)] = (min(nodes[p[:-1]]) if p else None, len(members), kids(p), sum(1 for q in below if not kids(q)), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def some_turns(seed, convs=60):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "no conversation", "own", "own"), (3, None, None, None, "own", "own"), (3, None, "user", "x" * 50_000, "own", "own"), (3, 1, "user", "tie", "own", "own"), (3, 1, "user", "tie", "own", "own"), (3, 1, "bot", "tie", "own", "own")]
    for c in range(-5, convs):
        for t in range(rng.choice([1, 2, 3, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]) if t > 2 else "user", "hot" if t < 2 and rng.random() < 0.7 else rng.choice(["a", "", "é", None]), "own", "own"))
    return rows


@pytest.mark.parametrize(("shard_nodes", "parts"), [(1, 3), (12, 1), (10**6, 5)])
def test_trie_equals_the_plain_version(spark, shard_nodes, parts):
    rows = some_turns(shard_nodes)
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(parts), shard_nodes).collect()
    assert {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got} == plain_trie(rows)


def test_trie_of_one_long_conversation_and_many_copies(spark):
    """A conversation longer than a shard is rolled up by doubling; copies are one sequence."""
    long_ = [(1, t, "user", "ab", "", "") for t in range(300)]
    rows = long_ + [(c, 0, "user", "copy", "", "") for c in range(2, 400)]
    got = {(r.conv_id, r.depth): r for r in prefixtrie.prefix_trie(spark.createDataFrame(rows, TURNS), 20).collect()}
    assert len(got) == 302 and got[1, 0].n_leaves == 2 and got[1, 0].saved_tokens == 397 * 4
    assert got[2, 1].ends_sha256 == hashlib.sha256(",".join(map(str, range(2, 400))).encode()).hexdigest()


def test_trie_empty_table_and_streamed_digests(spark, monkeypatch):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "", "")], TURNS)).count() == 0


def test_stored_shards_answer_prefix_searches(spark):
    rows = [(c, t, "user", f"{c % 4 if t == 0 else c}-{t}", "", "") for c in range(40) for t in range(3)]
    stored = prefixtrie.shards(spark.createDataFrame(rows, TURNS)).collect()
    assert sum(r.n_nodes for r in stored) == 4 + 80 and len(stored) == 4
    found = set()
    for r in stored:
        trie = prefixtrie.load_shard(bytes(r.louds), bytes(r.labels), r.n_nodes)
        assert (trie.parents() < np.arange(len(trie))).all()
        for c in range(40):
            path = [np.frombuffer(hashlib.sha256(f"4:user{x}".encode()).digest()[:16], "<u8") for x in (f"{c % 4}-0", f"{c}-1")]
            if (at := trie.find(np.array(path))) >= 0:
                found.add((c, r.conv_ids[at]))
    assert found == {(c, c) for c in range(40)}


def test_louds_rolls_up_like_recursion():
    rng = np.random.default_rng(4)
    up = np.array([-1, -1, *(rng.integers(0, k) for k in range(2, 300))])
    depth = np.zeros(300, dtype=np.int64)
    for k in range(2, 300):
        depth[k] = depth[up[k]] + 1
    label = rng.integers(0, 1 << 60, (300, 2)).astype(np.uint64)
    trie, order = prefixtrie.Louds.build(depth, np.arange(300), up, label)
    value = rng.integers(0, 9, 300)
    want = value.copy()
    for k in range(299, 1, -1):
        want[up[k]] += want[k]
    assert (trie.roll_up(value[order]) == want[order]).all()
    assert (trie.n_children() == np.bincount(up[2:], minlength=300)[order]).all()
