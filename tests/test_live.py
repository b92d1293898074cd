"""What happens while it runs: upload progress, numbered turns, live events, streamed answers, racing writers."""

from __future__ import annotations

import json
import os
import random
import time
import uuid

import pytest

from tessella import plugins
from tessella.conf import EngineConf
from tessella.operators import chats, ingest, store, structure
from tessella.streaming import events as E
from tessella.streaming import progress as P

NONE = dict.fromkeys(("doc_id", "stage", "done", "total", "chunks", "reason", "message", "ms"))


def event(seq, type_, **more):
    return NONE | {"seq": seq, "type": type_} | more


def shown(files, events):
    rows = {f: (f, "queued", None, None, None, None, None, None) for f in files}
    active, label, migrated = files[0], files[0], False
    for e in events:
        active, label, migrated, _ = P.take_over(rows, active, label, migrated, set(files), e)
    return {k: v[:2] for k, v in rows.items()}


def test_first_id_takes_over_the_file_row_and_later_ones_get_their_own():
    got = shown(["a.zip", "b.md"], [event(0, "status", doc_id="a.zip", stage="parsing"), event(1, "status", doc_id="x1", stage="chunking"), event(2, "done", doc_id="x1"), event(3, "skipped", doc_id="x2")])
    assert got == {"x1": ("a.zip", "ready"), "x2": ("a.zip", "skipped"), "b.md": ("b.md", "queued")}
    got = shown(["a", "b"], [event(0, "status", doc_id="b", stage="parsing"), event(1, "error"), event(2, "status", doc_id="y", stage="embedding"), event(3, "ping", doc_id="z"), event(4, "done")])
    assert got == {"a": ("a", "queued"), "y": ("b", "ready")}


def run_uploads(spark, tmp_path, batches):
    """Batches as files of a folder, a micro-batch each."""
    landing, root = tmp_path / uuid.uuid4().hex, tmp_path / uuid.uuid4().hex
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, P.UPLOAD_EVENT).coalesce(1).write.json(str(landing / f"{k}"))
    stream = spark.readStream.schema(P.UPLOAD_EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(landing))
    sink = E.BatchSink(spark, str(root / "out"))
    P.run_to_end(P.upload_progress(stream), str(root / "cp"), sink)
    return {(r.upload, r.key): (r.label, r.stage, r.done, r.chunks, r.error) for r in P.shown_rows(sink.read(P.PROGRESS)).collect()}


def test_progress_is_the_same_however_events_are_cut_into_batches_and_replayed(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for seq in range(120):
        e = event(seq, rng.choice(["status", "status", "done", "skipped", "error", "other"]), doc_id=rng.choice([None, "f1", "f2", "d1", "d2", "d3"]), stage=rng.choice([None, "chunking", "embedding"]), done=rng.choice([None, 3]), chunks=rng.choice([None, 5]), message="m")
        rows.append((rng.randrange(3), seq, ["f1", "f2"], *(e[k] for k in ("doc_id", "type", "stage", "done", "total", "chunks", "reason", "message", "ms"))))
    want = {}
    for u in range(3):
        held, active, label, migrated = {f: (f, "queued", *[None] * 6) for f in ("f1", "f2")}, "f1", "f1", False
        for r in (r for r in rows if r[0] == u):
            active, label, migrated, _ = P.take_over(held, active, label, migrated, {"f1", "f2"}, dict(zip(("upload", "seq", "files", "doc_id", "type", "stage", "done", "total", "chunks", "reason", "message", "ms"), r, strict=True)))
        want |= {(u, k): (v[0], v[1], v[2], v[4], v[6]) for k, v in held.items()}
    assert run_uploads(spark, tmp_path, [rows[:40], rows[:40] + rows[40:80], rows[30:120]]) == want


def test_interleaved_writers_lose_nothing(spark, tmp_path):
    """A second writer comes between the first one's read and its write."""
    a, b = (chats.ChatStore(spark, str(tmp_path / "c")) for _ in range(2))
    assert a.append("x", "user", "zero", "2024-01-01 00:00:00") == 0
    read, meddled = a.turns.snapshot, []

    def meddle(*args, **kw):
        got = read(*args, **kw)
        if not meddled:
            meddled.append(b.append("x", "user", "between", "2024-01-01 00:00:01"))
        return got

    a.turns.snapshot = meddle
    assert a.append("x", "user", "late", "2024-01-01 00:00:02") == 2 and meddled == [1]
    a.turns.snapshot = read
    assert [r.content for r in a.get("x").collect()] == ["zero", "between", "late"]
    _, at = a.turns.snapshot(chats.TURN_SCHEMA)
    b.append("y", "user", "other", "2024-01-01 00:00:03")
    with pytest.raises(store.ConflictError):
        a.turns.upsert(a.get("x"), after=at)


DOC = "doc_id string, markdown string, title string, filename string, source_url string, error string"


def doc(i, text="Some text", url=None, name=None, error=None):
    return (i, f"# T\n\n{text} {i if url is None else ''} that is long enough to make a chunk, surely it is so.", "T", name, url, error)


def picky(texts):
    if any("refuse" in t for t in texts):
        raise ValueError("refused")
    return [[1.0, 0.0]] * len(texts)


def test_one_bad_document_fails_alone_and_events_tell_it(spark, tmp_path):
    eng = ingest.Ingestor(spark, str(tmp_path / "kb"), EngineConf(embedding_dimensions=2), picky)
    sink = E.BatchSink(spark, str(tmp_path / "ev"))
    batch = spark.createDataFrame([doc("a"), doc("b", "refuse this"), doc("c", error="HTTP 404"), doc("d", "same", url="u"), doc("e", "changed", url="u"), doc("f", name="n.md"), doc("g", name="n.md")], DOC)
    got = {r.id.split("-")[0]: (r.chunks, r.skipped, r.error) for r in eng.ingest(batch, tell=sink.tell(0)).collect()}
    assert got == {"a": (1, False, None), "b": (0, False, "refused"), "c": (0, False, "HTTP 404"), "e": (1, False, None), "g": (1, False, None)} | {k: v for k, v in got.items() if v[1]}
    assert {r.id.split("-")[0]: r.status for r in eng.documents().collect()} == {"a": "ready", "b": "failed", "e": "ready", "g": "ready"}
    assert eng.store.count() == 3
    told = sorted((r.doc_id, r.seq, r.type) for r in sink.read(ingest.INGEST_EVENT).collect())
    assert [t for t in told if t[0] in "bcd"] == [("b", 0, "status"), ("b", 2, "status"), ("b", 4, "error"), ("c", 0, "error"), ("d", 0, "status"), ("d", 1, "skipped")]
    again = {r.id.split("-")[0]: (r.chunks, r.skipped) for r in eng.ingest(spark.createDataFrame([doc("a2", "Some text a").__class__(("z",) + doc("a")[1:])], DOC)).collect()}
    assert again == {"a": (1, True)}  # the identical document's own id and chunks


def test_a_stage_that_fails_leaves_the_events_before_it(spark, tmp_path):
    eng = ingest.Ingestor(spark, str(tmp_path / "kb"), EngineConf(embedding_dimensions=2), picky)
    eng.store.upsert = lambda rows: (_ for _ in ()).throw(RuntimeError("store is down"))
    sink = E.BatchSink(spark, str(tmp_path / "ev"))
    with pytest.raises(RuntimeError, match="store is down"):
        eng.ingest(spark.createDataFrame([doc("a")], DOC), tell=sink.tell(3))
    assert [r.stage for r in sink.read(ingest.INGEST_EVENT).orderBy("seq").collect()] == ["parsing", "chunking", "embedding"]
    assert eng.documents().count() == 0


def test_embedding_errors_are_rows_and_calls_are_not_repeated_for_good_ones(spark):
    rows = spark.createDataFrame([(i, "refuse" if i == 3 else f"t{i}") for i in range(10)], "i long, t string").coalesce(1)
    out = {r.i: (r.embedding, r.why) for r in plugins.embed_column(rows, "t", picky, EngineConf(embedding_dimensions=2, embed_batch_size=4), errors="why", rows=10).collect()}
    assert out[3] == (None, "refused") and all(out[i] == ([1.0, 0.0], None) for i in range(10) if i != 3)
    with pytest.raises(Exception, match="refused"):
        plugins.embed_column(rows, "t", picky, EngineConf(embedding_dimensions=2)).collect()
    assert plugins.embed_column(rows, "t", picky, rows=9_000).rdd.getNumPartitions() == 5


def test_streamed_answers_call_nothing_for_gated_or_blank_questions(spark):
    def generate(prompt):
        if "gated" in prompt or "blank" in prompt:
            raise AssertionError
        yield "One [1], "
        yield "two [7] ."
        if "breaks" in prompt:
            raise RuntimeError("lost")

    rows = [(1, "open", False, "c", [1, 2]), (2, "gated", True, None, None), (3, " ", False, "blank", [1]), (4, "breaks", False, "c", [1])]
    got = {}
    for r in chats.stream_answers(spark.createDataFrame(rows, "qid long, question string, gated boolean, context string, valid array<int>"), generate).orderBy("qid", "seq").collect():
        got.setdefault(r.qid, []).append((r.event, r.text))
    assert got[1] == [("meta", "open"), ("token", "One [1], "), ("token", "two [7] ."), ("answer", "One [1], two."), ("citations", "1"), ("done", "")]
    assert got[2] == [("meta", "gated"), ("answer", chats.REFUSAL), ("citations", ""), ("done", "")]
    assert got[3] == [("error", "a question is required")]
    assert got[4] == [("meta", "open"), ("token", "One [1], "), ("token", "two [7] ."), ("error", "lost")]


def test_history_keeps_the_last_lines_in_order(spark):
    turns = [("c", t, "user" if t % 2 == 0 else "assistant", None if t == 3 else " " if t == 4 else f"m{t}") for t in range(12)] + [("d", 0, "user", "x")]
    t = spark.createDataFrame(turns, "chat_id string, turn long, role string, content string")
    q = spark.createDataFrame([("c", 0, "q0"), ("c", 2, "q2"), ("c", 12, "q12"), ("d", 1, "qd"), ("e", 5, "none")], "chat_id string, turn long, question string")
    got = {(r.chat_id, r.turn): r.history for r in chats.render_history(t, q).collect()}
    say = lambda *n: "\n".join(("User: " if x % 2 == 0 else "Assistant: ") + f"m{x}" for x in n)
    assert got == {("c", 0): None, ("c", 2): say(0, 1), ("c", 12): say(6, 7, 8, 9, 10, 11), ("d", 1): "User: x", ("e", 5): None}


def test_orphaned_folders_go_when_a_version_is_published(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ORPHAN_SECONDS", -10)
    t = store.VersionedTable(spark, str(tmp_path / "t"), "id", buckets=2)
    t.upsert(spark.range(5).toDF("id"))
    (tmp_path / "t" / "v-lost").mkdir()
    for k in range(4):
        t.upsert(spark.range(k, k + 1).toDF("id"))
    assert not (tmp_path / "t" / "v-lost").exists() and t.read().count() == 5


def test_sessions_and_frames_of_a_stream(spark):
    turns = spark.createDataFrame([("a", 0, "m", "user", "x"), ("a", 1, "n", "assistant", "y")], P.NUMBERED)
    assert [tuple(r) for r in P.sessions_of(turns).collect()] == [("a", 2, "assistant")]
    frames = E.write_frames(spark.createDataFrame([("done", 1)], "type string, seq long")).first().frame
    assert E.parse_frames(spark.createDataFrame([("s", frames)], "stream_id string, body string"), "seq long").first().data.seq == 1


def test_citations_of_titles_whose_capitals_are_one_letter_or_several(spark, tmp_path):
    from tessella.plans import catalogue, live  # noqa: F401

    from .oracle import compare

    titles = ["Enä, lichüß", "Beß die", "ᾳβ ŉa", "straße ﬁn", "Straße", "STRASSE a", "ǰa ΐ"]
    rows = [(3 * i + j, t, "s") for i, t in enumerate(titles) for j in range(2)] + [(3 * i + 90, t, "s") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    compare(catalogue.queries()["collated_citations"](spark, str(tmp_path)), catalogue.oracle_sql()["collated_citations"], str(tmp_path))


def test_an_upload_reads_and_writes_its_state_once_a_batch():
    class Value:
        held, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return value

    value = Value()
    p = P.UploadProgress()
    p.init(Handle())
    sent = [event(k, "status", files=["f"], doc_id=f"d{k}", stage="chunking", done=k) for k in range(40)]
    send = lambda some: [(r.key, r.gone, r.label, r.done) for r in p.handleInputRows((1,), iter([(1, json.dumps(e)) for e in some]), None)]
    got = send(sent[:20] + sent[:20])
    assert len(got) == 21 and ("f", True, None, None) in got and ("d0", False, "f", 0) in got and value.calls == ["get", "update"]
    assert send(sent[:20]) == [] and value.calls == ["get", "update", "get"]
    assert len(send(sent[30:] + sent[20:30])) == 20 and len(value.held[-1]) == 40


def test_a_common_word_is_hashed_once_by_a_worker(monkeypatch):
    plugins._word_hash.cache_clear()
    md5, made = plugins.hashlib.md5, []
    monkeypatch.setattr(plugins.hashlib, "md5", lambda b: made.append(b) or md5(b))
    got = plugins.hash_embedder(8)(["Same same WORD", "word", "", "same"])
    assert sorted(made) == [b"same", b"word"]
    cell = {w: int(md5(w.encode()).hexdigest()[:8], 16) % 8 for w in ("same", "word")}
    plain = [0.0] * 8
    for w in ("same", "same", "word"):
        plain[cell[w]] += 1
    assert got[0] == pytest.approx([x / sum(y * y for y in plain) ** 0.5 for x in plain]) and got[2] == [0.0] * 8 and got[3][cell["same"]] == 1


def test_what_to_ingest_is_found_without_the_texts_and_lines_are_dealt_in_whole_rounds(spark, monkeypatch):
    rows = spark.createDataFrame([("b", "h"), ("a", "h"), ("c", "k"), ("d", "r")], "doc_id string, content_hash string")
    known = spark.createDataFrame([("r", "ready")], "content_hash string, status string")
    todo, skipped = ingest.skip_known(rows, known)
    assert sorted(r.doc_id for r in todo.collect()) == ["a", "c"] and sorted(r.doc_id for r in skipped.collect()) == ["b", "d"]
    monkeypatch.setattr(structure, "PART_CHARS", 10)
    docs = spark.range(5).selectExpr("repeat('x', 9) as markdown")  # 45 characters are 5 parts
    cores = spark.sparkContext.defaultParallelism
    assert structure.parts_of(docs) == -(-5 // cores) * cores and structure.parts_of(docs.limit(0)) == cores


def test_a_run_holds_one_copy_of_its_texts_and_no_shuffle_files_of_steps_that_are_over(spark, tmp_path):
    eng = ingest.Ingestor(spark, str(tmp_path / "kb"), EngineConf(embedding_dimensions=2), picky)
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f.split("_")[1] for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    name, before, held = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffled(), {}

    def tell(stage, events):
        for _ in range(50):  # removal is not waited for
            left = len(shuffled() - before)
            if not left:
                break
            time.sleep(0.1)
        held[stage] = {f for r in (tmp_path / "kb" / "runs").iterdir() for f in os.listdir(r)}, left, spark.conf.get(name)

    usual = spark.conf.get(name)
    batch = [doc(f"d{k}", "refuse this" if k == 3 else "Some text") for k in range(9)]
    eng.ingest(spark.createDataFrame(batch, DOC), tell=tell)
    texts = {"parsed", "source", "chunks", "embedded"}
    assert [held[s][0] & texts for s in ("skip", "chunk", "embed", "done")] == [{"parsed"}, {"chunks"}, {"embedded"}, set()]
    # A task that Spark cancelled late may leave the files of a shuffle behind.
    assert {on for _, _, on in held.values()} == {"true"} and spark.conf.get(name) == usual and max(left for _, left, _ in held.values()) <= 2
    (run,) = (tmp_path / "kb" / "runs").iterdir()
    assert os.listdir(run) == ["results"] and eng.store.count() == 8 and not [f for f in os.listdir(tmp_path / "kb" / "chunks") if f.startswith("s-")]


def test_rows_of_new_keys_come_beside_a_bucket_and_a_mutation_deals_rows_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SMALL_BYTES", -1)
    t, want, rng = store.VersionedTable(spark, str(tmp_path / "t"), "id", buckets=4, dealt_by="doc"), {}, random.Random(3)
    kind = "id long, doc long, v long"
    rows = lambda ids, v: spark.createDataFrame([(i, i // 3, v) for i in ids], kind)
    t.upsert(rows(range(40), 0))
    want |= dict.fromkeys(range(40), 0)
    first = t._paths(t._pointer())
    t.upsert(rows([*range(40, 80), 41], 1))
    want |= dict.fromkeys(range(40, 80), 1)
    assert set(first) < set(t._paths(t._pointer()))  # nothing was rewritten
    for v in range(2, 8):
        ids, gone = [rng.randrange(120) for _ in range(rng.choice([1, 9]))], [rng.randrange(120) for _ in range(3)]
        t.upsert(rows(ids, v), drop=rows(gone, 0).select("id", "doc") if v % 2 else None)
        want = {k: x for k, x in want.items() if not (v % 2 and k in gone)} | dict.fromkeys(ids, v)
        assert {r.id: r.v for r in t.read().collect()} == want and t.read().count() == len(want)
    docs = [rng.randrange(40) for _ in range(8)]
    t.delete_matching(spark.createDataFrame([(d,) for d in docs], "doc long"), "doc")
    assert {r.id: r.v for r in t.read().collect()} == {k: x for k, x in want.items() if k // 3 not in docs}
    monkeypatch.setattr(store, "MOST_PIECES", 2)  # a bucket of many folders is one again
    for k in range(3):
        t.upsert(rows(range(1000 + 40 * k, 1040 + 40 * k), 9))
    assert max(len(b["paths"]) for b in t._pointer()["buckets"].values()) <= 2
    assert t.read().columns == ["id", "doc", "v"] and t.read().where("id >= 1000").count() == 120
    plans, rewrite = [], t._rewrite
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(t, "_rewrite", lambda rows, touched, at, n, into, left: rewrite(rows, touched, at, n, into, lambda dealt: planned(left(dealt))))
    t.upsert(rows(range(0, 9), 10), drop=rows([1000], 0).select("id", "doc"))
    t.delete_matching(spark.createDataFrame([(2,)], "doc long"), "doc")
    assert [p.count("Exchange ") for p in plans] == [1, 1]
    monkeypatch.setattr(store, "ROUND_BYTES", 0)  # a bucket at a time, in one version
    monkeypatch.setattr(store, "ROUND_TASKS", 0)
    version, had = t._pointer()["version"], {r.id: r.v for r in t.read().collect()}
    t.delete_matching(spark.createDataFrame([(d,) for d in range(333, 347)], "doc long"), "doc")
    assert len(plans) > 3 and {p.count("Exchange ") for p in plans} == {1} and t._pointer()["version"] == version + 1
    assert {r.id: r.v for r in t.read().collect()} == {k: v for k, v in had.items() if not 333 <= k // 3 < 347} and len(t.read().collect()) < len(had)
    assert sorted((r.id, r.v) for r in t.read().where("id < 9 or id = 1000").collect()) == [(i, 10) for i in range(6)]
    assert {p.rsplit("/", 2)[1] for p in t._paths(t._pointer())} <= {f for f in os.listdir(tmp_path / "t") if f.startswith("v-")}


def test_chunks_of_a_refused_document_stay_out_without_an_exchange_of_texts_for_it(spark, tmp_path, monkeypatch):
    eng = ingest.Ingestor(spark, str(tmp_path / "kb"), EngineConf(embedding_dimensions=2, max_chunk_tokens=20), picky)
    long = lambda i, n, bad=None: (i, "# T\n\n" + "\n\n".join(f"{'refuse' if k == bad else 'keep'} paragraph {k} of {i}, of some fifteen tokens or a few more" for k in range(n)), "T", None, f"u/{i}", None)
    plans, rewrite = [], eng.store.table._rewrite
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(eng.store.table, "_rewrite", lambda rows, touched, at, n, into, left: rewrite(rows, touched, at, n, into, lambda dealt: planned(left(dealt))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.id.split("-")[0]: (r.chunks, r.error) for r in eng.ingest(spark.createDataFrame([long("a", 4), long("b", 4, 2), long("c", 1, 0)], DOC)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {"a": (4, None), "b": (0, "refused"), "c": (0, "refused")}
    assert {(r.document_id.split("-")[0], r.ordinal) for r in eng.store.rows().collect()} == {("a", k) for k in range(4)}
    (plan,) = plans
    assert "LeftAnti" not in plan and plan.count("Exchange hashpartitioning(_bucket") == 1 and plan.count("Exchange hashpartitioning(") == 3  # two of ids
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v string")
    t = store.VersionedTable(spark, str(tmp_path / "t"), "id", buckets=2)
    t.upsert(rows(range(4), "old"))
    new, path = t._staged(rows([2, 2, 3, 4, 5], "new"))
    t.upsert(store.Written(new, path, rows([3, 5, 9], "").select("id")), drop=rows([0, 4], "").select("id"))
    assert sorted((r.id, r.v) for r in t.read().collect()) == [(1, "old"), (2, "new"), (3, "old"), (4, "new")]
