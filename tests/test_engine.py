from __future__ import annotations

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella import plugins
from tessella.conf import EngineConf
from tessella.functions import text as X
from tessella.functions import vectors as V
from tessella.operators import chats, chunking, ingest, retrieval, store, structure
from tessella.sources import files
from tessella.sources.html import html_to_markdown, tidy
from tessella.streaming import events as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_conf_rejects_what_is_out_of_range():
    for bad in ({"min_score": math.nan}, {"top_k": 0}, {"max_chunk_tokens": -1}, {"vector_store": "other"}):
        with pytest.raises(ValueError):
            EngineConf(**bad)
    assert EngineConf.from_env({"TOP_K": "3", "MIN_SCORE": "0.2"}).top_k == 3
    with pytest.raises(ValueError):
        EngineConf.from_env({"TOP_K": "three"})
    assert EngineConf().overlap_tokens == 67


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("## A\n\n# a\nbody", "# a\nbody"),
        ("reCAPTCHA\r\n# T\r\nx  \n\n\n\ny", "# T\nx\n\ny"),
        ("text\n\n### Deep\n\n## Next", "text\n\n# Deep\n\n## Next"),
        ("no heading", "no heading"),
        ("## Other\n\n# Title", "## Other\n\n# Title".replace("## Other", "# Other", 1)),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, X.normalize_markdown(F.lit(raw))) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Acceptable Use", True), ("Purpose of this privacy policy", True), ("1\\. Important information and who we are?", True),
        ("We sell gold, silver and more", False), ("This ends here.", False), ("POSTAL", False), ("Postal address: 1 Road", False),
        ("- Item One", False), ("**Bold All**", False), ("| a | b |", False), ("See [Link](u)", False), ("ab", False), ("# Already", False), ("x" * 91, False),
    ],
)
def test_heading_shapes(spark, line, want):
    assert one(spark, X.looks_like_heading(F.lit(line))) is want


def doc(spark, md, title="T", url="https://e.org/t"):
    return spark.createDataFrame([(1, md, title, url)], "doc_id long, markdown string, title string, source_url string")


LONG = "word " * 150  # 188 tokens


def test_chunks_of_every_kind(spark):
    md = "\n\n".join([
        "# T", "- [First Part](u#one)\n- [Hours Table](u#two)", "First Part", "Intro text long enough to be kept as a prose chunk of its own.",
        "Can I pay?", "Yes.", "Is it safe?", "Hours Table", "Caption before the table goes along with it.",
        "| a | b |\n| --- | --- |\n| 1 | long enough cell text to keep it |", "After the table comes a paragraph that is long enough to stay.",
        "1\\. Long Section", LONG, LONG, "short tail that carries over", LONG, "Sub Part", "Some closing text that is long enough to be kept here.",
    ])
    rows = chunking.chunk_documents(doc(spark, md)).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(rows)))
    kinds = [(r.kind, r.part_index, r.part_count) for r in rows]
    assert kinds == [("prose", None, None), ("qa", None, None), ("qa", None, None), ("table", None, None), ("clause", None, None), ("clause", 0, 2), ("clause", 1, 2), ("clause", None, None)]
    assert rows[1].text == "Can I pay?\n\nYes." and rows[1].question == "Can I pay?"
    assert rows[2].text == "Is it safe?"
    assert rows[0].heading_path == ["T", "First Part"] and rows[0].anchor == "one"
    assert rows[3].text.startswith("Caption before") and rows[3].anchor == "two"
    assert rows[6].text.startswith("short tail") and "short tail" in rows[5].text
    assert rows[7].heading_path == ["T", "1. Long Section", "Sub Part"]
    fam = chunking.family_integrity(chunking.chunk_documents(doc(spark, md))).collect()
    assert [f.whole for f in fam] == [True]


def test_fences_and_links_only(spark):
    md = "# T\n\n```\n\nLooks Like Heading\n\ntext\n```\n\nReal Heading\n\nbody"
    lines = structure.promote(structure.heading_candidates(structure.doc_lines(doc(spark, md).select("doc_id", "markdown"))))
    assert [r.promoted for r in lines.where("promoted is not null").collect()] == ["Real Heading"]
    links = "\n".join(f"- [L{i}](u#{i})" for i in range(70))
    toc = structure.mark_toc(doc(spark, links).select("doc_id", "markdown"))
    assert toc.where("is_toc").count() == 61


def test_empty_documents_have_no_chunks(spark):
    rows = spark.createDataFrame([(1, None, "T", None), (2, "", "T", None), (3, " \n ", "T", None)], "doc_id long, markdown string, title string, source_url string")
    assert chunking.chunk_documents(rows).count() == 0


@pytest.mark.parametrize(
    ("answer", "want", "used"),
    [("A [1].", "A [1].", [1]), ("A [1, 9] b", "A [1] b", [1]), ("A [01]", "A [1]", [1]), ("In [2004] x", "In [2004] x", []), ("A [9].  b", "A. b", []), ("[3,1] x", "[3][1] x", [1, 3])],
)
def test_citations(spark, answer, want, used):
    a = spark.createDataFrame([(1, answer)], "qid long, answer string")
    c = spark.createDataFrame([(1, n) for n in (1, 2, 3)], "qid long, n int")
    r = chats.validate(a, c).first()
    assert (r.answer, list(r.used)) == (want, used)


def test_vectors(spark):
    assert one(spark, V.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0.0
    assert one(spark, V.conform(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2)) == [0.6, 0.8]
    assert one(spark, V.conform(F.array(F.lit(0.0), F.lit(0.0)), 2)) == [0.0, 0.0]
    with pytest.raises(Exception, match="shorter"):
        one(spark, V.conform(F.array(F.lit(1.0)), 2))


def vec(i, d=16):
    v = [math.sin((i + 1) * (k + 1)) for k in range(d)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def test_store_contract(spark, tmp_path):
    conf = EngineConf(embedding_dimensions=16)
    s = store.open_store(spark, str(tmp_path / "chunks"), conf)
    assert s.count() == 0 and s.dimensions() is None
    row = lambda i, doc, o, text="t": (f"c{i}", doc, o, text, "clause", ["T", f"S{i}"], None, None, 0 if i == 2 else None, 2 if i == 2 else None, None, "T", vec(i))
    rows = spark.createDataFrame([row(0, "d1", 0), row(1, "d1", 1), row(2, "d2", 0)], store.CHUNK_SCHEMA)
    s.upsert(rows)
    assert s.count() == 3 and s.dimensions() == 16
    q = spark.createDataFrame([(7, vec(1))], "qid long, qvec array<double>")
    hits = s.search(q, 3).orderBy("rank").collect()
    assert hits[0].id == "c1" and hits[0].score > 0.99 and hits[0].heading_path == ["T", "S1"] and hits[0].part_index is None
    assert {h.id for h in s.search(q, 3, "d2").collect()} == {"c2"}
    assert [r.id for r in s.get_by_ordinal_range("d1", 0, 1).collect()] == ["c0", "c1"]
    s.upsert(spark.createDataFrame([row(1, "d1", 1, "new")], store.CHUNK_SCHEMA))
    assert s.count() == 3 and s.get_by_ids(spark.createDataFrame([("c1",)], "id string")).first().text == "new"
    s.delete_by_document("d1")
    assert s.count() == 1
    back = store.from_row(store.to_row(s.rows().drop("embedding"))).first()
    assert back.anchor is None and back.part_index == 0 and back.heading_path == ["T", "S2"]


def test_search_ties_and_wrong_length(spark):
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(99, None)], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "qid long, qvec array<double>")
    assert [r.id for r in retrieval.search(q, c, 3).orderBy("rank").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="dimensions"):
        retrieval.search(spark.createDataFrame([(1, [1.0])], "qid long, qvec array<double>"), c, 3).collect()
    assert retrieval.search(q.limit(0), c, 3).count() == 0


def test_gate_edge(spark):
    hits = spark.createDataFrame([(1, 5, 0.55), (1, 6, 0.1), (2, 7, 0.54)], "qid long, id long, score double")
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    head, kept = retrieval.gate(hits, q)
    assert {r.qid: r.gated for r in head.collect()} == {1: False, 2: True, 3: True}
    assert {r.id for r in kept.collect()} == {5, 6}


def test_budget_skips_and_keeps_the_best(spark):
    rows = [(1, i, s, "x" * (4 * t)) for i, s, t in ((1, 0.9, 4960), (2, 0.8, 1960), (3, 0.7, 860))]
    d = spark.createDataFrame(rows, "qid long, id long, score double, text string")
    assert {r.id for r in retrieval.select_budget(d).collect()} == {1, 3}
    huge = spark.createDataFrame([(1, 1, 0.9, "x" * 40_000)], "qid long, id long, score double, text string")
    assert retrieval.select_budget(huge).count() == 1


def test_html():
    html = "<html><head><title>A  B</title><script>var x='</p>'</script></head><body><nav>menu</nav><h1>Get in<br>touch</h1><p>One <b>two</b> &amp; three<ul><li>a<li>b</ul><dl><dt>Mon<dt>Tue<dd>9<dd>10</dl><div class='Breadcrumb'>x</div><div aria-hidden=true>y</div><table><tr><th>k<th>v<tr><td>1<td>2</table>"
    md = html_to_markdown(html, page=True)
    assert md.startswith("# Get in touch") and "**two** & three" in md and "- a\n- b" in md
    assert "- Mon: 9\n- Tue: 10" in md and "| k | v |\n| --- | --- |\n| 1 | 2 |" in md
    assert "menu" not in md and "\ny" not in md and "var x" not in md
    assert html_to_markdown(None) == "" and html_to_markdown("<script>x</script>") == ""
    assert tidy("[ ](u)a\n* * *\n# H\n# H\nLoading...") == "a\n# H"


def docx(*paras):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paras)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_parse_files_and_ingest(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    page = {"markdown": "# Policy\n\nSome text that is long enough to make a chunk, surely it is.", "metadata": {"sourceURL": "https://e.org/p", "statusCode": 200}}
    (d / "a.json").write_text(json.dumps(page))
    (d / "b.json").write_text(json.dumps(page | {"metadata": {"statusCode": 404}}))
    (d / "c.txt").write_text("Plain text that is long enough to make a chunk, surely it is so.")
    (d / "d.docx").write_bytes(docx(("Heading1", "Doc"), ("", "A paragraph that is long enough to make a chunk, surely it is.")))
    (d / "e.pdf").write_bytes(b"%PDF")
    (d / "f.exe").write_bytes(b"x")
    with zipfile.ZipFile(d / "g.zip", "w") as z:
        z.writestr("in/h.html", "<title>H</title><p>An HTML text that is long enough to make a chunk, surely it is.</p>")
        z.writestr("__MACOSX/._h.html", "x")
        z.writestr("skip.bin", "x")
    parsed = files.parse_files(files.read_files(spark, str(d)))
    by = {r.filename: r for r in parsed.collect()}
    assert set(by) == {"a.json", "b.json", "c.txt", "d.docx", "e.pdf", "h.html"}
    assert by["a.json"].title == "Policy" and by["a.json"].source_url == "https://e.org/p"
    assert "404" in by["b.json"].error and "PDF" in by["e.pdf"].error and by["d.docx"].markdown.startswith("# Doc\n\nA paragraph")
    env = {r.filename: r for r in files.read_envelopes(spark, str(d / "*.json")).collect()}
    assert env["a.json"].title == "Policy" and "404" in env["b.json"].error

    eng = ingest.Ingestor(spark, str(tmp_path / "kb"), EngineConf(embedding_dimensions=32))
    got = {r.outcome: r.n for r in ingest.seed_totals(eng.ingest(parsed)).collect()}
    assert got == {"ok": 4, "refused": 1, "failed": 1}
    assert eng.store.count() == 4 and eng.documents().where("status = 'ready'").count() == 4
    again = {r.outcome: r.n for r in ingest.seed_totals(eng.ingest(parsed)).collect()}
    assert again["skipped"] == 4 and eng.store.count() == 4
    (d / "a.json").write_text(json.dumps(page | {"markdown": "# Policy\n\nAnother text that is long enough to make a chunk, surely it is."}))
    eng.ingest(files.parse_files(files.read_files(spark, str(d), "a.json")))
    assert eng.store.count() == 4 and eng.documents().count() == 4
    assert eng.store.rows().where("text like 'Another%'").count() == 1

    queries = plugins.embed_column(spark.createDataFrame([(1, "Policy another text")], "qid long, question string"), "question", plugins.hash_embedder(32), eng.conf, "qvec")
    head, found = retrieval.retrieve(queries, eng.store.rows(), EngineConf(embedding_dimensions=32, min_score=0.1))
    assert not head.first().gated
    texts = found.join(eng.store.rows().drop("document_id", "ordinal", "embedding"), "id")
    ctx = retrieval.build_context(texts, eng.conf).withColumn("question", F.lit("q")).withColumn("gated", F.lit(False))
    ans = chats.answer(ctx, plugins.extractive_chat)
    cites = ctx.select("qid", F.explode("citations").alias("c")).select("qid", "c.n")
    r = chats.validate(ans, cites).first()
    assert r.answer.endswith("[1]") and list(r.used) == [1]


def test_embedding_port():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise RuntimeError("429 rate limit")
        return [[1.0]] * len(texts)

    assert plugins.with_retry(flaky, 2, sleep=lambda s: None)(["a"]) == [[1.0]] and len(calls) == 2
    with pytest.raises(KeyError):
        plugins.with_retry(lambda t: {}[t], 2, sleep=lambda s: None)("x")


def test_condense_and_refusal(spark):
    t = spark.createDataFrame([("c", 0, "user", "first"), ("c", 1, "assistant", "reply"), ("c", 2, "user", "and then?")], "chat_id string, turn long, role string, content string")
    q = t.where("role = 'user'").select("chat_id", "turn", F.col("content").alias("question"))
    got = {r.turn: r.condensed for r in chats.condense(t, q, lambda p: '"rewritten query"\nmore').collect()}
    assert got == {0: "first", 2: "rewritten query"}

    def fail(prompt):
        raise RuntimeError

    assert {r.turn: r.condensed for r in chats.condense(t, q, fail).collect()}[2] == "and then?"
    ctx = spark.createDataFrame([(1, "q", True, None)], "qid long, question string, gated boolean, context string")
    assert chats.answer(ctx, fail).first().answer == chats.REFUSAL
    more = chats.append_turn(t, spark.createDataFrame([("c", 0, "assistant", "x")], "chat_id string, seq long, role string, content string"))
    assert more.where("turn = 3").count() == 1
    with pytest.raises(Exception, match="malformed"):
        chats.append_turn(t, spark.createDataFrame([("../c", 0, "user", "x")], "chat_id string, seq long, role string, content string")).collect()


def test_frames(spark):
    body = 'event: token\ndata: {"seq": 1}\n\nevent: bad\ndata: {"seq": \n\nevent: done\ndata: {"seq": 2}\n\n'
    rows = E.parse_frames(spark.createDataFrame([("s", body)], "stream_id string, body string"), "seq long").collect()
    assert [(r.event, r.data.seq) for r in rows] == [("token", 1), ("done", 2)]
    f = spark.createDataFrame([(1, 2, "token", "b"), (1, 1, "token", "a"), (2, 1, "token", "x"), (2, 2, "answer", "final")], "qid long, seq long, event string, text string")
    assert {r.qid: r.answer for r in E.accumulate_answers(f).collect()} == {1: "ab", 2: "final"}


def test_ingest_stream(spark, tmp_path):
    d = tmp_path / "landing"
    d.mkdir()
    (d / "a.txt").write_text("one")
    seen = []
    run = lambda: E.ingest_stream(spark, str(d), str(tmp_path / "cp"), lambda df, n: seen.extend(r.filename for r in files.parse_files(df).collect())).awaitTermination()
    run()
    (d / "b.txt").write_text("two")
    run()
    assert seen == ["a.txt", "b.txt"]


def test_chat_store(spark, tmp_path):
    s = chats.ChatStore(spark, str(tmp_path / "chats"))
    assert s.list().count() == 0
    assert [s.append("a-1", r, c, t) for r, c, t in (("user", "x" * 90, "2024-01-01 10:00:00"), ("assistant", "yes", "2024-01-01 10:01:00"))] == [0, 1]
    s.append("b", "assistant", "hello", "2024-01-01 09:00:00")
    assert [(r.chat_id, r.title) for r in s.list().collect()] == [("a-1", "x" * 70), ("b", "New conversation")]
    s.rename("b", "  My chat ", "2024-01-02 00:00:00")
    assert [(r.chat_id, r.title) for r in s.list().collect()] == [("b", "My chat"), ("a-1", "x" * 70)]
    for bad in (lambda: s.rename("b", " ", "2024-01-01 00:00:00"), lambda: s.get("../b")):
        with pytest.raises(ValueError):
            bad()
    s.delete("a-1")
    assert [r.chat_id for r in s.list().collect()] == ["b"] and s.get("a-1").count() == 0


def test_roll_back(spark, tmp_path):
    eng = ingest.Ingestor(spark, str(tmp_path / "kb"), EngineConf(embedding_dimensions=8))
    row = ("d", "# T\n\nSome text that is long enough to make a chunk, surely it is.", "T", "t.md", None, None)
    schema = "doc_id string, markdown string, title string, filename string, source_url string, error string"
    eng.ingest(spark.createDataFrame([row], schema))
    doc_id = eng.documents().first().id
    eng.mark_failed(doc_id, "broken")
    assert eng.store.count() == 0 and (eng.documents().first().status, eng.documents().first().error) == ("failed", "broken")
    assert [r.outcome for r in ingest.seed_totals(eng.ingest(spark.createDataFrame([row], schema))).collect()] == ["ok"]
    assert eng.store.count() == 1


def test_labels_and_blocks(spark):
    assert one(spark, X.answer_blocks(F.lit("Intro.\n\n- a\n- b\n\n\nEnd"))) == [("prose", ["Intro."]), ("list", ["a", "b"]), ("prose", ["End"])]
    assert one(spark, X.answer_blocks(F.lit("Two\nlines\n• a\n* b\n\n- x\ntail"))) == [("prose", ["Two lines"]), ("list", ["a", "b"]), ("prose", ["- x\ntail"])]
    assert one(spark, X.inline_tokens(F.lit("a **b [2]** [10]x **open"))) == [(False, None, "a "), (True, None, "b "), (True, 2, None), (False, None, " "), (False, 10, None), (False, None, "x **open")]
    assert one(spark, X.content_text(F.array(F.struct(F.lit("a").alias("text")), F.struct(F.lit(None).cast("string").alias("text")), F.struct(F.lit("b").alias("text"))))) == "ab"
    assert one(spark, X.relative_day(F.lit("2024-01-01 08:30:00").cast("timestamp"), F.lit("2024-01-02 01:00:00").cast("timestamp"))) == "Yesterday"
    assert one(spark, X.safe_upload_name(F.lit("a/b/we ird$$name.md"))) == "we ird_name.md"
    assert one(spark, X.slug_title(F.lit("https://e.org/a/opening-hours_now/?q=1"))) == "Opening Hours Now"


def test_table_survives_crashes_and_keeps_its_buckets(spark, tmp_path, monkeypatch):
    rows = lambda lo, hi, v: spark.range(lo, hi).select("id", F.lit(v).alias("v"))
    t = store.VersionedTable(spark, str(tmp_path / "t"), "id", buckets=16)
    t.upsert(rows(0, 50, "a"))
    store.VersionedTable(spark, str(tmp_path / "t"), "id", buckets=4).upsert(rows(0, 50, "b"))  # the table's own number holds
    assert t.read().count() == 50 and t.read().where("v = 'b'").count() == 50
    real = store.VersionedTable._publish
    monkeypatch.setattr(store.VersionedTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.upsert(rows(0, 60, "c"))
    monkeypatch.setattr(store.VersionedTable, "_publish", real)
    assert t.read().where("v = 'b'").count() == 50
    stale = t._pointer()
    t.upsert(rows(50, 60, "d"))
    monkeypatch.setattr(t, "_pointer", lambda: stale)
    with pytest.raises(store.ConflictError):
        t.upsert(rows(60, 70, "e"))
    monkeypatch.undo()
    assert t.read().count() == 60
    monkeypatch.setattr(store, "BUCKET_BYTES", 100)  # outgrown: more buckets, nothing lost
    t.upsert(rows(60, 61, "f"), drop=spark.range(0, 10).toDF("id"))
    assert t._pointer()["n"] > 16 and t.read().count() == 51
    t.delete_matching(spark.range(10, 30).toDF("id"), "id")
    t.delete(F.col("v") == "f")
    assert {r.id for r in t.read().collect()} == set(range(30, 60))


def test_each_text_is_embedded_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def embed(texts):
        (log / __import__("uuid").uuid4().hex).write_text(str(len(texts)))
        return [[1.0, float(len(t)), 0.0, 0.0] for t in texts]

    asked = lambda: sum(int(f.read_text()) for f in log.iterdir())
    eng = ingest.Ingestor(spark, str(tmp_path / "kb"), EngineConf(embedding_dimensions=4), embed)
    doc = lambda i, more="": (str(i), f"# T{i}\n\nSome text {i} that is long enough to make a chunk, surely it is{more}.", "T", f"{i}.md", None, None)
    schema = "doc_id string, markdown string, title string, filename string, source_url string, error string"
    eng.ingest(spark.createDataFrame([doc(i) for i in range(20)], schema))
    assert asked() == 20 == eng.store.count()
    eng.ingest(spark.createDataFrame([doc(i, " so" * (i % 2)) for i in range(20)], schema))
    assert asked() == 30 and eng.store.count() == 20 == eng.documents().count()
    assert eng.store.dimensions() == 4
    with pytest.raises(Exception, match="expected 4 dimensions"):
        eng.store.upsert(eng.store.rows().withColumn("embedding", F.array(F.lit(1.0))))
    one = ingest.find(eng.documents(), filename="3.md").collect()
    assert len(one) == 1 and ingest.find(eng.documents(), content_hash=one[0].content_hash).count() == 1


def test_search_ids_ties_and_values_that_never_match(spark):
    c = spark.createDataFrame([(f"k{i:03d}", [1.0, 0.0]) for i in range(300)] + [("nan", [float("nan"), 1.0]), ("null", None), ("part", [None, 1.0]), ("zero", [0.0, 0.0])], "id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "qid string, qvec array<double>")
    got = {(r.qid, r["rank"]): (r.id, r.score) for r in retrieval.search(q, c, 3).collect()}
    assert [got["a", k] for k in (1, 2, 3)] == [(f"k{i:03d}", 1.0) for i in range(3)]
    assert not any(i in ("nan", "null", "part") for i, _ in got.values()) and {x for x, _ in got} == {"a", "b"}


def test_html_of_any_depth():
    from tessella.sources import html as H

    assert H.html_to_markdown("<div>" * 5000 + "<b>deep</b> text" + "</div>" * 5000) == "**deep** text"
    page = "<html><head><title>x</title></head><body><nav>n</nav><h2>A<br>b</h2><p>One <em>two</em> <a href='/u'>three</a>.</p><ol><li>first<ul><li>inner</li></ul></li><li>second</li></ol><table><tr><th>k</th><th>v</th></tr><tr><td>1|2</td><td><b>3</b></td></tr></table><dl><dt>t</dt><dd>d</dd></dl><pre>a\n b</pre></body></html>"
    assert H.html_to_markdown(page, page=True) == (
        "## A b\n\nOne _two_ [three](/u).\n\n1. first\n\n    - inner\n2. second\n\n| k | v |\n| --- | --- |\n| 1\\|2 | **3** |\n\n- t: d\n\n```\na\n b\n```"
    )


def test_batch_sink_and_debug_record(spark, tmp_path):
    sink = E.BatchSink(spark, str(tmp_path / "s"))
    assert sink.read("a long").count() == 0
    for batch, n in ((0, 3), (1, 2), (0, 4)):  # batch 0 again after a lost commit
        sink(spark.range(n).toDF("a"), batch)
    assert sink.read("a long").count() == 6
    q = spark.createDataFrame([(1, "Q?", "q", 0.5, False)], "qid long, question string, condensed string, top_score double, gated boolean")
    hits = spark.createDataFrame([(1, "b", 0.4), (1, "a", 0.5)], "qid long, id string, score double")
    assert chats.debug_record(q, hits).first().record == '{"question":"Q?","condensed":"q","top_score":0.5,"gated":false,"hits":[{"id":"a","score":0.5},{"id":"b","score":0.4}]}'


@pytest.mark.parametrize("sent", [0, 100])
def test_search_in_blocks_is_the_plain_search(spark, monkeypatch, sent):
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "SENT_QUERIES", sent)
    rng = np.random.default_rng(1)
    e = rng.integers(-2, 3, (90, 4)).astype(float)  # many ties
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "id long, embedding array<double>").repartition(4)
    q = spark.createDataFrame([(i, e[i].tolist()) for i in range(0, 90, 4)], "qid long, qvec array<double>").repartition(3)
    got = {}
    for r in retrieval.search(q, c, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.score))
    n = np.linalg.norm(e, axis=1, keepdims=True)
    u = np.divide(e, n, out=np.zeros_like(e), where=n > 0)
    for i in range(0, 90, 4):
        s = np.round(u @ u[i], 12)
        assert [x for x, _ in got[i]] == sorted(range(90), key=lambda j: (-s[j], j))[:5]
    with pytest.raises(Exception, match="dimensions"):
        retrieval.search(q, spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>"), 5).collect()


def test_nested_tables_and_stray_end_tags_in_linear_time():
    import time

    from tessella.sources import html as H

    began = time.perf_counter()
    page = "<table><tr><td>a|b" + "".join(f"<table><tr><td>c{k}</td><td>" for k in range(1000)) + "end" + "</td></tr></table>" * 1000 + "</td><td>y</td></tr></table>"
    out = H.html_to_markdown(page)
    assert out.startswith("| a\\|b c0 c1 ") and out.count("c999") == 1 and len(out) < 7000
    assert H.html_to_markdown("<div>" * 8000 + "</span>" * 8000 + "x") == "x"
    assert H.html_to_markdown("<table><tr><td>1<table><tr><td>in</td><td>ner|</td></tr></table></td><td>z</td></tr><tr><td>2</td></tr></table>") == "| 1 in ner\\| | z |\n| --- | --- |\n| 2 |"
    assert time.perf_counter() - began < 5


def test_normalize_is_linear_in_blanks(spark):
    import time

    began = time.perf_counter()
    cases = [("a" + " " * 1_000_000 + "b", None), ("a" + "\n" * 200_000 + "b", "a\n\nb"), ("a" + " \n" * 100_000 + "## X y\n# X\nb", "a\n# X\nb"), ("\n \n## Same\n\n# The same\nz", "# The same\nz")]
    rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "k int, m string").select("k", X.normalize_markdown(F.col("m")).alias("x")).collect()
    assert {r.k: r.x for r in rows} == {k: want or text for k, (text, want) in enumerate(cases)}
    assert time.perf_counter() - began < 30


def test_lines_are_dealt_over_more_partitions_as_documents_grow(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"# Title {i}\n\nsome line of text\n" * 20) for i in range(40)], "doc_id long, markdown string")
    small = structure.doc_lines(docs)
    monkeypatch.setattr(structure, "PART_CHARS", 1000)
    large = structure.doc_lines(docs)
    assert large.rdd.getNumPartitions() > 20 > small.rdd.getNumPartitions()
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


def test_lines_do_not_carry_the_headings_of_their_document(spark):
    md = "# Doc\n\n- [Doc](http://a#top)\n- [One](http://a#one)\n\n" + "Opening words of the document that are long enough for a chunk.\n\n" + "## One\n\n" + "Words of the first section that are long enough for a chunk to be kept.\n\n" + "".join(f"## Part {k}\n\nx\n\n" for k in range(50))
    rows = spark.createDataFrame([(1, md, "Doc", "http://a"), (2, md, "Other", "http://b")], "doc_id long, markdown string, title string, source_url string")
    out = chunking.chunk_documents(rows)
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.document_id, r.heading_path[-1]): r.anchor for r in out.collect()}
    assert got[1, "Doc"] == "top" and got[1, "One"] == got[2, "One"] == "one"


def test_a_pair_of_full_search_blocks_takes_little_memory(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n = retrieval.BLOCK
    unit = pa.array([np.random.default_rng(0).normal(size=(n, 8)).tobytes()], pa.binary())
    ids = pa.array([list(range(n))], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([x for _ in "qc" for x in (pa.array([0]), pa.array([8]), ids, unit)], names=[f"{s}_{x}" for s in "qc" for x in ("block", "dims", "ids", "unit")])
    tracemalloc.start()
    try:
        out = list(retrieval._score_blocks(8, "qid long, id long, score double")(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out[0].num_rows == 8 * n and peak < 64 << 20
