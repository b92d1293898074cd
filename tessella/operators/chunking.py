"""From paragraphs to chunks: question-answer pairs, whole tables, token-bounded packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, EngineConf
from ..functions import text as X
from . import structure

_BY = ("doc_id", "section")


def pack(items: Column, conf: EngineConf = DEFAULT) -> Column:
    """array<struct<p, tokens>> -> array<array<string>>: first-fit groups of paragraphs.

    A group ends before the paragraph that would exceed the bound; its last paragraph opens the
    next group too when it is within the overlap.  A single paragraph is never cut.  The fold
    runs over one run of one section.
    """
    unit = "struct<p:string,tokens:int>"
    zero = F.expr(f"named_struct('done', cast(array() as array<array<{unit}>>), 'cur', cast(array() as array<{unit}>), 'sum', 0)")

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["cur"]) > 0) & (a["sum"] + x["tokens"] > conf.max_chunk_tokens)
        last = F.element_at(a["cur"], -1)
        carry = full & (last["tokens"] <= conf.overlap_tokens)
        cur = F.when(carry, F.array(last, x)).when(full, F.array(x)).otherwise(F.concat(a["cur"], F.array(x)))
        total = F.when(carry, last["tokens"] + x["tokens"]).when(full, x["tokens"]).otherwise(a["sum"] + x["tokens"])
        done = F.when(full, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"])
        return F.struct(done.alias("done"), cur.alias("cur"), total.alias("sum"))

    groups = F.aggregate(items, zero, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    return F.transform(groups, lambda g: F.transform(g, lambda x: x["p"]))


def marked(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with the shape of their section (qa, table, plain), question group, table run and caption mark."""
    whole = Window.partitionBy(*_BY)
    by = whole.orderBy("ppos")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    questions, tables = F.sum(F.col("is_q").cast("int")).over(whole), F.max(F.col("is_table").cast("int")).over(whole)
    shape = F.when(questions >= 2, "qa").when(tables == 1, "table").otherwise("plain")
    caption = ~F.col("is_table") & F.coalesce(F.lead("is_table").over(by), F.lit(False))
    return (
        paragraphs.withColumn("shape", shape).withColumn("qgroup", F.sum(F.col("is_q").cast("int")).over(run).cast("int"))
        .withColumn("trun", (F.sum(F.col("is_table").cast("int")).over(run) - F.col("is_table").cast("int")).cast("int"))
        .withColumn("caption", (F.col("shape") == "table") & caption)
    )


def drafts(m: DataFrame, conf: EngineConf = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """Marked paragraphs -> drafts: doc_id, section, heading_path, run, slot, part, kind, text, question, part_index, part_count.

    A question takes its whole answer, and what precedes the first question is prose.  A table
    stays whole with the paragraph before as caption.  Other paragraphs are packed, with part
    numbers only where a run needs more than one chunk.  All kinds come from one grouping.
    """
    table = (F.col("shape") == "table") & (F.col("is_table") | F.col("caption"))
    kind = F.when((F.col("shape") == "qa") & (F.col("qgroup") == 0), "prose").when(F.col("shape") == "qa", "qa").when(table, "table").otherwise("clause")
    run = F.when(F.col("shape") == "qa", F.col("qgroup")).otherwise(F.col("trun"))
    keyed = m.withColumns({"kind": kind, "run": run, "slot": F.when(table, 1).otherwise(0)})
    items = F.transform(F.array_sort(F.collect_list(F.struct("ppos", "p", "tokens"))), lambda s: F.struct(s["p"].alias("p"), s["tokens"].alias("tokens")))
    question = F.max(F.when((F.col("kind") == "qa") & F.col("is_q"), F.col("p")))
    kept = [F.first(c).alias(c) for c in ("heading_path", *carry)]
    g = keyed.groupBy(*_BY, "run", "slot", "kind").agg(*kept, items.alias("items"), question.alias("question"))
    whole = F.array(F.transform("items", lambda x: x["p"]))
    g = g.withColumn("groups", F.when(F.col("kind") == "clause", pack(F.col("items"), conf)).otherwise(whole)).withColumn("n", F.size("groups"))
    d = g.drop("items").select("*", F.posexplode("groups").alias("part", "g"))
    many = F.col("n") > 1
    return d.select(
        *_BY, "heading_path", "run", "slot", "part", "kind", F.array_join("g", "\n\n").alias("text"), "question",
        F.when(many, F.col("part")).alias("part_index"), F.when(many, F.col("n")).alias("part_count"), *carry,
    )


def number_chunks(d: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """Drop fragments, then number what is left of each document from 0; ids are doc:ordinal."""
    small = (F.col("kind") != "qa") & F.col("part_index").isNull() & (X.token_count(F.col("text")) < conf.min_chunk_tokens)
    order = Window.partitionBy("doc_id").orderBy("section", "run", "slot", "part")
    out = d.where(~small).withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))
    return out.withColumn("id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")))


def chunk_documents(docs: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """(doc_id, markdown, title, source_url) -> chunks.

    id, document_id, ordinal, text, kind, heading_path (title first), anchor, question,
    part_index, part_count, source_url, source_title.  Null or blank documents have no chunks.
    """
    named = docs.select("doc_id", "markdown", F.col("title").alias("doc_title"), "source_url")
    lines = structure.section_lines(structure.promote(structure.heading_candidates(structure.doc_lines(named, conf), conf)))
    key = F.when(F.col("title").isNotNull(), X.normalize_title(F.col("title")))
    # The last title of a path is that of a heading; only a document's own title may be none.
    lines = lines.withColumn("titled", F.max(key == X.normalize_title(F.col("doc_title"))).over(Window.partitionBy("doc_id")))
    carry = ("toc", "titled", "source_url", "doc_title")
    parts = structure.paragraphs(structure.sections(lines, carry), conf)
    out = number_chunks(drafts(marked(parts), conf, carry), conf)
    leaf = X.normalize_title(F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.col("doc_title")))
    anchor = F.when((F.size("heading_path") > 0) | F.col("titled"), F.try_element_at("toc", leaf))
    return out.select(
        "id", F.col("doc_id").alias("document_id"), "ordinal", "text", "kind", X.breadcrumb(F.col("doc_title"), F.col("heading_path")).alias("heading_path"),
        anchor.alias("anchor"), "question", "part_index", "part_count", "source_url", F.col("doc_title").alias("source_title"),
    )


def kind_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    tokens = X.token_count(F.col("text"))
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("document_id").alias("n_documents"), F.coalesce(F.max(tokens), F.lit(0)).alias("max_tokens"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("sum_tokens"))


def family_integrity(chunks: DataFrame) -> DataFrame:
    """One row per family of split parts; whole when indices run 0..n-1 over adjacent ordinals and one path."""
    parts = chunks.where("part_index is not null").withColumn("first_ordinal", F.col("ordinal") - F.col("part_index"))
    g = parts.groupBy("document_id", "first_ordinal").agg(
        F.count(F.lit(1)).alias("n"), F.min("part_index").alias("lo"), F.max("part_index").alias("hi"),
        F.max("part_count").alias("part_count"), F.coalesce(F.min("heading_path") == F.max("heading_path"), F.lit(False)).alias("one_path"))
    ok = (F.col("n") == F.col("part_count")) & (F.col("lo") == 0) & (F.col("hi") == F.col("part_count") - 1) & F.col("one_path")
    return g.select("document_id", "first_ordinal", "n", "part_count", ok.alias("whole"))
