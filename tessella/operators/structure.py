"""From Markdown to sections: contents list, heading recovery, heading paths, paragraphs.

Documents become rows of lines once; every later step is a window over the lines of a document
or a group within it, so one exchange by doc_id serves the whole chain up to the chunks.
Windows look back only (a look ahead runs over the lines in falling order), so each costs one
pass and spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, EngineConf
from ..functions import text as X

LEVELS = range(1, 7)
#: Characters of documents whose lines are dealt to one task; windows hold a partition's lines several times over.
PART_CHARS = 8 << 20


def parts_of(docs: DataFrame) -> int:
    """Partitions that the lines of `docs` are dealt over, so that a task's share stays the same as the input grows; whole rounds of all cores."""
    n = docs.agg(F.coalesce(F.sum(F.length("markdown").cast("long")), F.lit(0))).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, -(-n // (PART_CHARS * cores)))


def mark_toc(docs: DataFrame, conf: EngineConf = DEFAULT, marks_only: bool = False, parts: int | None = None) -> DataFrame:
    """(doc_id, markdown, ...) -> one row per line: i, line, is_toc, and the other columns.

    Link-only bullets among the first lines are the contents list, up to the first heading that
    follows one of them.  With `marks_only` other lines than links and headings stay behind
    before the exchange; they decide nothing.  Lines are dealt over `parts` partitions (see `parts_of`).
    """
    parts = parts_of(docs) if parts is None else parts
    other = [c for c in docs.columns if c != "markdown"]
    lines = docs.select(*other, F.posexplode(F.split("markdown", "\n")).alias("i", "line"))
    whole = Window.partitionBy("doc_id")
    link = (F.col("i") <= conf.max_toc_scan_lines) & F.col("line").rlike(X.TOC_LINE)
    if marks_only:
        lines = lines.where(link | F.col("line").rlike(r"^#{1,6}\s"))
    lines = lines.repartition(parts, "doc_id").withColumn("_link", link).withColumn("_first", F.min(F.when(F.col("_link"), F.col("i"))).over(whole))
    end = F.min(F.when(F.col("line").rlike(r"^#{1,6}\s") & (F.col("i") > F.col("_first")), F.col("i"))).over(whole)
    lines = lines.withColumn("_end", end).withColumn("is_toc", F.col("_link") & F.coalesce(F.col("i") < F.col("_end"), F.lit(True)))
    return lines.drop("_link", "_first", "_end")


def toc_entries(lines: DataFrame) -> DataFrame:
    """doc_id, i, title, url of the lines of contents lists."""
    part = lambda k: F.regexp_extract("line", X.TOC_LINE, k)
    return lines.where("is_toc").select("doc_id", "i", part(1).alias("title"), part(2).alias("url"))


def toc_maps(lines: DataFrame) -> DataFrame:
    """doc_id, toc: normalised title -> anchor (of the last entry of a title that has one; null without)."""
    e = toc_entries(lines).select("doc_id", "i", X.normalize_title(F.col("title")).alias("key"), F.nullif(X.anchor_of(F.col("url")), F.lit("")).alias("anchor"))
    last = F.max_by("anchor", F.when(F.col("anchor").isNotNull(), F.col("i")))
    per = e.where("key <> ''").groupBy("doc_id", "key").agg(last.alias("anchor"))
    return per.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "anchor"))).alias("toc"))


def doc_lines(docs: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """One row per line after the contents list: doc_id, pos, line, toc (title key -> anchor), and the other columns."""
    parts = parts_of(docs)
    lines = mark_toc(docs, conf, parts=parts)
    rest = lines.where(~F.col("is_toc")).drop("is_toc")
    rest = rest.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1).cast("int")).drop("i")
    return rest.join(toc_maps(mark_toc(docs.select("doc_id", "markdown"), conf, marks_only=True, parts=parts)), "doc_id", "left")


def heading_candidates(lines: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """Lines with key, in_fence, alone (first, or after a blank), followed (by content) and candidate."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    back = Window.partitionBy("doc_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blank = F.col("_t") == ""
    fence = F.sum(F.col("line").rlike(r"^\s*```").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    # Only whether the next line with text is a heading goes through the window, not that line.
    content = F.coalesce(~F.last(F.when(~blank, F.col("_t").rlike(r"^#{1,6}\s")), ignorenulls=True).over(back), F.lit(False))
    out = (
        lines.withColumn("_t", X.trimmed(F.col("line"))).withColumn("followed", content)
        .withColumn("in_fence", fence).withColumn("alone", F.coalesce(F.lag(blank).over(by), F.lit(True)))
        .withColumn("key", X.normalize_title(F.col("line")))
    )
    # Tests in a branch are made for the lines that reach it; beside an AND, shared parts of them are made for every line.
    listed = F.exists(F.array(X.normalize_title(F.col("line"))), lambda k: (k != "") & F.map_contains_key("toc", k)) & ~F.col("line").rlike(r"^\s*#")
    listed = F.when(F.col("toc").isNotNull(), listed).otherwise(F.lit(False))
    shaped = F.when(F.length("_t") <= conf.max_heading_chars, X.has_heading_shape(F.col("_t"), conf)).otherwise(F.lit(False))
    good = F.when(~F.col("in_fence") & F.col("alone") & ~blank & F.col("followed"), listed | shaped).otherwise(F.lit(False))
    return out.withColumn("candidate", good).drop("_t")


def promote(candidates: DataFrame) -> DataFrame:
    """Candidate lines become headings: numbered ones level 2, others level 3 once a numbered one has come."""
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    title = X.heading_title(F.col("line"))
    numbered = F.col("candidate") & X.is_numbered(title)
    seen = F.max(numbered.cast("int")).over(by) == 1
    level = F.when(seen & ~X.is_numbered(title), F.lit("### ")).otherwise("## ")
    line = F.when(F.col("candidate"), F.concat(level, title)).otherwise(F.col("line"))
    return candidates.withColumn("promoted", F.when(F.col("candidate"), title)).withColumn("line", line)


def section_lines(lines: DataFrame) -> DataFrame:
    """Lines with section (running number of headings) and heading_path (titles of the open levels)."""
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = F.length(F.regexp_extract("line", X.HEADING, 1))
    lines = lines.withColumn("level", F.when(F.col("line").rlike(X.HEADING), level)).withColumn("title", F.when(F.col("level").isNotNull(), X.trimmed(F.regexp_extract("line", X.HEADING, 2))))
    lines = lines.withColumn("section", F.count("level").over(by).cast("int"))
    at = {k: F.coalesce(F.max(F.when(F.col("level") == k, F.col("pos"))).over(by), F.lit(-1)) for k in LEVELS}
    named = {k: F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(by) for k in LEVELS}
    lines = lines.withColumns({f"_p{k}": at[k] for k in LEVELS} | {f"_t{k}": named[k] for k in LEVELS})  # one window node
    open_ = [F.when(F.col(f"_p{k}") > F.greatest(F.lit(-1), *[F.col(f"_p{j}") for j in LEVELS if j < k], F.lit(-1)), F.col(f"_t{k}")) for k in LEVELS]
    path = F.filter(F.array(*open_), lambda t: t.isNotNull())
    return lines.withColumn("heading_path", path).drop(*[f"_{a}{k}" for a in "pt" for k in LEVELS])


def sections(lines: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Section bodies: doc_id, section, heading_path, body; empty ones are dropped."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "line")))), lambda s: s["line"]), "\n")
    kept = [F.first(c).alias(c) for c in ("heading_path", *carry)]
    out = lines.groupBy("doc_id", "section").agg(*kept, X.trimmed(body).alias("body"))
    return out.where("body <> ''")


def paragraphs(sections_: DataFrame, conf: EngineConf = DEFAULT) -> DataFrame:
    """One row per paragraph of a section: ppos, p, tokens, is_q, is_table, and the other columns."""
    parts = F.filter(F.transform(F.split("body", r"\n{2,}"), X.trimmed), lambda p: p != "")
    other = [c for c in sections_.columns if c != "body"]
    out = sections_.select(*other, F.posexplode(parts).alias("ppos", "p"))
    return out.withColumn("tokens", X.token_count(F.col("p"))).withColumn("is_q", X.is_question(F.col("p"), conf)).withColumn("is_table", X.is_table(F.col("p")))
