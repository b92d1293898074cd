"""Temperature mixing of sources, in DataFrame expressions only.

Weights are token shares raised to an exponent in [0, 1] and normalised.  The exponent is
bisected: the largest with at least the target entropy, or, where that would repeat a source
more often than allowed, the smallest within the repetition limit.  Each job evaluates the 31
exponents that five bisection steps can reach, as sums over a table with a row for each source.

A source's budget of tokens is then spent in epochs.  Its documents lie in about sqrt(n) blocks
by a hash of the id; an epoch is a permutation of blocks, and of the documents within a block.
Whole epochs take all documents.  The last, partial one takes whole blocks while they fit, and
of the block where the budget ends the documents that still fit.  Running sums are taken over
the blocks of a source and over the documents of one block, never over a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Columns, Workspace, pick, row_key, table, without

STEPS = 40
ENTROPY, REPEATS, BUDGET, SEED = 0.999, 4.0, 1.0, "mix"
#: Plan rows (a few numbers each) that are broadcast at most; beyond, joins shuffle.
PLAN_ROWS = 200_000


def _hash60(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _doc_text(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent a: sum of p^a, sum of p^a ln p, and the smallest p^(a-1) inverse (largest p^a / p)."""
    cols = []
    for k, a in enumerate(exponents):
        power = F.pow("p", F.lit(a))
        cols += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log("p")).alias(f"l{k}"), F.max(power / F.col("p")).alias(f"r{k}")]
    row = shares.agg(*cols).first()
    return [(row[f"z{k}"], row[f"l{k}"], row[f"r{k}"]) for k in range(len(exponents))]


def entropy(moment: tuple[float, float, float], a: float) -> float:
    z, l, _ = moment
    return math.log(z) - a * l / z


def bisect(shares: DataFrame, accept, largest: bool, steps: int = STEPS) -> float:
    """Border of a monotone condition on [0, 1]; each job settles five steps of the bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(steps // 5):
        grid = [lo + (hi - lo) * j / 32 for j in range(33)]
        ok = [accept(m, a) for m, a in zip(_moments(shares, grid[1:-1]), grid[1:-1], strict=True)]
        left, right = 0, 32
        while right - left > 1:
            mid = (left + right) // 2
            if ok[mid - 1] == largest:
                left = mid
            else:
                right = mid
        lo, hi = grid[left], grid[right]
    return lo if largest else hi


def choose_exponent(shares: DataFrame, target: float, repeats: float, budget_ratio: float) -> float:
    """`shares` has p > 0 per source.  `target` is a share of the largest possible entropy."""
    n = shares.count()
    enough = target * math.log(n) if n else 0.0
    edge = _moments(shares, [1.0, 0.0]) if n else []
    if n < 2:
        return 1.0
    if entropy(edge[0], 1.0) >= enough:
        a = 1.0
    else:
        a = bisect(shares, lambda m, x: entropy(m, x) >= enough, largest=True)
    within = lambda m, _: m[2] / m[0] * budget_ratio <= repeats
    if not within(_moments(shares, [a])[0], a):
        a = bisect(shares, within, largest=False)
    return a


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(PLAN_ROWS + 1).count() <= PLAN_ROWS else df


def mix(
    docs: DataFrame,
    entropy_share: float = ENTROPY,
    repeats: float = REPEATS,
    budget: float = BUDGET,
    seed: str = SEED,
    tokens: str | None = None,
) -> DataFrame:
    """`docs` (doc_id, text, source, ...) -> its rows, once for each epoch that takes them.

    Added columns: mix_epoch (0-based), mix_weight (the source's weight) and mix_key, by which a
    sorted output has the target weights in every stretch.  `budget` is a multiple of all
    tokens; no source is repeated beyond `repeats` (a larger budget is cut to that).  A null
    source is a source of its own, a null id hashes as an empty one; null or empty texts have no
    tokens; very long texts count whole; a source without tokens gets no budget.  No rows give
    no rows.  Ties in the permutations go by id, then tokens; a repeated row is mixed as often as
    it stands.  All other columns stay under their names, whatever these are; columns of the
    added names, in any case, are replaced.  `tokens` names a column that has the counts already.
    """
    spark = docs.sparkSession
    held = Columns(without(docs, "mix_epoch", "mix_weight", "mix_key"))
    ident, source, content = held.at("doc_id"), held.at("source"), held.at(tokens or "text")
    with Workspace(spark, "mixing") as ws:
        n_tokens = F.col(content).cast("long") if tokens else count_tokens(F.col(content))
        slim = held.df.select(F.col(source).alias("source"), F.col(ident).alias("doc_id"), row_key(content).alias("rk"), n_tokens.alias("n_tokens"), _hash60(F.lit(seed), _doc_text(ident)).alias("h"))
        slim = ws.save(slim, "slim")
        per = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("t")).where("t > 0")
        per = ws.save(per, "sources")
        total = per.agg(F.sum("t")).first()[0] or 0
        ratio = min(budget, repeats)
        shares = per.select((F.col("t") / F.lit(float(total or 1))).alias("p"))
        a = choose_exponent(shares, entropy_share, repeats, ratio)
        z = _moments(shares, [a])[0][0] if total else 1.0
        weight = F.pow(F.col("t") / F.lit(float(total or 1)), F.lit(a)) / F.lit(z)
        quota = F.floor(weight * F.lit(math.floor(ratio * total)) * F.lit(1 + 1e-12) + F.lit(1e-6))
        plan = per.select("source", "t", F.ceil(F.sqrt(F.col("n_docs").cast("double"))).cast("long").alias("blocks"), weight.alias("w"), quota.alias("q"))
        plan = plan.withColumn("whole", F.floor(F.col("q") / F.col("t"))).withColumn("rest", F.col("q") - F.col("whole") * F.col("t"))
        plan = ws.save(plan, "plan")
        small = _small(plan)
        placed = slim.join(small, slim["source"].eqNullSafe(small["source"])).drop(small["source"]).withColumn("block", F.pmod("h", "blocks"))
        sums = ws.save(placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("bt")), "blocks")
        epochs = sums.join(small, sums["source"].eqNullSafe(small["source"])).drop(small["source"]).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
        order = Window.partitionBy("source", "epoch").orderBy(_hash60(F.lit(seed), F.col("epoch").cast("string"), F.col("block").cast("string")), "block")
        ranked = epochs.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("before", F.sum("bt").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bt"))
        share = F.when(F.col("epoch") < F.col("whole"), "all").when(F.col("before") + F.col("bt") <= F.col("rest"), "all").when(F.col("before") < F.col("rest"), "part")
        ranked = ranked.withColumn("take", share).where("take is not null")
        steps = ws.save(ranked.select("source", "block", "blocks", "epoch", "rank", "take", "w", "q", "t", (F.col("rest") - F.col("before")).alias("room")), "steps")
        part = _small(steps.where("take = 'part'").select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "room"))
        inside = Window.partitionBy("source", "block").orderBy(_hash60(F.lit(seed), F.col("epoch").cast("string"), _doc_text()), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
        edge = placed.join(part, placed["source"].eqNullSafe(part["s"]) & (placed["block"] == part["b"]))
        edge = edge.withColumn("run", F.sum("n_tokens").over(inside)).where("run <= room").select("doc_id", "rk").distinct()
        edge = ws.save(edge, "edge").checkpoint()
        steps = steps.checkpoint()
    named = _small(steps.select(*[F.col(c).alias(f"s_{c}") for c in steps.columns]))
    blocks = _small(steps.select(F.col("source").alias("b_source"), F.col("blocks").alias("b_n")).distinct())
    rows = held.df.withColumns({"rk": row_key(content), "id": F.col(ident)})
    rows = rows.join(blocks, rows[source].eqNullSafe(blocks["b_source"])).withColumn("block", F.pmod(_hash60(F.lit(seed), _doc_text("id")), F.col("b_n")))
    rows = rows.join(named, rows[source].eqNullSafe(named["s_source"]) & (rows["block"] == named["s_block"]))
    edge = _small(edge.select(F.col("doc_id").alias("e_id"), F.col("rk").alias("e_rk")))
    rows = rows.join(edge, (rows["rk"] == edge["e_rk"]) & rows["id"].eqNullSafe(edge["e_id"]), "left").where("s_take = 'all' or e_rk is not null")
    inner = _hash60(F.lit(seed), F.col("s_epoch").cast("string"), _doc_text("id")) / F.lit(float(1 << 60))
    key = (F.col("s_epoch") + (F.col("s_rank") - 1 + inner) / F.col("s_blocks")) * F.col("s_t") / F.col("s_q")
    rows = rows.withColumns({"mix_epoch": F.col("s_epoch"), "mix_weight": F.round("s_w", 9), "mix_key": F.round(key, 6)})
    return held.back(rows, "mix_epoch", "mix_weight", "mix_key")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture of `documents` at the target weights of their sources.

    For nulls, empty and long texts, ties, repeated rows and empty tables see `mix`.
    """
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "source", "text").select("doc_id", "source", count_tokens(F.col("text")).alias("n_tokens"))
    return mix(docs, tokens="n_tokens")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
per AS (SELECT source, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS t FROM d GROUP BY source HAVING sum(n_tokens) > 0),
tot AS (SELECT CAST(sum(t) AS BIGINT) AS total, list(t ORDER BY t) AS ts, count(*) AS n FROM per),
sh AS (SELECT total, n, list_transform(ts, lambda x: x / CAST(total AS DOUBLE)) AS p FROM tot),
ent AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, p, n FROM sh
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, p, n FROM (
    SELECT *, ln(z) - mid * l / z >= 0.999 * ln(n) AS ok FROM (
      SELECT *, list_sum(list_transform(p, lambda x: pow(x, mid))) AS z, list_sum(list_transform(p, lambda x: pow(x, mid) * ln(x))) AS l
      FROM (SELECT *, (lo + hi) / 2 AS mid FROM ent WHERE i < 40)))),
a1 AS (SELECT CASE WHEN n < 2 OR -list_sum(list_transform(p, lambda x: x * ln(x))) / list_sum(p) + ln(list_sum(p)) >= 0.999 * ln(n) THEN 1.0 ELSE lo END AS a, p, n FROM ent WHERE i = 40),
rep AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, p FROM a1
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END, p FROM (
    SELECT *, list_max(list_transform(p, lambda x: pow(x, mid) / x)) / list_sum(list_transform(p, lambda x: pow(x, mid))) * 1.0 <= 4.0 AS ok
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM rep WHERE i < 40))),
ex AS (SELECT CASE WHEN list_max(list_transform(a1.p, lambda x: pow(x, a) / x)) / list_sum(list_transform(a1.p, lambda x: pow(x, a))) * 1.0 <= 4.0 THEN a ELSE (SELECT hi FROM rep WHERE i = 40) END AS a, p FROM a1),
w AS (SELECT source, t, CAST(ceil(sqrt(CAST(n_docs AS DOUBLE))) AS BIGINT) AS blocks, total,
        pow(t / CAST(total AS DOUBLE), a) / list_sum(list_transform(p, lambda x: pow(x, a))) AS w FROM per, ex, tot),
quotas AS (SELECT *, CAST(floor(w * CAST(total AS DOUBLE) * (1 + 1e-12) + 1e-6) AS BIGINT) AS q FROM w),
plan AS (SELECT *, q // t AS whole, q % t AS rest FROM quotas),
placed AS (SELECT d.*, plan.* EXCLUDE (source), h % blocks AS block FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
sums AS (SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS bt FROM placed GROUP BY ALL),
ranked AS (
  SELECT sums.*, plan.* EXCLUDE (source), e AS epoch, row_number() OVER o AS rank, CAST(sum(bt) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) - bt AS before
  FROM sums JOIN plan ON sums.source IS NOT DISTINCT FROM plan.source, unnest(generate_series(0, whole)) AS g(e)
  WINDOW o AS (PARTITION BY sums.source, e ORDER BY CAST('0x' || substr(md5('mix|' || e || '|' || block), 1, 15) AS BIGINT), block)),
steps AS (SELECT *, CASE WHEN epoch < whole OR before + bt <= rest THEN 'all' WHEN before < rest THEN 'part' END AS take FROM ranked),
copies AS (
  SELECT placed.doc_id, placed.source, placed.n_tokens, s.epoch, s.rank, s.take, s.rest - s.before AS room, placed.w, placed.q, placed.t, placed.blocks,
    CAST('0x' || substr(md5('mix|' || s.epoch || '|' || coalesce(CAST(placed.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hd, placed.block
  FROM placed JOIN steps s ON placed.source IS NOT DISTINCT FROM s.source AND placed.block = s.block WHERE s.take IS NOT NULL),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, block, epoch ORDER BY hd, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM copies)
SELECT doc_id, source, n_tokens, epoch AS mix_epoch, round(w, 9) AS mix_weight,
  round((epoch + (rank - 1 + hd / 1152921504606846976.0::DOUBLE) / blocks) * t / q, 6) AS mix_key
FROM run WHERE take = 'all' OR upto <= room
"""
