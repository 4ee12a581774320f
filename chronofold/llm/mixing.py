"""Mixing sources to target weights: temperature mixing with native functions alone.

A source with share p of all tokens gets weight p^a, normalised.  The exponent a
is bisected so that the weights' entropy meets a target between that of the
shares (a = 1) and that of equal weights (a = 0); where some source would then be
repeated more than ``max_epochs`` times as often as the least repeated one, the
exponent rises until it is not.  The token budget is the smallest that gives
every source at least one epoch, so no document is left out.

A source's budget is realised as permutations of its documents, one for each
epoch, ordered by a hash: whole epochs, then a part of one more.  The last
permutation is cut into blocks by the leading digits of its hash; only blocks'
token sums are put in line, and documents are ordered only inside the one block
of each source where the budget ends.  Texts are scanned and never shuffled, but
for those blocks.

Tokens are runs of characters other than ASCII white space.  Defined results: a
null source is a source of its own; null and empty texts hold no tokens and are
in every whole epoch; a source without any token gets one epoch; rows with equal
or null doc_id are separate documents that share a place in the permutation
(ties by their text's MD5); other columns are ignored (``mix`` keeps them); an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, table

#: Where the target entropy lies between that of the shares (0) and that of equal weights (1).
ENTROPY_TARGET = 0.5
#: Most epochs of one source for one epoch of the least repeated one.
MAX_EPOCHS = 2.0
BISECTIONS = 50
SEED = "mix-1"
#: Expected documents of one block of a permutation.
BLOCK_DOCS = 4096
#: Largest number of sources whose table is broadcast (rows of about 100 bytes); more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _entropy(shares: Column, a: Column) -> Column:
    """Entropy of the shares' powers, normalised."""
    powers = F.transform(shares, lambda p: F.pow(p, a))
    total = F.aggregate(powers, F.lit(0.0), lambda t, x: t + x)
    # -sum w ln w, with w = x / total
    return F.log(total) - F.aggregate(powers, F.lit(0.0), lambda t, x: t + x * F.log(x)) / total


def _bisect(holds, low: float = 0.0, high: float = 1.0, steps: int = BISECTIONS) -> Column:
    """The least exponent in [low, high] for which ``holds``, where that is monotone."""
    zero = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def step(span, _):
        mid = (span["lo"] + span["hi"]) / 2
        return F.when(holds(mid), F.struct(span["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), span["hi"].alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step, lambda s: s["hi"])


def plan_sources(counted: DataFrame, entropy_target: float = ENTROPY_TARGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, docs, tokens, weight and budget of each source of ``counted`` (source, n_tokens).

    The shares of the sources, sorted, are one array: a number for each source,
    whatever the documents.  The exponent and two sums of it come back as one row.
    """
    sources = materialise(counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "mix-sources")
    shares = sources.where("tokens > 0").agg(F.sort_array(F.collect_list("tokens")).alias("held"), F.sum("tokens").alias("all"))
    shares = shares.select("all", F.transform("held", lambda x: x / F.col("all")).alias("p"))
    flat, own = F.log(F.size("p").cast("double")), _entropy(F.col("p"), F.lit(1.0))
    shares = shares.withColumn("goal", own + F.lit(entropy_target) * (flat - own))
    # entropy falls as the exponent rises: the least exponent whose entropy is at or below the goal
    by_entropy = _bisect(lambda a: _entropy(F.col("p"), a) <= F.col("goal"))
    # epochs go as p^(a - 1): the smallest source is repeated most, the largest least
    by_epochs = _bisect(lambda a: F.pow(F.element_at("p", -1) / F.element_at("p", 1), 1 - a) <= F.lit(max_epochs))
    shares = shares.where(F.size("p") > 0).select("all", "p", F.greatest(by_entropy, by_epochs).alias("a"))
    norm = F.aggregate(F.transform("p", lambda x: F.pow(x, F.col("a"))), F.lit(0.0), lambda t, x: t + x)
    found = shares.select("all", "a", norm.alias("norm"), F.element_at("p", -1).alias("top")).first()
    if found is None:
        return sources.select("*", F.lit(None).cast("double").alias("weight"), F.lit(0).cast("long").alias("budget"))
    every, a, norm, top = found
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / every, F.lit(a)) / norm)
    # the largest source, the least repeated, has one epoch: all budgets follow from its weight
    whole_budget = every * top / (top**a / norm)
    budget = F.greatest(F.col("tokens"), F.floor(F.lit(whole_budget) * weight + 1e-6))
    return sources.select("*", weight.alias("weight"), F.coalesce(budget, F.lit(0)).cast("long").alias("budget"))


def _permuted(epoch: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(SEED), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with source) beside their source's row of ``plan`` (with p_source)."""
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")


def mix_rows(docs: DataFrame, entropy_target: float = ENTROPY_TARGET, max_epochs: float = MAX_EPOCHS, block_docs: int = BLOCK_DOCS, *kept: Column) -> DataFrame:
    """A row for each copy of each document, with epoch (from 1) and place (the hash that orders its permutation)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("text").alias("mix_text"), *kept)
    counted = materialise(text.select("doc_id", "source", token_count(F.col("mix_text")).alias("n_tokens")), "mix-counts")
    plan = plan_sources(counted, entropy_target, max_epochs)
    digits = F.when(F.col("docs") <= block_docs, 0).otherwise(F.ceil(F.log(F.col("docs") / block_docs) / F.log(F.lit(16.0)))).cast("int")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long")
    rest = F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).cast("long")
    plan = plan.select(F.col("source").alias("p_source"), "weight", "budget", digits.alias("digits"), whole.alias("whole"), rest.alias("rest"))
    plan = materialise(plan, "mix-plan")

    # where in its last permutation does each source's budget end?
    placed = _with_plan(counted, plan).withColumn("place", _permuted(F.col("whole") + 1)).withColumn("block", F.expr("substring(place, 1, digits)"))
    blocks = placed.where("rest > 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("rest").alias("rest"))
    in_line = blocks.withColumn("upto", F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block")))
    ends = in_line.where("upto - block_tokens < rest AND rest <= upto").select(F.col("source").alias("e_source"), F.col("block").alias("end_block"), (F.col("upto") - F.col("block_tokens")).alias("before"))
    plan = materialise(plan.join(ends, F.col("p_source").eqNullSafe(F.col("e_source")), "left").drop("e_source"), "mix-ends")

    rows = _with_plan(text, plan).withColumn("place", _permuted(F.col("whole") + 1)).withColumn("block", F.expr("substring(place, 1, digits)"))
    here = F.coalesce(F.col("block") == F.col("end_block"), F.lit(False))
    known = rows.where(~here).withColumn("last", F.coalesce(F.col("block") < F.col("end_block"), F.lit(False)))
    inside = Window.partitionBy("source").orderBy("place", F.md5(F.coalesce("mix_text", F.lit("")).cast("binary"))).rowsBetween(Window.unboundedPreceding, 0)
    ending = rows.where(here).withColumn("last", F.col("before") + F.sum(token_count(F.col("mix_text"))).over(inside) <= F.col("rest"))
    every = known.unionByName(ending).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole") + F.col("last").cast("long"))))
    return every.withColumn("place", _permuted(F.col("epoch"))).drop("last", "before", "end_block", "block", "digits", "whole", "rest")


def mix(docs: DataFrame, entropy_target: float = ENTROPY_TARGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` with their own columns, each as often as its source's budget has it."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_row")
    return mix_rows(docs, entropy_target, max_epochs, BLOCK_DOCS, row).select("mix_row.*")


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "epoch", "place", F.round("weight", 9).alias("weight"), "budget")


OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens, md5(coalesce(text, '')) AS tie FROM documents
), s AS (
  SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source
), h AS (
  SELECT sum(tokens)::BIGINT AS every, list_sort(list(tokens)) AS held FROM s WHERE tokens > 0
), p AS (
  SELECT every, list_transform(held, lambda x: x::DOUBLE / every) AS p FROM h
), g AS (
  SELECT *, -list_sum(list_transform(p, lambda x: x * ln(x))) AS own FROM p
), g2 AS (
  SELECT *, own + {ENTROPY_TARGET} * (ln(len(p)) - own) AS goal FROM g
), bis AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2
  UNION ALL
  SELECT i + 1,
    CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END,
    CASE WHEN ok2 THEN lo2 ELSE (lo2 + hi2) / 2 END, CASE WHEN ok2 THEN (lo2 + hi2) / 2 ELSE hi2 END
  FROM (
    SELECT bis.*,
      ln(list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))))
        - list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ln(pow(x, (lo + hi) / 2))))
          / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) <= goal AS ok,
      pow(p[len(p)] / p[1], 1 - (lo2 + hi2) / 2) <= {MAX_EPOCHS} AS ok2
    FROM bis, g2 WHERE i < {BISECTIONS}
  )
), e AS (
  SELECT greatest(hi, hi2) AS a FROM bis WHERE i = {BISECTIONS}
), n AS (
  SELECT every, a, p[len(p)] AS top, list_sum(list_transform(p, lambda x: pow(x, a))) AS norm FROM g2, e
), w AS (
  SELECT s.*, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE / every, a) / norm END AS weight, every * top / (pow(top, a) / norm) AS total FROM s, n
), b AS (
  SELECT *, CASE WHEN tokens > 0 THEN greatest(tokens, floor(total * weight + 1e-6)::BIGINT) ELSE 0 END AS budget FROM w
), c AS (
  SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM b
), r AS (
  SELECT d.doc_id, d.source, n_tokens, weight, budget, whole, rest,
         sum(n_tokens) OVER (PARTITION BY d.source ORDER BY md5('{SEED}/' || (whole + 1) || '/' || coalesce(doc_id::VARCHAR, '')), tie ROWS UNBOUNDED PRECEDING) AS reach
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
), x AS (
  SELECT *, unnest(range(1, whole + CASE WHEN rest > 0 AND reach <= rest THEN 2 ELSE 1 END)) AS epoch FROM r
)
SELECT doc_id, source, epoch, md5('{SEED}/' || epoch || '/' || coalesce(doc_id::VARCHAR, '')) AS place, round(weight, 9) AS weight, budget FROM x
"""
