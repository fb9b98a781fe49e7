"""Mixing of sources to target shares of tokens.

Tokens are summed per source; a source's repetition rate is what its share of the mixture needs over what it has. Every document comes out
floor(rate) times and once more if its seeded hash falls below the fraction, so the choice depends on the document alone and is the same in
every run and on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.llm.tokens import count_tokens
from tradeloom.session import checkpointed


def unit_hash(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from the columns and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(2**53))


def repetition_rates(sizes: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, tokens, rate) for each source of targets.

    sizes: (source, tokens). budget: tokens of the mixture; by default the most at which every source that has tokens reaches its share
    within its cap. A rate never exceeds max_repeats; with a larger budget the capped sources fall short, which the report shows. Sources
    without tokens get rate 0. Null sources and sources that targets lacks are no part of the mixture.
    """
    t = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    s = sizes.select(F.col("source").alias("s__"), F.col("tokens").cast("double"))
    t = t.join(s, F.col("source") == F.col("s__"), "left").drop("s__").withColumn("tokens", F.coalesce("tokens", F.lit(0.0)))
    if budget is None:
        room = t.where("tokens > 0 AND target_share > 0").agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("budget"))
        t = t.crossJoin(F.broadcast(room))  # one row
    else:
        t = t.withColumn("budget", F.lit(float(budget)))
    wanted = F.try_divide(F.col("target_share") * F.col("budget"), F.col("tokens"))
    rate = F.when(F.col("tokens") > 0, F.least(F.coalesce(wanted, F.lit(0.0)), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return t.withColumn("rate", rate).drop("budget")


def token_counts(documents: DataFrame, **tokens) -> DataFrame:
    """(doc_id, source, n_tokens), written once: the corpus is encoded a single time."""
    return checkpointed(count_tokens(documents, ["doc_id", "source"], **tokens))


def mixture(counts: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 20) -> DataFrame:
    """(doc_id, source, n_tokens, copies) for every document that takes part, copies >= 1.

    counts: (doc_id, source, n_tokens). Documents without tokens (null or empty texts) add nothing to a share and are left out. Repeated
    rows are documents of their own, chosen alike. targets is a small fixed table of one row per source.
    """
    sizes = counts.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rates = repetition_rates(sizes, targets, budget).select(F.col("source").alias("s__"), "rate", "max_repeats")
    copies = F.floor("rate") + (unit_hash(seed, F.col("doc_id")) < F.col("rate") - F.floor("rate")).cast("long")
    # as many rows as targets has, whatever the corpus
    out = counts.where("n_tokens > 0").join(F.broadcast(rates), F.col("source") == F.col("s__"))
    return out.withColumn("copies", F.least(copies, F.col("max_repeats").cast("long")).cast("int")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def emit_copies(mixed: DataFrame) -> DataFrame:
    """(doc_id, source, copy_no), a row for each copy of each document."""
    return mixed.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def mixture_report(counts: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 20) -> DataFrame:
    """Per source of targets: target and actual share of the tokens, what there was, the rate, and what was used."""
    sizes = counts.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rates = repetition_rates(sizes, targets, budget)
    used = mixture(counts, targets, budget, seed).groupBy(F.col("source").alias("u__")).agg(
        F.sum("copies").alias("documents_used"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_used"), F.max("copies").alias("most_repeats")
    )
    both = rates.join(used, F.col("source") == F.col("u__"), "left").drop("u__")
    both = both.crossJoin(F.broadcast(used.agg(F.sum("tokens_used").alias("all__"))))  # one row
    return both.select(
        "source", "target_share", F.try_divide(F.coalesce("tokens_used", F.lit(0)).cast("double"), F.col("all__")).alias("actual_share"), "max_repeats", "rate", F.col("tokens").cast("long").alias("tokens_available"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents_used", "tokens_used", "most_repeats")],
    )
