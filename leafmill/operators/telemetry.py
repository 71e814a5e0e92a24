"""Run statistics as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Price for 1000 tokens in and out; other models cost the first.
PRICES = {"gpt-4-1106-preview": (0.01, 0.03), "gpt-4": (0.03, 0.06), "gpt-3.5-turbo": (0.001, 0.002)}
#: Context length in tokens, whether JSON mode and a seed are supported.
ABILITIES = {"gpt-4-1106-preview": (128000, True, True), "gpt-4": (8192, False, False), "gpt-3.5-turbo": (16385, True, False)}


def models(spark) -> DataFrame:
    """model, context_length, price_in, price_out, supports_json, supports_seed."""
    return spark.createDataFrame([(m, n, *PRICES[m], json, seed) for m, (n, json, seed) in ABILITIES.items()], "model string, context_length int, price_in double, price_out double, supports_json boolean, supports_seed boolean")


def models_used(calls: DataFrame) -> DataFrame:
    """model, calls, context_length (0: unknown model), supports_json, supports_seed, too_long (calls over the context)."""
    j = calls.join(F.broadcast(models(calls.sparkSession).drop("price_in", "price_out")), "model", "left")
    known = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    return j.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.max("context_length"), F.lit(0)).alias("context_length"), known("supports_json"), known("supports_seed"),
        F.count_if(F.col("tokens_in") + F.col("tokens_out") > F.col("context_length")).alias("too_long"),
    )


def supports(model: str, what: str) -> bool:
    """Whether a model supports ``json`` or ``seed``; unknown models support neither."""
    return ABILITIES.get(model, (0, False, False))[{"json": 1, "seed": 2}[what]]


def used(cards: DataFrame) -> DataFrame:
    """strategies, note_types: the distinct ones, in order."""
    return cards.agg(F.sort_array(F.collect_set("strategy")).alias("strategies"), F.sort_array(F.collect_set("note_type")).alias("note_types"))


def model_prices(spark) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, price_in double, price_out double")


def with_cost(calls: DataFrame) -> DataFrame:
    """Adds cost to calls (model, tokens_in, tokens_out); unknown models cost as the first known one."""
    p = F.broadcast(model_prices(calls.sparkSession))
    a, b = next(iter(PRICES.values()))
    cost = F.col("tokens_in") / 1000 * F.coalesce("price_in", F.lit(a)) + F.col("tokens_out") / 1000 * F.coalesce("price_out", F.lit(b))
    return calls.join(p, "model", "left").withColumn("cost", cost).drop("price_in", "price_out")


def rolled_up(calls: DataFrame) -> DataFrame:
    """Sums of tokens, cost, cache hits, calls and cards by strategy, and over all (strategy null)."""
    return calls.rollup("strategy").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sum(F.col("cached").cast("bigint")).alias("cache_hits"), F.count(F.lit(1)).alias("calls"), F.sum("cards").alias("cards"))


def share(part: Column, whole: Column) -> Column:
    """part / max(1, whole) to three places, halves to even."""
    return F.bround(part / F.greatest(whole, F.lit(1)), 3)


def hit_rates(calls: DataFrame) -> DataFrame:
    return calls.groupBy("strategy").agg(F.sum(F.col("cached").cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("calls")).withColumn("hit_rate", share(F.col("hits"), F.col("calls")))


def review_metrics(reviews: DataFrame, least: float = 7.0) -> DataFrame:
    """reviewed, kept, dropped, edited, drop_rate, edit_rate. ``reviews``: score, edited."""
    kept = F.coalesce("score", F.lit(5.0)) >= least
    m = reviews.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.count_if(kept & F.col("edited")).alias("edited"))
    return m.withColumn("drop_rate", share(F.col("dropped"), F.col("reviewed"))).withColumn("edit_rate", share(F.col("edited"), F.col("reviewed")))


def phases(events: DataFrame) -> DataFrame:
    """phase, seconds: the last run of each phase (phase, start, end)."""
    return events.groupBy("phase").agg(F.max_by(F.col("end").cast("double") - F.col("start").cast("double"), "start").alias("seconds"))


def manifest(calls: DataFrame, events: DataFrame | None = None, model: str = "") -> dict:
    """A run's summary as a nested dict (one row for each strategy is collected)."""
    rows = {r["strategy"]: r.asDict() for r in rolled_up(calls).collect()}
    whole = rows.pop(None, {}) or {}
    out = {"model": model, "totals": {k: v for k, v in whole.items() if k != "strategy"}, "by_strategy": {s: {k: v for k, v in r.items() if k != "strategy"} for s, r in sorted(rows.items())}}
    out["cache_hit_rate"] = round((whole.get("cache_hits") or 0) / max(1, whole.get("calls") or 0), 3)
    if events is not None:
        out["phases"] = {r["phase"]: r["seconds"] for r in phases(events).collect()}
    return out
