"""Model calls on Arrow batches: retries, JSON checks, usage figures, a table of earlier responses, card reviews."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.plans.ship import ship

#: A model takes (system prompt or None, prompt) and gives (content, tokens in, tokens out).
Model = Callable[[str | None, str], tuple[str, int, int]]
#: What a review without a usable score counts as.
FALLBACK = 5.0
RESPONSE = "content string, error string, attempts int, tokens_in bigint, tokens_out bigint, seconds double"

_providers: dict[str, Callable[..., Model]] = {}


def register_provider(name: str, make: Callable[..., Model]) -> None:
    """``make(settings)`` gives the model of a provider; settings are those of the configuration's ``llm`` section."""
    _providers[name] = make


def provider(settings) -> Model:
    if settings.provider not in _providers:
        raise ValueError(f"no provider {settings.provider!r} is registered")
    return _providers[settings.provider](settings)


def call(model: Model, prompt: str, system: str | None = None, json_mode: bool = False, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> dict:
    """One response: errors are tried again after 1, 2, 4, ... seconds, and in JSON mode broken JSON at once, both
    ``retries`` times; then the row has an error and no content. Tokens of all attempts count."""
    began, used, error = time.monotonic(), [0, 0], None
    for attempt in range(retries + 1):
        try:
            content, n_in, n_out = model(system, prompt)
        except Exception as e:  # noqa: BLE001  whatever a provider raises counts as a failed call
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                wait(2.0**attempt)
            continue
        used[0] += n_in
        used[1] += n_out
        if json_mode:
            try:
                json.loads(content)
            except ValueError as e:
                error = f"no JSON: {e}"
                continue
        return {"content": content, "error": None, "attempts": attempt + 1, "tokens_in": used[0], "tokens_out": used[1], "seconds": time.monotonic() - began}
    return {"content": None, "error": error, "attempts": retries + 1, "tokens_in": used[0], "tokens_out": used[1], "seconds": time.monotonic() - began}


def responses(prompts: DataFrame, model: Model, json_mode: bool = False, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``prompts`` (key, prompt[, system]) with the columns of ``RESPONSE``. Neither cheap nor repeatable: write it before
    it is used twice."""
    ship(prompts.sparkSession)
    rows = prompts.select("key", "prompt", (F.col("system") if "system" in prompts.columns else F.lit(None).cast("string")).alias("system"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [call(model, p, s, json_mode, retries, wait) for p, s in zip(b.column("prompt").to_pylist(), b.column("system").to_pylist())]
            types = {"content": pa.string(), "error": pa.string(), "attempts": pa.int32(), "tokens_in": pa.int64(), "tokens_out": pa.int64(), "seconds": pa.float64()}
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array([g[n] for g in got], t) for n, t in types.items())], names=["key", *types])

    return rows.mapInArrow(run, f"key string, {RESPONSE}")


def prompt_key(prompt: Column, model: Column, params: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", prompt, model, params), 256)


def split_cached(prompts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prompts whose key the cache has, with its content; each other key once)."""
    hits = prompts.join(cache.select("key", "content"), "key")
    return hits, prompts.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def usage(rows: DataFrame) -> DataFrame:
    """total_tokens, api_calls, cache_hits, cache_hit_rate of responses (tokens_in, tokens_out, cached)."""
    u = rows.agg(F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("api_calls"), F.count_if("cached").alias("cache_hits"))
    return u.withColumn("cache_hit_rate", F.col("cache_hits") / F.greatest("api_calls", F.lit(1)))


def review_prompts(cards: DataFrame, prompt: Column) -> DataFrame:
    """key (card_ord), prompt of each card."""
    return cards.select(F.col("card_ord").cast("string").alias("key"), prompt.alias("prompt"))


def parse_reviews(rows: DataFrame) -> DataFrame:
    """card_ord, id, score, issues, edit_front, edit_back of review responses (card_ord, id, content).

    A response that is null, no JSON object or without a numeric score counts ``FALLBACK`` with one issue that says so.
    An id or issues that are missing are the card's and none. Only texts count as issues and edits.
    """
    v = rows.withColumn("v", F.try_parse_json("content")).withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))
    score = F.coalesce(F.try_variant_get("v", "$.score", "double"), F.try_variant_get("v", "$.score", "string").try_cast("double"))
    part = lambda k: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")) == "STRING", F.try_variant_get("v", f"$.{k}", "string"))
    issues = F.coalesce(F.filter(F.try_variant_get("v", "$.issues", "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return v.select(
        "card_ord", F.coalesce(F.when(score.isNotNull(), part("id")), "id").alias("id"), F.coalesce(score, F.lit(FALLBACK)).alias("score"),
        F.when(score.isNull(), F.array(F.lit("no usable review"))).otherwise(issues).alias("issues"),
        *[F.when(score.isNotNull(), part(f"edited.{k}")).alias(f"edit_{k}") for k in ("front", "back")],
    )


def reviews(cards: DataFrame, model: Model, prompt: Column, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Asks the model about each card; what fails gets the fallback, so that no card is lost to a failed call."""
    got = responses(review_prompts(cards, prompt), model, True, retries, wait)
    return parse_reviews(cards.select("card_ord", "id", F.col("card_ord").cast("string").alias("key")).join(got.select("key", "content"), "key", "left"))
