"""Model responses: validation, routing, the response cache and call planning."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.text import digest
from tidewright.sources.tables import CONDITIONS

#: Marks of a thinking trace before the answer.
THINKING = ("<unused94>", "<think>", "<thinking>")


def first_object(text: str) -> str:
    """The first JSON object of a text by balanced braces, strings and escapes heeded; the whole text when none closes."""
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(max(start, 0), len(text) if start >= 0 else 0):
        char = text[i]
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = char == "\\", char != '"'
        elif char == '"':
            quoted = True
        elif char == "{":
            depth += 1
        elif char == "}":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return text


def parse_response(text: str | None, classes: list[str]) -> tuple[dict[str, float] | None, str | None]:
    """(scores, error name) of a raw response.

    Code fences and a thinking trace are skipped, the first object is read; all
    classes must be numbers in 0 to 1 (NaN is out of range), other keys are
    ignored.
    """
    if text is None:
        return None, "ParseError"
    body = text.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[1] if "\n" in body else body[3:]
        body = body.rsplit("```", 1)[0].strip()
    marks = [body.rfind(m) for m in THINKING if m in body]
    if marks and (at := body.find("{", max(marks))) >= 0:
        body = body[at:]
    try:
        found = json.loads(first_object(body))
    except ValueError:
        return None, "ParseError"
    if not isinstance(found, dict):
        return None, "ParseError"
    if any(c not in found for c in classes):
        return None, "MissingKeyError"
    for c in classes:
        value = found[c]
        if isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value) or not 0 <= value <= 1:
            return None, "RangeError"
    return {c: float(found[c]) for c in classes}, None


def parsed(responses: DataFrame, raw: str, classes: list[str]) -> DataFrame:
    """The responses with the columns scores (map) and parse_error."""
    schema = f"{', '.join(f'`{c}` {t}' for c, t in responses.dtypes)}, scores map<string,double>, parse_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse_response(t, classes) for t in pdf[raw]]
            yield pdf.assign(scores=[s for s, _ in got], parse_error=[e for _, e in got])

    return responses.mapInPandas(run, schema)


def json_scores(responses: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """Well-formed JSON responses without Python: one double column per key and the error."""
    have = F.from_json(raw, "map<string,string>")
    values = {k: F.try_element_at(have, F.lit(k)).try_cast("double") for k in keys}
    missing = have.isNull() | F.exists(F.array(*map(F.lit, keys)), lambda k: ~F.array_contains(F.map_keys(have), k))
    return responses.withColumns(values).withColumn("parse_error", F.when(have.isNull(), "ParseError").when(missing, "MissingKeyError"))


def route_errors(responses: DataFrame, call_error: str, parse_error: str, condition: str) -> DataFrame:
    """error_type of each response: a failed call, a validation error, an unknown condition, else null."""
    kind = F.when(F.col(call_error).isNotNull(), "LLMCallFailed").when(F.col(parse_error).isNotNull(), F.col(parse_error)).when(~F.col(condition).isin(CONDITIONS), "UnknownCondition")
    return responses.withColumn("error_type", kind)


def cache_latest(cache: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last entry of each key."""
    return cache.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(at)))).where("__rn = 1").drop("__rn")


def cache_status(expected: DataFrame, cache: DataFrame, keys: list[str], error: str) -> DataFrame:
    """The expected calls with their status: completed, failed or pending."""
    known = cache.select(*keys, F.when(F.col(error).isNull(), "completed").otherwise("failed").alias("status"))
    return expected.select(*keys).distinct().join(known, keys, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def pending_calls(expected: DataFrame, cache: DataFrame, keys: list[str], error: str, prompt_hash: str) -> DataFrame:
    """Calls to make, with the reason: missing, failed, or stale when the prompt has another hash."""
    known = cache.select(*keys, F.col(error).alias("__e"), F.col(prompt_hash).alias("__h"), F.lit(True).alias("__there"))
    joined = expected.join(known, keys, "left")
    reason = F.when(F.col("__there").isNull(), "missing").when(F.col("__e").isNotNull(), "failed").when(~F.col(prompt_hash).eqNullSafe(F.col("__h")), "stale")
    return joined.withColumn("reason", reason).where("reason is not null").drop("__e", "__h", "__there")


def without_failed(cache: DataFrame, error: str) -> DataFrame:
    return cache.where(F.col(error).isNull())


def cache_key(item: str) -> Column:
    """The item part of a cache key."""
    return digest(F.col(item), 12)


def dry_run(calls: DataFrame, classes: list[str]) -> DataFrame:
    """Every class at one half."""
    return calls.withColumns({c: F.lit(0.5) for c in classes})


def score_calls(calls: DataFrame, prompt: str, scorer: Callable[[list[str]], list[str]], retries: int = 3) -> DataFrame:
    """Calls with the columns raw_text and error from a scorer of batches of prompts; a failing batch is tried again, then recorded."""
    schema = f"{', '.join(f'`{c}` {t}' for c, t in calls.dtypes)}, raw_text string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, error = [None] * len(pdf), None
            for _ in range(retries):
                try:
                    texts, error = scorer(list(pdf[prompt])), None
                    break
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
            yield pdf.assign(raw_text=texts, error=error)

    return calls.mapInPandas(run, schema)


def in_dataset_order(scores: DataFrame, pairs: DataFrame, keys: list[str], position: str, order: str) -> DataFrame:
    """One row per dataset pair with the last score of its key, null where there is none."""
    last = scores.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("__rn = 1").drop("__rn", position)
    return pairs.join(last, keys, "left")
