"""Scoring replies: chatty text to a JSON object, and its fields; the scorer itself is injected."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_fence


def balanced_object(said: str | None) -> str | None:
    """The whole text if it is an object, else the first part between balanced braces that is one."""
    said = (said or "").strip()
    try:
        return said if isinstance(json.loads(said), dict) else None
    except ValueError:
        pass
    start, depth = said.find("{"), 0
    for k in range(start, len(said)) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(said[k], 0)
        if not depth:
            part = said[start : k + 1]
            try:
                return part if isinstance(json.loads(part), dict) else None
            except ValueError:
                return None
    return None


def _objects(said: pd.Series) -> pd.Series:
    return said.map(balanced_object)


def reply_object(said: Column) -> Column:
    """The JSON object in a chatty reply as text, else null; balancing braces is beyond a regular expression."""
    return F.pandas_udf(_objects, "string")(strip_fence(said))


def parse_reply(reply: Column) -> Column:
    """(score, reasoning, matched_skills, missing_skills, seniority_fit, status) of a JSON object's text.

    Scores are cut to integers and kept within 0 to 100; a missing or unreadable score is null with the
    status ``unreadable``, never 0.
    """
    v = F.try_parse_json(reply)
    number = F.try_variant_get(v, "$.score", "double")
    number = F.coalesce(number, F.try_variant_get(v, "$.score", "string").try_cast("double"))
    score = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e9), F.greatest(F.lit(0), F.least(F.lit(100), number.cast("int"))))
    listed = lambda path: F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))
    return F.struct(score.alias("score"), F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit("")).alias("reasoning"), listed("$.matched_skills").alias("matched_skills"), listed("$.missing_skills").alias("missing_skills"), F.coalesce(F.try_variant_get(v, "$.seniority_fit", "boolean"), F.lit(True)).alias("seniority_fit"), F.when(score.isNull(), "unreadable").otherwise("ok").alias("status"))


def run_scorer(jobs: DataFrame, scorer: Callable[[str], str], budget: int = 0) -> DataFrame:
    """Replies of an injected scorer for (id, prompt); write the result before using it, so each row is scored once.

    A budget above 0 takes the first so many ids; the others are left for the next cycle.
    """
    if budget > 0:
        jobs = jobs.orderBy("id").limit(budget)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "reply": [scorer(p) for p in pdf["prompt"]]})

    return jobs.select("id", "prompt").mapInPandas(run, "id string, reply string")


def run_scorers(jobs: DataFrame, free: list[Callable[[str], str | None]], paid: list[Callable[[str], str | None]] = (), budget: int = 0) -> DataFrame:
    """(id, reply, scorer) for (id, prompt): the first of the injected scorers that answers, free ones before paid ones.

    A scorer that raises or gives None is passed over.  A budget above 0 lets only the first so many ids go on to
    paid scorers, whether they answer or not; a row that no scorer answers has a null reply and is left for the next cycle.
    """
    may_pay = F.lit(True)
    if budget > 0:
        first = jobs.select(F.col("id").alias("_id")).orderBy("_id").limit(budget)
        jobs, may_pay = jobs.join(F.broadcast(first), F.col("id") == F.col("_id"), "left"), F.col("_id").isNotNull()  # at most ``budget`` ids

    def answer(prompt: str, pays: bool) -> tuple[str | None, str | None]:
        for name, scorer in [*((f"free{k}", s) for k, s in enumerate(free)), *((f"paid{k}", s) for k, s in enumerate(paid) if pays)]:
            try:
                reply = scorer(prompt)
            except Exception:  # noqa: BLE001 - whatever a provider raises, the next one is asked
                continue
            if reply is not None:
                return reply, name
        return None, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            said = [answer(p, bool(may)) for p, may in zip(pdf["prompt"], pdf["may_pay"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "reply": pd.Series([r for r, _ in said], dtype=object), "scorer": pd.Series([n for _, n in said], dtype=object)})

    return jobs.select(F.col("id").cast("string").alias("id"), "prompt", may_pay.alias("may_pay")).mapInPandas(run, "id string, reply string, scorer string")
