"""Postings inside arbitrary embedded JSON: a depth-first walk, which no fixed schema can express."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import experience_level

DEPTH = 10
_FIELDS = ("source_job_id", "title", "company", "location", "is_remote", "url", "description")


def found_in(node, host: str, depth: int = 0) -> Iterator[dict]:
    """Objects with a title and a url on the host; nothing below a hit is visited, nor below the depth."""
    if depth > DEPTH:
        return
    if isinstance(node, list):
        for x in node:
            yield from found_in(x, host, depth + 1)
    elif isinstance(node, dict):
        pick = lambda *names: next((node[n] for n in names if node.get(n)), "")
        title, url = pick("title", "name"), pick("url", "jobUrl", "applyUrl")
        if title and url and host in str(url):
            startup = node.get("startup")
            company = pick("startupName", "company") or (startup.get("name") if isinstance(startup, dict) else "") or ""
            place = pick("remote", "locationStr", "location")
            yield dict(zip(_FIELDS, (str(node.get("id", "")), str(title), company if isinstance(company, str) else "", place if isinstance(place, str) else "", "remote" in str(place).lower() or bool(node.get("remote")), str(url), str(node.get("description") or "")), strict=True))
        else:
            for x in node.values():
                yield from found_in(x, host, depth + 1)


def walk(df: DataFrame, host: str, source: str, payload_col: str = "payload") -> DataFrame:
    """RawPosting rows of every blob; blobs that are no JSON are skipped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for blob in pdf["payload"]:
                try:
                    out += found_in(json.loads(blob), host)
                except (TypeError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(out, columns=list(_FIELDS))

    rows = df.select(F.col(payload_col).alias("payload")).mapInPandas(run, "source_job_id string, title string, company string, location string, is_remote boolean, url string, description string")
    return rows.select(F.lit(source).alias("source"), *_FIELDS[:7], experience_level("title", F.lit("")).alias("experience_level"), F.lit(None).cast("string").alias("posted_at_raw"))
