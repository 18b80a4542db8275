"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import leaks
from .embedding_dedup import near_duplicates
from .hard_negatives import ORACLE_SQL as HARD_NEGATIVES_SQL
from .hard_negatives import mine
from .html_extraction import extract
from .ngram_jaccard import jaccard_components
from .packing import pack
from .pii import find
from .source_divergence import ORACLE_SQL as SOURCE_DIVERGENCE_SQL
from .source_divergence import divergences
from .suffix_dedup import ORACLE_SQL as SUFFIX_DEDUP_SQL
from .suffix_dedup import dedupe
from .token_counts import count_tokens
from .toxicity import score, train
from .url_filter import ORACLE_SQL as URL_FILTER_SQL
from .url_filter import judge
from .warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), spark.createDataFrame([(x,) for x in BLOCKED_DOMAINS], "domain string"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(_table(spark, sf_dir, "embeddings"))


#: The block list of op6's query.
BLOCKED_DOMAINS = tuple(f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills", "ads-track", "casino-win", "adult-x", "free-bets") for top in ("com", "net", "org"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

_SHINGLES = """
sh_{t} as (select {id} as id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(10))) when len(w) > 0 then [array_to_string(w, chr(10))] else [] end) as s
  from (select {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from {t}))"""

_LINKS = """
both_ways as (select a, b from links union all select b, a from links),
reached as (select a as id, b as other from both_ways union select r.id, l.b from reached r join both_ways l on l.a = r.other)"""

DECONTAMINATION_SQL = f"""
with {_SHINGLES.format(t="documents", id="doc_id")}, {_SHINGLES.format(t="benchmark", id="item_id")},
items as (select id, len(s) as n, unnest(s) as x from sh_benchmark),
found as (select d.id as doc_id, i.id as item_id, any_value(i.n) as n, count(*) as m from (select id, unnest(s) as x from sh_documents) d join items i using (x) group by 1, 2)
select doc_id, item_id, n as n_item_shingles, m as n_shared from found where 100 * m >= 80 * n"""

JACCARD_SQL = f"""
with recursive {_SHINGLES.format(t="documents", id="doc_id")},
flat as (select id, len(s) as n, unnest(s) as x from sh_documents),
shared as (select a.id as a, b.id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as c from flat a join flat b on a.x = b.x and a.id < b.id group by 1, 2),
links as (select a, b from shared where 100 * c >= 80 * (n + m - c)), {_LINKS}
select d.id as doc_id, cast(len(d.s) as bigint) as n_shingles, least(d.id, coalesce((select min(other) from reached r where r.id = d.id), d.id)) as component_id from sh_documents d"""

EMBEDDING_SQL = f"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93), {_LINKS}
select x.vec_id, (select count(*) from both_ways l where l.a = x.vec_id) as n_links, least(x.vec_id, coalesce((select min(other) from reached r where r.id = x.vec_id), x.vec_id)) as component_id,
  x.vec_id <= coalesce((select min(other) from reached r where r.id = x.vec_id), x.vec_id) as kept from embeddings x"""

ORACLE: dict[str, str] = {
    "op2_decontamination": DECONTAMINATION_SQL,
    "op4_ngram_jaccard": JACCARD_SQL,
    "op6_url_filter": URL_FILTER_SQL,
    "op7_embedding_dedup": EMBEDDING_SQL,
    "op11_source_divergence": SOURCE_DIVERGENCE_SQL,
    "op12_suffix_dedup": SUFFIX_DEDUP_SQL,
    "op13_hard_negatives": HARD_NEGATIVES_SQL,
}
