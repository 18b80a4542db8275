"""The fetch cycle as a stream: what lands in a folder is conformed and merged, batch by batch, into known postings.

Outcomes and the postings known after a batch are written to folders of the batch's number, which a replayed
batch overwrites; so an outcome is written once and a posting seen in an earlier batch is found again.

``run_available`` keeps what is known as a snapshot for each batch, for small collections.  ``run_incremental`` keeps it in two keyed
tables, the keys that postings are found by and the postings, and reads and writes only the buckets that a batch touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import posted_at
from ..functions.text import dedupe_hash
from ..operators.resolve import merge, replay, vias
from ..sources.payloads import ARRIVAL, FAMILIES
from .state import KeyedTable

#: A known posting: the key and the place in arrival that it has kept, its fields, and every url that it was seen at.
POSTING = ("key", "seq", "source", "source_job_id", "title", "company", "location", "is_remote", "url", "apply_url", "description", "experience_level", "posted_at", "dedupe_hash", "source_urls")


def conform(df: DataFrame, family: str, batch: int = 0) -> DataFrame:
    """Landed payloads of a family as postings with key, hash, date and ``seq``, their order of arrival.

    That is the batch, the landed row's own ``seq`` (rows without one in the order of the files), and the place in its payload.
    """
    landed = df.withColumn(ARRIVAL, F.coalesce("seq", F.monotonically_increasing_id()) if "seq" in df.columns else F.monotonically_increasing_id())
    rows = FAMILIES[family](landed)
    seq = F.struct(F.lit(batch).cast("long").alias("batch"), F.col(ARRIVAL).alias("landed"), F.coalesce("pos", F.lit(0)).alias("pos"))
    key = F.sha2(F.concat_ws("|", F.to_json(seq), "source", "url", F.coalesce("source_job_id", F.lit("")), "title", "company", "location"), 256)
    rows = rows.withColumns({"key": key, "seq": seq, "dedupe_hash": dedupe_hash("company", "title", "location"), "posted_at": posted_at(F.col("posted_at_raw")), "apply_url": F.lit(None).cast("string"), "source_urls": F.array("url")})
    return rows.select(*POSTING)


def known_after(existing: DataFrame | None, incoming: DataFrame, merged: DataFrame) -> DataFrame:
    """The postings known after a batch: existing and inserted ones, with what merged rows added to them."""
    changed = merged.where("keeper is not null").groupBy("keeper").agg(*(F.any_value(c).alias(f"_{c}") for c in ("source_urls", "description", "apply_url")))
    fresh = incoming.join(merged.where("outcome = 'inserted'").select("key"), "key", "left_semi")
    rows = (fresh if existing is None else existing.unionByName(fresh)).join(changed, F.col("key") == F.col("keeper"), "left")
    return rows.withColumns({c: F.coalesce(f"_{c}", c) for c in ("source_urls", "description", "apply_url")}).select(*POSTING)


def _latest(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """The newest complete snapshot of an earlier batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [x.getPath() for x in fs.listStatus(path)]
    done = [int(x.getName()[6:]) for x in found if x.getName().startswith("batch=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    done = [k for k in done if k < before]
    return spark.read.parquet(f"{folder}/batch={max(done)}").select(*POSTING) if done else None


def run_available(spark: SparkSession, landing: str, family: str, out: str, checkpoint: str, now: F.Column, max_age_days: int = 30, known: str | None = None) -> None:
    """Process all files that have landed since the last call; outcomes go to ``out``/batch=N, known postings to ``known``/batch=N.

    ``known`` is beside ``out`` by default.  A snapshot is read only when it is complete, and only by later batches.
    """
    files = spark.readStream.schema("payload string, slug string, location string, url string, seq long").json(landing)
    known = known or out.rstrip("/") + "-known"

    def cycle(batch: DataFrame, batch_id: int) -> None:
        incoming = conform(batch.persist(), family, batch_id)
        existing = _latest(spark, known, batch_id)
        merge(incoming, now, max_age_days, existing).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        merged = spark.read.parquet(f"{out}/batch={batch_id}")
        known_after(existing, incoming, merged).write.mode("overwrite").parquet(f"{known}/batch={batch_id}")
        batch.unpersist()

    files.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


_SEQ = "struct<batch: bigint, landed: bigint, pos: int>"
KEYS = f"via string, keeper string, seq {_SEQ}"
POSTINGS = f"key string, seq {_SEQ}, source string, source_job_id string, title string, company string, location string, is_remote boolean, url string, apply_url string, description string, experience_level string, posted_at timestamp, dedupe_hash string"


def known_tables(spark: SparkSession, folder: str, **options: int) -> tuple[KeyedTable, KeyedTable]:
    """The keys that known postings are found by, each with its keeper, and the postings; a posting's urls are its keys that begin with ``u:``."""
    return KeyedTable(spark, f"{folder}/keys", "via", KEYS, **options), KeyedTable(spark, f"{folder}/postings", "key", POSTINGS, **options)


def merge_batch(incoming: DataFrame, batch_id: int, keys: KeyedTable, postings: KeyedTable, out: str, now: F.Column, max_age_days: int = 30) -> None:
    """Merge a batch of postings into the known ones: outcomes go to ``out``, changes to the tables as version ``batch_id``.

    A batch that is merged again reads the versions before its own and writes the same once more.
    """
    spark = incoming.sparkSession
    edges = vias(incoming, "seq").withColumnRenamed("key", "own")
    wanted = edges.select("via").distinct()
    known = keys.read(keys.buckets_of(wanted), batch_id).join(wanted, "via", "left_semi")
    found, keepers, _ = replay(incoming, now, max_age_days, known=known.select("via", "keeper"))
    found.write.mode("overwrite").parquet(out)
    found = spark.read.schema(found.schema).parquet(out)

    added = edges.join(found.withColumnRenamed("key", "own"), "own").where("outcome = 'inserted' or outcome = 'merged' and via like 'u:%'")
    keys.apply(added.groupBy("via").agg(F.min_by("keeper", "seq").alias("keeper"), F.min("seq").alias("seq")), batch_id)

    told = keepers.select(F.col("keeper").alias("key"), F.col("description").alias("_text"), F.col("apply_url").alias("_apply"))
    fresh = incoming.join(found.where("outcome = 'inserted'").select("key"), "key", "left_semi").join(told, "key", "left")
    fresh = fresh.withColumns({"description": F.col("_text"), "apply_url": F.col("_apply")})
    others = told.join(fresh.select("key"), "key", "left_anti")
    old = postings.read(postings.buckets_of(others), batch_id).join(others, "key")
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    text = F.when(size("_text") > size("description"), F.col("_text")).otherwise(F.col("description"))
    apply = F.when(size("apply_url") > 0, F.col("apply_url")).otherwise(F.coalesce("_apply", "apply_url"))
    old = old.withColumns({"_text": text, "_apply": apply}).where("not (_text <=> description) or not (_apply <=> apply_url)")
    old = old.withColumns({"description": F.col("_text"), "apply_url": F.col("_apply")})
    columns = [c for c in POSTING if c != "source_urls"]
    postings.apply(fresh.select(*columns).unionByName(old.select(*columns)), batch_id)


def run_incremental(spark: SparkSession, landing: str, family: str, out: str, checkpoint: str, state: str, now: F.Column, max_age_days: int = 30, **options: int) -> None:
    """As ``run_available``, with what is known in the keyed tables of the folder ``state``."""
    files = spark.readStream.schema("payload string, slug string, location string, url string, seq long").json(landing)

    def cycle(batch: DataFrame, batch_id: int) -> None:
        merge_batch(conform(batch.persist(), family, batch_id), batch_id, *known_tables(spark, state, **options), f"{out}/batch={batch_id}", now, max_age_days)
        batch.unpersist()

    files.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
