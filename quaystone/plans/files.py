"""Queries that write tables and read them back, and streams over them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quaystone.operators import joins
from quaystone.plans.evaluation import NEWEST, r6
from quaystone.plans.registry import query
from quaystone.session import checkpoint_dir
from quaystone.sinks import files as sinks
from quaystone.sources import files as sources
from quaystone.sources.tables import table
from quaystone.streaming import online


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/quaystone-{name}-{uuid.uuid4().hex}"


@query("SELECT id, task_family, theme FROM question_labels")
def jsonl_round_trip(spark, d):
    path = _folder(spark, "jsonl")
    sinks.jsonl(table(spark, d, "question_labels"), path)
    return spark.read.json(path).select("id", "task_family", "theme")


@query("SELECT org_id, org_name, len(aliases) AS n_aliases FROM source_orgs")
def csv_round_trip(spark, d):
    path = _folder(spark, "csv")
    sinks.csv(table(spark, d, "source_orgs"), path)
    back = sources.csv(spark, path)
    return back.select(F.col("org_id").cast("bigint").alias("org_id"), "org_name", F.size(F.from_json("aliases", "array<string>")).alias("n_aliases"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, CAST(vec_id AS VARCHAR) AS content, CAST(label AS VARCHAR) AS label FROM embeddings")
def vector_collection(spark, d):
    """Two appends to a collection: ids run on."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("vec_id").cast("string").alias("content"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    store = sinks.Collection(spark, _folder(spark, "collection"))
    middle = rows.agg(F.percentile_approx("vec_id", 0.5)).first()[0]
    store.add(rows.where(F.col("vec_id") <= middle), "vec_id")
    store.add(rows.where(F.col("vec_id") > middle), "vec_id")
    return store.read().select("id", "content", F.col("metadata")["label"].alias("label"))


@query(f"WITH {NEWEST} SELECT detail_no, id FROM newest WHERE detail_no % 3 <> 0")
def resume_unfinished(spark, d):
    rows = joins.keep_last(table(spark, d, "gate_details"), "detail_no", "received_at", ["id"])
    return sources.unfinished(rows, rows.where("detail_no % 3 = 0"), "detail_no")


@query("SELECT type AS expected, action AS predicted, count(*) AS n FROM gate_details WHERE type IS NOT NULL AND action IS NOT NULL GROUP BY 1, 2")
def streaming_confusion(spark, d):
    rows = table(spark, d, "gate_details").select("type", "action")
    path = _folder(spark, "stream")
    rows.write.parquet(path)
    stream = online.results(spark, path, "type string, action string")
    return online.run_to_memory(online.running_confusion(stream, "type", "action"), f"confusion_{uuid.uuid4().hex[:8]}")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1")
def streaming_windows(spark, d):
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    path = _folder(spark, "stream")
    rows.write.parquet(path)
    stream = online.results(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))
    out = online.windowed_rates(stream, "ts", F.col("event_type") == "purchase")
    return online.run_to_memory(out, f"windows_{uuid.uuid4().hex[:8]}").select(F.col("window.start").alias("day"), "n", r6("rate", "rate"))
