"""Sinks: JSON lines, CSV, evaluation bundles and append-only vector collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T


def jsonl(df: DataFrame, path: str, sort_keys: bool = False) -> None:
    """One object a line, UTF-8; ``sort_keys`` orders the fields by name."""
    (df.select(*sorted(df.columns)) if sort_keys else df).write.mode("overwrite").json(path, ignoreNullFields=False)


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def bundle(rows: DataFrame, path: str, fields: list[str], means: list[str], failed: str, examples: int = 10) -> None:
    """Per-row results, means overall and by each field, and the first failures, under one folder."""
    from quaystone.operators.metrics import slices

    aggregates = [F.count("*").alias("n"), *[F.avg(m).alias(m) for m in means]]
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    kept = rows.sparkSession.read.parquet(f"{path}/rows")
    kept.agg(*aggregates).write.mode("overwrite").json(f"{path}/overall")
    slices(kept, fields, aggregates).write.mode("overwrite").json(f"{path}/by_field")
    kept.where(failed).limit(examples).write.mode("overwrite").json(f"{path}/failures")


class Collection:
    """A named, append-only vector collection in Parquet: (id, embedding, content, metadata map of scalars)."""

    SCHEMA = "id bigint, embedding array<float>, content string, metadata map<string, string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if self._exists() else self.spark.createDataFrame([], self.SCHEMA)

    def count(self) -> int:
        return self.read().count()

    def add(self, rows: DataFrame, order: str) -> None:
        """Appends (embedding, content, metadata) with ids that continue from the count, in ``order``.

        Ids are dense without a single-task window: ranks within ranges of
        ``order``, plus the counts of the ranges before.
        """
        bad = rows.where(F.col("embedding").isNull() | F.col("content").isNull()).count()
        if bad:
            raise ValueError(f"{bad} rows without text or embedding")
        start = self.count()
        ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
        from quaystone.session import materialise

        ranged = materialise(ranged, "append")
        counts = ranged.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("_first"))
        before = counts.select("_p", "_first", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        out = ranged.join(before, "_p").select((F.lit(start) + F.col("_before") + F.col("_i") - F.col("_first")).cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), "content", F.map_filter("metadata", lambda k, v: v.isNotNull()).alias("metadata"))
        out.write.mode("append").parquet(self.path)

    def recreate(self) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def search(self, queries: DataFrame, k: int, where=None, least: float | None = None) -> DataFrame:
        """(query_id, id, score, rank): nearest of each (query_id, embedding); filters apply before the search."""
        from quaystone.operators.retrieval import vector_top_k

        rows = self.read().where(where) if where is not None else self.read()
        asked = queries.select((-F.col("query_id") - 1).alias("id"), "embedding")  # never equal to a stored id
        hits = vector_top_k(asked, rows, k, "id", "embedding").withColumn("query_id", -F.col("query_id") - 1)
        return hits if least is None else hits.where(F.col("score") >= least)

    def ensure(self, rows: DataFrame, order: str) -> bool:
        """Rebuilds the collection if it doesn't hold as many rows; whether it did."""
        if self.count() == rows.count():
            return False
        self.recreate()
        self.add(rows, order)
        return True
