"""File scans as DataFrames: text, JSON, CSV, HTML, PDF, manifests and whole directories."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quaystone.functions.text import squeeze, strip

DOCUMENT = T.StructType([T.StructField("content", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def _document(df: DataFrame, content, **meta) -> DataFrame:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(str(v)))]
    return df.select(content.alias("content"), F.create_map(*pairs).alias("metadata"))


def text(spark: SparkSession, path, split: str | None = None) -> DataFrame:
    """Whole files, or their paragraphs (``split="paragraph"``) or lines (``"line"``), numbered from 1 over all parts; blank ones are dropped."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"))
    if split is None:
        return _document(whole, F.col("value"), source=F.col("source"), loader="text")
    mark = {"paragraph": "\n\n", "line": "\n"}[split]
    parts = whole.select("source", F.posexplode(F.split("value", mark, -1)).alias("pos", "part")).withColumn("part", strip("part")).where("part <> ''")
    return _document(parts, F.col("part"), source=F.col("source"), loader="text", index=F.col("pos") + 1)


def _object(c: Column, content_field: str, source: Column, loader: str, index: Column) -> list[Column]:
    """Content and metadata of one JSON object (as text): its content field, or the whole object."""
    keys = F.from_json(c, T.MapType(T.StringType(), T.StringType()))
    content = F.coalesce(keys[content_field], c)
    own = F.map_from_arrays(F.array(F.lit("source"), F.lit("loader"), F.lit("index")), F.array(source, F.lit(loader), index.cast("string")))
    kept = F.map_filter(keys, lambda k, v: (k != content_field) & ~k.isin("source", "loader", "index"))
    return [content.alias("content"), F.map_concat(kept, own).alias("metadata")]


def jsonl(spark: SparkSession, path, content_field: str = "content") -> DataFrame:
    """One document a line, numbered from 1; lines that are no object are skipped."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"))
    lines = whole.select("source", F.posexplode(F.split("value", "\n", -1)).alias("pos", "line")).where(F.try_parse_json("line").isNotNull() & F.trim("line").startswith("{"))
    return lines.select(*_object(F.col("line"), content_field, F.col("source"), "json", F.col("pos") + 1))


def json(spark: SparkSession, path, content_field: str = "content", documents_key: str = "documents") -> DataFrame:
    """Files that hold an object, an array, or an object with an array under ``documents_key``; numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"))
    inner = F.get_json_object("value", f"$.{documents_key}")
    array = F.when(F.trim("value").startswith("["), F.col("value")).when(F.trim(inner).startswith("["), inner).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    items = F.transform(F.from_json(array, T.ArrayType(T.VariantType())), lambda v: F.to_json(v))
    spread = whole.select("source", F.posexplode(items).alias("pos", "line"))
    return spread.select(*_object(F.col("line"), content_field, F.col("source"), "json", F.col("pos")))


def csv(spark: SparkSession, path) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name is ignored."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def html_text(c: Column) -> Column:
    """Visible text of a page: no script, style or noscript, tags as blanks, common entities decoded."""
    c = F.regexp_replace(c, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return squeeze(F.regexp_replace(c, " ", " "))


def html(spark: SparkSession, path) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(html_text(F.col("value")).alias("value"), F.col("_metadata.file_path").alias("source"))
    return _document(whole.where("value <> ''"), F.col("value"), source=F.col("source"), loader="html")


def pdf(spark: SparkSession, path) -> DataFrame:
    """(source, page, total_pages, content) of each page with text; needs the optional package pypdf on the workers."""

    def pages(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for batch in batches:
            rows = []
            for source, data in zip(batch["path"], batch["content"]):
                found = PdfReader(io.BytesIO(data)).pages
                rows += [(source, k + 1, len(found), t) for k, p in enumerate(found) if (t := (p.extract_text() or "")).strip()]
            yield pd.DataFrame(rows, columns=["source", "page", "total_pages", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(pages, "source string, page int, total_pages int, content string")


def page_document(pages: DataFrame, key: str = "source") -> DataFrame:
    """(key, content): pages in order under ``[PAGE n]`` marks, joined by blank lines."""
    marked = F.concat(F.lit("[PAGE "), F.col("page").cast("string"), F.lit("]\n"), F.col("content"))
    return pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", marked.alias("t")))).alias("ps")).select(key, F.array_join(F.transform("ps", lambda p: p["t"]), "\n\n").alias("content"))


LOADERS = {".txt": text, ".md": text, ".json": json, ".jsonl": jsonl, ".html": html, ".htm": html}


def directory(spark: SparkSession, path: str, recursive: bool = True, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """Documents of all known files under a folder, by the loader of each suffix; files that can't be read are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path")
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    kinds = [r[0] for r in found.select(suffix).distinct().collect()]  # as many as there are suffixes
    frames = []
    for k in sorted(kinds):
        if k in LOADERS and (suffixes is None or k in suffixes):
            files = [r["path"] for r in found.where(suffix == k).collect()]  # the listing, as Spark's own reader holds it
            frames.append(LOADERS[k](spark, files))
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], DOCUMENT)


def manifest(spark: SparkSession, path: str, key: str = "sources", ids: list[str] | None = None) -> DataFrame:
    """Entries of a YAML manifest as rows of text columns; an empty list is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        entries = (yaml.safe_load(f) or {}).get(key)
    if not isinstance(entries, list) or not entries:
        raise ValueError(f"{path}: {key} must be a list with entries")
    names = list(dict.fromkeys(k for e in entries for k in e))
    rows = [tuple(None if e.get(k) is None else str(e[k]) for k in names) for e in entries if ids is None or e.get("id") in ids]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def with_path_parts(df: DataFrame, path_col: str, root: str) -> DataFrame:
    """Adds ``layer`` (the first folder under ``root``) and ``doc_id`` (the file's stem in lower case)."""
    rest = F.regexp_replace(F.regexp_replace(path_col, "^file:/*", "/"), "^" + re.escape(os.path.abspath(root)) + "/?", "")
    return df.withColumn("layer", F.when(rest.contains("/"), F.regexp_extract(rest, "^([^/]+)/", 1))).withColumn("doc_id", F.lower(F.regexp_extract(path_col, r"([^/]+?)(\.[a-z]+)*$", 1)))


def required(df: DataFrame, fields: list[str]) -> DataFrame:
    """The rows, after checking that no required field is missing, null or blank."""
    absent = [f for f in fields if f not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    bad = df.where(reduce(lambda a, b: a | b, [F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "") for f in fields])).count()
    if bad:
        raise ValueError(f"{bad} rows without {fields}")
    return df


def unfinished(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
