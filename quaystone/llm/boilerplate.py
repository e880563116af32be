"""Problem 2: lines repeated across one source's documents.

Each text becomes an array of line keys once (written to the shared folder: 8
bytes a line). Nodes are (source, key) with the number of documents that hold
them, edges are consecutive keys of one document. Nodes and edges of high support
stay, connected components of what stays are the boilerplate blocks, and every
occurrence of a block's lines is reported or deleted. Counting is by partial
aggregation, so a source or line that holds a third of all rows is combined
before it is shuffled; the join back is one of rows with a small table of
frequent lines, broadcast only under Spark's size check, else split by AQE.

Defined results: rows with null text or null source have no line and do not
count; a line without a letter never counts; an empty text is a document with one
line that holds no letter; each row is a document, so a row repeated counts as
often as it is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quaystone.llm.forest import spanning_forest
from quaystone.session import materialise

#: Java's White_Space plus the four separators that count as blanks in texts.
BLANK_OR_DIGIT = r"(?U)[\s\x1c-\x1f0-9]+"


def line_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc, source, keys): the key of each line, null for a line without a letter."""
    key = lambda line: F.when(line.rlike(r"\p{L}"), F.xxhash64(F.regexp_replace(F.lower(line), BLANK_OR_DIGIT, "")))
    kept = docs.where(F.col(text_col).isNotNull() & F.col(source_col).isNotNull())
    return kept.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), F.transform(F.split(text_col, "\n", -1), key).alias("keys"))


def frequent_lines(keyed: DataFrame, min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """(source, key, support) of lines in at least ``min_docs`` and ``min_share`` of a source's documents."""
    totals = keyed.groupBy("source").agg(F.count("*").alias("n"))
    held = keyed.select("source", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("key"))
    support = held.groupBy("source", "key").agg(F.count("*").alias("support")).where(F.col("support") >= min_docs)
    return support.join(totals, "source").where(F.col("support") >= F.lit(min_share) * F.col("n") - F.lit(1e-9)).select("source", "key", "support")


def occurrences(keyed: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc, source, line_no, key, prev): frequent lines with the key of the lettered line before."""
    numbered = F.filter(F.transform("keys", lambda k, i: F.struct((i + 1).cast("bigint").alias("line_no"), k.alias("key"))), lambda x: x["key"].isNotNull())
    lettered = keyed.select("doc", "source", numbered.alias("lines"))
    spread = lettered.select("doc", "source", F.explode(F.expr("transform(lines, (x, i) -> named_struct('line_no', x.line_no, 'key', x.key, 'prev', if(i > 0, lines[i - 1].key, null)))")).alias("x"))
    return spread.select("doc", "source", "x.*").join(frequent.select("source", "key"), ["source", "key"])


def blocks(found: DataFrame, frequent: DataFrame, edge_share: float = 0.5) -> DataFrame:
    """(source, key, block): components over edges held by ``edge_share`` of the rarer end's documents."""
    pairs = found.where("prev is not null").groupBy("source", F.col("prev").alias("pa"), F.col("key").alias("pb")).agg(F.count("*").alias("n"))
    ends = [frequent.select("source", F.col("key").alias(k), F.col("support").alias("s" + k)) for k in ("pa", "pb")]
    strong = pairs.join(ends[0], ["source", "pa"]).join(ends[1], ["source", "pb"]).where(F.col("n") >= F.lit(edge_share) * F.least("spa", "spb"))
    node = lambda c: F.concat_ws("\x1f", F.col("source"), F.col(c).cast("string"))
    loops = frequent.select(node("key").alias("a"), node("key").alias("b"), F.lit(0).cast("bigint").alias("w"))
    _, labels = spanning_forest(strong.select(node("pa").alias("a"), node("pb").alias("b"), (-F.col("n")).alias("w")).union(loops))
    return frequent.withColumn("v", node("key")).join(labels, "v").select("source", "key", F.col("root").alias("block"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """(id_col, line_no, block) of each line that belongs to a block of its source."""
    keyed = materialise(line_keys(docs, id_col, text_col, source_col), "keys")
    frequent = materialise(frequent_lines(keyed, min_docs, min_share), "frequent")
    found = materialise(occurrences(keyed, frequent), "occurrences")
    return found.join(blocks(found, frequent), ["source", "key"]).select(F.col("doc").alias(id_col), "line_no", "block")


def without_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text): every text without the lines in ``found`` (id_col, line_no)."""
    drop = found.groupBy(id_col).agg(F.collect_set("line_no").alias("_drop"))
    joined = docs.select(id_col, text_col).join(drop, id_col, "left")
    kept = F.filter(F.split(text_col, "\n", -1), lambda line, i: ~F.array_contains("_drop", (i + 1).cast("bigint")))
    return joined.select(id_col, F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(text_col))
