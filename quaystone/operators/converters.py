"""Raw question-answering and claim datasets as premise / hypothesis / label rows, by explode-style projections.

Labels: 0 entailment, 1 neutral, 2 contradiction. Choices that would be random are
taken by the hash of the row, so a dataset always converts alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ENTAILMENT, NEUTRAL, CONTRADICTION = 0, 1, 2


def _row(premise, hypothesis, label, kind: str) -> Column:
    return F.struct(premise.alias("premise"), hypothesis.alias("hypothesis"), F.lit(label).cast("int").alias("label"), F.lit(kind).alias("kind"))


def _spread(df: DataFrame, id_col: str, *rows: Column) -> DataFrame:
    out = df.select(F.col(id_col).alias("id"), F.explode(F.array(*rows)).alias("x")).select("id", "x.*")
    return out.where((F.trim("premise") != "") & (F.trim("hypothesis") != ""))


def claims(df: DataFrame) -> DataFrame:
    """(id, claim, label, evidence array): one row for each distinct evidence text."""
    label = F.when(F.upper("label").isin("SUPPORTS", "SUPPORTED"), ENTAILMENT).when(F.upper("label").isin("REFUTES", "REFUTED"), CONTRADICTION).otherwise(NEUTRAL)
    spread = df.select("id", "claim", label.alias("label"), F.explode(F.array_distinct("evidence")).alias("premise"))
    return spread.select("id", "premise", F.col("claim").alias("hypothesis"), "label", F.lit("claim").alias("kind")).where("trim(premise) <> '' and trim(hypothesis) <> ''")


def question_pairs(df: DataFrame) -> DataFrame:
    """(id, question, pairs array<struct<question, answer>>): right answers entail, another pair's answer is neutral, a denial contradicts."""
    spread = df.select("id", "question", F.size("pairs").alias("n"), F.posexplode("pairs").alias("i", "p"), "pairs")
    other = F.element_at("pairs", ((F.col("i") + 1 + F.pmod(F.xxhash64("id", "i"), F.greatest(F.col("n") - 1, F.lit(1)))) % F.col("n") + 1).cast("int"))
    premise = F.concat_ws(" ", F.col("p.question"), F.col("p.answer"))
    rows = [
        _row(premise, F.concat(F.lit("The answer is "), F.col("p.answer"), F.lit(".")), ENTAILMENT, "pair"),
        _row(premise, F.when(F.col("n") > 1, F.concat(F.lit("The answer is "), other["answer"], F.lit("."))), NEUTRAL, "mismatch"),
        _row(premise, F.concat(F.lit("The answer is not "), F.col("p.answer"), F.lit(".")), CONTRADICTION, "denial"),
    ]
    return _spread(spread, "id", *rows)


def long_answers(df: DataFrame, most: int = 3) -> DataFrame:
    """(id, answer, claims array): up to ``most`` claims entail, hedged ones are neutral, negated ones contradict."""
    spread = df.select("id", "answer", F.explode(F.slice("claims", 1, most)).alias("c"))
    lowered = F.concat(F.lower(F.substring("c", 1, 1)), F.expr("substring(c, 2)"))
    return _spread(spread, "id", _row(F.col("answer"), F.col("c"), ENTAILMENT, "claim"), _row(F.col("answer"), F.concat(F.lit("It may be that "), lowered), NEUTRAL, "hedged"), _row(F.col("answer"), F.concat(F.lit("It is not true that "), lowered), CONTRADICTION, "negated"))


def clarifications(df: DataFrame) -> DataFrame:
    """(id, question, ambiguous boolean, clarification): whether the question needs the clarification."""
    rows = [
        _row(F.col("question"), F.lit("The question has several readings."), 0, "ambiguity"),
        _row(F.col("question"), F.col("clarification"), NEUTRAL, "clarification"),
    ]
    out = _spread(df, "id", *rows)
    flags = df.select("id", F.when(F.col("ambiguous"), ENTAILMENT).otherwise(CONTRADICTION).alias("own"))
    return out.join(flags, "id").select("id", "premise", "hypothesis", F.when(F.col("kind") == "ambiguity", F.col("own")).otherwise(F.col("label")).alias("label"), "kind")


def conditions(df: DataFrame) -> DataFrame:
    """(id, question, properties array<struct<condition, answer>>, context): an entailed and a neutral row a property, and a context row."""
    spread = df.select("id", "question", F.explode("properties").alias("p"))
    base = F.concat_ws(" ", F.col("p.condition"), F.col("question"))
    two = _spread(spread, "id", _row(base, F.col("p.answer"), ENTAILMENT, "condition"), _row(F.col("question"), F.col("p.condition"), NEUTRAL, "assumption"))
    return two.unionByName(_spread(df.where("context is not null"), "id", _row(F.col("context"), F.col("question"), NEUTRAL, "context")))


def word_senses(data: DataFrame, gold: DataFrame) -> DataFrame:
    """Tab-separated lines and gold letters joined by line number: same sense entails, other senses contradict, half of those by hash are neutral."""
    cols = F.split("line", "\t")
    rows = data.where(F.size(cols) >= 5).select("line_no", cols[0].alias("word"), cols[3].alias("a"), cols[4].alias("b")).join(gold, "line_no")
    same = F.concat(F.lit("The word '"), F.col("word"), F.lit("' means the same as in: "), F.col("b"))
    label = F.when(F.col("gold") == "T", ENTAILMENT).when(F.pmod(F.xxhash64("line_no", "word"), F.lit(2)) == 0, NEUTRAL).otherwise(CONTRADICTION)
    return rows.select(F.col("line_no").alias("id"), F.col("a").alias("premise"), same.alias("hypothesis"), label.alias("label"), F.lit("sense").alias("kind"))


def valid(df: DataFrame) -> DataFrame:
    """Rows with both texts and a label of the three, each (premise, hypothesis) once, its first label kept."""
    ok = df.where("trim(premise) <> '' and trim(hypothesis) <> '' and label in (0, 1, 2)")
    first = F.row_number().over(Window.partitionBy("premise", "hypothesis").orderBy("id", "label"))
    return ok.withColumn("_n", first).where("_n = 1").drop("_n")


def merged(parts: dict[str, tuple[DataFrame, float]], id_col: str = "id", seed: int = 42) -> DataFrame:
    """Sources under- or oversampled to int(n * weight) rows each, in hashed order, tagged with ``dataset``."""
    out = None
    for name, (df, weight) in parts.items():
        n = df.count()
        want = int(n * weight)
        copies = -(-want // n) if n else 0
        if not copies:
            continue
        rows = df.withColumn("copy_index", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("_k", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256))
        rows = rows.orderBy("copy_index", "_k").limit(want).drop("_k").withColumn("dataset", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
