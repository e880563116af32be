"""Vector and lexical retrieval, fusion and reranking over whole question sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaystone.functions import text as T
from quaystone.functions.numeric import ratio


def top_k(scored: DataFrame, by: str, order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each ``by`` with their rank; Spark cuts within partitions before it shuffles."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def _packed(rows: DataFrame, id_col: str, vec_col: str, per_block: int) -> tuple[DataFrame, int]:
    n = max(1, math.ceil(rows.count() / per_block))

    def pack(group):
        import numpy as np
        import pyarrow as pa

        ids = np.asarray(group.column("id").to_pylist(), np.int64)
        vectors = np.asarray(group.column("v").to_pylist(), np.float32)
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary())})

    placed = rows.where(F.col(vec_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("block"), F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    return placed.groupBy("block").applyInArrow(pack, "block int, ids binary, vectors binary"), n


#: Size of the stated query vectors up to which they are sent to every task.
BROADCAST_BYTES = 64 << 20


def _best(scores, ids, k: int):
    """Columns of the ``k`` largest of each row, equal ones by id."""
    import numpy as np

    return np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]


def _cosines(q, x, qi, ids, digits: int):
    """Rounded cosines of all queries with all rows, minus infinity for a query itself."""
    import numpy as np

    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    scores = np.round(np.divide(q @ x.T, size, out=np.zeros_like(size), where=size > 0), digits)
    scores[qi[:, None] == ids[None, :]] = -np.inf
    return scores


def _scanned(held: DataFrame, corpus: DataFrame, k: int, id_col: str, vec_col: str, digits: int, rows: int = 512) -> DataFrame:
    """(query_id, id, score): the best ``k`` a query of each task of the corpus."""
    import numpy as np

    found = held.collect()  # BROADCAST_BYTES at most
    qi = np.array([r["id"] for r in found], np.int64)
    sent = corpus.sparkSession.sparkContext.broadcast((qi, np.array([r["v"] for r in found], np.float32).reshape(len(qi), -1)))

    def search(batches):
        import pyarrow as pa

        qi, q = sent.value
        best: list = [None] * len(range(0, len(qi), rows))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(ids):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64)
            for n, at in enumerate(range(0, len(qi), rows)):
                own = slice(at, at + rows)
                scores, names = _cosines(q[own].astype(np.float64), x, qi[own], ids, digits), np.broadcast_to(ids, (len(qi[own]), len(ids)))
                if best[n] is not None:
                    scores, names = np.concatenate((best[n][0], scores), 1), np.concatenate((best[n][1], names), 1)
                keep = _best(scores, names, k)
                best[n] = np.take_along_axis(scores, keep, 1), np.take_along_axis(names, keep, 1)
        for n, at in enumerate(range(0, len(qi), rows)):
            if best[n] is not None:
                scores, names = best[n]
                ok = np.isfinite(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi[at : at + rows], ok.sum(1))), pa.array(names[ok]), pa.array(scores[ok])], ["query_id", "id", "score"])

    return corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint"), vec_col).mapInArrow(search, "query_id bigint, id bigint, score double")


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", per_block: int = 4096, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): exact cosine neighbours of every query, itself left out.

    Queries of up to ``BROADCAST_BYTES`` go to the tasks that scan the corpus, each
    of which passes on its best ``k`` a query: the corpus is not shuffled. Beyond
    that both sides are packed into blocks, and every pair of blocks is one matrix
    product cut to ``k`` a query. Scores are rounded before they are ranked, equal
    ones by id.
    """
    held = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    if (held.agg(F.sum(F.size("v"))).first()[0] or 0) * 4 <= BROADCAST_BYTES:
        return top_k(_scanned(held, corpus, k, id_col, vec_col, digits), "query_id", [F.desc("score"), "id"], k)
    left, n_left = _packed(queries, id_col, vec_col, per_block)
    right, _ = _packed(corpus, id_col, vec_col, per_block)
    left = left.select(F.col("block").alias("qb"), F.col("ids").alias("qi"), F.col("vectors").alias("qv"))
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("qb"), "ids", "vectors")
    pairs = right.join(left, "qb")

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for ids, vectors, qi, qv in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "qi", "qv"))):
                ids, qi = np.frombuffer(ids, np.int64), np.frombuffer(qi, np.int64)
                x = np.frombuffer(vectors, np.float32).reshape(len(ids), -1).astype(np.float64)
                q = np.frombuffer(qv, np.float32).reshape(len(qi), -1).astype(np.float64)
                scores = _cosines(q, x, qi, ids, digits)
                order = _best(scores, ids, k)
                best = np.take_along_axis(scores, order, 1)
                keep = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, keep.sum(1))), pa.array(ids[order][keep]), pa.array(best[keep])], ["query_id", "id", "score"])

    found = pairs.mapInArrow(multiply, "query_id bigint, id bigint, score double")
    return top_k(found, "query_id", [F.desc("score"), "id"], k)


def words(c) -> Column:
    """Lower-case tokens between blanks, punctuation kept."""
    return F.filter(F.split(F.lower(c), r"[ \t\n\r\x0B\f]+"), lambda t: t != "")


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(query_id, doc_id, score) of every pair that shares a token; negative idf becomes ``floor`` times the mean idf.

    Document tokens are counted once; only terms that some query has travel with
    their document.
    """
    asked = queries.where(F.col(query_text).isNotNull()).select(F.col(query_id).alias("q"), F.explode(words(F.col(query_text))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf"))
    tokens = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("d"), words(F.col(doc_text)).alias("ts"))
    size = tokens.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avgdl"))  # one row
    df = tokens.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(size)).withColumn("idf", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf").alias("mean_idf"))  # one row
    idf = raw.crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("idf") < 0, F.lit(floor) * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    wanted = asked.select("term").distinct().join(idf, "term")
    tf = tokens.select("d", F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(wanted, "term").groupBy("d", "dl", "term", "idf", "avgdl").agg(F.count("*").alias("tf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = asked.join(tf.withColumn("w", weight), "term").groupBy("q", "d").agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))
    return scored.select(F.col("q").alias(query_id), F.col("d").alias(doc_id), "score")


def overlap_top_k(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k: int) -> DataFrame:
    """(query_id, doc_id, shared, rank): the ``k`` documents of every query that hold most of its distinct words.

    A question set of up to ``BROADCAST_TERMS`` words goes to the tasks that scan the
    documents, so that a common word makes no pair outside them; a larger one is
    joined by word.
    """
    side = lambda df, i, t, n: df.where(F.col(t).isNotNull()).select(F.col(i).alias(n), F.explode(F.array_distinct(words(F.col(t)))).alias("term"))
    asked = side(queries, query_id, query_text, "q").distinct()
    order = [F.desc("shared"), doc_id]
    if asked.count() > BROADCAST_TERMS:
        met = asked.join(side(docs, doc_id, doc_text, "d"), "term").groupBy(F.col("q").alias(query_id), F.col("d").alias(doc_id)).agg(F.count("*").alias("shared"))
        return top_k(met, query_id, order, k)
    found = asked.collect()  # BROADCAST_TERMS rows at most
    names = sorted({r["q"] for r in found})
    place = {q: i for i, q in enumerate(names)}
    columns: dict[str, list[int]] = {}
    for r in found:
        columns.setdefault(r["term"], []).append(place[r["q"]])
    held = docs.sparkSession.sparkContext.broadcast((names, columns))

    def count(batches):
        import re

        import numpy as np
        import pyarrow as pa

        names, columns = held.value
        columns = {t: np.array(qs) for t, qs in columns.items()}
        split = re.compile(r"[^ \t\n\r\x0b\f]+").findall
        step = max(k, 4_000_000 // max(1, len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, total = part.column(0), np.zeros((part.num_rows, len(names)), np.int32)
                for d, text in enumerate(part.column(1).to_pylist()):
                    for t in set(split(text)):
                        if (qs := columns.get(t)) is not None:
                            total[d, qs] += 1
                by_id = np.argsort(np.array(ids.to_pylist()), kind="stable")
                best = np.argsort(-total[by_id], axis=0, kind="stable")[:k]
                values = np.take_along_axis(total[by_id], best, 0)
                keep = values > 0
                qi = np.broadcast_to(np.arange(len(names)), best.shape)[keep]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in qi], batch_type), ids.take(pa.array(by_id[best[keep]])), pa.array(values[keep].astype(np.int64))], [query_id, doc_id, "shared"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(queries.schema[query_id].dataType)
    kinds = [queries.schema[query_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()]
    lowered = docs.where(F.col(doc_text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id), F.lower(doc_text).alias("_t"))
    return top_k(lowered.mapInArrow(count, f"`{query_id}` {kinds[0]}, `{doc_id}` {kinds[1]}, shared bigint"), query_id, order, k)


def bm25_candidates(candidates: DataFrame, query: str, doc: str, text: str, content: str, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(query, doc, score) of given candidates (query, doc, query text, content), each list a corpus of its own.

    Idf, mean idf and mean length are those of a query's candidates; an idf below
    zero becomes ``floor`` times the mean one. Candidates that share no token score
    0 and stay. Lists are as long as the caller makes them; each row is one pair.
    """
    rows = candidates.select(query, doc, words(F.coalesce(F.col(text), F.lit(""))).alias("_q"), words(F.coalesce(F.col(content), F.lit(""))).alias("_d"))
    size = rows.groupBy(query).agg(F.count("*").alias("_n"), F.avg(F.size("_d")).alias("_avg"))
    counted = rows.select(query, doc, F.size("_d").alias("_dl"), F.explode("_d").alias("term")).groupBy(query, doc, "_dl", "term").agg(F.count("*").alias("_tf"))
    df = counted.groupBy(query, "term").agg(F.count("*").alias("_df")).join(size, query)
    raw = df.withColumn("_idf", F.ln(F.col("_n") - F.col("_df") + 0.5) - F.ln(F.col("_df") + 0.5))
    mean = raw.groupBy(query).agg(F.avg("_idf").alias("_mean"))
    idf = raw.join(mean, query).select(query, "term", "_avg", F.when(F.col("_idf") < 0, F.lit(floor) * F.col("_mean")).otherwise(F.col("_idf")).alias("_w"))
    asked = rows.select(query, doc, F.explode("_q").alias("term")).groupBy(query, doc, "term").agg(F.count("*").alias("_times"))
    own = asked.join(counted, [query, doc, "term"]).join(idf, [query, "term"])
    part = F.col("_times") * F.col("_w") * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_dl") / F.col("_avg")))
    scored = own.groupBy(query, doc).agg(F.sum(part).alias("score"))
    return rows.select(query, doc).join(scored, [query, doc], "left").fillna(0.0, ["score"])


def score_with(rows: DataFrame, query: str, content: str, score, out: str = "score") -> DataFrame:
    """Adds ``out`` by a plug-in: ``score(queries, contents) -> scores`` over Arrow batches; an earlier one is kept as ``original_score``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in (query, content)]
            found = score(*(batch.column(i).to_pylist() for i in at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(x) for x in found], pa.float64())], [*batch.schema.names, out])

    kept = rows.withColumnRenamed(out, "original_score") if out in rows.columns else rows
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{kinds}, `{out}` double")


#: Distinct (query, term) rows up to which a question set is broadcast to the tasks that score it.
BROADCAST_TERMS = 2_000_000


def bm25_top_k(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``k`` documents of every query, scores rounded before they are ranked.

    Each task scores its documents against the whole question set and passes on
    ``k`` a query, so pairs of common words never leave it. A question set above
    ``BROADCAST_TERMS`` goes through the joins of ``bm25``.
    """
    asked = queries.where(F.col(query_text).isNotNull()).select(F.col(query_id).alias("q"), F.explode(words(F.col(query_text))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf"))
    if asked.count() > BROADCAST_TERMS:
        scored = bm25(queries, docs, query_id, query_text, doc_id, doc_text, k1, b, floor).withColumn("score", F.round("score", digits)).where("score <> 0")
        return top_k(scored, query_id, [F.desc("score"), doc_id], k)
    from quaystone.session import materialise

    # one pass: the null term of every document counts documents and tokens
    tokens = docs.where(F.col(doc_text).isNotNull()).select(words(F.col(doc_text)).alias("ts"))
    terms = tokens.select(F.size("ts").alias("dl"), F.explode(F.concat(F.array_distinct("ts"), F.array(F.lit(None).cast("string")))).alias("term"))
    df = materialise(terms.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dl")), "df")
    n, total = df.where("term is null").agg(F.sum("df"), F.sum("dl")).first()
    n, avgdl = n or 0, (total or 0) / n if n else 0.0
    idf = df.where("term is not null").select("term", (F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf")).first()[0] or 0.0
    found = asked.join(idf, "term").collect()  # BROADCAST_TERMS rows at most
    names = sorted({r["q"] for r in found})
    place = {q: i for i, q in enumerate(names)}
    rows: dict[str, tuple[float, list[int], list[int]]] = {}
    for r in sorted(found, key=lambda r: (r["term"], place[r["q"]])):
        entry = rows.setdefault(r["term"], (floor * mean if r["idf"] < 0 else r["idf"], [], []))
        entry[1].append(place[r["q"]])
        entry[2].append(r["qtf"])
    held = docs.sparkSession.sparkContext.broadcast((names, rows))

    def score(batches):
        import re
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        asked_names, weights = held.value
        type_of_query = pa.array(asked_names).type if asked_names else pa.string()
        # one dense matrix of query terms if it is small, else one column list a term
        dense = len(weights) * len(asked_names) <= 8_000_000
        column = {t: j for j, t in enumerate(weights)}
        matrix = np.zeros((len(weights), len(asked_names)) if dense else (0, 0))
        if dense:
            for t, (_, qs, c) in weights.items():
                matrix[column[t], qs] = c
        weights = {t: (i, np.array(qs), np.array(c, float)) for t, (i, qs, c) in weights.items()}
        split = re.compile(r"[^ \t\n\r\x0b\f]+").findall
        step = max(k, 4_000_000 // max(1, len(asked_names), len(weights) if dense else 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0)
                total = np.zeros((part.num_rows, len(weights) if dense else len(asked_names)))
                for d, text in enumerate(part.column(1).to_pylist()):
                    ts = split(text)
                    base = k1 * (1 - b + b * len(ts) / avgdl) if avgdl else k1
                    for t, tf in Counter(ts).items():
                        if (w := weights.get(t)) is None:
                            continue
                        if dense:
                            total[d, column[t]] = w[0] * tf * (k1 + 1) / (tf + base)
                        else:
                            total[d, w[1]] += w[0] * tf * (k1 + 1) / (tf + base) * w[2]
                total = total @ matrix if dense else total
                total = np.round(total, digits)
                order = np.argsort(np.array(ids.to_pylist()), kind="stable")  # equal scores by id
                ranked = total[order]
                best = np.argsort(-ranked, axis=0, kind="stable")[:k]
                values = np.take_along_axis(ranked, best, 0)
                keep = values != 0
                qi = np.broadcast_to(np.arange(len(asked_names)), best.shape)[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([asked_names[i] for i in qi], type_of_query), ids.take(pa.array(order[best[keep]])), pa.array(values[keep])], [query_id, doc_id, "score"]
                )

    kinds = [queries.schema[query_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()]
    lowered = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_id), F.lower(doc_text).alias("_t"))
    out = lowered.mapInArrow(score, f"`{query_id}` {kinds[0]}, `{doc_id}` {kinds[1]}, score double")
    return top_k(out, query_id, [F.desc("score"), doc_id], k)


def fuse(rankings: list[DataFrame], by: str, key: str, constant: int = 60) -> DataFrame:
    """(by, key, score): reciprocal-rank fusion of rankings with (by, key, rank); null keys are left out."""
    every = rankings[0].select(by, key, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(by, key, "rank"))
    return every.where(F.col(key).isNotNull()).groupBy(by, key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))


def merge_by_score(hits: DataFrame, by: str, key: str, score: str = "score") -> DataFrame:
    """Best score of each key over all expanded queries."""
    return hits.groupBy(by, key).agg(F.max(score).alias(score))


def merge_round_robin(hits: DataFrame, by: str, key: str, bucket: str, rank: str, limit: int) -> DataFrame:
    """Rank by rank across the buckets; a key stays in the first bucket that has it, ranks are taken after that."""
    first = Window.partitionBy(by, key).orderBy(bucket, rank)
    kept = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(by, bucket).orderBy(rank)))
    order = Window.partitionBy(by).orderBy("_r", bucket)
    return kept.withColumn("merged_rank", F.row_number().over(order)).where(F.col("merged_rank") <= limit).drop("_r")


def keep_first(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row for each ``by``: the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def balance_families(hits: DataFrame, by: str, family: str, rank: str, k: int) -> DataFrame:
    """The best hit of each family first, then by rank."""
    best = F.row_number().over(Window.partitionBy(by, family).orderBy(rank))
    staged = hits.withColumn("_tier", F.when(F.col(family).isNotNull() & (best == 1), 0).otherwise(1))
    return staged.withColumn("balanced_rank", F.row_number().over(Window.partitionBy(by).orderBy("_tier", rank))).where(F.col("balanced_rank") <= k).drop("_tier")


#: Weights of the feature reranker.
WEIGHTS = {"semantic": 0.54, "retriever": 0.20, "position": 0.10, "evidence": 0.07, "length": 0.03, "title_overlap": 0.06}


def rerank_features(hits: DataFrame, by: str, query: str, content: str, title: str, score: str, position: str, semantic: str | None = None, evidence: str | None = None) -> DataFrame:
    """Adds the six features and their weighted ``final_score``; blank contents are left out."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    n_words = F.size(words(F.col(content)))
    q, t = T.keywords(F.col(query)), T.keywords(F.col(title))
    features = {
        "semantic": F.col(semantic) if semantic else F.lit(0.0),
        "retriever": F.when(high == low, F.lit(0.0)).otherwise((F.col(score) - low) / (high - low)),
        "position": 1.0 / F.log2(3 + F.greatest(F.col(position), F.lit(0))),
        "evidence": F.log1p(F.col(evidence)) if evidence else F.lit(0.0),
        "length": F.when(n_words == 0, F.lit(0.0)).otherwise(1 - F.exp(-n_words / 120.0)),
        "title_overlap": ratio(F.size(F.array_intersect(q, t)), F.size(q)),
    }
    kept = hits.where(T.strip(F.col(content)) != "")
    out = kept.withColumns({f"f_{k}": v for k, v in features.items()})
    return out.withColumn("final_score", sum((F.lit(wt) * F.col(f"f_{k}") for k, wt in WEIGHTS.items()), F.lit(0.0)))
