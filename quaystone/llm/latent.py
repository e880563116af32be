"""Latent semantic retrieval: paraphrased passages of stated records in a corpus.

Passages are overlapping word windows. Words are hashed into a fixed number of
features; document frequencies of all passages give the idf weights. A randomised
SVD finds the row space: each task sums A^T (A R) over its passages for a random R
that is derived from the feature number, the sums are orthonormalised, and a
second pass gives the small core matrix. What reaches the driver is features x
rank numbers, whatever the corpus. Passages are indexed by unit vectors of the
latent space; stated query passages meet all of them in blocks of matrix products
that keep pairs above a cosine. Pairs are checked by the longest common
subsequence of their words.

This finds paraphrases and partial copies of a stated set of records. It can't
give the exact result of ``leakage.leaks``: see the README.

Defined results: null and empty texts have no passage; shorter texts are one
passage; repeated rows give one row a pair; an empty side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quaystone.llm.words import RUN
from quaystone.session import materialise

FEATURES = 1 << 15
RANK = 48
#: Words of a passage and of its step.
WINDOW, STEP = 24, 12
#: Least cosine of a candidate: well below the share of words that the exact check asks for.
COSINE = 0.3
#: Columns into which words are folded to bound how many two passages share.
FOLDS = 256
#: Passages of one block of the search.
BLOCK = 4096
#: Largest size of the stated query passages that is broadcast; beyond it they are joined in blocks.
BROADCAST_BYTES = 64 << 20


def _passages(text: str, window: int, step: int) -> list[tuple[int, list[str]]]:
    ws = [w.lower() for w in RUN.findall(text or "")]
    if not ws:
        return []
    last = max(0, len(ws) - window)
    starts = list(range(0, last + 1, step))
    if starts[-1] != last:
        starts.append(last)
    return [(s, ws[s : s + window]) for s in starts]


def _hasher(features: int):
    import xxhash

    known: dict[str, int] = {}

    def of(w: str) -> int:
        h = known.get(w)
        if h is None:
            if len(known) > 500_000:
                known.clear()
            h = known[w] = xxhash.xxh32_intdigest(w) & (features - 1)
        return h

    return of


def _matrix(texts, window: int, step: int, features: int, idf=None):
    """(row of each passage, start, words, dense blocks as lists of (columns, weights))."""
    import numpy as np

    of = _hasher(features)
    rows, starts, words, cols, vals = [], [], [], [], []
    for i, t in enumerate(texts):
        for s, ws in _passages(t, window, step):
            c = np.unique(np.fromiter(map(of, ws), np.int64, len(ws)))
            rows.append(i)
            starts.append(s)
            words.append(ws)
            cols.append(c)
            if idf is not None:
                v = idf[c]
                size = float(np.sqrt(v @ v))
                vals.append(v / size if size else v)
    return rows, starts, words, cols, vals


def _random(features: int, rank: int):
    import numpy as np

    return np.random.default_rng(17).standard_normal((features, rank)).astype(np.float32)


def _summed(df: DataFrame, step_rows, shape: int, width: int):
    """Sum over all tasks of a (shape x width) float64 array made by ``step_rows(texts)``, in chunks of rows."""
    import numpy as np

    chunk = max(1, (1 << 17) // width)

    def run(batches):
        import pyarrow as pa

        total = np.zeros((shape, width))
        for batch in batches:
            step_rows(batch.column(0).to_pylist(), total)
        parts = [(k, total[k : k + chunk].tobytes()) for k in range(0, shape, chunk)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([b for _, b in parts], pa.binary())], ["k", "part"])

    def add(group):
        import pyarrow as pa

        total = None
        for b in group.column("part"):
            x = np.frombuffer(b.as_py())
            total = x.copy() if total is None else total + x
        return pa.table({"k": group.column("k")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    sums = df.mapInArrow(run, "k bigint, part binary").groupBy("k").applyInArrow(add, "k bigint, part binary")
    out = np.zeros((shape, width))
    for r in sums.collect():  # shape x width numbers in all
        x = np.frombuffer(r["part"]).reshape(-1, width)
        out[r["k"] : r["k"] + len(x)] = x
    return out


def fit(texts: DataFrame, text_col: str = "text", features: int = FEATURES, rank: int = RANK, window: int = WINDOW, step: int = STEP, parts: int | None = None):
    """(idf, basis): weights of the features, and the (features x rank) map into the latent space."""
    import numpy as np

    rows = texts.where(F.length(text_col) > 0).select(F.col(text_col).alias("t"))
    rows = rows.coalesce(parts) if parts else rows

    def count(ts, total):
        _, _, _, cols, _ = _matrix(ts, window, step, features)
        for c in cols:
            total[c, 0] += 1
        total[0, 1] += len(cols)

    counts = _summed(rows, count, features, 2)
    n = counts[0, 1]
    idf = np.log((1 + n) / (1 + counts[:, 0])).astype(np.float32)
    shared = texts.sparkSession.sparkContext.broadcast((idf, _random(features, rank)))

    def sketch(ts, total):
        weights, omega = shared.value
        _, _, _, cols, vals = _matrix(ts, window, step, features, weights)
        for c, v in zip(cols, vals):
            total[c] += np.outer(v, v @ omega[c])

    basis, _ = np.linalg.qr(_summed(rows, sketch, features, rank))
    basis = basis.astype(np.float32)
    turned = texts.sparkSession.sparkContext.broadcast((idf, basis))

    def core(ts, total):
        weights, q = turned.value
        _, _, _, cols, vals = _matrix(ts, window, step, features, weights)
        if cols:
            z = np.stack([v @ q[c] for c, v in zip(cols, vals)]).astype(np.float64)
            total += z.T @ z

    m = _summed(rows, core, rank, rank)
    _, vectors = np.linalg.eigh(m)
    return idf, (basis @ vectors[:, ::-1]).astype(np.float32)


def _embedded(df: DataFrame, id_col: str, text_col: str, model, window: int, step: int, features: int) -> DataFrame:
    """(id, start, words, vector): blocks of unit vectors of a table's passages, as one row a batch of ``BLOCK``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        idf, basis = model.value
        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1).to_pylist()
            rows, starts, words, cols, vals = _matrix(texts, window, step, features, idf)
            for a in range(0, len(rows), BLOCK):
                z = np.stack([v @ basis[c] for c, v in zip(cols[a : a + BLOCK], vals[a : a + BLOCK])]).astype(np.float32)
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
                own = ids.take(pa.array(rows[a : a + BLOCK]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own.to_pylist()], pa.list_(own.type)), pa.array([[" ".join(w) for w in words[a : a + BLOCK]]], pa.list_(pa.string())), pa.array([z.tobytes()], pa.binary())],
                    ["ids", "words", "vectors"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.where(F.length(text_col) > 0).select(id_col, text_col).mapInArrow(run, f"ids array<{kind}>, words array<string>, vectors binary")


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        m = row & at.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - bin(row).count("1")


def common_subsequences(a, b):
    """``common_subsequence`` of each row of two arrays of word numbers; negative numbers equal nothing, at most 64 columns in ``a``."""
    import numpy as np

    bits = np.left_shift(np.uint64(1), np.arange(a.shape[1], dtype=np.uint64))
    a = np.where(a < 0, -1, a)
    row = np.full(len(a), ~np.uint64(0))
    for k in range(b.shape[1]):
        m = row & np.where((a == b[:, k : k + 1]) & (a >= 0), bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        row = (row + m) | (row - m)
    return np.bitwise_count(~row).astype(np.int64)


def _numbered(passages: list[str], vocabulary: dict[str, int], grow: bool):
    """Word numbers of passages, a row each, filled up with -1; words that aren't in the vocabulary are -1 unless it may grow."""
    import numpy as np

    split = [p.split(" ") for p in passages]
    out = np.full((len(split), max(map(len, split), default=1)), -1, np.int32)
    for i, ws in enumerate(split):
        out[i, : len(ws)] = [vocabulary.setdefault(w, len(vocabulary)) for w in ws] if grow else [vocabulary.get(w, -1) for w in ws]
    return out, np.array([len(ws) for ws in split])


def similar_passages(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "id", query_text: str = "text", cosine: float = COSINE, least: float = 0.5, window: int = WINDOW, step: int = STEP, features: int = FEATURES, rank: int = RANK, model=None) -> DataFrame:
    """(doc_id, query_id, similarity, shared, answered): best passage pair of each document and stated record.

    ``shared`` is the longest common subsequence over the record passage's words,
    at least ``least``; all pairs of passages above ``cosine`` are checked.
    ``answered`` is the answer check: the share of the record passage's figures
    (words with a digit) that the document's passage holds too, 1 if it has none.
    """
    spark = docs.sparkSession
    fitted = model or fit(docs, doc_text, features, rank, window, step)
    shared = spark.sparkContext.broadcast(fitted)
    asked = queries.select(F.col(query_id).alias("qid"), F.col(query_text).alias("qt")).where(F.length("qt") > 0).distinct()
    left = materialise(_embedded(asked, "qid", "qt", shared, window, step, features), "latent-queries")
    right = _embedded(docs.select(F.col(doc_id).alias("did"), F.col(doc_text).alias("dt")), "did", "dt", shared, window, step, features)
    d_kind, q_kind = docs.schema[doc_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    schema = f"`{doc_id}` {d_kind}, `{query_id}` {q_kind}, similarity double, shared double, answered double"

    def best_pairs(doc_block, query_block):
        import numpy as np

        (dids, dwords, dvectors), (qids, qwords, qvectors) = doc_block, query_block
        d = np.frombuffer(dvectors, np.float32).reshape(len(dids), -1)
        q = np.frombuffer(qvectors, np.float32).reshape(len(qids), -1)
        best: dict = {}
        vocabulary: dict[str, int] = {}
        (qn, sizes), (dn, _) = _numbered(qwords, vocabulary, True), _numbered(dwords, vocabulary, False)
        counts = np.zeros((FOLDS, len(qids)), np.float32)
        at, k = np.nonzero(qn >= 0)
        np.add.at(counts, (qn[at, k] % FOLDS, at), 1)
        for a in range(0, len(dids), 512):
            scores = d[a : a + 512] @ q.T
            holds = np.zeros((len(scores), FOLDS), np.float32)
            at, k = np.nonzero(dn[a : a + 512] >= 0)
            holds[at, dn[a + at, k] % FOLDS] = 1
            # no subsequence is longer than the number of the record's words that occur at all
            rows, cols = np.nonzero((scores >= cosine) & (holds @ counts >= least * sizes - 1e-3))
            for f in range(0, len(rows), 1 << 15):
                i, j = rows[f : f + (1 << 15)], cols[f : f + (1 << 15)]
                if qn.shape[1] <= 64:
                    shares = common_subsequences(qn[j], dn[a + i]) / sizes[j]
                else:
                    shares = np.array([common_subsequence(qwords[y].split(" "), dwords[a + x].split(" ")) / sizes[y] for x, y in zip(i, j)])
                for x, y, part in zip(i, j, shares):
                    key = (dids[a + x], qids[y])
                    if part >= least and (key not in best or (part, scores[x, y]) > best[key][:2]):
                        figures = {w for w in qwords[y].split(" ") if not w.isalpha()}
                        best[key] = (float(part), float(scores[x, y]), len(figures.intersection(dwords[a + x].split(" "))) / len(figures) if figures else 1.0)
        return best

    def emitted(best, d_type, q_type):
        import pyarrow as pa

        keys = list(best)
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in keys], d_type), pa.array([x for _, x in keys], q_type), pa.array([best[x][1] for x in keys], pa.float64()), pa.array([best[x][0] for x in keys], pa.float64()), pa.array([best[x][2] for x in keys], pa.float64())],
            [doc_id, query_id, "similarity", "shared", "answered"],
        )

    size = left.agg(F.sum(F.length("vectors") + F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)))).first()[0] or 0
    q_type = left.schema["ids"].dataType.elementType
    if size <= BROADCAST_BYTES:
        # the stated queries go to every task once; passages of the corpus are not shuffled
        held = spark.sparkContext.broadcast([(r["ids"], r["words"], bytes(r["vectors"])) for r in left.collect()])

        def meet(batches):
            from pyspark.sql.pandas.types import to_arrow_type

            for batch in batches:
                d_type = batch.schema.field("ids").type.value_type
                for block in zip(*(batch.column(c).to_pylist() for c in ("ids", "words", "vectors"))):
                    for query_block in held.value:
                        yield emitted(best_pairs(block, query_block), d_type, to_arrow_type(q_type))

        found = right.mapInArrow(meet, schema)
    else:
        left = left.select(F.monotonically_increasing_id().alias("block"), F.col("ids").alias("qids"), F.col("words").alias("qwords"), F.col("vectors").alias("qvectors"))
        left = materialise(left, "latent-blocks")
        blocks = [r["block"] for r in left.select("block").collect()]  # one number for BLOCK query passages
        pairs = right.withColumn("block", F.explode(F.array(*[F.lit(b) for b in blocks]))).join(left, "block")

        def search(batches):
            for batch in batches:
                types = (batch.schema.field("ids").type.value_type, batch.schema.field("qids").type.value_type)
                for row in zip(*(batch.column(c).to_pylist() for c in ("ids", "words", "vectors", "qids", "qwords", "qvectors"))):
                    yield emitted(best_pairs(row[:3], row[3:]), *types)

        found = pairs.mapInArrow(search, schema)
    return found.groupBy(doc_id, query_id).agg(F.max(F.struct("shared", "similarity", "answered")).alias("x")).select(doc_id, query_id, "x.similarity", "x.shared", "x.answered")
