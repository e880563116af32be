"""Problem 7: passages of held-out records inside a corpus.

Every run of ``length`` words of a record is a gram of two 64-bit hashes. A
blocked Bloom filter of the grams, of a size fixed by parameter, is put together
by a distributed OR over its 64-bit blocks and broadcast. Each document is read
once, its grams are hashed by vector operations, and only those that pass the
filter are shuffled, to an equi-join on both hashes. The filter only saves
shuffle: the result is the same if it lets everything pass. Grams are joined by the
class of records that hold them, so that a passage that a third of all documents
and records share is expanded once.

Latent semantic retrieval alone can't give this result: a run of 12 words in a
document of thousands hardly moves a passage vector, and the result asks for all
of them. See the README.

Defined results: null texts and texts of fewer words have no gram; repeated rows
and gram copies give one row per (document, record); an empty side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quaystone.llm.words import RUN
from quaystone.session import materialise

#: 64-bit blocks of the largest filter: 16 MB, whatever the tables.
MAX_BLOCKS = 1 << 21
#: Blocks put together by one task.
CHUNK = 1 << 14
#: Words of which a worker keeps the hash before it starts over.
CACHED_WORDS = 1_000_000


def _grams(length: int):
    """f(texts) -> (rows, h1, h2) of all runs of ``length`` words, with the row each is in."""
    import numpy as np
    import xxhash

    known: dict[str, int] = {}

    def of(texts):
        flat, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            found = [w.lower() for w in RUN.findall(text)] if not text.isascii() else RUN.findall(text.lower())
            if len(known) > CACHED_WORDS:
                known.clear()
            for w in found:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w)
                flat.append(h)
            sizes[i] = len(found)
        hashes = np.array(flat, np.uint64)
        n = len(hashes) - length + 1
        if n <= 0:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for j in range(length):
            part = hashes[j : j + n]
            h1 = h1 * np.uint64(0x9E3779B97F4A7C15) + part
            h2 = h2 * np.uint64(0xC2B2AE3D27D4EB4F) + (part ^ (part >> np.uint64(31)))
        h1 ^= h1 >> np.uint64(29)
        h1 *= np.uint64(0xBF58476D1CE4E5B9)
        h1 ^= h1 >> np.uint64(32)
        row = np.repeat(np.arange(len(texts)), sizes)
        whole = row[:n] == row[length - 1 :]
        return row[:n][whole], h1[whole].view(np.int64), h2[whole].view(np.int64)

    return of


def _emit(df: DataFrame, id_col: str, text_col: str, length: int, out_id: str, keep=None) -> DataFrame:
    """(out_id, h1, h2) of the grams of a text column that pass ``keep``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        of = _grams(length)
        sieve = keep.value if keep is not None else None
        for batch in batches:
            rows, h1, h2 = of(batch.column(1).to_pylist())
            if sieve is not None:
                u = h1.view(np.uint64)
                mask = _mask(u)
                hit = (sieve[(u & np.uint64(len(sieve) - 1)).astype(np.int64)] & mask) == mask
                rows, h1, h2 = rows[hit], h1[hit], h2[hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(h1), pa.array(h2)], [out_id, "h1", "h2"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, f"`{out_id}` {kind}, h1 bigint, h2 bigint")


def _mask(u):
    """Three bits of a 64-bit block, from the upper bits of the hash."""
    import numpy as np

    one, low = np.uint64(1), np.uint64(63)
    return (one << (u >> np.uint64(58))) | (one << ((u >> np.uint64(52)) & low)) | (one << ((u >> np.uint64(46)) & low))


def bloom(grams: DataFrame, n: int, max_blocks: int = MAX_BLOCKS):
    """The filter as a numpy array of 64-bit blocks: about 32 bits a gram up to ``max_blocks`` blocks."""
    import numpy as np

    blocks = 64
    while blocks < max_blocks and blocks * 2 < n:
        blocks *= 2
    bit = lambda s: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h1, {s}) & 63 as int))")
    mask = bit(58).bitwiseOR(bit(52)).bitwiseOR(bit(46))
    words = grams.select(F.col("h1").bitwiseAND(blocks - 1).alias("at"), mask.alias("mask")).groupBy("at").agg(F.bit_or("mask").alias("mask"))

    def chunk(group):
        import pyarrow as pa

        first = group.column("chunk")[0].as_py()
        part = np.zeros(min(CHUNK, blocks), np.int64)
        part[group.column("at").to_numpy() - first * CHUNK] = group.column("mask").to_numpy()
        return pa.table({"chunk": pa.array([first], pa.int64()), "part": pa.array([part.tobytes()], pa.binary())})

    chunks = words.withColumn("chunk", F.floor(F.col("at") / CHUNK).cast("bigint")).groupBy("chunk").applyInArrow(chunk, "chunk bigint, part binary")
    sieve = np.zeros(blocks, np.uint64)
    for row in chunks.collect():  # max_blocks / CHUNK rows at most
        part = np.frombuffer(row["part"], np.uint64)
        sieve[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(part)] = part
    return sieve


def leaks(docs: DataFrame, held_out: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", record_id: str = "id", record_texts: tuple[str, ...] = ("premise", "hypothesis"), length: int = 12, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(doc_id, record_id): documents with at least ``length`` consecutive words of a record's text."""
    spark = docs.sparkSession
    texts = held_out.select(F.col(record_id).alias("rid"), F.explode(F.array(*record_texts)).alias("t")).distinct()
    grams = materialise(_emit(texts, "rid", "t", length, "rid").distinct(), "grams")
    sieve = spark.sparkContext.broadcast(bloom(grams, grams.count(), max_blocks))
    passed = _emit(docs.select(F.col(doc_id).alias("did"), F.col(doc_text).alias("t")), "did", "t", length, "did", sieve)
    # grams that the same records hold are one class: a passage that many documents and records share is met once, not once a gram
    held = materialise(grams.groupBy("h1", "h2").agg(F.bit_xor(F.xxhash64("rid")).alias("c1"), F.bit_xor(F.xxhash64("rid", F.lit(7))).alias("c2"), F.count("*").alias("n")), "gram-classes")
    first = held.groupBy("c1", "c2", "n").agg(F.min(F.struct("h1", "h2")).alias("g")).select("c1", "c2", "n", "g.h1", "g.h2")
    members = first.join(grams, ["h1", "h2"]).select("c1", "c2", "n", "rid")
    met = passed.join(held, ["h1", "h2"]).select("did", "c1", "c2", "n").distinct()
    return met.join(members, ["c1", "c2", "n"]).select(F.col("did").alias(doc_id), F.col("rid").alias(record_id)).distinct()
