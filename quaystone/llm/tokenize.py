"""Problem 8: the whole corpus as ids of a public byte-level BPE.

Plan: every scan task splits its texts into pre-tokens once and puts them into
blocks of bounded size. A block keeps its distinct words and, for each document,
the place of each pre-token's word among them (its positions, as 32-bit numbers);
no text is shuffled. The distinct words of all blocks are made distinct again,
each is encoded exactly once, and the ids are joined back to the (block, word)
rows. A co-group brings every block's positions together with its coded words,
and the ids are gathered by position. The number of tasks is that of the scan and
of the session's shuffle partitions, whatever the corpus.

Defined results: null and empty texts give an empty list; every input row gives
one output row (repeated rows stay repeated); marker tokens written in a text
are ordinary text. Extra columns of the input are not read.
"""

from __future__ import annotations

import base64
import functools
import os

from pyspark.sql import DataFrame, functions as F

from quaystone.session import materialise

#: Characters of text in one block; bounds the memory of a co-group task.
BLOCK_CHARS = 4_000_000

#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DEFAULT_VOCABULARY = os.environ.get("QUAYSTONE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


@functools.lru_cache(maxsize=4)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Places(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def in_blocks(docs: DataFrame, id_col: str, text_col: str, pattern: str = PATTERN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, doc, places, words), written: a row for each document with the places of its pre-tokens, and one for each block with its words.

    ``words`` is null in the rows of documents, ``places`` in those of blocks. A
    block holds about ``block_chars`` characters, and one document at least.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def split_up(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        context, split, number = TaskContext.get(), _splitter(pattern), 0
        first = (context.partitionId() if context else 0) << 32
        for batch in batches:
            texts = batch.column(1)
            start, chars, places, words = 0, 0, [], _Places()

            def block(stop):
                n, kind = stop - start, pa.int64()
                own = pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n + 1, first + number), kind), pa.concat_arrays([batch.column(0).slice(start, n), pa.nulls(1, batch.column(0).type)]), pa.array([*places, None], pa.binary()), pa.array([None] * n + [list(words)], pa.list_(pa.string()))],
                    ["block", "doc", "places", "words"],
                )
                return own

            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                if chars and chars + len(text) > block_chars:
                    yield block(i)
                    number += 1
                    start, chars, places, words = i, 0, [], _Places()
                places.append(np.fromiter(map(words.__getitem__, split(text)), np.int32).tobytes())
                chars += len(text)
            if batch.num_rows > start:
                yield block(batch.num_rows)
                number += 1

    out = f"block bigint, doc {id_type}, places binary, words array<string>"
    return materialise(docs.select(id_col, text_col).mapInArrow(split_up, out), "blocks")


def encode_words(words: DataFrame, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """(word, code): each distinct word encoded once; code holds 32-bit little-endian ids."""

    def encode(batches):
        import array

        import pyarrow as pa

        piece = _encoder(vocabulary, pattern)._encode_single_piece
        for batch in batches:
            given = batch.column(0)
            codes = [array.array("i", piece(w.encode())).tobytes() for w in given.to_pylist()]
            yield pa.RecordBatch.from_arrays([given, pa.array(codes, pa.binary())], ["word", "code"])

    return words.select("word").distinct().mapInArrow(encode, "word string, code binary")


def _reassembled(blocks: DataFrame, coded: DataFrame, id_col: str, id_type: str, counts_only: bool) -> DataFrame:
    def put_together(docs, table):
        import numpy as np
        import pyarrow as pa

        order = table.column("at").to_numpy()
        codes = [b""] * len(order)
        for k, code in zip(order.tolist(), table.column("code").to_pylist()):
            codes[k] = code
        length = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        begin, flat = np.cumsum(length) - length, np.frombuffer(b"".join(codes), "<i4")
        rows = docs.column("places").to_pylist()
        at = np.frombuffer(b"".join(rows), np.int32)
        ends = np.cumsum([len(r) // 4 for r in rows])
        upto = np.concatenate(([0], np.cumsum(length[at])))
        sizes = np.concatenate(([0], upto[ends]))
        ids = docs.column("doc").combine_chunks()
        if counts_only:
            return pa.table({id_col: ids, "n_tokens": pa.array(np.diff(sizes), pa.int64())})
        gathered = flat[np.repeat(begin[at] - upto[:-1], length[at]) + np.arange(upto[-1])]
        return pa.table({id_col: ids, "ids": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(gathered, pa.int32()))})

    out = f"`{id_col}` {id_type}, " + ("n_tokens bigint" if counts_only else "ids array<int>")
    return blocks.groupBy("block").cogroup(coded.groupBy("within")).applyInArrow(put_together, out)


def _run(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str, block_chars: int, counts_only: bool) -> DataFrame:
    blocks = in_blocks(docs, id_col, text_col, pattern, block_chars)
    words = blocks.where("words is not null").select(F.col("block").alias("within"), F.posexplode("words").alias("at", "word"))
    codes = encode_words(words, vocabulary, pattern)
    coded = words.join(codes, "word").select("within", "at", "code")
    rows = blocks.where("words is null").select("block", "doc", "places")
    return _reassembled(rows, coded, id_col, docs.schema[id_col].dataType.simpleString(), counts_only)


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id_col, ids array<int>) of every row of ``docs``."""
    return _run(docs, id_col, text_col, vocabulary, pattern, block_chars, False)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id_col, n_tokens) of every row of ``docs``, by the same plan without keeping the ids."""
    return _run(docs, id_col, text_col, vocabulary, pattern, block_chars, True)


def token_bytes(spark, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, bytes): the token-byte table, as large as the vocabulary."""
    lines = spark.read.text(vocabulary)
    part = F.split("value", " ")
    return lines.select(part[1].cast("int").alias("id"), F.unbase64(part[0]).alias("bytes"))


def decode(encoded: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text): ids joined with the token-byte table and concatenated by position.

    An empty list gives the empty text; a null list gives null.
    """
    rows = encoded.select(id_col, F.monotonically_increasing_id().alias("row"), "ids")
    spread = rows.select("row", F.posexplode("ids").alias("pos", "id"))
    table = token_bytes(encoded.sparkSession, vocabulary)
    texts = (
        spread.join(F.broadcast(table), "id")  # the vocabulary bounds its size
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("parts"))
        .select("row", F.expr("decode(aggregate(parts, X'', (a, p) -> concat(a, p.bytes)), 'UTF-8')").alias("decoded"))
    )
    return rows.join(texts, "row", "left").select(id_col, F.when(F.col("ids").isNotNull(), F.coalesce("decoded", F.lit(""))).alias("text"))
