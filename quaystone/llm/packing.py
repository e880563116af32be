"""Problem 9: items into containers of fixed capacity, by shortest-pack-first.

Sizes are token counts from ``tokenize.token_counts``. Only the histogram of
lengths (at most ``capacity`` rows, whatever the corpus) reaches the driver. The
histogram is packed longest length first, each into the pattern with the most
room left, and patterns carry counts, so the work does not depend on the number
of items. Patterns become ranges of ranks per length; items get their rank within
their length from two-level counts (no window over a whole length), and look up
their container in the ranges.

Defined results: an item above the capacity is cut into full pieces and a rest;
items of size 0, null or negative are left out; repeated rows are items of their
own; an empty input gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame, Window, functions as F

#: Items that one ranking task sorts.
ITEMS_PER_BUCKET = 100_000


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """[(count, ((length, times), ...))]: packing patterns with how often each is used.

    Longest length first; each goes into the open pattern with the most room
    (the shortest pack), and into a fresh container when none has room.
    """
    by_room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    rooms: list[int] = []  # max-heap by negation

    def put(room: int, count: int, pattern: tuple) -> None:
        if not by_room[room]:
            heapq.heappush(rooms, -room)
        by_room[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = -rooms[0] if rooms else 0
            if room < length:
                fits = capacity // length
                if left >= fits:
                    put(capacity - fits * length, left // fits, ((length, fits),))
                left %= fits
                if left:
                    put(capacity - left * length, 1, ((length, left),))
                left = 0
                continue
            count, pattern = by_room[room].pop()
            if not by_room[room]:
                heapq.heappop(rooms)
            used = min(count, left)
            if count > used:
                put(room, count - used, pattern)
            last = pattern[-1]
            grown = (*pattern[:-1], (length, last[1] + 1)) if last[0] == length else (*pattern, (length, 1))
            put(room - length, used, grown)
            left -= used
    return sorted(((c, p) for groups in by_room.values() for c, p in groups), key=lambda x: (x[1], x[0]))


def rank_ranges(patterns: list[tuple[int, tuple]]) -> dict[int, tuple[list[int], list[int]]]:
    """{length: (starts, first containers)}: ranks from a start on go to consecutive containers."""
    ranges: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    ranks: dict[int, int] = defaultdict(int)
    base = 0
    for count, pattern in patterns:
        for length, times in pattern:
            for _ in range(times):
                starts, firsts = ranges[length]
                starts.append(ranks[length])
                firsts.append(base)
                ranks[length] += count
        base += count
    return dict(ranges)


def pieces(sized: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id_col, piece, size): whole items, or full pieces and a rest for those above the capacity."""
    kept = sized.where(F.col(size_col) > 0)
    numbers = F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col(size_col) / capacity).cast("bigint"))
    return kept.select(id_col, F.explode(numbers).alias("piece"), F.col(size_col).alias("_all")).select(
        id_col, "piece", F.least(F.lit(capacity), F.col("_all") - (F.col("piece") - 1) * capacity).cast("bigint").alias("size")
    )


def with_rank(items: DataFrame, id_col: str, n_items: int, per_bucket: int = ITEMS_PER_BUCKET) -> DataFrame:
    """Adds ``rank``: 0.. within each size, without bringing one size into one task."""
    buckets = max(1, math.ceil(n_items / per_bucket))
    spread = items.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)))
    if buckets == 1:
        return spread.withColumn("rank", F.row_number().over(Window.partitionBy("size").orderBy(id_col, "piece")) - 1).drop("_bucket")
    counts = spread.groupBy("size", "_bucket").count()
    before = Window.partitionBy("size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    # the offsets grow with the items: never broadcast
    own = F.row_number().over(Window.partitionBy("size", "_bucket").orderBy(id_col, "piece")) - 1
    return spread.withColumn("_own", own).join(offsets.hint("merge"), ["size", "_bucket"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_bucket")


def containers(sized: DataFrame, capacity: int = 2048, id_col: str = "doc_id", size_col: str = "n_tokens", per_bucket: int = ITEMS_PER_BUCKET) -> DataFrame:
    """(id_col, piece, container, size) for every item of ``sized`` with a positive size."""
    items = pieces(sized, id_col, size_col, capacity)
    histogram = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}  # capacity rows at most
    ranges = rank_ranges(pack_histogram(histogram, capacity))
    ranked = with_rank(items, id_col, sum(histogram.values()), per_bucket)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for length, rank in zip(batch.column("size").to_pylist(), batch.column("rank").to_pylist()):
                starts, firsts = ranges[length]
                k = bisect.bisect_right(starts, rank) - 1
                found.append(firsts[k] + rank - starts[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("piece"), pa.array(found, pa.int64()), batch.column("size")], [id_col, "piece", "container", "size"]
            )

    kind = sized.schema[id_col].dataType.simpleString()
    return ranked.select(id_col, "piece", "size", F.col("rank").cast("bigint").alias("rank")).mapInArrow(place, f"`{id_col}` {kind}, piece bigint, container bigint, size bigint")
