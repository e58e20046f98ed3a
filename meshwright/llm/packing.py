"""Filling fixed-capacity containers by minimum bin slack over the histogram of sizes.

Items of one size are interchangeable, so containers are planned over the counts of sizes:
at most ``capacity`` numbers, whatever the corpus. A plan step is a multiset of sizes and how
often it is used. Each step takes the largest size left and fills the room beside it by a
bitset subset-sum over all sizes left (each as often as it is there); the fullest feasible
combination is removed as often as the counts allow, which uses up one size at least. Items
then find their container from their exact rank among the items of their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshwright.llm.bpe import DEFAULT_TOKENIZER, encode_column
from meshwright.planning.lineage import materialise
from meshwright.planning.ranking import buckets_for, spread_rank

CAPACITY = 2048


def fullest(room: int, sizes: list[int], counts: list[int]) -> dict[int, int]:
    """How often to take each size so that the sum is as near to ``room`` as can be, not above.

    Sizes in falling order; ``reach`` has bit t set if the sum t is reachable. Counts are split
    into powers of two. Stops at the first perfect fill.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size, count in zip(sizes, counts):
        if size > room:
            continue
        left, k = min(count, room // size), 1
        while left > 0:
            k = min(k, left)
            wider = (reach | (reach << (size * k))) & full
            if wider != reach:
                steps.append((size, k, reach))
                reach = wider
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for size, k, before in reversed(steps):
        if not before >> at & 1:  # this step was needed to reach the sum
            at -= size * k
            taken[size] = taken.get(size, 0) + k
    return taken


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(sizes taken, times)`` in order; every item of the histogram is in exactly one container."""
    left = {s: n for s, n in histogram.items() if n > 0}
    plan = []
    while left:
        sizes = sorted(left, reverse=True)
        first = sizes[0]
        counts = [left[s] - (s == first) for s in sizes]
        taken = fullest(capacity - first, sizes, counts)
        taken[first] = taken.get(first, 0) + 1
        times = min(left[s] // k for s, k in taken.items())
        plan.append((taken, times))
        for s, k in taken.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return plan


def _intervals(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per size and run of ranks: where it starts (size and rank in one key), items a container, first container."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for taken, times in plan:
        for s, k in taken.items():
            rows.append((s << 44 | used.get(s, 0), k, container))
            used[s] = used.get(s, 0) + k * times
        container += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 3)
    return columns[:, 0], columns[:, 1], columns[:, 2]


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece, piece_size, container_id)`` of every distinct item.

    An item within the capacity is one piece 0. A larger one fills containers of its own and
    leaves a last piece that is packed like an item. Items of size 0 or null take no room and
    lie in container 0. Repeated rows count once; an empty table gives an empty result; other
    columns are ignored. Container ids run from 0 without gaps.
    """
    whole = items.select(F.col(key), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n")).distinct()
    parts = F.when(F.col("n") == 0, F.lit(1)).otherwise(F.ceil(F.col("n") / capacity))
    pieces = whole.select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("piece"))
    pieces = pieces.select(key, "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("piece_size"))
    counts = {r["piece_size"]: r["count"] for r in pieces.groupBy("piece_size").count().collect()}
    buckets = buckets_for(sum(counts.values()))
    counts.pop(0, None)
    starts, each, first = _intervals(plan_containers(counts, capacity))
    table = items.sparkSession.sparkContext.broadcast((starts, each, first))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, per, base = table.value
        for batch in batches:
            sizes, ranks = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            out = np.zeros(len(sizes), np.int64)
            real = sizes > 0
            if real.any():
                at = np.searchsorted(begin, sizes[real] << 44 | ranks[real], side="right") - 1
                out[real] = base[at] + (ranks[real] - (begin[at] & ((1 << 44) - 1))) // per[at]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(out)]
            yield pa.RecordBatch.from_arrays(columns, ["k", "piece", "piece_size", "container_id"])

    ranked = spread_rank(pieces.withColumn("unit", F.struct(key, "piece")), ["piece_size"], "unit", buckets=buckets)
    kind = items.schema[key].dataType.simpleString()
    return (
        ranked.select(F.col(key).alias("k"), "piece", "piece_size", "rank0")
        .mapInArrow(place, f"k {kind}, piece long, piece_size long, container_id long")
        .withColumnRenamed("k", key)
    )


def pack_texts(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Containers of texts measured in tokens; see ``pack``. Each text is encoded once."""
    sizes = materialise(encode_column(docs, key, text, tokenizer, counts_only=True), "packing-sizes")
    return pack(sizes, key, "n_tokens", capacity)
