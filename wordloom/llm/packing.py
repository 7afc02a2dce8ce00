"""Put items of varying size into containers of fixed capacity.

Sizes are whole numbers up to the capacity, so the items of a capacity are fully
described by a histogram of at most ``capacity`` rows, however many items there are.
The driver solves the packing on that histogram, treating all items of one size
alike; the result is a list of bin patterns with multiplicities.  Executors then rank
the items within each size and look up which bin the n-th item of the size goes to.

Packing (large-item matching): sizes above a third of the capacity, at most two a
bin, are matched greedily, the largest with the largest that fits beside it; the
others, from the largest down, go where they leave the least room, or open a bin.

An item larger than the capacity, and only such, is cut: into full pieces, each a
bin of its own, and a rest.  Items of size 0 or null take no room and are left out;
repeated rows are items of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def pack_histogram(capacity: int, histogram: dict[int, int]) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Bins as (multiplicity, ((size, items of that size), ...)) for {size: items}."""
    left = {s: n for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    # bins that are open: gap -> [(bins, content)]
    gaps: dict[int, list[tuple[int, tuple]]] = {}
    order: list[int] = []

    def put(gap: int, bins: int, content: tuple) -> None:
        if bins:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((bins, content))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        n = left[a]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else None
        if b is None:
            put(capacity - a, n, ((a, 1),))
            used = {a: n}
        elif a == b:
            put(capacity - 2 * a, n // 2, ((a, 2),))
            used = {a: n}
            if n % 2 and len(large) > 1:
                # the odd one goes with the next smaller size, which fits as two of this size do
                put(capacity - a - large[-2], 1, ((a, 1), (large[-2], 1)))
                used[large[-2]] = 1
            else:
                put(capacity - a, n % 2, ((a, 1),))
        else:
            m = min(n, left[b])
            put(capacity - a - b, m, ((a, 1), (b, 1)))
            used = {a: m, b: m}
        for s, k in used.items():
            left[s] -= k
            if not left[s]:
                large.remove(s)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(order, s)
            if at == len(order):
                each = capacity // s
                put(capacity - each * s, n // each, ((s, each),))
                if n % each:
                    put(capacity - n % each * s, 1, ((s, n % each),))
                break
            gap = order[at]
            bins, content = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            # the best place for the next item of this size is the bin just used, as long as it fits
            each = gap // s
            full = min(bins, n // each)
            put(gap - each * s, full, (*content, (s, each)))
            n -= full * each
            rest = bins - full
            if rest and n:
                some = min(n, each)
                put(gap - some * s, 1, (*content, (s, some)))
                n -= some
                rest -= 1
            put(gap, rest, content)
    return [(bins, content) for gap in order for bins, content in gaps[gap]]


class _Slots:
    """Which bin the n-th item of a size goes to, for all containers."""

    def __init__(self, packings: list[tuple[int, list]]):
        key, start, each, base, fill, bins_in = [], [], [], [], [], []
        for which, (_, patterns) in enumerate(packings):
            first, used = 0, {}
            for bins, content in patterns:
                total = sum(s * k for s, k in content)
                for s, k in content:
                    key.append((which << 48) | s)
                    start.append(used.get(s, 0))
                    each.append(k)
                    base.append(first)
                    fill.append(total)
                    bins_in.append(bins)
                    used[s] = used.get(s, 0) + bins * k
                first += bins
        self.key, self.start = np.array(key, np.int64), np.array(start, np.int64)
        order = np.lexsort((self.start, self.key))
        self.key, self.start = self.key[order], self.start[order]
        self.each, self.base, self.fill = (np.array(x, np.int64)[order] for x in (each, base, fill))

    def find(self, which: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin number and fill of that bin."""
        key = (which << np.int64(48)) | size
        lo = np.searchsorted(self.key, key)
        n = np.searchsorted(self.key, key, side="right") - lo
        # binary search in the slots of each size
        at = lo.copy()
        step = 1 << max(0, int(n.max()).bit_length()) if len(n) else 0
        while step:
            probe = at + step
            ok = probe < lo + n
            ok[ok] = self.start[probe[ok]] <= rank[ok]
            at[ok] = probe[ok]
            step >>= 1
        return self.base[at] + (rank - self.start[at]) // self.each[at], self.fill[at]


def fill_containers(items: DataFrame, containers: DataFrame, *, id_col: str = "doc_id", size_col: str = "tokens", per_task: int = 200_000) -> DataFrame:
    """One row per container kind and piece: (container_kind, capacity_tokens, bin_id,
    id, piece_no from 0, pieces, piece_tokens, bin_tokens).  ``bin_id`` counts from 0 in
    each kind; ``bin_tokens`` is how full the bin is.

    ``containers`` (container_kind, capacity_tokens) is a small table of settings.  To
    the driver comes one row per capacity and size, at most the sum of the capacities.
    Ranks are counted per size and hash class; a size has a class for every ``per_task``
    of its items, so none, however frequent, is sorted in one task.  A container kind
    without a positive capacity is left out.
    """
    if id_col in ("container_kind", "capacity_tokens", "bin_id", "piece_no", "pieces", "piece_tokens", "bin_tokens"):
        raise ValueError(f"{id_col} is the name of an output column")
    kinds = [(r[0], int(r[1])) for r in containers.select("container_kind", "capacity_tokens").where("capacity_tokens > 0").orderBy("capacity_tokens", "container_kind").collect()]
    item_type = items.schema[id_col].dataType.simpleString()
    out = f"container_kind string, capacity_tokens int, bin_id bigint, `{id_col}` {item_type}, piece_no bigint, pieces bigint, piece_tokens bigint, bin_tokens bigint"
    spark = items.sparkSession
    if not kinds:
        return spark.createDataFrame([], out)
    sized = checkpointed(items.select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("size")).where("size > 0"))
    which = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("which"), F.lit(c).cast("bigint").alias("capacity")) for i, (_, c) in enumerate(kinds)]))
    cut = (
        sized.select("id", "size", which.alias("c")).select("id", "size", "c.*")
        .withColumn("pieces", F.ceil(F.col("size") / F.col("capacity")).cast("bigint"))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
        .withColumn("piece", F.least(F.col("capacity"), F.col("size") - F.col("piece_no") * F.col("capacity")))
    )
    counts = [{} for _ in kinds]
    # the pieces of a size are counted without being made: the full ones, and one rest
    full, rest = F.floor(F.col("size") / F.col("capacity")), F.col("size") % F.col("capacity")
    parts = F.array(F.struct(F.col("capacity").alias("piece"), full.cast("bigint").alias("n")), F.struct(rest.alias("piece"), (rest > 0).cast("bigint").alias("n")))
    tally = sized.groupBy("size").agg(F.count("*").alias("items")).select("size", "items", which.alias("c")).select("size", "items", "c.*")
    tally = tally.select("which", "items", F.explode(parts).alias("p")).where("p.n > 0").groupBy("which", "p.piece").agg(F.sum(F.col("p.n") * F.col("items")).alias("n"))
    for r in tally.collect():
        counts[r["which"]][r["piece"]] = r["n"]
    slots = _Slots([(c, pack_histogram(c, counts[i])) for i, (_, c) in enumerate(kinds)])
    # one row per capacity and frequent size
    frequent = [(i, s, -(-n // per_task)) for i, own in enumerate(counts) for s, n in own.items() if n > per_task]
    if frequent:
        classes = spark.createDataFrame(frequent, "which bigint, piece bigint, classes bigint")
        cut = cut.join(classes, ["which", "piece"], "left").withColumn("salt", F.pmod(F.xxhash64("id", "piece_no"), F.coalesce("classes", F.lit(1))).cast("int"))
    else:
        cut = cut.withColumn("salt", F.lit(0))
    cut = cut.select("which", "piece", "salt", "id", "piece_no", "pieces")
    ranked = cut.withColumn("nth", F.row_number().over(Window.partitionBy("which", "piece", "salt").orderBy("id", "piece_no")))
    if frequent:
        before = Window.partitionBy("which", "piece").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        sums = cut.join(classes.select("which", "piece"), ["which", "piece"], "left_semi").groupBy("which", "piece", "salt").agg(F.count("*").alias("n"))
        offsets = sums.select("which", "piece", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        ranked = ranked.join(offsets, ["which", "piece", "salt"], "left").withColumn("nth", F.col("nth") + F.coalesce("offset", F.lit(0)))
    ranked = ranked.select("which", "piece", (F.col("nth") - 1).alias("rank"), "id", "piece_no", "pieces")
    names = [k for k, _ in kinds]
    capacities = np.array([c for _, c in kinds], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, size, rank = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(3))
            bins, fill = slots.find(w, size, rank)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in w.tolist()], pa.string()), pa.array(capacities[w]), pa.array(bins), batch.column(3), batch.column(4), batch.column(5), batch.column(1), pa.array(fill)],
                names=["container_kind", "capacity_tokens", "bin_id", id_col, "piece_no", "pieces", "piece_tokens", "bin_tokens"],
            )

    return ranked.mapInArrow(run, out)
