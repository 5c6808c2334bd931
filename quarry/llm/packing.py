"""Filling fixed-capacity containers: dominance reduction on the histogram of sizes, then best fit."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.ranks import spread_rank

#: (how many containers, the sizes in each with how often each size stands in it)
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def dominant(left: dict[int, int], sizes: list[int], j: int, capacity: int) -> tuple[int, ...] | None:
    """A set of the remaining items beside one of size j that dominates every other set beside it, or None.

    Martello and Toth's cases: nothing fits (the item stands alone); the largest fitting item fills the rest
    exactly; no two remaining items fit together, so the largest fitting one dominates; no three fit and
    the largest one is at least as large as the best fitting pair; else, where no three fit, a pair that fills
    the rest exactly. `sizes` are the sizes that remain, ascending; `left` counts them, j's own place taken.
    """
    room = capacity - j
    i = bisect_right(sizes, room)
    while i and left[sizes[i - 1]] == 0:
        i -= 1
    if not i:
        return ()
    k = sizes[i - 1]
    if k == room:
        return (k,)
    smallest = []
    for s in sizes:
        smallest += [s] * min(left[s], 3)
        if len(smallest) >= 3:
            break
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (k,)
    if len(smallest) > 2 and sum(smallest[:3]) <= room:
        return None
    best, pair, a, b = -1, (), 0, i - 1
    while a <= b:
        x, y = sizes[a], sizes[b]
        if not left[x] or (a == b and left[x] < 2):
            a += 1
        elif not left[y]:
            b -= 1
        elif x + y > room:
            b -= 1
        else:
            if x + y > best:
                best, pair = x + y, (x, y)
            a += 1
    if k >= best:
        return (k,)
    return pair if best == room else None


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Containers for items given as size -> count (sizes from 1 to capacity), as patterns with multiplicities.

    Sizes are taken from the largest down. Where a set dominates, it is fixed for as many containers as there are
    such sets and the instance shrinks; the rest goes by best fit, a size at a time, largest first. At most two
    patterns arise per size and step, so the plan is bounded by the capacity, whatever the number of items.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    patterns: list[Pattern] = []
    rest: list[int] = []
    for j in reversed(sizes):
        while left[j]:
            left[j] -= 1
            found = dominant(left, sizes, j, capacity)
            left[j] += 1
            if found is None:
                rest.append(j)
                break
            need: dict[int, int] = {j: 1}
            for s in found:
                need[s] = need.get(s, 0) + 1
            times = min(left[s] // m for s, m in need.items())
            for s, m in need.items():
                left[s] -= m * times
            patterns.append((times, tuple(sorted(need.items()))))
    rooms: list[int] = []
    bins: dict[int, list[tuple[int, dict[int, int]]]] = {}

    def put(room: int, times: int, inside: dict[int, int]) -> None:
        if room not in bins:
            insort(rooms, room)
            bins[room] = []
        bins[room].append((times, inside))

    for s in sorted(rest, reverse=True):
        n = left[s]
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                room, times, inside = capacity, -(-n // (capacity // s)), {}
            else:
                room = rooms[i]
                times, inside = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[i]
            each = room // s
            full = min(times, n // each)
            if full:
                put(room - each * s, full, inside | {s: inside.get(s, 0) + each})
                n -= full * each
                times -= full
            if times and 0 < n < each:
                put(room - n * s, 1, inside | {s: inside.get(s, 0) + n})
                n, times = 0, times - 1
            if times and inside:
                put(room, times, inside)
    return patterns + [(times, tuple(sorted(inside.items()))) for r in rooms for times, inside in bins[r]]


def assignments(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(size, from_rank, to_rank, first_container, per_container): which ranks within a size go where, ranks from 1."""
    used: dict[int, int] = {}
    out, container = [], 0
    for times, inside in patterns:
        for s, m in inside:
            at = used.get(s, 0)
            out.append((s, at + 1, at + m * times, container, m))
            used[s] = at + m * times
        container += times
    return out


PLAN = T.StructType([T.StructField("pack_name", T.StringType()), T.StructField("size", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("from_rank", "first_container", "per_container")]])


def pieces(sized: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, doc_id, part, from_token, size): the items of every container size.

    sized has doc_id, tokenizer, n_tokens. A text longer than the capacity gives full parts and a remainder;
    others are one part. Texts without tokens are one item of size 0."""
    cap, n = F.col("capacity_tokens"), F.col("n_tokens").cast("long")
    parts = F.greatest(F.lit(1), F.ceil(n / cap)).cast("long")
    rows = sized.join(F.broadcast(limits), "tokenizer").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return rows.select("pack_name", "capacity_tokens", "doc_id", "part", (F.col("part") * cap).alias("from_token"), F.least(cap.cast("long"), n - F.col("part") * cap).alias("size"))


def pack(spark: SparkSession, sized: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_name, container_id, doc_id, part, from_token, size) for every item of `pieces`.

    Only the histogram of sizes comes to the driver, at most one row per pack and token of capacity. The plan has one row
    per pack and size as well, its stretches of ranks in order, so it is bounded by the capacities, not by the items;
    it is joined by pack and size, and an item finds its stretch by its number within its size. Items of size 0 take no
    room and go to container 0; packs without a capacity of at least 1 are left out; repeated doc_ids are items of their own.
    """
    limits = limits.where(F.col("capacity_tokens") >= 1).select("pack_name", "tokenizer", "capacity_tokens").distinct()
    items = pieces(sized, limits)
    counted: dict[tuple[str, int], dict[int, int]] = {}
    for r in items.where("size > 0").groupBy("pack_name", "capacity_tokens", "size").count().collect():
        counted.setdefault((r[0], r[1]), {})[r[2]] = r[3]
    rows: dict[tuple[str, int], list[list[int]]] = {}
    for (name, capacity), h in counted.items():
        for size, first, _, container, per in assignments(plan(h, capacity)):
            for column, x in zip(rows.setdefault((name, size), [[], [], []]), (first, container, per), strict=True):
                column.append(x)
    where = spark.createDataFrame([(*k, *v) for k, v in rows.items()], PLAN)
    order = items.where("size > 0").withColumn("_order", F.xxhash64("doc_id", "part"))
    ranked = spread_rank(order, ["pack_name", "size"], "_order")
    tied = Window.partitionBy("pack_name", "size", "rank").orderBy("doc_id", "part")
    ranked = ranked.withColumn("rank", F.col("rank") + F.row_number().over(tied) - 1)
    at = F.size(F.filter("from_rank", lambda x: x <= F.col("rank")))
    placed = ranked.join(where, ["pack_name", "size"]).withColumn("_at", at)
    container = F.element_at("first_container", F.col("_at")) + F.floor((F.col("rank") - F.element_at("from_rank", F.col("_at"))) / F.element_at("per_container", F.col("_at")))
    out = placed.select("pack_name", container.cast("long").alias("container_id"), "doc_id", "part", "from_token", "size")
    none = items.where("size = 0").select("pack_name", F.lit(0).cast("long").alias("container_id"), "doc_id", "part", "from_token", "size")
    return out.unionByName(none)
