"""Resharding by minimum-cost flow.

Old shards have sizes, new shards have capacities.  A minimum-cost flow over
these few numbers says how many bytes each old shard sends to each new one, so
that as few bytes as possible move.  Every old shard is then one sequence of
rows, cut into blocks, one for each of its flows; a row's place in the sequence
tells its block and so its new shard.

The places come from keys and sizes alone.  Where texts are moved, the keys at
which blocks begin, a handful per shard, tell the shard of a row as it is read,
so texts cross one shuffle, which deals them out in the order of the shards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartfold.plans.running import running_total
from chartfold.sources.scratch import stored


#: bytes that one task writes, about
TASK_BYTES = 32 << 20


def stay_free(old: int, new: int) -> int:
    """A byte costs 1 to move and nothing to leave in the shard of its number."""
    return int(old != new)


def min_cost_flow(
    sizes: Sequence[int], capacities: Sequence[int], cost: Callable[[int, int], int] = stay_free
) -> list[tuple[int, int, int]]:
    """Cheapest (old, new, bytes) that empty all ``sizes`` into ``capacities``.

    Successive shortest paths with potentials.  The graph has a node per shard,
    so it is small whatever the data; capacities must add up to the sizes.
    """
    n, m = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError("the new shards are too small for the old ones")
    supply, room = list(sizes), list(capacities)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    flow = [[0] * m for _ in range(n)]
    high = [0] * (n + m)  # potentials: old shards first, then new ones
    infinite = float("inf")
    while any(supply):
        dist = [0 if i < n and supply[i] else infinite for i in range(n + m)]
        back, done = [-1] * (n + m), [False] * (n + m)
        end = -1
        while True:
            u = min((d, k) for k, d in enumerate(dist) if not done[k])[1]
            done[u] = True
            if u >= n and room[u - n]:
                end = u
                break
            if u < n:
                steps = ((n + j, price[u][j]) for j in range(m))
            else:
                steps = ((i, -price[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in steps:
                d = dist[u] + c + high[u] - high[v]
                if d < dist[v]:
                    dist[v], back[v] = d, u
        for k in range(n + m):
            if dist[k] < infinite:
                high[k] += min(dist[k], dist[end])
            else:
                high[k] += dist[end]
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        amount = min([supply[path[0]], room[end - n]] + [flow[v][u - n] for u, v in zip(path, path[1:]) if u >= n])
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        supply[path[0]] -= amount
        room[end - n] -= amount
    return [(i, j, flow[i][j]) for i in range(n) for j in range(m) if flow[i][j]]


def even(total: int, n: int) -> list[int]:
    """``total`` in ``n`` parts that differ by one at most."""
    return [total // n + (i < total % n) for i in range(n)]


@dataclass(frozen=True)
class Plan:
    """Where all rows go.  ``placed`` is the result of :func:`reshard`.

    ``cuts`` has, for each old shard, its blocks in order: the key of the first
    row, and the new shard.  ``touched`` are the new shards that gain or lose rows.
    """

    placed: DataFrame
    old: str
    size: str
    order: Sequence[str]
    old_shards: int
    big: int
    total: int
    cuts: dict[int, list[tuple[tuple, int]]]
    touched: list[int]

    @property
    def key(self) -> list[Column]:
        """A row's old shard, and the key that it goes by there."""
        return [_home(self.old, self.old_shards), _first(self.size, self.big), *[F.col(c) for c in self.order]]

    def shard(self, kinds: Sequence[str]) -> Column:
        """The new shard of a row, by comparison with the keys at the cuts; ``kinds`` are the types of the key."""
        home, *rest = self.key
        key, out = F.struct(*rest), F.lit(None).cast("int")
        for i, blocks in self.cuts.items():
            block = F.lit(blocks[0][1])
            for cut, j in blocks[1:]:
                from_here = key >= F.struct(*[F.lit(v).cast(t) for v, t in zip(cut, kinds, strict=True)])
                block = F.when(from_here, F.lit(j)).otherwise(block)
            out = F.when(home == i, block).otherwise(out)
        return out


def _home(old: str, old_shards: int) -> Column:
    """The old shard; ``old_shards`` stands for rows that are in none."""
    at = F.col(old).cast("int")
    return F.when(at.between(0, old_shards - 1), at).otherwise(F.lit(old_shards))


def _first(size: str, big: int) -> Column:
    """Large rows come first, the largest ahead."""
    n = _bytes(size)
    return F.when(n > big, -n).otherwise(F.lit(0).cast("bigint"))


def _bytes(size: str) -> Column:
    return F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint")


def plan(
    rows: DataFrame,
    old: str,
    size: str,
    order: Sequence[str],
    old_shards: int,
    new_shards: int,
    capacities: Sequence[int] | None = None,
    cost: Callable[[int, int], int] = stay_free,
    grain: float = 0.001,
) -> Plan:
    """Where :func:`reshard` puts the rows, and what it takes to move them with :func:`rewrite`."""
    if old in ("shard", "slot"):
        raise ValueError(f"{old!r} is a column of the result")
    rows = rows.drop("shard", "slot")
    base = stored(rows.withColumns({"__row": F.monotonically_increasing_id(), "__home": _home(old, old_shards)}), "reshard")
    sizes = [0] * (old_shards + 1)
    for r in base.groupBy("__home").agg(F.sum(_bytes(size))).collect():  # a row per old shard
        sizes[r[0]] = r[1]
    total = sum(sizes)
    room = list(capacities) if capacities is not None else even(total, new_shards)
    # what is in no old shard has to move, wherever it goes
    flows = min_cost_flow(sizes, room, lambda i, j: cost(i, j) if i < old_shards else 1)

    big = max(1, int(grain * min([c for c in room if c] or [1])))
    placed = running_total(
        base.withColumns({"__first": _first(size, big), "__one": F.lit(1), "__bytes": _bytes(size)}),
        [(c, True) for c in ("__first", *order, "__row")], ["__bytes", "__one"], "__home", out=["__upto", "__place"],
    )
    # the blocks of an old shard: what stays, then what goes, by number
    blocks: dict[int, list[tuple[int, int]]] = {i: [(0, i % new_shards)] for i in range(old_shards + 1) if not sizes[i]}
    for i, j, n in sorted(flows, key=lambda f: (f[0], f[0] != f[1], f[1])):
        mine = blocks.setdefault(i, [])
        mine.append(((mine[-1][0] if mine else 0) + n, j))
    middle, shard = 2 * F.col("__upto") - F.col("__bytes"), F.lit(0)
    for i, mine in blocks.items():
        block = F.lit(mine[-1][1])
        for upto, j in reversed(mine[:-1]):
            block = F.when(middle < 2 * upto, F.lit(j)).otherwise(block)
        shard = F.when(F.col("__home") == i, block).otherwise(shard)

    moved = stored(placed.withColumn("shard", shard.cast("int")), "resharded")
    pieces = stored(moved.groupBy(F.col("__home").alias("__h"), F.col("shard").alias("__shard")).agg(
        F.min("__place").alias("__from"), F.count(F.lit(1)).alias("__n"),
        F.min(F.struct(F.col("__first"), *[F.col(c) for c in order])).alias("__key"),
    ), "blocks")  # at most a row per old and new shard
    cuts: dict[int, list[tuple[tuple, int]]] = {}
    touched = set()
    for r in pieces.orderBy("__h", "__from").collect():
        cuts.setdefault(r["__h"], []).append((tuple(r["__key"]), r["__shard"]))
        if r["__h"] == old_shards:
            touched.add(r["__shard"])
        elif r["__h"] != r["__shard"]:
            touched |= {r["__shard"]} | ({r["__h"]} if r["__h"] < new_shards else set())
    earlier = W.partitionBy("__shard").orderBy("__h").rowsBetween(W.unboundedPreceding, -1)
    before = pieces.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__key")
    slots = moved.join(before, (F.col("__home") == F.col("__h")) & (F.col("shard") == F.col("__shard"))).select(
        *rows.columns, "shard", (F.col("__before") + F.col("__place") - F.col("__from")).cast("bigint").alias("slot")
    )
    return Plan(slots, old, size, list(order), old_shards, big, total, cuts, sorted(touched))


def reshard(rows: DataFrame, old: str, size: str, order: Sequence[str], old_shards: int, new_shards: int, **options) -> DataFrame:
    """``rows`` with ``shard`` (int, from 0) and ``slot`` (place in the shard, gapless from 0).

    ``old`` numbers the shard that a row is in, from 0; rows with another number
    or none are in no shard yet and are put where there is room.  A null or
    negative ``size`` counts as 0.  ``capacities`` are equal unless given.  Rows
    of an old shard go by the columns ``order``, hashes at best; rows larger than
    ``grain`` times a capacity come first, the largest ahead, so that blocks are
    cut between small rows and shards come out near their capacity.  A row that a
    cut falls into goes to the side that has its middle.  Repeated rows are placed
    one by one, an empty table gives an empty one, and columns of ``rows`` named
    like those of the result give way to them.  ``options`` are those of :func:`plan`.
    """
    return plan(rows, old, size, order, old_shards, new_shards, **options).placed


def rewrite(docs: DataFrame, moves: Plan, path: str) -> None:
    """Writes the affected shards of ``docs`` below ``path``, one folder each, in the order of their slots.

    ``docs`` has the columns that the plan was made from, with the same values,
    and ``order`` must tell all rows apart, or equal ones stay together; nulls
    are values like others.  Shards that keep all their rows are not touched.
    Columns of ``docs`` named ``shard`` and ``slot`` give way to the new ones.
    A shard is written by as many tasks as its bytes take.
    """
    docs = docs.drop("shard", "slot")
    kinds = [f.dataType.simpleString() for f in docs.select(*[c.alias(f"k{i}") for i, c in enumerate(moves.key[1:])]).schema]
    rows = docs.withColumn("shard", moves.shard(kinds)).filter(F.col("shard").isin(moves.touched))
    order = [F.col("shard"), *moves.key]
    dealt = rows.repartitionByRange(max(1, -(-moves.total // TASK_BYTES)), *order).sortWithinPartitions(*order)
    # tasks have contiguous ranges of this order, so a row's place is that in its task and the rows of the tasks before
    dealt.withColumn("slot", F.monotonically_increasing_id()).write.partitionBy("shard").parquet(path)


def written(spark: SparkSession, path: str, schema: str, *columns: Column) -> DataFrame:
    """``columns`` of the rows below ``path`` that :func:`rewrite` has written, with ``shard`` and ``slot``.

    ``schema`` names what is read beside them.  Only what ``columns`` keep is
    joined with the tasks' counts, which are a row per task and shard.
    """
    rows = spark.read.schema(f"{schema}, slot bigint, shard int").parquet(path)
    task = F.shiftright("slot", 33)  # the upper bits of the number count tasks
    pieces = rows.groupBy(F.col("shard").alias("__shard"), task.alias("__task")).agg(
        F.min("slot").alias("__from"), F.count(F.lit(1)).alias("__n")
    )
    earlier = W.partitionBy("__shard").orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    found = rows.select(*columns, "shard", F.col("slot").alias("__at"), task.alias("__of"))
    met = found.join(pieces, (F.col("shard") == F.col("__shard")) & (F.col("__of") == F.col("__task")))
    slot = (F.col("__before") + F.col("__at") - F.col("__from")).cast("bigint").alias("slot")
    return met.select(*found.columns[: len(columns)], "shard", slot)
