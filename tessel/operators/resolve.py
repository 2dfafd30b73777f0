"""Several layers, versions or logged operations of a keyed table made into one state.

The newest entry of each key wins, and it may be a tombstone.  Entries that can't win are
dropped before their shuffle, so a key with many entries costs a task little.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans


def stack(layers: list[tuple[int, DataFrame]]) -> DataFrame:
    """Layers of one schema as rows with prio; a higher prio shadows the lower ones."""
    return reduce(DataFrame.unionByName, (df.withColumn("prio", F.lit(prio)) for prio, df in layers))


def newest(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The entry of each key with the largest order columns.

    Spark keeps one entry of each key before the shuffle, and one after it.
    """
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return entries.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")


#: Tombstones that are written into the plan as a constant, ranges in a span of the others,
#: and parts that the entries of a span are dealt to.
PIECES, RANGES, PARTS = 1000, 20_000, 16


def outside(entries: DataFrame, ranges: DataFrame, key: str, order: str = "prio") -> DataFrame:
    """Entries that no range tombstone (lo, hi, order) of a later order covers.

    Up to PIECES ranges are made disjoint by the driver and become a constant of the
    filter, without any join.  More are made disjoint span by span; at most one piece can
    cover a key, the last that begins at or before it, which a window over the span finds.
    """
    few = ranges.limit(PIECES + 1).collect()
    kinds = dict(ranges.dtypes)
    if len(few) <= PIECES:
        found = sweep([(r.lo, r.hi, r[order]) for r in few])
        if not found:
            return entries
        known = F.array(*(F.struct(F.lit(lo).cast(kinds["lo"]).alias("lo"), F.lit(hi).cast(kinds["lo"]).alias("hi"), F.lit(turn).cast(kinds[order]).alias("turn")) for lo, hi, turn in found))
        return entries.where(~F.exists(known, lambda r: F.coalesce((F.col(key) >= r["lo"]) & (F.col(key) < r["hi"]) & (r["turn"] > F.col(order)), F.lit(False))))
    cuts = spans.bounds(ranges, "lo", RANGES)
    disjoint = _disjoint(ranges, order, cuts).select("span", F.col("lo").cast(kinds["lo"]).alias("_at"), F.struct("hi", F.col(order).alias("turn")).alias("_piece"))
    disjoint = disjoint.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    names = entries.columns
    placed = entries.select(spans.span_of(F.col(key), cuts, kinds["lo"]).alias("span"), F.pmod(F.xxhash64(*names[:8]), F.lit(PARTS)).cast("int").alias("part"), F.col(key).cast(kinds["lo"]).alias("_at"), F.struct(*names).alias("_row"))
    mixed = placed.unionByName(disjoint, allowMissingColumns=True)
    upto = Window.partitionBy("span", "part").orderBy(F.col("_at"), F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = mixed.withColumn("_over", F.last("_piece", ignorenulls=True).over(upto)).where("_row is not null")
    covered = (F.col("_at") < F.col("_over.hi")) & (F.col("_over.turn") > F.col(f"_row.{order}"))
    return met.where(~F.coalesce(covered, F.lit(False))).select("_row.*")


def sweep(ranges: list[tuple]) -> list[tuple]:
    """Disjoint pieces (lo, hi, order) of half-open ranges, each with the largest order over it."""
    ranges = sorted((r for r in ranges if r[0] is not None and r[1] is not None and r[0] < r[1]), key=lambda r: r[0])
    edges = sorted({x for r in ranges for x in r[:2]})
    heap: list[tuple] = []
    out: list[list] = []
    i = 0
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        while i < len(ranges) and ranges[i][0] <= lo:
            heapq.heappush(heap, _Later(ranges[i][2], ranges[i][1]))
            i += 1
        while heap and heap[0].hi <= lo:
            heapq.heappop(heap)
        if heap:
            if out and out[-1][1] == lo and out[-1][2] == heap[0].order:
                out[-1][1] = hi
            else:
                out.append([lo, hi, heap[0].order])
    return [tuple(p) for p in out]


class _Later:
    """The later order first."""

    __slots__ = ("order", "hi")

    def __init__(self, order, hi):
        self.order, self.hi = order, hi

    def __lt__(self, other: _Later) -> bool:
        return other.order < self.order


def _disjoint(ranges: DataFrame, order: str, cuts: list) -> DataFrame:
    """span, lo, hi, order: the disjoint pieces of each span.

    A range goes to every span that it touches; of those that cover a span whole the latest
    alone is kept, before any shuffle.  The sweep of a span is one task's.
    """
    kinds = dict(ranges.dtypes)
    lo_kind, order_kind = kinds["lo"], kinds[order]
    valid = ranges.where(F.col("lo") < F.col("hi")).select("lo", "hi", F.col(order).alias("turn"), spans.span_of(F.col("lo"), cuts, lo_kind).alias("i"), spans.span_of(F.col("hi"), cuts, lo_kind).alias("j"))
    each = valid.withColumn("span", F.explode(F.sequence("i", "j")))
    each = each.select("span", F.when(F.col("span") == F.col("i"), F.col("lo")).alias("lo"), F.when(F.col("span") == F.col("j"), F.col("hi")).alias("hi"), "turn")
    whole = F.col("lo").isNull() & F.col("hi").isNull()
    full = each.where(whole).groupBy("span").agg(F.max("turn").alias("turn")).select("span", F.lit(None).cast(lo_kind).alias("lo"), F.lit(None).cast(lo_kind).alias("hi"), "turn")

    def run(table):
        import pyarrow as pa

        span = table["span"][0].as_py()
        low, high = (cuts[span - 1] if span else None), (cuts[span] if span < len(cuts) else None)
        rows = [(low if a is None else a, high if b is None else b, t) for a, b, t in zip(*(table[c].to_pylist() for c in ("lo", "hi", "turn")), strict=True)]
        found = sweep(rows)
        columns = list(zip(*found, strict=True)) if found else [(), (), ()]
        return pa.table({"span": pa.array([span] * len(found), pa.int32()), "lo": pa.array(columns[0], table.schema.field("lo").type), "hi": pa.array(columns[1], table.schema.field("hi").type), order: pa.array(columns[2], table.schema.field("turn").type)})

    both = each.where(~whole).unionByName(full)
    return both.groupBy("span").applyInArrow(run, f"span int, lo {lo_kind}, hi {lo_kind}, {order} {order_kind}")


def flatten(ranges: DataFrame, order: str = "prio") -> DataFrame:
    """Disjoint pieces of half-open ranges, each with the largest order over it."""
    return _disjoint(ranges, order, spans.bounds(ranges, "lo", RANGES)).select("lo", "hi", order)


def merge(layers: list[tuple[int, DataFrame]], key: str, ranges: DataFrame | None = None, tombstone: Column | None = None) -> DataFrame:
    """The live rows of layers of rows with op ('put' or 'del')."""
    entries = stack(layers)
    if ranges is not None:
        entries = outside(entries, ranges, key)
    return newest(entries, key, ["prio"]).where(F.col("op") == "put" if tombstone is None else ~tombstone)


#: Layers that each read mode sees: the base, the frozen buffer, the buffer in use.
READ_MODES = {"trie": 0, "buffered": 1, "fresh": 1, "latest": 2}


def as_of(versions: DataFrame, key: str, version: int) -> DataFrame:
    """The rows visible at a version: the newest entry up to it, unless it is a tombstone."""
    return newest(versions.where(F.col("version") <= version), key, ["version"]).where("not deleted")


def collectable(versions: DataFrame, key: str, snapshots: list[int]) -> DataFrame:
    """Entries that neither a live snapshot nor the newest state needs."""
    w = Window.partitionBy(key).orderBy("version")
    following = F.lead("version").over(w)
    needed = F.exists(F.array(*(F.lit(s) for s in snapshots)), lambda s: (F.col("version") <= s) & (F.col("next") > s)) if snapshots else F.lit(False)
    return versions.withColumn("next", following).where(F.col("next").isNotNull() & ~needed).drop("next")


def replay(log: DataFrame, key: str = "key") -> DataFrame:
    """The state after a log of rows seq, op (put, del, range), key, key_hi, value.

    An entry lives if it is the newest of its key, a put, and no later range covers it.
    """
    points = log.where(F.col("op") != "range").select(key, "op", "value", "seq")
    ranges = log.where(F.col("op") == "range").select(F.col(key).alias("lo"), F.col("key_hi").alias("hi"), "seq")
    won = newest(points, key, ["seq"]).where("op = 'put'")
    return outside(won, ranges, key, "seq").select(key, "value")


def complete(log: DataFrame) -> DataFrame:
    """Entries of transactions whose participants all wrote and of which a commit was seen."""
    own = Window.partitionBy("tx_id")
    seen = log.withColumn("_roots", F.size(F.collect_set("root").over(own))).withColumn("_asked", F.max("participants").over(own)).withColumn("_ended", F.max(F.col("is_commit").cast("int")).over(own))
    return seen.where("_roots = _asked and _ended = 1").select(log.columns)


def coalesce_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping and adjacent half-open ranges (lo, hi) of each `by` made one."""
    before = Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    new = ranges.withColumn("_far", F.max("hi").over(before)).withColumn("_new", F.when(F.col("_far") >= F.col("lo"), 0).otherwise(1))
    return new.withColumn("_island", F.sum("_new").over(upto)).groupBy(*by, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (added, removed, changed), old and new value."""
    both = old.select(key, F.col(value).alias("old"), F.lit(1).alias("_o")).join(new.select(key, F.col(value).alias("new"), F.lit(1).alias("_n")), key, "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change is not null").select(key, "change", "old", "new")
