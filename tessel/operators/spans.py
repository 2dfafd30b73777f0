"""Ordered keys of any type cut into spans of about equal size, by bounds from a sample.

What needs the order of all keys (neighbours, disjoint ranges, ranks) is done in each span
by itself, and between spans on one row for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys in a span (fewer keys are one span and one task), spans at most, sampled keys for each span.
SPAN, MOST, DRAWN = 100_000, 1024, 20


def bounds(df: DataFrame, key: str, span: int = SPAN) -> list:
    """At most MOST - 1 keys that part df's keys evenly; none for few keys."""
    keys = df.select(key).where(F.col(key).isNotNull())
    n = keys.count()
    parts = min(MOST, n // span)
    if parts < 2:
        return []
    share = int((1 << 30) * min(1.0, DRAWN * parts / n))
    drawn = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share).distinct().collect())
    return sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []


def span_of(column: Column, cuts: list, kind) -> Column:
    """How many bounds are at or before a value; 0 for null.  Two steps of at most 32 comparisons."""
    if not cuts:
        return F.lit(0)
    every = F.array(*(F.lit(c).cast(kind) for c in cuts))
    count = lambda some: F.size(F.filter(some, lambda c: c <= column))
    coarse = cuts[31::32]
    if not coarse:
        return count(every)
    block = count(F.array(*(F.lit(c).cast(kind) for c in coarse)))
    return block * 32 + count(F.slice(every, block * 32 + 1, F.lit(32)))


def following(df: DataFrame, key: str, *carried: str, span: int = SPAN) -> DataFrame:
    """df (distinct keys) with next_KEY and next_CARRIED: those of the row with the next key."""
    kind = df.schema[key].dataType
    cuts = bounds(df, key, span)
    row = F.struct(key, *carried)
    placed = df.withColumn("_span", span_of(F.col(key), cuts, kind))
    ahead = placed.withColumn("_next", F.lead(row).over(Window.partitionBy("_span").orderBy(key)))
    if cuts:
        first = {r["_span"]: r["_first"] for r in placed.groupBy("_span").agg(F.min(row).alias("_first")).collect()}
        after, last = {}, None
        for k in range(len(cuts), -1, -1):
            after[k] = last
            last = first.get(k, last)
        shape = ahead.schema["_next"].dataType
        edges = df.sparkSession.createDataFrame(list(after.items()), "_span int, _edge " + shape.simpleString())
        # one row for each span, MOST at most
        ahead = ahead.join(F.broadcast(edges), "_span").withColumn("_next", F.coalesce("_next", "_edge"))
    return ahead.select(*df.columns, *(F.col("_next")[c].alias(f"next_{c}") for c in (key, *carried)))


def percentiles(df: DataFrame, column: str, shares: list[float], few: int = 50_000) -> list[float | None]:
    """Exact percentiles with linear interpolation, in a few counting passes.

    Each pass cuts the values between two bounds into spans and counts them; a percentile's
    span is cut further until it holds few distinct values.  No task holds more than those.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    kind = counts.schema["v"].dataType

    def at(rank: int) -> float:
        part, before = counts, 0
        while True:
            cuts = bounds(part, "v", few)
            if not cuts:
                break
            sizes = dict(part.groupBy(span_of(F.col("v"), cuts, kind).alias("s")).agg(F.sum("n").alias("n")).collect())
            for s in range(len(cuts) + 1):
                if rank < before + sizes.get(s, 0):
                    break
                before += sizes.get(s, 0)
            low, high = cuts[s - 1] if s else None, cuts[s] if s < len(cuts) else None
            part = part.where((F.col("v") >= F.lit(low) if s else F.lit(True)) & (F.col("v") < F.lit(high) if s < len(cuts) else F.lit(True)))
        for v, n in sorted(part.collect()):
            if rank < before + n:
                return v
            before += n
        raise ValueError("no such rank")

    out = []
    for share in shares:
        if not total:
            out.append(None)
            continue
        place = share * (total - 1)
        low = at(int(place))
        rest = place - int(place)
        high = at(int(place) + 1) if rest else low
        out.append(float(low) + (float(high) - float(low)) * rest)
    return out
