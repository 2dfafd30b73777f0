"""MinHash near-duplicates, with Odd sketches to verify the banded candidates.

Each text becomes the set of its shingles.  SAMPLES MinHash values give BANDS keys of
ROWS values, and are folded into a parity bitmap (an Odd sketch): each sample flips one
bit, so the bits in which two bitmaps differ count the samples in which the sets differ.
At high similarities that estimate is precise, and a candidate whose estimate is out of
reach of the threshold is dropped; the others are confirmed on full sets.

Texts with equal sets are put together first, by a 128-bit sum over the set.  Then:

1. every class takes the smallest id among the classes that share a band with it, and
   that one pair is checked: large groups become stars, in linear work;
2. only in bands that still hold several components, classes of different components are
   compared by their bitmaps, in blocks of bounded size.  Classes with a partner in reach
   meet again with their texts, in the same blocks, and are confirmed from the nearest
   pair on; a block gives the links of a forest.

Pairs inside one component need no check, so no link between components is lost, and the
pairs of a group are never listed.

Defined results: null and empty texts, and texts without words, have no shingles, are
linked with nothing and stay; rows with a null id are linked with nothing and stay, with
a null component; repeated rows give a row each.  An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .store import Store

SAMPLES, BANDS, ROWS, BITS = 512, 25, 5, 2048
#: A candidate is dropped when its estimate lies more than this below the threshold:
#: above five standard deviations of the estimate at the threshold.
MARGIN = 0.085
#: Partners of one pivot, and classes of one band, that are handled together.
STAR, BLOCK = 16, 128
#: A band of more than PARTS blocks gets larger ones, of MOST classes at most, so that rows
#: are copied to few groups.
PARTS, MOST = 12, 2048
#: A class counts once for each so many shingles when blocks are dealt, so that a block's
#: texts stay bounded in bytes; rows that are signed at once, and bytes of text at once.
HEAVY, SIGNED, BLOCK_BYTES = 2000, 256, 1 << 20

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_PLACE = tx.mix64(np.arange(1, 33, dtype=np.uint64))


def shingle_sets(block: tx.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(the shingle hashes of all rows, distinct and sorted within each row; limits by row).

    A row with fewer words than size has its whole sequence as its one shingle.
    """
    hashes, counts = block.hashes(), np.diff(block.first)
    n = len(hashes) - size + 1
    if n > 0:
        total = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            total += hashes[j : n + j] * (_PLACE[j] | np.uint64(1))
        total = tx.mix64(total)
        rows = block.word_rows()
        inside = rows[:n] == rows[size - 1 :]
        total, owner = total[inside], rows[:n][inside]
    else:
        total, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = []
        for row in short.tolist():
            lo, hi = block.first[row], block.first[row + 1]
            own.append(np.bitwise_xor.reduce(tx.mix64(hashes[lo:hi] + _PLACE[: hi - lo]) * _PLACE[hi - lo + 8]))
        owner = np.concatenate([owner, short])
        total = np.concatenate([total, tx.mix64(np.array(own, dtype=np.uint64))])
        by = np.argsort(owner, kind="stable")
        owner, total = owner[by], total[by]
    limits = np.searchsorted(owner, np.arange(len(counts) + 1))
    for lo, hi in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        total[lo:hi].sort()
    if len(total):
        new = np.ones(len(total), dtype=bool)
        new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
        total, owner = total[new], owner[new]
    return total, np.searchsorted(owner, np.arange(len(counts) + 1))


def sign(sets: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sums (two), band keys and bitmaps of rows whose sets aren't empty."""
    starts = limits[:-1]
    first = np.add.reduceat(tx.mix64(sets), starts)
    second = np.add.reduceat(tx.mix64(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
    least = np.empty((len(starts), SAMPLES), dtype=np.uint64)
    for i in range(SAMPLES):
        least[:, i] = np.minimum.reduceat(sets * _MULTIPLY[i] + _ADD[i], starts)
    values = tx.mix64(least + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = values[:, : BANDS * ROWS].reshape(len(starts), BANDS, ROWS)
    band = np.zeros((len(starts), BANDS), dtype=np.uint64)
    for j in range(ROWS):
        band = tx.mix64(band ^ keys[:, :, j])
    at = np.arange(len(starts))[:, None] * BITS + (values >> np.uint64(40)).astype(np.int64) % BITS
    odd = (np.bincount(at.ravel(), minlength=len(starts) * BITS) & 1).astype(np.uint8).reshape(-1, BITS)
    return first, second, band, np.packbits(odd, axis=1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing bits of two bitmaps."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * differing / BITS, 1e-9))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n (set size), f1 and f2 (sums over the set), bands, sketch; null where the set is empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi, block in tx.blocks(batch.column(1), tx.NOT_SPACE, True, BLOCK_BYTES):
                sets, limits = shingle_sets(block, size)
                counts = np.diff(limits)
                full = np.flatnonzero(counts > 0)
                if len(full):
                    edges = np.append(limits[:-1][full], len(sets))
                    signed = [sign(sets[edges[i] : edges[min(i + SIGNED, len(full))]], edges[i : min(i + SIGNED, len(full)) + 1] - edges[i]) for i in range(0, len(full), SIGNED)]
                    first, second, band, sketch = (np.concatenate(x) for x in zip(*signed, strict=True))
                at = np.full(hi - lo, -1)
                at[full] = np.arange(len(full))
                take = pa.array(at, mask=at < 0)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(counts.astype(np.int64))]
                if len(full):
                    bands = tx.long_list(band.ravel(), np.full(len(full), BANDS))
                    found = [pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), bands, pa.array([r.tobytes() for r in sketch], pa.binary())]
                else:
                    found = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + [c.take(take) for c in found], names=["id", "n", "f1", "f2", "bands", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n long, f1 long, f2 long, bands array<long>, sketch binary")


def _confirm(store: Store, pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as (a, b).

    The partners of a pivot a are dealt to groups of STAR; a group gets the pivot's text
    once and streams its partners' texts past the pivot's set.
    """
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = store.table("texts", texts.join(store.table("wanted", wanted), "id", "left_semi"))
    many = store.table("many", pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts")).where("parts > 1"))
    dealt = store.table("dealt", pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part")))
    pivots = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    others = dealt.join(texts, F.col("b") == F.col("id")).select("a", "part", "b", "text")

    def run(batches):
        now, pivot = None, None
        for batch in batches:
            a, part, b = (batch.column(i).to_pylist() for i in range(3))
            linked = []
            for lo, hi, block in tx.blocks(batch.column(3), tx.NOT_SPACE, True):
                sets, limits = shingle_sets(block, size)
                for i in range(lo, hi):
                    own = sets[limits[i - lo] : limits[i - lo + 1]]
                    if b[i] is None:
                        now, pivot = (a[i], part[i]), own.copy()
                    elif now == (a[i], part[i]):
                        both = len(np.intersect1d(pivot, own, assume_unique=True))
                        if 100 * both >= percent * (len(pivot) + len(own) - both):
                            linked.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in linked], pa.int64()), pa.array([y for _, y in linked], pa.int64())], names=["a", "b"])

    return pivots.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _reach(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (x, y) of one group with their estimates, nearest first.

    Rows of different components whose bitmaps are near, in the first band they share.
    """
    ids, comp, block = (np.asarray(table[c].combine_chunks()) for c in ("id", "component", "own"))
    bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
    bands = np.asarray(table["bands"].combine_chunks().flatten()).reshape(len(ids), BANDS)
    i, j, k = (table[c][0].as_py() for c in ("i", "j", "k"))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    xs, ys, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for x in left.tolist():
        other = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) | (i != j))]
        got = estimate(np.bitwise_count(bits[other] ^ bits[x]).sum(axis=1).astype(float))
        ok = got >= percent / 100 - MARGIN
        other, got = other[ok], got[ok]
        first = ~(bands[other, :k] == bands[x, :k]).any(axis=1)
        xs.append(np.full(first.sum(), x)), ys.append(other[first]), near.append(got[first])
    x, y, got = np.concatenate(xs), np.concatenate(ys), np.concatenate(near)
    by = np.argsort(-got, kind="stable")
    return x[by], y[by], got[by]


def _rest(known: DataFrame, own: DataFrame, texts: DataFrame, store: Store, size: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of one band but different components.

    known: band, k, id, component, weight.  In each band that holds several components, the
    classes outside its largest one are dealt to blocks, and so is the largest;
    each block of the former meets each other block in a group of its own.  Classes of
    the largest component don't meet each other.
    """
    sizes = known.groupBy("band", "component").agg(F.sum("weight").alias("n"))
    bands = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("big"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    block = F.least(F.greatest(F.ceil(F.col("n") / PARTS), F.lit(BLOCK)), F.lit(MOST))
    bands = bands.select("band", F.col("big.component").alias("big"), F.ceil((F.col("n") - F.col("big.n")) / block).cast("int").alias("s"), F.ceil(F.col("big.n") / block).cast("int").alias("g"))
    rows = store.table("open", known.join(store.table("bands_open", bands), "band"))
    is_big = F.col("component") == F.col("big")
    rows = rows.join(own.drop("weight"), "id").withColumn("own", F.when(is_big, F.col("s") + F.pmod(F.xxhash64("id"), "g")).otherwise(F.pmod(F.xxhash64("id"), "s")).cast("int"))
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_big, F.col("s")).otherwise(F.col("s") + F.col("g")) - 1)))
    dealt = each.select("band", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "sketch", "bands")

    def narrow(table: pa.Table) -> pa.Table:
        x, y, _ = _reach(table, percent)
        return table.take(pa.array(np.unique(np.concatenate([x, y]))))

    def confirm(table: pa.Table) -> pa.Table:
        x, y, _ = _reach(table, percent)
        sets = []
        for _, _, block in tx.blocks(table["text"].combine_chunks(), tx.NOT_SPACE, True):
            found, limits = shingle_sets(block, size)
            sets += [found[lo:hi] for lo, hi in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]
        ids = table["id"].to_pylist()
        parent = {c: c for c in table["component"].to_pylist()}
        comp = table["component"].to_pylist()

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        a, b = [], []
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            if top(comp[p]) == top(comp[q]):
                continue
            both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                parent[top(comp[p])] = top(comp[q])
                a.append(ids[p]), b.append(ids[q])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    near = store.table("near", dealt.groupBy("band", "k", "i", "j").applyInArrow(narrow, dealt.schema))
    wanted = store.table("wanted", near.select("id").distinct())
    texts = store.table("texts", texts.join(wanted, "id", "left_semi"))
    return near.join(texts, "id").groupBy("band", "k", "i", "j").applyInArrow(confirm, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id.

    size: words of a shingle.  percent: texts are linked when 100 * common shingles >=
    percent * all shingles of both.  component_id is the smallest id that links reach.
    """
    spark = docs.sparkSession
    store = Store(spark, "minhash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = rows.where(F.col("id").isNotNull())
    signed = store.table("signed", signatures(rows, "id", "text", size))
    held = signed.where(F.col("id").isNotNull() & F.col("f1").isNotNull())
    classed = store.table("classes", held.groupBy("f1", "f2").agg(F.min("id").alias("id")))
    own = held.select("id", "f1", "f2", "bands", "sketch", F.ceil(F.col("n") / HEAVY).alias("weight")).join(classed, ["id", "f1", "f2"], "left_semi")
    own = store.table("own", own.select("id", "bands", "sketch", "weight"))
    banded = own.select("id", "weight", F.posexplode("bands").alias("k", "v")).select("id", "weight", "k", F.xxhash64("k", "v").alias("band"))
    full = store.table("full", banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")).where("n > 1"))
    members = store.table("members", banded.join(full, "band").select("band", "k", "id", "a", "weight"))
    tried = store.table("tried", members.where("a < id").groupBy("id").agg(F.min("a").alias("a")).select("a", F.col("id").alias("b")))
    links = store.table("links", _confirm(store, tried, texts, size, percent))
    found = store.table("found", components(spark, links, store))
    known = store.table("known", members.join(found, "id", "left").select("band", "k", "id", F.coalesce("component", "id").alias("component"), "weight"))
    more = store.table("links", _rest(known, own, texts, store, size, percent))
    if not more.isEmpty():
        found = store.table("found", components(spark, links.unionByName(more), store))
    whole = classed.join(found, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("c"))
    whole = store.table("whole", whole)
    out = signed.select("id", "n", "f1", "f2").join(whole, ["f1", "f2"], "left")
    out = store.table("out", out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id")))
    store.drop_but("out")
    return out


def kept(id_col: str = "doc_id") -> F.Column:
    """True for the one row of each component that stays, and for rows without a component."""
    return F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))


def report(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    return classes(docs, size=size, percent=percent).withColumn("kept", kept())


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one of each component, and all rows without words.

    Rows get numbers of their own, so that rows with repeated or null ids are told apart.
    The row with the smallest id stays, a null id before all others.
    """
    store = Store(docs.sparkSession, "deduplicate")
    # written, since other scans could number the rows in another way
    numbered = store.table("numbered", docs.withColumn("_row", F.monotonically_increasing_id()))
    found = classes(numbered, id_col="_row", size=size, percent=percent)
    ids = found.join(numbered.select("_row", "doc_id"), "_row")
    stays = store.table("stays", ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_row")).select("_row"))
    # both sides are dealt by the row's number at every size: what is kept grows with docs
    return numbered.join(stays.hint("shuffle_hash"), "_row", "left_semi").select(docs.columns)
