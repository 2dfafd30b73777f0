"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits its rows by a random direction at each node, at the median of a bounded
sample, until a node of the sample is small enough.  Rows close to a split go to both
sides (spill), so that near vectors meet in a leaf of some tree.  Directions come from a
hash of tree and node; only the thresholds are kept.  The sample fits the thresholds
alone: all rows are indexed, and all pairs within a leaf are compared.

A split inside a group of near vectors would part its links, however it lies.  In the first
WHOLE trees, splits go where they part few of the sample's links, and a label whose links
are dense in a node and would be parted by every split stays there: the node is its leaf.

How many trees a forest needs is measured: QUERIES rows are compared with all rows, in one
pass, and trees are added until GOAL of the links found there (at most KNOWN a query) share
a leaf, MOST_TREES at most.  With fewer than EVIDENCE links there are TREES trees.

Vectors with equal directions cosine needs no search for: equal vectors of one label are
put together first and stand as one with their count.  Pairs at or above the threshold are
counted in one leaf only, the first that both vectors share, so no pair is listed; a leaf
emits counts for its vectors and the links of a spanning forest.  Leaves larger than BLOCK
are compared block by block in tasks of their own, with larger blocks in larger leaves.

Defined results: rows with a null label, a null or zero vector, or null, NaN or infinite
components are linked with nothing; so are rows with a null id, whose component is null.
Vectors of different lengths are never compared.  Repeated rows give a row each and are
linked with each other.  An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .store import Store

#: Trees, expected rows of the whole sample, rows of one label in a leaf, and the share of
#: a node's rows next to its split that go to both sides.  Labels are dealt to FORESTS
#: forests by a hash, so that the sample and the thresholds stay bounded.
TREES, SAMPLE, LEAF, SPILL, FORESTS = 10, 100_000, 800, 0.08, 64
#: Least and most trees where links are known; share of them to be found; rows compared with
#: all rows (over all forests, and at least so many of each), and links kept of each.
FEWEST, MOST_TREES, GOAL, QUERIES, QUERIES_EACH, KNOWN = 8, 48, 0.999, 512, 16, 16
#: Trees that keep dense groups whole, the share of a label's pairs in a node that are links
#: from which it is dense, the share of them that a split may part, and the places of splits.
WHOLE, DENSE, PARTED, PLACES = 2, 1 / 1024, 0.05, np.linspace(0.2, 0.8, 13)
#: Rows of a node whose pairs are looked at, and links below which nothing is told from them.
LOOK, EVIDENCE = 256, 16
#: Vectors of one leaf that are compared with one another in one task, and as one matrix;
#: a leaf of more than PARTS blocks gets larger blocks, up to MOST vectors.
BLOCK, TILE, PARTS, MOST = 2048, 512, 12, 16_384


def _direction(tree: int, node: int, size: int) -> np.ndarray:
    v = np.random.default_rng([tree, node, size, 77]).standard_normal(size)
    return v / np.linalg.norm(v)


def _links(sample: np.ndarray, labels: np.ndarray, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one label with a cosine of threshold or more among at most LOOK of rows."""
    some = rows if len(rows) <= LOOK else rows[np.linspace(0, len(rows) - 1, LOOK).astype(int)]
    near = np.triu((sample[some] @ sample[some].T >= threshold) & (labels[some][:, None] == labels[some][None, :]), 1)
    x, y = np.nonzero(near)
    return some[x], some[y]


def _parted(on: np.ndarray, x: np.ndarray, y: np.ndarray, places: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Share of the pairs that no child of a split at each place holds together."""
    low, high = np.minimum(on[x], on[y])[:, None], np.maximum(on[x], on[y])[:, None]
    return ((low < places - wide) & (high >= places + wide)).mean(axis=0)


def grow(sample: np.ndarray, labels: np.ndarray, tree: int, leaf: int, threshold: float) -> tuple[dict[int, tuple[float, float]], dict[int, set[int]]]:
    """Threshold and half-width of the spill of each inner node; children of k: 2k+1, 2k+2.
    Besides, the labels (by their place) for which an inner node is a leaf.
    """
    nodes: dict[int, tuple[float, float]] = {}
    stays: dict[int, set[int]] = {}
    whole = tree < WHOLE
    on = np.zeros(len(sample))
    work = [(0, np.random.default_rng([tree, 78]).permutation(len(sample)))]
    while work:
        node, rows = work.pop()
        if len(rows) <= leaf or node > 1 << 40:
            continue
        on[rows] = sample[rows] @ _direction(tree, node, sample.shape[1])
        if whole:
            places = np.quantile(on[rows], PLACES)
            wide = np.array([np.quantile(np.abs(on[rows] - p), SPILL) for p in places])
            for label in np.flatnonzero(np.bincount(labels[rows]) > leaf).tolist():
                own = rows[labels[rows] == label]
                x, y = _links(sample, labels, own, threshold)
                looked = min(len(own), LOOK)
                if len(x) >= max(EVIDENCE, DENSE * looked * (looked - 1) / 2) and _parted(on, x, y, places, wide).min() > PARTED:
                    stays.setdefault(node, set()).add(label)
            if node in stays:
                rows = rows[~np.isin(labels[rows], list(stays[node]))]
        if len(rows) > leaf:
            middle = float(np.median(on[rows]))
            if whole and len((pairs := _links(sample, labels, rows, threshold))[0]) >= EVIDENCE:
                places = np.quantile(on[rows], PLACES)
                wide = np.array([np.quantile(np.abs(on[rows] - p), SPILL) for p in places])
                middle = float(places[np.argmin(_parted(on, *pairs, places, wide) + 0.1 * np.abs(PLACES - 0.5))])
            if (on[rows] < middle).any() and (on[rows] >= middle).any():
                nodes[node] = (middle, float(np.quantile(np.abs(on[rows] - middle), SPILL)))
                work += [(2 * node + 1, rows[on[rows] < middle]), (2 * node + 2, rows[on[rows] >= middle])]
    return nodes, stays


def leaves(vectors: np.ndarray, labels: np.ndarray, tree: int, nodes: dict[int, tuple[float, float]], stays: dict[int, set[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every leaf that a row falls in."""
    rows, at, done = [], [], [(0, np.arange(len(vectors)))]
    while done:
        node, own = done.pop()
        if not len(own):
            continue
        ends = np.isin(labels[own], list(stays[node])) if node in stays and node in nodes else np.full(len(own), node not in nodes)
        rows.append(own[ends])
        at.append(np.full(len(rows[-1]), node))
        own = own[~ends]
        if len(own):
            middle, wide = nodes[node]
            on = vectors[own] @ _direction(tree, node, vectors.shape[1])
            done += [(2 * node + 1, own[on < middle + wide]), (2 * node + 2, own[on >= middle - wide])]
    return np.concatenate(rows), np.concatenate(at)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision of the rows of a with the rows of b."""
    return (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :])


def _usable(vec: str) -> F.Column:
    v = F.col(vec).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def meets(a: np.ndarray, b: np.ndarray, label: np.ndarray, tree: int, nodes: dict, stays: dict) -> np.ndarray:
    """Whether row k of a and row k of b, both of label k, share a leaf of the tree."""
    n = len(a)
    row, leaf = leaves(np.concatenate([a, b]), np.concatenate([label, label]), tree, nodes, stays)
    first = row < n
    pair = np.rec.fromarrays([row % n, leaf])
    got = np.zeros(n, dtype=bool)
    got[row[first][np.isin(pair[first], pair[~first])]] = True
    return got


def forest(sample: np.ndarray, labels: np.ndarray, leaf: int, threshold: float, known: tuple[np.ndarray, np.ndarray, np.ndarray], trees: int = TREES) -> list[tuple[dict, dict]]:
    """Trees until GOAL of the known links (vectors, vectors, places of their labels) share a leaf."""
    a, b, label = known
    enough = len(a) >= EVIDENCE
    found = np.zeros(len(a), dtype=bool)
    grown: list[tuple[dict, dict]] = []
    while len(grown) < (max(MOST_TREES, trees) if enough else trees):
        grown.append(grow(sample, labels, len(grown), leaf, threshold))
        if enough:
            found |= meets(a, b, label, len(grown) - 1, *grown[-1])
            if len(grown) >= min(FEWEST, trees) and found.mean() >= GOAL:
                break
    return grown


def _known(rows: DataFrame, queries: dict, threshold: float) -> dict:
    """{(forest, size): [(place of the query, vector)]}: at most KNOWN links of each query, by a hash, from all rows.

    queries: {(forest, size): (ids, unit vectors, places of the labels, place of each label)}.
    """
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        kept: dict[tuple, list] = {}
        for batch in batches:
            kinds = np.array(list(zip(batch.column("forest").to_pylist(), batch.column("size").to_pylist(), strict=True))).reshape(-1, 2)
            all_ids, draws = np.asarray(batch.column("id")), np.asarray(batch.column("draw"))
            for kind in {(f, n) for f, n in kinds.tolist()} & set(sent.value):
                own = np.flatnonzero((kinds == kind).all(axis=1))
                ids, vectors, places, names = sent.value[kind]
                m = _matrix(batch.column("v").take(pa.array(own)), kind[1])
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                labels = np.array([names.get(k, -1) for k in batch.column("label").take(pa.array(own)).to_pylist()])
                near = (vectors @ m.T >= threshold) & (places[:, None] == labels) & (ids[:, None] != all_ids[own])
                for q in np.flatnonzero(near.any(axis=1)).tolist():
                    hits = np.flatnonzero(near[q])
                    hits = hits[np.argsort(draws[own[hits]], kind="stable")[:KNOWN]]
                    best = kept.get((*kind, q), []) + [(int(draws[own[k]]), m[k]) for k in hits.tolist()]
                    kept[(*kind, q)] = sorted(best, key=lambda x: x[0])[:KNOWN]
        out = [(*key, draw, v) for key, best in kept.items() for draw, v in best]
        for at in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[at : at + 1000], strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["forest", "size", "q", "draw", "v"])

    found = rows.select("id", "label", "forest", "size", "v", F.xxhash64("id", F.lit(6)).alias("draw")).mapInArrow(run, "forest int, size int, q int, draw long, v array<double>")
    rank = F.row_number().over(Window.partitionBy("forest", "size", "q").orderBy("draw"))
    links: dict[tuple, list] = {}
    # QUERIES * KNOWN vectors at most, or QUERIES_EACH * KNOWN of each forest
    for r in found.withColumn("rank", rank).where(F.col("rank") <= KNOWN).select("forest", "size", "q", "v").collect():
        links.setdefault((r[0], r[1]), []).append((r[2], r[3]))
    sent.unpersist()
    return links


def _fit(rows: DataFrame, leaf: int, trees: int, threshold: float) -> dict:
    """{(forest, size): (place of each label, nodes and stays of each tree)}, from about SAMPLE rows; vectors have few sizes."""
    kinds = {(r.forest, r.size): r for r in rows.groupBy("forest", "size", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("forest", "size").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    if not kinds:
        return {}
    each = SAMPLE / len(kinds)
    share = F.create_map(*[x for k, r in kinds.items() for x in (F.lit(f"{k[0]}:{k[1]}"), F.lit(min(1.0, each / r.n)))])
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    samples: dict[tuple, list] = {}
    for r in rows.where(draw < share[F.concat_ws(":", "forest", "size")]).select("forest", "size", "v", "label", "id").toLocalIterator():
        samples.setdefault((r[0], r[1]), []).append((np.array(r[2], dtype=np.float32), r[3], r[4]))
    fitted, queries = {}, {}
    total = sum(r.n for r in kinds.values())
    for kind, own in sorted(samples.items()):
        sample = np.array([v for v, _, _ in own], dtype=np.float64)
        names = {label: k for k, label in enumerate(dict.fromkeys(label for _, label, _ in own))}
        labels = np.array([names[label] for _, label, _ in own])
        fitted[kind] = (names, labels, sample := sample / np.linalg.norm(sample, axis=1, keepdims=True))
        some = np.random.default_rng(79).permutation(len(own))[: max(QUERIES_EACH, round(QUERIES * kinds[kind].n / total))]
        queries[kind] = (np.array([own[k][2] for k in some.tolist()], dtype=np.int64), sample[some], labels[some], names)
    links = _known(rows, queries, threshold)
    model = {}
    for kind, (names, labels, sample) in fitted.items():
        asked, other = ([x[k] for x in links.get(kind, [])] for k in range(2))
        known = (queries[kind][1][asked], np.array(other).reshape(-1, kind[1]), queries[kind][2][asked])
        # the leaves of the sample shrink with the share, so that those of all rows keep their size
        model[kind] = (names, forest(sample, labels, max(4, int(leaf * len(sample) / kinds[kind].most)), threshold, known, trees))
    return model


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, size)


def _index(rows: DataFrame, model: dict) -> DataFrame:
    """id, n, label, v, and all (tree, leaf) of each row as one sorted list of longs."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            kinds = list(zip(batch.column("forest").to_pylist(), batch.column("size").to_pylist(), strict=True))
            found: list[list[int]] = [[] for _ in kinds]
            for kind in set(kinds):
                own = [i for i, k in enumerate(kinds) if k == kind]
                m = _matrix(batch.column("v").take(pa.array(own)), kind[1])
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                names, grown = sent.value.get(kind, ({}, []))
                labels = np.array([names.get(k, -1) for k in batch.column("label").take(pa.array(own)).to_pylist()])
                for tree, (nodes, stays) in enumerate(grown):
                    for r, leaf in zip(*(x.tolist() for x in leaves(m, labels, tree, nodes, stays)), strict=True):
                        found[own[r]].append((tree << 48) | leaf)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", "label", "size", "v")), pa.array([sorted(x) for x in found], pa.list_(pa.int64()))], names=["id", "n", "label", "size", "v", "leaves"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "n", "label", "forest", "size", "v").mapInArrow(run, f"id long, n long, label {kinds['label']}, size int, v {kinds['v']}, leaves array<long>")


def _compare(indexed: DataFrame, store: Store, threshold: float) -> DataFrame:
    """Rows of two kinds from every leaf: links of a forest (a, b), and counts (a, n)."""
    apart = indexed.select("id", "label", F.explode("leaves").alias("leaf")).select("id", F.xxhash64("label", "leaf").alias("group"), "leaf")
    large = store.table("large", apart.groupBy("group").agg(F.count(F.lit(1)).alias("rows")).select("group", F.ceil(F.col("rows") / F.least(F.greatest(F.ceil(F.col("rows") / PARTS), F.lit(BLOCK)), F.lit(MOST))).cast("int").alias("parts")).where("parts > 1"))
    rows = indexed.select("id", "n", "label", "size", "v", "leaves", F.explode("leaves").alias("leaf")).withColumn("group", F.xxhash64("label", "leaf"))
    rows = rows.join(large, "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = rows.select("label", "size", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "v", "leaves")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, counts, own = (np.asarray(table[c].combine_chunks()) for c in ("id", "n", "own"))
        m = _matrix(table["v"], table["size"][0].as_py())
        leaf, i, j = (table[c][0].as_py() for c in ("leaf", "i", "j"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        # earlier leaves of two vectors decide whether this leaf is the first that they share
        lists = table["leaves"].combine_chunks()
        values, size = np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))
        owner, sooner = np.repeat(np.arange(len(ids)), size), values < leaf
        owner, values = owner[sooner], values[sooner]
        first = np.searchsorted(owner, np.arange(len(ids) + 1))

        def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            own, other = (np.concatenate([values[first[k] : first[k + 1]] for k in side.tolist()]) for side in (x, y))
            both = np.intersect1d(own, other)
            marks = []
            for side, held in ((x, own), (y, other)):
                mark = np.zeros((len(side), len(both)), dtype=np.float32)
                if len(both):
                    at = np.minimum(np.searchsorted(both, held), len(both) - 1)
                    known = both[at] == held
                    mark[np.repeat(np.arange(len(side)), first[side + 1] - first[side])[known], at[known]] = 1
                marks.append(mark)
            return marks[0] @ marks[1].T > 0

        total = np.zeros(len(ids))
        parent = np.arange(len(ids))
        a, b = [], []

        def top(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for lo in range(0, len(left), TILE):
            for at in range(lo if i == j else 0, len(right), TILE):
                x, y = left[lo : lo + TILE], right[at : at + TILE]
                near = (cosine(m[x], m[y]) >= threshold) & (x[:, None] < y[None, :] if i == j else True)
                p, q = near.any(axis=1), near.any(axis=0)
                if not p.any():
                    continue
                x, y, near = x[p], y[q], near[p][:, q]
                near &= ~shared(x, y)
                total[x] += near @ counts[y].astype(np.float64)
                total[y] += counts[x].astype(np.float64) @ near
                while True:
                    # a link of each vector with another component, until none is left
                    top_x, top_y = (np.array([top(k) for k in side.tolist()], dtype=np.int64) for side in (x, y))
                    apart = near & (top_x[:, None] != top_y[None, :])
                    p, q = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
                    if not len(p):
                        break
                    for k, n in [*zip(x[p].tolist(), y[apart[p].argmax(axis=1)].tolist(), strict=True), *zip(x[apart[:, q].argmax(axis=0)].tolist(), y[q].tolist(), strict=True)]:
                        k, n = top(k), top(n)
                        if k != n:
                            parent[max(k, n)] = min(k, n)
                            a.append(ids[min(k, n)])
                            b.append(ids[max(k, n)])
        some = np.flatnonzero(total)
        return pa.table({"a": pa.array(np.concatenate([np.array(a, dtype=np.int64), ids[some]])), "b": pa.array([*map(int, b), *[None] * len(some)], pa.int64()), "n": pa.array([*[None] * len(a), *total[some].astype(np.int64).tolist()], pa.int64())})

    return dealt.groupBy("label", "size", "leaf", "i", "j").applyInArrow(run, "a long, b long, n long")


def classes(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """One row per row of table: id_col, n_links (long), component_id (long).

    Pairs of one label with a cosine of threshold or more are links; n_links counts the
    other rows linked with a row that the forest found, component_id is the smallest id
    that links reach.
    """
    spark = table.sparkSession
    store = Store(spark, "vectors")
    v = F.col(vec_col) if table.schema[vec_col].dataType.simpleString() == "array<float>" else F.col(vec_col).cast("array<double>")
    # -0.0 + 0.0 is 0.0: vectors that differ in the sign of a zero are equal
    zero = F.lit(0.0).cast(v_type := "float" if table.schema[vec_col].dataType.simpleString() == "array<float>" else "double")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.when(_usable(vec_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.transform(v, lambda x: (x + zero).cast(v_type))).alias("v"))
    same = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: x.cast("string"))), 256)
    # rows without a usable vector get keys that no class has, dealt evenly
    rows = store.table("rows", rows.withColumn("key", F.when(F.col("v").isNotNull(), same).otherwise(F.concat(F.lit("none:"), F.pmod(F.xxhash64("id", F.rand(7)), F.lit(4096))))))
    usable = rows.where(F.col("v").isNotNull())
    once = store.table("once", usable.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    single = usable.join(once, ["key", "id"]).select("key", "id", "n", "label", "v").dropDuplicates(["key"])
    single = store.table("single", single.withColumn("size", F.size("v")).withColumn("forest", F.pmod(F.xxhash64("label"), F.lit(FORESTS))))
    indexed = store.table("indexed", _index(single, _fit(single, leaf, trees, threshold)))
    found = store.table("pairs", _compare(indexed, store, threshold))
    counted = store.table("counts", found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links")))
    reached = components(spark, found.where("b is not null").select("a", "b"), store)
    of_class = once.join(counted, "id", "left").join(reached, "id", "left")
    of_class = store.table("classes", of_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component")))
    out = rows.select("id", "key").join(of_class, "key", "left")
    out = store.table("out", out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    store.drop_but("out")
    return out


def report(table: DataFrame) -> DataFrame:
    return classes(table).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
