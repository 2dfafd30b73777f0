"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of WINDOW consecutive words (a shorter item is one
window).  A window's shingles are its runs of three words (or all words of a shorter
window).  Shingles are ordered by rarity, counted over all documents, and a window joins
documents on its rarest shingle alone: a document that holds the window must hold it.
Where it does, the shingle's place in the window fixes where the window would start; it
must start and end inside the document (positional and length bounds) before its words
are compared one by one.

Benchmarks are taken in blocks of a bounded number of words and bytes, as flat arrays; each
block is sent to all tasks, and all documents are held against each block in turn.  With
several blocks documents are numbered and stored once, and the runs that blocks find in
one document are put together by its number.

Defined results: null or empty text has no words and is not contaminated; items without
words match nothing; repeated items count once per item_id; repeated documents give a row
each, null doc_id included; an item with null item_id still marks words as hit, but isn't
listed or counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import Store, settle

WINDOW, SHINGLE = 13, 3
#: Words of benchmark items sent to the tasks at once, and bytes for each of these words.
BLOCK_WORDS, WORD_BYTES = 400_000, 16


class Windows:
    """The distinct windows of one block of items, in flat arrays.

    start (word in block) and size of each window; names, the items' ids as strings;
    owners[bounds[w] : bounds[w + 1]] are the items of window w.
    """

    def __init__(self, items: list[tuple[object, str | None]]):
        raws = [(text or "").encode("utf-8", "surrogatepass") for _, text in items]
        self.names = [None if item is None else str(item) for item, _ in items]
        self.block = block = tx.Block(np.frombuffer(b"".join(raws), dtype=np.uint8), np.cumsum([0, *map(len, raws)]), tx.ALNUM, True)
        self.hashes = block.hashes()
        n = np.diff(block.first)
        size = np.minimum(n, WINDOW)
        count = np.where(n > 0, n - size + 1, 0)
        item = np.repeat(np.arange(len(n)), count)
        start = block.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        size = size[item]
        keys = np.zeros(len(item), dtype=[("size", "i8"), ("h1", "u8"), ("h2", "u8")])
        keys["size"] = size
        self.runs = {k: tx.run_hashes(self.hashes, k) for k in range(1, SHINGLE + 1)}
        for k in np.unique(size).tolist():
            own = size == k
            keys["h1"][own], keys["h2"][own] = (tx.run_hashes(self.hashes, k, which)[start[own]] for which in (0, 1))
        _, first, window = np.unique(keys, return_index=True, return_inverse=True)
        self.start, self.size = start[first], size[first]
        pairs = np.unique(window.astype(np.int64) * max(1, len(n)) + item)
        self.owners = pairs % max(1, len(n))
        self.bounds = np.searchsorted(pairs // max(1, len(n)), np.arange(len(first) + 1))

    def shingles(self, size: int) -> np.ndarray:
        """The hashes of the shingles (a column each) of the windows of one size."""
        words = min(SHINGLE, size)
        return self.runs[words][self.start[self.size == size][:, None] + np.arange(size - words + 1)]

    def tokens(self) -> tuple[np.ndarray, list[int]]:
        """The distinct shingles, sorted, and the sizes in words that they have."""
        sizes = np.unique(self.size).tolist()
        every = [self.shingles(k).ravel() for k in sizes]
        return np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64), sorted({min(SHINGLE, k) for k in sizes})

    def order(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle; ties go to the first in the window."""
        self.place = np.zeros(len(self.start), dtype=np.int64)
        key = np.zeros(len(self.start), dtype=np.uint64)
        for k in np.unique(self.size).tolist():
            own, shingles = np.flatnonzero(self.size == k), self.shingles(k)
            self.place[own] = counts[np.searchsorted(tokens, shingles)].argmin(axis=1)
            key[own] = shingles[np.arange(len(own)), self.place[own]]
        self.by = np.argsort(key, kind="stable")
        self.prefix, first = np.unique(key[self.by], return_index=True)
        self.first = np.append(first, len(self.by))

    def same(self, block: tx.Block, hashes: np.ndarray, at: int, w: int) -> bool:
        """Whether the words of a block from place `at` on are those of window w."""
        own = slice(self.start[w], self.start[w] + self.size[w])
        if not np.array_equal(hashes[at : at + self.size[w]], self.hashes[own]):
            return False
        ours = zip(self.block.starts[own].tolist(), self.block.ends[own].tolist(), strict=True)
        theirs = zip(block.starts[at : at + self.size[w]].tolist(), block.ends[at : at + self.size[w]].tolist(), strict=True)
        return all(np.array_equal(self.block.buf[a:b], block.buf[c:d]) for (a, b), (c, d) in zip(ours, theirs, strict=True))

    def find(self, block: tx.Block) -> dict[int, list[tuple[int, int, int]]]:
        """(first word, end word, window) of each occurrence, by row of a block of documents."""
        hashes, rows = block.hashes(), block.word_rows()
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for words in sorted({min(SHINGLE, k) for k in np.unique(self.size).tolist()}):
            for a, k in zip(*(x.tolist() for x in _lookup(self.prefix, tx.run_hashes(hashes, words))), strict=True):
                row = int(rows[a])
                for w in self.by[self.first[k] : self.first[k + 1]].tolist():
                    start, size = a - int(self.place[w]), int(self.size[w])
                    if words == min(SHINGLE, size) and start >= block.first[row] and start + size <= block.first[row + 1] and self.same(block, hashes, start, w):
                        spans.setdefault(row, []).append((start - int(block.first[row]), start + size - int(block.first[row]), w))
        return spans


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in keys, positions in the sorted table) of the keys that it has."""
    if not len(table) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a small bit table turns most keys away before the binary search
    mask = np.uint64((1 << 20) - 1)
    bits = np.zeros(1 << 20, dtype=bool)
    bits[table & mask] = True
    maybe = np.flatnonzero(bits[keys & mask])
    at = np.searchsorted(table, keys[maybe])
    at[at == len(table)] = 0
    same = table[at] == keys[maybe]
    return maybe[same], at[same]


def _frequencies(docs: DataFrame, text_col: str, tokens: np.ndarray, sizes: list[int]) -> np.ndarray:
    """In how many documents each of the given shingles occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        counts = np.zeros(len(sent.value), dtype=np.int64)
        for batch in batches:
            for _, _, block in tx.blocks(batch.column(0), tx.ALNUM, True):
                hashes, rows = block.hashes(), block.word_rows()
                for size in sizes:
                    keys = tx.run_hashes(hashes, size)
                    at, which = _lookup(sent.value, keys)
                    fits = rows[at] == rows[at + size - 1]
                    pairs = np.unique(rows[at[fits]] * len(counts) + which[fits])
                    counts += np.bincount(pairs % len(counts), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["token", "n"])

    found = np.zeros(len(tokens), dtype=np.int64)
    for token, n in docs.select(F.col(text_col)).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n")).collect():
        found[token] = n
    return found


def _runs(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap made one."""
    out: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RUN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _matches(docs: DataFrame, windows: Windows, all_rows: bool = True) -> DataFrame:
    """id, n_words, runs, items of the documents (id, text), or of those alone that hold a window."""
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        own: Windows = sent.value
        for batch in batches:
            for lo, hi, block in tx.blocks(batch.column("text"), tx.ALNUM, True):
                spans = own.find(block)
                some = range(hi - lo) if all_rows else sorted(spans)
                runs = [[{"start": a, "end": b} for a, b in _runs(spans.get(i, []))] for i in some]
                items = [sorted({own.names[k] for *_, w in spans.get(i, []) for k in own.owners[own.bounds[w] : own.bounds[w + 1]].tolist()} - {None}) for i in some]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo).take(pa.array(list(some), pa.int64())), pa.array(np.diff(block.first)[list(some)].astype(np.int64)), pa.array(runs, _RUN), pa.array(items, pa.list_(pa.string()))], names=["id", "n_words", "runs", "items"])

    return docs.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:int,end:int>>, items array<string>")


def _blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, block_words: int):
    """(number of blocks, the Windows of each in turn); docs: id, text."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).distinct()
    words = F.greatest(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / WORD_BYTES))
    count = max(1, -(-int(items.agg(F.sum(words)).first()[0] or 0) // block_words))

    def each():
        for k in range(count):
            some = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
            windows = Windows([tuple(r) for r in some.collect()])
            tokens, sizes = windows.tokens()
            windows.order(tokens, _frequencies(docs, "text", tokens, sizes) if len(tokens) else np.zeros(0, np.int64))
            yield windows

    return count, each()


def _folded(store: Store, docs: DataFrame, blocks) -> DataFrame:
    """row, runs, items of the documents (row, text) that hold a window of any block."""
    parts = [store.table("part", _matches(docs.select(F.col("row").alias("id"), "text"), w, False)) for w in blocks]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    together = every.groupBy(F.col("id").alias("row")).agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    last = lambda done: F.element_at(done, -1)
    grown = lambda done, r: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], r["end"]).alias("end"))))
    merged = F.aggregate("runs", F.array().cast("array<struct<start:int,end:int>>"), lambda done, r: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= r["start"]), grown(done, r)).otherwise(F.concat(done, F.array(r))))
    return together.withColumn("runs", merged)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Words of documents inside any occurrence of a benchmark window.

    Returns id_col, n_words, n_hit, starts and ends (of the hit runs of words), items
    (the item ids as strings, sorted as strings).  With one block of benchmark words the
    documents aren't shuffled; with more, only the runs are.
    """
    settle(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    count, blocks = _blocks(rows, benchmark, item_col, item_text, block_words)
    if count == 1:
        out = _matches(rows, next(blocks))
    else:
        store = Store(docs.sparkSession, "decontamination")
        numbered = store.table("numbered", rows.withColumn("row", F.monotonically_increasing_id()))
        found = store.table("found", _folded(store, numbered, blocks))
        counted = _matches(numbered.select(F.struct("row", "id").alias("id"), "text"), Windows([])).select("id.row", "id.id", "n_words")
        none = F.array()
        out = counted.join(found, "row", "left").select("id", "n_words", F.coalesce("runs", none.cast("array<struct<start:int,end:int>>")).alias("runs"), F.coalesce("items", none.cast("array<string>")).alias("items"))
        out = store.table("out", out)
        store.drop_but("out")
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.col("runs.start").alias("starts"), F.col("runs.end").alias("ends"), "items")


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with the digest of its items and the contamination mark."""
    found = find(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that aren't contaminated, with all their columns.

    Each row is judged by its own text, whatever its id; null texts stay.  With one block
    of benchmark words rows are filtered where they are read, without a shuffle; with
    more, rows get numbers of their own and those of contaminated rows are joined out.
    """
    spark, names = settle(docs.sparkSession), docs.columns
    texts = docs.select(F.lit(None).cast("long").alias("id"), "text")
    count, blocks = _blocks(texts, benchmark, "item_id", "text", block_words)
    if count > 1:
        store = Store(spark, "decontamination")
        numbered = store.table("numbered", docs.withColumn("_row", F.monotonically_increasing_id()))
        found = store.table("found", _folded(store, numbered.select(F.col("_row").alias("row"), "text"), blocks))
        words = _matches(numbered.select(F.col("_row").alias("id"), "text").join(found.select(F.col("row").alias("id")), "id", "left_semi"), Windows([])).select(F.col("id").alias("row"), "n_words")
        hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
        gone = found.join(words, "row").withColumn("n_hit", hit).where(contaminated()).select(F.col("row").alias("_row"))
        return numbered.join(gone, "_row", "left_anti").select(names)
    sent = spark.sparkContext.broadcast(next(blocks))

    def run(batches):
        own: Windows = sent.value
        for batch in batches:
            for lo, hi, block in tx.blocks(batch.column(names.index("text")), tx.ALNUM, True):
                n, stays = np.diff(block.first), np.ones(hi - lo, dtype=bool)
                for i, spans in own.find(block).items():
                    hit = sum(b - a for a, b in _runs(spans))
                    stays[i] = not (hit > 0 and 20 * hit >= n[i])
                yield batch.slice(lo, hi - lo).filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
