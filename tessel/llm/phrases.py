"""Substring deduplication by automata of recurring passages.

A window is WINDOW consecutive words; a window recurs when its words start anywhere else
too.  Each window has a seed, its run of GRAM words with the least hash, so equal windows
have equal seeds, and only every tenth place or so holds a seed.

1. Texts with equal words (by SHA-256) are put together first and stand as one with their
   count.
2. Seeds are counted over all texts; only windows whose seed recurs are candidates.
   They are counted exactly, by 128-bit hashes of their words: those that recur are
   confirmed, and each names one text, the least, as its source.  Candidates are made
   again where they are needed and never stored, so that the only large thing on disk is
   one shuffle at a time.
3. Confirmed windows that follow each other in their source make one passage.  Sources
   are dealt to shards of bounded size; a shard compiles an Aho-Corasick automaton of
   the seed phrases of its passages and streams past it all documents that hold a
   confirmed window of the shard.  The automaton finds the places; windows around the
   phrases found are looked up among the passages' windows and compared word by word, and
   those that agree are removed.  Shards that many documents need are dealt to several
   tasks.

Defined results: null or empty text has no words; texts with fewer than WINDOW words lose
none.  Rows with equal words, repeated rows too, recur with each other.  A null id is a
row like the others.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import Store

WINDOW, GRAM = 35, 8
#: Sources in a shard, and documents that one task streams past a shard's automaton.
SOURCES, STREAM = 16, 64
#: Windows in one Arrow batch.
OUT = 20_000


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each run of size consecutive values."""
    done, out = 1, values
    while done * 2 <= size:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = size - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Seeds:
    """The grams, windows and their seeds of a block of texts, all at once.

    grams and windows hold the word at which each starts, least the seed of each window,
    row the row of each.
    """

    def __init__(self, block: tx.Block, window: int, gram: int):
        self.hashes = block.hashes()
        rows = block.word_rows()
        every = tx.run_hashes(self.hashes, gram)
        self.gram_at = np.flatnonzero(rows[: len(every)] == rows[gram - 1 :]) if len(every) else np.zeros(0, np.int64)
        self.gram, self.gram_row = every[self.gram_at], rows[self.gram_at]
        n = max(0, len(rows) - window + 1)
        self.at = np.flatnonzero(rows[:n] == rows[window - 1 :]) if n else np.zeros(0, np.int64)
        self.row = rows[self.at]
        self.least = _least(every, window - gram + 1)[self.at] if n else np.zeros(0, np.uint64)


def _of_row(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One key for a value of a row, to look up the values of many rows at once."""
    return tx.mix64(values + tx.mix64(row.astype(np.uint64) + np.uint64(1)))


def _known(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of keys in the sorted table, -1 where it hasn't got them."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _described(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """row, id, n_words, whole (SHA-256 of all words), seeds and their counts."""
    kind = dict(docs.dtypes)["id"]

    def run(batches):
        for batch in batches:
            for lo, hi, block in tx.blocks(batch.column("text"), tx.NOT_SPACE):
                raw, found = block.buf.tobytes(), Seeds(block, window, gram)
                whole = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
                keys, first = np.unique(_of_row(found.row, found.least), return_index=True)
                at = _known(_of_row(found.gram_row, found.gram), keys)
                times = np.bincount(at[at >= 0], minlength=len(keys))
                by = np.argsort(found.row[first], kind="stable")
                sizes = np.bincount(found.row[first], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), batch.column("id").slice(lo, hi - lo), pa.array(np.diff(block.first).astype(np.int64)), pa.array(whole), tx.long_list(found.least[first][by], sizes), tx.long_list(times[by].astype(np.int64), sizes)],
                    names=["row", "id", "n_words", "whole", "seeds", "times"],
                )

    return docs.mapInArrow(run, f"row long, id {kind}, n_words long, whole string, seeds array<long>, times array<long>")


def _candidates(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """h1, h2, row, copies of the windows whose seed is among the row's recurring ones."""

    def run(batches):
        for batch in batches:
            seeds, sizes = batch.column("seeds").flatten(), batch.column("seeds").value_lengths()
            wanted = np.unique(_of_row(np.repeat(np.arange(batch.num_rows), np.asarray(sizes)), np.asarray(seeds).view(np.uint64)))
            rows, copies = np.asarray(batch.column("row")), np.asarray(batch.column("copies"))
            for lo, _, block in tx.blocks(batch.column("text"), tx.NOT_SPACE):
                found = Seeds(block, window, gram)
                some = _known(_of_row(found.row + lo, found.least), wanted) >= 0
                at, row = found.at[some], found.row[some] + lo
                h1, h2 = (tx.run_hashes(found.hashes, window, k)[at] for k in (0, 1))
                for a in range(0, len(row), OUT):
                    part = slice(a, a + OUT)
                    yield pa.RecordBatch.from_arrays([pa.array(h1[part].view(np.int64)), pa.array(h2[part].view(np.int64)), pa.array(rows[row[part]]), pa.array(copies[row[part]])], names=["h1", "h2", "row", "copies"])

    return texts.select("row", "text", "seeds", "copies").mapInArrow(run, "h1 long, h2 long, row long, copies long")


class Text:
    """The words of one text of a block, with the hashes of its grams and windows."""

    def __init__(self, block: tx.Block, grams: np.ndarray, windows: np.ndarray, row: int, window: int, gram: int):
        lo, hi = int(block.first[row]), int(block.first[row + 1])
        self.words = block.words(row)
        self.sizes = block.ends[lo:hi] - block.starts[lo:hi]
        self.grams, self.windows = grams[lo : max(lo, hi - gram + 1)], windows[lo : max(lo, hi - window + 1)]


def texts_of(column: pa.Array, window: int, gram: int):
    """A Text for each value."""
    for lo, hi, block in tx.blocks(column, tx.NOT_SPACE):
        hashes = block.hashes()
        grams, windows = tx.run_hashes(hashes, gram), tx.run_hashes(hashes, window)
        for row in range(hi - lo):
            yield Text(block, grams, windows, row, window, gram)


class Automaton:
    """The seed phrases of passages (a text, first and end word), and the places of their windows."""

    def __init__(self, passages: list[tuple[Text, int, int]], window: int, gram: int):
        import ahocorasick

        self.passages, self.window, self.gram = [text.words[a:b] for text, a, b in passages], window, gram
        # bytes as Latin-1 text, so that places in the automaton's text are byte places
        self.machine = ahocorasick.Automaton()
        keys, owners, places = [], [], []
        for k, (text, a, b) in enumerate(passages):
            words, grams = text.words, text.grams[a : b - gram + 1]
            for at in (a + np.flatnonzero(np.isin(grams, _least(grams, window - gram + 1)))).tolist():
                self.machine.add_word((b" " + b" ".join(words[at : at + gram]) + b" ").decode("latin-1"), gram)
            keys.append(text.windows[a : b - window + 1])
            owners.append(np.full(len(keys[-1]), k))
            places.append(np.arange(len(keys[-1])))
        if passages:
            self.machine.make_automaton()
            self.keys, first = np.unique(np.concatenate(keys), return_index=True)
            self.owners, self.places = np.concatenate(owners)[first], np.concatenate(places)[first]

    def cover(self, text: Text) -> list[tuple[int, int]]:
        """Runs of words [start, end) of the windows that passages hold too."""
        words, n = text.words, len(text.windows)
        if not n or not len(self.machine):
            return []
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        ends = np.fromiter((end for end, _ in self.machine.iter(joined)), np.int64)
        if not len(ends):
            return []
        begins = np.cumsum(np.concatenate([[1], text.sizes + 1]))
        last = np.searchsorted(begins, ends + 1) - self.gram  # the first word of each phrase
        near = np.zeros(n + 1, dtype=np.int64)
        np.add.at(near, np.clip(last - (self.window - self.gram), 0, n), 1)
        np.add.at(near, np.clip(last + 1, 0, n), -1)
        at = np.flatnonzero(np.cumsum(near[:n]) > 0)
        which = _known(text.windows[at], self.keys)
        on = np.zeros(len(words) + 1, dtype=np.int64)
        for i, k in zip(at[which >= 0].tolist(), which[which >= 0].tolist(), strict=True):
            p = self.places[k]
            if words[i : i + self.window] == self.passages[self.owners[k]][p : p + self.window]:
                on[i] += 1
                on[i + self.window] -= 1
        edges = np.diff(np.concatenate([[0], (np.cumsum(on) > 0).astype(np.int8)]))
        return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_sha256, starts, ends.

    starts and ends limit the runs of words that are removed; kept_sha256 is the hex
    digest of the words that stay, joined by one space, in UTF-8.
    """
    store = Store(docs.sparkSession, "phrases")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    described = store.table("described", _described(numbered, window, gram))
    long_enough = described.where(F.col("n_words") >= window)
    same = store.table("same", long_enough.groupBy("whole").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")))
    first = long_enough.select("row", "seeds", "times").join(same.select("row", "copies"), "row")
    seeded = store.table("seeded", first.select("row", "copies", F.explode(F.arrays_zip("seeds", "times")).alias("x")).select("row", F.col("x.seeds").alias("seed"), (F.col("x.times") * F.col("copies")).alias("n")))
    again = store.table("again", seeded.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed"))
    wanted = store.table("wanted", seeded.join(again, "seed").groupBy("row").agg(F.collect_list("seed").alias("seeds")).join(same.select("row", "copies"), "row"))
    store.drop("seeded", "again")
    texts = store.table("texts", numbered.select("row", "text").join(wanted, "row"))
    store.drop("wanted")
    windows = _candidates(texts, window, gram)
    counted = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("n"), F.min("row").alias("source"))
    confirmed = store.table("confirmed", counted.where("n > 1").select("h1", "h2", "source"))

    shards = F.ceil(F.lit(max(1, same.count())) / SOURCES)
    shard = F.pmod(F.xxhash64("source"), shards).alias("shard")
    pieces = confirmed.groupBy("source").agg(F.collect_list("h1").alias("keys")).select("source", "keys", shard)
    needs = store.table("needs", windows.select("h1", "h2", "row").join(confirmed, ["h1", "h2"]).select("row", shard).distinct())
    parts = store.table("parts", needs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / STREAM).alias("parts")))
    sources = store.table("sources", pieces.join(texts.select(F.col("row").alias("source"), "text"), "source").join(parts, "shard"))
    store.drop("confirmed")
    none = F.lit(None)
    compiled = sources.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), none.cast("long").alias("row"), "keys", "text")
    streamed = needs.join(parts, "shard").select("shard", F.pmod(F.xxhash64("row"), "parts").alias("part"), "row").join(texts.select("row", "text"), "row").select("shard", "part", "row", none.cast("array<long>").alias("keys"), "text")

    def locate(batches):
        now, machine, passages = None, None, []
        for batch in batches:
            shard, part, row, keys = (batch.column(i).to_pylist() for i in range(4))
            found, starts, ends = [], [], []
            for i, text in enumerate(texts_of(batch.column(4), window, gram)):
                if now != (shard[i], part[i]):
                    now, machine, passages = (shard[i], part[i]), None, []
                if row[i] is None:
                    own = np.flatnonzero(np.isin(text.windows, np.array(keys[i], dtype=np.int64).view(np.uint64)))
                    breaks = np.flatnonzero(np.diff(own) > 1)
                    for a, b in zip(own[np.append(0, breaks + 1)].tolist(), own[np.append(breaks, len(own) - 1)].tolist(), strict=True):
                        passages.append((text, a, b + window))
                    continue
                machine = machine or Automaton(passages, window, gram)
                runs = _merged(machine.cover(text))
                if runs:
                    found.append(row[i])
                    starts.append([a for a, _ in runs])
                    ends.append([b for _, b in runs])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["row", "starts", "ends"])

    dealt = compiled.unionByName(streamed).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("row").asc_nulls_first())
    runs = store.table("runs", dealt.mapInArrow(locate, "row long, starts array<int>, ends array<int>"))
    store.drop("needs", "parts", "sources")
    per_row = store.table("removed", runs.groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")))

    def cut(batches):
        for batch in batches:
            removed, digests, starts, ends = [], [], [], []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "text")), strict=True):
                runs, words, kept, done = _merged(list(zip(a, b, strict=True))), _split(text), [], 0
                for x, y in runs:
                    kept += words[done:x]
                    done = y
                kept += words[done:]
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                starts.append([x for x, _ in runs])
                ends.append([y for _, y in runs])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["row", "removed", "digest", "starts", "ends"])

    done = texts.select("row", "text").join(per_row, "row").mapInArrow(cut, "row long, removed long, digest string, starts array<int>, ends array<int>")
    by_class = store.table("cut", done.join(same, "row").select("whole", "removed", "digest", "starts", "ends"))
    out = described.select("id", "n_words", "whole").join(by_class, "whole", "left")
    empty = F.array().cast("array<int>")
    out = out.select(F.col("id").alias(id_col), "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("digest", "whole").alias("kept_sha256"), F.coalesce("starts", empty).alias("starts"), F.coalesce("ends", empty).alias("ends"))
    out = store.table("out", out)
    store.drop_but("out")
    return out


def report(docs: DataFrame) -> DataFrame:
    return find(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
