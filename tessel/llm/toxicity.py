"""Toxicity scores from a lexicon matched by Levenshtein automata, with context windows.

The lexicon is learned from labelled rows: words, and beginnings of words, that documents
marked toxic use far more often than others.  Its words form a trie.  The Levenshtein
automaton of one edit (a character put in, left out, changed, or swapped with its
neighbour) runs along the trie; its state sets are determinised as words need them, so a
word that is near no term leaves after a few characters.  Terms that clean documents often
come near are matched exactly only.  A window of words around each hit tells quotation
(quotation marks around it, or a word of reporting near it) from abuse (a word of address
near it), which lowers or raises its weight; a logistic regression turns the sums into
probabilities.

Learning reads at most FIT_ROWS rows of each label; every term of theirs that passes the
tests below is in the lexicon, and their evidence bounds how many can.  Scoring is a narrow
map over whole texts.

Defined results: null and empty texts score as texts without hits; with fewer than two
labels in the training rows every score is the label's share (0 without any).
Rows with a null id are scored like others and aren't held out; repeated rows give a row
each; of repeated labels of one id the largest counts; terms of one weight are told apart
by name; other columns of docs don't matter, whatever their names; an empty table gives
an empty one.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .labelled import held_out, row_weights, sample, sigmoid
from .store import Store
from .text import as_strings

FIT_ROWS = 4000
#: Tokens (of at most so many characters) and states of the automaton that a worker remembers.
REMEMBERED, REMEMBERED_CHARS, STATES = 150_000, 64, 20_000
#: Terms need this log odds ratio, this share of the toxic rows, and this much evidence
#: (twice the log likelihood ratio against use at the labels' common rate).
MIN_ODDS, MIN_SHARE, MIN_EVIDENCE = 2.5, 0.002, 15.0
#: Of sampled rows of a label that share this much of their shingles of so many words, one
#: counts: near copies would pass chance words off as terms.
SAME, SAME_WORDS = 0.5, 3
#: Shorter terms are matched exactly only.  Lengths of beginnings of words.
FUZZY_LENGTH, BEGINNINGS = 5, (4, 5, 6)
#: Words on each side of a hit; factors of its weight.
NEAR, QUOTED, ADDRESSED, MISSPELLED = 6, 0.35, 1.25, 0.95

#: Words of reporting, words of address, quotation marks.
REPORTING = frozenset("said says wrote writes called quote quoted quotes word term phrase insult dit écrit appelé mot terme sagte schrieb nannte wort begriff dijo escribió llamó palabra término".split())
ADDRESS = frozenset("you your you're youre u tu toi te vous votre du dich dir dein deine tú usted tus eres".split())
MARKS = "\"“”„«»"

_EDGE = re.compile(r"\A[\W_]+|[\W_]+\Z")
_INNER = re.compile(r"[-/'’,.;:|]+")


def cores(token: str) -> list[str]:
    """The words of a lower-case token without the marks around them."""
    core = _EDGE.sub("", token)
    if not core:
        return []
    parts = [_EDGE.sub("", p) for p in _INNER.split(core)]
    return [core] if len(parts) == 1 else [p for p in [*parts, core] if p]


class Lexicon:
    """A trie of terms with the one-edit automaton that runs along it."""

    def __init__(self, terms: dict[str, float], beginnings: dict[str, float], fuzzy: set[str] | None = None):
        self.terms, self.beginnings = terms, beginnings
        self.fuzzy = {t for t in terms if len(t) >= FUZZY_LENGTH} if fuzzy is None else fuzzy
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        for term in sorted(self.fuzzy):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.ends[node] = term
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[str | None] = []
        self.known: dict[str, tuple[str, float, int] | None] = {}
        self.start = self._number(self._closed({(0, 0, "")}))

    def _closed(self, states: set) -> frozenset:
        """With the states that leave out a character of a term."""
        return frozenset(states | {(k, 1, "") for node, edits, wait in states if edits == 0 for k in self.children[node].values()})

    def _number(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            ends = [self.ends[node] for node, _, wait in states if not wait and node in self.ends]
            self.found.append(max(ends, key=lambda t: (self.terms[t], t), default=None))
        return self.numbers[states]

    def _step(self, number: int, c: str) -> int:
        out = set()
        for node, edits, wait in self.sets[number]:
            if wait:
                if wait == c:
                    out.add((node, 1, ""))
                continue
            after = self.children[node]
            if c in after:
                out.add((after[c], edits, ""))
            if edits == 0:
                out.add((node, 1, ""))
                for first, k in after.items():
                    out.add((k, 1, ""))
                    if c in self.children[k]:
                        out.add((self.children[k][c], 1, first))
        self.steps[number][c] = got = self._number(self._closed(out)) if out else -1
        return got

    def near(self, word: str) -> str | None:
        """The heaviest term at one edit or less."""
        at = self.start
        for c in word:
            nxt = self.steps[at].get(c)
            at = self._step(at, c) if nxt is None else nxt
            if at < 0:
                return None
        return self.found[at]

    def look(self, word: str) -> tuple[str, float, int] | None:
        """(term, weight, edits) of a word: as it is, by its beginning, or misspelled."""
        if word in self.terms:
            return word, self.terms[word], 0
        for n in reversed(BEGINNINGS):
            if len(word) > n and word[:n] in self.beginnings:
                return word[:n], self.beginnings[word[:n]], 0
        if len(word) >= FUZZY_LENGTH - 1 and self.ends:
            term = self.near(word)
            if term:
                return term, self.terms[term], 1
        return None

    def token(self, token: str) -> tuple[str, float, int] | None:
        if token in self.known:
            return self.known[token]
        if len(self.known) > REMEMBERED or len(self.sets) > STATES:
            self.clear()
        hits = [h for h in map(self.look, cores(token)) if h]
        best = max(hits, key=lambda h: (h[1], -h[2], h[0]), default=None)
        if len(token) <= REMEMBERED_CHARS:
            self.known[token] = best
        return best


def hits(text: str, lexicon: Lexicon) -> tuple[list[tuple[str, float, int, bool, bool]], int]:
    """((term, weight, edits, quoted, addressed) of each hit, number of words)."""
    words = text.lower().split()
    look = lexicon.token
    toxic = {w for w in set(words) if look(w)}
    out = []
    if toxic:
        for i, w in enumerate(words):
            if w not in toxic:
                continue
            term, weight, edits = look(w)
            before, after = words[max(0, i - NEAR) : i], words[i + 1 : i + 1 + NEAR]
            around = {c for x in (*before, *after) for c in cores(x)}
            left = sum(x.count(m) for x in before for m in MARKS) + sum(w[: len(w) - len(w.lstrip(MARKS))].count(m) for m in MARKS)
            right = sum(x.count(m) for x in after for m in MARKS) + sum(w[len(w.rstrip(MARKS)) :].count(m) for m in MARKS)
            out.append((term, weight, edits, bool(left % 2 and right) or bool(around & REPORTING), bool(around & ADDRESS)))
    return out, len(words)


def features(found: list[tuple[str, float, int, bool, bool]], n_words: int) -> list[float]:
    abuse = quoted = slips = top = 0.0
    seen = set()
    for term, weight, edits, in_quotes, addressed in found:
        w = weight * (QUOTED if in_quotes else 1) * (ADDRESSED if addressed else 1) * (MISSPELLED if edits else 1)
        top = max(top, w)
        if term not in seen:
            seen.add(term)
            abuse, quoted, slips = abuse + w * (not in_quotes), quoted + w * in_quotes, slips + w * bool(edits)
    return [np.log1p(abuse), np.log1p(quoted), np.log1p(slips), top, np.log1p(len(found)), min(1.0, 20 * len(found) / max(n_words, 1))]


class Model:
    def __init__(self, lexicon: Lexicon, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.lexicon, self.mean, self.scale, self.weights, self.bias = lexicon, mean, scale, weights, bias

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        x = (np.array(rows, dtype=float).reshape(len(rows), -1) - self.mean) / self.scale
        return sigmoid(x @ self.weights + self.bias)


def _words(text: str) -> set[str]:
    return {c for token in set(text.lower().split()) for c in cores(token) if len(c) > 2}


def _counted(rows: DataFrame, names) -> dict[str, tuple[int, int]]:
    """{name: (toxic rows, other rows)} over a bounded sample; names: text -> set of names."""

    def run(batches):
        counts = Counter(), Counter()
        for batch in batches:
            for text, y in zip(as_strings(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[1 - y].update(names(text))
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())], names=["name", "t", "c"])

    return rows.select("text", "y").mapInArrow(run, "name string, t long, c long").groupBy("name").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _apart(rows: DataFrame) -> DataFrame:
    """The sampled rows (text, y) without near copies, told by MinHash sketches of whole texts."""
    keyed = rows.withColumn("key", F.concat_ws(":", F.col("y").cast("string"), F.xxhash64("text").cast("string")))
    signed = minhash.signatures(keyed, "key", "text", SAME_WORDS).where("sketch is not null").select("id", "sketch").collect()
    gone: list[str] = []
    by_label: dict[str, list] = {}
    for r in sorted(signed, key=lambda r: r.id):
        by_label.setdefault(r.id.split(":")[0], []).append(r)
    for own in by_label.values():
        sketches = np.array([np.frombuffer(r.sketch, dtype=np.uint64) for r in own])
        kept = np.zeros_like(sketches)
        n = 0
        for r, sketch in zip(own, sketches, strict=True):
            differing = np.bitwise_count(kept[:n] ^ sketch).sum(axis=1, dtype=np.int64)
            if (minhash.estimate(differing) >= SAME).any():
                gone.append(r.id)
            else:
                kept[n] = sketch
                n += 1
    copies = rows.sparkSession.createDataFrame([(k,) for k in gone], "key string")
    return keyed.join(F.broadcast(copies), "key", "left_anti").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    store = Store(docs.sparkSession, "toxicity")
    rows, counts = sample(store, docs, labels, label_col, fit_rows, id_col, text_col)
    rows = store.table("apart", _apart(rows))
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if len(n) < 2:
        store.drop(*store.paths)
        return Model(Lexicon({}, {}), np.zeros(6), np.ones(6), np.zeros(6), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    toxic, other = n[1], n[0]
    rate = toxic / (toxic + other)
    seen = F.col("t") + F.col("c")
    evidence = 2 * (F.col("t") * F.log(F.col("t") / seen / rate) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / seen / (1 - rate))).otherwise(0.0))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (other + 1)))

    def best(names) -> dict[str, float]:
        found = _counted(rows, names).where(F.col("t") >= max(2, int(MIN_SHARE * toxic))).withColumn("w", odds).where((F.col("w") >= MIN_ODDS) & (evidence >= MIN_EVIDENCE))
        return {r.name: float(r.w) for r in found.orderBy(F.desc("w"), F.desc("t"), "name").select("name", "w").collect()}

    terms = best(_words)
    beginnings = best(lambda text: {w[:k] for w in _words(text) for k in BEGINNINGS if len(w) > k})
    lexicon = Lexicon(terms, beginnings)

    def slips(text: str) -> set[str]:
        return {hit[0] for hit in map(lexicon.token, set(text.lower().split())) if hit and hit[2]}

    doubtful = {r.name for r in _counted(rows, slips).where((F.col("c") > 0) & (odds < MIN_ODDS)).select("name").collect()}
    lexicon = Lexicon(terms, beginnings, lexicon.fuzzy - doubtful)

    def described(batches):
        for batch in batches:
            x = [features(*hits(t, lexicon)) for t in as_strings(batch.column(0)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    known = rows.select("text", "y").mapInArrow(described, "x array<double>, y int").collect()
    x, y = np.array([r.x for r in known]), np.array([r.y for r in known])
    store.drop(*store.paths)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, w = (x - mean) / scale, row_weights(y, counts)
    beta = np.zeros(z.shape[1] + 1)
    z1 = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.append(np.full(z.shape[1], 1.0), 0)
    for _ in range(50):
        p = sigmoid(z1 @ beta)
        step = np.linalg.solve((z1 * (w * p * (1 - p))[:, None]).T @ z1 + np.diag(ridge + 1e-6), z1.T @ (w * (p - y)) + ridge * beta)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(lexicon, mean, scale, beta[:-1], float(beta[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_hits: bool = True) -> DataFrame:
    """id_col, score, and hits (term, edits, quoted) of every row if asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))

    def run(batches):
        own: Model = sent.value
        for batch in batches:
            described, listed = [], []
            for text in as_strings(batch.column(1)).to_pylist():
                found, n_words = hits(text, own.lexicon)
                described.append(features(found, n_words))
                if with_hits:
                    listed.append([{"term": h[0], "edits": h[2], "quoted": h[3]} for h in found])
            columns = [batch.column(0), pa.array(own.scores(described) if described else np.zeros(0))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(listed, shape)] if with_hits else columns, names=["id", "score", "hits"][: 3 if with_hits else 2])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, score double" + (", hits array<struct<term:string,edits:int,quoted:boolean>>" if with_hits else ""))
    return out.withColumnRenamed("id", id_col)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels), with_hits=False).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns, without a shuffle."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own: Model = sent.value
        for batch in batches:
            texts = as_strings(batch.column(batch.schema.names.index("text"))).to_pylist()
            if texts:
                scores = own.scores([features(*hits(t, own.lexicon)) for t in texts])
                yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)
