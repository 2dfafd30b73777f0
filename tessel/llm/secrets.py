"""Secrets in texts: fixed patterns, and random strings by a token-efficiency test.

The fixed patterns give the base spans.  Besides, a run of MIN_CHARS or more characters
of [A-Za-z0-9+/_=-] with MIN_KINDS or more different characters is a span of kind token
when a public vocabulary needs many tokens for it: fewer than MAX_RATIO characters for each
token, which written words don't reach.  It mustn't overlap a base span.
Known digests (runs of hexadecimal digits of the lengths of common hashes), UUIDs, names
made of words (words of the vocabulary, alone or joined by _ - /) and numbers are excluded
first.

Defined results: null or empty text has no spans and the digest of the empty string;
every row gives a row, repeated rows and null ids too.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import as_strings

#: The kinds in their order, and the patterns of the base spans.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Thresholds of the token-efficiency test.
MIN_CHARS, MIN_KINDS, MAX_RATIO = 20, 8, 2.0
#: Letters for each token that the words of a name have at least, in small letters.
MIN_WORDS_RATIO = 2.5
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = frozenset({32, 40, 56, 64, 96, 128})
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NAME = re.compile(r"([A-Z]?[a-z]+|[A-Z]+)([_/=+-]*([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[_/=+-]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[0-9]+")

_encodings: dict[str, object] = {}


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and not overlapping for each kind."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def excluded(run: str, encoding) -> bool:
    """Known digests and identifiers."""
    if _UUID.fullmatch(run) or run.isdigit():
        return True
    if _HEX_ONLY.fullmatch(run):
        return len(run) in DIGESTS
    if _NAME.fullmatch(run):
        # a name is made of words that the vocabulary knows, whatever their case; the pieces of a
        # random string, long ones too, need a token for every one or two letters
        words = _WORD.findall(run)
        tokens = sum(len(encoding.encode_ordinary(" " + w.lower())) for w in words) + len(_DIGITS.findall(run))
        return sum(map(len, words)) / tokens >= MIN_WORDS_RATIO
    return False


def token_spans(text: str, encoding, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs with few characters for each token that no base span overlaps."""
    spans, starts = [], [a for a, _, _ in base]
    ends = list(accumulate((b for _, b, _ in base), max))
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that begin before the run ends
        if before and ends[before - 1] > m.start():
            continue
        if len(set(m[0])) < MIN_KINDS or excluded(m[0], encoding):
            continue
        if (m.end() - m.start()) / len(encoding.encode_ordinary(m[0])) < MAX_RATIO:
            spans.append((m.start(), m.end(), "token"))
    return spans


def scan(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans (array of start, end, kind; code points, end exclusive), in scan order.

    A narrow map over the rows; a task holds one Arrow batch.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        encoding = _encoding(ranks_path)
        for batch in batches:
            found = []
            for text in as_strings(batch.column(1)).to_pylist():
                base = base_spans(text)
                spans = sorted(base + token_spans(text, encoding, base), key=lambda s: (s[0], KINDS.index(s[2])))
                found.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, shape)], names=["id", "spans"])

    out = rows.mapInArrow(run, f"id {kind}, spans array<struct<start:int,end:int,kind:string>>")
    return out.select(F.col("id").alias(id_col), "spans")


def report(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Counts and digests of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "token")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs, ranks_path).select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, ranks_path: str, text_col: str = "text", length_col: str = "n_chars", mark: str = "[{}]") -> DataFrame:
    """The same rows with each secret replaced by its kind in brackets and the length kept true.

    Overlapping spans count as one, of the first one's kind.  A null text stays null.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches):
        encoding = _encoding(ranks_path)
        for batch in batches:
            texts, lengths = [], []
            column = batch.column(names.index(text_col))
            for text in column.to_pylist():
                if text is None:
                    texts.append(None), lengths.append(None)
                    continue
                base = base_spans(text)
                spans = sorted(base + token_spans(text, encoding, base), key=lambda s: (s[0], KINDS.index(s[2])))
                out, done = [], 0
                for a, b, kind in spans:
                    if a >= done:
                        out += [text[done:a], mark.format(kind)]
                    done = max(done, b)
                texts.append("".join([*out, text[done:]]))
                lengths.append(len(texts[-1]))
            columns = list(batch.columns)
            columns[names.index(text_col)] = pa.array(texts, column.type)
            if length_col in names:
                at = names.index(length_col)
                columns[at] = pa.array([old if new is None else new for old, new in zip(columns[at].to_pylist(), lengths, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
