"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one session per task.

A task splits its texts into pieces with numpy, gives each distinct piece a number and
loads the new ones.  Pieces that are tokens as they stand join the vocabulary; the bytes of
the others become token-position rows.  A recursive query joins neighbouring rows with the
merge table, contracts each piece's leftmost pair of minimum rank and repeats until no
piece has a pair left.  All tokens then join the vocabulary again and an ordered
aggregation decodes them.  Documents are put together from their pieces.

Pieces of more than LONG_PIECE bytes are cut first, between neighbouring bytes that no
occurrence of a token spans: no merge can cross such a place, so the parts are encoded each
alone, and text without spaces costs little more than other text.  Parts that are still
longer contract every occurrence of their least pair at once where that gives the same.

Defined results: a null text counts as empty (no ids, empty bytes); rows and their other
columns stay as they are, repeated rows too; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import as_strings

#: Fixed value: the splitting pattern that split() follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces, and bytes of them, that a worker remembers.
REMEMBERED, REMEMBERED_BYTES = 350_000, 16_000_000
#: Pieces and bytes in one DuckDB query, and characters of the texts that are split together.
PIECES_AT_ONCE, BYTES_AT_ONCE, CHARS_AT_ONCE = 60_000, 1_000_000, 4_000_000
#: Longer pieces are cut, and longer parts contract all occurrences of their least pair.
LONG_PIECE = 96
#: A noncharacter that marks the splits; texts that hold it are sliced instead.
_MARK = "\U0010ffff"
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)

_classes: np.ndarray | None = None
_coders: dict[str, Coder] = {}


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        import regex

        every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "￾" for i in range(0x110000))
        table = np.full(0x110000, _OTHER, dtype=np.uint8)
        for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
            for m in regex.finditer(pattern, every):
                table[m.start() : m.end()] = kind
        _classes = table
    return _classes


def split(text: str) -> list[str]:
    """The pieces of a text, as the splitting pattern of the vocabulary finds them.

    A piece is a contraction ('s 't 're 've 'm 'll 'd), or a run of letters, of numbers
    or of other characters with one space before it if there is one, or white space:
    the last character of a run before another piece stands apart.
    """
    if not text:
        return []
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _class_table()[code]
    n = len(code)
    start = np.ones(n + 3, dtype=bool)
    start[1:n] = kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:n] & (kind[:-1] == _SPACE)) + 1
    start[after - 1] = True
    start[after[code[after - 1] == 0x20]] = False
    quotes = np.flatnonzero(code[: n - 1] == 0x27)
    quotes = quotes[start[quotes] & (kind[quotes + 1] == _LETTER)]
    if len(quotes):
        one = code[quotes + 1]
        two = np.where(quotes + 2 < n, code[np.minimum(quotes + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[quotes[single | double] + 1] = False
        start[quotes[single] + 2] = True
        start[quotes[double] + 3] = True
    at = np.flatnonzero(start[:n])
    if _MARK in text:
        return [text[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), n], strict=True)]
    marked = np.insert(code, at[1:], ord(_MARK))
    return marked.tobytes().decode("utf-32-le", "surrogatepass").split(_MARK)


#: A row's key is its piece's number and its first byte's place; the least key of each
#: piece's pairs is their rank and place.
_LOOP = """
with recursive r(w, t, done) as (
  select (w::bigint << 32) | p, t, false from start
  union all (
    with s as (select w, t, lead(t) over x as nt, lead(w) over x as nw, lag(w) over x as pw from r where not done window x as (order by w)),
    best as (select s.w >> 32 as piece, min((m.rank::bigint << 32) | (s.w & 4294967295)) as k from s join merges m on m.pair = (s.t::bigint << 16) | s.nt where s.nw >> 32 = s.w >> 32 group by 1)
    select s.w, case when s.w & 4294967295 = best.k & 4294967295 then (best.k >> 32)::int else s.t end, best.k is null
    from s left join best on s.w >> 32 = best.piece
    where best.k is null or s.pw is null or s.pw <> (s.w >> 32 << 32) | (best.k & 4294967295)
  )
)
"""

#: As above, but every occurrence of the least pair at once, alternate ones in runs that
#: overlap; where the merged token could take part in a lower rank, the leftmost alone.
_LOOP_LONG = """
with recursive all_rows(w, p, t, done) as (
  select w, p, t, false from start
  union all (
    with s as (select w, p, t, lead(t) over x as nt, lag(p) over x as pp, row_number() over x as i from all_rows where not done window x as (partition by w order by p)),
    pairs as (select s.w, s.p, s.i, m.rank, m.safe from s join merges m on m.pair = (s.t::bigint << 16) | s.nt),
    least as (select w, min(rank) as rank from pairs group by w),
    hits as (select a.w, a.p, a.i, a.rank, a.safe, row_number() over (partition by a.w order by a.i) as j from pairs a join least b on a.w = b.w and a.rank = b.rank),
    picked as (select w, p, rank from (select *, row_number() over (partition by w, i - j order by i) as n from hits) where n % 2 = 1 and (safe or j = 1))
    select s.w, s.p, coalesce(a.rank, s.t), l.rank is null
    from s left join least l on s.w = l.w left join picked a on s.w = a.w and s.p = a.p left join picked b on s.w = b.w and s.pp = b.p
    where b.p is null
  )
), r as (select (w::bigint << 32) | p as w, t, done from all_rows)
"""

_ENDS = "select r.w >> 32 as piece, count(*) as n, string_agg(v.name, ' ' order by r.w) as ids, string_agg(v.hex, '' order by r.w) as parts from r join vocabulary v on v.id = r.t where r.done group by 1"

#: Pieces that are tokens as they stand, decoded from their ids.
_WHOLE = "select p.piece, 1 as n, v.name as ids, v.hex as parts from pieces p join vocabulary t on t.raw = p.raw join vocabulary v on v.id = t.id"


class Coder:
    """The vocabulary of one rank file in a DuckDB session."""

    def __init__(self, path: str, memory: str = "512MB"):
        import duckdb

        self.spans = None
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        a, b, r = (np.array(x, dtype=np.int64) for x in (left, right, rank))
        unsafe = np.unique(np.concatenate([a[r < a], b[r < b]]))
        self._make("merges", {"pair": (a << 16) | b, "rank": r.astype(np.int32), "safe": ~np.isin(r, unsafe)})
        self._make("vocabulary", {"id": pa.array(list(self.ranks.values()), pa.int32()), "name": list(map(str, self.ranks.values())), "hex": [t.hex() for t in self.ranks], "raw": pa.array(list(self.ranks), pa.binary())})
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.forget()

    def _make(self, name: str, columns: dict) -> None:
        self.con.register("made", pa.table(columns))
        self.con.execute(f"create or replace table {name} as select * from made")
        self.con.unregister("made")

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[str] = []
        self.bytes: list[bytes] = []
        self.sizes, self.uses = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.held = 0

    def thin(self) -> None:
        """Forget all but the pieces met most often, half of REMEMBERED at most."""
        pieces, ids, data, sizes, uses = list(self.number), self.ids, self.bytes, self.sizes, self.uses
        self.forget()
        kept = np.flatnonzero(uses > 1)
        if len(kept) > REMEMBERED // 2:
            kept = np.sort(kept[np.argpartition(-uses[kept], REMEMBERED // 2)[: REMEMBERED // 2]])
        kept = [k for k in kept.tolist() if len(pieces[k]) <= LONG_PIECE]
        self.number = {pieces[k]: i for i, k in enumerate(kept)}
        self.ids, self.bytes, self.sizes = [ids[k] for k in kept], [data[k] for k in kept], sizes[kept]
        self.uses = np.zeros(len(kept), dtype=np.int64)
        self.held = sum(map(len, self.bytes))

    def cut(self, raw: bytes) -> list[bytes]:
        """A piece in parts that no token spans."""
        if self.spans is None:
            import ahocorasick

            self.spans = ahocorasick.Automaton()
            for token in self.ranks:
                if len(token) > 1:
                    self.spans.add_word(token.decode("latin-1"), len(token))
            self.spans.make_automaton()
        inside = np.zeros(len(raw) + 2, dtype=np.int64)
        found = np.array(list(self.spans.iter(raw.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
        np.add.at(inside, found[:, 0] - found[:, 1] + 2, 1)
        np.add.at(inside, found[:, 0] + 1, -1)
        at = [0, *(np.flatnonzero(np.cumsum(inside)[1 : len(raw)] == 0) + 1).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def merge(self, parts: list[bytes]) -> tuple[list[str], list[bytes], np.ndarray]:
        """Ids (joined by spaces), decoded bytes and number of ids of each part."""
        ids, decoded, sizes = [""] * len(parts), [b""] * len(parts), np.zeros(len(parts), dtype=np.int64)
        short = [i for i, p in enumerate(parts) if len(p) <= LONG_PIECE]
        long = [i for i, p in enumerate(parts) if len(p) > LONG_PIECE]
        for some, loop in ((short, _LOOP), (long, _LOOP_LONG)):
            lo = 0
            while lo < len(some):
                hi, size = lo, 0
                while hi < len(some) and hi - lo < PIECES_AT_ONCE and (hi == lo or size + len(parts[some[hi]]) <= BYTES_AT_ONCE):
                    size += len(parts[some[hi]])
                    hi += 1
                lengths = np.array([len(parts[i]) for i in some[lo:hi]])
                owner = np.repeat(np.array(some[lo:hi], dtype=np.int32), lengths)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                data = np.frombuffer(b"".join(parts[i] for i in some[lo:hi]), dtype=np.uint8)
                self._make("start", {"w": owner, "p": place.astype(np.int32), "t": self.byte_ids[data]})
                self._take(loop + _ENDS, ids, decoded, sizes)
                lo = hi
        return ids, decoded, sizes

    def _take(self, query: str, ids: list[str], decoded: list[bytes], sizes: np.ndarray) -> np.ndarray:
        found = self.con.sql(query).to_arrow_table()
        which = found["piece"].to_numpy()
        sizes[which] = found["n"].to_numpy()
        for w, tokens, parts in zip(which.tolist(), found["ids"].to_pylist(), found["parts"].to_pylist(), strict=True):
            ids[w], decoded[w] = tokens, bytes.fromhex(parts)
        return which

    def learn(self, pieces: list[str]) -> None:
        """Encode and decode distinct pieces, in the order of their numbers."""
        ids, decoded, sizes = [""] * len(pieces), [b""] * len(pieces), np.zeros(len(pieces), dtype=np.int64)
        raws = [p.encode("utf-8", "surrogatepass") for p in pieces]
        self._make("pieces", {"piece": np.arange(len(raws), dtype=np.int64), "raw": pa.array(raws, pa.large_binary())})
        self._take(_WHOLE, ids, decoded, sizes)
        parts, owner = [], []
        for i in np.flatnonzero(sizes == 0).tolist():
            own = self.cut(raws[i]) if len(raws[i]) > LONG_PIECE else [raws[i]]
            parts += own
            owner += [i] * len(own)
        if parts:
            first = np.flatnonzero(np.diff([-1, *owner]))
            found = self.merge(parts)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(parts)], strict=True):
                i = owner[a]
                ids[i], decoded[i], sizes[i] = " ".join(found[0][a:b]), b"".join(found[1][a:b]), found[2][a:b].sum()
        self.ids += ids
        self.bytes += decoded
        self.sizes = np.concatenate([self.sizes, sizes])
        self.held += sum(map(len, raws))

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """(number of ids, the ids joined by spaces, the bytes decoded from them) of each text."""
        if len(self.number) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.thin()
        numbers, seen = [], []
        for text in texts:
            pieces = split(text)
            for piece in set(pieces):
                if piece not in self.number:
                    self.number[piece] = len(self.number)
                    seen.append(piece)
            numbers.append(np.fromiter(map(self.number.__getitem__, pieces), np.int32, len(pieces)))
        if seen:
            self.learn(seen)
        self.uses = np.concatenate([self.uses, np.zeros(len(self.number) - len(self.uses), dtype=np.int64)])
        for each in numbers:
            np.add.at(self.uses, each, 1)
            which = each.tolist()
            yield int(self.sizes[each].sum()), " ".join(map(self.ids.__getitem__, which)), b"".join(map(self.bytes.__getitem__, which))


def coder(path: str) -> Coder:
    """One coder per worker and rank file; a worker serves many tasks."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _grouped(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > CHARS_AT_ONCE:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


#: What encode() can return for each text, with Spark's and Arrow's types.
OUTPUTS = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode every text and decode the ids again, in the tasks that read the rows.

    Returns id_col, n_tokens and the outputs asked for: ids, decoded (the bytes decoded
    from them), ids_sha256 and decoded_sha256 (the hex digests of the decimal ids joined by
    spaces and of the decoded bytes).  No shuffle; a task holds one group of CHARS_AT_ONCE
    characters (or one longer text) and the pieces it remembers besides.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = coder(ranks_path)
        make = {
            "ids": lambda ids, data: np.fromstring(ids, dtype=np.int32, sep=" "),
            "decoded": lambda ids, data: data,
            "ids_sha256": lambda ids, data: hashlib.sha256(ids.encode()).hexdigest(),
            "decoded_sha256": lambda ids, data: hashlib.sha256(data).hexdigest(),
        }
        for batch in batches:
            done = 0
            for some in _grouped(as_strings(batch.column(1)).to_pylist()):
                counts, found = [], [[] for _ in outputs]
                for n, ids, data in own.encode(some):
                    counts.append(n)
                    for out, name in zip(found, outputs, strict=True):
                        out.append(make[name](ids, data))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(some)), pa.array(counts, pa.int64()), *(pa.array(x, OUTPUTS[o][1]) for x, o in zip(found, outputs, strict=True))], names=["id", "n_tokens", *outputs])
                done += len(some)

    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, " + ", ".join(f"{o} {OUTPUTS[o][0]}" for o in outputs))
    return out.withColumnRenamed("id", id_col)
