"""Byte-level BPE encoding and decoding.

Texts are cut by the vocabulary's pattern. The distinct pieces of a batch that a worker has not
met before become token-position rows in DuckDB; a recursive query joins neighbouring tokens with
the merge table and contracts each piece's leftmost minimum-rank pair until nothing joins. Ids
are decoded by an ordered aggregation over (document, position, id) rows joined to the vocabulary.
A piece of over LONG bytes is cut into stretches that are encoded like pieces. Ids are the encoding of a whole if every two
neighbours among them are the encoding of their own bytes; so only the ids around the cuts where that fails are encoded
again, over more and more of both sides until their outer neighbours agree. The work is in proportion to the piece's length, but for
a piece whose encoding depends on all that stands before (such as one letter, repeated), which the query then takes whole.
Spark partitions the documents; nothing is shuffled and only the vocabulary (a fixed file) is broadcast.

A piece that is an entry of the vocabulary is that entry, as in any byte-level BPE whose merges make its entries; only the
others reach the query.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows are
encoded each, whatever their doc_id; other columns are carried along untouched, but for those that have the name of a result
column, which they lose to it; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, spare

#: Pieces that a worker remembers, and characters of text handled at once.
CACHE_PIECES, CHUNK_CHARS = 900_000, 8_000_000
#: Pieces given to one recursive query.
QUERY_PIECES = 20_000
#: Bytes above which a piece takes the query for long ones.
LONG = 64

#: Pieces of usual length: a row knows its successor, so a pair is one self join; each round contracts the
#: leftmost pair of least rank (rank, position and successor packed into one number, least first).
ENCODE = """
WITH RECURSIVE step(it, w, pos, id, after) AS (
  SELECT 0, w, pos, id, pos + 1 FROM start
  UNION ALL
  SELECT it + 1, r.w, r.pos, CASE WHEN r.pos = best.spot THEN made ELSE r.id END, CASE WHEN r.pos = best.spot THEN beyond ELSE r.after END
  FROM step r JOIN (
    SELECT w, arg_min(m, m::BIGINT * 4096 + pos) AS made, arg_min(pos, m::BIGINT * 4096 + pos) AS spot,
           arg_min(nxt, m::BIGINT * 4096 + pos) AS gone, arg_min(nnxt, m::BIGINT * 4096 + pos) AS beyond
    FROM (SELECT a.w, a.pos, b.pos AS nxt, b.after AS nnxt, g.m
          FROM step a JOIN step b ON a.w = b.w AND a.after = b.pos JOIN merges g ON g.pair = a.id::BIGINT * 1048576 + b.id)
    GROUP BY w) best USING (w)
  WHERE r.pos <> gone)
SELECT w, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids
FROM step JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) USING (w, it) GROUP BY w
"""

#: Stretches over LONG bytes that have to be encoded in one: every occurrence of the least-ranked pair is contracted in one round where that can't change the
#: result: no pair made with the new token may rank below it (column safe). Overlapping occurrences
#: (aaaa) are taken from the left, every second one.
ENCODE_LONG = """
WITH RECURSIVE step(it, w, pos, id) AS (
  SELECT 0, w, pos, id FROM start
  UNION ALL
  SELECT it + 1, w, pos, CASE WHEN hit THEN least_id ELSE id END
  FROM (SELECT *, lag(hit, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone
        FROM (SELECT *, coalesce(cand AND (safe OR pos = first_pos)
                     AND (NOT twin OR (n - coalesce(max(CASE WHEN NOT cand THEN n END) OVER
                          (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1), false) AS hit
              FROM (SELECT *, coalesce(m = least_id, false) AS cand,
                           min(CASE WHEN m = least_id THEN pos END) OVER (PARTITION BY w) AS first_pos
                    FROM (SELECT p.*, g.m, g.safe, g.twin, min(g.m) OVER (PARTITION BY w) AS least_id
                          FROM (SELECT *, lead(id) OVER (PARTITION BY w ORDER BY pos) AS nxt,
                                       row_number() OVER (PARTITION BY w ORDER BY pos) AS n FROM step) p
                          LEFT JOIN merges g ON g.pair = p.id::BIGINT * 1048576 + p.nxt) a
                    WHERE least_id IS NOT NULL) b) c) d
  WHERE NOT gone)
SELECT w, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids
FROM step JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) USING (w, it) GROUP BY w
"""

#: Ordered aggregation. Bytes travel as characters of the same number.
DECODE = """
SELECT doc, string_agg(ch, '' ORDER BY pos) AS chars FROM tokens JOIN vocab USING (id) GROUP BY doc
"""


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from a rank file (base64 token, space, rank)."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (x.split() for x in f if x.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n-1 without gaps")
    return [ranks[k] for k in range(len(ranks))]


def merge_table(tokens: list[bytes]) -> dict[str, np.ndarray]:
    """Rows (left, right -> merged) for every way in which two tokens make a third one."""
    rank = {t: k for k, t in enumerate(tokens)}
    rows = [(a, b, k) for k, t in enumerate(tokens) for i in range(1, len(t)) if (a := rank.get(t[:i])) is not None and (b := rank.get(t[i:])) is not None]
    left, right, made = np.array(rows or np.empty((0, 3)), dtype=np.int64).T
    least = np.full(len(tokens), len(tokens), dtype=np.int64)  # lowest rank that a pair with this token can have
    np.minimum.at(least, left, made)
    np.minimum.at(least, right, made)
    return {"pair": left * 1048576 + right, "m": made, "safe": least[made] > made, "twin": left == right}


class Coder:
    """One worker's DuckDB connection, merge table and remembered pieces."""

    def __init__(self, tokens: list[bytes], merges: dict[str, np.ndarray], pattern: str):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": f"{tempfile.gettempdir()}/bpe-{os.getpid()}"})
        merged = pa.table(merges)  # noqa: F841  DuckDB reads it by name
        vocab = pa.table({"id": pa.array(range(len(tokens)), pa.int32()), "ch": [t.decode("latin-1") for t in tokens]})  # noqa: F841
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merged")
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM vocab")
        self.tokens, self.neighbours = tokens, {}
        self.rank = {t: k for k, t in enumerate(tokens)}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pattern, self.fast = regex.compile(pattern), _latin(pattern)
        self.known: dict[str, str] = {}

    def pieces(self, text: str) -> list[str]:
        if self.fast and not self.fast[0].search(text):
            return self.fast[1].findall(text)
        return [m.group() for m in self.pattern.finditer(text)] if self.pattern.groups else self.pattern.findall(text)

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
            new = list(pieces)
        hard = []
        for p in new:
            k = self.rank.get(p.encode())
            if k is None:
                hard.append(p)
            else:
                self.known[p] = str(k)
        hard.sort(key=len)  # pieces of like length need like numbers of rounds
        raw = [p.encode() for p in hard]
        short = [k for k, r in enumerate(raw) if len(r) <= LONG]
        for k, ids in zip(short, self.contract([raw[k] for k in short]), strict=True):
            self.known[hard[k]] = ids
        for k, r in enumerate(raw):
            if len(r) > LONG:
                self.known[hard[k]] = " ".join(map(str, self.encode_long(r)))

    def contract(self, raw: list[bytes]) -> list[str]:
        """The ids, joined by one space, of stretches of bytes, by the recursive queries."""
        out = [""] * len(raw)
        for query, some in ((ENCODE, [k for k, r in enumerate(raw) if len(r) <= LONG]), (ENCODE_LONG, [k for k, r in enumerate(raw) if len(r) > LONG])):
            for at in range(0, len(some), QUERY_PIECES):
                part = some[at : at + QUERY_PIECES]
                size = np.array([len(raw[k]) for k in part], dtype=np.int64)
                word = np.repeat(np.arange(len(part), dtype=np.int32), size)
                pos = np.arange(len(word), dtype=np.int32) - np.repeat(np.cumsum(size) - size, size).astype(np.int32)
                start = pa.table({"w": word, "pos": pos, "id": self.byte_id[np.frombuffer(b"".join(raw[k] for k in part), dtype=np.uint8)]})  # noqa: F841
                for w, ids in self.con.execute(query).fetchall():
                    out[part[w]] = ids
        return out

    def agree(self, pairs: set[tuple[int, int]]) -> None:
        """Learn which pairs of ids are the encoding of their own bytes."""
        new = [p for p in pairs if p not in self.neighbours]
        if len(self.neighbours) + len(new) > CACHE_PIECES:
            self.neighbours.clear()
            new = list(pairs)
        made = self.contract([self.tokens[a] + self.tokens[b] for a, b in new])
        self.neighbours.update((p, ids == f"{p[0]} {p[1]}") for p, ids in zip(new, made, strict=True))

    def encode_long(self, raw: bytes) -> list[int]:
        """The ids of a long piece, from those of its stretches."""
        cut = [raw[k : k + LONG] for k in range(0, len(raw), LONG)]
        parts = [list(map(int, ids.split())) for ids in self.contract(cut)]
        wide = [2] * len(parts)  # ids on either side of the cut before each part that are encoded again
        while True:
            cuts = {k: (parts[k - 1][-1], parts[k][0]) for k in range(1, len(parts))}
            self.agree(set(cuts.values()))
            open_ = [k for k, pair in cuts.items() if not self.neighbours[pair]]
            if not open_:
                return [x for p in parts for x in p]
            # a cut takes at most half of either part, so that neighbouring cuts don't meet
            fits = [k for k in open_ if 2 * wide[k] < min(len(parts[k - 1]), len(parts[k]))]
            again = [parts[k - 1][-wide[k] :] + parts[k][: wide[k]] for k in fits]
            made = [list(map(int, x.split())) for x in self.contract([b"".join(map(self.tokens.__getitem__, a)) for a in again])]
            ends = [((parts[k - 1][-wide[k] - 1], m[0]), (m[-1], parts[k][wide[k]])) for k, m in zip(fits, made, strict=True)]
            self.agree({p for e in ends for p in e})
            for k, m, (left, right) in zip(fits, made, ends, strict=True):
                if self.neighbours[left] and self.neighbours[right]:
                    w = wide[k]
                    parts[k - 1], parts[k] = parts[k - 1][:-w] + m[:1], m[1:] + parts[k][w:]
                else:
                    wide[k] *= 2
            # parts that are too short for their cut become one, cut from anew
            joined, wider, last = [], [], -2
            for k, (p, w) in enumerate(zip(parts, wide, strict=True)):
                if k in open_ and k not in fits and last < k - 1:
                    whole = b"".join(map(self.tokens.__getitem__, joined[-1] + p))
                    joined[-1], last = list(map(int, self.contract([whole])[0].split())), k
                else:
                    joined.append(p)
                    wider.append(w)
            parts, wide = joined, wider

    def encode(self, texts: list[str]) -> list[str]:
        """For each text its ids in decimal, joined by one space."""
        cut = [self.pieces(t) for t in texts]
        self.learn(set().union(*cut) if cut else set())
        known = self.known.__getitem__
        return [" ".join(map(known, c)) for c in cut]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        size = np.array([len(x) for x in ids], dtype=np.int64)
        if not size.sum():
            return [b""] * len(ids)
        tokens = pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), size), "pos": np.arange(size.sum(), dtype=np.int32), "id": np.concatenate(ids).astype(np.int32)})  # noqa: F841
        got = self.con.execute(DECODE).fetchall()
        out = [b""] * len(ids)
        for doc, x in got:
            out[doc] = x.encode("latin-1")
        return out


def _latin(pattern: str):
    """For the usual pattern, an equal one over explicit classes for texts below U+0250: (foreign, pattern)."""
    usual = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    if pattern != usual:
        return None
    below = [chr(c) for c in range(0x250)]
    of = lambda p: "".join(map(re.escape, filter(regex.compile(p).fullmatch, below)))
    letter, number, space = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    return re.compile("[^\0-ɏ]"), re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    if shared.value["key"] not in _coders:
        _coders.clear()
        _coders[shared.value["key"]] = Coder(shared.value["tokens"], shared.value["merges"], shared.value["pattern"])
    return _coders[shared.value["key"]]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for k, t in enumerate(texts):
        if chars and chars + len(t) > CHUNK_CHARS:
            yield start, k
            start, chars = k, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def _share(df: DataFrame, ranks_path: str, pattern: str):
    tokens = read_ranks(ranks_path)
    key = hashlib.sha256(b"\0".join([pattern.encode(), *tokens])).hexdigest()
    return df.sparkSession.sparkContext.broadcast({"key": key, "tokens": tokens, "merges": merge_table(tokens), "pattern": pattern})


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None, digests: bool = False) -> DataFrame:
    """`docs` with n_tokens and `ids` (array<int>), and with `decoded` (binary): the bytes that these ids decode to.

    With digests, ids and decoded bytes are not moved: ids_sha256 and decoded_sha256 (lowercase hex of the
    decimal ids joined by a space, and of the bytes) take their place. Columns of these names in `docs` are replaced.
    """
    prepare(docs.sparkSession)
    shared = _share(docs, ranks_path, pattern)
    new = [T.StructField("n_tokens", T.LongType())]
    new += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] if digests else [T.StructField(ids, T.ArrayType(T.IntegerType())), *(T.StructField(c, T.BinaryType()) for c in (decoded,) if c)]
    carried = [f for f in docs.schema.fields if f.name.lower() not in {x.name.lower() for x in new}]
    # the text itself goes to the worker once; carried columns keep their own types
    source = docs.select(*[F.col(f"`{f.name}`") for f in carried], F.col(f"`{text}`").alias(spare(docs.columns, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            texts = ["" if t is None else t for t in column.to_pylist()]
            for a, b in _slices(texts):
                made = coder.encode(texts[a:b])
                arrays = [np.fromstring(x, dtype=np.int32, sep=" ") if x else np.empty(0, np.int32) for x in made]
                more: list[pa.Array] = [pa.array([len(x) for x in arrays], pa.int64())]
                if digests:
                    more.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in made]))
                    more.append(pa.array([hashlib.sha256(x).hexdigest() for x in coder.decode(arrays)]))
                else:
                    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                    more.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32))))
                    if decoded:
                        more.append(pa.array(coder.decode(arrays), pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)), *more], names=[*(f.name for f in carried), *(f.name for f in new)])

    return source.mapInArrow(run, T.StructType([*carried, *new]))


def decode_documents(encoded: DataFrame, ranks_path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its ids; null or empty ids give no bytes, an id outside the vocabulary fails."""
    prepare(encoded.sparkSession)
    shared = _share(encoded, ranks_path, ".")
    carried = [f for f in encoded.schema.fields if f.name.lower() != decoded.lower()]
    source = encoded.select(*[F.col(f"`{f.name}`") for f in carried], F.col(f"`{ids}`").alias(spare(encoded.columns, "__ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        top = len(shared.value["tokens"])
        for batch in batches:
            arrays = [np.array([] if x is None else x, dtype=np.int32) for x in batch.column(batch.num_columns - 1).to_pylist()]
            if any(len(x) and (x.min() < 0 or x.max() >= top) for x in arrays):
                raise ValueError("an id lies outside the vocabulary")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(coder.decode(arrays), pa.binary())], names=[*(f.name for f in carried), decoded])

    return source.mapInArrow(run, T.StructType([*carried, T.StructField(decoded, T.BinaryType())]))
