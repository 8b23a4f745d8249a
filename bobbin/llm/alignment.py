"""Alignment of two tokenizers by an associative fragment monoid.

A is a byte-level BPE over space+text, B a sentence-piece BPE over text (it adds the space). Where a token of A and one of B end at
the same byte of space+text, a group ends; inside a group every token of A is linked with every one of B.

Fragments. A chunk owns the tokens that start in its range of bytes. What it knows of the groups is a Fragment: an open prefix (tokens up to
its first common end; their group may begin before the chunk), closed groups, and an open suffix (tokens after its last common
end). A chunk without a common end is all prefix. compose() joins two neighbours: the left's suffix and the right's prefix may
hold common ends that neither saw. It is associative, with the empty fragment as its identity.

Texts of at least CHUNK bytes are cut into chunks, at any byte; a chunk travels to a task of its own with the words around its
ends, so that its tokens are those of the whole text (a chunk moves its end to the next place between words where none is within REACH).
Their fragments are reduced as a tree, FAN neighbours at a time, each level one shuffle of the open ends only; closed groups stay where
they closed. Shorter texts are one chunk and need no reduction.

Tokens. Neither tokenizer joins bytes across a single space between two characters that aren't space, so a text is cut into units
there, and each worker remembers the ids of short units (at most UNITS of them).

Counts. How many documents hold an id pair linked is summed from blocks of at most BLOCK documents and about BLOCK_CHARS characters, each with one list of its distinct pairs; the
counts come back to the blocks, joined by pair (frequent ones dealt by a salt), and meet the blocks' documents by block. Pairs of
chunked documents are rows of their own. Nothing is broadcast but the two vocabularies.

Defined results: null and empty texts, and texts whose tokens don't spell space+text for both tokenizers (B folds U+2581 into space), have
zeros, empty groups and count for no pair; rows are told apart by position, so one that repeats a doc_id or a whole row counts as a
document of its own; a null doc_id is carried; of counts, ties are all highest; no rows give no rows; other columns are not read.
The groups of one document are hashed in order by one task, which streams them; a group's links are multiplied out by its distinct
ids, so a group costs the product of these.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SIGNS, attach, forget, give_back, keep, prepare

#: Bytes of a chunk, bytes around its end in which a place between words is sought, and neighbours composed at a time.
CHUNK, REACH, FAN = 32 << 10, 2 << 10, 8
#: Documents and characters of a block; units that a worker remembers, and their greatest length.
BLOCK, BLOCK_CHARS, UNITS, UNIT_CHARS = 2048, 4 << 20, 400_000, 48
#: Bytes of a block's texts whose tokens and links are worked out at once.
PART_BYTES = 512 << 10
#: Links of a group that are listed one by one.
FEW_LINKS = 256
#: A single space between characters that aren't space, for texts; the same between two printable ASCII signs, for bytes.
_BETWEEN = re.compile(r"(?<=[^\s▁᠎])(?= [^\s▁᠎])")
_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")
#: Units that can follow one another.
_JOINT = re.compile(r" [^\s▁᠎](?:.*[^\s▁᠎])?", re.DOTALL)
#: Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Tokens = list[tuple[int, int]]


class Fragment(NamedTuple):
    """Tokens are (id, end). `stretches` lists (end, groups) of neighbouring closed groups, a group being (A ids, B ids)."""

    pre_a: Tokens
    pre_b: Tokens
    stretches: list
    suf_a: Tokens
    suf_b: Tokens
    closed: bool


IDENTITY = Fragment([], [], [], [], [], False)


def _group(a: Tokens, b: Tokens) -> tuple:
    return tuple(i for i, _ in a), tuple(i for i, _ in b)


def fragment(a: Tokens, b: Tokens) -> Fragment:
    """The fragment of neighbouring tokens."""
    ends = {e for _, e in b}
    common = [e for _, e in a if e in ends]
    if not common:
        return Fragment(a, b, [], [], [], False)
    first, last = common[0], common[-1]
    side = lambda x, lo, hi: [t for t in x if lo < t[1] <= hi]
    middle = cut(side(a, first, last), side(b, first, last))
    return Fragment(side(a, 0, first), side(b, 0, first), [(last, middle)] if middle else [], [t for t in a if t[1] > last], [t for t in b if t[1] > last], True)


def cut(a: Tokens, b: Tokens) -> list[tuple]:
    """Groups of tokens that begin at one byte and end at one."""
    out, i, j, x, y = [], 0, 0, [], []
    while i < len(a) or j < len(b):
        if j == len(b) or i < len(a) and a[i][1] <= b[j][1]:
            x.append(a[i][0])
            both = j < len(b) and a[i][1] == b[j][1]
            i += 1
            if both:
                y.append(b[j][0])
                j += 1
                out.append((tuple(x), tuple(y)))
                x, y = [], []
        else:
            y.append(b[j][0])
            j += 1
    return out


def closings(f: Fragment) -> list:
    """The stretches of a fragment that begins at a common end: its prefix is a group then."""
    if not f.closed or not (f.pre_a or f.pre_b):
        return f.stretches
    end = max(e for _, e in [*f.pre_a, *f.pre_b])
    return [(end, [_group(f.pre_a, f.pre_b)]), *f.stretches]


def compose(left: Fragment, right: Fragment) -> Fragment:
    if left.closed:
        m = fragment(left.suf_a + right.pre_a, left.suf_b + right.pre_b)
        suffix = (right.suf_a, right.suf_b) if right.closed else (m.suf_a, m.suf_b) if m.closed else (m.pre_a, m.pre_b)
        return Fragment(left.pre_a, left.pre_b, left.stretches + closings(m) + right.stretches, *suffix, True)
    m = fragment(left.pre_a + right.pre_a, left.pre_b + right.pre_b)
    if right.closed:
        return Fragment(m.pre_a, m.pre_b, m.stretches + right.stretches, right.suf_a, right.suf_b, True)
    return m


def spell(group: tuple) -> str:
    return "|".join(",".join(map(str, ids)) for ids in group)


def linked(groups: list) -> dict[int, int]:
    """Links of groups by pair (A id * 2^32 + B id)."""
    out: dict[int, int] = {}
    for a, b in groups:
        if len(a) * len(b) > 16:
            a, b = list(Counter(a).items()), list(Counter(b).items())
            for i, n in a:
                for j, m in b:
                    out[i << 32 | j] = out.get(i << 32 | j, 0) + n * m
        else:
            for i in a:
                for j in b:
                    out[i << 32 | j] = out.get(i << 32 | j, 0) + 1
    return out


class Told(NamedTuple):
    """What is told of stretches of closed groups, one entry a stretch: spelling, numbers; and links as (stretch, pair, links)."""

    groups: list[str]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    at: np.ndarray
    pairs: np.ndarray
    links: np.ndarray


def tell(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, stops: np.ndarray, spelt: tuple[np.ndarray, np.ndarray]) -> Told:
    """Told of tokens (ids and ascending ends) in stretches that end at `stops`, where both sides have an end; `spelt` has
    each id's spelling before a sign inside its side and at its side's end."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    n_a, n_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
    up_a, up_b = np.cumsum(n_a), np.cumsum(n_b)
    # spelling: a group's tokens of A, then those of B
    parts = np.empty(len(a) + len(b), dtype=object)
    parts[np.arange(len(a)) + (up_b - n_b)[of_a]] = spelt[0][(np.arange(len(a)) + 1 == up_a[of_a]).astype(np.intp), a]
    parts[np.arange(len(b)) + up_a[of_b]] = spelt[1][(np.arange(len(b)) + 1 == up_b[of_b]).astype(np.intp), b]
    signs = parts.tolist()
    last = np.searchsorted(common, stops)
    bounds = [0, *(up_a + up_b)[last].tolist()]
    groups = ["".join(signs[x:y])[:-1] for x, y in pairwise(bounds)]
    per = lambda up: np.diff(up[last], prepend=0)
    # links: each token of A with every one of B in its group; large groups by their distinct ids
    each = n_b[of_a]
    many = (n_a * n_b > FEW_LINKS)[of_a]
    each = np.where(many, 0, each)
    other = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat((up_b - n_b)[of_a], each)
    pair, at = np.repeat(a, each) << 32 | b[other], np.searchsorted(last, np.repeat(of_a, each))
    links = np.ones(len(pair), np.int64)
    for g in np.unique(of_a[many]).tolist():
        x, y = (np.unique(side[of == g], return_counts=True) for side, of in ((a, of_a), (b, of_b)))
        own = (x[0][:, None] << 32 | y[0][None, :]).ravel()
        pair, links = np.concatenate([pair, own]), np.concatenate([links, (x[1][:, None] * y[1][None, :]).ravel()])
        at = np.concatenate([at, np.full(len(own), np.searchsorted(last, g))])
    known, code = np.unique(pair, return_inverse=True)
    key, place = np.unique(at * max(1, len(known)) + code, return_inverse=True)
    summed = np.zeros(len(key), np.int64)
    np.add.at(summed, place, links)
    at, code = np.divmod(key, max(1, len(known)))
    return Told(groups, per(up_a), per(up_b), np.diff(last + 1, prepend=0), per(np.cumsum(n_a * n_b)), at, known[code] if len(known) else key, summed)


class Aligner:
    """Both tokenizers, from their files' contents.

    Units that a worker doesn't remember are joined and go through each tokenizer as one text, whose ids are cut at the units' ends."""

    def __init__(self, a_spec: str, b_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_spec), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        byte = {c: b for b, c in SIGNS.items()}
        vocab = self.a.get_vocab(with_added_tokens=True)
        entries = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in vocab.items()}
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.sizes = [np.array([len(t) for t in entry], np.int64) for entry in (self.a_bytes, self.b_bytes)]
        self.spelt = tuple(np.array([[f"{i}{c}" for i in range(len(entry))] for c in ("," + end)], dtype=object) for entry, end in ((self.a_bytes, "|"), (self.b_bytes, ";")))
        self.fast = self._ranks(json.loads(a_spec), entries)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def _ranks(self, spec: dict, entries: dict[int, bytes]):
        """A as a table of ranks, where it is one: byte-level pre-tokens, and merges in the order of the ids they make."""
        model, cut = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] is not None or cut != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return None
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {t: i for i, t in entries.items() if i not in special}
        if made != sorted(made) or len(made) + 256 != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, spaced: str) -> tuple[list[int], list[int]]:
        """Ids of both tokenizers for a text that begins with a space."""
        return self.fast.encode_ordinary(spaced) if self.fast else self.a.encode(spaced, add_special_tokens=False).ids, self.b.encode(spaced[1:])

    def learn(self, units: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of units, as bytes of 32-bit numbers; None where the tokens don't spell the unit."""
        alone = [u for u in units if not _JOINT.fullmatch(u)]
        if alone and len(units) > 1:
            rest = [u for u in units if _JOINT.fullmatch(u)]
            return {u: ids for part in ([rest] if rest else []) + [[u] for u in alone] for u, ids in self.learn(part).items()}
        spaced = "".join(units)
        ends = np.cumsum([len(u.encode()) for u in units])
        sides = []
        for ids, entry, sizes in zip(self.ids(spaced), (self.a_bytes, self.b_bytes), self.sizes, strict=True):
            if b"".join([entry[i] for i in ids]) != spaced.encode():
                return {units[0]: None} if len(units) == 1 else self.learn(units[: len(units) // 2]) | self.learn(units[len(units) // 2 :])
            at = (4 * np.searchsorted(np.cumsum(sizes[ids]), ends, side="right")).tolist()
            raw = array("i", ids).tobytes()
            sides.append([raw[x:y] for x, y in pairwise([0, *at])])
        return dict(zip(units, zip(*sides, strict=True), strict=True))

    def tokens(self, spaced: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and ends of A, of B, of a text that begins with a space, or of a part of one between places between words; None where they don't spell it."""
        units, known = _spaced(spaced), self.known
        new = [u for u in set(units) if u not in known]
        if len(known) + len(new) > UNITS:
            known.clear()
            new = list(set(units))
        long: dict[str, tuple[bytes, bytes] | None] = {}
        if new:
            for u, ids in self.learn(new).items():
                (known if len(u) <= UNIT_CHARS else long)[u] = ids
        parts = [long[u] if u in long else known[u] for u in units] if long else list(map(known.__getitem__, units))
        if None in parts:
            return None
        out = []
        for k, sizes in enumerate(self.sizes):
            ids = np.frombuffer(b"".join([p[k] for p in parts]), np.int32).astype(np.int64)
            out += [ids, np.cumsum(sizes[ids])]
        return out[0], out[1], out[2], out[3]

    def chunk(self, window: bytes, at: int, lo: int, hi: int) -> tuple[Fragment, Told | None] | None:
        """The fragment of the tokens that start in [lo, hi), and what is told of its stretch. `window` holds the bytes from `at` on,
        from one place between words to another. None if the tokens don't spell them."""
        got = self.tokens(window.decode())
        if got is None:
            return None
        sides = []
        for ids, ends in (got[:2], got[2:]):
            starts = at + np.concatenate([[0], ends[:-1]])
            own = (starts >= lo) & (starts < hi)
            sides.append((ids[own], at + ends[own]))
        common = np.intersect1d(sides[0][1], sides[1][1], assume_unique=True)
        pick = lambda low, high: [list(zip(ids[k].tolist(), ends[k].tolist(), strict=True)) for ids, ends in sides for k in ((ends > low) & (ends <= high),)]
        if not len(common):
            return Fragment(*pick(-1, hi << 1), [], [], [], False), None
        first, last = int(common[0]), int(common[-1])
        inner = [x[k] for ids, ends in sides for k in ((ends > first) & (ends <= last),) for x in (ids, ends)]
        told = tell(*inner, np.array([last]), self.spelt) if last > first else None
        return Fragment(*pick(-1, first), [(last, None)] if told else [], *pick(last, 1 << 62), True), told


def _spaced(spaced: str) -> list[str]:
    """Units of a text that begins with a space."""
    return _BETWEEN.split(spaced)


def windows(text: str, chunk: int = CHUNK, reach: int = REACH) -> Iterator[tuple[int, int, int, bytes]]:
    """(lo, hi, at, window) of the chunks of space+text: owned bytes, and the bytes from `at` on between places between words."""
    raw = (" " + text).encode()
    marks, pos = [(0, 0, 0)], chunk
    while pos < len(raw):
        base = max(0, pos - reach - 1)
        near = [base + m.start() for m in _CUT.finditer(raw[base : pos + reach + 2])]
        left, right = [p for p in near if p <= pos], [p for p in near if p >= pos]
        if left and right:
            marks.append((pos, left[-1], right[0]))
        else:
            m = _CUT.search(raw, pos)
            if not m:
                break
            marks.append((m.start(),) * 3)
        pos = marks[-1][0] + chunk
    for (lo, at, _), (hi, _, stop) in zip(marks, [*marks[1:], (len(raw),) * 3], strict=True):
        yield lo, hi, at, raw[at:stop]


def _pack(tokens: Tokens) -> bytes:
    return np.array(tokens, dtype=np.int64).tobytes()


def _unpack(data: bytes) -> Tokens:
    return [tuple(t) for t in np.frombuffer(data, np.int64).reshape(-1, 2).tolist()]


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_STRETCH = "row long, k int, chunks int, edge boolean, ok boolean, pre_a binary, pre_b binary, suf_a binary, suf_b binary, closed boolean, at long, groups string, n_a long, n_b long, n_groups long, n_links long, codes array<long>, links array<long>"


def _rows_of(row: int, k: int, chunks: int, ok: bool, f: Fragment, told: Told | None) -> list[tuple]:
    """A row for each stretch of a fragment and, unless it is the whole document, one for its open ends."""
    stretches = closings(f) if chunks == 1 else f.stretches
    out = []
    for end, groups in stretches:
        if groups is None:
            said = (told.groups[0], *(int(x[0]) for x in told[1:5]), told.pairs.tolist(), told.links.tolist())
        else:
            links = linked(groups)
            n = [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(len(a) * len(b) for a, b in groups)]
            said = (";".join(map(spell, groups)), *n, list(links), list(links.values()))
        out.append((row, k, chunks, False, ok, *(None,) * 5, int(end), *said))
    if chunks > 1 or not out:
        out.append((row, k, chunks, True, ok, *map(_pack, (f.pre_a, f.pre_b, f.suf_a, f.suf_b)), f.closed, 0, "", 0, 0, 0, 0, [], []))
    return out


def _long_documents(docs: DataFrame, readers, chunk: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(rows of chunked documents, row and doc_id of them, tables to forget): stretches in `at` order within a row."""
    numbered = docs.where(F.octet_length("text") >= chunk).withColumn("row", F.monotonically_increasing_id())
    split_schema = T.StructType().add("row", "long").add(docs.schema["doc_id"]).add("k", "integer").add("chunks", "integer").add("lo", "long").add("hi", "long").add("at", "long").add("window", "binary")
    arrow = to_arrow_schema(split_schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (t, row) in enumerate(zip(batch.column("text"), batch.column("row").to_pylist(), strict=True)):
                n = 0
                parts = list(windows(t.as_py(), chunk))
                for lo, hi, at, window in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([row]), batch.column("doc_id").slice(i, 1), pa.array([n], pa.int32()), pa.array([len(parts)], pa.int32()), *(pa.array([v]) for v in (lo, hi, at)), pa.array([window], pa.binary())], schema=arrow)
                    n += 1

    spread = keep(numbered.mapInArrow(split, split_schema).repartition("row", "k"), "windows")
    made_schema = to_arrow_schema(docs.sparkSession.createDataFrame([], _STRETCH).schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(readers)
        for batch in batches:
            for r in batch.to_pylist():
                got = aligner.chunk(r["window"], r["at"], r["lo"], r["hi"])
                made = _rows_of(r["row"], r["k"], r["chunks"], got is not None, *(got or (IDENTITY, None)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), made_schema, strict=True)], schema=made_schema)
        give_back()

    level = keep(spread.select("row", "k", "chunks", "lo", "hi", "at", "window").mapInArrow(work, _STRETCH), "fragments")
    levels = [level]
    most = spread.agg(F.max("chunks")).first()[0] or 1

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        parts = [Fragment(_unpack(a), _unpack(b), [], _unpack(c), _unpack(d), bool(e)) for a, b, c, d, e in zip(*(rows[c] for c in ("pre_a", "pre_b", "suf_a", "suf_b", "closed")), strict=True)]
        made = _rows_of(int(key[0]), int(key[1]), -(-int(rows["chunks"].iloc[0]) // FAN), bool(rows["ok"].all()), reduce(compose, parts, IDENTITY), None)
        return pd.DataFrame(made, columns=list(made_schema.names))

    while most > 1:
        most = -(-most // FAN)
        edges = level.where("edge and chunks > 1").withColumn("up", F.floor(F.col("k") / FAN).cast("int"))
        level = keep(edges.groupBy("row", "up").applyInPandas(fold, _STRETCH), "fragments")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels), spread.where("k = 0").select("row", "doc_id"), [*levels, spread]


def _short_schema(doc_id: T.StructField, groups: bool) -> T.StructType:
    s = T.StructType().add("block", "long").add(doc_id)
    for c in _NUMBERS:
        s = s.add(c, "long")
    s = s.add("groups_sha256", "string")
    s = s.add("groups", "string") if groups else s
    return s.add("places", "binary").add("links", "binary").add("codes", T.ArrayType(T.LongType())).add("docs", T.ArrayType(T.LongType()))


def _short_documents(docs: DataFrame, readers, chunk: int, groups: bool) -> DataFrame:
    """Documents of one chunk: their numbers and links by place in the pair list of their block, and a row with that list for each block."""
    src = docs.where(F.coalesce(F.octet_length("text") < chunk, F.lit(True)))
    schema = _short_schema(docs.schema["doc_id"], groups)
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = _aligner(readers), TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        texts: list[str | None] = []
        size = 0

        for batch in batches:
            taken = 0
            for k, t in enumerate(batch.column("text")):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if len(texts) >= BLOCK or size >= BLOCK_CHARS:
                    ids.append(batch.column("doc_id").slice(taken, k + 1 - taken))
                    taken = k + 1
                    yield from _block_rows(aligner, block, pa.concat_arrays(ids), texts, groups, arrow)
                    block, ids, texts, size = block + 1, [], [], 0
            ids.append(batch.column("doc_id").slice(taken))
        if texts:
            yield from _block_rows(aligner, block, pa.concat_arrays(ids), texts, groups, arrow)
        give_back()

    return src.select("doc_id", "text").mapInArrow(work, schema)


def _block_rows(aligner: Aligner, block: int, ids: pa.Array, texts: list[str | None], groups: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a block's documents, and the row with its pairs and how many of its documents hold each."""
    n = len(texts)
    columns = {c: np.zeros(n, np.int64) for c in _NUMBERS} | {"block": np.full(n, block)}
    columns |= {"doc_id": ids, "codes": pa.nulls(n), "docs": pa.nulls(n)} | {c: [v] * n for c, v in (("groups_sha256", ""), ("groups", ""), ("places", b""), ("links", b""))}
    parts = []

    def told_of(good: list[int], tokens: tuple[list, ...], stops: list[int]) -> None:
        told = tell(*(np.concatenate(x) for x in tokens), np.array(stops), aligner.spelt)
        for c, x in zip(_NUMBERS, told[1:5], strict=True):
            columns[c][good] = x
        for k, said in zip(good, told.groups, strict=True):
            columns["groups_sha256"][k] = hashlib.sha256(said.encode()).hexdigest()
            columns["groups"][k] = said if groups else ""
        own, places = np.unique(told.pairs, return_inverse=True)
        parts.append((good, np.searchsorted(told.at, np.arange(len(good) + 1)), own, places.astype(np.int32), told.links.astype(np.int32)))

    good, tokens, stops, at = [], ([], [], [], []), [], 0
    for k, t in enumerate(texts):
        got = aligner.tokens(" " + t) if t else None
        if got is not None:
            good.append(k)
            for held, x, shift in zip(tokens, got, (0, at, 0, at), strict=True):
                held.append(x + shift)
            at += int(got[1][-1])
            stops.append(at)
        if at >= PART_BYTES:
            told_of(good, tokens, stops)
            good, tokens, stops, at = [], ([], [], [], []), [], 0
    if good:
        told_of(good, tokens, stops)
    known = np.unique(np.concatenate([p[2] for p in parts])) if parts else np.empty(0, np.int64)
    docs = np.zeros(len(known), np.int64)
    for good, bounds, own, places, links in parts:
        places = np.searchsorted(known, own).astype(np.int32)[places]
        docs += np.bincount(places, minlength=len(known))
        for j, k in enumerate(good):
            at = slice(bounds[j], bounds[j + 1])
            columns["places"][k], columns["links"][k] = places[at].tobytes(), links[at].tobytes()
    yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    yield pa.RecordBatch.from_pylist([{"block": block, "codes": known.tolist(), "docs": docs.tolist()}], schema=schema)


_aligners: dict[int, Aligner] = {}


def _aligner(readers) -> Aligner:
    """The worker's aligner, kept for its next tasks."""
    key = hash(readers.value)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*readers.value)
    return _aligners[key]


def align(docs: DataFrame, a_path: str, b_path: str, groups: bool = False, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row, and its groups if asked for.

    n_best: links whose pair is held by as many documents as any pair of its A id; count_sum: that number, summed over links."""
    spark = prepare(docs.sparkSession)
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        readers = spark.sparkContext.broadcast((f.read(), g.read()))
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    texts = ["groups"] if groups else []

    short = keep(_short_documents(src, readers, chunk, groups), "short")
    lists = short.where("codes is not null").select("block", F.posexplode(F.arrays_zip("codes", "docs")).alias("place", "z")).select("block", "place", F.col("z.codes").alias("code"), F.col("z.docs").alias("docs"))
    lists = keep(lists, "lists")

    stretches, numbered, old = _long_documents(src, readers, chunk)
    good = keep(stretches.groupBy("row").agg(F.min("ok").alias("ok")).where("ok").select("row"), "good")
    pairs = stretches.join(good, "row", "left_semi").select("row", F.explode(F.arrays_zip("codes", "links")).alias("z")).groupBy("row", F.col("z.codes").alias("code")).agg(F.sum("z.links").alias("links"))
    pairs = keep(pairs, "pairs")

    counts = lists.select("code", "docs").union(pairs.select("code", F.lit(1).cast("long").alias("docs"))).groupBy("code").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("code", 32))
    counts = keep(counts, "counts")
    counted = counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    counted = keep(counted, "counted")

    known = attach(lists.select("block", "place", "code"), counted, "code").select("block", "place", "n", "best")
    rows = short.where("codes is null").drop("codes", "docs")
    out = T.StructType().add("doc_id", docs.schema[doc_id].dataType)
    for c in [*_NUMBERS, "n_best", "count_sum"]:
        out = out.add(c, "long")
    for c in ["groups_sha256", *texts]:
        out = out.add(c, "string")

    def weigh(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(known), np.int64), np.zeros(len(known), bool)
        n[known["place"]], best[known["place"]] = known["n"], known["best"]
        sums = []
        for places, links in zip(rows["places"], rows["links"], strict=True):
            at, own = np.frombuffer(places, np.int32), np.frombuffer(links, np.int32).astype(np.int64)
            sums.append((int(own[best[at]].sum()), int((own * n[at]).sum())))
        rows = rows.assign(n_best=[s[0] for s in sums], count_sum=[s[1] for s in sums])
        return rows[out.names]

    near = rows.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(weigh, out)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", *_NUMBERS, "groups_sha256", *texts]
        now, n, sha, parts, first = None, np.zeros(4, np.int64), hashlib.sha256(), [], True
        for batch in batches:
            for r in batch.to_pylist():
                if r["row"] != now:
                    if now is not None:
                        yield done(names, now, n, sha, parts)
                    now, n, sha, parts, first = r["row"], np.zeros(4, np.int64), hashlib.sha256(), [], True
                n += [r[c] for c in _NUMBERS]
                if r["groups"]:
                    piece = r["groups"] if first else ";" + r["groups"]
                    first = False
                    sha.update(piece.encode())
                    if groups:
                        parts.append(piece)
        if now is not None:
            yield done(names, now, n, sha, parts)

    def done(names: list[str], row: int, n: np.ndarray, sha, parts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (row, *n.tolist(), sha.hexdigest(), *(["".join(parts)] if groups else []))], names=names)

    told = stretches.join(good, "row", "left_semi").select("row", "at", "groups", *_NUMBERS).repartition("row").sortWithinPartitions("row", "at")
    told = told.mapInArrow(gather, ", ".join(["row long", *(f"{c} long" for c in _NUMBERS), *(f"{c} string" for c in ["groups_sha256", *texts])]))
    weighed = attach(pairs, counted, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    far = numbered.join(told, "row", "left").join(weighed, "row", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*_NUMBERS, "n_best", "count_sum"]], *[F.coalesce(c, F.lit("")).alias(c) for c in ["groups_sha256", *texts]])
    result = keep(near.unionByName(far), "aligned")
    forget(short, lists, good, pairs, counts, counted, *old)
    return result
