"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts and benchmark items are word sequences (lower case, ASCII punctuation dropped). A document holds an item if
some stretch of it lies within (1 - similarity) * n word edits of the item's n words.

Windows as long as an item start where a document shares a gram of words with it. By pigeonhole k edits leave one of
k + 1 pieces of an item whole, so with gram length floor(n / (k + 1)) no stretch in reach is missed. The CGK walk
embeds window and item so that edit distance becomes Hamming distance: at step j it writes the word under its pointer
and moves on if a random bit of (j, word) says so. Every repetition of the walk is sampled at SAMPLED places of its first
REACH * n by each of TABLES tables (a walk ends after about 2n, and a place past its end makes no key); a window and an item that
agree on a table's places are a candidate pair. Candidates are verified by the exact edit distance of the item to the
best stretch around the window. Recall of the step: walks of an item and an edited copy at the limit agree on 0.45 of these
places or more on average, so a table joins them with probability 0.09 and all REPETITIONS * TABLES miss with less than 1e-4 if they
were independent; the tests measure at least 0.98 against brute force over substitutions, insertions and deletions at random,
at the front and at the end, and fewer than 0.15 of unrelated windows become candidates.

The scan is one pass over the documents without a shuffle; drop_contaminated() drops rows in that pass, so no ids are joined
back. Items are broadcast in blocks of at most BLOCK_BYTES of text; find_items() takes a pass for each, drop_contaminated() runs
them one after the other on the same rows in one worker, which holds one block's index at a time.

Defined results: no documents or no items give no rows found and drop none; other columns are not read, and are carried by
drop_contaminated() under whatever names; a text of any length is one word list in the worker; null and empty texts hold nothing; null and wordless items are held by nothing; equal items are
reported each, with a null item_id too; repeated documents are reported each; a row is judged by its own text, whatever its
doc_id (null or repeated).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import prepare

SIMILARITY, REPETITIONS, TABLES, SAMPLED, REACH, SEED = 0.8, 8, 16, 3, 1.2, 7
BLOCK_BYTES = 16 << 20
#: Bytes of rows that wait in a worker while blocks of items are taken one after the other.
HELD_BYTES = 128 << 20
#: Windows embedded together.
WINDOWS = 4096
SPACED = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(SPACED).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


def edits(n: int, similarity: float) -> int:
    return int(np.floor((1 - similarity) * n + 1e-9))


def embed(windows: np.ndarray, rep: int, columns: int) -> np.ndarray:
    """First columns of the CGK embedding of rows of n word ids, by the walk of repetition `rep`; -1 where a walk has ended."""
    count, n = windows.shape
    padded = np.concatenate([windows, np.full((count, 1), -1, windows.dtype)], axis=1)
    at, rows = np.zeros(count, np.int64), np.arange(count)
    out = np.empty((count, columns), dtype=np.int64)
    for j in range(columns):
        out[:, j] = here = padded[rows, at]
        bit = _mix(here.astype(np.uint64) * _M1 + np.uint64(((rep * 1_000_003 + j) * 2 + 1) * int(_M2) % 2**64)) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), n)
    return out


def lsh_keys(windows: np.ndarray) -> np.ndarray:
    """One key for each repetition and table (columns) of each window (rows); 0 where a walk has ended."""
    n = windows.shape[1]
    columns, sampled = int(np.ceil(REACH * n)), min(SAMPLED, max(1, n // 2))
    keys = []
    for rep in range(REPETITIONS):
        walk = embed(windows, rep, columns)
        rng = np.random.default_rng([SEED, n, rep])
        for t in range(TABLES):
            key = np.full(len(windows), rep * TABLES + t + 1, dtype=np.uint64)
            ended = np.zeros(len(windows), dtype=bool)
            for place in rng.choice(columns, sampled, replace=False):
                key = _mix((key ^ walk[:, place].astype(np.uint64)) * _M1)
                ended |= walk[:, place] < 0
            keys.append(np.where(ended, np.uint64(0), key))
    return np.stack(keys, axis=1)


def best_stretch(item: np.ndarray, around: np.ndarray) -> tuple[int, int]:
    """(edits, end) of the stretch of `around` nearest to the item; the first end on ties."""
    cost = np.zeros(len(around) + 1, dtype=np.int64)  # a stretch may start anywhere
    ramp = np.arange(len(around) + 1)
    for k, word in enumerate(item):
        new = np.empty_like(cost)
        new[0] = k + 1
        new[1:] = np.minimum(cost[:-1] + (around != word), cost[1:] + 1)
        cost = np.minimum.accumulate(new - ramp) + ramp
    return int(cost.min()), int(cost.argmin())


class Index:
    """Items of a block: vocabulary, grams and LSH buckets."""

    def __init__(self, items: list[tuple], similarity: float):
        self.vocab: dict[bytes, int] = {}
        self.items, self.ids = [], []
        for item_id, text in items:
            if words := words_of(text):
                self.items.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.int64))
                self.ids.append(item_id)
        self.reach = [edits(len(x), similarity) for x in self.items]
        grams: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        by_length = defaultdict(list)
        for k, x in enumerate(self.items):
            q = len(x) // (self.reach[k] + 1)
            q = min(q, 4)
            for o, g in enumerate(self.grams(x, q)):
                grams[q][int(g)].append((k, o))
            by_length[len(x)].append(k)
        self.at = {q: dict(g) for q, g in grams.items()}
        self.known = {q: np.array(sorted(g), dtype=np.uint64) for q, g in grams.items()}
        self.buckets = {}
        for n, ks in by_length.items():
            bucket = defaultdict(set)
            for k, row in zip(ks, lsh_keys(np.stack([self.items[k] for k in ks])), strict=True):
                for key in row[row > 0].tolist():
                    bucket[key].add(k)
            self.buckets[n] = dict(bucket)

    @staticmethod
    def grams(ids: np.ndarray, q: int) -> np.ndarray:
        n = len(ids) - q + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        acc = np.zeros(n, np.uint64)
        for k in range(q):
            acc = _mix((acc ^ ids[k : k + n].astype(np.uint64)) * _M1)
        return acc

    def starts(self, ids: np.ndarray) -> dict[int, set[int]]:
        """By item length: where windows of a document start."""
        windows = defaultdict(set)
        for q, known in self.known.items():
            if len(ids) < q:
                continue
            whole = np.ones(len(ids) - q + 1, dtype=bool)
            for k in range(q):
                whole &= ids[k : k + len(whole)] > 0
            places = np.flatnonzero(whole)
            if not len(places):
                continue
            acc = np.zeros(len(places), np.uint64)
            for k in range(q):
                acc = _mix((acc ^ ids[places + k].astype(np.uint64)) * _M1)
            hit = known[np.minimum(np.searchsorted(known, acc), len(known) - 1)] == acc
            for p, g in zip(places[hit].tolist(), acc[hit].tolist(), strict=True):
                for k, o in self.at[q][g]:
                    windows[len(self.items[k])].add(p - o)
        return windows

    def find(self, docs: list[np.ndarray]) -> list[dict[int, tuple[int, int, int]]]:
        """For each document, by item held: (edits, first word, last word + 1) of its best stretch, the first on ties.

        Windows of all documents are embedded together, WINDOWS of them at a time."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in docs]
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for d, ids in enumerate(docs):
            for n, starts in self.starts(ids).items():
                by_length[n] += [(d, x) for x in sorted(starts)]
        for n, places in by_length.items():
            bucket = self.buckets[n]
            known = np.fromiter(bucket, np.uint64, len(bucket))
            for at in range(0, len(places), WINDOWS):
                part = places[at : at + WINDOWS]
                rows = np.zeros((len(part), n), dtype=np.int64)
                for i, (d, x) in enumerate(part):
                    lo, hi = max(0, x), min(len(docs[d]), x + n)
                    rows[i, lo - x : hi - x] = docs[d][lo:hi]
                keys = lsh_keys(rows)
                for i in np.flatnonzero(np.isin(keys, known).any(axis=1)).tolist():
                    d, start = part[i]
                    for k in set().union(*(bucket[x] for x in keys[i].tolist() if x in bucket)):
                        self.verify(k, docs[d], start, n, found[d])
        return found

    def verify(self, k: int, ids: np.ndarray, start: int, n: int, found: dict[int, tuple[int, int, int]]) -> None:
        """Exact edit distance of item k to the best stretch around a window."""
        reach = self.reach[k]
        lo, hi = max(0, start - reach), min(len(ids), start + n + reach)
        cost, end = best_stretch(self.items[k], ids[lo:hi])
        if cost <= reach:
            _, from_end = best_stretch(self.items[k][::-1], ids[lo : lo + end][::-1])
            hit = (cost, lo + end - from_end, lo + end)
            found[k] = min(found.get(k, hit), hit)


_indexes: dict[str, Index] = {}


def _index(shared, similarity: float) -> Index:
    """The worker's index of a block."""
    key = shared[0]
    if key not in _indexes:
        _indexes.clear()
        rows = shared[1].value
        _indexes[key] = Index(rows, similarity)
        shared[1].__dict__.pop("_value", None)  # the index stands for the rows; one block is held at a time
    return _indexes[key]


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator:
    """The items, broadcast in blocks of BLOCK_BYTES or less."""
    item = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    total = item.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = int(total // BLOCK_BYTES * 2 + 1)  # by hash: twice as many as would do, so that none is much over
    for b in range(blocks):
        rows = [tuple(r) for r in item.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        yield uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(rows)


def _numbers(index: Index, texts: list[str | None]) -> list[np.ndarray]:
    return [np.fromiter(map(index.vocab.get, words, repeat(0)), dtype=np.int64, count=len(words)) for words in map(words_of, texts)]


def find_items(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, first_word, end_word for every item that a document holds (its best stretch)."""
    prepare(docs.sparkSession)
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    arrow = to_arrow_type(items.schema[item_id].dataType)
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = None
    for shared in _blocks(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared, similarity)
            for batch in batches:
                made: list[list] = [[], [], [], []]
                taken = []
                for i, held in enumerate(index.find(_numbers(index, batch.column(1).to_pylist()))):
                    for k, (cost, first, end) in sorted(held.items()):
                        taken.append(i)
                        for column, value in zip(made, (index.ids[k], cost, first, end), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken, pa.int64())), pa.array(made[0], arrow), *(pa.array(c, pa.int32()) for c in made[1:])], names=["doc_id", "item_id", "edits", "first_word", "end_word"])

        part = src.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, first_word int, end_word int")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` whose text holds no item. One worker a task takes HELD_BYTES of rows at a time through the blocks."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text)
    blocks = list(_blocks(items, item_id, item_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, HELD_BYTES if len(blocks) > 1 else 0):
            for shared in blocks:
                index = _index(shared, similarity)
                group = [batch.filter(pa.array([not x for x in index.find(_numbers(index, batch.column(at).to_pylist()))], pa.bool_())) for batch in group]
            yield from group

    return docs.mapInArrow(run, docs.schema)


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Neighbouring batches, together of `most` bytes or little more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield held
            held = []
    if held:
        yield held
