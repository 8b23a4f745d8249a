"""Packing documents into sequences of one length: concatenate and cut.

All documents' tokens form one line, cut every `length` tokens; so only the last sequence isn't full. The line's order
is that of the tasks that tokenise, and of the rows within each. Two passes. The first tokenises: each row gets the tokens
before it in its task's rows (a running sum), and is written with its ids. The totals of the tasks, summed in task order on the driver
(one number for each task), give every task its global offset. The second pass adds offset and running sum, which is a
row's global place whatever the order it is read in, and cuts it at the multiples of `length`: one record for a document inside one
window, one more for each window boundary that falls inside it (`cut_before`, `cut_after` tell). No shuffle.

Ids. A document is its text's ids and then `end_id`. The tokenizer drops white space between words and no pre-token spans it,
so a text is split at white space and each worker remembers the ids of short words (at most WORDS of them); texts go through
in slices of SLICE characters. Strings of special tokens inside texts are ordinary text.

Defined results: null and empty texts are `end_id` alone; a null doc_id is carried; rows that repeat a doc_id or a whole row
are packed each, and each counts its own `start` from 0; a text of any length spans as many sequences as it needs; no rows give no rows;
other columns are not read. Sequence numbers are gapless; which document lies where depends on how the input is split.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import SIGNS, keep, prepare

LENGTH, END_ID, PAD_ID = 4096, 2, 0
#: Words that a worker remembers, their greatest length in characters, and characters of text that are split at once.
WORDS, WORD_CHARS, SLICE = 600_000, 48, 1 << 19
#: Fixed value: the pattern of pre-tokens, as the tokenizer's file has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]")
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")
#: White space of str.split() that isn't ASCII white space, and all beyond Latin-1.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u0100-\U0010ffff]")
#: Words whose lower case and pre-tokens are plain: ASCII signs and Latin-1 letters.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class WordCoder(dict):
    """Ids of texts under a tokenizer that drops white space; as a table, the ids of words, as little-endian bytes.

    A word of ASCII signs and Latin-1 letters is lower-cased and cut into pre-tokens here, by the tokenizer's own pattern, and
    these go to its merges alone, remembered like words; others go through the whole tokenizer."""

    def __init__(self, spec: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.merges = self.tokenizer.model
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.packed = [k.to_bytes(self.dtype.itemsize, "little") for k in range(size)]
        steps = [n["type"] for n in json.loads(spec)["normalizer"]["normalizers"]], json.loads(spec)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.plain = steps == (["NFC", "Replace", "Lowercase"], PATTERN)

    def made(self, word: str) -> bytes:
        if self.plain and _PLAIN.fullmatch(word):
            low = word.lower()
            parts = _PARTS.findall(low)
            if len(parts) > 1 or low != word:
                return b"".join([self[p] for p in parts])
            sign = low if low.isascii() else low.encode().decode("latin-1").translate(SIGNS)
            return b"".join([self.packed[t.id] for t in self.merges.tokenize(sign)])
        return b"".join([self.packed[k] for k in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def __missing__(self, word: str) -> bytes:
        ids = self.made(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids

    @staticmethod
    def words(text: str) -> Iterator[list[str]]:
        """The words of a text, slice by slice; a slice ends at white space."""
        at = 0
        while at < len(text):
            end = at + SLICE
            stop = _SPACE.search(text, end) if end < len(text) else None
            part = text[at : stop.start()] if stop else text[at:]
            at += len(part)
            # str.split() also splits at some characters that the tokenizer keeps, and lower() knows neighbours beyond Latin-1
            yield _WORD.findall(part) if _ODD.search(part) else part.lower().split()
            if stop:
                at += 1

    def encode(self, text: str | None) -> bytes:
        return b"".join([b"".join(map(self.__getitem__, w)) for w in self.words(text or "")])


_coders: dict[int, WordCoder] = {}


def _coder(spec: str) -> WordCoder:
    """The worker's coder, kept for its next tasks."""
    key = hash(spec)
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordCoder(spec)
    return _coders[key]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.dtype]:
    """First pass, written to the shared folder: doc_id, ids (bytes of the dtype returned), n_ids, part, before."""
    spark = prepare(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    dtype = WordCoder(spec.value).dtype
    if not 0 <= end_id <= np.iinfo(dtype).max:
        raise ValueError("end_id is not an id of the tokenizer")
    kind = docs.schema[doc_id].dataType
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.spark_partition_id().alias("part"))
    last = np.array([end_id], dtype=dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before = _coder(spec.value), 0
        for batch in batches:
            ids = [coder.encode(t.as_py()) + last for t in batch.column(1)]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // dtype.itemsize
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(n), batch.column(2), pa.array(ends - n)], names=["doc_id", "ids", "n_ids", "part", "before"])
            before = int(ends[-1]) if len(ends) else before

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType()), T.StructField("n_ids", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])
    return keep(src.mapInArrow(run, schema), "ids"), dtype


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, digests: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of `length` tokens: doc_id, start (its document's ids before it), length, ids (or
    with `digests` ids_crc32, of little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset, cut_before, cut_after."""
    if length < 1:
        raise ValueError("length must be positive")
    rows, dtype = tokenised(docs, tokenizer, end_id, doc_id, text)
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts = accumulate([n for _, n in totals], initial=0)
    offset = rows.sparkSession.sparkContext.broadcast(dict(zip((p for p, _ in totals), starts, strict=False)))
    kind = rows.schema["doc_id"].dataType
    made = T.StructField("ids_crc32", T.LongType()) if digests else T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length")], [T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([T.StructField("doc_id", kind), *longs[0], made, *longs[1], T.StructField("cut_before", T.BooleanType()), T.StructField("cut_after", T.BooleanType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, part, before = (batch.column(c).to_numpy() for c in (2, 3, 4))
            first = np.fromiter((offset.value[p] for p in part.tolist()), np.int64, len(part)) + before
            pieces = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            window = (first // length)[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(window * length, first[row])
            size = np.minimum((window + 1) * length, (first + n)[row]) - begin
            start, doc = begin - first[row], n[row]
            held = [np.frombuffer(b.as_py(), dtype).astype("<u4") for b in batch.column(1)]
            own = [held[r][a : a + k] for r, a, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            if digests:
                ids = pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())
            else:
                flat = np.concatenate(own).astype(np.int32) if own else np.empty(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat)).cast(arrow.field(3).type)
            columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(size), ids, pa.array(doc), pa.array(window), pa.array(begin - window * length), pa.array(start > 0), pa.array(start + size < doc)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.select("doc_id", "ids", "n_ids", "part", "before").mapInArrow(cut, schema)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = PAD_ID) -> DataFrame:
    """sequence_id, ids and n_ids of packed sequences, from pieces with ids. A sequence is padded to `length`, unless what it
    holds is a power of two long. A sequence has at most `length` pieces, so its group is bounded."""
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined: Column = F.flatten(F.transform(in_order, lambda p: p["ids"]))
    out = pieces.groupBy("sequence_id").agg(joined.alias("ids")).withColumn("n_ids", F.size("ids"))
    whole = F.bit_count(F.col("n_ids").cast("long")) == 1
    return out.select("sequence_id", F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(length) - F.col("n_ids")))).alias("ids"), "n_ids")
