"""Near-duplicate documents by b-bit MinHash.

Words are runs of anything but ASCII white space after lower-casing A-Z; a document's set holds its distinct
shingles of consecutive words. Each task computes 128 minima per document, hashes four of them at a time to
32 band keys and keeps two low bits of each minimum, packed into four longs. Documents with equal shingle sets
are joined first, so copies cost one row each from there on. Documents that share a band key are candidates:

1. Per bucket, every member meets the bucket's centre, which is its member with the most company over all bands
   (in a family of copies that is one with few edits). A bucket of n gives at most n pairs, and a family's
   buckets mostly share their centre. The members that this leaves outside the bucket's largest component meet a
   centre of their own in the same way, once more.
2. The packed signatures estimate each pair's similarity from equal bit groups, corrected for chance
   collisions; pairs clearly below the threshold go. The rest is confirmed on the full sets.
3. Links give components. Documents of buckets whose members still lie in several components get a longer
   signature (4096 minima, one bit each), which tells 0.8 from 0.76. Such a bucket then meets in full, across
   components only, with both estimates inside the join's condition: what comes out is nearly the links that are
   missing, not the bucket's pairs. These are confirmed on the full sets too; nothing is dropped.

With similarity 0.8 a pair shares no band with probability (1 - 0.8^4)^32 < 5e-8.

Hot keys. A bucket, a set, a hub of pairs or a component that holds over a thousandth of the rows of a join is dealt by a salt
(common.attach). A bucket of n that is left for step 3 is a grid of cells, CELL rows by CELL rows each: its work is
n (n - m) comparisons of packed signatures, m being its largest component, spread over (n / CELL)^2 tasks at will.

Defined results: null, empty and blank texts have no set and link with nothing; fewer words than a shingle
give one shingle of all words; equal sets link. Rows are told apart by doc_id and text: a doc_id on two texts has
the component of each; a null doc_id comes last, and a component of such rows only has a null component_id and is kept.
Rows that repeat a doc_id and its text count once and share a verdict; drop_near_copies() leaves one row of a component. No rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, forget, hot_keys, keep, prepare, spare
from .components import components

MINIMA, BAND_ROWS, BITS, SEED = 128, 4, 2, 20240229
BANDS = MINIMA // BAND_ROWS
#: Minima of the longer signature, one bit each.
LONG = 4096
#: Standard deviations of the estimate by which a pair may fall short and still be confirmed on the sets.
SLACK = 4.5
#: Rows on a side of one cell of a large bucket.
CELL = 2_000
#: Word hashes that a worker remembers.
CACHE_WORDS = 400_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_rng = np.random.default_rng(SEED)


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n hash functions h(x) = a * x + b mod 2^32."""
    return _rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), _rng.integers(0, 2**32, n, dtype=np.uint32)


_SHORT, _LONG = _family(MINIMA), _family(LONG)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    # a position-dependent sum, mixed: word order within the shingle counts
    acc = np.full(n, len(h) if len(h) < width else 0, dtype=np.uint64)
    for k in range(min(width, len(h))):
        acc = (acc ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def minima(hashes: np.ndarray, family: tuple[np.ndarray, np.ndarray] = _SHORT) -> np.ndarray:
    """The minima (32 bits each, mixed so that all their bits count) of a nonempty set under the family's functions."""
    a, b = family
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    size = max(16, 65536 // len(a))
    for at in range(0, len(x), size):
        mixed = x[at : at + size, None] * a[None, :]
        mixed += b[None, :]
        np.minimum(low, mixed.min(axis=0), out=low)
    low *= np.uint32(0x9E3779B1)
    low ^= low >> np.uint32(15)
    low *= np.uint32(0x85EBCA77)
    return low ^ (low >> np.uint32(13))


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = low.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(BAND_ROWS):
        acc = (acc ^ keys[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(32)
    return acc.view(np.int64)


def pack(low: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum, 32 minima to a long."""
    bits = (low & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
    return np.bitwise_or.reduce(bits << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1).view(np.int64)


def sketches(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, whole (digest of the set), s0-s3 (signature), keys (band keys) of each document."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, whole, sig, keys = [], [], [], []
            for t in batch.column(2).to_pylist():
                h = shingle_hashes(t, width)
                n.append(len(h))
                if len(h):
                    low = minima(h)
                    whole.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sig.append(pack(low))
                    keys.append(band_keys(low))
                else:
                    whole.append(None)
                    sig.append(np.zeros(4, np.int64))
                    keys.append(np.empty(0, np.int64))
            s = np.array(sig).reshape(-1, 4)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), *(pa.array(s[:, k]) for k in range(4)), lists], names=["doc_id", "text_hash", "n_shingles", "whole", "s0", "s1", "s2", "s3", "keys"])

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, whole binary, s0 long, s1 long, s2 long, s3 long, keys array<long>")


def long_signatures(sets: DataFrame) -> DataFrame:
    """whole and the longer signature, as `long` (array of longs), of shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((batch.num_rows, LONG // 64), dtype=np.int64)
            for i, x in enumerate(batch.column(1)):
                if len(h := np.frombuffer(x.as_buffer(), np.uint64)):
                    bits[i] = np.packbits((minima(h, _LONG) & np.uint32(1)).astype(np.uint8)).view(np.int64)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (LONG // 64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(bits.ravel()))], names=["whole", "long"])

    return sets.select("whole", "set").mapInArrow(run, "whole binary, long array<long>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """whole, set (binary: sorted 64-bit hashes) of rows (whole, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["whole", "set"])

    return texts.mapInArrow(run, "whole binary, set binary")


def matching_groups(a: str, b: str) -> Column:
    """How many of the 128 bit groups of two packed signatures are equal."""
    def differing(k: int) -> Column:
        x = F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return F.lit(MINIMA) - reduce(lambda x, y: x + y, [differing(k) for k in range(4)])


def least_matching(threshold: float) -> int:
    """Equal bit groups below which a pair is taken to lie under the threshold.

    Groups agree with probability C + (1 - C) J with C = 2^-BITS, so J is estimated as (m / 128 - C) / (1 - C)."""
    c = 2.0**-BITS
    p = c + (1 - c) * threshold
    return int(np.floor(MINIMA * p - SLACK * np.sqrt(MINIMA * p * (1 - p))))


def differing_bits(a: str, b: str) -> Column:
    each = F.zip_with(f"{a}.long", f"{b}.long", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(each, F.lit(0), lambda n, x: n + x)


def most_differing(threshold: float) -> int:
    """Differing bits of the longer signatures above which a pair lies under the threshold: bits agree with probability (1 + J) / 2."""
    p = (1 - threshold) / 2
    return int(np.ceil(LONG * p + SLACK * np.sqrt(LONG * p * (1 - p))))


def confirm(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b: a kept table) whose sets have intersection / union of at least `threshold`."""
    percent = round(100 * threshold)
    left = attach(pairs, sets.select(F.col("whole").alias("a"), F.col("set").alias("set_a")), "a")
    right = sets.select(F.col("whole").alias("b"), F.col("set").alias("set_b"))
    both = attach(left, right, "b", heavy=hot_keys(pairs, "b"), counted=True).select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    ok.append(False)
                    continue
                s = np.concatenate([p, q])
                s.sort(kind="stable")
                both = int((s[1:] == s[:-1]).sum())
                ok.append(100 * both >= percent * (len(s) - both))
            keep_ = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep_), batch.column(1).filter(keep_)], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def _labelled(docs: DataFrame, threshold: float, width: int, doc_id: str, text: str) -> DataFrame:
    """Each row's doc_id, text_hash, n_shingles and `lead`: (doc_id is null, doc_id, text_hash) of its component's first."""
    prepare(docs.sparkSession)
    all_docs = keep(sketches(docs, width, doc_id, text), "sketches")
    worded = all_docs.where("whole is not null")
    # a node is a set: rows with equal sets are one from here on, joined inside each task first
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep")
    nodes = keep(worded.groupBy("whole").agg(rep, *[F.first(c).alias(c) for c in ("n_shingles", "s0", "s1", "s2", "s3", "keys")]), "nodes")
    rows = nodes.select(F.explode("keys").alias("key"), "whole")
    # buckets of two or more
    sizes = keep(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    heavy = hot_keys(rows, "key", sizes, BANDS * nodes.count())
    shared = keep(attach(rows, sizes, "key", heavy=heavy, counted=True), "shared")
    company = shared.groupBy("whole").agg(F.sum("n").alias("company"))
    members = keep(shared.select("key", "whole").join(company, "whole"), "members")
    forget(shared)
    least = least_matching(threshold)
    sharing = members.select("whole").distinct()
    signed = keep(nodes.join(sharing.hint("merge"), "whole", "left_semi").select("whole", "rep", "n_shingles", "s0", "s1", "s2", "s3", "keys"), "signatures")
    percent = round(100 * threshold)

    def side(name: str) -> DataFrame:
        return signed.select(F.col("whole").alias(name), F.struct("n_shingles", "s0", "s1", "s2", "s3").alias("p" if name == "a" else "q"))

    def passing(pairs: DataFrame) -> DataFrame:
        """Pairs whose set sizes and signatures allow the threshold."""
        pairs = keep(pairs, "met")
        x = attach(attach(pairs, side("a"), "a"), side("b"), "b", heavy=hot_keys(pairs, "b"), counted=True)
        fits = F.least("p.n_shingles", "q.n_shingles") * 100 >= F.greatest("p.n_shingles", "q.n_shingles") * percent
        out = keep(x.where(fits & (matching_groups("p", "q") >= least)).select("a", "b"), "pairs")
        forget(pairs)
        return out

    def stars(rows: DataFrame) -> DataFrame:
        """Every row of a bucket with the one of most company, the first set on ties."""
        heads = rows.groupBy("key").agg(F.min(F.struct((-F.col("company")).alias("o"), F.col("whole").alias("d"))).getField("d").alias("head"))
        met = attach(rows.select("key", "whole"), heads, "key", heavy=heavy, counted=True).where("whole <> head")
        return met.select(F.least("whole", "head").alias("a"), F.greatest("whole", "head").alias("b")).distinct()

    # The texts of one row for each set that shares a bucket are read and cut into shingles once more, for all that
    # follows. How many these are has no bound, so they are not broadcast. Rows that repeat a doc_id and its text are
    # joined inside each task before.
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    if repeated(all_docs):
        source = source.dropDuplicates(["doc_id", "text_hash"])
    wanted = signed.select("whole", F.col("rep.doc_id").alias("__d"), F.col("rep.text_hash").alias("__h")).hint("merge")
    first = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h"))).select("whole", "text")
    sets = keep(shingle_sets(first, width), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        return keep(confirm(pairs, sets, threshold), "links")

    def by_component(links: DataFrame) -> DataFrame:
        """Rows of buckets with several components: key, whole, company, component, the bucket's largest component as main, its rows as n."""
        reached = components(links, "a", "b")
        labelled = keep(members.join(reached.select(F.col("node").alias("whole"), "component"), "whole", "left").withColumn("component", F.coalesce("component", "whole")), "labelled")
        forget(reached)
        each = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
        mixed = each.groupBy("key").agg(F.max(F.struct("n", "component")).getField("component").alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1").drop("parts")
        return attach(labelled, mixed, "key", heavy=heavy, counted=True)

    met = passing(stars(members))
    links = linked(met)
    again = passing(stars(by_component(links).where("component <> main").select("key", "whole", "company")).join(met, ["a", "b"], "left_anti"))
    links = links.union(linked(again))
    met = met.union(again)
    # what is left: buckets that hold several components, across these only
    open_rows = keep(by_component(links).drop("company"), "open")
    longer = keep(long_signatures(sets.join(open_rows.select("whole").distinct(), "whole", "left_semi")).join(signed.drop("rep"), "whole"), "longer")
    # a large bucket is a grid of cells, each of about CELL rows by CELL rows
    cells = F.ceil(F.col("n") / CELL).cast("int")
    block, every = F.pmod(F.xxhash64("whole"), F.col("cells")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    rows = open_rows.withColumn("cells", cells).withColumn("block", block).join(longer, "whole")
    # one side without the bucket's largest component: two of its members never need to meet
    p = rows.where("component <> main").withColumn("i", F.col("block")).withColumn("j", every).alias("p")
    q = rows.withColumn("j", F.col("block")).withColumn("i", every).alias("q")
    fits = F.least("p.n_shingles", "q.n_shingles") * 100 >= F.greatest("p.n_shingles", "q.n_shingles") * percent
    near_by_bands = matching_groups("p", "q") >= least
    near = differing_bits("p", "q") <= most_differing(threshold)
    once = F.element_at(F.array_intersect("p.keys", "q.keys"), 1) == F.col("p.key")  # of the buckets that both are in, one
    across = F.when((F.col("p.component") != F.col("q.component")) & fits & near_by_bands, once & near).otherwise(False)
    cell = (F.col("p.key") == F.col("q.key")) & (F.col("p.i") == F.col("q.i")) & (F.col("p.j") == F.col("q.j"))
    rest = p.join(q, cell & across).select(F.least("p.whole", "q.whole").alias("a"), F.greatest("p.whole", "q.whole").alias("b")).distinct()
    rest = keep(rest.join(met, ["a", "b"], "left_anti"), "rest")
    links = links.union(linked(rest))
    final = components(links, "a", "b")
    forget(open_rows, longer, sets, members, rest, sizes, signed)
    # the first row of each component, by doc_id, then text_hash
    labels = keep(final.join(nodes.select(F.col("whole").alias("node"), "rep"), "node"), "labels")
    leads = labels.groupBy("component").agg(F.min("rep").alias("lead"))
    found = attach(labels.select("node", "component"), leads, "component").select(F.col("node").alias("whole"), "lead")
    of_set = keep(nodes.select("whole", "rep").join(found, "whole", "left").select("whole", F.coalesce("lead", "rep").alias("lead")), "leads")
    forget(final, labels, nodes)
    out = attach(worded.select("doc_id", "text_hash", "n_shingles", "whole"), of_set, "whole", heavy=hot_keys(worded, "whole"), counted=True).drop("whole")
    alone = all_docs.where("whole is null").select("doc_id", "text_hash", "n_shingles", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("lead"))
    return out.unionByName(alone)


def repeated(rows: DataFrame) -> bool:
    """Whether some doc_id and text occur twice."""
    return bool(rows.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count())


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept (it is its component's first)."""
    component = F.col("lead.doc_id")
    out = _labelled(docs, threshold, width, doc_id, text)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"))


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each component: its first by doc_id (null last), then by the text's hash; of repeated rows any one."""
    found = keep(_labelled(docs, threshold, width, doc_id, text), "near")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    h, lost, of = (spare(docs.columns, c) for c in ("__hash", "__gone", "__of"))
    gone = found.where(~own.eqNullSafe(F.col("lead"))).select(F.col("doc_id").alias(lost), F.col("text_hash").alias(of)).distinct()
    out = docs.withColumn(h, F.xxhash64(F.col(f"`{text}`")))
    if repeated(found):
        out = out.dropDuplicates([doc_id, h])
    return out.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(lost)) & (F.col(h) == F.col(of)), "left_anti").drop(h)
