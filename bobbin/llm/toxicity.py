"""Toxicity by a weighted lexicon under Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts, full-width forms and digit or sign
substitutions become the Latin letters they stand for (i, l, 1, ! and | are one letter). A lexicon entry is a word or
a word's beginning, with the log odds of toxic against clean documents that hold it as its weight. Entries are
found by one Aho-Corasick pass; an entry inside an exception phrase (a word pair that the labelled clean documents
use and the toxic ones don't, or one that the caller names) doesn't count. Weights are summed and
normalised by length, and a logistic curve over the sum and the density makes the score.

Fitting. At most FIT_ROWS labelled ids of each class (the least by hash) are read, and of their different texts at most FIT_ROWS of each
class again, whatever number of rows share an id; that bound is a parameter. Entries are counted in Spark; all that reach SUPPORT and MIN_ODDS form the lexicon (each occurs in SUPPORT of the
FIT_ROWS toxic documents, so their number is bounded by what these hold), and the curve is fitted on three numbers of
each sampled document. Scoring is a pass without a shuffle.

Defined results: null and empty texts score as texts without matches; without both classes among the labels
every score is the share of toxic labels (0 if none, as for empty tables); repeated rows are scored each and fit as one, a
doc_id on two texts lends its label to both, one with both labels to none; ties of weights at a word count once; texts of
any length are one string in the worker; a column of the score's name is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, keep, prepare, spare

FIT_ROWS, STEMS = 6_000, (4, 5, 6, 7)
#: Least toxic documents that hold an entry, and least log odds.
SUPPORT, MIN_ODDS = 6, 2.5
#: Look-alikes in other scripts, then substitutions.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i", "€": "e", "+": "t"}
_FOLD = str.maketrans(LOOKALIKES | SUBSTITUTES)
_WIDE = re.compile("[℀-⅏＀-￯​-‏­\U0001d400-\U0001d7ff]")
_INSIDE = re.compile(r"(?<![^\W_])[!|+$@€]+|[!|+$@€]+(?![^\W_])")
_GAPS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words, each between single spaces."""
    t = text or ""
    if _WIDE.search(t):
        t = re.sub("[​-‏­]", "", unicodedata.normalize("NFKC", t))
    # signs stand for letters only inside a word
    return f" {_GAPS.sub(' ', _INSIDE.sub(' ', t.lower()).translate(_FOLD)).strip()} "


def entries_of(words: set[str]) -> set[str]:
    """Possible lexicon entries: " word " and " beginning"."""
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


class Matcher:
    def __init__(self, model: dict):
        self.model, self.auto = model, ahocorasick.Automaton()
        for k, w in model["lexicon"].items():
            self.auto.add_word(k, (k, w))
        if model["lexicon"]:
            self.auto.make_automaton()
        self.except_ = set(model["exceptions"])

    def weigh(self, text: str | None) -> tuple[float, int]:
        """(sum of weights, words) of a text; at each word its heaviest entry counts."""
        t = fold(text)
        words = t.count(" ") - 1 if t.strip() else 0
        best: dict[int, float] = {}
        if self.model["lexicon"]:
            for end, (k, w) in self.auto.iter(t):
                start = end - len(k) + 1
                if self.except_ and self.excepted(t, start):
                    continue
                best[start] = max(best.get(start, 0.0), w)
        return sum(best.values()), words

    def excepted(self, t: str, space: int) -> bool:
        stop = t.index(" ", space + 1)
        after = t.find(" ", stop + 1)
        before = t.rfind(" ", 0, space) if space else -1
        return (after > 0 and t[space + 1 : after] in self.except_) or (before >= 0 and t[before + 1 : stop] in self.except_)


def features(total: float, words: int) -> tuple[float, float]:
    return float(np.log1p(total)), total / max(1, words)


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int) -> DataFrame:
    """y, text of at most `rows` different labelled texts of each class, the least by hash, as a written table."""
    # an id's label is the one that all its label rows give; ids with both are left out
    known = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("doc_id", "y", F.xxhash64("doc_id").alias("__h"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    # a hash below this share of its range leaves about twice the rows wanted, so only those meet in one task
    share = {y: min(1.0, 2 * rows / n) for y, n in sizes.items()}
    parts = [known.where((F.col("y") == y) & (F.col("__h") / 2.0**64 + 0.5 <= share.get(y, 1.0))).orderBy("__h", "doc_id").limit(rows) for y in (0, 1)]
    ids = parts[0].union(parts[1]).drop("__h")
    # an id may be on any number of rows: these are bounded too, by the least hashes of doc_id and text
    met = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(ids), "doc_id").select("y", "text", F.xxhash64("doc_id", "text").alias("h"))
    last = {y: met.where(F.col("y") == y).select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0] for y in (0, 1)}
    below = F.when(F.col("y") == 1, F.col("h") <= F.lit(last[1])).otherwise(F.col("h") <= F.lit(last[0]))
    return keep(met.where(below).groupBy("y", "h").agg(F.first("text", ignorenulls=False).alias("text")).select("y", "text"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS, exceptions: tuple[str, ...] = ()) -> dict:
    """A model from the labelled rows given: lexicon, exceptions, curve. Filter `labels` first to hold rows out."""
    spark = prepare(docs.sparkSession)
    src = _sample(docs, labels, doc_id, text, label, fit_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(entries_of(set(fold(t).split())))
                seen[y][""] += 1
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], names=["entry", "clean", "toxic"])

    counts = src.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    whole = counts.where("entry = ''").first()
    clean, toxic = (whole["clean"], whole["toxic"]) if whole else (0, 0)
    if not clean or not toxic:
        forget(src)
        return {"lexicon": {}, "exceptions": [], "curve": None, "base": toxic / max(1, clean + toxic)}
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    top = counts.where((F.col("entry") != "") & (F.col("toxic") >= SUPPORT)).withColumn("w", odds).where(F.col("w") >= MIN_ODDS).select("entry", "w").collect()
    model = {"lexicon": {r["entry"]: float(r["w"]) for r in top}, "exceptions": [fold(x).strip() for x in exceptions], "curve": None, "base": 0.0}
    first = spark.sparkContext.broadcast(model)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(first.value)
        for batch in batches:
            seen: Counter = Counter()
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if first.value["lexicon"]:
                    f, own = fold(t), set()
                    for end, (k, _) in matcher.auto.iter(f):
                        start = end - len(k) + 1
                        stop = f.index(" ", start + 1)
                        if (after := f.find(" ", stop + 1)) > 0:
                            own.add(f[start + 1 : after])
                    seen.update((p, y) for p in own)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([n if not y else 0 for (_, y), n in seen.items()], pa.int64()), pa.array([n if y else 0 for (_, y), n in seen.items()], pa.int64())], names=["pair", "clean", "toxic"])

    learned = src.mapInArrow(pairs, "pair string, clean long, toxic long").groupBy("pair").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where((F.col("clean") >= SUPPORT) & (F.col("toxic") == 0)).select("pair").collect()
    model["exceptions"] += [r["pair"] for r in learned]
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            x = [features(*matcher.weigh(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], names=["y", "a", "b"])

    rows = src.mapInArrow(weigh, "y int, a double, b double").collect()
    y = np.array([r["y"] for r in rows], dtype=float)
    x = np.array([(1.0, r["a"], r["b"]) for r in rows])
    model["curve"] = _logistic(x, y)
    forget(src)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> list[float]:
    """Penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3, *[1.0] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w = w + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the score (0 to 1) of `text`; a column of that name is replaced."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    carried = [f for f in docs.schema.fields if f.name.lower() != out.lower()]
    src = docs.select(*[F.col(f"`{f.name}`") for f in carried], F.col(f"`{text}`").alias(spare(docs.columns, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, curve = Matcher(shared.value), shared.value["curve"]
        for batch in batches:
            got = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                if curve is None:
                    got.append(float(shared.value["base"]))
                else:
                    a, b = features(*matcher.weigh(t))
                    got.append(float(1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * a + curve[2] * b, -30, 30)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], names=[*(f.name for f in carried), out])

    return src.mapInArrow(run, T.StructType([*carried, T.StructField(out, T.DoubleType())]))
