"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the character n-grams (lengths 1 to GRAM) that both hold,
divided by the root of the product of how many each holds. Landmark documents give a Nyström map: with K the kernel among
landmarks, a text's features are its kernel values to them times K^(-1/2). One-versus-rest ridge regression on
these features scores each language. Texts are scored in batches: presence matrix times landmark matrix, then two small
products.

N-grams are hashed to DIM places; only places that some landmark has take part in products. At most
FIT_PER_LANGUAGE labelled rows of a language (least hash of doc_id and text) and FIT_ROWS in all fit the model, LANDMARKS_PER_LANGUAGE
of each are landmarks. These bounds are parameters; each fitting row reaches the driver as its place list only, and its
label is its own, whatever other rows share its doc_id.

Defined results: `und` with score 0 if a text is null or has no letter, or if nothing was learned (an empty table); with one language
all lettered texts are of it; ties go to the first language by name; repeated rows are scored each and fit as one; a null doc_id
is a value like any other; texts of any length go through in pieces; columns that clash with the two results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, spare

GRAM, DIM = 3, 1 << 15
FIT_PER_LANGUAGE, FIT_ROWS, LANDMARKS_PER_LANGUAGE, LANDMARKS, RIDGE, BATCH = 300, 2_000, 24, 240, 1e-3, 128
UNKNOWN = "und"


def presence(text: str) -> np.ndarray:
    """Places (sorted, distinct) of a text's n-grams."""
    held = np.zeros(DIM, dtype=bool)
    low = text.lower()
    for at in range(0, len(low), 1 << 20):  # long texts in pieces that overlap by an n-gram
        c = np.frombuffer(low[at : at + (1 << 20) + GRAM - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        acc = np.zeros(len(c), dtype=np.uint32)
        for n in range(1, GRAM + 1):
            if len(c) < n:
                break
            acc = acc[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(1)
            held[((acc ^ np.uint32(n * 0x5BD1)) * np.uint32(2654435761)) >> np.uint32(17)] = True
    return np.flatnonzero(held)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = FIT_PER_LANGUAGE, rows: int = FIT_ROWS) -> dict:
    """A model from the rows of `docs` that have a language and a letter. Filter `docs` first to hold rows out."""
    prepare(docs.sparkSession)
    raw = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    # a row's own hash below this share of its range leaves about twice the rows wanted of each language, so only those meet in
    # one task; at most `rows` languages (the first by name) can be chosen from, so their counts may be broadcast
    sizes = raw.groupBy("lang").agg(F.count("*").alias("n_lang")).orderBy("lang").limit(rows)
    share = F.lit(2.0 * per_language) / F.col("n_lang")
    lettered = raw.join(F.broadcast(sizes), "lang").where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id", "text"))
    # rows that repeat are one, joined inside each task first
    src = lettered.where(F.col("h") / 2.0**64 + 0.5 <= share).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [presence(t).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h.tobytes() for h in held], pa.binary())], names=["lang", "h", "held"])

    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = src.mapInArrow(run, "lang string, h long, held binary").withColumn("n", place).where(F.col("n") <= per_language).orderBy("n", "lang").limit(rows)
    got = sorted((r["n"], r["lang"], bytes(r["held"])) for r in chosen.collect())
    names = sorted({r[1] for r in got})
    if not names:
        return {"names": []}
    held = [np.frombuffer(r[2], np.int32) for r in got]
    seen: dict[str, int] = dict.fromkeys(names, 0)
    marks = []
    for k, r in enumerate(got):
        if seen[r[1]] < LANDMARKS_PER_LANGUAGE and len(marks) < LANDMARKS:
            seen[r[1]] += 1
            marks.append(k)
    places = np.unique(np.concatenate([held[k] for k in marks]))
    slot = np.full(DIM, -1, dtype=np.int32)
    slot[places] = np.arange(len(places))
    land = np.zeros((len(places), len(marks)), dtype=np.float32)
    for j, k in enumerate(marks):
        land[slot[held[k]], j] = 1 / np.sqrt(len(held[k]))
    kernel = (land.T @ land).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    model = {"names": names, "slot": slot, "land": land, "map": root}
    x = np.concatenate([_features(model, held[a : a + BATCH]) for a in range(0, len(held), BATCH)])
    y = np.where(np.array([r[1] for r in got])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([1 / sum(r[1] == n for r in got) for n in names])
    weight = np.array([share[names.index(r[1])] for r in got])[:, None]  # languages count alike
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    model["map"] = root
    model["weights"] = np.linalg.solve((x1 * weight).T @ x1 + RIDGE * np.eye(x1.shape[1]), (x1 * weight).T @ y)
    return model


def _features(model: dict, held: list[np.ndarray]) -> np.ndarray:
    dense = np.zeros((len(held), model["land"].shape[0]), dtype=np.float32)
    for i, h in enumerate(held):
        s = model["slot"][h]
        dense[i, s[s >= 0]] = 1 / np.sqrt(max(1, len(h)))
    return (dense @ model["land"]).astype(np.float64) @ model["map"]


def predict(docs: DataFrame, model: dict, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs` with the predicted language of `text` and its score (0 to 1); columns of these names are replaced."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    carried = [f for f in docs.schema.fields if f.name.lower() not in (lang.lower(), score.lower())]
    lettered = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    src = docs.select(*[F.col(f"`{f.name}`") for f in carried], F.when(lettered, F.col(f"`{text}`")).alias(spare(docs.columns, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None] if model["names"] else []
            for a in range(0, len(known), BATCH):
                part = known[a : a + BATCH]
                x = _features(model, [presence(texts[i]) for i in part])
                margin = x @ model["weights"][:-1] + model["weights"][-1]
                e = np.exp(3 * (margin - margin.max(axis=1, keepdims=True)))
                share = e / e.sum(axis=1, keepdims=True)
                for i, k, s in zip(part, margin.argmax(axis=1).tolist(), share.max(axis=1).tolist(), strict=True):
                    names[i], scores[i] = model["names"][k], s
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in carried), lang, score])

    return src.mapInArrow(run, T.StructType([*carried, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))
