"""Language, toxicity, licences and the pipeline against plain versions; many spans; ids on several rows; benchmarks in blocks."""

import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from bobbin.llm import decontaminate, language, licences, pii, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
GERMAN = "der die das und ist nicht ein eine mit von zu auf für über schön groß straße haus wasser licht nacht morgen".split()


def prose(seed, n, words=WORDS):
    return " ".join(np.random.default_rng(seed).choice(words, n).tolist())


def plain_places(text):
    """Places of n-grams, one at a time."""
    out = set()
    for n in range(1, language.GRAM + 1):
        for k in range(len(text) - n + 1):
            acc = 0
            for c in text.lower()[k : k + n]:
                acc = (acc * 0x01000193 + ord(c) + 1) % 2**32
            out.add((((acc ^ (n * 0x5BD1)) * 2654435761) % 2**32) >> 17)
    return out


def test_language_is_ridge_regression_on_nystroem_features(spark):
    rows = [(k, prose(k, 8) if k % 2 else prose(k, 8, GERMAN), "en" if k % 2 else "de") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    sets = [plain_places(t) for _, t, _ in rows]
    # landmarks: the first of each language by hash
    order = [r.k for r in df.select(F.col("doc_id").alias("k"), "lang", F.xxhash64("doc_id", "text").alias("h")).orderBy("h").collect()]
    marks, seen = [], {"en": 0, "de": 0}
    for place in range(15):
        for lang in ("de", "en"):
            own = [k for k in order if rows[k][2] == lang]
            if place < len(own) and seen[lang] < language.LANDMARKS_PER_LANGUAGE:
                seen[lang] += 1
                marks.append(own[place])
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    own = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(own)
    root = vectors / np.sqrt(values)
    x = np.array([[kernel(s, sets[j]) for j in marks] for s in sets]) @ root
    x1 = np.concatenate([x, np.ones((30, 1))], axis=1)
    y = np.array([[1.0 if r[2] == n else -1.0 for n in ("de", "en")] for r in rows])
    weights = np.linalg.solve(x1.T @ x1 / 15 + language.RIDGE * np.eye(x1.shape[1]), x1.T @ y / 15)
    asked = [prose(99, 6), prose(98, 6, GERMAN), "alpha und omega ist", "zzz qqq"]
    margin = np.array([[kernel(plain_places(t), sets[j]) for j in marks] for t in asked]) @ root @ weights[:-1] + weights[-1]
    share = np.exp(3 * margin) / np.exp(3 * margin).sum(axis=1, keepdims=True)
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for k in range(4):
        assert got[k].lang_pred == ("de", "en")[int(margin[k].argmax())] and abs(got[k].score - share[k].max()) < 1e-3


def test_language_learns_each_row_by_its_own_label(spark):
    rows = [(k % 40, prose(k, 20) if k < 40 else prose(k, 20, GERMAN), "en" if k < 40 else "de") for k in range(80)] + [(None, prose(7, 20, GERMAN), "de"), (5, None, "de"), (6, "123", "fr"), (7, prose(1, 5), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.union(spark.createDataFrame([rows[0]] * 500, df.schema)))
    got = language.predict(df.drop("lang"), model).where("text is not null and text <> '123'").collect()
    assert all(r.lang_pred == ("de" if set(r.text.split()) & set(GERMAN) else "en") for r in got) and model["names"] == ["de", "en"]
    one = language.predict(df.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)), language.fit(df.where("lang = 'en'")))
    assert {r.lang_pred for r in one.where("text is not null and text <> '123'").collect()} == {"en"} and one.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    none = language.fit(df.limit(0))
    assert {(r.lang_pred, r.score) for r in language.predict(df, none).collect()} == {("und", 0.0)} and language.predict(df.limit(0), model).count() == 0


def plain_weigh(model, text):
    words = toxicity.fold(text).split()
    total = 0.0
    for k, w in enumerate(words):
        pairs = {" ".join(words[k : k + 2])} if k + 1 < len(words) else set()
        pairs |= {" ".join(words[k - 1 : k + 1])} if k else set()
        if pairs & set(model["exceptions"]):
            continue
        total += max([v for e, v in model["lexicon"].items() if (e == f" {w} " or not e.endswith(" ") and w.startswith(e[1:]))], default=0.0)
    return total, len(words)


def test_toxicity_weighs_as_a_plain_matcher(spark):
    rng = np.random.default_rng(5)
    bad = ["blockhead", "nitwit", "numbskull", "bird brain"]
    clean = [(k, prose(k, 30) + (" nitwit theory" if k % 3 == 0 else ""), 0) for k in range(60)]
    toxic = [(100 + k, prose(k, 25) + " " + bad[k % 4] + ("s" if k % 5 == 0 else ""), 1) for k in range(60)]
    df = spark.createDataFrame([r[:2] for r in clean + toxic], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in clean + toxic], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    matcher = toxicity.Matcher(model)
    signs = [*bad, "bl0ckhe@d", "nitwitted", "nitwit theory", "a nitwit", "ВLOCKHEAD", "num-bskull", *WORDS[:6], "!", "birdbrain"]
    for _ in range(400):
        t = " ".join(rng.choice(signs, 12))
        got, want = matcher.weigh(t), plain_weigh(model, t)
        assert abs(got[0] - want[0]) < 1e-9 and got[1] == want[1], t
    assert model["lexicon"] and matcher.weigh(None) == (0, 0) == matcher.weigh("")
    # repeated documents and labels change nothing; an id with both labels counts for neither class
    again = toxicity.fit(df.union(df).union(df), labels.union(labels).union(spark.createDataFrame([(9999, 0), (9999, 1)], labels.schema)))
    assert again["lexicon"] == model["lexicon"] and np.allclose(again["curve"], model["curve"])


def test_toxicity_of_one_id_on_two_texts_and_very_long_texts(spark):
    rows = [(k, prose(k, 30), 0) for k in range(40)] + [(100 + k, prose(k, 30) + " blockhead", 1) for k in range(40)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(5, "other text " * 9), (5, None), (None, "blockhead")], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), fit_rows=30)
    asked = spark.createDataFrame([(1, "blockhead " * 200_000, "a"), (1, prose(3, 200_000), "b"), (None, "", "c"), (1, "blockhead", "d"), (1, "blockhead", "d")], "doc_id long, text string, score string")
    got = [r.score for r in toxicity.score(asked, model).collect()]
    assert got[0] >= 0.5 and got[1] < 0.5 and got[2] < 0.5 and got[3] == got[4] >= 0.5


def plain_matches(templates, width, containment, words):
    out = set()
    for name in sorted(templates):
        for t in [templates[name]] if isinstance(templates[name], str) else templates[name]:
            own = licences.words_of(t)
            n, w = len(own), width if len(own) > max(3, width) else 1
            grams = lambda x: [tuple(x[k : k + w]) for k in range(len(x) - w + 1)]  # noqa: B023, E731
            shingles = set(grams(own))
            need = max(1, min(math.ceil(containment * len(shingles) - 1e-9), len(shingles) - w))
            keys = [k for k in (licences.words_of(x) for x in re.findall(r"\[\[(.*?)\]\]", t)) if k]
            for start in range(max(1, len(words) - n)):
                window = words[start : start + n + 1]
                held = [k for k, g in enumerate(grams(window)) if g in shingles]
                got = len({grams(window)[k] for k in held})
                if got >= need and len(set(own) - set(window)) <= max(1, n // 5) and all(any(window[i : i + len(k)] == k for i in range(len(window))) for k in keys):
                    out.add((name, start + held[0], start + held[-1] + w, got / len(shingles), got))
    return out


def test_licence_windows_equal_plain_windows():
    templates = {"A-1": ("this work is [[licensed under a]] [[version 1]] of the terms below", "[[a 1]]"), "B": "permission is [[hereby granted b]] free of charge to any person who obtains this work and its files", "C-2": "all of it [[is c]] and [[is 2]]"}
    index = licences.Index(templates, licences.WIDTH, licences.CONTAINMENT)
    vocab = sorted({w.decode() for v in templates.values() for t in ([v] if isinstance(v, str) else v) for w in licences.words_of(t)})
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(250):
        words = rng.choice([*vocab, "quux", "other"], rng.integers(1, 40)).tolist()
        own = templates[str(rng.choice(list(templates)))]
        own = [w.decode() for w in licences.words_of(own if isinstance(own, str) else own[int(rng.integers(2))])]
        if rng.random() < 0.7:
            own[int(rng.integers(len(own)))] = str(rng.choice([*vocab, "quux"]))
        at = int(rng.integers(len(words)))
        texts.append(words[:at] + own + words[at:])
    hits = 0
    for words in texts:
        raw = [w.encode() for w in words]
        got, want = set(index.matches(raw)), plain_matches(templates, licences.WIDTH, licences.CONTAINMENT, raw)
        assert got == want, (words, got ^ want)
        hits += bool(want)
    assert hits > 50


def plain_spans(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


def test_many_spans_take_time_near_their_number(spark):
    rng = np.random.default_rng(1)
    text = " ".join(f"{rng.choice(WORDS)} u{k}@mail{k % 7}.example.org" for k in range(50_000))
    df = spark.createDataFrame([(1, text, "x"), (2, "a@b.c", "x"), (2, "a@b.c", "x"), (None, "a@b.c é@b.c", "x")], "doc_id long, text string, found string")
    pii.find_pii(df.where("doc_id = 2")).collect()
    began = time.time()
    rows = pii.find_pii(df).collect()
    took = time.time() - began
    whole = next(r for r in rows if r.doc_id == 1)
    assert [(s.start, s.end) for s in whole.found if s.kind == "email"] == plain_spans(text)
    assert [[(s.start, s.end) for s in r.found] for r in rows if r.doc_id != 1] == [[(0, 5)], [(0, 5)], [(0, 5)]]
    assert took < 20, took


def test_contexts_reach_over_neighbouring_matches(spark):
    """Scores are those of the words within reach, wherever stretches of matches are cut."""
    text = "".join(f"{'ssn ' if k % 5 == 0 else 'nr '}{100 + k % 500:03d}-{10 + k % 80}-{1000 + k} {'x' * (k % 50)} " for k in range(300))
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found
    want = []
    for m in re.finditer(pii.PATTERNS["ssn"], text):
        near = text[max(0, m.start() - 40) : m.start()] + " " + text[m.end() : m.end() + 40]
        score = pii.SCORES["ssn"] + (0.3 if re.search(pii.CONTEXT["ssn"], near) else 0) - (0.3 if re.search(pii.AGAINST, near) else 0)
        if score >= pii.MIN_SCORE:
            want.append((m.start(), m.end(), round(score, 6)))
    assert want and [(s.start, s.end, round(s.score, 6)) for s in got if s.kind == "ssn"] == want


def stretch_edits(item, words):
    """Least edits from an item to a stretch of a text, by the plain table."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_in_blocks_equals_plain_edit_tables(spark, monkeypatch):
    rng = np.random.default_rng(8)
    items = [(k, prose(50 + k, 24, [f"v{j}" for j in range(60)])) for k in range(12)]
    docs = []
    for k in range(60):
        words = items[k % 12][1].split()
        for at in rng.choice(24, k % 7, replace=False):
            words[at] = f"x{k}"
        docs.append((k, f"{prose(k, 15)} {' '.join(words)} {prose(k + 1, 15)}", "kept"))
    docs += [(99, None, "kept"), (None, "", "kept"), (98, prose(3, 50), "kept")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k): d for i, t, _ in docs if t for k, x in items if (d := stretch_edits(x.split(), t.split())) <= 4}
    for size in (16 << 20, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontaminate, "HELD_BYTES", 2000)
        got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_items(df, bench).collect()}
        assert got == want
        left = decontaminate.drop_contaminated(df, bench)
        assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _, _ in docs if i not in {d for d, _ in want})
        assert decontaminate.drop_contaminated(df.limit(0), bench).count() == 0


def plain_pipeline(rows, scores, benchmark):
    """(doc_id, text) that the four filters leave, by plain rules; `scores` are those of the fitted model."""
    left = [r for r in rows if scores.get(r[1] or "", 0) < 0.5]
    keep = {}
    for i, t in left:
        keep[t or ""] = max(keep.get(t or "", -1), -1 if i is None else i)
    left = sorted((i, t) for t, i in keep.items())
    sets = {r: frozenset(zip(*[r[1].split()[k:] for k in range(5)])) for r in left}
    gone = set()
    for a in left:
        for b in left:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                gone.add(b)
    left = [r for r in left if r not in gone]
    return [(i, t) for i, t in left if not any(stretch_edits(x.split(), t.lower().split()) <= math.floor(0.2 * len(x.split()) + 1e-9) for x in benchmark)]


def test_pipeline_equals_plain_rules_on_odd_rows(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken
    from base64 import b64decode

    toxic = [(1000 + k, prose(k, 30) + " blockhead nitwit") for k in range(60)]
    clean = [(k, prose(500 + k, 40)) for k in range(80)]
    near = [(200 + k, prose(500 + k, 40) + " tail") for k in range(0, 80, 9)]
    same = [(300 + k, prose(500 + k, 40)) for k in range(0, 80, 7)]
    bench = [prose(9000 + k, 25, GERMAN) for k in range(4)]
    dirty = [(400 + k, f"{prose(k, 20)} {bench[k % 4]} {prose(k + 1, 20)}") for k in range(8)]
    rows = clean + toxic + near + same + dirty + [clean[3], clean[3], (601, None), (602, ""), (603, None)]
    names = "__score", "__gone", "__of", "__sha", "__hash", "score", "key", "whole"
    df = spark.createDataFrame([(i, t, "en", *["own"] * len(names)) for i, t in rows], ", ".join(["doc_id long", "text string", "lang string", *(f"{n} string" for n in names)]))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    first = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()
    kept = {r.text or "" for r in first}
    scores = {t: float(t not in kept) for t in {t or "" for _, t in rows}}
    assert all(scores[t] == 1 for _, t in toxic) and all(scores[t] == 0 for _, t in clean)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(rows, scores, bench)
    assert sorted((r.doc_id, tuple(r.token_ids), r.n_tokens, r.decoded) for r in got) == sorted((i, tuple(enc.encode_ordinary(t)), len(enc.encode_ordinary(t)), True) for i, t in want)
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
