"""Corpus operators against brute force on small tables, with nulls, empties, long texts, repeats and clashing columns."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bobbin.llm import bpe, components, decontaminate, exact_dedup, language, licences, near_dedup, pii, sharding, toxicity, warc
from bobbin.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, key string, rep long, score double, __text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n).tolist())


ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, prose(1, 60)), (7, prose(1, 60)), (8, prose(1, 60) + " tail"), (9, prose(2, 60)), (10, prose(2, 30000)),
    (11, "Mail a.b@c.de, ip 10.0.0.1 or 10.0.0.256, card 4111 1111 1111 1111, call +1 (555) 123-4567."), (12, "é日本 \U0001f600  x'll\n\n y 123"), (13, "a" * 3000), (13, "a" * 3000), (None, "one"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "k", 0, 0.0, "x") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_tiktoken_and_round_trips(docs, empty):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(docs, path, P.PATTERN, decoded="bytes_")
    assert got.columns == [*docs.columns, "n_tokens", "token_ids", "bytes_"]
    for r in got.collect():
        assert r.token_ids == enc.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids) and bytes(r.bytes_) == (r.text or "").encode()
    back = bpe.decode_documents(got.drop("bytes_"), path).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert bpe.encode_documents(empty, path, P.PATTERN).count() == 0


def test_bpe_long_and_odd_pieces():
    import public_tokenizers as P
    import tiktoken

    tokens = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    coder = bpe.Coder(tokens, bpe.merge_table(tokens), P.PATTERN)
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.choice([97, 98, 99, 101, 110, 116, 233, 0x4E2D], n))) for n in (1, 2, 30, 65, 66, 400, 2000)]
    texts += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000)), "a" * 30_000, " " + "=" * 900, "".join(rng.choice(WORDS, 5000))]
    texts += ["ab" * 500, "aab" * 333, "=" * 700, " " * 90, "\x1c\x85　x    y"]
    assert [list(map(int, x.split())) for x in coder.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_decontamination_finds_edited_items(spark, docs, empty):
    items = spark.createDataFrame([(1, prose(2, 40)), (2, prose(77, 25)), (3, None), (4, "")], "item_id long, text string")
    words = prose(77, 25).split()
    for at in (3, 11, 19):
        words[at] = "changed"
    held = spark.createDataFrame([(50, f"{prose(5, 20)} {' '.join(words)} {prose(6, 20)}"), (51, " ".join(words[:12])), (52, prose(9, 400))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_items(docs.select("doc_id", "text").union(held), items).collect()}
    assert {(9, 1, 0), (10, 1, 0), (50, 2, 3)} <= got and not {x[0] for x in got} & {51, 52}
    assert decontaminate.find_items(empty, items).count() == 0 and decontaminate.find_items(docs, items.where("item_id > 9")).count() == 0


def edited(rng, words, k, mode):
    x = list(words)
    for j in range(k):
        if mode == "changed front":
            x[j] = "quux"
        elif mode == "lost front":
            x.pop(0)
        elif mode == "longer front":
            x.insert(1, "quux")
        elif mode == "changed end":
            x[-1 - j] = "quux"
        else:
            at, how = rng.integers(len(x)), rng.integers(3)
            x[at : at + (how != 1)] = [] if how == 2 else ["quux"]
    return x


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(300)]
    share = 1 / np.arange(1, 301)
    pick = lambda n: rng.choice(vocab, n, p=share / share.sum()).tolist()
    items = [(k, pick(n)) for k, n in enumerate((3, 5, 9, 14, 20, 35, 59) * 4)]
    modes = ("any", "any", "changed front", "lost front", "longer front", "changed end")
    docs = [" ".join(pick(25) + edited(rng, x, decontaminate.edits(len(x), 0.8), m) + pick(25)) for _, x in items for m in modes]
    index = decontaminate.Index([(k, " ".join(x)) for k, x in items], 0.8)
    want = set()
    for d, t in enumerate(docs):
        ids = decontaminate._numbers(index, [t])[0]
        want |= {(d, k) for k, x in enumerate(index.items) if decontaminate.best_stretch(x, ids)[0] <= index.reach[k]}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_items(df, bench).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    left = {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert left == set(range(len(docs))) - {d for d, _ in got}


def test_lsh_keys_tell_windows_apart():
    rng = np.random.default_rng(4)
    for n in (5, 12, 35, 59):
        a, b = rng.integers(1, 400, (200, n)), rng.integers(1, 400, (200, n))
        ka, kb = decontaminate.lsh_keys(a), decontaminate.lsh_keys(b)
        met = ((ka == kb) & (ka > 0)).any(axis=1)
        assert met.mean() <= 0.15 and ((ka > 0).any(axis=1)).all()


def test_decontamination_of_odd_rows(spark, docs, empty):
    items = spark.createDataFrame([(None, prose(2, 40), "t", 1), (7, prose(2, 40), "t", 1), (7, prose(2, 40), "t", 1), (8, None, "t", 1)], "item_id long, text string, doc_id string, rep long")
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(d, i) for d in (9, 10) for i in (7, 7, None)], key=str)
    twice = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(9, "only here", "en"), (None, prose(2, 60), "en")], "doc_id long, text string, lang string"))
    left = decontaminate.drop_contaminated(twice, items)
    assert left.columns == twice.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i in [i for i, _ in ROWS if i not in (9, 10)] + [9])
    assert decontaminate.drop_contaminated(docs, items.where("item_id > 9")).count() == len(ROWS) and decontaminate.drop_contaminated(empty, items).count() == 0


def test_shards_are_contiguous_and_near_equal(docs, empty):
    rows = sharding.shard_by_bytes(docs, 4).collect()
    assert len(rows) == len(ROWS)
    sizes = {(i, t) for i, t in ROWS}
    for r in rows:
        assert any(r.doc_id == i and r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode()) for i, t in sizes)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_by_bytes(empty, 4).count() == 0


def shard_sizes(rows, n):
    return [sum(r.size for r in rows if r.shard == s) for s in range(n)]


def test_shards_keep_equal_texts_together(spark):
    rng = np.random.default_rng(6)
    texts = ["hot" * 30] * 2000 + [t for k in range(40) for t in [f"copy {k} " + "y" * int(rng.integers(20, 400))] * int(rng.integers(2, 60))] + ["z" * int(rng.integers(10, 300)) + str(k) for k in range(3000)]
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = sharding.shard_by_bytes(df, 10).collect()
    sizes, target = shard_sizes(rows, 10), sum(len(t) + 16 for t in texts) / 10
    assert len(rows) == len(texts) and max(sizes) <= 1.04 * target and min(sizes) >= 0.96 * target
    homes = {}
    for r in rows:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    hot = zlib.crc32(b"hot" * 30)
    assert all(len(v) == 1 for k, v in homes.items() if k != hot) and len(homes[hot]) <= 2000 * 106 // target + 2
    for s in range(10):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_of_one_repeated_row(spark):
    rows = sharding.shard_by_bytes(spark.createDataFrame([(1, "same")] * 400, "doc_id long, text string"), 4).collect()
    assert sorted(shard_sizes(rows, 4)) == [2000] * 4 and len({(r.shard, r.slot) for r in rows}) == 400


def shingles(t, width):
    w = re.findall(r"[^ \t-\r]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < width else zip(*[w[i:] for i in range(width)]))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, docs, empty, width):
    rng = np.random.default_rng(11)
    base, more = prose(40, 120).split(), []
    for k in range(40):  # copies with more and more changed words
        own = list(base)
        for at in rng.choice(120, k % 12, replace=False):
            own[at] = f"w{k}"
        more.append((100 + k, " ".join(own)))
    every = docs.select("doc_id", "text").where("doc_id is not null").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(every, 0.8, width).collect()}
    sets = {r.doc_id: shingles(r.text, width) for r in every.collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert near_dedup.near_duplicates(empty).count() == 0


TWICE = [(5, "only here " * 9), (5, "shared " + prose(4, 30)), (9, "shared " + prose(4, 30)), (None, "shared " + prose(4, 30)), (None, "lone " + prose(8, 30)), (None, "lone " + prose(8, 30)), (3, "twin " + prose(9, 30)), (3, "twin " + prose(9, 30)), (2, None), (1, "")]


def test_one_id_on_two_texts_and_rows_without_id(spark):
    df = spark.createDataFrame([(i, t, k, "c") for k, (i, t) in enumerate(TWICE)], "doc_id long, text string, whole long, rep string")
    got = sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in exact_dedup.exact_duplicates(df).collect())
    assert got == sorted(map(str, [(5, 5, 1, True), (5, 9, 3, False), (9, 9, 3, True), (None, 9, 3, False), *[(None, None, 2, True)] * 2, *[(3, 3, 2, True)] * 2, (2, 2, 2, True), (1, 2, 2, False)]))
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted([("5", TWICE[0][1]), ("9", TWICE[2][1]), ("None", TWICE[4][1]), ("3", TWICE[6][1]), ("2", "")])
    near = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 0.8, 4).collect()}
    assert near == {(5, 5, True), (9, 5, False), (None, 5, False), (None, None, True), (3, 3, True), (2, 2, True), (1, 1, True)}
    left = near_dedup.drop_near_copies(df, 0.8, 4)
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted([("5", TWICE[0][1]), ("5", TWICE[1][1]), ("None", TWICE[4][1]), ("3", TWICE[6][1]), ("2", ""), ("1", "")])


def test_hot_keys_are_dealt(spark):
    from bobbin.llm import common

    rows = spark.createDataFrame([(1 if k < 3000 else None if k < 5000 else k, k) for k in range(9000)], "key long, own long")
    look = spark.createDataFrame([(1, "a"), (6000, "b"), (6001, "c")], "key long, v string")
    for how, n in (("inner", 3002), ("left", 9000)):
        out = common.attach(rows, look, "key", how)
        assert out.count() == n and out.where("v = 'a'").count() == 3000 and out.columns == ["key", "own", "v"]
    heavy = common.hot_keys(rows, "key").collect()
    assert [r.key for r in heavy] == [1] and heavy[0][1] > 300


def test_components_of_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 140)}}


def test_pii_positions_and_checks(docs, empty):
    rows = {r.doc_id: r.found for r in pii.find_pii(docs).collect()}
    text = dict(ROWS)[11]
    assert [(s.kind, text[s.start : s.end]) for s in rows[11]] == [("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert not rows[1] and not rows[2] and pii.find_pii(empty).count() == 0


def test_pii_base_equals_plain_patterns(spark):
    rng = np.random.default_rng(2)
    bits = ["a@b.c", "@", ".", "_x", "1.2.3.4", "9.", "4111111111111111", "4111111111111112", "+", "1 23", "(55) 5", "é", " ", "-", "12345678901", "x" * 50]
    texts = ["".join(rng.choice(bits, 12)) for _ in range(300)]
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        want = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(plain.items()) for m in re.finditer(p, texts[r.doc_id]) if ok(kind, m.group()))
        assert [(s.start, s.k, s.kind, s.end) for s in r.found if s.kind in pii.BASE] == want


def test_pii_adds_valid_account_numbers(spark):
    df = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32 here"), (2, "IBAN GB82 WEST 1234 5698 7654 33 here")], "doc_id long, text string")
    assert {r.doc_id: [s.kind for s in r.found if s.kind == "iban"] for r in pii.find_pii(df).collect()} == {1: ["iban"], 2: []}


def test_exact_duplicates(docs, empty):
    got = sorted(((r.doc_id or -1), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect())
    want = []
    for i, t in ROWS:
        same = [j for j, u in ROWS if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i or -1, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want) and exact_dedup.exact_duplicates(empty).count() == 0


def test_language_held_out_accuracy(spark, docs, empty):
    rows = Q.op6_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    out = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and out[6].lang_pred == "en"
    assert language.predict(docs, language.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_toxicity_folds_and_holds_out(spark, docs, empty):
    clean = [(k, prose(k, 30), 0) for k in range(40)]
    toxic = [(100 + k, prose(k, 30) + " blockhead", 1) for k in range(40)]
    df = spark.createDataFrame([(i, t) for i, t, _ in clean + toxic], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, y) for i, _, y in clean + toxic], "doc_id long, toxic int"))
    asked = spark.createDataFrame([(1, "you bl0ckhead"), (2, "you blосkhead"), (3, "all is well"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert got[1] >= 0.5 and got[2] >= 0.5 and max(got[3], got[4], got[5]) < 0.5
    assert toxicity.score(docs, toxicity.fit(empty, df.withColumnRenamed("text", "t").selectExpr("doc_id", "0 as toxic"))).where("score <> 0").count() == 0


def test_licences(docs, spark, empty):
    df = spark.createDataFrame([(1, "intro words. Licensed under the Apache License, Version 2.0. more"), (2, "nothing here"), (3, "this work is licensed under the GNU General Public License version 3"), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.licence, r.first_word, r.end_word) for r in licences.find_licences(df).collect()}
    assert got >= {(1, "Apache-2.0", 2, 10), (3, "GPL-3.0", 0, 12)} and {x[0] for x in got} == {1, 3}
    assert licences.find_licences(empty).count() == 0


def test_licence_notices_with_one_word_changed(spark):
    rows, want = [], {}
    for name, texts in licences.TEMPLATES.items():
        for t in [texts] if isinstance(texts, str) else texts:
            marked = re.split(r"(\[\[.*?\]\])", t)
            words, fixed = [], []
            for part in marked:
                own = [w.decode() for w in decontaminate.words_of(part)]
                words += own
                fixed += [part.startswith("[[") and (k, len(own)) for k in range(len(own))]
            loose = [k for k in range(len(words)) if not fixed[k]]
            gaps = [k for k in range(1, len(words)) if not fixed[k] or fixed[k][0] == 0]
            edited = [words] + [[*words[:k], "quux", *words[k + 1 :]] for k in loose] + [[*words[:k], *words[k + 1 :]] for k in loose] + [[*words[:k], "quux", *words[k:]] for k in gaps]
            for e in edited:
                want[len(rows)] = name
                rows.append((len(rows), f"{prose(len(rows), 9)} {' '.join(e)} {prose(len(rows) + 1, 9)}"))
    got = {}
    for r in licences.find_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.licence)
    lost = [(want[i], rows[i][1]) for i in want if want[i] not in got.get(i, ())]
    assert not lost, (len(lost), len(rows), lost[:5])


def test_licence_versions_and_names_are_told_apart(spark):
    said = {
        "Licensed under CC BY 3.0.": {"CC-BY-3.0"}, "Licensed under CC BY-NC-SA 4.0": {"CC-BY-NC-SA-4.0"}, "licensed under the GNU General Public License, version 2": {"GPL-2.0"}, "Released under MIT License": {"MIT"},
        "This work is licensed under the GNU Lesser General Public License, version 3.": {"LGPL-3.0"}, "Licensed under CC BY 9.9": set(), "Released under the Foo License": set(), "All rights are reserved": {"Proprietary"}, "all human rights": set(),
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": {"BSD"},
    }
    df = spark.createDataFrame([(k, f"{prose(k, 8)} {t} {prose(k + 50, 8)}") for k, t in enumerate(said)], "doc_id long, text string")
    rows = licences.find_licences(df).collect()
    assert [{r.licence for r in rows if r.doc_id == k} for k in range(len(said))] == list(said.values())


def test_pii_secrets_without_digits_and_of_any_length(spark):
    rng = np.random.default_rng(4)
    keys = ["correcthorsebatterystaple", *("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEF_/+-"), n)) for n in (16, 64, 65, 88, 93, 200)), "".join(rng.choice(list("abcdef0123456789"), 120))]
    texts = [f"set password={k} now" for k in keys] + ["password=tooshort now"]
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.found] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {**{i: [("secret", f"password={k}")] for i, k in enumerate(keys)}, len(keys): []}


def test_licence_full_texts_and_blocks(spark, docs):
    rows = []
    for name, t in licences.FULL_TEXTS.items():
        words = t.replace("[[", "").replace("]]", "").split()
        for k in (7, len(words) // 2, len(words) - 9):
            rows.append((name, f"{prose(k, 12)} {' '.join([*words[:k], 'quux', *words[k + 1 :]])} {prose(k + 1, 5)}"))
    df = spark.createDataFrame([(k, t, "x", "y") for k, (_, t) in enumerate(rows)], "doc_id long, text string, hits string, licence string").unionByName(docs.select("doc_id", "text", F.lit("x").alias("hits"), F.lit("y").alias("licence")).where("doc_id = 10"))
    whole = sorted(map(tuple, licences.find_licences(df).collect()))
    wide = {(r[0], r[1]) for r in whole if r[3] - r[2] > 100}
    assert {(k, name) for k, (name, _) in enumerate(rows)} <= wide
    assert sorted(map(tuple, licences.find_licences(df, block_bytes=2000).collect())) == whole
    assert [r for r in whole if r[0] == 10 and r[0] >= len(rows)] == []


def test_warc_one_id_on_two_payloads(spark):
    p, r = "<html>" + "p" * 200, "<html>" + "r" * 200
    rows = [(2, "u", p), (2, "u", r), (1, "u", p), (None, "u", p), (None, "u", "<html>" + "s" * 200), (1, "u", p)]
    pages = spark.createDataFrame([(*x, "d") for x in rows], "page_id long, url string, html string, d string")
    got = sorted(((r_.page_id or 0), r_.record_type, r_.refers_to or 0, bytes(r_.payload)[-1:]) for r_ in warc.read_archives(warc.write_archives(pages)).collect())
    assert got == sorted([(2, "revisit", 1, b""), (2, "response", 0, b"r"), (1, "response", 0, b"p"), (0, "revisit", 1, b""), (0, "response", 0, b"s"), (1, "response", 0, b"p")])


def test_warc_headers_of_any_length(spark):
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(map(chr, rng.integers(33, 126, n)))
    rows = [(1, "http://a/" + noise(100_000), "<html>one"), (2, "http://b", "<html>two"), (3, "data:" + " " * 9_000, "<html>three"), (4, "x" * 400_000, "<html>" + noise(300_000)), (5, noise(70_000), None)]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    for split in (1000, 50_000, 1 << 20):
        got = {r.page_id: (r.url, bytes(r.payload)) for r in warc.read_archives(files, split).collect()}
        assert got == {i: (u.replace(" ", "%20"), (h or "").encode()) for i, u, h in rows}


def test_warc_gap_is_an_error(tmp_path):
    one = warc.record(1, "http://a", b"x", hashlib.sha256(b"x").hexdigest(), 1, None)
    for k, data in enumerate((one + b"\x1f\x8b\x08rest" + one, one + b"rest", b"rest" + one)):
        (tmp_path / f"{k}.warc.gz").write_bytes(data)
        with pytest.raises(ValueError, match="no record at"):
            list(warc.records_in(f"file://{tmp_path}/{k}.warc.gz", 0, len(data), len(data)))


def test_warc_round_trip_in_small_splits(spark):
    page = "<html>" + "x" * 300
    rows = [(1, "http://a", page), (2, "http://b", page), (3, "http://c", "tiny"), (4, "http://d", "tiny"), (5, None, None), (6, "http://e\n", page + "é"), (0, "http://f", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    files = warc.write_archives(pages)
    for split in (64, 1000, 1 << 20):
        got = {r.page_id: r for r in warc.read_archives(files, split).collect()}
        assert set(got) == {r[0] for r in rows}
        for i, _, h in rows:
            body = (h or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
            assert (got[i].record_type, got[i].refers_to) == (("revisit", 0) if i in (1, 2) else ("response", None))
            assert bytes(got[i].payload) == (b"" if i in (1, 2) else body)
    assert warc.read_archives(warc.write_archives(pages.where("page_id > 99"))).count() == 0


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_twin(spark, name):
    from compare import differing

    assert differing(spark, "/root/testdata/sf0.001", name) is None


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d)
    assert out.where("not decoded").count() == 0
    assert 0.5 * docs.select("text").distinct().count() < out.count() <= docs.select("text").distinct().count()
