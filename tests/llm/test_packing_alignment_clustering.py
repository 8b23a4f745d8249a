"""Packing, alignment and clustering against brute force, with nulls, empties, long texts, repeats and clashing columns."""

import hashlib
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bobbin.llm import alignment as A
from bobbin.llm import clustering as C
from bobbin.llm import packing as K

WORDS = "alpha beta gamma delta epsilon zeta Strasse naïve it's we'll 2024 日本語 привет κόσμος don't x=y(1) ... -- É ﬁ".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n).tolist())


SCHEMA = "doc_id long, text string, ids string, start string, sequence_id string, n_a string"
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "two"), (None, "one"), (5, prose(1, 9000)), (6, "a" * 3000), (7, "x\x1cy \x85z   w\xa0v  é é"), (8, "<|endoftext|> and <s> </s> <0x41>"),
    (9, "  two  spaces \n lines\n\nend "), (10, "日本語" * 700), (11, "a▁b c"), (12, prose(3, 40)), (13, "tab\tnew\r\nline don't STOP 12345"), (14, " "), (15, "😀 emoji 👩‍👩‍👧 end"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def word_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def held(pieces):
    return sorted((str(p.doc_id), p.start, p.length, tuple(p.ids), p.doc_tokens) for p in pieces)


@pytest.mark.parametrize("length", [1, 7, 64, 4096])
def test_pieces_hold_each_id_once_and_sequences_are_full(spark, docs, length):
    few = docs if length > 1 else docs.where("length(text) < 100 or text is null")
    texts = [r.text for r in few.collect()]
    want = word_ids(texts)
    pieces = K.pack(few.repartition(3), P.path("word_bpe_49k.json"), length).collect()
    by_sequence = {}
    for p in pieces:
        assert p.length == len(p.ids) and p.cut_before == (p.start > 0) and p.cut_after == (p.start + p.length < p.doc_tokens)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, ps in by_sequence.items():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        assert sum(p.length for p in ps) == length or s == max(by_sequence)
    # documents come out in line: each begins where another ends
    line = [p for s in sorted(by_sequence) for p in by_sequence[s]]
    ids, got = [], []
    for p in line:
        ids += p.ids
        if not p.cut_after:
            assert len(ids) == p.doc_tokens
            got.append((str(p.doc_id), tuple(ids)))
            ids = []
    assert sorted(got) == sorted((str(r.doc_id), tuple(w)) for r, w in zip(few.collect(), want, strict=True))


def test_packing_digests_sequences_and_empty_tables(docs, empty):
    path = P.path("word_bpe_49k.json")
    whole, short = K.pack(docs, path, 100).collect(), K.pack(docs, path, 100, digests=True).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(p.doc_id), p.start, p.ids_crc32) for p in short) == sorted((str(p.doc_id), p.start, crc(p.ids)) for p in whole)
    total = sum(p.length for p in whole)
    seqs = sorted(K.sequences(K.pack(docs, path, 100), 100).collect(), key=lambda r: r.sequence_id)
    last = total - 100 * (len(seqs) - 1)
    assert [len(s.ids) for s in seqs[:-1]] == [100] * (len(seqs) - 1) and len(seqs[-1].ids) == (last if last & (last - 1) == 0 else 100) and seqs[-1].n_ids == last
    assert K.pack(empty, path).count() == 0


def test_words_of_odd_texts_have_the_ids_of_the_whole_text():
    rng = np.random.default_rng(0)
    signs = list("abAB é́ '1!") + ["\x1c", "\x85", "\xa0", " ", "᠎", "\t", "\n", "\x0b", "'ll ", "'s", "İ", "ς", "ﬃ", "각", "ᄀ", "ᅡ", "‍", "<|endoftext|>", " " * 3]
    texts = ["".join(rng.choice(signs, 60)) for _ in range(400)]
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = K.WordCoder(f.read())
    assert [np.frombuffer(coder.encode(t), coder.dtype).tolist() + [2] for t in texts] == word_ids(texts)


def test_word_memory_is_bounded_and_slices_change_nothing(monkeypatch):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = K.WordCoder(f.read())
    monkeypatch.setattr(K, "WORDS", 50)
    monkeypatch.setattr(K, "SLICE", 64)
    texts = [" ".join(f"w{k}{j}" for j in range(40)) + " " + "z" * 80 + " tail" for k in range(9)]
    assert [np.frombuffer(coder.encode(t), coder.dtype).tolist() + [2] for t in texts] == word_ids(texts) and len(coder) <= 50


@pytest.fixture(scope="module")
def aligner():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(P.path("piece_bpe_32k.model"), "rb") as g:
        return A.Aligner(f.read(), g.read())


def plain_groups(aligner, text):
    """Groups by the definition, from both tokenizers over the whole text; None without tokens."""
    if not text:
        return None
    whole = (" " + text).encode()
    sides = []
    for ids, entry in ((aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.a_bytes), (aligner.b.encode(text), aligner.b_bytes)):
        parts = [entry[i] for i in ids]
        if b"".join(parts) != whole:
            return None
        sides.append((ids, np.cumsum([len(p) for p in parts]).tolist()))
    common = sorted(set(sides[0][1]) & set(sides[1][1]))
    out, lo = [], 0
    for hi in common:
        out.append(tuple(tuple(i for i, e in zip(ids, ends) if lo < e <= hi) for ids, ends in sides))
        lo = hi
    return out


def plain_align(aligner, texts):
    every = [plain_groups(aligner, t) for t in texts]
    links = [Counter((a, b) for x, y in g or [] for a in x for b in y) for g in every]
    counts = Counter(p for own in links for p in own)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for g, own in zip(every, links):
        said = ";".join("|".join(",".join(map(str, ids)) for ids in x) for x in g or [])
        out.append((sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(own.values()), sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in own.items()), hashlib.sha256(said.encode()).hexdigest() if g else "", said))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


@pytest.mark.parametrize("chunk", [64, 700, 1 << 15])
def test_alignment_equals_brute_force(docs, aligner, chunk, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 3)
    rows = A.align(docs.repartition(2), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), groups=True, chunk=chunk).collect()
    want = plain_align(aligner, [t for _, t in TEXTS])
    got = sorted((str(r.doc_id), *(r[c] for c in NAMES)) for r in rows)
    assert got == sorted((str(i), *w) for (i, _), w in zip(TEXTS, want, strict=True))


def test_alignment_of_an_empty_table_and_digests(docs, empty):
    a, b = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    assert A.align(empty, a, b).count() == 0
    out = A.align(docs.where("doc_id = 1 or doc_id = 2"), a, b)
    assert out.columns == ["doc_id", *NAMES[:-1]] and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in out.collect())


def chunks_of(tokens, cuts):
    """Fragments of the chunks of two token lists with ends: a token belongs to the chunk it starts in."""
    out = []
    for lo, hi in zip([0, *cuts], [*cuts, 1 << 30]):
        out.append(A.fragment(*[[t for t, s in zip(side, [0, *(e for _, e in side)]) if lo <= s < hi] for side in tokens]))
    return out


ends = st.lists(st.integers(1, 5), min_size=1, max_size=14).map(lambda x: np.cumsum(x).tolist())


@settings(max_examples=300, deadline=None)
@given(ends, ends, st.lists(st.integers(1, 60), max_size=6), st.randoms())
def test_fragments_compose_in_any_order(a, b, cuts, random):
    last = max(a[-1], b[-1])  # both sides end together, as texts do
    sides = [[(k, e) for k, e in enumerate(sorted({*x, last}))] for x in (a, b)]
    whole = A.fragment(*sides)
    parts = chunks_of(sides, sorted(set(cuts)))
    groups = lambda f: [g for _, gs in A.closings(f) for g in gs]
    assert groups(reduce(A.compose, parts, A.IDENTITY)) == groups(whole)
    while len(parts) > 1:  # neighbours in any order
        k = random.randrange(len(parts) - 1)
        parts[k : k + 2] = [A.compose(parts[k], parts[k + 1])]
    assert groups(parts[0]) == groups(whole) and not parts[0].suf_a and not parts[0].suf_b
    assert A.compose(A.IDENTITY, whole) == whole == A.compose(whole, A.IDENTITY)


def test_units_and_windows_have_the_tokens_of_the_whole_text(aligner):
    rng = np.random.default_rng(1)
    signs = list("ab AB  1!") + ["é", "\x1c", "\x85", "\xa0", "\t", "\n", "'ll ", "日本", "<s>", "<0x41>", "  ", " ", " ", "word", "Word "]
    for _ in range(150):
        text = "".join(rng.choice(signs, 80))
        made = aligner.tokens(" " + text)
        want = plain_groups(aligner, text)
        assert (made is None) == (want is None)
        if made is not None:
            said = A.tell(*made, np.array([len((" " + text).encode())]), aligner.spelt)
            links = Counter((a << 32) + b for x, y in want for a in x for b in y)
            assert said.groups == [";".join(map(A.spell, want))] and dict(zip(said.pairs.tolist(), said.links.tolist())) == links
            assert [int(x[0]) for x in said[1:5]] == [sum(len(x) for x, _ in want), sum(len(y) for _, y in want), len(want), sum(links.values())]
        spans = list(A.windows(text, 37, 12))
        assert [s[0] for s in spans] == [0, *(s[1] for s in spans[:-1])] and spans[-1][1] == len((" " + text).encode())
        parts = [aligner.chunk(w, at, lo, hi) for lo, hi, at, w in spans]
        if want is not None:
            told = {f.stretches[0][0]: said.groups[0] for f, said in parts if said}
            done = A.closings(reduce(A.compose, [p[0] for p in parts], A.IDENTITY))
            assert ";".join(told[e] if g is None else ";".join(map(A.spell, g)) for e, g in done) == ";".join(map(A.spell, want))


VECTORS = "vec_id long, embedding array<double>, cluster string, v string"


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        centres = [[sum(x) // len(x) for x in zip(*[v for (_, v), o in zip(kept, own) if o == c])] or centres[c] for c in range(len(centres))]
    out = [(i, near(v), far(v, centres[near(v)])) for i, v in kept]
    part = Counter()
    for _, c, d in out:
        part[c] += d
    return [(str(i), c, d, part[c], sum(part.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in out]


def clustered(df, **more):
    return sorted((str(r.vec_id), *tuple(r)[1:]) for r in C.cluster(df, **more).collect())


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(0, 1, 5).round(3).tolist()) for i in range(300)] + [(7, [0.5] * 5), (7, [0.25] * 5), (None, [1.0] * 5), (301, [1.0] * 4), (302, [1.0] * 6), (303, None), (304, [1.0, None, 1.0, 1.0, 1.0]), (305, [1.0, float("nan"), 1.0, 1.0, 1.0]), (306, [float("inf")] * 5), (307, []), *[(400, [-2.0] * 5)] * 60, (501, [9e5, -9e5, 0.1, 0.2, 0.3])]
    df = spark.createDataFrame([(i, e, "x", "y") for i, e in rows], VECTORS).repartition(3)
    for k, rounds in ((16, 3), (1, 1), (4, 0)):
        assert clustered(df, dims=5, k=k, rounds=rounds) == sorted(plain_clusters(rows, k, rounds, 5))
    few = df.where("vec_id = 7 or vec_id is null")
    assert clustered(few, dims=5) == sorted(plain_clusters([r for r in rows if r[0] in (7, None)], 16, 3, 5))
    assert clustered(df.where("vec_id = 303"), dims=5) == [] and C.cluster(df.limit(0), dims=5).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_distances_come_from_tables_of_any_spread():
    rng = np.random.default_rng(4)
    for spread in (3, 200, 1 << 27):
        x, c = rng.integers(-spread, spread, (500, 9)).astype("<i4"), rng.integers(-spread, spread, (4, 9))
        assert (C.distances(x, c) == ((x[:, None, :].astype(np.int64) - c[None]) ** 2).sum(axis=2)).all()


def test_integers_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="larger than"):
        C.cluster(spark.createDataFrame([(1, [1e9] * 5, "x", "y")], VECTORS), dims=5)
