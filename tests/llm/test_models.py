"""Trained operators: held-out accuracy, exact base scores, defined cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from quire.llm import langid, lm, quality

SOUNDS = {"en": "th and ing er wh ou", "de": "sch ung ver ei ch ü", "fr": "eau oi qu é ai tion", "es": "ción ll ñ rr que os"}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(700):
        lang = rng.choice(list(SOUNDS))
        kind = rng.choice("ggggbt")
        text = sentence(rng, lang, rng.randint(20, 120))
        if kind == "b":
            text = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in text.split())
        if kind == "t":
            text = " ".join(w if rng.random() > 0.15 else rng.choice(["trash", "scum", "moron"]) for w in text.split())
        rows.append((i, text, lang, f"src{i % 5}", len(text), int(kind != "b"), int(kind == "t")))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int").repartition(3).cache()


ODD = [(9001, None, "en", None, None), (9002, "", None, "s", 0), (None, "12 34 !!", "de", "s", 8), (9004, "the", "en", "s", 3), (9004, "the", "en", "s", 3)]
COLS = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_held_out(spark, docs):
    m = langid.fit(docs, per_lang=100)
    got = {r.doc_id: r for r in langid.identify(docs.drop("lang"), m).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert m.families == ["germanic", "romance"]


def test_language_defined_cases(spark, docs):
    m = langid.fit(docs, per_lang=50)
    odd = spark.createDataFrame(ODD, COLS)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd, m).collect()]
    assert [g[1:] for g in got[:3]] == [("und", 0.0)] * 3 and got[3] == got[4] and got[3][1] == "en"
    assert langid.keep(odd, m).columns == odd.columns and langid.keep(odd, m).count() == 2
    nothing = langid.fit(odd.limit(0))
    assert [r.lang_pred for r in langid.identify(odd, nothing).collect()] == ["und"] * 5
    one = langid.fit(docs.filter("lang = 'fr'"))
    assert {r.lang_pred for r in langid.identify(odd, one).collect()} == {"und", "fr"}
    assert langid.identify(odd.limit(0), m).count() == 0


def test_quality(spark, docs):
    labels = docs.filter("doc_id % 3 > 0").select("doc_id", "quality", "toxic")
    table = quality.prepared(docs.select(*quality.COLS, "doc_id"), False)
    m = quality.fit(table, labels, per_stratum=150)
    got = {r.doc_id: r for r in quality.classify(table, m).collect()}
    unseen = [r for r in docs.collect() if r.doc_id % 3 == 0]
    good = [got[r.doc_id].accepted for r in unseen if r.quality and not r.toxic]
    bad = [got[r.doc_id].accepted for r in unseen if not r.quality]
    toxic = [got[r.doc_id].accepted for r in unseen if r.toxic]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.2 and np.mean(toxic) < 0.5
    kept = quality.keep(docs, labels, per_stratum=150)
    assert kept.columns == docs.columns and kept.count() == sum(r.accepted for r in got.values())


def test_quality_rejects_toxic(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        words = sentence(rng, rng.choice(list(SOUNDS)), rng.randint(60, 160)).split()
        if i % 8 == 7:
            for _ in range(5):
                words[rng.randrange(len(words))] = rng.choice(["trash", "scum", "moron", "loser"])
        if i % 8 == 3:
            words = [w + rng.choice(["***", "$$$"]) for w in words]
        rows.append((i, " ".join(words), "en", "s", 900, int(i % 8 != 3), int(i % 8 == 7)))
    docs = spark.createDataFrame(rows, COLS + ", quality int, toxic int")
    table = quality.prepared(docs, False)
    m = quality.fit(table, docs.filter("doc_id % 2 = 0 or doc_id % 16 in (7, 3)").select("doc_id", "quality", "toxic"), rounds=1)
    got = {r.doc_id: r.accepted for r in quality.classify(table, m).collect()}
    assert np.mean([got[i] for i in range(1500) if i % 16 == 15]) < 0.3  # unseen toxic ones
    assert np.mean([got[i] for i in range(1500) if i % 16 in (1, 5, 9, 13)]) > 0.95  # unseen good ones
    assert quality.fit(quality.prepared(docs.filter("quality = 1"), False), docs.filter("quality = 1"), rounds=1).clean.ready  # toxic labels alone are learned from


def test_quality_counts_very_frequent_words():
    at, n = quality.text_view(["a"] * 70_000 + ["b"])
    assert sorted(n.tolist()) == [1, 70_000]
    (_, v), = quality.text_rows([at.tobytes()], [n.tobytes()])
    assert abs(v.max() / v.min() - 70_000**0.5) < 0.1


def test_quality_counts_repeats_of_all_lines():
    late = "\n".join([f"line {k}" for k in range(60)] + ["again"] * 30)
    early = "\n".join(["again"] * 30 + [f"line {k}" for k in range(60)])
    one, other = (quality.views(t, "en", "s", len(t))[2] for t in (late, early))
    assert one[21] == other[21] == np.float32(30 / 90)


def brute_surest(table, model, most):
    """All rows scored, lists sorted in full."""
    rows, out = {(r.v.at, r.v.n): r.v for r in sorted(table.collect(), key=lambda r: -r.v.o)}, {}
    for t, target in enumerate((model.fine, model.clean)):
        z = target.logits(quality.text_rows([bytes(v.at) for v in rows.values()], [bytes(v.n) for v in rows.values()]), quality.numbers([bytes(v.meta) for v in rows.values()]))
        for view in (0, 1):
            for label in (0, 1):
                sure = sorted((-abs(x), v.o) for x, v in zip(z[:, view], rows.values(), strict=True) if abs(x) > 1 and (x > 0) == bool(label))
                out[4 * t + 2 * view + label] = {o for _, o in sure[:most]}
    return out


def test_quality_searches_all_unlabelled_rows(spark, docs):
    table = quality.prepared(docs, False)
    m = quality.fit(table, docs.filter("doc_id % 3 > 0").select("doc_id", "quality", "toxic"), per_stratum=150, rounds=0)
    got = {}
    for r in quality.surest(table.repartition(7), m, 9).collect():
        got.setdefault(r.list, set()).add(r.o)
    assert got == {k: v for k, v in brute_surest(table, m, 9).items() if v}


def test_quality_defined_cases(spark, docs):
    odd = spark.createDataFrame(ODD, COLS)
    labels = docs.select("doc_id", "quality", "toxic")
    table = quality.prepared(odd, False)
    assert quality.classify(table, quality.fit(quality.prepared(docs, False), labels, per_stratum=60, rounds=1)).count() == 5
    none = quality.fit(table, labels.limit(0))
    assert [(r.score, r.accepted) for r in quality.classify(table, none).collect()] == [(0.5, True)] * 5
    assert quality.classify(quality.prepared(odd.limit(0), False), none).count() == 0
    several = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 0), (0, None, None), (10**9, 1, 0), (1, 0, None)], "doc_id long, quality int, toxic int"))
    clashing = odd.withColumns({"v": F.lit(1), "d": F.lit("x"), "o": F.lit(2.5), "at": F.lit(None).cast("string"), "list": F.lit(0)})
    assert quality.keep(clashing, several, rounds=1).columns == clashing.columns  # ties and repeated labels, no row of theirs here
    assert quality.keep(clashing, several, rounds=1).count() == 5


def test_base_scores_against_counting(spark, docs):
    import public_tokenizers

    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(9001, None), (9002, ""), (None, "The\x0bTHE a b"), (9004, "the"), (9004, "the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = lambda t: [w.lower() for w in (t or "").encode().split()] + [b" "]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    for top in (3, 1 << 20):  # few frequent words, so that most are joined; all of them
        got = lm.scores(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, top=top).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.scores(df.limit(0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def naive_logprob(m: lm.Attention, ids: list[int]) -> float:
    """Token by token, attention written out."""
    x, total = [m.end, *ids], 0.0
    for t, target in enumerate([*ids, m.end]):
        start = max(0, (t // lm.S - 1) * lm.S)
        e = m.E[x[start : t + 1]].astype(float)
        q, k, v = np.split(e @ m.Wqkv, 3, axis=1)
        a = np.exp([q[-1] @ k[j] / np.sqrt(lm.D) + m.R[len(k) - 1 - j] for j in range(len(k))])
        h = np.concatenate([e[-1], (a / a.sum()) @ v @ m.Wo])
        z = np.exp(np.maximum(h @ m.W1 + m.b1, 0) @ m.W2 + m.b2)
        w = z / z.sum()
        one = two = mixed = w[: lm.K] @ m.Q[target] / w[: lm.K].sum()
        if m.next:
            before = x[t - 1] if t else lm.NONE
            share, left = after(m.next.plain, (x[t],), target)
            one = two = share + left * mixed
            if before != lm.NONE:
                share, left = after(m.next.plain, (before, x[t]), target)
                two = share + left * one
        total += np.log10(w[: lm.K] @ m.Q[target] + w[lm.K] * one + w[lm.K + 1] * two)
    return total


def after(plain, context, y):
    """Discounted share of y after a context and what is left over, by plain dictionaries."""
    kept, totals = plain
    if context not in totals or not any(k[:-1] == context for k in kept):
        return 0.0, 1.0
    own = {k[-1]: c for k, c in kept.items() if k[:-1] == context}
    return max(own.get(y, 0) - lm.CUT, 0) / totals[context], 1 - sum(c - lm.CUT for c in own.values()) / totals[context]


def counted(docs, end, vocab):
    """Successors from counting, with their plain dictionaries; triples from 2 on."""
    c = Counter()
    for d in docs:
        x = [end, *d.tolist(), end]
        c.update(zip(x, x[1:], strict=False))
        c.update(zip(x, x[1:], x[2:], strict=False))
    totals = Counter()
    for k, n in c.items():
        totals[k[:-1]] += n
    kept = {k: n for k, n in c.items() if len(k) == 2 or n > 1}
    key = lambda k: int(lm.triple(*(np.array([v]) for v in ((lm.NONE, *k) if len(k) == 2 else k)))[0])
    last = lambda k: key((*k, 0)) >> 21
    s = lm.Successors(vocab, np.array([key(k) for k in kept]), np.array([*kept.values()]), np.array([last(k) for k in totals]), np.array([*totals.values()]))
    s.plain = kept, totals
    return s


def test_attention_against_plain_loop():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 90, rng.integers(0, 70)) for _ in range(12)] + [np.zeros(0, int)]
    for known in (None, counted(docs, 99, 100)):
        m = lm.Attention(100, 99)
        m.next = known
        m.fit(docs, steps=30, chunk=256)
        got = m.score(docs, chunk=64)
        assert np.allclose(got, [naive_logprob(m, d.tolist()) for d in docs], rtol=1e-4)
        assert np.allclose(m.Q.sum(axis=0), 1, atol=1e-4)  # each component is a distribution
    # and so are the successors: over all tokens the experts give 1
    every = np.arange(100)
    for a, b in ((5, 7), (lm.NONE, 99), (int(docs[0][0]), int(docs[0][1]))):
        p = np.full((100, lm.K + 2), 1 / (lm.K + 2), np.float32)
        assert np.allclose(m.experts(np.full(100, a), np.full(100, b), every, p).sum(axis=0), 1, atol=1e-4)


def test_successors_against_counting(spark, docs):
    import public_tokenizers

    enc = lm.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = [enc.encode([lm.lower(r.text)])[0] for r in docs.limit(40).collect()] + [b""]
    table = spark.createDataFrame([(bool(k % 5 == 0), bytearray(x)) for k, x in enumerate(ids)], "held_out boolean, ids binary").repartition(3)
    own = [np.frombuffer(x, enc.dtype) for k, x in enumerate(ids) if k % 5]
    plain = counted(own, enc.end, enc.size)
    got = lm.successors(table, enc.size, enc.dtype, enc.end, 1 << 19, 1 << 20)
    few = lm.successors(table, enc.size, enc.dtype, enc.end, 50, 20)  # what is not kept is left over
    flat = np.concatenate([np.concatenate([[enc.end], d, [enc.end]]) for d in own]).astype(np.int64)
    a, b, y = flat[:-2], flat[1:-1], flat[2:]
    for known in (plain, got, few):
        share, left, _ = known.of_pair(b, y)
        share3, left3 = known.of_triple(a, b, y, known.pairs(a << 21 | b))
        if known is plain:
            want = share, left, share3, left3
        elif known is got:
            assert all(np.allclose(x, z, atol=1e-6) for x, z in zip((share, left, share3, left3), want, strict=True))
    assert len(few.pairs.h) <= 50 and len(few.triples.h) <= 20 and (left >= want[1] - 1e-6).all()


def test_every_training_document_gives_a_run():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 90, n) for n in (0, 1, 23, 24, 500, 5000)]
    for share in (1 / 16, 1.0):
        for d, (i, j) in zip(docs, lm.runs_of(docs, share), strict=True):
            assert 0 <= i < j <= len(d) + 1 and i % lm.S == 0
            assert share < 1 or (i, j) == (0, len(d) + 1)


def test_attention_learns_its_context():
    rng = np.random.default_rng(1)
    docs = [np.tile(rng.choice([[1, 2, 3], [4, 5, 6]][k % 2], 6), 5) for k in range(200)]
    m = lm.Attention(10, 9).fit(docs[:160], steps=300, chunk=1024)
    n = sum(len(d) + 1 for d in docs[160:])
    y = np.concatenate([np.append(d, 9) for d in docs[:160]])
    u = np.log10(np.bincount(y, minlength=10) / len(y) + 1e-9)
    base = sum(u[np.append(d, 9)].sum() for d in docs[160:])
    assert m.score(docs[160:]).sum() > base + 0.15 * n


def test_language_rejects_what_was_not_learned(spark, docs):
    m = langid.fit(docs.filter("lang <> 'fr'"), per_lang=150)
    rng = random.Random(4)
    junk = [(k, "".join(rng.choice("qxzjkvwpybgm") if rng.random() < 0.8 else " " for _ in range(400))) for k in range(40)]
    repeated = [(100 + k, f"{w} " * 300) for k, w in enumerate(("xerc", "mubq", "ozzi"))]
    odd = spark.createDataFrame(junk + repeated, "doc_id long, text string")
    assert langid.keep(odd, m).count() <= 4
    french, known = docs.filter("lang = 'fr'"), docs.filter("lang <> 'fr'")
    assert langid.keep(french, m).count() < 0.3 * french.count() and langid.keep(known, m).count() > 0.97 * known.count()


def test_svm_against_plain_solver():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((80, 6)).astype(np.float32)
    y = np.where(x @ np.arange(6) + rng.standard_normal(80) > 0, 1.0, -1.0)
    w = langid.svm(x, y, c=1.0, epochs=400)
    weight = np.where(y > 0, 40 / (y > 0).sum(), 40 / (y < 0).sum())
    best, at = np.zeros(7), np.hstack([x, np.ones((80, 1))])
    for _ in range(20_000):  # gradient steps on the same objective
        slack = np.maximum(0, 1 - y * (at @ best))
        best -= 2e-3 * (best - 2 * at.T @ (weight * slack * y))
    assert np.allclose(w, best, atol=0.02)


def test_runs_cut_out_of_documents_train_alike():
    rng = np.random.default_rng(4)
    docs = [rng.integers(3, 400, n).astype("<u2") for n in (0, 1, 15, 16, 40, 333, 2000)]
    for share in (1 / 64, 1 / 3, 1.0):
        runs = lm.runs_of(docs, share)
        small = [lm.cut(d, r) for d, r in zip(docs, runs, strict=True)]
        model = lm.Attention(400, 2)
        whole, cut = model.stream(docs, runs), model.stream([d for d, _ in small], [r for _, r in small])
        assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
        assert share == 1 or sum(len(d) for d, _ in small) < sum(len(d) for d in docs)
        assert [np.append(d, 2)[i:j].tolist() for d, (i, j) in zip(docs, runs, strict=True)] == [np.append(d, 2)[i:j].tolist() for d, (i, j) in small]


def test_every_training_token_is_learned_from(spark):
    import public_tokenizers

    enc = lm.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 300, n).astype(enc.dtype) for n in (0, 1, 700, 5000, 16, 90)] * 3
    table = spark.createDataFrame([(k % 4 == 1, bytearray(d.tobytes())) for k, d in enumerate(docs)], "held_out boolean, ids binary").repartition(3)
    own = [d for k, d in enumerate(docs) if k % 4 != 1]
    counts = lm.successor_counts(table, enc.dtype, enc.end, most=1500).cache()  # few at a time, so that counts are merged
    seen, sums = lm.contexts(counts, enc.size)
    want_seen, want = np.zeros(enc.size), np.zeros((enc.size, lm.D))
    for d in own:
        for x, y in zip([enc.end, *d.tolist()], [*d.tolist(), enc.end], strict=True):
            want_seen[x] += 1
            want[x, : lm.D // 2] += lm.signs(np.array([y]))[0]
            want[y, lm.D // 2 :] += lm.signs(np.array([x]))[0]
    assert (seen == want_seen).all() and (sums == want).all()
    m = lm.train(table, enc.size, enc.dtype, enc.end, lm.most_frequent(counts, enc.size, 1 << 18, 1 << 19), (seen, sums), least=1)
    assert m.tokens == sum(len(d) + 1 for d in own)
    # within one task too, each token weighs 1 among the components and the counted successors
    alone = lm.Attention(enc.size, enc.end).embed(seen, sums)
    counts, n = alone.learn(iter([own[:2], own[2:]]), chunk=256)
    assert n == m.tokens and np.isclose(counts.sum() + alone.counted, n, rtol=1e-4)


def test_weights_follow_the_gradient():
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 40, n) for n in (30, 0, 47, 5)]
    m = lm.Attention(50, 49)
    m.next = counted(docs, 49, 50)
    m.fit(docs, steps=20, chunk=256)
    m.next = None
    eps = 1e-2
    for name in m.taught:
        w = getattr(m, name)
        at = np.unravel_index(np.abs(w).argmax(), w.shape)
        was, got = w[at].copy(), []
        for step in (eps, -eps):
            w[at] = was + step
            got.append(m.score(docs).sum())
        w[at] = was
        slope = got[0] - got[1]
        other = lm.Attention(50, 49)
        for k in ("E", "Q", "floor", *m.taught):
            setattr(other, k, getattr(m, k).copy())
        other.learn(iter([docs]), chunk=4096, rate=1e-4)
        assert abs(slope) < 1e-3 or np.sign(getattr(other, name)[at] - was) == np.sign(slope)


def test_distinct_parts_are_encoded_once():
    import public_tokenizers
    import pyarrow as pa

    enc = lm.Encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng, plain, asked = random.Random(3), enc.enc, []
    signs = [" ", " ", " ", "  ", "\n", "\t", "\x0b", "\x1f", "\x85", "\xa0", " ", "​", "　", "﻿", "'s", "'", "a", "bc", "Ä", "日本", "12", "!?", "\U0001f600", "\x00", "́"]
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    every = [f"x {chr(c)}y z{chr(c)} w{chr(c)}" for c in range(0x3100)]  # each character after a space, before one and at the end
    for texts in (odd, every, [""], [" "], ["a"], [" a", "  ", "b" * 5000 + " b"]):
        of = pa.array(texts)
        assert enc.encode_parts(of, *lm.parts(of)).to_pylist() == enc.encode(texts)
    words = [f"w{k}" for k in range(300)]
    of = pa.array([" ".join(rng.choice(words) for _ in range(500)) for _ in range(80)])
    want = enc.encode(of.to_pylist())

    class Counting:
        def encode_ordinary(self, text):
            asked.append(len(text))
            return plain.encode_ordinary(text)

    enc.enc = Counting()
    assert enc.encode_parts(of, *lm.parts(of)).to_pylist() == want and sum(asked) < 0.02 * sum(map(len, of.to_pylist()))


def test_places_against_a_dictionary():
    import pickle

    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 50_000):
        keys = rng.permutation(np.unique(rng.integers(0, 1 << rng.integers(18, 42), n)))
        want = {k: i for i, k in enumerate(keys.tolist())}
        asked = np.concatenate([keys, rng.integers(-(1 << 21), 1 << 42, 20_000), keys + 1, [-1, 0]])
        for places in (lm.Places(keys), pickle.loads(pickle.dumps(lm.Places(keys)))):
            assert places(asked).tolist() == [want.get(k, -1) for k in asked.tolist()]
    with pytest.raises(ValueError):
        lm.Places(np.zeros(1 << 21, np.int64))


def test_successor_counts_come_once_a_key(spark):
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 40, n).astype("<u2") for n in (0, 1, 2, 900, 3000, 40)] * 4
    table = spark.createDataFrame([(k % 5 == 1, bytearray(d.tobytes())) for k, d in enumerate(docs)], "held_out boolean, ids binary").repartition(5)
    want = Counter()
    for d in (d for k, d in enumerate(docs) if k % 5 != 1):
        x = [40, *d.tolist(), 40]
        want.update((lm.NONE, *p) for p in zip(x, x[1:], strict=False))
        want.update(zip(x, x[1:], x[2:], strict=False))
    for most in (20, 1000, 1_000_000):
        got = lm.successor_counts(table, np.dtype("<u2"), 40, most=most)
        assert "HashAggregate" not in got._jdf.queryExecution().toString()  # rows of packed counts travel, not a row a key
        rows = got.collect()
        assert len(rows) == len(want) and {(r.key >> 42, r.key >> 21 & lm.NONE, r.key & lm.NONE): r.c for r in rows} == want
