"""Toxicity, quality and language classifiers: held-out accuracy and edge cases."""

import random
import re
import zlib

import numpy as np
import pytest

from joinwright.llm import language_id, quality_classifier, toxicity
from pyspark.sql import functions as F


def held(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


def prose(draw, n, stems=("lo", "mi", "ra", "te", "so", "na", "ku")):
    return " ".join("".join(draw.choice(stems) for _ in range(draw.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def toxic_rows():
    draw = random.Random(8)
    bad = [f"grim{x}" for x in ("ba", "do", "fu", "lek")] + ["vileword", "nastyword", "crudeword"]
    docs, labels = [], []
    for i in range(1200):
        text = prose(draw, draw.randrange(20, 60)).split()
        toxic = i % 8 == 0
        for _ in range(draw.randrange(2, 5) if toxic else 0):
            text.insert(draw.randrange(len(text)), draw.choice(bad))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic), 1))
    return docs, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")


def test_toxic_texts_are_found(spark, make, clashing, toxic_rows):
    docs, labels = toxic_rows
    df = make(docs, **clashing)
    model = toxicity.train(df, frame(spark, labels))
    found = {r.doc_id: r.score for r in toxicity.toxicity(df, model).collect()}
    wrong = [i for i, y, _ in labels if (found[i] >= toxicity.THRESHOLD) != bool(y) and held(i, 4, 2)]
    assert len(wrong) <= 3 and all(0 <= s <= 1 for s in found.values())


def test_toxicity_never_reads_held_out_labels(spark, make, toxic_rows):
    docs, labels = toxic_rows
    df = make(docs)
    flipped = [(i, 1 - y if held(i, 4, 2) else y, q) for i, y, q in labels]
    one, two = toxicity.train(df, frame(spark, labels)), toxicity.train(df, frame(spark, flipped))
    assert np.array_equal(one.lexicon, two.lexicon) and np.allclose(one.weights, two.weights)


def test_toxicity_edges(spark, make, toxic_rows):
    docs, labels = toxic_rows
    model = toxicity.train(make(docs), frame(spark, labels))
    odd = make([(None, "vileword nastyword vileword crudeword grimba"), (1, None), (2, ""), (3, "a" * 100000), (3, "a" * 100000)])
    scores = {(r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(odd, model).collect()}
    assert len(scores) == 4 and max(s for i, s in scores if i is None) >= 0.3 and max(s for i, s in scores if i is not None) < 0.3
    nothing = toxicity.train(make([]), frame(spark, []))
    assert {r.score for r in toxicity.toxicity(odd, nothing).collect()} == {0.0}
    assert toxicity.toxicity(make([]), model).count() == 0
    unusable = frame(spark, [(None, 1, 1), (1, None, None)])
    assert len(toxicity.train(make(docs), unusable).weights) == 0


def naive_terms(text):
    words = re.findall(rb"[a-z'\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text))
    return [("word", w) for w in words if len(w) >= 3] + [(k, w[:k]) for w in words for k in toxicity.PREFIXES if len(w) >= k]


def naive_patterns(text):
    upper, lower = len(re.findall(rb"[A-Z]", text)), len(re.findall(rb"[a-z]", text))
    blank = len(re.findall(rb"[\x20\x09-\x0D]", text)) + 1  # the line that ends the text
    return [upper > lower, 40 * text.count(b"!") > blank + 20, 10 * len(re.findall(rb"[#*$%&|<>]", text)) > blank + 20, blank <= 20]


def test_toxicity_equals_brute_force(spark, make, toxic_rows):
    docs, labels = toxic_rows
    odd = [b"", b"Don't GRIMBA grimdo!!", "Ünder éé ab vileword".encode(), b"### $$ |", b"A!!!!" * 30, b"x" * 5000 + b" crudewords"]
    texts = [t.encode() for _, t in docs[:200]] + odd
    known = {}
    for t in texts:
        keys, owners = toxicity.terms([t])
        want = naive_terms(t)
        assert len(keys) == len(want) and not owners.any()
        # the same multiset of terms: words first, then beginnings by length
        for w, h in zip(sorted(want, key=lambda x: (x[0] != "word", x[0] if x[0] != "word" else 0)), keys.tolist()):
            assert known.setdefault(w, h) == h
        assert toxicity.patterns([t])[0].tolist() == naive_patterns(t)
    assert len(set(known.values())) == len(known)
    # candidates from counts, text by text
    used = {i: y for i, y, _ in labels if not held(i, 4, 2)}
    positive, total = {}, {}
    for i, t in docs:
        if i in used:
            for w in set(naive_terms(t.encode())):
                total[w] = total.get(w, 0) + 1
                positive[w] = positive.get(w, 0) + used[i]
    n1 = sum(used.values())
    n0 = len(used) - n1

    def ratio(w):
        return ((positive[w] + 0.05) / (n1 + 1)) / ((total[w] - positive[w] + 0.05) / (n0 + 1))

    want = sorted((w for w in total if positive[w] >= max(4, 0.006 * n1) and ratio(w) >= 60), key=lambda w: -positive[w] * np.log(ratio(w)))
    sample = toxicity.sampled_texts(make(docs), toxicity.labelled_sample(frame(spark, labels), "toxic", 4, 2, 8000))
    found = toxicity.candidates(toxicity._counts(sample)).tolist()
    for t in (t.encode() for i, t in docs if i in used):
        for w, h in zip(sorted(naive_terms(t), key=lambda x: (x[0] != "word", x[0] if x[0] != "word" else 0)), toxicity.terms([t])[0].tolist()):
            known[w] = h
    assert sorted(found) == sorted(known[w] for w in want) and known[want[0]] in found[:2]
    # scores from the fitted weights, term by term
    model = toxicity.train(make(docs), frame(spark, labels))
    m = len(model.lexicon)
    assert set(model.lexicon.tolist()) <= set(found) and m <= toxicity.MAX_VOTERS
    at = {h: i for i, h in enumerate(model.lexicon.tolist())}
    for t, s in zip(texts, model.score(texts)):
        hits = [at[known[w]] for w in naive_terms(t) if known[w] in at]
        z = sum(model.weights[i] for i in set(hits)) + np.log1p(len(hits)) * model.weights[m] + np.dot(naive_patterns(t), model.weights[m + 1 : -1]) + model.weights[-1]
        assert s == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def test_label_model_recovers_accuracies_and_correlations():
    draw = np.random.default_rng(3)
    y = draw.random(4000) < 0.3
    # voters that seldom speak for a clean text, as a lexicon does: abstentions are no evidence
    rates = np.array([[0.01, 0.03, 0.005, 0.02], [0.7, 0.6, 0.5, 0.8]])
    votes = (draw.random((4000, 4)) < np.where(y[:, None], rates[1], rates[0])).astype(float)
    votes = np.hstack([votes, votes[:, :1], votes.sum(axis=1, keepdims=True) == 0])
    posterior, found, corr = toxicity.label_model(votes, np.where(votes[:, :5].sum(axis=1) > 1, 0.9, 0.1))
    assert ((posterior > 0.5) == y).mean() > 0.9
    # abstentions carry no evidence, so rates given label 1 come out low, in the right order
    assert np.abs(found[0, :4] - rates[0]).max() < 0.05 and np.abs(found[1, :4] - rates[1]).max() < 0.2
    assert np.argsort(found[1, :4]).tolist() == np.argsort(rates[1]).tolist()
    assert corr[0, 4] > 0.95 and corr[1, 2] < 0.2


def quality_docs(n):
    draw = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        text, good = prose(draw, draw.randrange(20, 80)), i % 5 != 0
        if not good:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "%%% "), " | ".join(text.split()), " ".join([text.split()[0]] * 40)][i // 5 % 4]
        docs.append((i, text))
        labels.append((i, 0, int(good)))
    return docs, labels


def test_quality_held_out(spark, make, clashing):
    docs, labels = quality_docs(900)
    df = make(docs, **clashing)
    model = quality_classifier.train(df, frame(spark, labels))
    found = {r.doc_id: r.score for r in quality_classifier.quality(df, model).collect()}
    test = [(found[i], q) for i, _, q in labels if held(i, 5, 0)]
    assert np.mean([(s >= 0.3) == bool(q) for s, q in test]) > 0.95
    flipped = [(i, t, 1 - q if held(i, 5, 0) else q) for i, t, q in labels]
    again = quality_classifier.train(df, frame(spark, flipped))
    assert np.allclose(model.vectors, again.vectors, atol=1e-5) and np.allclose(model.network.w1, again.network.w1, atol=1e-3)
    odd = quality_classifier.quality(make([(None, "x"), (1, None), (2, ""), (2, "")]), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd)
    assert quality_classifier.quality(make([]), model).count() == 0


def naive_tokens(text):
    """Words, those of more than 24 bytes in pieces of 8 cut between characters."""
    out = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", text):
        if len(w) <= 24:
            out.append(w)
            continue
        cuts = []
        for c in range(0, len(w), 8):
            while c < len(w) and w[c] & 0xC0 == 0x80:
                c += 1
            cuts.append(c)
        out += [w[i:j] for i, j in zip(cuts, [*cuts[1:], len(w)])]
    return out


ODD = ["a bb a bb c", "bb", "", None, "a c bb d", "日本語のテキストには空白がありません だから切る", "x" * 100 + " " + "é" * 31, " \n "]


def test_tokens_equal_brute_force():
    texts = [(t or "").encode() for t in ODD]
    tokens = quality_classifier.Tokens(texts)
    want = [naive_tokens(t) for t in texts]
    assert tokens.counts.tolist() == list(map(len, want)) and tokens.sizes.tolist() == [len(w) for t in want for w in t]
    known = {}
    for w, h in zip([w for t in want for w in t], tokens.hashes.tolist()):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def naive_vectors(texts):
    """The table of ``word_vectors`` word by word, with the tokens' own fingerprints as their draws."""
    q = quality_classifier
    table = np.zeros((q.VOCABULARY, q.DIMENSIONS + 1))
    for t in texts:
        tokens = q.Tokens([(t or "").encode()])
        entries, (dims, signs) = list(zip(*tokens.entries())), tokens.index_vectors()
        for i, own in enumerate(entries):
            for entry in own:
                table[entry, -1] += 1
                for j in range(max(0, i - q.REACH), min(len(entries), i + q.REACH + 1)):
                    if j != i:
                        for d, s in zip(dims[j], signs[j]):
                            table[entry, d] += s
    v = table[:, :-1] / np.sqrt(table[:, -1:] + 1)
    v = np.sign(v) * np.log1p(np.abs(v))
    v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-6
    return np.hstack([v, np.log1p(table[:, -1:] * 1e6 / max(table[:, -1].sum(), 1)) / 10])


def test_word_vectors_and_scores_equal_brute_force(make):
    want = naive_vectors(ODD)
    found = quality_classifier.word_vectors(make(list(enumerate(ODD))).repartition(7))
    assert np.allclose(found, want, atol=1e-5)
    x = quality_classifier.pooled([(t or "").encode() for t in ODD], found)
    for row, t in zip(x, ODD):
        tokens = quality_classifier.Tokens([(t or "").encode()])
        n = len(tokens.hashes)
        v = [(want[a] + want[b]) / 2 for a, b in zip(*tokens.entries())]
        mean = np.mean(v, axis=0) if n else np.zeros(quality_classifier.DIMENSIONS + 1)
        near = [sum(v[i][:-1] @ v[i + g][:-1] for i in range(n - g)) / max(n, 1) for g in (1, 2)]
        same = [sum(tokens.hashes[i] == tokens.hashes[i + g] for i in range(n - g)) / max(n, 1) for g in (1, 2)]
        size = sum(tokens.sizes.tolist()) / max(n, 1) / 10
        assert np.allclose(row, [*mean, np.linalg.norm(mean[:-1]), *near, *same, size, np.log1p(n) / 10], atol=1e-4), t
    net = quality_classifier.fit(x.astype(float), np.array([0, 1] * 4, float), rounds=20)
    z = [sum(np.tanh(sum((r[i] - net.shift[i]) / net.scale[i] * net.w1[i, h] for i in range(len(r))) + net.b1[h]) * net.w2[h] for h in range(len(net.w2))) + net.b2 for r in x.astype(float)]
    assert np.allclose(net.score(x.astype(float)), 1 / (1 + np.exp(-np.array(z) / net.temperature)))


def test_quality_without_labels(spark, make):
    model = quality_classifier.train(make([(1, "a b")]), frame(spark, [(1, 0, None)]))
    assert [r.score for r in quality_classifier.quality(make([(1, "a b")]), model).collect()] == [0.5]
    assert quality_classifier.train(make([]), frame(spark, [])).network is None


LANGUAGES = {"aa": ("the", "ing", "wh", "and"), "bb": ("ção", "lho", "que", "não"), "cc": ("ung", "sch", "ein", "über")}


def test_languages_held_out(make, clashing):
    draw = random.Random(9)
    docs = [(i, prose(draw, draw.randrange(10, 120), LANGUAGES[lang]), lang) for i, lang in ((i, sorted(LANGUAGES)[i % 3]) for i in range(600))]
    df = make(docs, **clashing)
    net = language_id.train(df)
    found = {r.doc_id: r for r in language_id.identify(df, net).collect()}
    assert np.mean([found[i].lang_pred == lang for i, _, lang in docs if held(i, 4, 2)]) > 0.98
    odd = [(1, None, "aa"), (2, "", "aa"), (3, "12 !?", "aa"), (None, docs[1][1], None), (5, docs[2][1] * 60, None), (5, docs[2][1] * 60, None)]
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in language_id.identify(make(odd), net).collect()))
    assert got == [(0, "bb"), (1, "und"), (2, "und"), (3, "und"), (5, "cc"), (5, "cc")]
    assert language_id.identify(make([]), net).count() == 0
    flipped = make([(i, t, "aa" if held(i, 4, 2) else lang) for i, t, lang in docs])
    assert np.allclose(language_id.train(flipped).filters, net.filters)
    nothing = language_id.train(make([(1, "x", None)]))
    assert nothing is None and [r.lang_pred for r in language_id.identify(make([(1, "x")]), nothing).collect()] == ["und"]


def test_network_equals_naive_convolution():
    draw = np.random.default_rng(5)
    batch = draw.integers(0, 256, (6, language_id.WINDOW)).astype(np.uint8)
    net = language_id.fit(batch, np.array([0, 1, 2, 0, 1, 2]), ["aa", "bb", "cc"], rounds=3, size=4)
    places = language_id.WINDOW - max(language_id.WIDTHS) + 1
    for window, got in zip(batch, net.scores(batch)):
        pooled = []
        for f in range(net.filters.shape[1]):
            width = language_id.WIDTHS[f // language_id.FILTERS]
            kernel = net.filters[:, f].reshape(max(language_id.WIDTHS), language_id.EMBEDDING)
            assert not kernel[width:].any()
            best = max(sum(net.embedding[window[p + k]] @ kernel[k] for k in range(width)) for p in range(places))
            pooled.append(max(best + net.bias[f], 0))
        z = np.array(pooled) @ net.out + net.out_bias
        assert np.allclose(got, z - np.log(np.exp(z).sum()), atol=1e-3)
    text = batch.tobytes()[:700]
    cut, _ = language_id.windows([text])
    mean = net.scores(cut).mean(axis=0)
    best, score = net.predict([text])
    p = np.exp(mean) / np.exp(mean).sum()
    assert best[0] == p.argmax() and score[0] == pytest.approx(p.max(), abs=1e-4)


def test_windows_cover_the_whole_text():
    texts = [b"a" * 256, b"b" * 257, b"c"]
    cut, count = language_id.windows(texts)
    assert count.tolist() == [1, 2, 1] and cut.shape == (4, 256) and (cut == ord("b")).sum() == 257


def test_queries(spark, sf):
    for query, fold in ((toxicity.op1_toxicity, (4, 2)), (quality_classifier.op5_quality_classifier, (5, 0)), (language_id.op8_language_id, (4, 2))):
        found = query(spark, sf).collect()
        assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
        assert all(r.held_out == held(r.doc_id, *fold) and 0 <= r.score <= 1 for r in found)
