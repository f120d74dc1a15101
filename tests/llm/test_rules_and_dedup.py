"""Quality rules, near duplicates and repeated passages against brute force."""

import random
import re

import numpy as np
from checks import rows, same

from joinwright.llm import near_dedup, quality_rules, runs, suffix_dedup
from joinwright.llm.components import components
from joinwright.llm.textcore import Words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def prose(draw, n, size=30):
    return " ".join(f"w{draw.randrange(size)}" for _ in range(n))


ODD = ["", None, " \t\n\v\f\r ", "one", "é x  y", "a\nb\n\nb\nb ", "\x1c a \x1f"]


def test_words_and_fingerprints():
    texts = [(t or "").encode() for t in ODD] + [b"aa ab aa", b"aa"]
    found = Words(texts)
    split = [[found.buf[a:b].tobytes() for a, b in zip(found.starts[i:j], found.ends[i:j])] for i, j in zip(found.first, found.first[1:])]
    assert split == [WORD.findall(t) for t in texts]
    by_word = {}
    for w, h in zip([w for s in split for w in s], found.hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def brute_rules(text):
    w = words_of(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    at = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    longest = 0
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            longest = max(longest, k)
    failed = len(w) < 20 or 100 * len(at) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(at), sum(len(w[i]) for i in at), longest if longest >= 8 else 0, failed)


def test_rules_equal_brute_force(make, clashing):
    draw = random.Random(1)
    texts = [*ODD, "# | <a> $5 & 100%"]
    for _ in range(25):
        part = prose(draw, draw.randrange(4, 20))
        texts.append("\n".join([prose(draw, draw.randrange(0, 60)), part, prose(draw, draw.randrange(0, 30)), part, part[: draw.randrange(len(part))]]))
    found = quality_rules.quality_rules(make(list(enumerate(texts)), **clashing)).select("doc_id", "quality_rules.*").collect()
    for r in found:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_chars, r.longest_repeat, r.base_failed)
        assert got == brute_rules(texts[r.doc_id]), texts[r.doc_id]
        assert r.covered_words == r.n_repeat_words and r.kept == (not r.base_failed and 100 * r.covered_chars <= 30 * r.word_chars)


def test_rules_reject_one_long_repeat(make):
    once = " ".join(f"u{i}" for i in range(160))
    text = once + " " + " ".join(f"v{i}" for i in range(1500)) + " " + once
    r = quality_rules.quality_rules(make([(1, text), (1, text), (None, text)])).select("quality_rules.*").collect()
    assert len(r) == 3 and all(x.longest_repeat == 160 and not x.base_failed and not x.kept for x in r)


def test_rules_reject_repeats_of_many_characters(make):
    once = " ".join(f"characterful{i}" for i in range(10))
    rest = " ".join(f"v{i}" for i in range(60))
    long, short = f"{once} {rest} {once}", f"{' '.join(f'c{i}' for i in range(10))} {rest} {' '.join(f'c{i}' for i in range(10))}"
    found = {r.doc_id: r.quality_rules for r in quality_rules.quality_rules(make([(1, long), (2, short)])).collect()}
    assert all(q.n_repeat_words == 20 and not q.base_failed and q.longest_repeat == 10 for q in found.values())
    assert not found[1].kept and found[2].kept


def test_rules_of_very_long_texts(make):
    texts = ["a b c d e f g h i j " * 20_000, " ".join(f"u{i}" for i in range(200_000)), "x" * 1_000_000]
    found = {r.doc_id: r.quality_rules for r in quality_rules.quality_rules(make(list(enumerate(texts)))).collect()}
    assert (found[0].n_repeat_words, found[0].longest_repeat, found[1].n_repeat_words, found[2].n_words) == (200_000, 199_990, 0, 1)


def test_rules_query(spark, sf, oracle):
    same(quality_rules.op3_quality_rules(spark, sf), oracle(quality_rules.ORACLE))


def shingles(text, k, fold):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "") if fold else text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(docs, k, percent):
    sets = {i: shingles(t, k, True) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(draw, n, words):
    base = [f"x{draw.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(draw.randrange(0, 8)):
            copy[draw.randrange(words)] = f"y{draw.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_near_duplicates_equal_brute_force(make, clashing):
    draw = random.Random(2)
    texts = [*[t for t in ODD if t], "", "one", "ONE", "a b", "a b", "a b c d"]
    for words in (30, 60, 120, 200):
        texts += near_copies(draw, 30, words)
    draw.shuffle(texts)
    docs = list(enumerate(texts))
    for k, percent in ((3, 85), (5, 80)):
        want = brute_components(docs, k, percent)
        found = near_dedup.near_duplicates(make(docs, **clashing), shingle=k, percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(docs)


def test_near_duplicates_nulls_repeats_empty(make):
    df = make([(None, "a b c"), (None, None), (3, None), (5, "a b c d"), (5, "a b c d"), (7, "A B c d")])
    found = near_dedup.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in found), key=repr) == sorted([(None, None, True), (None, None, True), (3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False)], key=repr)
    assert near_dedup.near_duplicates(make([])).count() == 0
    assert near_dedup.drop_near_duplicates(df).columns == df.columns
    assert sorted(r.doc_id or 0 for r in near_dedup.drop_near_duplicates(df).collect()) == [0, 0, 3, 5, 5]


def test_blocks_lose_no_pair(make, monkeypatch):
    draw = random.Random(4)
    docs = list(enumerate(near_copies(draw, 120, 40)))
    monkeypatch.setattr(near_dedup, "LEAST_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "MOST_BLOCK", 16)
    found = near_dedup.near_duplicates(make(docs), shingle=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: c for i, (_, c) in brute_components(docs, 3, 85).items()}


def test_odd_sketch_estimates():
    draw = np.random.default_rng(0)
    for size in (20, 150, 600, 2000, 20000):
        errors = []
        for _ in range(60 if size < 5000 else 15):
            a = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            cut = int(size * 0.92)
            b = np.unique(np.concatenate([a[draw.permutation(len(a))[:cut]], draw.integers(0, 1 << 63, size - cut, dtype=np.uint64) * np.uint64(2)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            (s, n), (t, m) = near_dedup.Signer.odd_sketch(a), near_dedup.Signer.odd_sketch(b)
            args = np.frombuffer(s, np.uint64), n, len(a), np.frombuffer(t, np.uint64)[None], np.array([m]), np.array([len(b)])
            errors.append(near_dedup.similar(*args)[0] - true)
            assert near_dedup.may_link(*args, true)[0]
        allowed = near_dedup.slack(2.0 * size, 0.85)
        assert np.abs(errors).max() < allowed < 0.1 and abs(np.mean(errors)) < allowed / 4, size


def test_small_sets_at_the_threshold_may_link():
    draw = np.random.default_rng(7)

    def kept(a, b, threshold):
        (s, n), (t, m) = near_dedup.Signer.odd_sketch(a), near_dedup.Signer.odd_sketch(b)
        return near_dedup.may_link(np.frombuffer(s, np.uint64), n, len(a), np.frombuffer(t, np.uint64)[None], np.array([m]), np.array([len(b)]), threshold)[0]

    for union, threshold in ((5, 0.8), (20, 0.8), (20, 0.85), (40, 0.85), (100, 0.85), (300, 0.8), (500, 0.85)):
        alone = round(union * (1 - threshold))
        for _ in range(2000 if union < 50 else 200):
            x = np.unique(draw.integers(0, 1 << 64, union, dtype=np.uint64))
            gone = draw.permutation(len(x))[:alone]
            cut = draw.integers(0, alone + 1)
            assert kept(np.delete(x, gone[:cut]), np.delete(x, gone[cut:]), threshold), union
        # every shingle of one set alone comes before a common one in its bin
        bins = np.arange(union - alone, dtype=np.uint64) << np.uint64(54)
        common = bins + np.uint64(1 << 50) + draw.integers(0, 1 << 40, len(bins), dtype=np.uint64)
        extra = bins[:alone] + draw.integers(0, 1 << 40, alone, dtype=np.uint64)
        assert kept(np.sort(np.concatenate([common, extra])), common, threshold), union
    a, b = (np.unique(draw.integers(0, 1 << 64, 200, dtype=np.uint64)) for _ in range(2))
    assert not kept(a, b, 0.8)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (200, 201), (200, 201), (300, 300)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def test_near_dedup_query(spark, sf, oracle):
    same(near_dedup.op9_near_dedup(spark, sf), oracle(near_dedup.ORACLE))


def brute_repeats(docs, n):
    """Spans of windows that start earlier elsewhere: {(doc, start, end, source)}."""
    first, marked = {}, {}
    for doc, text in sorted(docs):
        w = words_of(text)
        for i in range(len(w) - n + 1):
            win = tuple(w[i : i + n])
            if win in first and first[win] != (doc, i):
                marked.setdefault(doc, []).append((i, first[win][0]))
            first.setdefault(win, (doc, i))
    out = set()
    for doc, found in marked.items():
        span = None
        for i, source in found:
            if span and i <= span[1]:
                span = (span[0], i + n, min(span[2], source))
            else:
                if span:
                    out.add((doc, *span))
                span = (i, i + n, source)
        out.add((doc, *span))
    return out


def spans(df):
    return {(r.doc_id, s.start_word, s.end_word, s.source_doc_id) for r in df.collect() for s in r.spans}


def test_repeats_equal_brute_force(make, clashing):
    draw = random.Random(6)
    passages = [prose(draw, n, 10**6) for n in (16, 20, 24, 45, 80)]
    docs = []
    for i in range(60):
        parts = [prose(draw, draw.randrange(0, 30), 10**6)]
        for _ in range(draw.randrange(0, 4)):
            p = draw.choice(passages).split()
            a = draw.randrange(0, 4)
            parts += [" ".join(p[a : len(p) - draw.randrange(0, 4)]), prose(draw, draw.randrange(0, 10), 10**6)]
        docs.append((i, "\n".join(parts)))
    docs += [(60, "r " * 70), (61, "r s " * 40), (62, None), (63, ""), (64, docs[3][1])]
    for n in (16, 20):
        assert spans(suffix_dedup.repeated_passages(make(docs, **clashing), min_words=n)) == brute_repeats([(i, t) for i, t in docs if t], n)


def test_repeats_are_cut(make):
    passage = " ".join(f"p{i}" for i in range(55))
    df = make([(1, f"intro {passage} end"), (2, f"other\n{passage}\nrest"), (3, passage), (None, passage), (4, None), (4, "x"), (5, f"a {passage}"), (5, f"a {passage}")], spans="mine")
    found = suffix_dedup.remove_repeats(df)
    assert found.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.spans) for r in found.collect()), key=repr)
    assert got == sorted([(1, f"intro {passage} end", "mine"), (2, "other\nrest", "mine"), (3, "", "mine"), (None, passage, "mine"), (4, None, "mine"), (4, "x", "mine"), (5, "a ", "mine"), (5, "a ", "mine")], key=repr)
    assert suffix_dedup.remove_repeats(make([])).count() == 0


def test_sorted_runs_equal_brute_force(spark):
    draw = random.Random(8)
    keys = [(1, 1, 1)] * 300 + [(1, 2, draw.randrange(3)) for _ in range(60)] + [(draw.randrange(40), draw.randrange(2), 0) for _ in range(120)] + [(-7, 5, 5)] * 40
    data = [(*k, i % 97, -i, i * 3, i) for i, k in enumerate(keys)]
    data += data[:20]
    df = spark.createDataFrame(data, ", ".join(f"{c} bigint" for c in runs.COLUMNS)).repartition(3)
    first, groups = {}, {}
    for r in data:
        first[r[:3]] = min(first.get(r[:3], r[3:6]), r[3:6])
        groups.setdefault(r[0], []).append(r[:3])
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for partitions in (1, 7, 60):
        try:
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
            found, table = runs.sorted_runs(df)
            got = [tuple(r) for r in found.select(*runs.COLUMNS, *runs.HEAD, "copy", "varied", "q0").collect()]
            assert partitions == 1 or table.select("part").distinct().count() > partitions // 2
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            spark.conf.set("spark.sql.shuffle.partitions", before[0])
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
        assert all(r[7:10] == first[r[:3]] and r[10] == (r[3:6] != first[r[:3]]) for r in got)
        want = [r for r in data if len(groups[r[0]]) > 1]
        assert sorted(r[:7] for r in got if len(groups[r[0]]) > 1) == sorted(want) and len(got) - len(want) <= 2 * partitions
        for key in first:
            run = sorted(r[3] for r in data if r[:3] == key)
            assert len(run) < 2 or sorted(((r[3], r[12]) for r in got if r[:3] == key), key=repr) == sorted(zip(run, [None, *run]), key=repr)
        assert {r[:3] for r in got if r[11]} == {k for k in first if len(set(groups[k[0]])) > 1}
    empty, _ = runs.sorted_runs(df.limit(0))
    assert empty.count() == 0


def test_repeats_in_texts_of_odd_white_space_and_great_length(make):
    passage = [f"p{i}" for i in range(60)]
    texts = ["\n\t" + "  ".join(passage) + "\r\n", "x " + "\x0b".join(passage), " ".join(f"u{i % 5003}" for i in range(40_000))]
    found = suffix_dedup.repeated_passages(make(list(enumerate(texts))))
    assert spans(found) == {(1, 1, 61, 0), (2, 5003, 40_000, 2)}
    cut = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(make(list(enumerate(texts)))).collect()}
    assert cut == {0: texts[0], 1: "x ", 2: " ".join(f"u{i}" for i in range(5003)) + " "}


def test_suffix_query(spark, sf, oracle):
    same(suffix_dedup.op2_suffix_dedup(spark, sf), oracle(suffix_dedup.ORACLE))
