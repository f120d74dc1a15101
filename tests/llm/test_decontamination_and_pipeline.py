"""Template decontamination and the pipeline against brute force."""

import random
import re

import corpus_pipeline
from joinwright.llm import decontamination, near_dedup, piece_lattice
from joinwright.llm.decontamination import Template, contaminated, drop_contaminated


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def prose(draw, n):
    return " ".join("".join(draw.choice("bcdfgmnprst") + draw.choice("aeiou") for _ in range(3)) for _ in range(n))


def found(df):
    return {(r.doc_id, r.item_id): r.kind for r in df.collect()}


QUESTION = "A train leaves with Anna Smith at 40 km per hour and travels 3.5 hours. How far did Anna Smith go in 3.5 hours at 40 km?"


def test_template_tokens():
    t = Template([b"He met Anna Smith. Then 3,500.5 km or 12 apples; NASA x", b"", b"5 km"])
    marks = ["" if p else "*" for p in t.plain]
    # he met <name> then <number> <unit> or <number> apples nasa x
    assert marks == ["", "", "*", "", "*", "*", "", "*", "", "", "", "*", "*"]
    assert t.first.tolist() == [0, 11, 11, 13]


def test_reparameterised_copies_are_caught(spark, make, clashing):
    draw = random.Random(3)
    bench = items(spark, [(1, QUESTION), (2, prose(draw, 30)), (3, "is it so then"), (4, None), (5, ""), (None, prose(draw, 20)), (6, "1 2 3 4 5 6 7 8 9")])
    second = bench.where("item_id = 2").first().text
    new = QUESTION.replace("Anna Smith", "Bob").replace("40", "65").replace("3.5", "2")
    torn = QUESTION.replace("Anna Smith at 40", "Bob at 65")
    docs = [
        (1, f"{prose(draw, 30)}. {QUESTION} {prose(draw, 9)}"), (2, f"{prose(draw, 30)}. {new}"), (3, torn), (4, f"{prose(draw, 5)} {second.upper()} {prose(draw, 5)}"),
        (5, prose(draw, 300)), (6, None), (7, ""), (8, "well is it so then"), (9, "1 2 3 4 5 6 7 8 9 10"), (None, QUESTION), (1, f"{prose(draw, 30)}. {QUESTION}"), (10, " ".join(second.split()[:10])),
        (11, QUESTION.replace(" and travels", ", slowly, and travels")),
    ]
    df = make(docs, **clashing)
    assert found(contaminated(df, bench)) == {(1, 1): "verbatim", (2, 1): "reparameterised", (4, 2): "verbatim", (8, 3): "verbatim", (11, 1): "verbatim"}
    assert sorted(r.doc_id or 0 for r in drop_contaminated(df, bench).collect()) == [0, 3, 5, 6, 7, 9, 10]
    assert drop_contaminated(df, bench).columns == df.columns
    assert contaminated(make([]), bench).count() == 0 and contaminated(df, items(spark, [])).count() == 0


WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
CAPITAL = re.compile(rb"[A-Z]([a-z]|[\x80-\xff])|\xc3[\x80-\x9e].", re.S)
BREAK = re.compile(rb"[.!?:;\n\"]")


def brute_tokens(text):
    """(mark or word, value, first word, last word) of each token, and the words: by the rules in the module's docstring."""
    raw = text.encode()
    words = list(WORD.finditer(raw))
    tokens = []
    for i, m in enumerate(words):
        gap = raw[words[i - 1].end() : m.start()] if i else b"."
        number = m.group()[:1].isdigit()
        name = bool(CAPITAL.match(m.group())) and i > 0 and not BREAK.search(gap)
        kind = "NUMBER" if number else "NAME" if name else None
        before = (bool(words[i - 1].group()[:1].isdigit()), brute_name(raw, words, i - 1)) if i else (False, False)
        if (number and before[0] and gap in (b".", b",")) or (name and before[1] and gap == b" "):
            tokens[-1][3] = i
        else:
            tokens.append([kind, None, i, i])
    for t in tokens:
        t[1] = b" ".join(w.group().lower() if w.group().isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w.group()) for w in words[t[2] : t[3] + 1])
    for one, two in zip(tokens, tokens[1:]):
        if one[0] == "NUMBER" and two[1].decode(errors="replace") in decontamination.UNITS and two[0] != "NUMBER":
            two[0] = "UNIT"
    return tokens, [bytes(b + 32 if 65 <= b <= 90 else b for b in w.group()) for w in words]


def brute_name(raw, words, i):
    return bool(CAPITAL.match(words[i].group())) and i > 0 and not BREAK.search(raw[words[i - 1].end() : words[i].start()])


def brute_contaminated(docs, bench, least=0.5):
    """{(doc, item): (coverage, kind)} with every window of every document compared with every item's."""
    out = {}
    doc_side = []
    for doc, text in docs:
        tokens, words = brute_tokens(text)
        marks, index = [t[0] or t[1] for t in tokens], {}
        for k in range(4, 9):
            for i in range(len(tokens) - k + 1):
                index.setdefault(("t", tuple(marks[i : i + k])), []).append(i)
        owner = [n for n, t in enumerate(tokens) for _ in range(t[2], t[3] + 1)]
        for k in range(1, 9):
            for i in range(len(words) - k + 1):
                index.setdefault(("w", tuple(words[i : i + k])), []).append(owner[i + k - 1])
        doc_side.append((doc, tokens, index))
    for item, text in bench:
        tokens, words = brute_tokens(text)
        n, plain = len(tokens), [t[0] is None for t in tokens]
        owner = [j for j, t in enumerate(tokens) for _ in range(t[2], t[3] + 1)]
        wanted = []
        k = min(8, n)
        for i in range(n - k + 1 if k >= 4 else 0):
            if sum(plain[i : i + k]) >= 4:
                wanted.append((("t", tuple(t[0] or t[1] for t in tokens[i : i + k])), i, range(i, i + k), True))
        k = min(8, len(words))
        for i in range(len(words) - k + 1 if any(plain) else 0):
            if sum(plain[owner[x]] for x in range(i, i + k)) < 4 or n <= 8:
                inside = [j for j in range(n) if tokens[j][2] >= i and tokens[j][3] < i + k] or ([owner[i]] if owner[i] == owner[i + k - 1] else [])
                if inside:
                    wanted.append((("w", tuple(words[i : i + k])), owner[i + k - 1], inside, False))
        for doc, mine, index in doc_side:
            runs = {}
            for key, at, covered, template in wanted:
                for there in index.get(key, ()):
                    cover, bound = runs.setdefault(there - at, (set(), set()))
                    cover.update(covered)
                    bound.update((tokens[j][1], mine[there + j - at][1] if template else tokens[j][1]) for j in covered if not plain[j])
            good = [r for r in runs.values() if len(r[1]) == len({a for a, _ in r[1]}) == len({b for _, b in r[1]})]
            cover = set().union(*(c for c, _ in good))
            if n and cover and len(cover) >= least * n:
                out[doc, item] = (round(len(cover) / n, 6), "verbatim" if all(a == b for _, r in good for a, b in r) else "reparameterised")
    return out


def check(docs, bench, least=0.5):
    got = {(r.doc_id, r.item_id): (round(r.coverage, 6), r.kind) for r in contaminated(docs, bench, min_coverage=least).collect()}
    want = brute_contaminated([(r.doc_id, r.text) for r in docs.collect() if r.text], [(r.item_id, r.text) for r in bench.collect() if r.text], least)
    assert got == want
    return got


def test_tables_equal_brute_force(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert check(docs, bench) and check(docs, bench, 0.1)


def test_odd_texts_equal_brute_force(spark, make):
    draw = random.Random(21)
    pool = ["Anna", "Bob Lee", "Émile", "12", "3.5", "1,200", "km", "hours", "goes", "from", "the", "to", "store", "with", "Paris", "7", "eggs", ".", "?", ",", "dollars", "NASA", "über", "x"]
    # fragments that many items share, so that common windows are set aside
    shared = [" ".join(draw.choice(pool) for _ in range(14)) for _ in range(4)]
    texts = [" ".join(draw.choice([*pool, *shared]) for _ in range(draw.randrange(1, 14))) for _ in range(60)]
    bench = items(spark, list(enumerate(texts)))
    docs = []
    for i in range(120):
        parts = [draw.choice([draw.choice(texts), draw.choice(shared), " ".join(draw.choice(pool) for _ in range(6))]) for _ in range(4)]
        text = " ".join(parts)
        for old, new in (("Anna", "Zoe"), ("12", "45"), ("3.5", "12"), ("Paris", "Rome")):
            text = text.replace(old, new, draw.randrange(3)) if draw.random() < 0.3 else text
        docs.append((i, text))
    for least in (0.2, 0.5, 0.9):
        kinds = [k for _, k in check(make(docs), bench, least).values()]
        assert kinds.count("verbatim") > 20 and kinds.count("reparameterised") > 5


def test_repeated_fragments_count_once(spark, make):
    draw = random.Random(11)
    words = prose(draw, 59).split()
    bench = items(spark, [(1, " ".join(words))])
    fragment, rest = " ".join(words[20:30]), " ".join(words[35:55])
    docs = make([(1, " ".join(f"{fragment} {prose(draw, 5)}" for _ in range(3))), (2, f"{fragment} {prose(draw, 5)} {rest}"), (3, f"{fragment} {prose(draw, 3)} " * 40)])
    assert {(r.doc_id, r.item_id, round(r.coverage, 4)) for r in contaminated(docs, bench).collect()} == {(2, 1, round(30 / 59, 4))}
    assert {(r.doc_id, round(r.coverage, 4)) for r in contaminated(docs, bench, min_coverage=0.1).collect()} == {(1, round(10 / 59, 4)), (2, round(30 / 59, 4)), (3, round(10 / 59, 4))}


def test_verbatim_items_of_few_plain_words_are_caught(spark, make):
    draw = random.Random(12)
    texts = ["Compute 12 + 34 * 56 - 78 / 9 = ?", "Is it so then", "Paris Texas", "Anna Smith went home", "Add 1,2,3,4,5,6,7,8,9,10,11 now", "List 4 8 15 16 23 42 5 7 11 13 17 19 29 31"]
    bench = items(spark, list(enumerate(texts)))
    docs = make([(i, f"{prose(draw, 9)} He asked Bob, {t} {prose(draw, 9)}") for i, t in enumerate(texts)] + [(10, f"He told Bob {texts[3]}"), (11, "Compute 12 + 34 * 56 - 78 / 8 = ?"), (12, prose(draw, 40))])
    assert found(contaminated(docs, bench)) == {**{(i, i): "verbatim" for i in range(len(texts))}, (10, 3): "verbatim"}


def test_pipeline_stages(spark, sf):
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == names, name
        kept.append({r.doc_id for r in docs.collect()})
        assert kept[-1] <= kept[-2]
    again = near_dedup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet").where("doc_id in (" + ",".join(map(str, kept[2])) + ")"))
    assert {r.kept for r in again.collect()} == {True}
    assert kept[3] == kept[2] and all(r.n_chars == len(r.text) for r in docs.collect())
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert contaminated(docs, bench).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    decoded = {r.doc_id: r.text for r in piece_lattice.decode(last).collect()}
    assert decoded == {r.doc_id: r.text for r in docs.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id").collect())) == sorted((i,) for i in kept[4])


def test_pipeline_takes_nulls_and_empty_tables(spark, make, sf):
    for rows in ([], [(None, None, None), (1, None, None), (2, "", None), (None, "a b", "en")]):
        docs = make(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf).cache()
            docs.collect()
