"""Token counts, piece lattice, sharding."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from checks import same

from joinwright.llm import piece_lattice, sharding, token_counts
from joinwright.llm.vocabulary import Memo, balanced, model_path, processor

BITS = [" ", "  ", "a", "the", "\n", "▁", "\t", "é", "\x00", "<s>", "</s>", "日本", "👍", "<unk>", "<0x0A>", "ﬁ", "x" * 70]


def samples(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(BITS) for _ in range(draw.randrange(12))) for _ in range(n)]


def test_counts_equal_the_library(make, corpus, clashing):
    texts = [*samples(400), *(t for _, t in corpus), None, "", " ", "word " * 30000]
    found = {r.doc_id: r for r in token_counts.token_counts(make(list(enumerate(texts)), **clashing)).collect()}
    model = processor(model_path())
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((t or "").encode()), n, n > 4096)


def test_counts_of_empty_and_repeated_rows(make):
    assert token_counts.token_counts(make([])).count() == 0
    assert [tuple(r) for r in token_counts.token_counts(make([(None, "a"), (None, "a")])).collect()] == [(None, 1, 1, False)] * 2


def test_long_texts_are_cut_at_safe_boundaries():
    model = processor(model_path())
    texts = [*samples(600, 5), " a" * 50, "a  " * 50, " " * 40]
    for limit in (1, 3, 10):
        assert token_counts.count_tokens(texts, model_path(), 60, limit) == [len(model.encode(t)) for t in texts]
        assert all("".join(token_counts.safe_parts(t, limit)[:1]) == t[: len(token_counts.safe_parts(t, limit)[0])] for t in texts)
    long = "word and more words " * 40000
    assert max(map(len, token_counts.safe_parts(long))) <= token_counts.PART_CHARS + 8


def test_memo_is_bounded():
    calls = []
    memo = Memo(lambda new: calls.append(len(new)) or [len(k) for k in new], 10 * 220)
    for _ in range(3):
        keys = [str(i) for i in range(0, 200, 7)] + ["1", "1", "y" * 500]
        for a in range(0, len(keys), 4):
            assert memo(keys[a : a + 4]) == [len(k) for k in keys[a : a + 4]]
    assert 0 < len(memo.young) <= 10 and len(memo.old) <= 10 and not any(len(k) > Memo.KEPT for k in (*memo.young, *memo.old))


def test_batches_are_balanced():
    sizes = [3, 9, 1, 1, 0, 20, 2]
    runs = list(balanced(sizes, 10))
    assert runs == [(0, 1), (1, 3), (3, 5), (5, 6), (6, 7)] and list(balanced([], 5)) == []


def toy(pieces):
    return piece_lattice.Pieces([(p, 256 + i, s) for i, (p, s) in enumerate(pieces.items())], list(range(256)), 256 + len(pieces))


PLAIN = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.9, "▁a": -3.5, "ba": -4.25, "aab": -6.0}
#: Every way to cut a run scores the same.
TIED = {"▁": -1.0, "a": -1.0, "b": -1.0, "aa": -2.0, "ab": -2.0, "ba": -2.0, "bab": -3.0, "▁a": -2.0, "▁b": -2.5}


def all_segmentations(pieces, text):
    """(score, pieces) of every path of a lattice, best first."""
    coder = toy(pieces)
    text = text.replace(" ", "▁")
    number = {p: 256 + i for i, p in enumerate(pieces)}

    def walk(at):
        if at == len(text):
            yield 0.0, ()
        for end in range(at + 1, len(text) + 1):
            part = text[at:end]
            if part in pieces:
                yield from ((pieces[part] + s, (number[part], *rest)) for s, rest in walk(end))
            elif end == at + 1:
                yield from ((coder.unknown + s, (*part.encode(), *rest)) for s, rest in walk(end))

    return sorted(walk(0), reverse=True)


def check_list(found, every, n):
    """The n best scores, each with a segmentation of that score, none twice."""
    assert [s for s, _ in found] == pytest.approx([s for s, _ in every[:n]])
    scores = dict((ids, s) for s, ids in every)
    assert all(scores[tuple(ids)] == pytest.approx(s) for s, ids in found) and len({tuple(ids) for _, ids in found}) == len(found)


@pytest.mark.parametrize("pieces", [PLAIN, TIED])
def test_n_best_equals_enumeration(pieces):
    coder = piece_lattice.Encoder(toy(pieces), 5)
    for n in range(1, 6):
        for chars in itertools.product("abé ", repeat=n):
            text = "".join(chars)
            flat, counts, scores, paths = coder.encode([text])
            check_list(list(zip(scores[0], [p.tolist() for p in paths[0]])), all_segmentations(pieces, " " + text), 5)
            assert paths[0][0].tolist() == flat.tolist() and counts[0] == len(flat)
            assert {coder.pieces.decode(p.tolist()).decode() for p in paths[0]} == {text}
    for part in (" aabab", " bbaab", " aaaabab", " bababab"):
        every, lattice = all_segmentations(pieces, part), piece_lattice.Lattice(coder.table, part)
        for n in (1, 2, 3, 4, 10, 1000):
            check_list(lattice.n_best(n), every, n)
        ids, score, extra = lattice.best()
        assert score == pytest.approx(every[0][0]) and extra == pytest.approx(every[0][0] - every[1][0]) and lattice.n_best(3)[0][1] == ids


def test_search_is_linear_on_ties_and_long_parts():
    import time

    coder = piece_lattice.encoder(model_path())
    draw = random.Random(4)
    for text in ("jjjnwy" * 1000, "".join(draw.choice("abcXYZ0189") for _ in range(60_000)), "a" * 100_000):
        began = time.process_time()
        flat, _, scores, paths = coder.encode([text])
        assert time.process_time() - began < 20
        assert len(scores[0]) == len({tuple(p.tolist()) for p in paths[0]}) == 4 and {coder.pieces.decode(p.tolist()).decode() for p in paths[0]} == {text}


def test_arrays_equal_the_lattice_of_one_part(corpus):
    coder = piece_lattice.encoder(model_path())
    texts = [t for _, t in corpus[:40]] + samples(60)
    flat, counts, scores, _ = coder.encode(texts)
    ends = np.cumsum(counts)
    from joinwright.llm.vocabulary import parts

    for text, a, b, s in zip(texts, ends - counts, ends, scores):
        best = [piece_lattice.Lattice(coder.table, p).best() for p in (parts(text) if text else [])]
        assert flat[a:b].tolist() == [i for ids, _, _ in best for i in ids]
        assert s[0] == pytest.approx(sum(x for _, x, _ in best)) and s == sorted(s, reverse=True)
        assert processor(model_path()).decode(flat[a:b].tolist()) == coder.pieces.decode(flat[a:b]).decode() or "▁" in text or text[:1] == " "


def test_encode_and_decode_round_trip(make, corpus, clashing):
    texts = [*samples(200, 3), *(t for _, t in corpus[:60]), None, "", "y" * 5000]
    df = make(list(enumerate(texts)), **clashing)
    encoded = piece_lattice.encode(df).cache()
    for r in encoded.collect():
        assert r.round_trip == ("▁" not in (texts[r.doc_id] or "")) and len(r.scores) == len(r.n_best) <= piece_lattice.N_BEST
        assert r.n_best[0] == r.ids
    decoded = {r.doc_id: r.text for r in piece_lattice.decode(encoded).collect()}
    assert decoded == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert piece_lattice.encode(make([])).count() == 0


def test_lattice_query(spark, sf):
    found = piece_lattice.op10_piece_lattice(spark, sf).collect()
    assert all(r.round_trip and len(r.n_best_scores) == len(set(r.n_best_digests)) == 4 for r in found if r.n_pieces > 4)


def test_shards(make, clashing):
    df = make([(i, f"t{i}") for i in range(4000)] + [(None, None), (5, ""), (5, "")], **clashing)
    found = sharding.assign(df).collect()
    shards = {}
    for r in found:
        assert r.size in ({16} if r.doc_id is None else {16, 17 + len(str(r.doc_id))}) and r.grown_shard in (r.shard, 40)
        shards.setdefault(r.shard, []).append(r.slot)
    assert len(found) == 4003 and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert len(shards) == 40 and 60 <= min(map(len, shards.values())) and max(map(len, shards.values())) <= 145
    assert len({r.shard for r in found if r.doc_id == 5}) == 1
    assert sharding.assign(make([])).count() == 0


def brute_place(key, weights, new_weight=None):
    """Region, rack and shard of a key, and its shard once one more has joined."""
    import hashlib
    import math

    def first(node, children):
        times = {}
        for c, w in children.items():
            digest = hashlib.md5(f"{key}:{node}/{c // 4}".encode()).hexdigest()
            times[c] = -math.log((int(digest[8 * (c % 4) : 8 * (c % 4) + 8], 16) + 0.5) / 2**32) / w
        return min(times, key=times.get), times

    total = {}
    for s, w in enumerate(weights):
        for node in (("r", s // 20), ("k", s // 4), ("s", s)):
            total[node] = total.get(node, 0) + w
    regions = {r: total["r", r] for r in range(-(-len(weights) // 20)) if total["r", r]}
    region, times = first("", regions)
    rack, _ = first(f"r{region}", {k: total["k", k] for k in range(5 * region, 5 * region + 5) if total.get(("k", k))})
    shard, _ = first(f"k{rack}", {s: total["s", s] for s in range(4 * rack, 4 * rack + 4) if total.get(("s", s))})
    new = max(len(weights) // 20, max(regions) + 1)
    moves = new_weight and first("", {new: new_weight})[1][new] < times[region]
    return region, rack, shard, len(weights) if moves else shard


def test_descent_equals_brute_force(make):
    df = make([(i, "x") for i in range(1500)])
    draw = random.Random(2)
    for weights in ([1.0] * 40, [draw.choice([0.0, 0.5, 1.0, 4.0]) for _ in range(40)], [2.0] * 7, [1.0] * 46):
        for r in sharding.assign(df, weights, new_weight=1.5).collect():
            assert (r.region, r.rack, r.shard, r.grown_shard) == brute_place(r.doc_id, weights, 1.5)
    grown = {r.doc_id: r.grown_shard for r in sharding.assign(df).collect()}
    assert grown == {r.doc_id: r.shard for r in sharding.assign(df, [1.0] * 41).collect()} and 40 in grown.values()
    for bad in ([-1.0, 1.0], [0.0]):
        with pytest.raises(ValueError):
            sharding.assign(df, bad)


def test_weights_confine_movement(make):
    df = make([(i, "x") for i in range(6000)])

    def places(weights):
        return {r.doc_id: (r.region, r.rack, r.shard) for r in sharding.assign(df, weights).collect()}

    even = places([1.0] * 40)
    shares = [Counter(p[level] for p in even.values()) for level in range(3)]
    assert [len(s) for s in shares] == [2, 10, 40] and all(0.55 < n * len(s) / 6000 < 1.5 for s in shares for n in s.values())
    for weight in (3.0, 0.0):
        other = places([1.0] * 13 + [weight] + [1.0] * 26)
        moved = {i: (even[i], other[i]) for i in even if even[i] != other[i]}
        # shard 13 lies in region 0, rack 3
        for before, after in moved.values():
            if before[0] != after[0]:
                assert (after if weight else before)[0] == 0
            elif before[1] != after[1]:
                assert before[0] == 0 and (after if weight else before)[1] == 3
            else:
                assert before[1] == 3 and (after if weight else before)[2] == 13
        assert {b[0] != a[0] for b, a in moved.values()} == {b[1] != a[1] for b, a in moved.values()} == {True, False}
    # rows in the other region that stay there keep rack and shard
    assert 13 not in {p[2] for p in other.values()}


def test_slots_of_rows_that_share_an_id_are_spread(make):
    found = sharding.assign(make([(None, f"t{i}") for i in range(300)] + [(7, "same")] * 20)).collect()
    for key in (None, 7):
        mine = [r for r in found if r.doc_id == key]
        assert len({r.shard for r in mine}) == 1
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_query(spark, sf, oracle):
    same(sharding.op6_sharding(spark, sf), oracle(sharding.ORACLE))
