"""SentencePiece encoding by N-best search over the piece lattice, and decoding.

A part of a text (see ``vocabulary``) spans a lattice: nodes are character
positions, edges are pieces of the vocabulary with the model's scores, and a
character without a piece of its own is an edge of byte pieces with a penalty.
A forward Viterbi pass gives every node's best score.  Those scores are exact
heuristics for a backward A* search from the end, which therefore pops complete
segmentations in order of their scores.

The search is linear in a part's length whatever its ties: a node is expanded
N times at most, as its first N pops are its N best ways to the end; an edge is
pushed only if it can belong to one of N distinct segmentations that the
forward scores already prove (the best path with one edge exchanged); and of
equal scores the node nearest to the beginning is popped first.

A text's segmentations combine those of its parts.  Its N best use only the
N - 1 parts whose second segmentation costs least, so A* runs on those alone.

Edge cases: null and empty texts have no pieces and the single segmentation
of score 0; very long parts without spaces are searched in time and memory linear in
their length; of equal scores the segmentation with the longer last piece comes
first, as everywhere in the search; repeated rows get equal results; an empty
table gives an empty table; other columns are not read.  Decoding restores the
text, with the space mark itself read as a space, as the library does.
"""

from __future__ import annotations

import heapq
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm.textcore import mix
from joinwright.llm.vocabulary import MARK, Memo, balanced, model_path, processor
from joinwright.llm.worker import cached, tidy

N_BEST = 4
#: Characters segmented together: larger runs share more words, smaller ones need less memory.
BATCH_CHARS = 1_000_000
MEMO_BYTES = 8 << 20
#: Score of a character without a piece, under the lowest score of the model.
PENALTY = 10.0


_U = np.uint64
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_STEPS = np.array([pow(_STEP, k, 1 << 64) for k in range(65)], _U)


def _code(point: int) -> int:
    """A 64-bit code of a character."""
    return (((point + 1) * 0xD1342543DE82EF95) & _MASK) ^ (point + 7)


def _code_array(points: np.ndarray) -> np.ndarray:
    wide = points.astype(_U)
    return ((wide + _U(1)) * _U(0xD1342543DE82EF95)) ^ (wide + _U(7))


class Pieces:
    """Vocabulary: piece texts, numbers and scores, and the surface of each number."""

    def __init__(self, items: list[tuple[str, int, float]], byte_ids: list[int], n_ids: int):
        self.items, self.byte_ids = sorted(items), byte_ids
        # runs of space marks have a score far outside the trained range
        self.unknown = min((s for _, _, s in items if s > -1e8), default=0.0) - PENALTY
        self.surface: list[bytes] = [b""] * n_ids
        for text, number, _ in items:
            self.surface[number] = text.replace(MARK, " ").encode()
        for value, number in enumerate(byte_ids):
            self.surface[number] = bytes([value])

    @classmethod
    def load(cls, path: str) -> Pieces:
        model = processor(path)
        n = model.get_piece_size()
        byte_ids = [i for i in range(n) if model.is_byte(i)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        return cls([(model.id_to_piece(i), i, model.get_score(i)) for i in plain], byte_ids, n)

    def decode(self, ids) -> bytes:
        """Text of piece numbers, without the library's leading space."""
        out = b"".join([self.surface[i] for i in ids])
        return out[1:] if out[:1] == b" " else out


class Lattice:
    """One part's lattice: its edges in flat arrays, ordered by end and then by start.

    Edges into node v are ``cut[v]:cut[v + 1]``; piece -1 spells the character's bytes.
    """

    #: Nodes whose edges are looked up, or turned into Python numbers, at a time.
    BLOCK = 1 << 14

    def __init__(self, table: PieceTable, part: str):
        self.table, self.text = table, part.replace(" ", MARK)
        chars = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        n = self.n = len(chars)
        starts, ends, scores, pieces = [], [], [], []
        for a in range(0, n, self.BLOCK):
            for k, at, score, piece in table.matches(chars, a, min(a + self.BLOCK, n)):
                starts.append(at.astype(np.int32))
                ends.append((at + k).astype(np.int32))
                scores.append(score)
                pieces.append(piece)
        start, end = np.concatenate(starts), np.concatenate(ends)
        order = np.lexsort((start, end))
        self.start, self.score, self.piece = start[order], np.concatenate(scores)[order], np.concatenate(pieces)[order]
        self.cut = np.searchsorted(end[order], np.arange(n + 2))
        self._forward()

    def _forward(self) -> None:
        """Viterbi: the best score of each node and the edge by which it is reached; of equal ones the longest."""
        forward, back = array("d", [0.0]), array("q", [-1])
        for a in range(1, self.n + 1, self.BLOCK):
            b = min(a + self.BLOCK, self.n + 1)
            low, high = self.cut[a], self.cut[b]
            edges = zip(self.start[low:high].tolist(), self.score[low:high].tolist(), range(low, high), strict=True)
            for count in np.diff(self.cut[a : b + 1]).tolist():
                top, pick = -np.inf, -1
                for start, score, edge in islice(edges, count):
                    total = forward[start] + score
                    if total > top:
                        top, pick = total, edge
                forward.append(top)
                back.append(pick)
        self.forward, self.back = forward, back
        path, at = [], self.n
        while at:
            path.append(back[at])
            at = int(self.start[back[at]])
        #: Edges of the best path, from the end.
        self.path = np.array(path, np.int64)

    def exchanges(self) -> np.ndarray:
        """Score of the best path with one of its edges exchanged and the best beginning before that, best first.

        The n-th best segmentation scores no less than the n-th of these with the
        best path before them, and the second best is the first of them.
        """
        ends = np.append(self.n, self.start[self.path][:-1]).astype(np.int64)
        behind = np.append(0.0, np.cumsum(self.score[self.path])[:-1])
        counts = self.cut[ends + 1] - self.cut[ends]
        edge = np.repeat(self.cut[ends], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        total = np.repeat(behind, counts) + self.score[edge] + np.frombuffer(self.forward)[self.start[edge]]
        return -np.sort(-total[edge != np.repeat(self.path, counts)])

    def spell(self, edges: list[int]) -> tuple[int, ...]:
        """Piece numbers of edges given in reading order."""
        out: list[int] = []
        for edge, piece in zip(edges, self.piece[edges].tolist(), strict=True):
            if piece >= 0:
                out.append(piece)
            else:
                out += [int(self.table.byte_ids[b]) for b in self.text[self.start[edge]].encode()]
        return tuple(out)

    def best(self) -> tuple[tuple[int, ...], float, float]:
        """Best segmentation, its score, and how much the second one costs more."""
        others = self.exchanges()
        top = self.forward[self.n]
        return self.spell(self.path[::-1].tolist()), top, top - others[0] if len(others) else np.inf

    def n_best(self, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations as (score, pieces), by backward A*; the first is that of ``best``."""
        others = self.exchanges()
        bound = others[n - 2] if 1 < n <= len(others) + 1 else -np.inf if n > 1 else self.forward[self.n]
        bound -= 1e-9 * (1 + abs(bound)) if bound > -np.inf else 0
        forward, cut = self.forward, self.cut
        # (minus the score of the best complete path, node, order, score so far, path to the end)
        heap: list[tuple] = [(-forward[self.n], self.n, 0, 0.0, None)]
        pops: dict[int, int] = {}
        found, order = [], 0
        while heap and len(found) < n:
            _, node, _, so_far, path = heapq.heappop(heap)
            if node == 0:
                steps = []
                while path:
                    steps.append(path[0])
                    path = path[1]
                found.append((so_far, steps))
                continue
            times = pops[node] = pops.get(node, 0) + 1
            if times > n:
                continue
            low, high = int(cut[node]), int(cut[node + 1])
            for edge, start, score in zip(range(low, high), self.start[low:high].tolist(), self.score[low:high].tolist(), strict=True):
                total = so_far + score
                reach = total + forward[start]
                if reach >= bound:
                    order += 1
                    heapq.heappush(heap, (-reach, start, order, total, (edge, path)))
        # sums taken from the end may order equal scores in another way than those of the forward pass
        first = self.path[::-1].tolist()
        at = next((i for i, (_, steps) in enumerate(found) if steps == first), len(found) - 1)
        found = [(self.forward[self.n], first), *found[:at], *found[at + 1 :]]
        return [(score, self.spell(steps)) for score, steps in found]


class PieceTable:
    """Pieces by the polynomial hash of their characters, for whole arrays at once."""

    BITS = 21

    def __init__(self, pieces: Pieces):
        items = pieces.items
        self.longest = max((len(t) for t, _, _ in items), default=1)
        hashes = np.zeros(len(items), _U)
        for i, (text, _, _) in enumerate(items):
            h = 0
            for ch in text:
                h = (h * _STEP + _code(ord(ch))) & _MASK
            hashes[i] = h
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        self.hash, self.number = np.append(hashes, _U(0)), np.array([*(i for _, i, _ in items), -1], np.int32)
        self.score = np.array([*(s for _, _, s in items), -np.inf])
        # slot of each piece in a first table, and of those that found it taken in a second one
        self.tables, rest = [], np.arange(len(items))
        for shift in (64 - self.BITS, 64 - 2 * self.BITS):
            slot = self._slot(hashes[rest], shift)
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << self.BITS, len(items), np.int32)
            table[slot[first]] = rest[first]
            self.tables.append((shift, table))
            rest = np.delete(rest, first)
        if len(rest):
            raise ValueError("pieces collide in both tables")
        self.unknown = pieces.unknown
        self.byte_ids = np.array(pieces.byte_ids, np.int32)

    def _slot(self, hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((mix(hashes) >> _U(shift)) & _U((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash; the last index stands for none."""
        none = len(self.hash) - 1
        mixed = mix(hashes)
        mask = _U((1 << self.BITS) - 1)
        out = np.full(hashes.shape, none, np.int32)
        for shift, table in self.tables:
            at = table[((mixed >> _U(shift)) & mask).astype(np.int64)]
            hit = (at < none) & (self.hash[at] == hashes)
            out[hit] = at[hit]
        return out

    def matches(self, chars: np.ndarray, a: int, b: int):
        """(length, starts, scores, pieces) of the edges that start in a..b-1; a character without a piece has piece -1."""
        none = len(self.hash) - 1
        codes = _code_array(chars[a : b + self.longest - 1])
        hashes = np.zeros(len(codes), _U)
        for k in range(1, min(self.longest, len(chars) - a) + 1):
            hashes = hashes[: len(codes) - k + 1] * _U(_STEP) + codes[k - 1 :]
            found = self.find(hashes[: b - a])
            if k == 1:
                yield 1, np.arange(a, a + len(found)), np.where(found == none, self.unknown, self.score[found]), self.number[found]
            else:
                at = np.flatnonzero(found != none)
                yield k, at + a, self.score[found[at]], self.number[found[at]]

    def best(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best segmentations of equally long parts, a row of code points each.

        Returns pieces in reading order, right-aligned in an (n, length) array
        with -1 before them, their number, the best score, and how much the
        second segmentation costs more.  Rows with a character that needs
        several byte pieces get score NaN.
        """
        n, length = chars.shape
        chars = np.ascontiguousarray(chars.T)
        chars[chars == 32] = ord(MARK)
        width = min(self.longest, length)
        codes, none = _code_array(chars), len(self.hash) - 1
        # edges[start][k - 1]: rows (all: a full slice), scores and pieces of length k from start
        edges: list[list] = [[] for _ in range(length)]
        hashes = np.zeros((length, n), _U)
        for k in range(1, width + 1):
            hashes = hashes[: length - k + 1] * _U(_STEP) + codes[k - 1 :]
            found = self.find(hashes)
            if k == 1:
                lone = found == none
                number = np.where(lone, self.byte_ids[np.minimum(chars, 255)], self.number[found])
                score = np.where(lone, self.unknown, self.score[found])
                broken = (lone & (chars >= 0x80)).any(axis=0)
                for start in range(length):
                    edges[start].append((slice(None), score[start], number[start]))
            else:
                at, row = np.nonzero(found != none)
                hit = found[at, row]
                cuts = np.searchsorted(at, np.arange(len(found) + 1))
                score, number = self.score[hit], self.number[hit]
                for start in range(len(found)):
                    part = slice(cuts[start], cuts[start + 1])
                    edges[start].append((row[part], score[part], number[part]))

        forward = np.full((length + 1, n), -np.inf)
        forward[0] = 0
        step = np.ones((length + 1, n), np.int32)
        piece = np.zeros((length + 1, n), np.int32)
        for end in range(1, length + 1):
            top = forward[end]
            for k in range(min(width, end), 0, -1):
                rows, score, number = edges[end - k][k - 1]
                if not len(score):
                    continue
                # as in Lattice: of equal totals the longest last piece stays
                total = forward[end - k][rows] + score
                better = total > top[rows]
                chosen = np.flatnonzero(better) if k == 1 else rows[better]
                top[chosen] = total[better]
                step[end][chosen] = k
                piece[end][chosen] = number[better]
        after = np.full((length + 1, n), -np.inf)
        after[length] = 0
        for start in range(length - 1, -1, -1):
            here = after[start]
            for k, (rows, score, _) in enumerate(edges[start], 1):
                if len(score):
                    here[rows] = np.maximum(here[rows], score + after[start + k][rows])
        # walk back from the end; used[start] is the length of the best path's piece there
        rows = np.arange(n)
        used = np.zeros((length, n), np.int32)
        ids = np.full((n, length), -1, np.int32)
        count = np.zeros(n, np.int64)
        at = np.full(n, length)
        while len(rows):
            count[rows] += 1
            ids[rows, length - count[rows]] = piece[at, rows]
            k = step[at, rows]
            at = at - k
            used[at, rows] = k
            going = at > 0
            rows, at = rows[going], at[going]
        second = np.full(n, -np.inf)
        for start in range(length):
            for k, (rows, score, _) in enumerate(edges[start], 1):
                if len(score):
                    total = forward[start][rows] + score + after[start + k][rows]
                    total[used[start][rows] == k] = -np.inf
                    second[rows] = np.maximum(second[rows], total)
        top = forward[length].copy()
        top[broken] = np.nan
        return ids, count, top, forward[length] - second


class Encoder:
    """Best and N-best segmentations of whole texts."""

    #: Parts longer than this have a lattice of their own; shorter ones of equal length are searched together.
    LONG = 64

    def __init__(self, pieces: Pieces, n: int = N_BEST):
        self.pieces, self.n = pieces, n
        self.table = PieceTable(pieces)
        self.lists = Memo(lambda new: [Lattice(self.table, p).n_best(n) for p in new], MEMO_BYTES, lambda found: sum(100 + 28 * len(ids) for _, ids in found))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[np.ndarray]]]:
        """Best segmentations end to end, their lengths by text, and by text the scores and pieces of the N best."""
        bodies = [" " + t.replace(MARK, " ") if t else "" for t in texts]
        whole = "".join(bodies)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies)))])
        if not len(chars):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), [[0.0] for _ in texts], [[np.zeros(0, np.int32)] for _ in texts]
        # a part starts at each text and at each space after another character
        space = chars == 32
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[begin[:-1][np.diff(begin) > 0]] = True
        starts = np.flatnonzero(opens)
        lengths = np.diff(np.append(starts, len(chars)))
        first = np.searchsorted(starts, begin)

        offset = np.minimum(np.arange(len(chars)) - np.repeat(starts, lengths), self.LONG)
        keys = mix(np.add.reduceat(_code_array(chars) * _STEPS[offset], starts) + lengths.astype(_U))
        long = np.flatnonzero(lengths > self.LONG)
        keys[long] = mix(long.astype(_U) + _U(1))
        _, unique, of = np.unique(keys, return_index=True, return_inverse=True)
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(unique)
        count, score, extra = np.zeros(len(unique), np.int64), np.zeros(len(unique)), np.zeros(len(unique))
        scalar = [np.flatnonzero(lengths[unique] > self.LONG)]
        flat: list[np.ndarray] = []
        where, base = np.zeros(len(unique), np.int64), 0
        for size in np.unique(lengths[unique]):
            if size > self.LONG:
                break
            same = np.flatnonzero(lengths[unique] == size)
            step = max(1, (1 << 18) // int(size))
            for a in range(0, len(same), step):
                mine = same[a : a + step]
                found, n, top, more = self.table.best(chars[starts[unique[mine]][:, None] + np.arange(size)])
                scalar.append(mine[np.isnan(top)])
                count[mine], score[mine], extra[mine] = n, top, more
                where[mine] = base + np.cumsum(n) - n
                flat.append(found[found >= 0])
                base += len(flat[-1])
        for u in np.concatenate(scalar):
            at = int(starts[unique[u]])
            found, score[u], extra[u] = Lattice(self.table, whole[at : at + int(lengths[unique[u]])]).best()
            count[u], where[u] = len(found), base
            flat.append(np.array(found, np.int32))
            base += len(found)
        pool = np.concatenate(flat)
        n_part = count[of]
        at = np.repeat(where[of] - (np.cumsum(n_part) - n_part), n_part) + np.arange(int(n_part.sum()))
        ends = np.concatenate([[0], np.cumsum(n_part)])
        best = pool[at]
        scores, paths = self._lists(whole, starts, lengths, first, score[of], extra[of], best, ends)
        return best, ends[first[1:]] - ends[first[:-1]], scores, paths

    def _lists(self, whole, starts, lengths, first, score, extra, best, ends) -> tuple[list[list[float]], list[list[np.ndarray]]]:
        """Scores and pieces of the N best by text, from its parts' best scores, second costs and N-best lists."""
        near = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            m = min(self.n - 1, b - a)
            least = a + (np.argpartition(extra[a:b], m - 1)[:m] if 0 < m < b - a else np.arange(m))
            near.append(sorted(int(i) for i in least if extra[i] < np.inf))
        lists = iter(self.lists([whole[starts[i] : starts[i] + lengths[i]] for mine in near for i in mine]))
        scores, paths = [], []
        for a, b, mine in zip(first[:-1], first[1:], near, strict=True):
            # (cost, choices): which segmentation of each part of ``mine``
            combos: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
            choices = [next(lists) for _ in mine]
            for found in choices:
                combos = heapq.nsmallest(self.n, [(cost + max(0.0, found[0][0] - s), (*chosen, c)) for cost, chosen in combos for c, (s, _) in enumerate(found)])
            total = float(score[a:b].sum())
            scores.append([total - cost for cost, _ in combos])
            mine_paths = []
            for _, chosen in combos:
                pieces, at = [], ends[a]
                for i, c, found in zip(mine, chosen, choices, strict=True):
                    if c:
                        pieces += [best[at : ends[i]], np.array(found[c][1], np.int32)]
                        at = ends[i + 1]
                mine_paths.append(np.concatenate([*pieces, best[at : ends[b]]]) if pieces else best[ends[a] : ends[b]])
            paths.append(mine_paths)
        return scores, paths


@cached
def encoder(path: str, n: int = N_BEST) -> Encoder:
    return Encoder(Pieces.load(path), n)


SCHEMA = "doc_id bigint, ids array<int>, scores array<double>, n_best array<array<int>>, round_trip boolean"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, n: int = N_BEST) -> DataFrame:
    """(doc_id, ids, scores, n_best, round_trip) for each row.

    ids are the pieces of the best segmentation, scores and n_best the scores and
    pieces of the ``n`` best (fewer if there are fewer), the best first;
    round_trip tells whether decoding ids gives the text.
    """
    path = path or model_path()

    def run(batches):
        coder = encoder(path, n)
        decode = coder.pieces.decode
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for a, b in balanced(sizes, BATCH_CHARS):
                # only one run's texts are held at a time
                texts = batch.column(1).slice(a, b - a).to_pylist()
                flat, lengths, scores, paths = coder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                numbers = flat.tolist()
                same = [decode(numbers[i:j]) == (t or "").encode() for i, j, t in zip(offsets[:-1], offsets[1:], texts, strict=True)]
                every = [x for mine in paths for x in mine]
                inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, every)]).astype(np.int32)), pa.array(np.concatenate(every) if every else np.zeros(0, np.int32)))
                outer = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, paths)]).astype(np.int32)), inner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(scores, pa.list_(pa.float64())), outer, pa.array(same)],
                    names=["doc_id", "ids", "scores", "n_best", "round_trip"],
                )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run, "encoder"), SCHEMA)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) of piece numbers; null ids give null, and bytes that are no UTF-8 the replacement character."""
    path = path or model_path()

    def run(batches):
        pieces = encoder(path).pieces
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(tidy(run, "encoder"), "doc_id bigint, text string")


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of pieces of the best segmentation, digests and scores of the four best, round trip."""
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.xxhash64("ids").alias("ids_digest")
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), digest, F.col("scores").alias("n_best_scores"), F.transform("n_best", lambda x: F.xxhash64(x)).alias("n_best_digests"), "round_trip")
