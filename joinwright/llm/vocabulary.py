"""SentencePiece models by path, loaded once per process, and safe cuts of a text.

In the models used here a piece holds the space mark only at its start or is a
run of marks, so no piece and no merge crosses the place before a run of spaces.
A text with the library's leading space may be cut there, and its segmentation
is the segmentations of the parts laid end to end.  ``processor`` checks the
vocabulary for this when it is loaded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from joinwright.llm.worker import cached

MARK = "▁"
#: Parts of a text that starts with a space: spaces with the word after them.
PART = re.compile(" +[^ ]*")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of a public vocabulary file; a parameter, never a copy in this tree."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cached
def processor(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {i} holds a space mark inside a word; texts cannot be cut before spaces")
    if model.encode("a", out_type=str)[0][0] != MARK or model.encode("  a", out_type=str)[-1] != MARK + "a":
        raise ValueError("the model folds spaces or adds no leading space")
    return model


def parts(text: str) -> list[str]:
    """Safe parts of a non-empty text, the leading space included."""
    return PART.findall(" " + text.replace(MARK, " "))


class Memo:
    """Bounded memo of a function over parts: two generations of at most ``size`` bytes each.

    A part of more than ``KEPT`` characters is computed each time it comes.
    """

    KEPT = 64
    #: Estimate of an entry's bytes beside its key's characters and its value's ``weight``.
    ENTRY = 200

    def __init__(self, compute: Callable[[list[str]], list], size: int, weight: Callable[[object], int] = lambda value: 0):
        self.compute, self.size, self.weight = compute, size, weight
        self.young: dict = {}
        self.old: dict = {}
        self.bytes = 0

    def __call__(self, keys: list[str]) -> list:
        """Values of ``keys`` in order; misses are computed once, together."""
        get = self.young.get
        values = list(map(get, keys))
        if None in values:
            missing = {k for k, v in zip(keys, values, strict=True) if v is None}
            fresh = {}
            for k in missing & self.old.keys():
                fresh[k] = self.old[k]
            unknown = list(missing - fresh.keys())
            fresh.update(zip(unknown, self.compute(unknown), strict=True))
            values = [fresh[k] if v is None else v for k, v in zip(keys, values, strict=True)]
            for k, v in fresh.items():
                if len(k) > self.KEPT:
                    continue
                more = self.ENTRY + 4 * len(k) + self.weight(v)
                if self.bytes + more > self.size:
                    self.old, self.young, self.bytes = self.young, {}, 0
                if more <= self.size:
                    self.young[k] = v
                    self.bytes += more
        return values


def balanced(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about ``limit``; a larger row is a run of its own."""
    at, size, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at <= i:
        yield at, i + 1
