"""Ids of the public tokenizers, by pieces that are encoded once and remembered.

Text is cut at single spaces between two other characters, where neither tokenizer joins anything over the cut; each
piece (with its leading space) is encoded by the tokenizers library and its ids are kept in a bounded memo of the worker.
The ids are those of encoding the whole text with add_special_tokens=False; strings of special tokens count as plain text.
"""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers

END_ID = 1
MEMO = 400_000
AT_ONCE = 4096
#: places where a space may belong to a longer run of white space
_RUN = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: marks that both tokenizers cut off from letters before them
_MARKS = frozenset(".,;:!?")
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Text to ids as little-endian 16-bit bytes (every public vocabulary here is below 65,536)."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        # Spark's tasks are the parallelism; the library's threads would only compete with them
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.memo = memo
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: ids do not fit 16 bits")
        self.mark = self.tokenizer.encode(" \x00", add_special_tokens=False).ids
        self.marks = {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u2").tobytes() for c in _MARKS}
        # two generations: what was not asked for since the last turn is forgotten
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        if "\x00" in text:
            return ["\x00" + text]
        cut = _CUT.split(text) if _RUN.search(text) else text.split(" ")
        # the first piece has no space before it; a mark that no other piece has tells it from them
        cut[0] = "\x00" + cut[0]
        return cut

    def _encode_new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces, in one call: pieces with a plain space or nothing at their edges are joined by a mark of known ids."""
        joined, alone = [], []
        for x in pieces:
            (joined if x and "\x00" not in x and not x[0].isspace() and not x[-1].isspace() else alone).append(x)
        out = {}
        for x in alone:
            plain = x[1:] if x[:1] == "\x00" else " " + x
            out[x] = np.array(self.tokenizer.encode(plain, add_special_tokens=False).ids, "<u2").tobytes()
        # a few thousand at a time: the library keeps some hundred bytes per token of a call
        for k in range(0, len(joined), AT_ONCE):
            some = joined[k:k + AT_ONCE]
            # the form without offsets, which nobody asks for here
            found = self.tokenizer.encode_batch_fast(["".join(f" {x} \x00" for x in some)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u2")
            ends = np.flatnonzero(ids == self.mark[-1])
            if len(ends) != len(some):
                raise ValueError("the mark between pieces is not encoded alone")
            begins = np.concatenate([[0], ends[:-1] + 1])
            last = (ends - len(self.mark) + 1).tolist()
            out.update((x, ids[a:b].tobytes()) for x, a, b in zip(some, begins.tolist(), last, strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pieces = [self._pieces(t) if t else [] for t in texts]
        get = self.young.get
        found = [list(map(get, p)) for p in pieces]
        missing = {x for p, f in zip(pieces, found, strict=True) if None in f for x, y in zip(p, f, strict=True) if y is None}
        if missing:
            known = {x: y for x in missing if (y := self.old.get(x)) is not None}
            new = [x for x in missing if x not in known]
            # a letter and the mark after it are never one token: such pieces are made of the ids of both
            split = [x for x in new if x[-1:] in _MARKS and x[-2:-1].isalpha()]
            bases = {x[:-1] for x in split}
            for x in list(bases):
                ids = get(x) or self.old.get(x)
                if ids is not None:
                    known[x] = ids
            whole = [x for x in new if not (x[-1:] in _MARKS and x[-2:-1].isalpha())]
            known.update(self._encode_new([x for x in {*whole, *bases} if x not in known]))
            for x in split:
                known[x] = known[x[:-1]] + self.marks[x[-1]]
            found = [[known[x] if y is None else y for x, y in zip(p, f, strict=True)] if None in f else f
                     for p, f in zip(pieces, found, strict=True)]
            if len(self.young) + len(known) > self.memo // 2:
                self.old, self.young = self.young, {}
            self.young.update(known)
        return [b"".join(f) for f in found]


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """The worker's encoder for a vocabulary file; kept for the next tasks of the worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, memo)
    return _LOADED[path]


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
