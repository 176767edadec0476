"""Byte-level BPE ids of whole texts, by the public `tokenizers` library.

The library encodes about 2.5 MB a second and core, and a corpus repeats its
words. So a text is cut. Pieces of this pre-tokenizer are white space alone or a
run of other characters with at most one space before it, so none crosses from
anything else to white space, and the ids of a text are those of its cuts, made at
such places, in order. Where all white space between cuts is a single space, the
text is split at spaces; with longer runs a cut takes the run before it along. Each
distinct cut goes through the library's BPE model once and its ids are kept, in a
cache bounded by bytes. Texts with characters beyond Latin, of which libraries may
disagree what class they are, and those that hold one of the tokenizer's added tokens
(which are single ids wherever they stand), go to the library itself, cut into parts of PART
characters at such places; of a longer run without white space the part is as long.
"""

from __future__ import annotations

import gc
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import regex

from evigraph.llm.common import sole

#: Bytes of cuts and ids, with ENTRY for each, that a cache holds of new ones; and as many of older ones.
CACHE, ENTRY = 32 << 20, 150
#: Characters that go to the library in one piece, and in one call.
PART, CALL = 20_000, 200_000
#: Cuts of more characters aren't kept.
LONG = 200
#: Characters beyond Latin, and those whose class as white space differs between libraries.
_ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]")
_CONTROLS = "\x1c\x1d\x1e\x1f"
_TAILS = frozenset(".,!?;:")
#: A word and the marks, a piece of their own, behind it.
_ENDED = re.compile(r"([^\W\d_]+)([^\w\s]+)")
_BREAK = re.compile(r"\S(?=\s)")
_CUT = re.compile(r"\s*\S+|\s+")
#: The pre-tokenizer's pattern, and the characters that stand for bytes in the vocabulary.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One for each worker process, so that tasks share what was encoded before."""
    return sole(("encoder", path, cache), lambda: Encoder(path, cache))


class Encoder:
    """encode(texts) gives the ids of each as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache: int = CACHE):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        #: Whether a cut at white space could part such a token from what it takes along.
        self.uncut = any(t.lstrip or t.rstrip or t.single_word or t.content != "".join(t.content.split()) for t in added)
        self.first = _Cuts(self.tok.model, "", cache)
        self.later = _Cuts(self.tok.model, " ", cache, self.first)
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are laid out for little-endian machines with 32-bit ints")

    def whole(self, texts: list[str]) -> list[bytes]:
        """By the library alone. It takes about 100 bytes for a token while it runs, so it is called for few parts at a time."""
        parts = [(k, part) for k, t in enumerate(texts) for part in ([t] if self.uncut else _parts(t))]
        out: list[list[bytes]] = [[] for _ in texts]
        at = 0
        while at < len(parts):
            stop, size = at + 1, len(parts[at][1])
            while stop < len(parts) and size + len(parts[stop][1]) <= CALL:
                size += len(parts[stop][1])
                stop += 1
            for (k, _), e in zip(parts[at:stop], self.tok.encode_batch([p for _, p in parts[at:stop]], add_special_tokens=False), strict=True):
                out[k].append(np.asarray(e.ids, "<u4").tobytes())
            at = stop
        return [b"".join(x) for x in out]

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if (any(c in t for c in _CONTROLS) if t.isascii() else _ODD.search(t)) or any(a in t for a in self.added)]
        rest = dict(zip(odd, self.whole([texts[i] for i in odd]), strict=True))
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and a collection would walk the cache
        try:
            return [rest[i] if i in rest else self._cuts(t) for i, t in enumerate(texts)]
        finally:
            if collects:
                gc.enable()

    def _cuts(self, text: str) -> bytes:
        if not text:
            return b""
        self.first.turn()
        self.later.turn()
        if "  " in text or text[-1] == " ":
            first, later = self.first, self.later
            return b"".join([later[c[1:]] if c[0] == " " and len(c) > 1 and not c[1].isspace() else first[c] for c in _CUT.findall(text)])
        head, *later = text.split(" ")
        return (self.first[head] if head else b"") + b"".join(map(self.later.__getitem__, later))


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about PART characters, each beginning with white space that follows something else."""
    at = 0
    while len(text) - at > PART:
        found = _BREAK.search(text, at + PART)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    if at < len(text):
        yield text[at:]


class _Cuts(dict):
    """The ids of cuts, made when first asked for; keys are cuts without the space before them.
    When the new ones take `most` bytes they become the older ones, and the ones before are forgotten."""

    def __init__(self, model, before: str, most: int, first: _Cuts | None = None):
        self.tokenize, self.before, self.mapped = model.tokenize, before, before.translate(_BYTE)
        self.most, self.size, self.older = most, 0, {}
        self.first = self if first is None else first
        self.marks = {c: self._piece(c) for c in _TAILS}
        self.newline = self._piece("\n".translate(_BYTE))

    def turn(self) -> None:
        if self.size > self.most:
            self.older = dict(self)
            self.clear()
            self.size = 0

    def __missing__(self, cut: str) -> bytes:
        # cuts of a likely known word and what follows it hardly come again, so they are put together each time
        if cut[-1:] in self.marks and cut[:-1].isalpha():
            return self[cut[:-1]] + self.marks[cut[-1]]
        ids = self.older.get(cut)
        if ids is None:
            if cut.isalpha():
                ids = self._piece(self.mapped + (cut if cut.isascii() else cut.encode().decode("latin-1").translate(_BYTE)))
            elif "\n" in cut and (parts := cut.split("\n")) == cut.split():
                # single line ends between words are pieces of their own
                return self[parts[0]] + b"".join([self.newline + self.first[x] for x in parts[1:]])
            elif (ended := _ENDED.fullmatch(cut)) and ended[1].isalpha():
                return self[ended[1]] + self.first[ended[2]]
            else:
                ids = b"".join([self._piece(x.encode().decode("latin-1").translate(_BYTE)) for x in _PIECE.findall(self.before + cut)])
            if len(cut) > LONG:
                return ids
        self[cut] = ids
        self.size += ENTRY + len(cut) + len(ids)
        return ids

    def _piece(self, mapped: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()
