"""Tokens of whole texts by a `tokenizers` file, remembering what pieces of text between safe cuts encode to.

A cut is safe where the file's pre-tokenizer always ends a token: before a run of
ASCII white space, and between a Latin letter and a comma or full stop. So a text's
tokens are those of its pieces in order, and pieces repeat a great deal. Texts
with a special token's string, or with white space outside ASCII, are encoded whole.

A worker keeps its tokenizer and what it remembers of pieces between tasks, in two generations of bounded size: a full one
becomes the older one, whose pieces come back as they are met, and the rest goes with the next change.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Latin letters whose lower case is one letter (U+0130 becomes two characters).
_LETTERS = "[A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x12F), (0x131, 0x24F))) + "]+"
_PIECES = re.compile(rf"[ \t\n\r\x0b\x0c]*{_LETTERS}(?=[,.])|[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
_ODD_SPACE = re.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")

#: In lower case: a letter before a comma or full stop makes the cut safe; this finds the other cases.
_ODD_STOP = re.compile("[^a-z0-9ß-öø-ÿ \n\t\r][,.]")
#: Pieces that are one token before merging, whatever the pre-tokenizer: runs of Latin-1 letters, after one blank at most.
_SIMPLE = {True: re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+"), False: re.compile("[a-zß-öø-ÿ]+")}

#: Pieces in each of the two generations that one Python worker remembers, and the longest of them in characters. Beyond, pieces are encoded anew.
REMEMBERED, LONGEST = 300_000, 64


class Encoder:
    """One worker's tokenizer and its remembered pieces.

    white_space: whether white space gives tokens; if not, the tokenizer must take upper case as lower case.
    """

    def __init__(self, path: str, white_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # the same merges, for simple pieces, without rules that change nothing there
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.white_space, self.simple = white_space, _SIMPLE[white_space].fullmatch
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def _split(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special):
            return None
        if self.white_space:
            return None if not text.isascii() and _ODD_SPACE.search(text) else _PIECES.findall(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None if _ODD_SPACE.search(text) else [x.lstrip(" \t\n\r\x0b\x0c") for x in _PIECES.findall(text)]
        text = text.lower()
        if _ODD_STOP.search(text) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None if _ODD_SPACE.search(text) else [x.lstrip(" \t\n\r\x0b\x0c") for x in _PIECES.findall(text)]
        return text.replace(",", " ,").replace(".", " .").split()

    def _learn(self, pieces: list[list[str] | None], value) -> list[str]:
        """Have the values of these pieces in `known`; value(ids, bounds) makes them. Returns those too long to be remembered, which the caller takes out again."""
        seen = set().union(*(p for p in pieces if p))
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        todo: tuple[list[str], list[str]] = ([], [])
        for x in seen:
            if x not in known:
                if x in older:
                    known[x] = older[x]
                else:
                    todo[self.simple(x) is not None].append(x)
        for tokenizer, missing in zip((self.tokenizer, self.merges), todo, strict=True):
            for i in range(0, len(missing), 50_000):
                part = missing[i : i + 50_000]
                got = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                bounds = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(part) + 1))
                known.update(zip(part, value(np.array(got.ids, np.uint32), bounds), strict=True))
        return [x for missing in todo for x in missing if len(x) > LONGEST]

    def _each(self, texts: list[str], value, one, joined) -> list:
        """joined(values of a text's pieces) of each text, or one(text) where it has none."""
        pieces = [self._split(t) for t in texts]
        long = self._learn(pieces, value)
        of = self.known.__getitem__
        out = [one(t) if p is None else joined(map(of, p)) for t, p in zip(texts, pieces, strict=True)]
        for x in long:
            del self.known[x]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        return self._each(texts, lambda ids, bounds: np.diff(bounds).tolist(), lambda t: len(self.tokenizer.encode(t, add_special_tokens=False).ids), sum)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""

        def cut(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
            raw, at = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
            return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

        return self._each(texts, cut, lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), b"".join)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, white_space: bool) -> Encoder:
    """This worker's encoder for a file; it outlives a task."""
    key = (path, white_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, white_space)
    return _encoders[key]


def slices(texts: list[str], characters: int = 1 << 20):
    """Consecutive texts of about so many characters together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= characters:
            yield part
            part, size = [], 0
    if part:
        yield part
