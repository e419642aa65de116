"""Whole texts to token ids with the ``tokenizers`` library, one word at a time and remembered.

Both supported kinds of tokenizer never merge across the start of a white-space run, so the ids of
a text are those of its words, each with the white space before it. Words recur, so each worker
keeps what the library gave for a word; a bound on the kept words keeps its memory bounded.
"""

from __future__ import annotations

import re
from array import array

#: Unicode's White_Space characters.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
RARE = [c for c in SPACES if c not in " \n"]
#: Letters below this go to the library's BPE model without its own splitting.
LATIN_TO_CYRILLIC = "\u0530"
#: Words that a worker remembers.
KEPT = 400_000
#: ASCII without letters: what may follow the letters of a word.
NO_LETTERS = "".join(c for c in map(chr, range(128)) if not c.isalpha())


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE: itself if printable in Latin-1, else the next free letter from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class Words(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of ``' ' + word``."""

    def __init__(self, path: str):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.model = self.library.model
        self.byte_level = self.library.normalizer is None
        self.lead = " " if self.byte_level else ""
        self.letters = byte_letters()
        self.space = self.lead.translate(self.letters)
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tails: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.odd: set[str] = set()  # kept words of letters that the library must see whole

    def plain(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, stem: str) -> bytes | None:
        """Ids of a run of letters: one pre-token, so it goes to the library's BPE model as it is.

        None if the library's normalisation makes it something else than letters.
        """
        if not self.byte_level:
            if not stem.isascii() and max(stem) >= LATIN_TO_CYRILLIC:
                return None
            stem = self.library.normalizer.normalize_str(stem)
            if not stem.isalpha():
                return None
        if stem.isascii():
            spelt = self.space + stem  # ASCII letters stand for themselves
        elif max(stem) < LATIN_TO_CYRILLIC:
            spelt = self.space + stem.encode("utf-8").decode("latin-1").translate(self.letters)
        else:
            return None
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            got = self._letters(word)
            if got is None:
                got = self.plain(self.lead + word)
                if len(self) < KEPT:
                    self.odd.add(word)
        else:
            got = self._joined(word)
        if len(self) < KEPT:
            self[word] = got
        return got

    def _joined(self, word: str) -> bytes:
        """Ids of a word that is more than letters: of its letters and what follows them, where no pre-token holds both."""
        stem = word.rstrip(NO_LETTERS)
        if stem.isalpha():
            got = None if stem in self.odd else self.get(stem)
            if got is None:
                got = self._letters(stem)
                if got is not None and len(self) < KEPT:
                    self[stem] = got
            if got is not None:
                return got + self._tail(word[len(stem) :])
        head, line, last = stem.partition("\n")
        if line and last.isalpha() and head and not head[-1].isspace():
            # A line feed between other characters than white space is a pre-token of its own.
            ends = word[len(head) + 1 :]
            if not self.byte_level:
                return self[head] + self[ends]
            return self[head] + self._tail(line) + self._first(ends)
        return self.plain(self.lead + word)

    def _first(self, word: str) -> bytes:
        """Ids of letters, and what follows them, without white space before them."""
        got = self.firsts.get(word)
        if got is None:
            stem = word.rstrip(NO_LETTERS)
            if stem.isascii():
                got = array("I", [t.id for t in self.model.tokenize(stem)]).tobytes()
                got += self._tail(word[len(stem) :]) if len(stem) < len(word) else b""
            else:
                got = self.plain(word)
            if len(self.firsts) < KEPT // 10:
                self.firsts[word] = got
        return got

    def _tail(self, tail: str) -> bytes:
        """Ids of what follows a word's last letter; no pre-token holds both sides unless an apostrophe starts it."""
        got = self.tails.get(tail)
        if got is None:
            got = self.plain(tail)
            if len(self.tails) < KEPT // 10:
                self.tails[tail] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text without special tokens, as the library gives them."""
        if not text:
            return b""
        if any(m in text for m in self.marks):
            return self.plain(text)
        if "  " not in text and "\n " not in text and not any(c in text for c in RARE):
            first, *rest = text.split(" ")
            return (self.plain(first) if first else b"") + b"".join(map(self.__getitem__, rest))
        if not self.byte_level:
            return b"".join(map(self.__getitem__, (c for c in re.split(f"[{SPACES}]+", text) if c)))
        return b"".join(self[c[1:]] if c[0] == " " and c[1:2] not in ("", *SPACES) else self.plain(c) for c in CHUNK.findall(text))


_LOADED: dict[str, Words] = {}


def words_for(path: str) -> Words:
    """This worker's tokenizer for ``path``, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]
