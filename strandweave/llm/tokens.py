"""Token ids and counts from the ``tokenizers`` library, with each distinct word encoded once.

The vocabulary file is a parameter.  Encoders live in the Python worker, one per file, and
remember the pieces they have met lately, up to a fixed number.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

REMEMBERED = 300_000  # pieces an encoder keeps, a bound on its memory

# The code points with the Unicode property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ATOM = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WORD = re.compile("[^\\t-\\r ]+")
_CONTROL = re.compile("[\\x1c-\\x1f]")  # str.split() takes them for white space


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


LATIN = 0x250  # end of the Latin blocks
_MARKS = ".,!?;:*#$%&|"  # marks that end a word; an apostrophe may begin a contraction

_loaded: dict[tuple[type, str], object] = {}


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell the letters of the Latin blocks.

    Printable bytes (33..126, 161..172, 174..255) stand for themselves, the others for the
    code points from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    spelled = [chr(b if b in plain else next(others)) for b in range(256)]
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(LATIN)}


class _Remembering:
    """What the library says of each distinct piece, in two generations.

    When the young one is full it becomes the old one; pieces met again move back.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, object] = {}
        self.old: dict[str, object] = {}

    @classmethod
    def of(cls, path: str):
        """The worker's encoder for this file."""
        if (cls, path) not in _loaded:
            _loaded[cls, path] = cls(path)
        return _loaded[cls, path]

    def learn(self, pieces: Iterable[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, {}
        odd = []
        for piece in set(pieces).difference(self.known):
            value = self.old.get(piece)
            if value is None:
                value = self.direct(piece)
            if value is None:
                odd.append(piece)
            else:
                self.known[piece] = value
        for i in range(0, len(odd), 10_000):
            part = odd[i : i + 10_000]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[piece] = self.value(e.ids)

    def run(self, piece: str):
        """Value of a piece that the pre-tokenizer leaves whole, here or from the library."""
        value = self.known.get(piece)
        if value is None:
            value = self.known[piece] = self.value(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return value


def latin_letters(word: str) -> bool:
    """Letters only, all of blocks whose letters are composed and one word for every pattern."""
    return word.isalpha() and (word.isascii() or ord(max(word)) < LATIN)


class WordIds(_Remembering):
    """Ids of whole texts for tokenizers that drop white space (a word ends there).

    Such a tokenizer never merges across white space, so a text's ids are those of its
    words in a row.  A word of Latin letters with marks behind it is spelled for the model
    at once; all others take the library's whole way.
    """

    @staticmethod
    def value(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def direct(self, word: str) -> bytes | None:
        stem = word.rstrip(_MARKS)
        low = stem.lower()
        if not latin_letters(low):
            return None
        value = self.known.get(low)
        if value is None:
            spelled = low if low.isascii() else low.translate(self.letters)
            value = self.known[low] = self.value([t.id for t in self.model.tokenize(spelled)])
        return value if len(stem) == len(word) else value + self.run(word[len(stem) :])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = _WORD.findall(text) if _CONTROL.search(text) else text.split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(words)
            return b"".join(map(self.known.__getitem__, words))


class AtomCounts(_Remembering):
    """Token counts for byte-level BPE with the usual word pattern.

    An atom is a run of white space with the run of other characters behind it.  The
    pattern's matches never reach from one atom into the next and look ahead by one
    character only, which the atom holds, so the counts of atoms add up.
    """

    @staticmethod
    def value(ids: list[int]) -> int:
        return len(ids)

    def direct(self, atom: str) -> int | None:
        stem = atom.rstrip(_MARKS)
        bare = stem[1:] if stem[:1] == " " else stem
        if not latin_letters(bare):
            return None
        value = self.known.get(stem)
        if value is None:
            spelled = bare if bare.isascii() else bare.translate(self.letters)
            value = self.known[stem] = len(self.model.tokenize((self.letters[32] if bare is not stem else "") + spelled))
        return value if len(stem) == len(atom) else value + self.run(atom[len(stem) :])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        atoms = _ATOM.findall(text)
        try:
            return sum(map(self.known.__getitem__, atoms))
        except KeyError:
            self.learn(atoms)
            return sum(map(self.known.__getitem__, atoms))
