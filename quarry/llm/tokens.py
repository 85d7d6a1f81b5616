"""Token ids of whole texts by a public tokenizer, with a cache of words.

A text is cut where its tokenizer cuts in any case, each distinct piece is encoded once, and the ids are joined. Texts
of plain letters are cut by the tokenizer's own rule and their pieces go to its model; all others are cut at blanks and
their pieces go through the whole tokenizer. The ids equal those of the tokenizer over the whole text; tests hold the
two against each other.
"""

from __future__ import annotations

import os
import re
from array import array

#: Pieces a worker keeps before it starts anew; about 200 bytes each.
CACHE_PIECES = 300_000
#: Letters whose normal form is themselves and whose lower case is one letter: Latin and Cyrillic. A text with any
#: other sign beyond ASCII is left to the tokenizer.
_SMALL, _LARGE = "a-zß-öø-ÿа-џ", "A-ZÀ-ÖØ-ÞЀ-Я"
_OTHER = re.compile(f"[^\x00-\x7f{_SMALL}{_LARGE}]")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"\s |^ | \s| $")
#: Contractions and white space of the tokenizers' rules, which are tried in this order.
_ENDS, _SPACE = "'s|'t|'re|'ve|'m|'ll|'d", "\t-\r "
_RULES = {
    "words": f"[{_SMALL}]+|{_ENDS}|[0-9]|[^{_SPACE}0-9{_SMALL}]+",
    "spaced": f" ?[{_SMALL}{_LARGE}]+|{_ENDS}| ?[0-9]+| ?[^{_SPACE}0-9{_SMALL}{_LARGE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+",
}


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
_workers: dict[tuple[str, str], CachedTokenizer] = {}


def forget() -> None:
    """Clear what the tokenizers of this process have learned."""
    for t in _workers.values():
        for cache in (t.parts, t.first, t.later):
            cache.clear()


class _Pieces(dict):
    """Ids by piece; a piece that is missing is learned."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        got = self[piece] = self.learn(piece)
        return got


class _Parts(dict):
    """Ids of one word, number or run of signs by a tokenizer's model, whose letters stand for bytes."""

    def __init__(self, model, size: int):
        super().__init__()
        self.tokenize, self.codes = model.tokenize, [i.to_bytes(4, "little") for i in range(size)]

    def __missing__(self, part: str) -> bytes:
        letters = part if part.isascii() and part.isalnum() else part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        codes = self.codes
        got = self[part] = b"".join([codes[t.id] for t in self.tokenize(letters)])
        return got


class CachedTokenizer:
    """batch(texts) gives ids as little-endian unsigned 32-bit integers in bytes.

    mode "words": the tokenizer lowers letters and drops white space, so that pieces between blanks and line feeds stand
    alone. mode "spaced": a blank belongs to the word behind it, so that a text may be cut before each single blank that
    stands between two other characters. Any other blank stays inside its piece.
    """

    def __init__(self, path: str, mode: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        self.mode = mode
        self.cut = re.compile(_RULES[mode]).findall
        marks = [t.content for t in self.encode.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(re.escape(m) for m in marks)) if marks else re.compile(r"(?!)")
        self.parts = _Parts(self.encode.model, 1 + max(self.encode.get_vocab().values(), default=0))
        self.first = _Pieces(self._whole)
        self.later = _Pieces(lambda p: self._whole(" " + p if mode == "spaced" else p))

    def _whole(self, piece: str) -> bytes:
        return array("I", self.encode.encode(piece, add_special_tokens=False).ids).tobytes()

    def _odd(self, text: str) -> bytes:
        """Ids of any text, by pieces between blanks."""
        if self.mode == "words":
            return b"".join(map(self.later.__getitem__, text.replace("\n", " ").split(" ")))
        pieces = _BETWEEN.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is an empty text."""
        for cache in (self.parts, self.first, self.later):
            if len(cache) > CACHE_PIECES:
                cache.clear()
        get, cut, lower = self.parts.__getitem__, self.cut, self.mode == "words"
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif self.marks.search(t) or not t.isascii() and _OTHER.search(t):
                out.append(self._odd(t))
            else:
                out.append(b"".join(map(get, cut(t.lower() if lower else t))))
        return out


def tokenizer(path: str, mode: str) -> CachedTokenizer:
    """One for each worker process."""
    if (path, mode) not in _workers:
        _workers[path, mode] = CachedTokenizer(path, mode)
    return _workers[path, mode]


def sliced(texts: list[str | None], chars: int = 2_000_000):
    """(begin, end) of runs of texts with so many characters, or of one longer text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > chars:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
