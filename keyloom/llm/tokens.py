"""Token ids of whole texts, by the public tokenizers library, with a bounded memo of units.

Both vocabularies used here split a text at white space, and between letters and the signs of
``_SIGNS``, before they merge; so a text's ids are the ids of its units, one after another.
Most units of a corpus repeat: each worker keeps the ids of units up to ``MEMO_BYTES`` and
hands only unseen ones to the library. Units of plain letters go straight to its model, all
others through its whole chain. Texts with the control characters U+001C..U+001F, which Python
but not the library counts as white space, and texts that hold the string of an added token,
which the library turns into that token, go to the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Bytes that a worker's memo of units may take, looked at after each text, and what
#: an entry takes beside its characters; a bound on memory, not on what is encoded.
MEMO_BYTES, ENTRY_BYTES = 64_000_000, 190

_ODD = re.compile("[\x1c-\x1f]")
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?%*#$&|"
_WORD = f"[{_LETTERS}]+(?=[\\s{_SIGNS}]|\\Z)|[{_SIGNS}]+(?=\\s|\\Z)"
#: With the space before a word, or white space less the one that goes with the next word.
_SPACED = re.compile(rf" ?(?:{_WORD}|\S+)|\s+(?!\S)|\s")
_BARE = re.compile(rf"{_WORD}|\S+")
_PLAIN = re.compile(f" ?[{_LETTERS}]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is,
    all others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


_BYTES = _byte_letters()


def _latin(text: str) -> bool:
    """Whether normalisation changes a text in the case of its letters alone."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Memo(dict):
    """Unit -> its ids as 16-bit integers; an unseen unit is encoded and remembered."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode, self.held = encode, 0

    def __missing__(self, unit: str) -> bytes:
        self[unit] = ids = array("H", self.encode(unit)).tobytes()
        self.held += len(unit) + len(ids) + ENTRY_BYTES
        return ids


class UnitEncoder:
    """Encodes lists of texts with one tokenizer file.

    ``spaces``: whether white space is part of the ids and case is kept (byte-level BPE), or
    white space is dropped and letters are lower-cased (word BPE).
    """

    def __init__(self, path: str, spaces: bool, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo_bytes = memo_bytes
        self.spaces, self.units = spaces, (_SPACED if spaces else _BARE).findall
        self.memo = _Memo(self._unit)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _unit(self, unit: str) -> list[int]:
        if not _PLAIN(unit):
            return self._whole(unit)
        unit = unit if self.spaces else unit.lower()
        unit = unit.replace(" ", _BYTES[32]) if unit.isascii() else unit.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.model.tokenize(unit)]

    def _ids(self, text: str) -> bytes:
        if _ODD.search(text) or any(a in text for a in self.added):
            return array("H", self._whole(text)).tobytes()
        if not self.spaces and _latin(text):
            text = text.lower()  # so that units with capitals and without are the same
        if self.memo.held > self.memo_bytes:
            self.memo = _Memo(self._unit)
        memo = self.memo
        return b"".join([memo[unit] for unit in self.units(text)])  # faster than map with a class of its own

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, number of ids of each text)."""
        raw = [self._ids(text) for text in texts]
        return np.frombuffer(b"".join(raw), np.uint16), np.array([len(r) // 2 for r in raw], np.int64)


@lru_cache(maxsize=2)
def encoder(path: str, spaces: bool, memo_bytes: int = MEMO_BYTES) -> UnitEncoder:
    """The worker's encoder of this file."""
    return UnitEncoder(path, spaces, memo_bytes)


def slices(texts: list[str], chars: int = 500_000):
    """Index ranges of texts with about so many characters, at least one text each."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
