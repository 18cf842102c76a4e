"""Splitting text for byte-level BPE, and a bounded memory of what pieces encode to."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Generic, TypeVar

import public_tokenizers
import regex

V = TypeVar("V")

PATTERN = regex.compile(public_tokenizers.PATTERN)
#: Characters that the installed libraries may class differently, as they follow
#: different Unicode versions. Texts that hold one go to the tokenizer library whole.
ODD = regex.compile(
    r"[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7f1\uab6c\uab6d"
    r"\U00010000-\U0001f2ff\U0001fb00-\U0010ffff]")
#: Pieces that a worker remembers.
MEMORY = 400_000
#: Longer pieces are encoded but not remembered.
LONGEST = 64
#: Characters worked on at a time, which bounds a worker's memory.
CHARS_PER_CALL = 1 << 19


def is_plain(text: str) -> bool:
    return text.isascii() or ODD.search(text) is None


def calls(texts: list[str], chars: int = CHARS_PER_CALL) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about ``chars`` characters; a longer text is alone."""
    start, held = 0, 0
    for end, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield start, end
            start, held = end, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


class Memory(Generic[V]):
    """Values of pieces: a given table, then a cache that starts anew when it is full."""

    def __init__(self, encode: Callable[[list[str]], Iterable[V]], table: dict[str, V] | None = None, limit: int = MEMORY):
        self.encode, self.limit, self.table = encode, limit, table or {}
        self.known: dict[str, V] = dict(self.table)

    def learn(self, split: Iterable[list[str]]) -> dict[str, V]:
        """A look-up that has every piece in ``split``."""
        missing = list(set().union(*split).difference(self.known))
        if len(self.known) + len(missing) > self.limit + len(self.table):
            self.known = dict(self.table)
            missing = list(set().union(*split).difference(self.known))
        found = dict(zip(missing, self.encode(missing), strict=True)) if missing else {}
        if any(len(p) > LONGEST for p in missing):
            self.known.update((p, v) for p, v in found.items() if len(p) <= LONGEST)
            return self.known | {p: v for p, v in found.items() if len(p) > LONGEST}
        self.known.update(found)
        return self.known
