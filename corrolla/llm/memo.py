"""A bounded memo for values of text pieces, shared by the encoders."""

from __future__ import annotations

import re

#: Fixed value. The pattern for which a text may be cut before spaces, and words of Latin letters told without it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
MARKS = frozenset((".", ",", ";", ":", "!", "?"))
#: A space that doesn't alone precede a word: where it doesn't occur, a text can be cut before each space.
_ODD_SPACE = re.compile(r" (?:\s|$)")


class Memo(dict):
    """Two generations of at most `room` entries each; what a full young generation still needs is moved up on use."""

    def __init__(self, make, room: int = 300_000):
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


def space_chunks(text: str) -> list[str] | None:
    """The text cut before every space, or None if some space is last or precedes white space.

    In the pre-tokenizer's pattern only a run of white space holds a space past its start, so where every space
    precedes a visible character each one begins a match: the chunks can be encoded apart.
    """
    if _ODD_SPACE.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if rest else [first]
