"""Splitting text into pieces that byte-pair merges never cross."""

from __future__ import annotations

import re

import regex

_DOUBLE = re.compile(r"\s\s")


class PreTokenizer:
    """Matches of ``pattern`` (a pattern of the kind public byte-level tokenizers use).

    Every alternative of such a pattern starts with at most one white space
    character and then stays outside white space, or is white space only. So a
    position between a non-space and a space always ends a match, and text
    without two adjacent white space characters can be cut at its spaces: each
    cut piece is matched on its own, which lets callers cache by piece. Other
    texts are matched as a whole.
    """

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)

    def pieces(self, text: str) -> list[str]:
        """Pieces whose matches, one after another, are the matches of the text."""
        if _DOUBLE.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        out = [" " + piece for piece in rest]
        if first:
            out.insert(0, first)
        return out

    def matches(self, piece: str) -> list[str]:
        return self.pattern.findall(piece)


class Memo(dict):
    """A dictionary that fills itself; it forgets everything at ``most`` entries and never keeps long keys."""

    def __init__(self, make, most: int = 400_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
