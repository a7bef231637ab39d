"""The tokenizer's pre-split: text into pieces that merges never cross."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Fixed value: the split pattern of the tokenizer format.
SPLIT_PATTERN = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"

#: White space of Unicode, spelled out, as the standard engine's ``\s`` also holds U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"


def _in_classes(space: str, letters: str, numbers: str) -> re.Pattern:
    """The pattern for the standard engine, which is faster, with character classes for the properties."""
    return re.compile(
        SPLIT_PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
        .replace(r"[^\r\n\p{L}\p{N}]", rf"[^\r\n{letters}{numbers}]")
        .replace(r"\p{L}", f"[{letters}]")
        .replace(r"\p{N}", f"[{numbers}]")
        .replace(r"\S", f"[^{space}]")
        .replace(r"\s", f"[{space}]")
    )


_ASCII = _in_classes(r"\t-\r ", "A-Za-z", "0-9")


def _ranges(kind: str) -> str:
    """The ranges of the characters of 16 bits whose category starts with ``kind``."""
    out, start = [], None
    for i in range(0x10001):
        if i < 0x10000 and unicodedata.category(chr(i)).startswith(kind):
            start = i if start is None else start
        elif start is not None:
            out.append(rf"\u{start:04x}-\u{i - 1:04x}")
            start = None
    return "".join(out)


@lru_cache(1)
def _basic() -> re.Pattern:
    return _in_classes(_SPACE, _ranges("L"), _ranges("N"))


@lru_cache(1)
def _beyond() -> re.Pattern:
    """Characters of more than 16 bits, and those this Python doesn't know and other engines may."""
    return re.compile(f"[\U00010000-\U0010ffff{_ranges('Cn')}]")


@lru_cache(1)
def _full():
    import regex

    return regex.compile(SPLIT_PATTERN)


def pieces(text: str) -> list[str]:
    """The pieces of ``text``; joined they give the text again."""
    pattern = _ASCII if text.isascii() else _full() if _beyond().search(text) else _basic()
    return pattern.findall(text)
