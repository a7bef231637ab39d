"""Words as the problems define them: maximal runs of Unicode letters and digits, lower-cased."""

from __future__ import annotations

import re

#: ``[^\W_]`` is ``[\p{L}\p{N}]`` for every character this Python's Unicode tables know.
WORD = re.compile(r"[^\W_]+")
#: Letters whose lower case depends on, or changes, their neighbours.
_CONTEXTUAL = re.compile("[İΣ]")


def words(text: str) -> list[str]:
    """The lower-cased words of ``text``, in order."""
    if text.isascii() or not _CONTEXTUAL.search(text):
        return WORD.findall(text.lower())
    return [w.lower() for w in WORD.findall(text)]


def word_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The lower-cased words and their character ranges in the original text."""
    found = [(m.group().lower(), m.span()) for m in WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]
