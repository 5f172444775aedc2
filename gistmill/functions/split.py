"""The contract of splitting (functions/text.py) as plain code, for operators that read whole documents: a small part of the time
that column expressions take. Blank space, digits and line ends are those of the SQL's engine."""

from __future__ import annotations

import re
from collections.abc import Iterator

from gistmill.functions import text as T

_BLANK = "\t\n\f\r "


def _plain(pattern: str) -> re.Pattern:
    """\\p{L}, \\p{N} and _ are Python's \\w; its \\s, \\d and $ know more than the contract's."""
    out = pattern.replace(r"\p{L}\p{N}_", r"\w").replace(r"\S", r"[^\t\n\f\r ]").replace(r"[^\w\s]", r"[^\w\t\n\f\r ]").replace(r"[^\s.!?]", r"[^\t\n\f\r .!?]").replace(r"\s", r"[\t\n\f\r ]").replace(r"\d", "[0-9]")
    return re.compile(re.sub(r"\$$", r"\\Z", out))


_SENTENCE, _TOKEN, _MARKED = (_plain(x) for x in (T.SENTENCE, T.TOKEN, T._MARKED))
_REMOVED = [(_plain(pattern), by) for pattern, by in T.REMOVED]
_RUN, _LOOSE = re.compile(f"[{_BLANK}]+"), re.compile(f"[{_BLANK}]{{2}}|[\t\n\f\r]")
_LETTERS = str.maketrans({"İ": "i", "Σ": "σ"})
_WORD = re.compile(r"\w+|&")

tokens = _TOKEN.findall


def paragraph(text: str) -> str:
    """As T.clean_paragraph."""
    text = text.strip(_BLANK)
    if _LOOSE.search(text):
        text = _RUN.sub(" ", text)
    if _MARKED.search(text):
        for pattern, by in _REMOVED:
            text = pattern.sub(by, text)
    return text


def sentences(text: str | None) -> Iterator[tuple[int, str]]:
    """para_idx (of kept paragraphs) and sentence, in order."""
    at = 0
    for para in (text or "").split("\n"):
        para = paragraph(para)
        if not para.strip(_BLANK) or any(x in para for x in T.COPYRIGHT):
            continue
        for piece in _SENTENCE.findall(para):
            if piece := piece.strip(_BLANK):
                yield at, piece
        at += 1


def is_word(token: str) -> bool:
    """A token with a word character."""
    return token[:1].isalnum() or token[:1] == "_"


def lower(x: str) -> str:
    """Letter by letter, as the SQL does: İ gives i, and Σ σ at a word's end too."""
    return x.lower() if x.isascii() else x.translate(_LETTERS).lower()


def words(sentence: str) -> list[str]:
    """Lower-cased tokens with a word character, and ampersands."""
    return _WORD.findall(sentence.lower()) if sentence.isascii() else [lower(x) for x in _WORD.findall(sentence)]
