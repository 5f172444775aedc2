"""Personal data by anchor expansion.

An Aho-Corasick automaton walks a text once and reports anchors: at-signs, plus signs, digits, schemes and identifier
cues. A deterministic parser expands each anchor to its bounds and validates what it holds.

Base kinds: email, ip, card, phone. Added kinds: account (IBAN of a plausible length whose check digits hold), ssn
(three-two-four digits in an issued range, after a cue), login (user and password before the host of a URL).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, ship

KINDS = ("email", "ip", "card", "phone", "account", "ssn", "login")
BASE = KINDS[:4]

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOCAL = _LETTERS | _DIGITS | frozenset("._%+-")
_LABEL = _LETTERS | _DIGITS | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
#: Cues that stand before an identifier.
CUES = ("ssn", "SSN", "social security", "Social Security", "IBAN", "iban")

_automaton: list = []


def automaton() -> ahocorasick.Automaton:
    """The anchors' automaton; one a process."""
    if not _automaton:
        found = ahocorasick.Automaton()
        for x in "0123456789":
            found.add_word(x, ("digit", 1))
        found.add_word("@", ("at", 1))
        found.add_word("+", ("plus", 1))
        found.add_word("://", ("scheme", 3))
        for x in CUES:
            found.add_word(x, ("iban" if x.lower() == "iban" else "ssn", len(x)))
        found.make_automaton()
        _automaton.append(found)
    return _automaton[0]


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Bounds around the at-sign; nothing left of `floor` is taken."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (after := _run(text, end + 1, _LABEL)) > end + 1:
        end, dots = after, dots + 1
    return (start, end) if dots else None


def _ip(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """Digit groups joined by dots, four at most, from a group's first digit: where they end, and the groups."""
    end = _run(text, at, _DIGITS)
    groups = [(at, end)]
    while len(groups) < 4 and end < len(text) and text[end] == "." and (after := _run(text, end + 1, _DIGITS)) > end + 1:
        groups.append((end + 1, after))
        end = after
    return end, groups


def _small(text: str, at: int, end: int) -> bool:
    digits = text[at:end].lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        v = int(x) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _card(text: str, at: int) -> int:
    """The end of digits with at most one blank or hyphen between two."""
    n = len(text)
    end = at + 1
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return end


def _phone(text: str, at: int) -> int | None:
    """The end of a number after its plus sign."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return end if end > at + 3 and text[end - 1] in _DIGITS else None


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """Two letters, two digits and 11 to 30 more after the cue, blanks allowed, with sound check digits."""
    n = len(text)
    while at < n and text[at] in " :#=":
        at += 1
    end, taken = at, []
    while end < n and len(taken) < 34:
        if text[end] in _DIGITS or "A" <= text[end] <= "Z":
            taken.append(text[end])
            end += 1
        elif text[end] == " " and end + 1 < n and (text[end + 1] in _DIGITS or "A" <= text[end + 1] <= "Z"):
            end += 1
        else:
            break
    code = "".join(taken)
    if not 15 <= len(code) <= 34 or not code[:2].isalpha() or not code[2:4].isdigit():
        return None
    number = int("".join(str(int(x, 36)) for x in code[4:] + code[:4]))
    return (at, end) if number % 97 == 1 else None


def _ssn(text: str, at: int) -> tuple[int, int] | None:
    n = len(text)
    while at < n and text[at] in " :#=":
        at += 1
    x = text[at : at + 11]
    if len(x) < 11 or not (x[3] == x[6] == "-" and (x[:3] + x[4:6] + x[7:]).isascii() and (x[:3] + x[4:6] + x[7:]).isdigit()):
        return None
    if at + 11 < n and text[at + 11] in _DIGITS or x[:3] in ("000", "666") or x[0] == "9" or x[4:6] == "00" or x[7:] == "0000":
        return None
    return at, at + 11


def _login(text: str, at: int) -> tuple[int, int] | None:
    """user:password before the at-sign of an authority."""
    end, colon = at, False
    while end < len(text) and text[end] not in "@/ \t\r\n\"'<>?#":
        colon |= text[end] == ":" and end > at
        end += 1
    return (at, end) if colon and end < len(text) and text[end] == "@" and text[end - 1] != ":" else None


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of every span, by start and then kind."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    email_floor = ip_after = card_after = phone_after = 0
    for last, (what, size) in automaton().iter(text):
        if what == "digit":
            if last >= ip_after:
                # A shorter chain matches nowhere inside itself either: its groups are too few from any of them on.
                end, groups = _ip(text, last)
                ip_after = end
                if len(groups) == 4 and all(_small(text, a, b) for a, b in groups):
                    out.append((last, 1, end))
            if last >= card_after:
                card_after = _card(text, last)
                digits = "".join(x for x in text[last:card_after] if x in _DIGITS)
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((last, 2, card_after))
        elif what == "at":
            if last >= email_floor and (found := _email(text, last, email_floor)):
                out.append((found[0], 0, found[1]))
                email_floor = found[1]
        elif what == "plus":
            if last >= phone_after and (end := _phone(text, last)):
                phone_after = end
                if 10 <= sum(x in _DIGITS for x in text[last:end]) <= 15:
                    out.append((last, 3, end))
        elif what == "scheme":
            if found := _login(text, last + 1):
                out.append((found[0], 6, found[1]))
        else:
            found = (_iban if what == "iban" else _ssn)(text, last + 1)
            if found:
                out.append((found[0], 4 if what == "iban" else 5, found[1]))
    return sorted(set(out))


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span, overlapping ones merged, replaced by the kind of the first."""
    if text is None or not spans:
        return text
    parts, at, upto, kind = [], 0, -1, 0
    for start, k, end in spans:
        if start < upto:
            upto = max(upto, end)
            continue
        if upto >= 0:
            parts.append(f"<{KINDS[kind].upper()}>")
            at = upto
        parts.append(text[at:start])
        upto, kind = end, k
    return "".join([*parts, f"<{KINDS[kind].upper()}>", text[upto:]])


_SCHEMA = "id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, redacted string"


def _scan(with_text: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols: list[list] = [[] for _ in range(7)]
                for text in part.column(1).to_pylist():
                    spans = find(text)
                    base = [x for x in spans if x[1] < 4]
                    for k in range(4):
                        cols[k].append(sum(x[1] == k for x in base))
                    cols[4].append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base))
                    cols[5].append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans))
                    cols[6].append(redact(text, spans) if with_text else None)
                kinds = [pa.int64()] * 4 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))],
                    names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "redacted"],
                )

    return scan


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Spans of personal data in every text, one row a document, without a shuffle.

    Returns id_col, n_email, n_ip, n_card, n_phone, base_spans and spans ("kind:start:end", code points, end exclusive,
    comma-joined by start and then kind) and redacted (the text with each span replaced by its kind in angle brackets).
    A null text has no spans and stays null; an empty text has none; repeated rows and null ids each give a row; an empty
    table gives none; other columns, even of clashing names, do no harm. Any length of text is walked once.
    """
    ship(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(with_text), _SCHEMA).withColumnRenamed("id", id_col)
