"""Cleaning, splitting and formatting of text as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headers and marks that newswire paragraphs lose, in this order, with what takes their place.
REMOVED = (
    (r"^([A-Z]{2,}|[A-Z]{2,}D\.C\.).*\(.*?\)(\s?\-\-|\s?_|:)", ""),
    (r"\(Begin optional trim\)", ""),
    (r"^SOURCES: .*$", ""),
    (r"\(STORY CAN END HERE . OPTIONAL MATERIAL FOLLOWS.\)", ""),
    (r"\(END OPTIONAL TRIM\)", ""),
    (r"\(End trim\)", ""),
    (r"\(optional trim ends here\)", ""),
    (r"(\(NEW YORK _\)|NEW YORK _)", ""),
    (r"(\(WASHINGTON _\)|WASHINGTON _)", ""),
    (r"(\(ROME _\)|ROME _)", ""),
    (r"\(\d{3}\) \d{3}-\d{4}", ""),
    (r"NATIONAL GENERAL \(.*\)$", ""),
    (r"For Use By Clients of the New York Times News Service", ""),
    (r"Story Filed By Cox Newspapers", ""),
    (r"\s_\s", " "),
    (r"Gov\.", "Governor"),
)

# A paragraph that holds one of these is dropped.
COPYRIGHT = (
    "COPYRIGHT 1998 BY WORLDSOURCES",
    "NO PORTION OF THE MATERIALS CONTAINED HEREIN MAY BE USED IN ANY MEDIA WITHOUT ATTRIBUTION TO WORLDSOURCES, INC.",
)

# English stop words.
STOPWORDS = tuple(
    """a about above after again against ain all am an and any are aren as at be because been before being below between
    both but by can couldn d did didn do does doesn doing don down during each few for from further had hadn has hasn have
    haven having he her here hers herself him himself his how i if in into is isn it its itself just ll m ma me mightn more
    most mustn my myself needn no nor not now o of off on once only or other our ours ourselves out over own re s same shan
    she should shouldn so some such t than that the their theirs them themselves then there these they this those through
    to too under until up ve very was wasn we were weren what when where which while who whom why will with won wouldn y
    you your yours yourself yourselves""".split()
)

#: The contract of splitting. A sentence runs to terminators that blank space follows; a token is a run of word characters
#: or one other mark. Java's and RE2's \w are ASCII, so word characters are spelt out.
SENTENCE = r"[^.!?]+(?:[.!?]+[^\s.!?][^.!?]*)*[.!?]*"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"[\p{L}\p{N}_]"
UNFINISHED_QUOTE = r'^"[^"]+$|^[^"]+"$'
MANUAL_PARAGRAPH = r"(?<=\.|_)\s+(?!.*INC.)(?=\w)"


#: What a text must hold for any of REMOVED to match, and for its blank space to need squeezing.
_MARKED = r"[(_]|SOURCES: |For Use By|Story Filed By|Gov\."
_LOOSE = r"^\s|\s$|\s\s|[\t\n\x0B\f\r]"


def clean_paragraph(text: Column) -> Column:
    """Blank space squeezed, then REMOVED applied in order. Most paragraphs need neither, which two searches tell."""

    def squeezed(x: Column) -> Column:
        return F.when(x.rlike(_LOOSE), F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " ")).otherwise(x)

    def stripped(x: Column) -> Column:
        out = x
        for pattern, by in REMOVED:
            out = F.regexp_replace(out, pattern, by)
        return F.when(x.rlike(_MARKED), out).otherwise(x)

    # each step's input as a lambda's variable: it is made once
    return F.element_at(F.transform(F.transform(F.array(text), squeezed), stripped), 1)


def is_dropped(text: Column) -> Column:
    """Empty, or under copyright."""
    out = ~text.rlike(r"\S")
    for mark in COPYRIGHT:
        out = out | text.contains(mark)
    return out


def sentences(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def manual_paragraphs(text: Column) -> Column:
    """Paragraphs of a body without marked ones: after a full stop or a dash, before a word, unless INC. follows."""
    return F.split(text, MANUAL_PARAGRAPH)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(toks: Column, lowercase: bool = True, entities: bool = True) -> Column:
    """Tokens with a word character; with entities also those that start with an ampersand, without them not even then."""
    keep = (lambda x: x.rlike(WORD) | x.startswith("&")) if entities else (lambda x: x.rlike(WORD) & ~x.startswith("&"))
    out = F.filter(toks, keep)
    return F.transform(out, F.lower) if lowercase else out


def drop_stopwords(toks: Column) -> Column:
    return F.filter(toks, lambda x: ~x.isin(*STOPWORDS))


def ngrams(toks: Column, n: int, padded: bool = True) -> Column:
    """Runs of n tokens joined by a blank; padded, with n - 1 marks before the first and after the last."""
    if n == 1:
        return toks
    if padded:
        toks = F.concat(F.array_repeat(F.lit("<s>"), n - 1), toks, F.array_repeat(F.lit("</s>"), n - 1))

    def runs(t: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, found).otherwise(F.array().cast("array<string>"))

    # the tokens as a lambda's variable: they are made once, not once a run
    return F.element_at(F.transform(F.array(toks), runs), 1)


def headline(text: Column) -> Column:
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.coalesce(F.when(stripped != "", F.regexp_replace(stripped, "\n", " ")), F.lit("NONE"))


def date_of(doc_id: Column) -> Column:
    """The date in a document's name: the letters before it and the article's number go."""
    return F.regexp_replace(F.regexp_replace(doc_id, r"^[\D_]+", ""), r"\.[\w]+", "")


def summary_file_name(docset_id: Column, method: Column, budget: int = 100) -> Column:
    """D1001A-A and method 1 give D1001-A.M.100.A.1."""
    stem = F.substring_index(docset_id, "-", 1)
    return F.format_string(f"%s-%s.M.{budget}.%s.%s", F.substring(stem, F.lit(1), F.length(stem) - 1), F.substring(stem, -1, 1), F.substring(docset_id, -1, 1), method)


def jaccard_distance(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; of two empty ones 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def detokenize(toks: Column) -> Column:
    """Tokens as an English line: no blank before closing marks or after opening ones."""
    out = F.array_join(toks, " ")
    out = F.regexp_replace(out, r" ([.,;:!?)\]}%])", "$1")
    out = F.regexp_replace(out, r"([(\[{$#]) ", "$1")
    return F.regexp_replace(out, r" ?(['’]) ?(s|t|re|ve|m|ll|d)\b", "$1$2")


#: Patterns that undo two public tokenizations of English, in order, with what takes their place. Contractions come twice,
#: as two in a row share a blank.
_CONTRACTED = (r"(?i) ('(?:s|m|d|ll|re|ve)|n't)( |$)", "$1$2")
TREEBANK = (("`` ?", '"'), (" ?''", '"'), _CONTRACTED, _CONTRACTED, (r" ([.,;:?!%)\]}])", "$1"), (r"([(\[{$#]) ", "$1"))
MOSES = (('" ([^"]*) "', '"$1"'), (r" ([,.?!:;%})\]])", "$1"), (r"([(\[{$¿¡]) ", "$1"), (" ('[A-Za-z])", "$1"))


def rejoined(toks: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """Tokens as a line by TREEBANK (marked quotes become plain ones) or MOSES (every second quote closes)."""
    out = F.array_join(toks, " ")
    for pattern, by in patterns:
        out = F.regexp_replace(out, pattern, by)
    return out


def detokenizer(choice: bool | str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """True stands for detokenize(), False for the tokens as they are, "treebank" and "moses" for the rules of that name."""
    if callable(choice):
        return choice
    if isinstance(choice, str):
        patterns = {"treebank": TREEBANK, "moses": MOSES}[choice]
        return lambda toks: rejoined(toks, patterns)
    return detokenize if choice else (lambda x: x)


def clean_generation(text: Column) -> Column:
    """Leftovers of prompt marks go from generated text."""
    out = F.regexp_replace(F.regexp_replace(text, r"(\w*\])", ""), r"(\[\w*)", "")
    return F.trim(F.regexp_replace(out, " +", " "))


def replace_span(text: Column, by: str, start: int, end: int) -> Column:
    """text[:start] + by + text[end:], 0-based."""
    return F.overlay(text, F.lit(by), F.lit(start + 1), F.lit(end - start))


def tf_weight(x: Column, delta: float = 0.01, log: bool = True) -> Column:
    return F.log(x + delta) if log else x + delta


def idf_documented(n: Column, df: Column, delta: float = 0.7) -> Column:
    return F.lit(delta) + F.log(n / (df + delta))


def idf_ratio(n: Column, df: Column, delta: float = 0.7) -> Column:
    return F.log(n / df + delta) + delta
