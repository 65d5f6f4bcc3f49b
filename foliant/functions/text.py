"""Text expressions: tokens, sentences, character trigrams, content tests.

Whitespace is Python's ``str.isspace`` set, spelled out so that Java, RE2 and Python agree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

WS_SET = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = f"[{WS_SET}]"
WS_CHARS = "".join(
    chr(c)
    for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
# between a full stop and the whitespace that leads to an ASCII capital
SENTENCE_BREAK = rf"(?<=\.)(?={WS}+[A-Z])"
# every start position that is not the middle of a surrogate pair, with the three code points there
TRIGRAM = r"(?s)(?!\p{Cs})(?=(.{3}))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda uses it per element."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def words(c: Column) -> Column:
    """Whitespace-separated words, in order.

    All whitespace becomes a plain space first: splitting on one fixed character needs no regex.
    """
    spaced = F.translate(c, WS_CHARS, " " * len(WS_CHARS))
    return F.array_remove(F.split(spaced, " ", -1), "")


def count_tokens(c: Column) -> Column:
    """Whitespace word count, 0 for null or empty."""
    return F.coalesce(F.size(words(c)), F.lit(0))


def split_sentences(c: Column) -> Column:
    """Split after a full stop that is followed by whitespace and an ASCII capital."""
    pieces = F.transform(F.split(c, SENTENCE_BREAK, -1), strip)
    return F.when(strip(c) == ".", F.array(F.lit("."))).otherwise(
        F.filter(pieces, lambda x: ~x.isin("", "."))
    )


def word_windows(c: Column, size: int, overlap: int) -> Column:
    """Word windows of a text longer than ``size`` words; the text itself when it is not."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap

    def cut(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - size) / F.lit(step)), F.lit(0)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size), " ")
        )

    return F.when(count_tokens(c) <= size, F.array(c)).otherwise(let(words(c), cut))


def trigrams(c: Column) -> Column:
    """Distinct character 3-grams of the lower-cased, stripped text."""
    return F.array_distinct(F.regexp_extract_all(strip(F.lower(c)), F.lit(TRIGRAM), 1))


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two distinct arrays, 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        both / (F.size(a) + F.size(b) - both)
    )


def trigram_jaccard(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def contains_any(c: Column, needles: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [c.contains(n) for n in needles])


def contains_code(c: Column) -> Column:
    lines = F.regexp_count(c, F.lit("\n")) + 1
    indented = F.regexp_count(c, F.lit(r"(?dm)^(?: {4}|\t)"))
    return (
        contains_any(c, L.CODE_FENCES)
        | contains_any(F.lower(c), L.CODE_KEYWORDS)
        | ((lines > 3) & (indented / lines > 0.3))
    )


def concept_hits(c: Column) -> Column:
    low = F.lower(c)
    return reduce(
        lambda x, y: x + y, [low.contains(k).cast("int") for k in L.CONCEPT_KEYWORDS]
    )


def is_conceptual(c: Column) -> Column:
    return concept_hits(c) >= 2


def has_reference(c: Column) -> Column:
    """Any context-dependent term, on word boundaries, in any case."""
    return F.lower(c).rlike(r"\b(" + "|".join(L.REFERENCE_TERMS) + r")\b")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def format_size(c: Column) -> Column:
    """Bytes as text with 1024 steps and one decimal."""
    v = c.cast("double")
    # exact halves go to the even digit
    out = F.when(v < 1024, F.format_string("%.1f B", v))
    for step, unit in enumerate(["KB", "MB", "GB"], start=1):
        scaled = v / F.lit(float(1024**step))
        out = out.when(scaled < 1024, F.format_string(f"%.1f {unit}", F.bround(scaled, 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(v / F.lit(float(1024**4)), 1)))


def case_first(c: Column, rules: list[tuple[list[str], str]], default: Column | str) -> Column:
    """The value of the first rule with a needle contained in ``c``."""
    out = None
    for needles, value in rules:
        hit = contains_any(c, needles)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))
