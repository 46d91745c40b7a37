"""Unicode character classes and exact rounding, as native column expressions.

The regex engine on the JVM treats ``\\s``, ``\\d`` and ``\\w`` as ASCII, so every class is spelled out here.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import Stages, apply_stages

# Bodies for use inside [...]; both the JVM engine and RE2 read them.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
ALNUM = r"\p{L}\p{N}"

# The same white space as single characters, for trimming.
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

NOT_BEFORE = rf"(?<![{WORD}])"
NOT_AFTER = rf"(?![{WORD}])"
# A true word boundary in both directions.
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def _ranges(codes: list[int]) -> str:
    """Code points as a regex class body."""
    spans: list[list[int]] = []
    for code in codes:
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans)


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Characters with the Unicode Digit property: decimal digits plus superscripts, circled digits and the like."""
    extra = [c for c in range(128, sys.maxunicode + 1) if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    return r"\p{Nd}" + _ranges(extra)


@lru_cache(maxsize=1)
def delimiter_lookalikes() -> str:
    """Characters that compatibility normalisation turns into a URL delimiter."""
    hits = [
        c
        for c in range(128, sys.maxunicode + 1)
        if unicodedata.decomposition(chr(c)) and set("/?#@:") & set(unicodedata.normalize("NFKC", chr(c)))
    ]
    return _ranges(hits)


def count_class(col: Column, body: str) -> Column:
    """How many characters of ``col`` belong to the class ``[body]``.

    Runs of other characters are cut out in one pass, which is cheaper than one match per counted character.
    """
    return F.length(F.regexp_replace(col, F.lit(f"[^{body}]++"), F.lit("")))


def count_not_class(col: Column, body: str) -> Column:
    return F.length(F.regexp_replace(col, F.lit(f"[{body}]++"), F.lit("")))


def count_char(col: Column, char: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def count_digits(col: Column) -> Column:
    """Characters with the Unicode Digit property. The cheap ASCII pass leaves little for the long class."""
    return count_class(F.regexp_replace(col, F.lit(r"[\x00-/:-\x7f]++"), F.lit("")), digit_class())


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def lower_plain(col: Column) -> Column:
    """Lower case with the three letters that case-insensitive search equates with s, i and k folded too."""
    for char, plain in (("\u017f", "s"), ("\u0130", "i"), ("\u212a", "k")):
        col = F.replace(col, F.lit(char), F.lit(plain))
    return F.lower(col)


def contains_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def token_count(col: Column) -> Column:
    """Number of white-space separated tokens: each token with the space before it becomes one character."""
    return F.length(F.regexp_replace(strip(col), F.lit(rf"[{SPACE}]*+[^{SPACE}]++"), F.lit("x")))


def round_exact(col: Column, digits: int) -> Column:
    """Round half to even on the exact binary value of a non-negative double. Pass a plain column: it is read often.

    ``bround`` works on the shortest decimal form, so 3/160 = 0.01875 goes up there although the stored double lies
    below the tie. The product with 10**digits is formed with its exact rounding error (Dekker), which decides ties.
    """
    scale = float(10**digits)
    split = col * 134217729.0
    high = split - (split - col)
    product = col * scale
    error = (high * scale - product) + (col - high) * scale
    base = F.floor(product).cast("double")
    rest = product - base
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (base % 2.0 == 1.0))))
    return (base + F.when(up, 1.0).otherwise(0.0)) / scale


def ratio_stages(ratios: dict[str, tuple[Column, Column]], digits: int = 4) -> Stages:
    """``part / max(whole, 1)``, rounded. Two projections: rounding reads each quotient many times."""
    quotients = {
        name: part.cast("double") / F.greatest(whole, F.lit(1)).cast("double") for name, (part, whole) in ratios.items()
    }
    return [quotients, {name: round_exact(F.col(name), digits) for name in ratios}]


def with_ratios(df: DataFrame, ratios: dict[str, tuple[Column, Column]], digits: int = 4) -> DataFrame:
    return apply_stages(df, ratio_stages(ratios, digits))
