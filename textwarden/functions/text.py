"""Text functions as native column expressions.

Every rule stays in the JVM except entity decoding, which goes through an Arrow
batch function and ships only the texts that hold an ampersand.  The regular
expressions are written so that each takes time linear in the text: a long run
without spaces or of spaces only does not blow them up.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textwarden import constants as K
from textwarden.functions._base import col

# fixed values: character classes and removal patterns
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
URL_CHARS = r"[!$-_a-z]+"
WORD_CHARS = r"\p{L}\p{N}_"
# without any of these, no removal or shortening rule can apply
MARKS = ("://", "www.", "@", "....", "!!!", "???")


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape(c: Column | str) -> Column:
    """Decode HTML entities.  Only texts with an ampersand leave the JVM."""
    c = col(c)
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def strip_urls(c: Column | str) -> Column:
    without_links = F.regexp_replace(col(c), "https?://" + URL_CHARS, "")
    return F.regexp_replace(without_links, r"www\." + URL_CHARS, "")


def strip_emails(c: Column | str) -> Column:
    """Remove each run of non-space characters with an inner ``@``.

    A match always covers a run from its first character on, so anchoring it
    there changes nothing but saves a retry at every later character.
    """
    c = col(c)
    stripped = F.regexp_replace(c, f"(?<![^{SPACE}])[^{SPACE}]+@[^{SPACE}]+", "")
    return F.when(c.contains("@"), stripped).otherwise(c)


def squeeze_punct(c: Column | str) -> Column:
    c = F.regexp_replace(col(c), r"\.{3,}", "...")
    c = F.regexp_replace(c, "!{2,}", "!!")
    return F.regexp_replace(c, r"\?{2,}", "??")


def strip_space(c: Column | str) -> Column:
    """Remove white space, in the Unicode sense, at both ends."""
    return F.btrim(col(c), F.lit(K.SPACE_CHARS))


def squeeze_space(c: Column | str) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"[{SPACE}]+", " "))


def clean_text(c: Column | str, unescape: bool = True) -> Column:
    """Entities, links, mail addresses, punctuation runs, white space, in this order.

    NULL gives the empty text.
    """
    c = html_unescape(c) if unescape else col(c)
    stripped = squeeze_punct(strip_emails(strip_urls(c)))
    # plain searches are far cheaper than the patterns, and most texts hold none of these
    touched = reduce(lambda a, b: a | b, [c.contains(m) for m in MARKS])
    return F.coalesce(squeeze_space(F.when(touched, stripped).otherwise(c)), F.lit(""))


def word_count(c: Column | str) -> Column:
    """Number of blank-separated words of a text that went through squeeze_space."""
    c = col(c)
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def count_of(c: Column | str, char: str) -> Column:
    c = col(c)
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def has_listed_word(c: Column | str, words: Iterable[str] = K.LISTED_WORDS) -> Column:
    """Whole-word hit of any listed word, ignoring case."""
    joined = "|".join(re.escape(w) for w in words)
    return col(c).rlike(f"(?iu)(?<![{WORD_CHARS}])(?:{joined})(?![{WORD_CHARS}])")


def has_listed_word_by(c: Column | str, lang: Column | str, words_by_lang: dict) -> Column:
    """As has_listed_word, with one word list per language; other languages never hit."""
    hit = F.lit(False)
    for name, words in words_by_lang.items():
        hit = F.when(col(lang) == name, has_listed_word(c, words)).otherwise(hit)
    return hit


def preview(c: Column | str, n: int = 100, ellipsis: str = "never") -> Column:
    """The first n characters; the mark is added never, if_longer or always."""
    c = col(c)
    head = F.substring(c, 1, n)
    if ellipsis == "never":
        return head
    marked = F.concat(head, F.lit("..."))
    if ellipsis == "always":
        return marked
    if ellipsis == "if_longer":
        return F.when(F.length(c) > n, marked).otherwise(head)
    raise ValueError(f"unknown ellipsis mode: {ellipsis}")


def strip_fence(c: Column | str) -> Column:
    """Take the content out of a fenced code block; other texts are only stripped."""
    t = strip_space(c)
    inner = lambda skip: F.substr(t, F.lit(skip + 1), F.greatest(F.length(t) - skip - 3, F.lit(0)))
    return F.when(t.startswith("```json"), inner(7)).when(t.startswith("```"), inner(3)).otherwise(t)


def text_variants(c: Column | str, kind: str) -> Column:
    """The three ways a labelled sentence is varied, as an array."""
    if kind not in K.VARIANTS:
        raise ValueError(f"unknown kind: {kind}")
    cased = {"same": col(c), "upper": F.upper(col(c)), "lower": F.lower(col(c))}
    return F.array(
        *[F.concat(F.lit(before), cased[case], F.lit(after)) for before, case, after in K.VARIANTS[kind]]
    )


def tokens(c: Column | str, stop_words: Iterable[str] = K.STOP_WORDS) -> Column:
    """Lower-case word tokens of two or more characters, stop words left out."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(f"[{WORD_CHARS}]{{2,}}"), 0)
    stop = list(stop_words)
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def ngrams(toks: Column | str, n: tuple[int, int] = (1, 2)) -> Column:
    """All n-grams of a token array for n in the closed range, shortest first."""
    toks = col(toks)
    lo, hi = n
    out, grams = [], toks
    for size in range(1, hi + 1):
        if size > 1:
            left = F.greatest(F.size(toks) - (size - 1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), left),
                F.slice(toks, F.lit(size), left),
                lambda a, b: F.concat(a, F.lit(" "), b),
            )
        if size >= lo:
            out.append(grams)
    return F.concat(*out) if len(out) > 1 else out[0]


def action_label(c: Column | str) -> Column:
    return F.coalesce(F.upper(col(c)), F.lit("N/A"))


def title_label(c: Column | str) -> Column:
    """Words of an underscored name with capital first letters."""
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))
