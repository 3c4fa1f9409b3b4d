"""Registry of the checked queries: each has a Spark form and, where SQL can say it, a twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden import constants as K
from textwarden.sources.files import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


# --- the score every engine computes alike ------------------------------------
SQL_SCORE = "CAST((doc_id * 13) % 101 AS DOUBLE) / CAST(100 AS DOUBLE)"


def fixture_score(key: str = "doc_id") -> Column:
    return ((F.col(key) * 13) % 101).cast("double") / F.lit(100.0)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def steady(c: Column | str, digits: int = 4) -> Column:
    """A sum or mean of doubles, rounded alike whatever the order of adding.

    The engines break ties of round() differently; here both go up.
    """
    value = F.col(c) if isinstance(c, str) else c
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.500001)).cast("double") / scale


def sql_steady(c: str, digits: int = 4) -> str:
    return f"floor({c} * {10**digits}::DOUBLE + 0.500001::DOUBLE) / {10**digits}::DOUBLE"


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# --- SQL twins of the text rules ----------------------------------------------
# fixed values: the link, mail, punctuation, space and capital patterns are those of the rules they check
SQL_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
SQL_TRIM_CHARS = (
    "chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(28)||chr(29)||chr(30)||chr(31)"
    "||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)"
    "||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)"
    "||chr(8239)||chr(8287)||chr(12288)"
)


def sql_strip(c: str) -> str:
    return f"trim({c}, {SQL_TRIM_CHARS})"


def sql_urls(c: str) -> str:
    c = f"regexp_replace({c}, 'https?://[!$-_a-z]+', '', 'g')"
    return f"regexp_replace({c}, 'www\\.[!$-_a-z]+', '', 'g')"


def sql_emails(c: str) -> str:
    return f"regexp_replace({c}, '[^{SQL_SPACE}]+@[^{SQL_SPACE}]+', '', 'g')"


def sql_punct(c: str) -> str:
    c = f"regexp_replace({c}, '[.]{{3,}}', '...', 'g')"
    c = f"regexp_replace({c}, '[!]{{2,}}', '!!', 'g')"
    return f"regexp_replace({c}, '[?]{{2,}}', '??', 'g')"


def sql_space(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{SQL_SPACE}]+', ' ', 'g'))"


def sql_clean(c: str) -> str:
    return f"coalesce({sql_space(sql_punct(sql_emails(sql_urls(c))))}, '')"


SQL_UNESCAPED_HTML = (
    "replace(replace(replace(replace(html, '&quot;', '\"'), '&copy;', chr(169)),"
    " '&middot;', chr(183)), '&amp;', '&')"
)

SQL_CLEANED = f"cleaned AS (SELECT doc_id, lang, text, {sql_clean('text')} AS c FROM documents)"

SQL_LISTED = r"regexp_matches({c}, '(?i)(^|[^\pL\pN_])(" + "|".join(K.LISTED_WORDS) + r")($|[^\pL\pN_])')"

# four equal neighbours, from lists shifted against each other
SQL_REPEATED = (
    "len(list_filter(list_zip(regexp_extract_all({c}, '.'), regexp_extract_all({c}, '.')[2:],"
    " regexp_extract_all({c}, '.')[3:], regexp_extract_all({c}, '.')[4:]),"
    " lambda x: x[1] = x[2] AND x[1] = x[3] AND x[1] = x[4])) > 0"
)

SQL_FEATURES = f"""features AS (
  SELECT doc_id, c, length(c) AS length,
    CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS word_count,
    regexp_matches(c, '[A-Z]{{3,}}') AS has_caps,
    {SQL_REPEATED.format(c='c')} AS has_repeated_chars,
    length(c) - length(replace(c, '!', '')) AS exclamation_count,
    length(c) - length(replace(c, '?', '')) AS question_count,
    regexp_matches(c, '\\p{{Nd}}') AS has_numbers,
    CAST(length(replace(c, ' ', '')) AS DOUBLE)
      / greatest(CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END, 1) AS avg_word_length,
    {SQL_LISTED.format(c='c')} AS offensive
  FROM cleaned)"""

_SAME = "|".join(f"{chr(97 + i)}{{4}}" for i in range(26))


def sql_flags(source: str) -> str:
    return f"""flags AS (
  SELECT *, len(regexp_extract_all(c, '\\p{{Lu}}')) > CAST(0.5 AS DOUBLE) * length(c) AS excessive_caps,
    2 * length(c) - length(replace(c, '!', '')) - length(replace(c, '?', '')) > 5
      AS excessive_punctuation,
    regexp_matches(c, '{_SAME}') AS repeated_chars,
    length({sql_strip('c')}) < 10 AS very_short,
    length({sql_strip('c')}) > 1000 AS very_long
  FROM {source})"""
