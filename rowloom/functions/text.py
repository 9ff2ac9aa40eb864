"""Functions on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the published byte-level splitting pattern. (?U) gives \s its
# Unicode meaning in the JVM's regular expressions.
BYTE_LEVEL_PATTERN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# The same split without lookahead and spaces, for engines that have neither.
PLAIN_PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"

# Texts that a default delimited-file read treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


# The phrase that marks names with a code, and the code's prefix.
CODE_PHRASE = "Cytochrome P450"
CODE_PREFIX = "CYP"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def null_tokens(value: Column | str) -> Column:
    """NULL where the text is one of the missing-value tokens."""
    value = _column(value)
    return F.when(~value.isin(*NA_TOKENS), value)


def words(value: Column | str) -> Column:
    """Whitespace-separated tokens."""
    return F.regexp_extract_all(_column(value), F.lit(r"\S+"), F.lit(0))


def word_count(value: Column | str) -> Column:
    """Number of whitespace-separated tokens; 0 for blank text."""
    return F.regexp_count(_column(value), F.lit(r"\S+"))


def pieces(value: Column | str, pattern: str = BYTE_LEVEL_PATTERN) -> Column:
    """Split text into the runs that merges may never cross."""
    return F.regexp_extract_all(_column(value), F.lit(pattern), F.lit(0))


def name_to_code(
    name: Column | str,
    phrase: str = CODE_PHRASE,
    prefix: str = CODE_PREFIX,
    token: int = 3,
) -> Column:
    """Short code of a descriptive name: prefix + the given token, without the
    commas around it. NULL if the phrase is absent or there are too few tokens."""
    name = _column(name)
    word = F.try_element_at(words(name), F.lit(token))
    code = F.concat(F.lit(prefix), F.btrim(word, F.lit(",")))
    return F.when(F.contains(name, F.lit(phrase)), code)


def md5_number(value: Column | str) -> Column:
    """First 32 bits of the md5 as a number; every SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(_column(value)), 1, 8), 16, 10).cast("bigint")


def parse_list(value: Column | str) -> Column:
    """A list literal with single or double quotes as an array; NULL if it is
    not a list of strings (see ``unparsed_lists`` for counting those)."""
    return F.from_json(_column(value), "array<string>", {"allowSingleQuotes": "true"})


def list_text(value: Column | str) -> Column:
    """An array of strings as list text that ``parse_list`` reads back."""
    return F.to_json(_column(value))
