"""Tokenizers and text measures, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
WORD = r"[A-Za-z][A-Za-z'\-]*[A-Za-z]|[A-Za-z]"
DESCRIBE_TOKEN = r"[a-z0-9_./-]{2,}"
BREAK = "\x1e"


def _all(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def plain_tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return _all(F.lower(text), "[a-z0-9]+")


def words(text: Column | str) -> Column:
    return _all(text, WORD)


def sentences(text: Column | str) -> Column:
    """Cut after . ! or ? where white space and then a capital, a quote or a parenthesis follow."""
    marked = F.regexp_replace(F.trim(text), r"([.!?])\s+([A-Z\"'(])", f"$1{BREAK}$2")
    return F.filter(F.split(marked, BREAK), lambda s: F.trim(s) != "")


def name_tokens(name: Column | str) -> Column:
    """The distinct runs of letters and of digits of a snake_case or camelCase name, two characters or more, lower-cased."""
    cut = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.array_sort(F.array_distinct(_all(F.lower(cut), "[a-z]{2,}|[0-9]{2,}")))


def describe_tokens(text: Column | str) -> Column:
    """Distinct words of a description, and the bigrams of its CJK characters (a single one by itself)."""
    plain = _all(F.lower(text), DESCRIBE_TOKEN)
    cjk = F.regexp_replace(text, r"[^一-鿿]", "")
    pairs = F.when(F.length(cjk) == 1, F.array(cjk)).when(F.length(cjk) > 1, F.transform(F.sequence(F.lit(1), F.length(cjk) - 1), lambda i: F.substring(cjk, i, F.lit(2))))
    return F.array_sort(F.array_distinct(F.concat(plain, F.coalesce(pairs, F.array().cast("array<string>")))))


def jaccard(left: Column | str, right: Column | str) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))), F.lit(0.0))
