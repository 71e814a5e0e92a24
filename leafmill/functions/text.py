"""Text expressions shared by the operators: stripping, folding, token estimates, cutting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space, and the four separators that the (?U) class leaves out.
BLANKS = r"(?U)[\s\x1c-\x1f]"


#: The same characters one by one.
BLANK_SIGNS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(x: Column | str) -> Column:
    """Without white space at the ends; both ends are walked, so inner white space costs nothing."""
    return F.btrim(x, F.lit(BLANK_SIGNS))


def collapse(x: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, rf"{BLANKS}+", " "))


def is_blank(x: Column) -> Column:
    return F.coalesce(strip(x) == "", F.lit(True))


def tokens(x: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded down."""
    return tokens_of_length(F.length(x))


def tokens_of_length(n: Column) -> Column:
    return F.floor(n / 4).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(x: Column) -> Column:
    return F.filter(F.split(collapse(x), " "), lambda w: w != "")


def title_case(x: Column) -> Column:
    return F.initcap(x)


def clean_text(x: Column) -> Column:
    """White space collapsed, double quotes to single ones."""
    return F.replace(collapse(x), F.lit('"'), F.lit("'"))


def truncate_words(x: Column, n: int) -> Column:
    return let(words(x), lambda w: F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("..."))).otherwise(x))


def truncate_tokens(x: Column, most: int, strategy: str = "end") -> Column:
    """At most four characters a token: the head, the tail, or both ends with a mark between."""
    n = 4 * most
    if strategy == "start":
        cut = F.concat(F.lit("[truncated]..."), F.right(x, F.lit(n)))
    elif strategy == "middle":
        cut = F.concat(F.left(x, F.lit(n // 2)), F.lit("...[middle truncated]..."), F.right(x, F.lit(n // 2)))
    else:
        cut = F.concat(F.left(x, F.lit(n)), F.lit("...[truncated]"))
    return F.when(F.length(x) > n, cut).otherwise(x)


def preview(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)
