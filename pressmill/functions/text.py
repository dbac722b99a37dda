"""Small string helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python calls white space, as a regex class body
# that Java, RE2 and Python read alike, and as plain characters for trimming.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, so that a body using it twice does not repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def is_blank(col: Column) -> Column:
    # from the left only: that ends at the first character that isn't white space
    return F.ltrim(col, F.lit(SPACE_CHARS)) == ""


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def contains_any(col: Column, phrases: list[str]) -> Column:
    return any_of([col.contains(p) for p in phrases])


def matches_any(col: Column, patterns: list[str]) -> Column:
    return any_of([col.rlike(p) for p in patterns])


def sub(col: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(col, pattern, replacement)


def find_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def sub_where(col: Column, signs: list[str], pattern: str, replacement: str = "", test: str | None = None) -> Column:
    """``sub`` for texts that hold one of ``signs``, and ``test``, which any match needs; others aren't built anew."""

    def replaced(t: Column) -> Column:
        may = contains_any(t, signs)
        return F.when(may & t.rlike(test) if test else may, sub(t, pattern, replacement)).otherwise(t)

    return let(col, replaced)


def lines(col: Column) -> Column:
    return F.split(col, "\n")


def fixed_map(pairs: dict[str, str]) -> Column:
    """A constant map, written as two delimited literals and folded once."""
    mark = "\x1f"
    keys, values = (F.split(F.lit(mark.join(side)), mark) for side in zip(*pairs.items()))
    return F.map_from_arrays(keys, values)


def explode_positions(df, keep: list, items: Column, number: str, out: str):
    """One row per array item with its position.

    The outer form keeps the optimizer from testing the array for emptiness
    first, which would compute it twice; rows of empty arrays go afterwards.
    """
    exploded = df.select(*keep, F.posexplode_outer(items).alias(number, out))
    return exploded.filter(F.col(number).isNotNull())
