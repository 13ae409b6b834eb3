"""Small building blocks for array expressions."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space (the Unicode White_Space set and U+001C-U+001F).
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SPACES = SPACE_CLASS + "+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    Inside a lambda an outer expression is evaluated again for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """White-space separated words, none of them empty."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def trimmed(text: Column) -> Column:
    """``text`` without white space (of any script) at its ends."""
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(trimmed(text), F.lit("")) == ""


def literal_map(entries: dict[str, str]) -> Column:
    """A constant string map."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def flagged(tokens: Column, flags: Callable[[Column], Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of ``struct<items, flags>``, the flags computed once per token array."""
    return let(
        tokens, lambda ts: let(F.struct(ts.alias("items"), flags(ts).alias("flags")), body)
    )


def runs(pair: Column) -> Column:
    """Maximal runs of equal flag of a flagged array: ``array<struct<flag, items>>``.

    Linear in the array length, unlike a fold that appends to an array.
    """
    items, flags = pair["items"], pair["flags"]
    starts = F.filter(
        F.transform(flags, lambda f, i: F.when((i == 0) | (f != F.get(flags, i - 1)), i + 1)), lambda p: p.isNotNull()
    )

    def cut(st: Column) -> Column:
        end = lambda k: F.coalesce(F.get(st, k + 1), F.size(items) + 1)
        return F.transform(
            st,
            lambda s, k: F.struct(F.get(flags, s - 1).alias("flag"), F.slice(items, s, end(k) - s).alias("items")),
        )

    return let(starts, cut)


def member_flags(tokens: Column, words: list[str], *, fold_case: bool = False) -> Column:
    """Whether each token is one of many constant words, as one expression with a hashed set."""
    token = "lower(t)" if fold_case else "t"
    return F.call_function("transform", tokens, F.expr(f"t -> {token} IN ({', '.join(map(quoted, words))})"))


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(table: dict[str, str], key: Column, cells: int = 64) -> Column:
    """Value of ``key`` in a constant dictionary of SQL literals, null if absent.

    A map column is searched linearly; hashing the key to one of ``cells`` small maps keeps that short. The
    dictionary goes to the JVM as one expression, which is much faster to build than a column per entry. It is made of
    constants only, so the optimizer folds it; a lambda in it would have it built again for every key. A cell without
    words holds those of another cell, which no key of its own equals.
    """
    parts: list[list[str]] = [[] for _ in range(cells)]
    for word, value in table.items():
        parts[zlib.crc32(word.encode()) % cells] += [quoted(word), value]
    some = next(p for p in parts if p)
    maps = F.expr(f"array({', '.join(f'map({chr(44).join(p or some)})' for p in parts)})")
    return F.try_element_at(F.get(maps, (F.crc32(key.cast("binary")) % cells).cast("int")), key)
