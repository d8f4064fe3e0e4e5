"""Several values packed in one field.

Method: the field is split on quote characters. Odd pieces are literals, even pieces
are split on delimiters; array functions put the values together again with their
ordinals. Everything is one projection of built-in functions, so that the operator
adds no shuffle and no Python to a plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Private-use characters standing for a delimiter, and for quotes that are part of a value.
_SLOT, _APOSTROPHE, _QUOTE = "\ue001", "\ue000", "\ue002"
#: Characters that always separate values outside quotes.
DELIMITERS = ",;|\t\n\r，、；｜"
#: Fields that stand for a missing value as a whole.
NULL_WORDS = ("", "nan", "none", "null", "n/a", "na", "<na>", "nat", "-", "?")
#: An unquoted field without delimiters is a list separated by blanks from this many words on, with fewer only if they are as many as are told.
BLANK_LIST_WORDS = 6
#: A word that is a whole name: letters with a number or z behind, or capitals.
_NAME_WORD = r"(?:[A-Za-z][A-Za-z-]*(?:[0-9][A-Za-z0-9'-]*|z)|[A-HJ-Z][A-Z0-9-]+)"
NAME_LIST = rf"^{_NAME_WORD}(?:\s+{_NAME_WORD})+$"


def packed_values(field: Column, count_hint: Column | None = None) -> Column:
    """``array<string>`` of the slots of ``field``, empty slots as ``''``.

    Handles bracketed lists, enclosing quotes of either kind, doubled and escaped quotes,
    ``\\uXXXX`` escapes, mixed delimiters and lists separated by blanks only.

    * Inside quotes, delimiters are text. A quote between two letters or digits is text.
    * Blanks separate values only where no other delimiter stands outside quotes and
      the field either has quoted values beside others or has at least
      ``BLANK_LIST_WORDS`` words (and ``count_hint``, if given, is not 1), or has as many words as
      ``count_hint`` says, all of which look like names (``F3 F4 Cz``, but not ``EOG left``).
    * An unbalanced last quote does not swallow the rest: the piece after it is split as
      if it were not quoted.
    * Null, empty and null-like fields give an empty array. A field of one value gives one.
    """
    missing = field.isNull() | F.lower(F.trim(field)).isin(*NULL_WORDS)
    slots = let(_protected(field), lambda s: let(F.split(s, "[\"']", -1), lambda pieces: _slots(s, pieces, count_hint)))
    return F.when(missing, F.array().cast("array<string>")).otherwise(slots)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _protected(field: Column) -> Column:
    """The field without enclosing brackets, quotes that are text replaced by private-use characters."""
    s = F.regexp_replace(field, r"^[\s\x{feff}]+|\s+$", "")
    for _ in range(2):  # enclosed once, or twice like [[...]]
        s = F.regexp_replace(s, r"^\[\s*([\s\S]*?)\s*\]$|^\(\s*([\s\S]*?)\s*\)$|^\{\s*([\s\S]*?)\s*\}$", "$1$2$3")
    s = F.regexp_replace(s, r"\\+\"|(?<=[\p{L}\p{N}])\"\"|\"\"(?=[\p{L}\p{N}])", _QUOTE)
    return F.regexp_replace(s, r"\\+'|(?<=[\p{L}\p{N}])'(?=[\p{L}\p{N}])", _APOSTROPHE)


def _slots(s: Column, pieces: Column, count_hint: Column | None) -> Column:
    n = F.size(pieces)

    def literal(i: Column) -> Column:
        # with balanced quotes there is an odd number of pieces; else the last one is open
        return (i % 2 == 1) & ~((n % 2 == 0) & (i == n - 1))

    outside = F.array_join(F.filter(pieces, lambda p, i: ~literal(i)), "")
    words = F.size(F.split(F.trim(s), r"\s+"))
    many = words >= BLANK_LIST_WORDS
    if count_hint is not None:
        hint = F.coalesce(count_hint, F.lit(0))
        many = many & (hint != 1) | (hint > 1) & (words == hint) & F.trim(s).rlike(NAME_LIST)
    bare_list = (n == 1) & many
    by_blank = let(outside, lambda o: ~o.rlike(f"[{DELIMITERS}]") & ((n > 4) | (n >= 3) & o.rlike(r"\S") | bare_list))
    rebuilt = let(
        F.when(by_blank, r"\s+").otherwise(f"[{DELIMITERS}]"),
        lambda d: F.array_join(F.transform(pieces, lambda p, i: F.when(literal(i), p).otherwise(F.regexp_replace(p, d, F.lit(_SLOT)))), ""),
    )
    return F.transform(F.split(rebuilt, _SLOT, -1), _clean)


def _clean(v: Column) -> Column:
    v = F.translate(v, _APOSTROPHE + _QUOTE, "'\"")
    unescaped = F.from_json(F.concat(F.lit('["'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"]')), "array<string>")[0]
    v = F.when(v.contains("\\u"), F.coalesce(unescaped, v)).otherwise(v)
    return F.regexp_replace(v, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def split_packed(
    df: DataFrame, field: str, keys: list[str], *, pos: str = "pos", value: str = "value", count_hint: Column | None = None
) -> DataFrame:
    """One row per non-empty value of ``field``: the ``keys``, its slot from 0, and the value.

    Empty slots keep their number but give no row. Rows whose field is null, empty or
    null-like give none; repeated rows and repeated values are all kept. Other columns of
    ``df`` are not read, whatever their names; an empty table gives an empty result.
    """
    slots = packed_values(F.col(field), count_hint)
    return (
        df.select(*keys, F.posexplode(slots).alias(pos, value)).where(F.length(value) > 0)
    )
