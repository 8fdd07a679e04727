"""Column functions over text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two classes of a token.
WORD = r"\A[a-z_-]+\z"
NUMBER = r"\A[0-9]+(?:\.[0-9]+)?\z"


def tokens(line: Column, drop_trailing: bool = True) -> Column:
    """A line cut at single spaces. Empty tokens between spaces stay, so positions count them; trailing ones are dropped."""
    parts = F.split(line, " ", -1)
    if not drop_trailing:
        return parts
    return F.split(F.regexp_replace(line, r" +\z", ""), " ", -1)


def lines(text: Column) -> Column:
    """A text cut at line ends."""
    return F.split(text, "\r\n|\n|\r", -1)


def token_class(token: Column) -> Column:
    """``word``, ``number`` or null."""
    return F.when(token.rlike(WORD), F.lit("word")).when(token.rlike(NUMBER), F.lit("number"))


def letters_only(token: Column) -> Column:
    return token.rlike(r"\A\p{L}+\z")


def hashtags(text: Column) -> Column:
    """The hashtags of a text in order, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"#[\p{L}\p{N}_]+"), F.lit(0)), F.lower)


def padded_time(t: Column) -> Column:
    """``H:mm`` with the hour on two digits."""
    return F.lpad(F.trim(t), 5, "0")


def joined(parts: Sequence[Column], sep: str = ",") -> Column:
    """Texts with a separator; nulls are left out."""
    return F.concat_ws(sep, *parts)


def bits_to_names(bits: Column, names: Sequence[str]) -> Column:
    """The names at whose index a flag is set, in order of the index."""
    table = F.array(*(F.lit(n) for n in names))
    set_at = F.filter(F.sequence(F.lit(0), F.size(bits) - 1), lambda i: F.get(bits, i) == 1)
    return F.when(F.size(bits) > 0, F.transform(set_at, lambda i: F.get(table, i))).otherwise(F.array().cast("array<string>"))
