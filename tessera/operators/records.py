"""Records that do not parse: strict load, anti-join on the record offsets, diagnosis of the rest.

A record is one delimited text with quoted fields. The grammar is a regular language and is matched by possessive
patterns, so the JVM neither backtracks nor recurses however long a record is. Everything stays in built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.durable import durable, known

# One field: quoted, with "" or \" for a quote inside, or unquoted and free of quotes and commas.
FIELD = r'(?:"(?:[^"\\]++|""|\\"?)*+"|[^",]*+)'

# Marks that stand for a missing value and are no word, compared in lower case without surrounding brackets.
MARKERS = (
    "n/a", "#n/a", "na", "n.a.", "n.a", "null", "nan", "tbd", "tba", "t.b.d.", "t.b.a.", "undefined", "not available", "not applicable",
    "to be announced", "to be determined", "#ref!", "#value!", "#name?", "#null!", "#num!", "#div/0!",
)
# Words that say the same. A name may be one of them, unless it stands in brackets; a description is never one word.
ABSENCES = ("none", "nil", "unknown", "missing", "untitled", "no title", "no plot")

MOVIE_COLUMNS = ("release_year", "title", "origin", "director", "cast_list", "genre", "wiki_page", "plot")


@dataclass(frozen=True)
class RecordRules:
    """What a valid record holds: its columns, and which of them are a year or a text that must say something, as a name or a description."""

    columns: Sequence[str] = MOVIE_COLUMNS
    year: str | None = "release_year"
    year_from: int = 1880
    year_to: int = 2030
    required: Sequence[str] = ("title", "plot")
    names: Sequence[str] = ("title",)


def _led(line: Column) -> Column:
    """The line with a comma before it, so that each field is a comma and its text."""
    return F.concat(F.lit(","), line)


def well_quoted(line: Column) -> Column:
    """True where every field is closed at its end and no quote stands free."""
    return F.coalesce(_led(line).rlike(rf"\A(?:,{FIELD})++\z"), F.lit(False))


def has_columns(line: Column, n: int) -> Column:
    """True where the line is well quoted and has exactly ``n`` fields."""
    return F.coalesce(_led(line).rlike(rf"\A(?:,{FIELD}){{{n}}}\z"), F.lit(False))


def fields(line: Column) -> Column:
    """The texts of the fields of a well-quoted line, without quotes."""
    raw = F.regexp_extract_all(_led(line), F.lit(f",({FIELD})"), F.lit(1))

    def plain(x: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(x, r'(?s)\A"(.*)"\z', "$1"), r'\\"|""', '"')
        return F.when(x.startswith('"'), inner).otherwise(x)

    return F.transform(raw, plain)


def says_nothing(text: Column, name: bool = False) -> Column:
    """True for a null or blank text, one of punctuation only, or a placeholder for a missing value.

    A word such as "Unknown" is a placeholder as a description; as a ``name`` it is one only in brackets, for there are films of
    that name.
    """
    bare = F.lower(F.trim(F.regexp_replace(text, r"\A[\s\p{Z}\[({<]+|[\s\p{Z}\])}>]+\z", "")))
    word = bare.isin(*ABSENCES) & (text.rlike(r"\A[\s\p{Z}]*[\[({<].*[\])}>][\s\p{Z}]*\z") if name else F.lit(True))
    return F.coalesce(text.rlike(r"\A[\p{P}\p{S}\p{Z}\p{Cf}\s]*\z") | bare.isin(*MARKERS) | word, F.lit(True))


def undecodable(text: Column) -> Column:
    """True where a text holds the replacement character or control characters other than tab and line ends."""
    return F.coalesce(text.rlike("[\\x{FFFD}\\x{0000}-\\x{0008}\\x{000B}\\x{000C}\\x{000E}-\\x{001F}\\x{007F}-\\x{009F}]"), F.lit(False))


def _values_ok(parts: Column, rules: RecordRules) -> Column:
    at = {c: F.get(parts, F.lit(k)) for k, c in enumerate(rules.columns)}
    ok = F.lit(True)
    if rules.year:
        year = at[rules.year]
        ok = ok & year.rlike(r"\A[0-9]{4}\z")
        ok = ok & F.coalesce(year.try_cast("int").between(rules.year_from, rules.year_to), F.lit(False))
    for c in rules.required:
        ok = ok & ~says_nothing(at[c], c in rules.names) & ~undecodable(at[c])
    return F.coalesce(ok, F.lit(False))


def strict_load(df: DataFrame, offset: str, line: str, rules: RecordRules = RecordRules()) -> DataFrame:
    """The conforming records only: ``offset`` and one text column for each of ``rules.columns``.

    Null and empty lines, wrong field counts, broken quoting and invalid values are left out. Other columns of ``df`` are
    not kept, so none can clash with the loaded ones.
    """
    # The generator keeps Catalyst from repeating the split in each predicate and column.
    parts = df.where(has_columns(F.col(line), len(rules.columns))).select(F.col(offset).alias("__offset"), F.explode(F.array(fields(F.col(line)))).alias("__parts"))
    good = parts.where(_values_ok(F.col("__parts"), rules))
    return good.select(F.col("__offset").alias(offset), *(F.get(F.col("__parts"), F.lit(k)).alias(c) for k, c in enumerate(rules.columns)))


def diagnose(line: Column, n_columns: int) -> Column:
    """The first reason that applies to a record that did not load."""
    return (
        F.when(line.isNull(), F.lit("columns"))
        .when(~well_quoted(line), F.lit("quoting"))
        .when(~has_columns(line, n_columns), F.lit("columns"))
        .otherwise(F.lit("value"))
    )


def failed_records(df: DataFrame, offset: str, line: str, rules: RecordRules = RecordRules()) -> DataFrame:
    """(offset, reason) of each record that does not load.

    The offsets of the strict load are subtracted from all offsets, which moves offsets and never a text; the remainder is written
    and only its records are read again and diagnosed, through a broadcast of their offsets where they are few. Offsets must be
    unique; a null offset counts as not loaded, and its record has a reason by the same order.
    """
    loaded = strict_load(df, offset, line, rules).select(F.col(offset).alias("__offset"))
    rest = durable(df.where(F.col(offset).isNotNull()).select(F.col(offset).alias("__offset")).join(loaded, "__offset", "left_anti"))
    raw = df.select(F.col(offset).alias("__offset"), F.col(line).alias("__line"))
    left = raw.join(known(rest), "__offset", "left_semi").unionByName(raw.where(F.col("__offset").isNull()))
    return left.select(F.col("__offset").alias(offset), diagnose(F.col("__line"), len(rules.columns)).alias("reason"))
