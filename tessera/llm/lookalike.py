"""Texts that look the same in different characters, brought to one form.

Look-alike letters, letter widths and spaces are mapped to one character each by built-in expressions. What the map leaves open
(accents of any other kind, invisible characters) is settled by grouping under Spark's UNICODE collation, which tells case,
accents, punctuation and digits apart and ignores invisible characters. Each class takes the text of its least id as its form.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.durable import durable, known

# Letters of other scripts that look like a Latin letter, and that letter.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y",
    "ү": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V",
    "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Armenian, Latin and others
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ѵ": "v", "Ѵ": "V", "Օ": "O", "ɑ": "a", "ɡ": "g", "ı": "i", "ǃ": "!", "‐": "-", "‑": "-"
}
# Spaces that look like a space.
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# A joiner between two pictures makes another picture and is kept as this private character; elsewhere it is invisible.
JOINED = "\ue000"
_PICTURE = r"[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}\x{2640}\x{2642}]"


def _table() -> tuple[str, str]:
    table = dict(LOOKALIKES) | {s: " " for s in SPACES}
    for code in range(0xFF01, 0xFF5F):
        table[chr(code)] = chr(code - 0xFEE0)
    for code in [*range(0xFF5F, 0xFFBF), *range(0xFFE0, 0xFFE7)]:  # the other width variants by their Unicode mapping
        if len(wide := unicodedata.normalize("NFKC", chr(code))) == 1 and wide != chr(code):
            table[chr(code)] = wide
    table["\uff9e"], table["\uff9f"] = "\u3099", "\u309a"
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:  # look-alike letters with an accent
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in LOOKALIKES and len(latin := unicodedata.normalize("NFC", LOOKALIKES[base] + "".join(marks))) == 1:
            table[chr(code)] = latin
    # Mathematical and other styled letters and digits, and Roman numerals of one letter, by their Unicode mapping.
    for code in [*range(0x2100, 0x2150), *range(0x2160, 0x2180), *range(0x1D400, 0x1D800), *range(0x1FBF0, 0x1FBFA)]:
        styled = unicodedata.decomposition(chr(code)).startswith("<font>") or 0x2160 <= code < 0x2180
        if styled and len(plain := unicodedata.normalize("NFKC", chr(code))) == 1:
            table[chr(code)] = LOOKALIKES.get(plain, plain)
    return "".join(table), "".join(table.values())


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def looks(text: Column) -> Column:
    """The text with one character for all that look like it; accents are settled by the collation.

    Only texts with combining marks pass through Python, which composes them; the others go there as nulls.
    """
    other = text.rlike(r"[^\x00-\x7F]")  # a text of ASCII only looks like itself
    marked = other & text.rlike(r"[\p{M}&&[^\x{FE00}-\x{FE0F}]]")
    t = F.coalesce(_composed(F.when(marked, text)), text)
    t = F.regexp_replace(t, rf"({_PICTURE}\x{{FE0F}}?)\x{{200D}}(?={_PICTURE})", "$1" + JOINED)
    a, b = _table()
    ended = lambda x: F.regexp_replace(x, "\r\n?", "\n")
    return F.when(other, F.translate(ended(t), a, b)).otherwise(ended(text))


def _blank(text: Column) -> Column:
    return text.rlike(r"\A[\s\p{Z}\p{Cf}\p{Cc}\x{FE00}-\x{FE0F}]*\z")


LEAST_LETTERS = 12


def _bases() -> tuple[str, str]:
    """Letters and digits that the collation may find equal to an ASCII one with marks, and that one."""
    table = {}
    for code in range(0x80, 0x10000):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if named := re.fullmatch(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z])(?: WITH .*)?", unicodedata.name(chr(code), "")):
            base = named[2].lower() if named[1] == "SMALL" else named[2]
        if base.isascii() and base.isalnum():
            table[chr(code)] = base
    return "".join(table), "".join(table.values())


def _bare(looks: Column) -> Column:
    """The letters and digits of a text that are ASCII without their marks."""
    a, b = _bases()
    dropped = "".join(c for c in map(chr, range(0x80)) if not c.isalnum())  # more characters than replacements: the rest goes
    bare = F.translate(looks, a + dropped, b)
    return F.when(looks.rlike(r"[^\x00-\x7F]"), F.regexp_replace(bare, r"[^\x00-\x7F]+", "")).otherwise(bare)


def variants(df: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, looks, rep, copies, skeleton) of each different text: its least id, how many rows hold it, and a hash of its base letters
    and digits, which texts of one class share; null where these are few. Blank and null texts and
    null ids do not count."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").isNotNull() & ~_blank(F.col("t")))
    once = rows.groupBy(F.md5("t").alias("digest")).agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("t").alias("t"))
    # The generators keep each step from being worked out again in the next.
    told = once.select("digest", F.explode(F.array(looks(F.col("t")))).alias("looks"), "rep", "copies")
    bare = told.select("*", F.explode(F.array(_bare(F.col("looks")))).alias("bare"))
    return bare.withColumn("skeleton", F.when(F.length("bare") >= LEAST_LETTERS, F.xxhash64("bare"))).drop("bare")


def look_classes(v: DataFrame) -> DataFrame:
    """(digest, rep, copies, class_id): the texts of ``variants`` that look like another one, with their class, whose id is the
    least id of its texts.

    The collation leaves the base letters and digits what they are, so only texts that share theirs with another text can be in a class
    with one; the others, nearly all, need no comparison under the collation.
    """
    shared = known(durable(v.where("skeleton is not null").groupBy("skeleton").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("skeleton")))
    few = v.join(shared, "skeleton", "left_semi").unionByName(v.where("skeleton is null"))
    return v.sparkSession.sql(
        """
        WITH classes AS (
          SELECT collate(looks, 'UNICODE') AS form, min(rep) AS class_id
          FROM {v} GROUP BY collate(looks, 'UNICODE') HAVING count(*) > 1
        )
        SELECT v.digest, v.rep, v.copies, c.class_id
        FROM {v} AS v JOIN classes AS c ON collate(v.looks, 'UNICODE') = c.form
        """,
        v=few,
    )


def consistent_form(df: DataFrame, key: str, text: str, form: str = "form", class_id: str = "class_id") -> DataFrame:
    """(key, class_id, form): each row with the id of its class and the text of the class's member of least id.

    Texts that look alike have equal forms, others different ones. Blank and null texts are their own form and have no class; rows
    with a null id come out with a null class.
    """
    rows = df.select(F.col(key).alias("__k"), F.col(text).alias("__t"), F.md5(F.col(text)).alias("digest"))
    v = durable(variants(df, key, text))
    c = durable(look_classes(v))
    # Only a class of several texts needs the text of another row.
    heads = c.where("rep = class_id").select(F.col("rep").alias("__k"), "class_id").join(rows.select("__k", F.col("__t").alias("form")), "__k").groupBy("class_id").agg(F.min("form").alias("form"))
    told = v.select("digest", "rep").join(c.join(heads, "class_id").select("digest", "class_id", "form"), "digest", "left")
    out = rows.join(told, "digest", "left")
    return out.select(F.col("__k").alias(key), F.when(F.col("__k").isNotNull(), F.coalesce("class_id", "rep")).alias(class_id), F.coalesce("form", "__t").alias(form))


FULL = 1_000_000  # pairs of a class that are all listed


def lookalike_pairs(df: DataFrame, key: str, text: str, a: str = "doc_a", b: str = "doc_b", full: int = FULL) -> DataFrame:
    """(a, b): pairs of ids, the lesser first, whose texts look the same but are not the same characters.

    A class of up to ``full`` such pairs gives all of them. A larger one gives each row with another text than its head (the text of
    the class's least id) paired with the class's id, and each other row of the head's text with the least id of another text: as
    many pairs as rows, which link any two rows of the class; ``consistent_form`` has the class of every row.
    """
    c = durable(look_classes(durable(variants(df, key, text))))
    n = F.sum("copies")
    each = c.groupBy("class_id").agg(
        ((n * n - F.sum(F.col("copies") * F.col("copies"))) / 2).alias("pairs"), F.min_by("digest", "rep").alias("head"), F.min(F.when(F.col("rep") != F.col("class_id"), F.col("rep"))).alias("second")
    )
    # A text in one row needs no join: that row is its least id.
    rows = df.select(F.col(key).alias("k"), F.md5(F.col(text)).alias("digest")).where(F.col("k").isNotNull() & F.col("digest").isNotNull()).distinct()
    copied = rows.join(c.where("copies > 1").select("digest", "class_id"), "digest")
    members = durable(c.where("copies = 1").select(F.col("rep").alias("k"), "digest", "class_id").unionByName(copied.select("k", "digest", "class_id")).join(each, "class_id"))
    few = members.where(F.col("pairs") <= full).select("class_id", "k", "digest")
    other = few.select("class_id", F.col("k").alias("k2"), F.col("digest").alias("digest2"))
    listed = few.join(other, "class_id").where("k < k2 and digest <> digest2").select(F.col("k").alias("x"), F.col("k2").alias("y"))
    star = members.where(F.col("pairs") > full).select(F.col("k").alias("x"), F.when(F.col("digest") == F.col("head"), F.col("second")).otherwise(F.col("class_id")).alias("y"))
    starred = star.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return listed.unionByName(starred).select(F.col("x").alias(a), F.col("y").alias(b))
