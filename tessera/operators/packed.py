"""Several values packed in one field: infer the delimiters of each source, split, explode with position.

Every mark outside quotes is a candidate. A candidate is scored, for each source, on how regular the pieces beside it are
(the share of them that some record of the source holds as its whole field) and on how consistent the number of pieces is
from record to record; the score decides. A mark that stands inside a name (between two word characters, or an ampersand between
words) starts with a prior against it, any other mark with one for it. A record counts once for a mark however often it holds it,
so a few odd records do not turn a decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.durable import durable, known

W = r"[\p{L}\p{M}\p{N}]"
# A stretch in quotes. An apostrophe opens one only where no letter or digit stands before it and closes where none follows.
QUOTED = (
    rf"\"\"[^\"]++\"\"|\"[^\"]*+\"|“[^“”]*+”|„[^„“”]*+[“”]|«[^«»]*+»|‹[^‹›]*+›|‘[^‘’]*+’(?!{W})|`[^`]*+`"
    rf"|(?<!{W})'[^'\r\n]*'(?!{W})"
)
# What may stand inside a name: a hyphen or apostrophe between word characters, an ampersand, a dot of an abbreviation.
IN_NAME = rf"(?<={W})[-‐‑'’](?={W})|(?<={W}[\x20\x{{A0}}]{{0,8}})&(?=[\x20\x{{A0}}]{{0,8}}{W})"
MARK = r"[\p{P}\p{S}\p{Cc}\x{2028}\x{2029}]"
TOKEN = rf"{QUOTED}|{IN_NAME}|{MARK}|(?:(?!{MARK})[\s\S])++"
IS_QUOTED = r"(?s)\A(?:[\"“„«‹‘`].+[\"”“»›’`]|'.+')\z"


def _tidy(x: Column) -> Column:
    """Lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), r"[\s\p{Z}]+", " "))


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(x, r"\A[\"“„«‹‘`']+|[\"”“»›’`']+\z", "")


def _guarded(text: Column) -> Column:
    """The text with a quoted stretch as "...\x01\x02" and a mark inside a name as "\x01-\x02"."""
    return F.regexp_replace(text, rf"({QUOTED})|({IN_NAME})", "$1\x01$2\x02")


def tokens(text: Column, whole_names: bool = False) -> Column:
    """The text cut into quoted stretches, marks and runs of other characters, each as (kind, text).

    kind is ``q`` (quoted), ``n`` (mark inside a name), ``m`` (other mark) or ``t`` (text); with ``whole_names`` the marks inside
    names belong to the text. Nulls give null.
    """
    inside = "\x01[^\x02]\x02"
    text_of = rf"(?:{inside}|(?!{MARK})[\s\S])++|{MARK}" if whole_names else rf"{inside}|{MARK}|(?:(?!{MARK})[\s\S])++"
    parts = F.regexp_extract_all(_guarded(text), F.lit(rf"(?:{QUOTED})\x01\x02|{text_of}"), F.lit(0))
    one = rf"\A{inside}\z"
    name_mark = (lambda x: F.lit(False)) if whole_names else (lambda x: x.rlike(one))
    kind = lambda x: F.when(x.endswith("\x01\x02"), F.lit("q")).when(name_mark(x), F.lit("n")).when(x.rlike(rf"\A{MARK}\z"), F.lit("m")).otherwise(F.lit("t"))
    return F.transform(parts, lambda x: F.struct(kind(x).alias("kind"), F.regexp_replace(x, "[\x01\x02]", "").alias("text")))


def _beside(cut: DataFrame, tok: str, kind: str) -> DataFrame:
    """(source, mark, in_name, piece, n, s1, s2): the marks of a kind with the pieces on both sides. The places of a mark in a record
    weigh one together."""
    sided = F.expr(
        f"""transform(sequence(0, size({tok}) - 1), i -> struct(
            get({tok}, i).text as mark, get({tok}, i).kind as kind,
            if(i > 0 and get({tok}, i - 1).kind in ('t', 'q'), get({tok}, i - 1).text, null) as before,
            if(i + 1 < size({tok}) and get({tok}, i + 1).kind in ('t', 'q'), get({tok}, i + 1).text, null) as after))"""
    )
    # The marks of a record are few, however often it holds them: each takes its own places along.
    held = F.filter("sided", lambda x: x["kind"] == kind)
    of = F.expr("explode(transform(array_distinct(held.mark), m -> filter(held, x -> x.mark = m)))")
    return (
        cut.where(f"exists({tok}, x -> x.kind = '{kind}')")
        .select("source", sided.alias("sided"))
        .select("source", held.alias("held"))
        .select("source", of.alias("places"))
        .select("source", F.get("places", F.lit(0))["mark"].alias("mark"), F.lit(kind == "n").alias("in_name"), F.size("places").alias("pieces"), F.explode(F.concat(F.col("places.before"), F.col("places.after"))).alias("side"))
        .withColumn("piece", _tidy(_unquoted(F.col("side"))))
        .groupBy("source", "mark", "in_name", "piece")
        .agg(F.sum(F.lit(1.0) / F.col("pieces")).alias("n"), F.count(F.lit(1)).cast("double").alias("s1"), F.sum("pieces").cast("double").alias("s2"))
    )


def _source(source: str | None) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("all")


def infer_delimiters(df: DataFrame, text: str, source: str | None = None, prior: float = 25.0, accept: float = 0.5) -> DataFrame:
    """(source, mark, in_name, n, consistency, regularity, score, accepted) of each candidate mark of each source.

    ``source`` is a column of ``df`` (rows without one are a source of their own, the empty one) or None for a single source; n is
    the number of sides of the mark that the score rests on, those of a record weighing two together. Null and blank texts take no
    part. Marks of a source are few (at most the marks of Unicode), so the result is small beside the data; only pieces that stand
    beside a mark are shuffled, already counted.
    """
    base = df.select(_source(source).alias("source"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    cut = base.select("source", tokens(F.col("text"), True).alias("tok"))
    fine = base.where(F.col("text").rlike(IN_NAME)).select("source", tokens(F.col("text")).alias("tok"))
    first = F.get("tok", F.lit(0))
    whole = cut.where((F.size("tok") == 1) & first["kind"].isin("t", "q")).select("source", _tidy(_unquoted(first["text"])).alias("piece")).where("piece <> ''").groupBy("source", "piece").agg(F.count(F.lit(1)).alias("seen"))
    marks = _beside(cut, "tok", "m").unionByName(_beside(fine, "tok", "n"))
    known = marks.join(whole, ["source", "piece"], "left")
    scored = known.groupBy("source", "mark", "in_name").agg(
        F.round(F.sum("n"), 6).alias("n"),
        F.round(F.sum(F.when(F.coalesce(F.col("piece"), F.lit("")) == "", F.lit(0.0)).otherwise(F.col("n"))), 6).alias("filled"),
        F.round(F.sum(F.when(F.col("seen").isNotNull(), F.col("n")).otherwise(F.lit(0.0))), 6).alias("regular"),
        F.sum("s1").alias("s1"),
        F.sum("s2").alias("s2"),
    )
    # Over records: n of weight one, s1 the sum of their counts and s2 of the squares.
    mean = F.col("s1") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    belief = F.when(F.col("in_name"), F.lit(0.0)).otherwise(F.lit(1.0))
    regularity = (F.col("regular") + prior * belief) / (F.col("filled") + prior)
    consistency = F.lit(1.0) / (F.lit(1.0) + spread / mean)
    score = regularity * (F.lit(0.75) + consistency / 4)
    return scored.select("source", "mark", "in_name", "n", F.round(consistency, 6).alias("consistency"), F.round(regularity, 6).alias("regularity"), F.round(score, 6).alias("score"), (score >= accept).alias("accepted"))


def split_packed(df: DataFrame, key: str, text: str, source: str | None = None, value: str = "value", pos: str = "pos") -> DataFrame:
    """(key, pos, value): one row for each value of each record, in order, positions from 1.

    Repeated rows of the same key and text count once, under their least source. Empty pieces count for nothing, a quoted stretch is
    one value without its quotes, the same value twice is two rows. Null and blank texts give no rows. The accepted marks reach the
    records by a join on the source, as a broadcast where the sources are few.
    """
    rules = infer_delimiters(df, text, source).where("accepted").groupBy("source").agg(F.array_sort(F.collect_set(F.concat(F.when(F.col("in_name"), F.lit("n")).otherwise(F.lit("m")), F.col("mark")))).alias("cuts"))
    rules = known(durable(rules))
    base = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"), _source(source).alias("source")).where(F.col("__text").isNotNull()).groupBy("__key", "__text").agg(F.min("source").alias("source"))
    cut = base.join(rules, "source", "left").select("__key", tokens(F.col("__text")).alias("tok"), F.coalesce("cuts", F.array().cast("array<string>")).alias("cuts"))
    # Separators become \x01, quoted stretches stand between two of them, other marks stay in the text.
    flat = F.concat_ws(
        "",
        F.transform(
            "tok",
            lambda x: F.when(x["kind"] == "q", F.concat(F.lit("\x01"), _unquoted(x["text"]), F.lit("\x01")))
            .when(x["kind"].isin("m", "n") & F.array_contains("cuts", F.concat(x["kind"], x["text"])), F.lit("\x01"))
            .otherwise(x["text"]),
        ),
    )
    pieces = F.filter(F.transform(F.split(flat, "\x01"), _tidy), lambda x: x != "")
    return cut.select("__key", F.posexplode(pieces).alias("p", "v")).select(F.col("__key").alias(key), (F.col("p") + 1).cast("int").alias(pos), F.col("v").alias(value))
