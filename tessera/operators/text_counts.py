"""Counts of words and numbers, co-occurring pairs and stripes, stopwords, term statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def lines_of(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, line_no, line): each line of each text, numbered from 0."""
    return df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))


def class_counts(lines: DataFrame, line: str = "line", lowercase: bool = True) -> DataFrame:
    """(token_class, token, n): how often each word and number occurs, most frequent first within a class."""
    token = F.explode(T.tokens(F.lower(line) if lowercase else F.col(line))).alias("token")
    kinds = lines.select(token).withColumn("token_class", T.token_class(F.col("token"))).where("token_class is not null")
    return kinds.groupBy("token_class", "token").agg(F.count(F.lit(1)).alias("n"))


def stopwords(df: DataFrame, words: Sequence[str]) -> DataFrame:
    """A list of words as a table, each once."""
    return df.sparkSession.createDataFrame([(w,) for w in sorted(set(words))], "token string")


def without(counts: DataFrame, words: DataFrame) -> DataFrame:
    """Counts of tokens that are not in ``words`` (token)."""
    return counts.join(words, "token", "left_anti")


def top(counts: DataFrame, k: int, cls: str) -> DataFrame:
    """The ``k`` most frequent tokens of a class; ties in the order of the token."""
    return counts.where(F.col("token_class") == cls).orderBy(F.desc("n"), "token").limit(k).select("token", "n")


def pair_counts(lines: DataFrame, line: str = "line", m: int = 5, lowercase: bool = False) -> DataFrame:
    """(pair, n): ordered pairs ``a:b`` of tokens of one class, b at most ``m`` raw positions after a.

    Positions count every token, also those of no class and the empty ones between two spaces. The pairs of a line are made by
    array functions where the line lies; only counts are shuffled.
    """
    parts = T.tokens(F.lower(line) if lowercase else F.col(line))
    tagged = F.transform(parts, lambda x: F.struct(x.alias("t"), T.token_class(x).alias("c")))
    of = lines.select(tagged.alias("p"))
    pairs = F.flatten(
        F.transform(
            "p",
            lambda a, i: F.transform(F.filter(F.slice("p", i + 2, F.lit(m)), lambda b: b["c"] == a["c"]), lambda b: F.concat(a["t"], F.lit(":"), b["t"])),
        )
    )
    return of.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def stripe_counts(lines: DataFrame, line: str = "line", m: int = 5, lowercase: bool = False, same_class: bool = False) -> DataFrame:
    """(token, nbr, n): for each token of a class the raw tokens at most ``m`` positions away on either side and how often.

    Neighbours may be of any class, or only of the token's with ``same_class``; tokens are matched as written and counted in lower
    case.
    """
    parts = T.tokens(F.lower(line) if lowercase else F.col(line))
    # Each token takes along only its neighbours, so a long line costs its length and not the square of it.
    near = F.transform("p", lambda x, i: F.struct(x.alias("token"), F.concat(F.slice("p", F.greatest(i - m, F.lit(0)) + 1, F.least(i, F.lit(m))), F.slice("p", i + 2, F.lit(m))).alias("nbrs")))
    of = lines.select(parts.alias("p")).where(F.size("p") > 0).select(F.explode(near).alias("e"))
    of = of.select("e.*", T.token_class(F.col("e.token")).alias("c")).where("c is not null")
    flat = of.select(F.lower("token").alias("token"), "c", F.explode("nbrs").alias("raw"))
    if same_class:
        flat = flat.where(T.token_class(F.col("raw")) == F.col("c"))
    return flat.groupBy("token", F.lower("raw").alias("nbr")).agg(F.count(F.lit(1)).alias("n"))


def as_stripes(counts: DataFrame) -> DataFrame:
    """(token, stripe): the counts of ``stripe_counts`` as one map for each token."""
    return counts.groupBy("token").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("nbr", "n")))).alias("stripe"))


# English forms that follow no ending rule, and their lemma.
IRREGULAR = {
    "men": "man", "women": "woman", "children": "child", "people": "person", "feet": "foot", "teeth": "tooth", "mice": "mouse",
    "geese": "goose", "wives": "wife", "lives": "life", "knives": "knife", "wolves": "wolf", "was": "be", "were": "be", "been": "be",
    "is": "be", "are": "be", "am": "be", "has": "have", "had": "have", "did": "do", "does": "do", "done": "do", "went": "go",
    "gone": "go", "said": "say", "made": "make", "took": "take", "taken": "take", "came": "come", "got": "get", "saw": "see",
    "seen": "see", "knew": "know", "known": "know", "gave": "give", "given": "give", "found": "find", "thought": "think",
    "told": "tell", "became": "become", "left": "leave", "felt": "feel", "brought": "bring", "began": "begin", "begun": "begin",
    "kept": "keep", "held": "hold", "wrote": "write", "written": "write", "stood": "stand", "heard": "hear", "met": "meet",
    "ran": "run", "paid": "pay", "sat": "sit", "spoke": "speak", "led": "lead", "lost": "lose", "sold": "sell", "won": "win",
    "better": "good", "best": "good", "worse": "bad", "worst": "bad",
}


def lemma(word: str) -> str:
    """A lemma by rule for a lower-case English word: an approximation, there is no part-of-speech model behind it."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    for end, put, least in (("ies", "y", 5), ("sses", "ss", 5), ("shes", "sh", 5), ("ches", "ch", 5), ("xes", "x", 4), ("ied", "y", 5)):
        if word.endswith(end) and len(word) >= least:
            return word[: -len(end)] + put
    for end in ("ing", "ed"):
        stem = word[: -len(end)]
        if word.endswith(end) and len(stem) >= 3 and any(v in "aeiouy" for v in stem):
            if stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if stem[-1] in "vucz" or (len(stem) == 3 and stem[-2] in "aeiou" and stem[-1] not in "wxy") else stem
    if word.endswith("s") and len(word) > 3 and not word.endswith(("ss", "us", "is")):
        return word[:-1]
    return word


def lemmas(df: DataFrame, key: str, text: str, stop: Sequence[str] = (), shortest: int = 3) -> DataFrame:
    """(key, lemmas): the lemmas of each text in order: letters only, at least ``shortest`` long, no stopwords.

    Texts without such a word have an empty list; null texts too.
    """
    leave = frozenset(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            # Each word of a batch is looked at once, however often it stands there.
            told = [lemma(w) for w in coded.dictionary.to_pylist()]
            keep = np.array([len(x) >= shortest and x not in leave for x in told], dtype=bool)
            codes = coded.indices.to_numpy(zero_copy_only=False)
            kept = keep[codes] if len(codes) else np.zeros(0, dtype=bool)
            upto = np.concatenate([[0], np.cumsum(kept)])[ends - ends[0]]
            words = pa.array(told, type=pa.string()).take(pa.array(codes[kept]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), words)], names=["key", "lemmas"])

    words = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\p{L}+"), F.lit(0)), F.lower)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), words.alias("w")).mapInArrow(run, f"key {kind}, lemmas array<string>").withColumnRenamed("key", key)


def term_frequency(docs: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, term, tf, n_terms): counts of the terms of each record, and how many terms it holds with repeats."""
    each = docs.select(key, F.size(terms).alias("n_terms"), F.explode(terms).alias("term"))
    return each.groupBy(key, "n_terms", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(tf: DataFrame, size: int = 5000) -> DataFrame:
    """(term, df, term_id): the ``size`` terms of most records, numbered from 0 by falling frequency and term."""
    few = document_frequency(tf).orderBy(F.desc("df"), "term").limit(size)
    return few.withColumn("term_id", F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1)


def inverse_frequency(vocab: DataFrame, n_docs: int) -> DataFrame:
    """``vocab`` with idf = ln(n / df)."""
    return vocab.withColumn("idf", F.log(F.lit(float(n_docs)) / F.col("df")))


def weights(tf: DataFrame, key: str, vocab_idf: DataFrame) -> DataFrame:
    """(key, term, term_id, weight): idf * tf / all terms of the record, for terms of the vocabulary."""
    joined = tf.join(F.broadcast(vocab_idf), "term")  # as many rows as the vocabulary's size at most
    return joined.select(key, "term", "term_id", (F.col("idf") * F.col("tf") / F.col("n_terms")).alias("weight"))
