"""Queries over texts: counts, pairs, stripes, term weights, concepts, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.durable import durable
from tessera.functions import text as T
from tessera.operators import records, semantic
from tessera.operators import text_counts as C
from tessera.plans import problems
from tessera.sources import readers
from tessera.sources.tables import table

# A short list of English function words for these queries; operators take any list.
STOP = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "in",
        "is", "it", "its", "not", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "were", "who",
        "with", "you")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return C.lines_of(table(spark, d, "documents"), "text")


def word_count(spark: SparkSession, d: str) -> DataFrame:
    return C.class_counts(_lines(spark, d)).where("token_class = 'word'").select("token", "n").orderBy(F.desc("n"), "token")


def number_count(spark: SparkSession, d: str) -> DataFrame:
    return C.class_counts(_lines(spark, d)).where("token_class = 'number'").select("token", "n").orderBy(F.desc("n"), "token")


def word_count_top(spark: SparkSession, d: str) -> DataFrame:
    return C.top(C.class_counts(_lines(spark, d)), 1000, "word")


def stopword_top1000(spark: SparkSession, d: str) -> DataFrame:
    counts = C.class_counts(_lines(spark, d))
    return C.top(C.without(counts, C.stopwords(counts, STOP)), 1000, "word")


def stopword_top1000_numbers(spark: SparkSession, d: str) -> DataFrame:
    return C.top(C.class_counts(_lines(spark, d)), 1000, "number")


def word_pairs_m5(spark: SparkSession, d: str) -> DataFrame:
    return C.pair_counts(_lines(spark, d), m=5)


def word_stripes_m5(spark: SparkSession, d: str) -> DataFrame:
    return C.stripe_counts(_lines(spark, d), m=5)


def word_stripe_maps(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of each word and number as one map, told in the order of the neighbour."""
    stripes = C.as_stripes(word_stripes_m5(spark, d))
    told = F.transform(F.sort_array(F.map_entries("stripe")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return stripes.select("token", F.size("stripe").alias("n_neighbours"), F.md5(F.array_join(told, "|")).alias("stripe"))


def word_stripes_same_class(spark: SparkSession, d: str) -> DataFrame:
    return C.stripe_counts(_lines(spark, d), m=5, lowercase=True, same_class=True)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.lower).alias("terms"))


def doc_tf(spark: SparkSession, d: str) -> DataFrame:
    return C.term_frequency(_terms(spark, d), "doc_id", "terms")


def doc_df(spark: SparkSession, d: str) -> DataFrame:
    return C.document_frequency(doc_tf(spark, d))


def _idf(spark: SparkSession, d: str, size: int = 5000) -> DataFrame:
    n = table(spark, d, "documents").where("text is not null").count()
    return C.inverse_frequency(C.vocabulary(doc_tf(spark, d), size), n)


def idf(spark: SparkSession, d: str) -> DataFrame:
    return _idf(spark, d).withColumn("idf", F.round("idf", 9))


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    w = C.weights(doc_tf(spark, d), "doc_id", _idf(spark, d))
    return w.withColumn("weight", F.round("weight", 9))


def _concepts(spark: SparkSession, d: str, k: int = 25) -> semantic.Concepts:
    films = table(spark, d, "films").where("plot is not null").groupBy("film_id").agg(F.max("plot").alias("plot"))
    # Written once: the vocabulary, its size and the weights read the counts again.
    tf = durable(C.term_frequency(C.lemmas(films, "film_id", "plot", STOP), "film_id", "lemmas"))
    vocab = durable(C.inverse_frequency(C.vocabulary(tf, 5000), films.count()))
    return semantic.decomposed(C.weights(tf, "film_id", vocab), "film_id", vocab, k)


def lsa_topics(spark: SparkSession, d: str) -> DataFrame:
    return semantic.top_terms(_concepts(spark, d), 10)


def lsa_documents(spark: SparkSession, d: str) -> DataFrame:
    return semantic.top_documents(_concepts(spark, d), "film_id", 10)


def lsa_genres(spark: SparkSession, d: str) -> DataFrame:
    top = semantic.top_documents(_concepts(spark, d), "film_id", 25)
    return semantic.top_values(top, problems.p7_found(spark, d), "film_id", "genre_value", 5)


def lsa_query(spark: SparkSession, d: str) -> DataFrame:
    return semantic.query(_concepts(spark, d), "film_id", ["fortress", "station", "coin"], 25)


def lemmas(spark: SparkSession, d: str) -> DataFrame:
    return C.lemmas(table(spark, d, "documents"), "doc_id", "text", STOP)


def hashtag_counts(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "documents").select(F.explode(T.hashtags(F.col("text"))).alias("hashtag"))
    return tags.groupBy("hashtag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hashtag").limit(1000)


def quoted_csv_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "movie_lines").where(records.has_columns(F.col("raw_line"), 8))
    of = lines.select("line_id", F.explode(F.array(records.fields(F.col("raw_line")))).alias("f"))
    return of.select("line_id", *(F.get("f", F.lit(k)).alias(c) for k, c in ((1, "title"), (5, "genre"), (7, "plot"))))


_SHAPED = "elevation_dimension between -999 and 9999 and latitude is not null and longitude is not null and obs_year is not null and obs_month is not null and obs_day is not null and obs_hour is not null"


def _weather_lines(spark: SparkSession, d: str) -> DataFrame:
    """(obs_id, line): readings as fixed-width records; what is missing or does not fit stands as the sentinel of its field."""
    w = table(spark, d, "weather").where(_SHAPED)
    fit = lambda c, low, high, none: F.when(F.col(c).between(low, high), F.col(c)).otherwise(F.lit(none))
    scaled = lambda c, by, low, high, none: F.when(F.round(F.col(c) * by).between(low, high), F.round(F.col(c) * by)).otherwise(F.lit(none)).cast("int")
    line = F.format_string(
        "000000000000000%04d%02d%02d%02d000%+06d%+07dFM-15%+05d000000000%03d1N%04d1%05d100%06d1N1%+05d1%+05d1",
        "obs_year", "obs_month", "obs_day", "obs_hour", F.round(F.col("latitude") * 1000).cast("int"), F.round(F.col("longitude") * 1000).cast("int"),
        "elevation_dimension", fit("direction_angle", 0, 999, 999), scaled("speed_rate", 10, 0, 9998, 9999), fit("ceiling_height_dimension", 0, 99998, 99999),
        fit("distance_dimension", 0, 999998, 999999), scaled("air_temperature", 10, -9989, 9989, 9999), scaled("dew_point_temperature", 10, -9989, 9989, 9999),
    )
    return w.select("obs_id", line.alias("line"))


def fixed_width_parse(spark: SparkSession, d: str) -> DataFrame:
    """Records whose air temperature is measured; the sentinels of the other fields stay as values."""
    return readers.weather_records(_weather_lines(spark, d), "line", keep=["obs_id"])


def fixed_width_measured(spark: SparkSession, d: str) -> DataFrame:
    """The same records without sentinels: null, and -1 for whole numbers."""
    return readers.weather_records(_weather_lines(spark, d), "line", drop_sentinels=True, keep=["obs_id"]).select(
        "obs_id", "speed_rate", "dew_point_temperature", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("direction_angle", "ceiling_height_dimension", "distance_dimension"))
    )


def _event_lines(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("value").cast("decimal(18,3)").cast("string"))
    return table(spark, d, "events").select(F.concat_ws(",", F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_type"), value).alias("line"))


def _parsed_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = lambda k: F.get(F.split("line", ","), F.lit(k))
    parsers = {"event_id": part(0).try_cast("bigint"), "ts": F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"), "event_type": part(2), "value": part(3).try_cast("double")}
    return readers.safely_parsed(_event_lines(spark, d), "line", parsers)


def safe_parse_good(spark: SparkSession, d: str) -> DataFrame:
    return _parsed_events(spark, d)[0]


def safe_parse_bad(spark: SparkSession, d: str) -> DataFrame:
    return _parsed_events(spark, d)[1]


def json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


QUERIES = {
    f.__name__: f
    for f in (word_count, number_count, word_count_top, stopword_top1000, stopword_top1000_numbers, word_pairs_m5, word_stripes_m5, word_stripe_maps, word_stripes_same_class, doc_tf, doc_df, idf, tfidf,
              lsa_topics, lsa_documents, lsa_genres, lsa_query, lemmas, hashtag_counts, quoted_csv_parse, fixed_width_parse, fixed_width_measured, safe_parse_good, safe_parse_bad, json_field)
}



def _low(x: str) -> str:
    """Lower case with a final sigma at the end of a word, as in Spark."""
    return rf"lower(regexp_replace({x}, '(\p{{L}})Σ([^\p{{L}}]|$)', '\1ς\2', 'g'))"


_LINES = r"""
WITH lines AS (
  SELECT row_number() OVER () AS id, line FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line FROM documents WHERE text IS NOT NULL)
), toks AS (
  SELECT id, i - 1 AS pos, t[i] AS raw FROM (SELECT id, string_split(regexp_replace(line, ' +$', ''), ' ') AS t FROM lines), unnest(range(1, len(t) + 1)) AS r(i)
), low AS (
  SELECT lower(raw) AS token, CASE WHEN regexp_full_match(lower(raw), '[a-z_-]+') THEN 'word' WHEN regexp_full_match(lower(raw), '[0-9]+(\.[0-9]+)?') THEN 'number' END AS c FROM toks
), tagged AS (
  SELECT id, pos, raw, CASE WHEN regexp_full_match(raw, '[a-z_-]+') THEN 'word' WHEN regexp_full_match(raw, '[0-9]+(\.[0-9]+)?') THEN 'number' END AS c FROM toks
)
"""
_STOPPED = ", ".join(f"'{w}'" for w in STOP)
_TF = rf"""
WITH cut AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\p{{L}}+'), lambda x: {_low("x")}) AS w FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, len(w)::INT AS n_terms, term, count(*) AS tf FROM cut, unnest(w) AS t(term) GROUP BY ALL),
spread AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
vocab AS (SELECT term, df, (row_number() OVER (ORDER BY df DESC, term) - 1)::INT AS term_id FROM spread ORDER BY df DESC, term LIMIT 5000),
weighted AS (SELECT *, ln((SELECT count(*) FROM cut)::DOUBLE / df) AS idf FROM vocab)
"""
_IRREGULAR = ", ".join(f"'{a}': '{b}'" for a, b in C.IRREGULAR.items())


def _stemmed(n: int) -> str:
    """The lemma of a form that ends in ``n`` letters of -ing or -ed."""
    x = f"left(w, length(w) - {n})"
    last = f"right({x}, 1)"
    return (
        f"CASE WHEN {last} = left(right({x}, 2), 1) AND {last} NOT IN ('l', 's', 'z') THEN left({x}, length({x}) - 1) "
        f"WHEN {last} IN ('v', 'u', 'c', 'z') OR (length({x}) = 3 AND left(right({x}, 2), 1) IN ('a', 'e', 'i', 'o', 'u') AND {last} NOT IN ('w', 'x', 'y')) THEN {x} || 'e' ELSE {x} END"
    )


_LEMMA = f"""coalesce(MAP {{{_IRREGULAR}}}[w], CASE WHEN w LIKE '%ies' AND length(w) >= 5 THEN left(w, length(w) - 3) || 'y'
    WHEN (w LIKE '%sses' OR w LIKE '%shes' OR w LIKE '%ches') AND length(w) >= 5 THEN left(w, length(w) - 2)
    WHEN w LIKE '%xes' AND length(w) >= 4 THEN left(w, length(w) - 2) WHEN w LIKE '%ied' AND length(w) >= 5 THEN left(w, length(w) - 3) || 'y'
    WHEN w LIKE '%ing' AND length(w) >= 6 AND regexp_matches(left(w, length(w) - 3), '[aeiouy]') THEN {_stemmed(3)}
    WHEN w LIKE '%ed' AND length(w) >= 5 AND regexp_matches(left(w, length(w) - 2), '[aeiouy]') THEN {_stemmed(2)}
    WHEN w LIKE '%s' AND length(w) > 3 AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is') THEN left(w, length(w) - 1) ELSE w END)"""
_WORDS = rf"list_transform(regexp_extract_all(coalesce(text, ''), '\p{{L}}+'), lambda x: {_low('x')})"
_LEMMAS = f"SELECT doc_id, list_filter(list_transform({_WORDS}, lambda w: {_LEMMA}), lambda l: length(l) >= 3 AND l NOT IN ({_STOPPED})) AS lemmas FROM documents"
LEMMA_COUNTS = f"SELECT lemma, count(*) AS n FROM (SELECT unnest(lemmas) AS lemma FROM ({_LEMMAS})) GROUP BY 1"
_COUNT = "SELECT token, count(*) AS n FROM low WHERE c = '{}' {} GROUP BY token"
_FIXED = f"""
WITH f AS (
  SELECT obs_id, obs_year, obs_month, obs_day, obs_hour, round(latitude * 1000) / 1000 AS latitude, round(longitude * 1000) / 1000 AS longitude, elevation_dimension,
    CASE WHEN direction_angle BETWEEN 0 AND 999 THEN direction_angle ELSE 999 END AS direction_angle,
    CASE WHEN round(speed_rate * 10) BETWEEN 0 AND 9998 THEN round(speed_rate * 10) ELSE 9999 END / 10 AS speed_rate,
    CASE WHEN ceiling_height_dimension BETWEEN 0 AND 99998 THEN ceiling_height_dimension ELSE 99999 END AS ceiling_height_dimension,
    CASE WHEN distance_dimension BETWEEN 0 AND 999998 THEN distance_dimension ELSE 999999 END AS distance_dimension,
    CASE WHEN round(dew_point_temperature * 10) BETWEEN -9989 AND 9989 THEN round(dew_point_temperature * 10) ELSE 9999 END / 10 AS dew_point_temperature,
    CASE WHEN round(air_temperature * 10) BETWEEN -9989 AND 9989 THEN round(air_temperature * 10) ELSE 9999 END / 10 AS air_temperature
  FROM weather WHERE {_SHAPED}
)
"""
_EVENTS = """
WITH l AS (
  SELECT event_id, ts, event_type, event_id % 7 = 0 AS bad, value::DECIMAL(18,3) AS v,
         concat_ws(',', event_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), event_type, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE (value::DECIMAL(18,3))::VARCHAR END) AS line
  FROM events
)
"""
SQL = {
    "word_count": _LINES + _COUNT.format("word", ""),
    "number_count": _LINES + _COUNT.format("number", ""),
    "word_count_top": _LINES + _COUNT.format("word", "") + " ORDER BY n DESC, token LIMIT 1000",
    "stopword_top1000": _LINES + _COUNT.format("word", f"AND token NOT IN ({_STOPPED})") + " ORDER BY n DESC, token LIMIT 1000",
    "stopword_top1000_numbers": _LINES + _COUNT.format("number", "") + " ORDER BY n DESC, token LIMIT 1000",
    "word_pairs_m5": _LINES + "SELECT a.raw || ':' || b.raw AS pair, count(*) AS n FROM tagged a JOIN tagged b ON a.id = b.id AND b.pos > a.pos AND b.pos <= a.pos + 5 AND a.c = b.c GROUP BY 1",
    "word_stripes_m5": _LINES + "SELECT lower(a.raw) AS token, " + _low("b.raw") + " AS nbr, count(*) AS n FROM tagged a JOIN tagged b ON a.id = b.id AND a.pos <> b.pos AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 WHERE a.c IS NOT NULL GROUP BY 1, 2",
    "word_stripe_maps": _LINES
    + ", s AS (SELECT lower(a.raw) AS token, " + _low("b.raw") + """ AS nbr, count(*) AS n FROM tagged a JOIN tagged b ON a.id = b.id AND a.pos <> b.pos AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 WHERE a.c IS NOT NULL GROUP BY 1, 2)
SELECT token, count(*)::INT AS n_neighbours, md5(string_agg(nbr || '=' || n, '|' ORDER BY nbr)) AS stripe FROM s GROUP BY 1""",
    "word_stripes_same_class": _LINES
    + r""", lt AS (SELECT id, pos, lower(raw) AS raw, CASE WHEN regexp_full_match(lower(raw), '[a-z_-]+') THEN 'word' WHEN regexp_full_match(lower(raw), '[0-9]+(\.[0-9]+)?') THEN 'number' END AS c FROM toks)
SELECT a.raw AS token, b.raw AS nbr, count(*) AS n FROM lt a JOIN lt b ON a.id = b.id AND a.pos <> b.pos AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 AND a.c = b.c GROUP BY 1, 2""",
    "doc_tf": _TF + "SELECT * FROM tf",
    "doc_df": _TF + "SELECT * FROM spread",
    "idf": _TF + "SELECT term, df, term_id, round(idf, 9) AS idf FROM weighted",
    "tfidf": _TF + "SELECT doc_id, tf.term, term_id, round(idf * tf / n_terms, 9) AS weight FROM tf JOIN weighted ON tf.term = weighted.term",
    "lemmas": _LEMMAS,
    "hashtag_counts": r"SELECT hashtag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '#[\p{L}\p{N}_]+'))) AS hashtag FROM documents) GROUP BY hashtag ORDER BY n DESC, hashtag LIMIT 1000",
    "quoted_csv_parse": problems._PARSED + "SELECT line_id, f[2] AS title, f[6] AS genre, f[8] AS plot FROM cut",
    "fixed_width_parse": _FIXED + "SELECT * FROM f WHERE air_temperature <> 999.9",
    "fixed_width_measured": _FIXED
    + """SELECT obs_id, CASE WHEN direction_angle = 999 THEN -1 ELSE direction_angle END AS direction_angle, nullif(speed_rate, 999.9) AS speed_rate, CASE WHEN ceiling_height_dimension = 99999 THEN -1 ELSE ceiling_height_dimension END AS ceiling_height_dimension,
  CASE WHEN distance_dimension = 999999 THEN -1 ELSE distance_dimension END AS distance_dimension, nullif(dew_point_temperature, 999.9) AS dew_point_temperature FROM f WHERE air_temperature <> 999.9""",
    "safe_parse_good": _EVENTS + "SELECT event_id, date_trunc('second', ts) AS ts, event_type, v::DOUBLE AS value FROM l WHERE NOT bad",
    "safe_parse_bad": _EVENTS + "SELECT line, 'value' AS failed FROM l WHERE bad",
    "json_field": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
