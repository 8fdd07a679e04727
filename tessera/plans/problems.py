"""Queries p2, p4, p5 and p7 over whole tables, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import packed, places, records, spikes
from tessera.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return records.failed_records(table(spark, d, "movie_lines"), "line_id", "raw_line")


def p2_valid(spark: SparkSession, d: str) -> DataFrame:
    return records.strict_load(table(spark, d, "movie_lines"), "line_id", "raw_line")


def trip_ends(spark: SparkSession, d: str) -> DataFrame:
    trips = table(spark, d, "taxi_trips")
    return trips.select("trip_id", F.expr("stack(2, 'pickup', pickup_lon, pickup_lat, 'dropoff', dropoff_lon, dropoff_lat) as (trip_end, lon, lat)"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    stands = table(spark, d, "stands").select("stand_id", "stand_lon", "stand_lat", "radius_m")
    zones = table(spark, d, "zones").select("zone_id", "boundary")
    return places.points_at_places(trip_ends(spark, d), ["trip_id", "trip_end"], "lon", "lat", stands, zones)


WEATHER_FIELDS = ("air_temperature", "dew_point_temperature", "speed_rate")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    air, dew, wind = (F.col(c) for c in WEATHER_FIELDS)
    impossible = {
        "air_temperature": (air < -90) | (air > 60),
        "dew_point_temperature": (dew < -90) | (dew > 60) | F.coalesce(dew > air, F.lit(False)),
        "speed_rate": (wind < 0) | (wind > 110),
    }
    return spikes.implausible_readings(table(spark, d, "weather"), "obs_id", "station_id", "obs_time", WEATHER_FIELDS, impossible, 999.9, {"speed_rate": 0.0})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_packed(table(spark, d, "films"), "film_id", "genre", "origin", value="genre_value")


def p7_delimiters(spark: SparkSession, d: str) -> DataFrame:
    return packed.infer_delimiters(table(spark, d, "films"), "genre", "origin")


QUERIES = {"p2_found": p2_found, "p2_valid": p2_valid, "p4_found": p4_found, "p5_found": p5_found, "p7_found": p7_found, "p7_delimiters": p7_delimiters}

# The field grammar without possessive loops: a backslash before a quote always escapes it.
_INNER = r"""(?:[^"\\]|""|\\+"|\\+[^"\\])*"""
_FIELD = rf"""(?:"{_INNER}"|[^",]*)"""
_NOTHING = r"""[\p{P}\p{S}\p{Z}\p{Cf}\s]*"""
_LIST = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _says(c: str, name: bool) -> str:
    bare = rf"lower(trim(regexp_replace({c}, '^[\s\p{{Z}}\[({{<]+|[\s\p{{Z}}\])}}>]+$', '', 'g')))"
    bad = r"[\x{FFFD}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]"
    word = f"{bare} IN ({_LIST(records.ABSENCES)})" + (rf" AND regexp_full_match({c}, '[\s\p{{Z}}]*[\[({{<].*[\])}}>][\s\p{{Z}}]*')" if name else "")
    return f"(NOT regexp_full_match({c}, '{_NOTHING}') AND {bare} NOT IN ({_LIST(records.MARKERS)}) AND NOT ({word}) AND NOT regexp_matches({c}, '{bad}'))"


_PLAIN = r"""CASE WHEN x[1] = '"' THEN regexp_replace(regexp_replace(x, '^"((?s:.*))"$', '\1'), '\\"|""', '"', 'g') ELSE x END"""
_PARSED = rf"""
WITH seen AS (
  SELECT line_id, raw_line, regexp_full_match(',' || raw_line, '(?:,{_FIELD})+') AS quoted_ok,
         regexp_full_match(',' || raw_line, '(?:,{_FIELD}){{8}}') AS eight
  FROM movie_lines
), cut AS (
  SELECT line_id, list_transform(regexp_extract_all(',' || raw_line, ',({_FIELD})', 1), lambda x: {_PLAIN}) AS f FROM seen WHERE eight
), good AS (
  SELECT * FROM cut
  WHERE regexp_full_match(f[1], '[0-9]{{4}}') AND TRY_CAST(f[1] AS INT) BETWEEN 1880 AND 2030 AND {_says("f[2]", True)} AND {_says("f[8]", False)}
)
"""

SQL = {
    "p2_found": _PARSED
    + """SELECT line_id, CASE WHEN raw_line IS NULL THEN 'columns' WHEN NOT quoted_ok THEN 'quoting' WHEN NOT eight THEN 'columns' ELSE 'value' END AS reason
FROM seen WHERE line_id NOT IN (SELECT line_id FROM good)""",
    "p2_valid": _PARSED + "SELECT line_id, " + ", ".join(f"f[{k + 1}] AS {c}" for k, c in enumerate(records.MOVIE_COLUMNS)) + " FROM good",
    "p4_found": """
WITH ends AS (
  SELECT trip_id, 'pickup' AS trip_end, pickup_lon AS lon, pickup_lat AS lat FROM taxi_trips
  UNION ALL SELECT trip_id, 'dropoff', dropoff_lon, dropoff_lat FROM taxi_trips
), ok AS (
  SELECT * FROM ends WHERE isfinite(lon) AND isfinite(lat)
), pieces AS (
  SELECT zone_id, json(boundary) AS g FROM zones
), multi AS (
  SELECT zone_id, CASE WHEN g->>'$.type' = 'Polygon' THEN json_array(g->'$.coordinates') ELSE g->'$.coordinates' END AS c FROM pieces
), each_piece AS (
  SELECT zone_id, i AS piece, json_extract(c, '$[' || i || ']') AS p FROM multi, unnest(range(json_array_length(c)::BIGINT)) AS t(i)
), each_ring AS (
  SELECT zone_id, piece, json_extract(p, '$[' || i || ']')::DOUBLE[][] AS r FROM each_piece, unnest(range(json_array_length(p)::BIGINT)) AS t(i)
), edges AS (
  SELECT zone_id, piece, r[i][1] AS x1, r[i][2] AS y1, r[i % len(r) + 1][1] AS x2, r[i % len(r) + 1][2] AS y2
  FROM each_ring, unnest(range(1, len(r) + 1)) AS t(i)
), inside AS (
  SELECT trip_id, trip_end, zone_id AS place_id FROM ok, edges
  WHERE lon >= least(x1, x2) AND lon < greatest(x1, x2) AND lat < y1 + (lon - x1) * (y2 - y1) / (x2 - x1)
  GROUP BY trip_id, trip_end, zone_id, piece HAVING count(*) % 2 = 1
), near AS (
  SELECT trip_id, trip_end, stand_id AS place_id FROM ok, stands
  WHERE abs(lat) <= 90 AND abs(lon) <= 180 AND 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(stand_lat - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(stand_lat)) * pow(sin(radians(stand_lon - lon) / 2), 2)))) <= radius_m
)
SELECT DISTINCT * FROM inside UNION ALL SELECT DISTINCT * FROM near""",
}

_WORD = r"[\p{L}\p{M}\p{N}]"
_SEP = r"\p{P}\p{S}\p{Cc}"
_G = ("\ue001", "\ue002", "\ue003")  # stand for a hyphen, an apostrophe and an ampersand inside a name


def _guarded(x: str) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, '({_WORD})-({_WORD})', '\\1{_G[0]}\\2', 'g')"
        x = f"regexp_replace({x}, '({_WORD})''({_WORD})', '\\1{_G[1]}\\2', 'g')"
    return f"regexp_replace({x}, '({_WORD} *)&( *{_WORD})', '\\1{_G[2]}\\2', 'g')"


SQL["p7_found"] = rf"""
WITH once AS (SELECT DISTINCT film_id, genre FROM films WHERE genre IS NOT NULL),
cut AS (
  SELECT film_id, regexp_extract_all({_guarded("genre")}, '""[^"]+""|"[^"]*"|“[^“”]*”|''[^'']*''|[{_SEP}]|[^{_SEP}]+') AS t FROM once
), flat AS (
  SELECT film_id, array_to_string(list_transform(t, lambda x: CASE
    WHEN length(x) > 1 AND x[1] IN ('"', '“', '''') THEN chr(1) || regexp_replace(x, '^["“'']+|["”'']+$', '', 'g') || chr(1)
    WHEN regexp_full_match(x, '[{_SEP}]') THEN chr(1) ELSE x END), '') AS s FROM cut
), tidy AS (
  SELECT film_id, list_filter(list_transform(string_split(s, chr(1)), lambda x: trim(regexp_replace(
    replace(replace(replace(lower(x), '{_G[0]}', '-'), '{_G[1]}', ''''), '{_G[2]}', '&'), '[\s\p{{Z}}]+', ' ', 'g'))), lambda x: x <> '') AS v FROM flat
)
SELECT film_id, i::INT AS pos, v[i] AS genre_value FROM tidy, unnest(range(1, len(v) + 1)) AS r(i)"""
