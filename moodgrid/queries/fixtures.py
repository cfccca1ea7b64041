"""Frames derived from the given tables, stated once for both engines.

Every rule is plain arithmetic over all rows of a table. The few functions
whose names differ between the engines go through ``Dialect``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split(" ")


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def fmt(self, value: str, java: str, c: str) -> str:
        return f"date_format({value}, '{java}')" if self.spark else f"strftime({value}, '{c}')"

    def dow(self, value: str) -> str:
        return self.fmt(value, "EEEE", "%A")

    def doy(self, value: str) -> str:
        return self.fmt(value, "MM-dd", "%m-%d")

    def tod(self, value: str) -> str:
        return f"substring({self.fmt(value, 'HH:mm', '%H:%M')}, 1, 4)"

    def plus_minutes(self, value: str, minutes: str) -> str:
        if self.spark:
            return f"{value} + make_dt_interval(0, 0, cast({minutes} as int), 0)"
        return f"{value} + to_minutes(cast({minutes} as bigint))"

    def words(self, text: str) -> str:
        if self.spark:
            return f"explode(split(lower({text}), '[^\\\\p{{{{L}}}}\\\\p{{{{N}}}}_]+'))"
        return f"unnest(regexp_split_to_array(lower({text}), '[^\\p{{{{L}}}}\\p{{{{N}}}}_]+'))"


def _points(d: Dialect) -> str:
    return """
    SELECT cast(event_id AS string) AS id, ts AS tweet_created_at, event_id, user_id, value, event_type,
           -125 + (user_id * 37 % 5800) / 100 AS lon, 25 + (user_id * 53 % 2400) / 100 AS lat
    FROM {events}"""


def _posts(d: Dialect) -> str:
    return """
    SELECT p.id, p.tweet_created_at, p.lon, p.lat, d.text AS pure_text, d.lang, d.source, d.doc_id
    FROM {documents} d JOIN {points} p ON d.doc_id = p.event_id"""


def _weather(d: Dialect) -> str:
    return """
    SELECT id, tweet_created_at, (event_id * 7 % 600) / 10 - 20 AS temp,
           1e-3 + (event_id * 13 % 190) / 10000 AS speh,
           cast(101325 - user_id * 11 % 2000 AS double) AS pres,
           greatest(event_id * 17 % 100 - 70, 0) / 10 AS prcp,
           cast(event_id * 29 % 1000 AS double) AS srad, cast(300 + event_id * 3 % 100 AS double) AS lrad,
           cast(event_id % 21 - 10 AS double) AS wndu, cast(event_id * 3 % 17 - 8 AS double) AS wndv
    FROM {points}"""


def _daily(d: Dialect) -> str:
    return """
    SELECT id, tweet_created_at, lat, lon, greatest(event_id * 17 % 100 - 70, 0) / 10 AS ppt,
           (event_id * 7 % 300) / 10 + 5 AS tmax, (event_id * 7 % 300) / 10 - 3 AS tmin,
           (event_id * 11 % 200) / 50 + 5e-1 AS vpdmax, (event_id * 11 % 100) / 100 AS vpdmin
    FROM {points}"""


def _county(d: Dialect) -> str:
    return """
    SELECT id, tweet_created_at, lon, lat, user_id, event_id,
           1 + user_id % 48 AS fips_state, 1 + 2 * (user_id % 60) AS fips_county
    FROM {points}"""


def _zones(d: Dialect) -> str:
    return """
    SELECT DISTINCT concat(lpad(cast(fips_state AS string), 2, '0'), lpad(cast(fips_county AS string), 3, '0')) AS fips,
           CASE WHEN fips_state % 4 = 0 THEN 'America/New_York' WHEN fips_state % 4 = 1 THEN 'America/Chicago'
                WHEN fips_state % 4 = 2 THEN 'America/Denver' ELSE 'America/Los_Angeles' END AS tz
    FROM {county}"""


def _census(d: Dialect) -> str:
    return """
    SELECT id, tweet_created_at, cast(10000 + user_id * 7919 % 60000 AS double) AS income_percap,
           (user_id * 31 % 60) / 100 AS race_white, (user_id * 17 % 40) / 100 AS race_black,
           (user_id * 13 % 30) / 100 AS race_other, (user_id * 7 % 35) / 100 AS race_hisp
    FROM {points}"""


def _sentiment(d: Dialect) -> str:
    return """
    SELECT id, tweet_created_at, cast(event_id % 13 = 0 AS int) AS weather_term,
           value / 50 - 2 AS afinn, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 5 + value / 300 END AS hedono,
           (event_id * 37 % 200) / 100 - 1 AS vader
    FROM {points}"""


def _depressive(d: Dialect) -> str:
    return "SELECT id, tweet_created_at, cast(event_id % 19 = 0 AS int) AS depress_term FROM {points}"


def _localtime(d: Dialect) -> str:
    at = "tweet_created_at"
    return f"""
    SELECT lpad(cast(1000 * (1 + user_id % 48) + 1 AS string), 5, '0') AS fips, id, tweet_created_at,
           {d.dow(at)} AS dow, {d.doy(at)} AS doy,
           CASE WHEN event_id % 97 = 0 THEN 'EST' ELSE {d.tod(at)} END AS tod,
           cast(year({at}) AS int) AS year
    FROM {{points}}"""


def _ships(d: Dialect) -> str:
    at = d.plus_minutes("l_shipdate", "(l_partkey * 7 + l_linenumber * 131) % 1440")
    return f"""
    SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string)) AS id,
           {at} AS shipped, 1 + l_suppkey % 48 AS state_no,
           1000 * (1 + l_suppkey % 48) + 1 + 2 * cast(floor(l_suppkey / 48) AS bigint) AS fips_no,
           (l_partkey * 37 % 500) / 10 - 15 AS temp, l_orderkey, l_partkey, l_suppkey, l_linenumber,
           l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate
    FROM {{lineitem}}"""


def _panel(d: Dialect) -> str:
    return f"""
    SELECT id, lpad(cast(fips_no AS string), 5, '0') AS fips, lpad(cast(state_no AS string), 2, '0') AS state,
           cast(shipped AS date) AS date, {d.dow('shipped')} AS dow, {d.doy('shipped')} AS doy, {d.tod('shipped')} AS tod,
           cast(year(shipped) AS int) AS year,
           concat(lpad(cast(state_no AS string), 2, '0'), '-', {d.fmt('shipped', 'MM', '%m')}) AS statemonth,
           temp, temp * 8e-1 + l_quantity / 10 - 4 AS wbgt,
           greatest(l_orderkey * 17 % 100 - 70, 0) / 10 AS prcp,
           cast((l_orderkey * 29 + l_linenumber * 53) % 1000 AS double) AS srad,
           cast(10000 + l_suppkey * 7919 % 60000 AS double) AS income_percap,
           (l_suppkey * 31 % 60) / 100 AS race_white, (l_suppkey * 17 % 40) / 100 AS race_black,
           (l_suppkey * 13 % 30) / 100 AS race_other, (l_suppkey * 7 % 35) / 100 AS race_hisp,
           cast(l_orderkey % 13 = 0 AS int) AS weather_term, cast(l_partkey * l_linenumber % 19 = 0 AS int) AS depress_term,
           l_extendedprice / 61111 - 9e-1 - 2e-3 * greatest(temp - 20, 0) AS vader,
           l_quantity / 25013e-3 - 1 + l_discount AS afinn, 5 + l_tax * 97113171e-7 - l_discount * 30177193e-7 AS hedono
    FROM {{ships}}"""


def _words(d: Dialect) -> str:
    return f"SELECT DISTINCT word FROM (SELECT {d.words('text')} AS word FROM {{benchmark}}) t WHERE word <> ''"


def _lexicon(d: Dialect) -> str:
    return """
    SELECT word, (length(word) * 3 + instr(word, 'e') * 2 + instr(word, 'n')) % 11 - 5 AS afinn,
           1e0 + (length(word) * 5 + instr(word, 'a') * 3 + instr(word, 't')) % 9 AS hedono,
           (length(word) * 7 + instr(word, 'i') * 2 + instr(word, 'r')) % 9 / 2 - 2 AS valence
    FROM {words}"""


def _deaths(d: Dialect) -> str:
    return """
    SELECT fips, year, substring(statemonth, 4, 2) AS month,
           CASE WHEN sum(depress_term) % 5 = 4 THEN NULL ELSE cast(sum(depress_term) AS bigint) END AS deaths,
           cast(sum(depress_term + weather_term) AS bigint) AS mort
    FROM {panel} GROUP BY fips, year, substring(statemonth, 4, 2)"""


def _population(d: Dialect) -> str:
    return "SELECT fips, year, 1000 + 37 * count(*) AS population FROM {panel} GROUP BY fips, year"


def _survey(d: Dialect) -> str:
    return f"""
    SELECT o_orderkey, lpad(cast(1 + o_custkey % 48 AS string), 2, '0') AS state,
           {d.fmt('o_orderdate', 'MMddyyyy', '%m%d%Y')} AS idate,
           cast(CASE WHEN o_orderkey % 100 < 60 THEN 88 WHEN o_orderkey % 100 < 64 THEN 77
                     WHEN o_orderkey % 100 < 68 THEN 99 WHEN o_orderkey % 100 < 70 THEN NULL
                     ELSE 1 + o_orderkey % 30 END AS int) AS menthlth
    FROM {{orders}}"""


def _nibrs(d: Dialect) -> str:
    return f"""
    SELECT CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE fips_no END AS fips,
           {d.fmt('l_shipdate', 'yyyy-MM-dd', '%Y-%m-%d')} AS date, l_orderkey,
           CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE cast(hour(shipped) AS int) END AS hour,
           CASE WHEN l_returnflag = 'R' THEN 'R' END AS report_date_flag,
           CASE l_partkey % 6 WHEN 0 THEN 'Homicide Offenses' WHEN 1 THEN 'Assault Offenses' WHEN 2 THEN 'Arson'
                WHEN 3 THEN 'Fraud Offenses' WHEN 4 THEN 'Robbery' ELSE 'Bribery' END AS offense_category_name
    FROM {{ships}}"""


def _cod(d: Dialect) -> str:
    return f"""
    SELECT concat(lpad(cast(1000 * (1 + o_custkey % 48) + 1 + 2 * (o_custkey % 3) AS string), 5, '0'), '0001') AS census_block,
           {d.fmt('o_orderdate', 'yyyy-MM-dd HH:mm', '%Y-%m-%d %H:%M')} AS date_single,
           CASE o_orderkey % 5 WHEN 0 THEN 'homicide offenses' WHEN 1 THEN 'assault offenses' WHEN 2 THEN 'robbery'
                WHEN 3 THEN 'fraud offenses' ELSE 'arson' END AS offense_group
    FROM {{orders}}"""


def _coefs(d: Dialect) -> str:
    return """
    SELECT cast(l_linenumber AS int) AS replicate, 'wbgt' AS term, regr_slope(l_extendedprice, l_quantity) / 10000 AS estimate
    FROM {lineitem} GROUP BY l_linenumber
    UNION ALL
    SELECT cast(l_linenumber AS int), 'wbgt_10', -regr_slope(l_extendedprice, l_discount) / 1000000
    FROM {lineitem} GROUP BY l_linenumber
    UNION ALL
    SELECT cast(l_linenumber AS int), 'income:wbgt', regr_slope(l_tax, l_quantity)
    FROM {lineitem} GROUP BY l_linenumber"""


DERIVED = {
    "points": (_points, ("events",)),
    "posts": (_posts, ("documents", "points")),
    "weather": (_weather, ("points",)),
    "daily": (_daily, ("points",)),
    "county": (_county, ("points",)),
    "zones": (_zones, ("county",)),
    "census": (_census, ("points",)),
    "sentiment": (_sentiment, ("points",)),
    "depressive": (_depressive, ("points",)),
    "localtime": (_localtime, ("points",)),
    "ships": (_ships, ("lineitem",)),
    "panel": (_panel, ("ships",)),
    "words": (_words, ("benchmark",)),
    "lexicon": (_lexicon, ("words",)),
    "deaths": (_deaths, ("panel",)),
    "population": (_population, ("panel",)),
    "survey": (_survey, ("orders",)),
    "nibrs": (_nibrs, ("ships",)),
    "cod": (_cod, ("orders",)),
    "coefs": (_coefs, ("lineitem",)),
}


def derive(tables, name: str) -> DataFrame:
    rule, inputs = DERIVED[name]
    return tables.spark.sql(rule(Dialect(spark=True)), **{i: getattr(tables, i) for i in inputs})


def duckdb_ctes(names: Sequence[str]) -> str:
    """The named frames and what they build on, in order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in done:
            return
        for inner in DERIVED[name][1]:
            visit(inner)
        done.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in done:
        rule, inputs = DERIVED[name]
        parts.append(f"{name} AS ({rule(Dialect(spark=False)).format(**{i: i for i in inputs})})")
    return ",\n".join(parts)


def literal_rows(tables, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A declared lookup of a few rows."""
    return tables.spark.createDataFrame(list(rows), schema)

