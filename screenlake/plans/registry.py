"""The registry of queries, and the SQL text that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


ATTEMPTS = """
a0 AS (
    SELECT event_id AS event_index, epoch_us(ts) // 1000 AS ts_ms, user_id AS account,
           event_type || '-' || (CAST(props->>'$.k' AS BIGINT) % 4) AS token, event_type, value, 1.0::DOUBLE + user_id % 2 AS weight,
           1 + (event_id + user_id * 15485863) // 50000 AS generation, 1 + (event_id + user_id * 32452843) // 5000 AS version,
           ((event_id + user_id * 32452843) % 5000) / 5000.0::DOUBLE AS age_fraction
    FROM events
), attempts AS (
    SELECT *, age_fraction < 0.05 AS rotation_recent, CASE label WHEN 'VALID' THEN 'MATCH' WHEN 'NO_ACCOUNT' THEN 'NO_ACCOUNT' ELSE 'CREDENTIAL_MISMATCH' END AS result
    FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN 'VALID' WHEN event_type = 'signup' THEN 'NO_ACCOUNT'
                         WHEN row_number() OVER (PARTITION BY account, generation, version, token ORDER BY event_index) = 1 THEN 'INVALID_DISTINCT'
                         ELSE 'INVALID_REPEATED' END AS label FROM a0)
)"""
MEMBERS = """
members AS (
    SELECT account, token FROM (
        SELECT account, token, row_number() OVER (PARTITION BY account ORDER BY count(*) DESC, token) AS r FROM attempts GROUP BY account, token)
    WHERE r = 1
)"""
VERSIONS = "versions AS (SELECT account, generation, version, min(event_index) AS valid_from FROM attempts GROUP BY ALL)"
POINTS = """
points AS (
    SELECT l_suppkey % 20 AS seed, l_returnflag AS method, l_linestatus AS profile, l_linenumber::BIGINT AS load, count(*) AS offered,
           sum(CASE WHEN l_discount < 0.03 THEN 1 ELSE 0 END)::BIGINT AS dropped, sum(CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END)::BIGINT AS timed_out,
           sum(l_quantity::BIGINT)::BIGINT AS checks, round(avg(l_extendedprice), 6) AS p99
    FROM lineitem GROUP BY ALL
)"""
SPECS = "specs AS (SELECT p_partkey AS spec, p_brand AS family, p_size::BIGINT AS memory, p_retailprice / 2500.0::DOUBLE AS ffr FROM part)"


def h32(text: str, at: int = 0) -> str:
    """SQL of the unsigned 32 bits that functions.scalars.hash32 takes."""
    return f"CAST('0x' || substr(md5({text}), {1 + 8 * at}, 8) AS BIGINT)"


def encoded(*columns: str) -> str:
    """SQL of functions.scalars.encode_fields."""
    return " || ".join(f"lpad(length({c}::VARCHAR)::VARCHAR, 8, '0') || {c}::VARCHAR" for c in columns)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, digits) + 0.0 for c, t in df.dtypes if t == "double"})
