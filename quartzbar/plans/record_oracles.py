"""SQL of the records that fail to parse and of those that load, and of the regular grid."""

from __future__ import annotations

from quartzbar.functions.fields import QUANTITY_OF

_BLANK = r"[ \t\r\n\v\f\x{00a0}\x{3000}]"
_CELL = rf'{_BLANK}*"[^"]*(?:""[^"]*)*"{_BLANK}*|[^",]*'
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_NAMES = ", ".join(f"'{n}'" for n in QUANTITY_OF)


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"


def _number(i: int) -> str:
    return f"CASE WHEN regexp_full_match(c[{i}], '{_NUMBER}') THEN TRY_CAST(ltrim(c[{i}], '+') AS DOUBLE) END"


# Cells by one expression with a delimiter put before the record, so that every cell has one.
JUDGED = f"""
raw AS (SELECT rec_id, regexp_replace(regexp_replace(record, '^\\x{{feff}}', ''), '\\r$', '') AS r FROM archive_records WHERE record IS NOT NULL),
told AS (SELECT rec_id, r, regexp_full_match(r, '(?:{_CELL})(?:,(?:{_CELL}))*') AS whole FROM raw WHERE NOT regexp_full_match(r, '{_BLANK}*')),
cells AS (
  SELECT rec_id, whole, CASE WHEN whole THEN list_transform(regexp_extract_all(',' || r, ',({_CELL})', 1),
    lambda x: CASE WHEN starts_with({_trim("x")}, '"') THEN {_trim("replace(substr(" + _trim("x") + ", 2, length(" + _trim("x") + ") - 2), '\"\"', '\"')")} ELSE {_trim("x")} END) END AS c
  FROM told
),
data AS (
  SELECT * FROM cells WHERE c IS NULL OR len(c) < 2 OR len(list_filter(c, lambda x: x NOT IN ({_NAMES}) AND lower(x) NOT IN ({_NAMES}))) > 0
),
typed AS (
  SELECT rec_id, whole, c, CASE
      WHEN regexp_full_match(c[1], '[0-9]+') THEN CASE WHEN length(c[1]) < 19 THEN CAST(c[1] AS HUGEINT) * CASE WHEN CAST(c[1] AS HUGEINT) <= 10000000000 THEN 1000000 ELSE 1000 END ELSE 4611686018427387904 END
      WHEN regexp_full_match(c[1], '[0-9]{{4}}-?[0-9]{{2}}-?[0-9]{{2}}[T ][0-9]{{2}}:?[0-9]{{2}}.*') THEN epoch_us(TRY_CAST(c[1] AS TIMESTAMPTZ)) END AS t,
    {", ".join(f"{_number(i)} AS n{i}" for i in (2, 3, 4, 5, 6, 8, 9, 10, 11))}
  FROM data
),
judged AS (
  SELECT *, CASE WHEN NOT whole THEN 'quoting' WHEN len(c) <> 12 THEN 'column_count'
    WHEN coalesce(t >= 1577836800000000 AND t < 4102444800000000 AND n2 > 0 AND n3 > 0 AND n4 > 0 AND n5 > 0 AND n6 >= 0
      AND n4 <= least(n2, n5) AND n3 >= greatest(n2, n5) AND (c[8] = '' OR n8 >= 0) AND (c[9] = '' OR (n9 >= 0 AND n9 = floor(n9))) AND (c[10] = '' OR n10 >= 0) AND (c[11] = '' OR n11 >= 0), false)
    THEN NULL ELSE 'invalid_value' END AS reason
  FROM typed
)
"""
_MINUTE = 60_000_000
SQL = {
    "p5_found": f"WITH {JUDGED} SELECT rec_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_bars": f"""
WITH {JUDGED} SELECT rec_id, CAST(t AS BIGINT) AS open_time_us, n2 AS open, n3 AS high, n4 AS low, n5 AS close, n6 AS volume, c[7] AS close_time, n8 AS quote_volume, n9 AS count,
  n10 AS taker_buy_volume, n11 AS taker_buy_quote_volume, c[12] AS "ignore" FROM judged WHERE reason IS NULL
""",
    "kline_rows": f"""
WITH {JUDGED} SELECT CAST(t AS BIGINT) AS t_us, n2 AS open, n3 AS high, n4 AS low, n5 AS close, n6 AS volume, n8 AS quote_volume, n9 AS number_of_trades FROM judged WHERE reason IS NULL
""",
    "p4_grid": f"""
WITH k AS (
  SELECT symbol, epoch_us(open_time) AS t, CAST(floor((epoch_us(open_time) + 30000000) / {_MINUTE}) AS BIGINT) AS m, close, volume,
         row_number() OVER (PARTITION BY symbol, CAST(floor((epoch_us(open_time) + 30000000) / {_MINUTE}) AS BIGINT) ORDER BY coalesce(epoch_us(ingested_at), -1) DESC, bar_id DESC) AS k
  FROM bars WHERE symbol IS NOT NULL AND open_time IS NOT NULL AND NOT isnan(close) AND NOT isnan(volume)
), r AS MATERIALIZED (SELECT * EXCLUDE (k) FROM k WHERE k = 1),
g AS MATERIALIZED (
  SELECT DISTINCT symbol, unnest(range(CAST(ceil(epoch_us(start_time) / {_MINUTE}) AS BIGINT), CAST(ceil(epoch_us(end_time) / {_MINUTE}) AS BIGINT))) AS m FROM coverage_windows
), near AS (SELECT symbol, t, close, volume, m + unnest(range(-7, 8)) AS m FROM r),
j AS (SELECT g.symbol, g.m, (n.t - g.m * {_MINUTE}) / {6.0 * _MINUTE} AS d, n.close AS c, n.volume AS v FROM g JOIN near AS n ON n.symbol = g.symbol AND n.m = g.m WHERE abs(n.t - g.m * {_MINUTE}) < {6 * _MINUTE}),
s AS (
  SELECT symbol, m, count(*) AS readings, sum(1 - d * d) AS s0, sum((1 - d * d) * d) AS s1, sum((1 - d * d) * d * d) AS s2, sum((1 - d * d) * (1 - d * d)) AS w2,
         sum((1 - d * d) * c) AS c0, sum((1 - d * d) * d * c) AS c1, sum((1 - d * d) * v) AS v0, sum((1 - d * d) * d * v) AS v1
  FROM j GROUP BY ALL
), f AS (
  SELECT symbol, m, readings, s0 * s0 / w2 AS support, CASE WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 THEN (s2 * c0 - s1 * c1) / (s0 * s2 - s1 * s1) ELSE c0 / s0 END AS cf,
         greatest(0, CASE WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 THEN (s2 * v0 - s1 * v1) / (s0 * s2 - s1 * s1) ELSE v0 / s0 END) AS vf FROM s
), a AS (
  SELECT g.symbol, g.m * 60000 AS minute_ms, r.m IS NULL AS missing, CASE WHEN r.m IS NOT NULL THEN 'read' WHEN coalesce(f.support, 0) >= 2 THEN 'filled' ELSE 'missing' END AS status,
         r.close AS oc, r.volume AS ov, CASE WHEN f.support >= 2 THEN cf END AS close_fit, CASE WHEN f.support >= 2 THEN vf END AS volume_fit, coalesce(f.support, 0) AS support, CAST(coalesce(readings, 0) AS INTEGER) AS readings
  FROM g LEFT JOIN r ON r.symbol = g.symbol AND r.m = g.m LEFT JOIN f ON f.symbol = g.symbol AND f.m = g.m
), b AS (SELECT *, CASE WHEN missing THEN close_fit ELSE oc END AS close, CASE WHEN missing THEN volume_fit ELSE ov END AS volume FROM a)
SELECT symbol, minute_ms, missing, status, readings, CASE WHEN missing THEN CAST(CAST(close AS FLOAT) AS DOUBLE) ELSE close END AS close, CASE WHEN missing THEN CAST(CAST(volume AS FLOAT) AS DOUBLE) ELSE volume END AS volume,
       {", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in ("close_fit", "volume_fit", "support"))} FROM b
""",
}
