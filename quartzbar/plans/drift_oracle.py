"""SQL of the changes of feeds: kinds of all values of each column, compared from file to file."""

from __future__ import annotations

from quartzbar.functions.fields import QUANTITY_OF

_NAMES = ", ".join(f"('{n}', '{f}')" for n, f in QUANTITY_OF.items())
_LENGTH = "length(ltrim(ltrim({0}, '+-'), '0'))"
_INTEGER = f"CASE WHEN {_LENGTH} <= 11 THEN 's' WHEN {_LENGTH} <= 14 THEN 'ms' ELSE 'us' END"

SQL = {
    "p1_found": f"""
WITH spelled AS (SELECT * FROM (VALUES {_NAMES}) AS n(name, field)),
files AS (SELECT file_id, feed, file_format, header, row_number() OVER (PARTITION BY feed ORDER BY file_seq, file_id) AS k FROM feed_files),
heads AS (SELECT file_id, unnest(range(len(string_split(header, ',')))) AS pos, unnest(string_split(header, ',')) AS name FROM files WHERE file_format = 'csv' AND header IS NOT NULL),
cells AS (
  SELECT r.file_id, unnest(range(len(string_split(record, ',')))) AS pos, trim(unnest(string_split(record, ','))) AS x FROM feed_rows AS r JOIN files USING (file_id) WHERE file_format = 'csv' AND record IS NOT NULL
), objects AS (
  SELECT r.file_id, CAST(record AS JSON) AS j FROM feed_rows AS r JOIN files USING (file_id) WHERE file_format = 'jsonl' AND json_valid(record) AND json_type(CASE WHEN json_valid(record) THEN record END) = 'OBJECT'
), members AS (SELECT file_id, key, json_extract(j, '$."' || key || '"') AS v FROM (SELECT file_id, j, unnest(json_keys(j)) AS key FROM objects)),
kinds AS (
  SELECT h.file_id, trim(h.name) AS name, CASE WHEN x IS NULL OR x = '' THEN NULL WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN {_INTEGER.format("x")}
      WHEN regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'd' ELSE 't' END AS kind
  FROM heads AS h LEFT JOIN cells AS c ON c.file_id = h.file_id AND c.pos = h.pos
  UNION ALL
  SELECT file_id, trim(key), CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN 'b' WHEN 'DOUBLE' THEN 'd' WHEN 'VARCHAR' THEN CASE WHEN trim(v->>'$') <> '' THEN 't' END
      WHEN 'ARRAY' THEN 't' WHEN 'OBJECT' THEN 't' ELSE {_INTEGER.format("CAST(v AS VARCHAR)")} END FROM members
), columns AS (
  SELECT file_id, coalesce(s.field, k.name) AS field, list_sort(list(DISTINCT k.name)) AS names, list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)) AS found FROM kinds AS k LEFT JOIN spelled AS s ON s.name = k.name GROUP BY ALL
), own AS (
  SELECT f.feed, f.k, f.file_id, c.field, c.names, CASE
      WHEN found IS NULL OR len(found) = 0 THEN NULL WHEN found = ['b'] THEN 'boolean' WHEN list_contains(found, 't') OR list_contains(found, 'b') THEN 'text' WHEN list_contains(found, 'd') THEN 'decimal'
      WHEN field IN ('open_time', 'close_time') AND len(found) = 1 THEN 'integer_' || found[1] ELSE 'integer' END AS type
  FROM columns AS c JOIN files AS f USING (file_id)
), runs AS (SELECT *, k - row_number() OVER (PARTITION BY feed, field ORDER BY k) AS run FROM own),
carried AS (SELECT feed, k, file_id, field, names, last_value(type IGNORE NULLS) OVER (PARTITION BY feed, field, run ORDER BY k) AS type FROM runs)
SELECT c.file_id, c.field, unnest(list_filter([CASE WHEN p.k IS NULL AND c.k > 1 THEN 'added' END, CASE WHEN p.names <> c.names THEN 'renamed' END, CASE WHEN p.type <> c.type THEN 'retyped' END], lambda x: x IS NOT NULL)) AS change
FROM carried AS c LEFT JOIN carried AS p ON p.feed = c.feed AND p.field = c.field AND p.k = c.k - 1
UNION ALL
SELECT f.file_id, p.field, 'removed' FROM carried AS p JOIN files AS f ON f.feed = p.feed AND f.k = p.k + 1 ANTI JOIN carried AS c ON c.feed = p.feed AND c.field = p.field AND c.k = p.k + 1
""",
}
