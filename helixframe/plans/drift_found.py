"""Problem 6: changes of schema between the files of an instrument, and one table of all records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.schema_drift import conform, migration_rules, schema_changes, schema_versions
from helixframe.session import table

def p6_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change with its migration step."""
    return schema_changes(table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "col_dictionary"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_changes(spark, sf_dir).select("file_id", "field_name", "change")


def p6_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_versions(table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "col_dictionary"))


def p6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The migration rules of each version of each instrument's schema."""
    return migration_rules(table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "col_dictionary")).withColumn("names", F.array_join("names", ","))


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "col_dictionary"))


QUERIES = {"p6_found": p6_found, "p6_changes": p6_changes, "p6_versions": p6_versions, "p6_rules": p6_rules, "p6_table": p6_table}

_C = """WITH f AS (
  SELECT file_id, instrument, row_number() OVER (PARTITION BY instrument ORDER BY written_at, file_id) AS seq,
         lead(file_id) OVER (PARTITION BY instrument ORDER BY written_at, file_id) AS next_file
  FROM (SELECT file_id, min(instrument) AS instrument, min(written_at) AS written_at FROM raw_records GROUP BY file_id)
), kv AS (
  SELECT file_id, unnest(json_keys(payload)) AS k, unnest(json_extract(payload, '$.*')) AS v
  FROM raw_records WHERE json_valid(payload)
), h AS (
  SELECT kv.file_id, d.field_name, list_sort(list(DISTINCT d.col_name)) AS names,
         max(CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN 4 WHEN 'VARCHAR' THEN 3 WHEN 'DOUBLE' THEN 2 ELSE 1 END) AS type
  FROM kv JOIN col_dictionary d ON lower(trim(kv.k)) = lower(trim(d.col_name)) GROUP BY kv.file_id, d.field_name
), c AS (
  SELECT f.*, h.field_name, h.names, h.type, lag(seq) OVER w AS before, lead(seq) OVER w AS after, lag(names) OVER w AS old_names,
         last_value(type IGNORE NULLS) OVER (PARTITION BY instrument, field_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_type
  FROM f JOIN h ON f.file_id = h.file_id WINDOW w AS (PARTITION BY instrument, field_name ORDER BY seq)
)
"""
_KIND = "CASE {} WHEN 1 THEN 'integer' WHEN 2 THEN 'real' WHEN 3 THEN 'text' ELSE 'list' END"
_NAMES, _OLD = "array_to_string(names, ',')", "array_to_string(old_names, ',')"
_CASES = f"""SELECT file_id, field_name, 'added' AS change, 'default before' AS step FROM c WHERE seq > 1 AND (before IS NULL OR before < seq - 1)
UNION ALL SELECT next_file, field_name, 'removed', 'default from here' FROM c WHERE next_file IS NOT NULL AND (after IS NULL OR after > seq + 1)
UNION ALL SELECT file_id, field_name, 'renamed', 'rename ' || {_NAMES} || ' from ' || {_OLD} FROM c WHERE before = seq - 1 AND names <> old_names
UNION ALL SELECT file_id, field_name, 'retyped', 'cast ' || {_KIND.format('old_type')} || ' to ' || {_KIND.format('type')} FROM c WHERE before = seq - 1 AND type <> old_type"""
_V = f"""{_C.rstrip()}, e AS (
  SELECT file_id, md5(array_to_string(list_sort(list(field_name || ':' || {_NAMES} || ':' || coalesce(CAST(type AS VARCHAR), '?'))), ';')) AS fingerprint, count(*) AS n_fields FROM h GROUP BY file_id
), g AS (SELECT f.*, coalesce(fingerprint, '') AS fingerprint, coalesce(n_fields, 0) AS n_fields FROM f LEFT JOIN e ON f.file_id = e.file_id),
l AS (SELECT *, CASE WHEN fingerprint = lag(fingerprint) OVER (PARTITION BY instrument ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM g),
v AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY instrument ORDER BY seq) AS BIGINT) AS version FROM l)
"""

SQL = {
    "p6_found": f"{_C} SELECT file_id, field_name, change FROM ({_CASES})",
    "p6_changes": f"{_C} {_CASES}",
    "p6_versions": f"{_V} SELECT instrument, version, fingerprint, n_fields, arg_min(file_id, seq) AS first_file, count(*) AS n_files FROM v GROUP BY instrument, version, fingerprint, n_fields",
}
