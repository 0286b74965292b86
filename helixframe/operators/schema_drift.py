"""Schemas that drift between files: versioned fingerprints, migration steps and one consistent table.

A file's fingerprint is, per known field, the names it goes by and the widest type of its values. Files of a stream
(here: an instrument) are compared in order of time; each difference is a change and the step that undoes it:
``added``/``removed`` -> default, ``renamed`` -> rename, ``retyped`` -> cast. Successive files of one fingerprint are a version, and
``migration_rules`` is the table of each version's steps to the common schema, whose types come from the fingerprints of all files.
``conform`` routes every file through the rules of its version.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, REAL, TEXT, LIST = 1, 2, 3, 4
TYPE_NAMES = {INTEGER: "integer", REAL: "real", TEXT: "text", LIST: "list"}
#: conform() holds the dictionary on the driver, as it makes the result's columns; a larger one is refused.
MAX_DICTIONARY = 10_000


class _Object(list):
    """The name-value pairs of a JSON object, in order, with any repeated names."""


def _refuse(_: str) -> None:
    raise ValueError("no JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=_Object, parse_constant=_refuse)


def parse_record(payload: str | None) -> list[tuple[str, object]]:
    """Name-value pairs of a payload; none unless it is one complete JSON object."""
    if not payload:
        return []
    try:
        found = _DECODER.decode(payload)
    except (ValueError, RecursionError):
        return []
    return found if isinstance(found, _Object) else []


def type_rank(value: object) -> int | None:
    """Rank of a value's type; None for null. Truth values and nested objects count as text."""
    if value is None:
        return None
    if isinstance(value, (bool, str, _Object)):
        return TEXT
    if isinstance(value, int):
        return INTEGER
    return REAL if isinstance(value, float) else LIST


def _names_seen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        seen: dict[tuple[int, str | None], int] = {}
        for file_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.setdefault((file_id, None), 0)
            for name, value in parse_record(payload):
                key = (file_id, name.strip().lower())
                seen[key] = max(seen.get(key, 0), type_rank(value) or 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int32())], ["file_id", "name", "type"]
        )


def fingerprints(records: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files in their order and the fields of each.

    Files: ``(instrument, file_id, written_at, seq, next_file)``, seq from 1 by written_at, then file_id. Fields:
    ``(file_id, field_name, names, type)``; type is null where the file has only nulls. Rows without a file_id
    are dropped; repeats of a record change nothing; a file whose payloads are all null or broken has no fields.
    """
    records = records.where("file_id is not null")
    files = records.groupBy("file_id").agg(F.min("instrument").alias("instrument"), F.min("written_at").alias("written_at"))
    w = Window.partitionBy("instrument").orderBy("written_at", "file_id")
    files = files.select("instrument", "file_id", "written_at", F.row_number().over(w).alias("seq"), F.lead("file_id").over(w).alias("next_file"))
    seen = records.select("file_id", "payload").mapInArrow(_names_seen, "file_id long, name string, type int").where("name is not null").groupBy("file_id", "name").agg(F.max("type").alias("type"))
    known = dictionary.select(F.lower(F.trim("col_name")).alias("name"), "col_name", "field_name").where("col_name is not null and field_name is not null").dropDuplicates(["name"])
    fields = seen.join(known, "name").groupBy("file_id", "field_name").agg(F.sort_array(F.collect_set("col_name")).alias("names"), F.max("type").alias("type"))
    return files, fields.withColumn("type", F.when(F.col("type") > 0, F.col("type")))


def _compared(files: DataFrame, fields: DataFrame) -> DataFrame:
    w = Window.partitionBy("instrument", "field_name").orderBy("seq")
    return files.join(fields, "file_id").select(
        "*",
        F.lag("seq").over(w).alias("before"),
        F.lead("seq").over(w).alias("after"),
        F.lag("names").over(w).alias("old_names"),
        F.last("type", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("old_type"),
    )


def schema_changes(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every change against the file before of the same instrument: ``(file_id, field_name, change, step)``.

    ``step`` is the migration step in words. Changes: added, removed (file_id is the later file), renamed (in both,
    under other names), retyped (in both, other than the last type known). A first file has no changes.
    """
    files, fields = fingerprints(records, dictionary)
    steady = F.col("before") == F.col("seq") - 1
    names = F.create_map(*(x for k, v in TYPE_NAMES.items() for x in (F.lit(k), F.lit(v))))
    change = lambda when, file, kind, step: F.when(when, F.struct(F.col(file).alias("file_id"), F.lit(kind).alias("change"), step.alias("step")))
    cases = F.array(
        change((F.col("seq") > 1) & ~F.coalesce(steady, F.lit(False)), "file_id", "added", F.lit("default before")),
        change(F.col("next_file").isNotNull() & ~F.coalesce(F.col("after") == F.col("seq") + 1, F.lit(False)), "next_file", "removed", F.lit("default from here")),
        change(steady & (F.col("names") != F.col("old_names")), "file_id", "renamed", F.concat(F.lit("rename "), F.array_join("names", ","), F.lit(" from "), F.array_join("old_names", ","))),
        change(steady & (F.col("type") != F.col("old_type")), "file_id", "retyped", F.concat(F.lit("cast "), names[F.col("old_type")], F.lit(" to "), names[F.col("type")])),
    )
    return _compared(files, fields).select("field_name", F.explode(F.filter(cases, lambda x: x.isNotNull())).alias("x")).select("x.file_id", "field_name", "x.change", "x.step")


def versioned_files(files: DataFrame, fields: DataFrame) -> DataFrame:
    """``files`` with ``fingerprint`` (an md5 of fields, names and types; empty for a file without fields), ``n_fields`` and ``version`` from 1."""
    entry = F.concat_ws(":", "field_name", F.array_join("names", ","), F.coalesce(F.col("type").cast("string"), F.lit("?")))
    of_file = fields.groupBy("file_id").agg(F.md5(F.array_join(F.sort_array(F.collect_list(entry)), ";")).alias("fingerprint"), F.count("*").alias("n_fields"))
    w = Window.partitionBy("instrument").orderBy("seq")
    rows = files.join(of_file, "file_id", "left").fillna({"fingerprint": "", "n_fields": 0})
    return rows.withColumn("fresh", F.when(F.col("fingerprint") == F.lag("fingerprint").over(w), 0).otherwise(1)).withColumn("version", F.sum("fresh").over(w)).drop("fresh")


def schema_versions(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row per version of an instrument's schema: ``(instrument, version, fingerprint, first_file, n_files, n_fields)``.

    A version lasts as long as successive files have the same fingerprint, an md5 of fields, names and types.
    """
    rows = versioned_files(*fingerprints(records, dictionary))
    return rows.groupBy("instrument", "version", "fingerprint", "n_fields").agg(F.min_by("file_id", "seq").alias("first_file"), F.count("*").alias("n_files"))


def _known_fields(dictionary: DataFrame) -> dict[str, str]:
    """Field of each name in lower case without outer blanks."""
    known = dictionary.where("col_name is not null and field_name is not null").select("col_name", "field_name").limit(MAX_DICTIONARY + 1).collect()
    if len(known) > MAX_DICTIONARY:
        raise ValueError(f"the dictionary has more than {MAX_DICTIONARY} names")
    return {r.col_name.strip().lower(): r.field_name for r in known}


def _rules(files: DataFrame, fields: DataFrame, names: dict[str, str], types: dict[str, int]) -> DataFrame:
    every = F.array(*(F.lit(f) for f in sorted(set(names.values())))) if names else F.array().cast("array<string>")
    first = files.groupBy("instrument", "version").agg(F.min_by("file_id", "seq").alias("file_id"))
    to_type = F.create_map(*(x for f, t in types.items() for x in (F.lit(f), F.lit(t)))) if types else None
    rows = first.select("instrument", "version", "file_id", F.explode(every).alias("field_name")).join(fields, ["file_id", "field_name"], "left")
    target = F.coalesce(to_type[F.col("field_name")], F.lit(TEXT)) if to_type is not None else F.lit(TEXT)
    rows = rows.withColumn("to_type", target)
    steps = F.array_compact(
        F.array(
            F.when(F.col("names").isNull(), F.lit("default")),
            F.when(F.col("names").isNotNull() & (F.array_join("names", ",") != F.col("field_name")), F.lit("rename")),
            F.when(F.col("type") != F.col("to_type"), F.lit("cast")),
        )
    )
    return rows.select("instrument", "version", "field_name", F.array_join(steps, ",").alias("steps"), "names", F.col("type").alias("from_type"), "to_type")


def migration_rules(records: DataFrame, dictionary: DataFrame, types: dict[str, int] | None = None) -> DataFrame:
    """The steps of each version to the common schema: ``(instrument, version, field_name, steps, names, from_type, to_type)``.

    One row per version and field of the dictionary. ``steps`` are some of default (the version lacks the field), rename (it has it
    under ``names``) and cast (its values' widest type isn't that of the common schema), in the order they are applied.
    """
    files, fields = fingerprints(records, dictionary)
    return _rules(versioned_files(files, fields), fields, _known_fields(dictionary), types or field_types(records, dictionary))


_NUMBER = re.compile(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?$")


def cast_value(value: object, rank: int) -> tuple[object, bool]:
    """The value in the given type and whether the cast held. Text is trimmed; a list of one stands for a scalar."""
    if value is None:
        return None, True
    if rank == LIST:
        items = value if isinstance(value, list) and not isinstance(value, _Object) else [value]
        cast = [cast_value(x, REAL) for x in items]
        return [x for x, _ in cast], all(ok for _, ok in cast)
    if isinstance(value, list) and not isinstance(value, _Object):
        if len(value) == 1:
            return cast_value(value[0], rank)
        return (json.dumps(value), True) if rank == TEXT else (None, False)
    if rank == TEXT:
        return value if isinstance(value, str) else json.dumps(value), True
    if isinstance(value, str):
        text = value.strip()
        if not _NUMBER.match(text):
            return None, not text
        try:
            value = int(text)
        except ValueError:
            value = float(text)
    if isinstance(value, (bool, _Object)) or (isinstance(value, float) and not math.isfinite(value)):
        return None, False
    if rank == REAL:
        try:
            return float(value), True
        except OverflowError:
            return None, False
    whole = value == int(value) and abs(value) < 1 << 63
    return (int(value), True) if whole else (None, False)


def readable_rank(value: object) -> int:
    """The narrowest of integer, real and list that holds the value as ``cast_value`` reads it; 0 if none does, as for null, text that is no number and lists with such text."""
    if value is None or isinstance(value, str) and not value.strip():
        return 0
    if isinstance(value, list) and not isinstance(value, _Object):
        if len(value) == 1:
            return readable_rank(value[0])
        return LIST if all(x is None or readable_rank(x) in (INTEGER, REAL) for x in value) else 0
    return next((rank for rank in (INTEGER, REAL) if cast_value(value, rank)[1]), 0)


def field_types(records: DataFrame, dictionary: DataFrame) -> dict[str, int]:
    """The common schema's type of each field of the dictionary, from the values of all files.

    A field is text if more of its values can't be read as numbers than can (or none can). Else it is the narrowest of integer, real
    and list that holds every readable value: a fraction or more than 64 bits make it real (exact up to 2^53), a list of other than
    one element a list. Values are counted where they lie.
    """

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seen: dict[str, list[int]] = {}
            for payload in batch.column(0).to_pylist():
                for name, value in parse_record(payload):
                    if value is None:
                        continue
                    rank, had = readable_rank(value), seen.setdefault(name.strip().lower(), [0, 0, 0])
                    had[0] = max(had[0], rank)
                    had[1 if rank else 2] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([x[i] for x in seen.values()], pa.int64()) for i in range(3))], ["name", "type", "read", "unread"])

    known = dictionary.select(F.lower(F.trim("col_name")).alias("name"), "field_name").where("name is not null and field_name is not null").distinct()
    seen = records.select("payload").mapInArrow(kernel, "name string, type long, read long, unread long").groupBy("name").agg(F.max("type").alias("type"), F.sum("read").alias("read"), F.sum("unread").alias("unread"))
    found = seen.join(known, "name").groupBy("field_name").agg(F.max("type").alias("type"), F.sum("read").alias("read"), F.sum("unread").alias("unread"))
    types = dict.fromkeys(_known_fields(dictionary).values(), TEXT)
    return types | {r.field_name: TEXT if r.unread > r.read or not r.type else int(r.type) for r in found.limit(MAX_DICTIONARY).collect()}


def conform(records: DataFrame, dictionary: DataFrame, types: dict[str, int] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """All records in one table: record keys, one column per field_name, ``schema_version`` and ``n_uncast``.

    Each file goes through the rules of its version (``migration_rules``): rename (from the names this version uses), default (a
    field the version or the record lacks; null unless ``defaults`` has it) and cast (to the field's type in ``types``, by default
    ``field_types``). A value that can't be cast becomes null and is counted in ``n_uncast``. Repeats of a record_id count once, and
    so do equal rows without one. A record without a file_id has no version and is read by all names. A null, broken or empty payload gives a
    record of defaults. If a record names a field twice, the first value that isn't null counts. Extra columns are dropped.
    """
    names = _known_fields(dictionary)
    fields = sorted(set(names.values()))
    types = types or field_types(records, dictionary)
    defaults = defaults or {}
    arrow = {INTEGER: pa.int64(), REAL: pa.float64(), TEXT: pa.string(), LIST: pa.list_(pa.float64())}
    spark_types = {INTEGER: T.LongType(), REAL: T.DoubleType(), TEXT: T.StringType(), LIST: T.ArrayType(T.DoubleType())}
    keys = [c for c in ("record_id", "file_id", "instrument", "record_no", "written_at") if c in records.columns]
    alike = F.when(F.col("record_id").isNull(), F.to_json(F.struct(*keys, "payload")))
    rows = records.select(*keys, "payload", alike.alias("_alike")).dropDuplicates(["record_id", "_alike"]).drop("_alike")
    if {"file_id", "instrument", "written_at"} <= set(records.columns):
        files, found = fingerprints(records, dictionary)
        files = versioned_files(files, found)
        rules = _rules(files, found, names, types).where("names is not null").groupBy("instrument", "version")
        rules = rules.agg(F.to_json(F.sort_array(F.collect_list(F.struct("field_name", "names")))).alias("_rules"))
        rules = rules.select(F.col("instrument").alias("_i"), F.col("version").alias("_v"), "_rules")
        routed = files.select(F.col("file_id").alias("_file"), F.col("instrument").alias("_of"), F.col("version").alias("schema_version"))
        routed = routed.join(rules, F.col("_of").eqNullSafe(F.col("_i")) & (F.col("schema_version") == F.col("_v")), "left").select("_file", F.col("schema_version").cast("int").alias("schema_version"), "_rules")
        rows = rows.join(routed, F.col("file_id") == F.col("_file"), "left").select(*keys, "payload", "schema_version", "_rules")
    else:
        rows = rows.select("*", F.lit(None).cast("int").alias("schema_version"), F.lit(None).cast("string").alias("_rules"))

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_version: dict[tuple, dict[str, str]] = {}
        for batch in it:
            out: dict[str, list] = {f: [] for f in fields}
            failed = []
            n = len(keys)
            for payload, version, text in zip(*(batch.column(n + i).to_pylist() for i in range(3))):
                if version is None:
                    known = names
                else:
                    known = of_version.get(text)
                    if known is None:
                        known = of_version[text] = {name.strip().lower(): x["field_name"] for x in json.loads(text or "[]") for name in x["names"]}
                record: dict[str, object] = {}
                for name, value in parse_record(payload):
                    field = known.get(name.strip().lower())
                    if field is not None and record.get(field) is None:
                        record[field] = value
                bad = 0
                for f in fields:
                    value, held = cast_value(record.get(f, defaults.get(f)), types.get(f, TEXT))
                    bad += not held
                    out[f].append(value)
                failed.append(bad)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array(out[f], arrow[types.get(f, TEXT)]) for f in fields] + [batch.column(n + 1), pa.array(failed, pa.int32())],
                [*keys, *fields, "schema_version", "n_uncast"],
            )

    tail = [T.StructField("schema_version", T.IntegerType()), T.StructField("n_uncast", T.IntegerType())]
    schema = T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(f, spark_types[types.get(f, TEXT)]) for f in fields), *tail])
    return rows.mapInArrow(kernel, schema)
