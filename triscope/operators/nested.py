"""Deeply nested records into flat tables: one pass, a depth-first visitor, rows tagged with their table.

Every object that stands in a list becomes one row: the tag of its table, its own key, the key of the object that holds it, its
place, and all its other fields as payload. The record itself is a row too, of the table named like its source. The rows of all
tables leave one scan together; they are written partitioned by tag, and a schema is applied to a table when it is read. Sources
of JSON text and of typed columns (as JSON of their struct) go through the same visitor.

Keys are the record's key, a digest of its content and the object's number in the order of the visit: two records under one key,
or without one, don't mix, and a repeated record gives the same keys again.

Cases: null or empty text, text that is not complete JSON, and text without a registry object give no row. A byte order mark
before the text, wrappers around the registry object, and JSON inside a JSON string are seen through. A null list element
gives no row but keeps its place. An object in place of a list of ``list_fields`` counts as a list of one. A list inside a
list adds the outer place to ``parent_pos``; its objects hang on the object that holds the outer list. Objects that aren't in a list
stay within the payload. What a list holds besides objects stays in the payload at its place, with null for each object; a list of
objects alone isn't repeated there, an empty list is. Payloads nested deeper than the JSON writer goes are null. Rows with a null key
are emitted under a null key. Repeated records give repeated rows (``distinct`` where that is not wanted). Empty inputs give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST_FIELDS = ("revisions", "sheets", "stamps", "members", "page_kinds")
ROOT_FIELD = "schema_version"
TAGGED = "src string, tag string, record_key string, list_path string, parent_path string, parent_pos string, pos bigint, row_key string, parent_key string, payload string"
_NAMES = [x.split()[0] for x in TAGGED.split(", ")]
_TYPES = [pa.int64() if n == "pos" else pa.string() for n in _NAMES]
_FOLDER = re.compile(r"[\w.-]{1,80}", re.ASCII)

#: list_path, parent's path, parent_pos, pos, number, parent's number, fields
Row = tuple[str, str | None, str, int | None, int, int | None, dict]


def registry_object(text: str, root_field: str | None = ROOT_FIELD) -> dict | None:
    """The outermost object with ``root_field``, whatever stands around it; without a field the object that the text is."""
    try:
        todo = [json.loads(text.lstrip("\ufeff"))]
    except (ValueError, RecursionError):
        return None
    if root_field is None:
        return todo[0] if isinstance(todo[0], dict) else None
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if root_field in x:
                return x
            todo.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, str) and root_field in x:
            try:
                todo.append(json.loads(x.lstrip("\ufeff")))
            except (ValueError, RecursionError):
                pass
    return None


def _parts(xs: list, places: str) -> tuple[list[tuple[dict, str, int]], list | None]:
    """The objects of a list and of the lists in it, each with the places around it and its own; and what else it holds, if anything."""
    objects: list[tuple[dict, str, int]] = []
    rest: list = []
    others = False
    todo = [(xs, rest, places)]
    while todo:
        ys, into, around = todo.pop()
        for i, y in enumerate(ys):
            if isinstance(y, dict):
                objects.append((y, around, i))
                into.append(None)
            elif isinstance(y, list):
                into.append([])
                todo.append((y, into[-1], f"{around}.{i}" if around else str(i)))
            else:
                into.append(y)
                others = others or y is not None
    return objects, rest if others or not objects else None


def visit(root: dict, list_fields: frozenset[str]) -> list[Row]:
    """The record and each object in a list, depth first, without recursion."""
    rows: list[Row] = []
    # object, its fields if it isn't in a list; path, places and table around it; place, number of the holder
    stack: list[tuple] = [(root, None, "", "", None, None, None)]
    while stack:
        x, into, path, places, table, pos, no = stack.pop()
        if into is None:
            rows.append((path, table, places, pos, len(rows), no, into := {}))
            no, table = len(rows) - 1, path
            places = "" if pos is None else f"{places}.{pos}" if places else str(pos)
        below: list[tuple] = []
        for name, y in x.items():
            at = f"{path}.{name}" if path else name
            one = isinstance(y, dict)
            if one and name not in list_fields:
                into[name] = {}
                below.append((y, into[name], at, places, table, None, no))
            elif one or isinstance(y, list):
                objects, rest = _parts([y] if one else y, places)
                if rest is not None:
                    into[name] = rest
                below += [(z, None, at, around, table, i, no) for z, around, i in objects]
            else:
                into[name] = y
        stack += reversed(below)
    return rows


def tag_of(src: str, path: str) -> str:
    """Name of a table, fit for a folder: the source and the path of its list, or a digest of a path that is long or odd."""
    name = f"{src}.{path}" if path else src
    return name if _FOLDER.fullmatch(name) else f"{src}.{hashlib.md5(path.encode('utf-8', 'surrogatepass')).hexdigest()}"


def _payload(fields: dict) -> str | None:
    try:
        text = json.dumps(fields, ensure_ascii=False)
        return text if text.isascii() or text.encode() else None
    except RecursionError:
        return None
    except UnicodeEncodeError:  # half a pair of surrogates, which only an escape can carry
        return json.dumps(fields)


def source(df: DataFrame, name: str, key: Column, record: Column) -> DataFrame:
    """src, key, text of a source: ``record`` is JSON text, or a struct whose fields make the record."""
    text = F.to_json(record, {"ignoreNullFields": "false"}) if isinstance(df.select(record).schema[0].dataType, T.StructType) else record
    return df.where(record.isNotNull()).select(F.lit(name).alias("src"), key.cast("string").alias("key"), text.alias("text"))


def emit_tagged(sources: DataFrame, roots: dict[str, str | None], list_fields: tuple[str, ...] = LIST_FIELDS) -> DataFrame:
    """``TAGGED``: the rows of all tables of the records in ``sources`` (src, key, text).

    ``roots`` names for each source the field by which its record is known within the text; None where the text is the record.
    """
    fields = frozenset(list_fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags: dict[tuple[str, str | None], tuple[str, str | None]] = {}  # the tag and the path as it can be written
        plain = lambda path: path and path.encode("utf-8", "replace").decode()
        for batch in batches:
            rows: list[list] = [[] for _ in _NAMES]
            for src, k, t, digest in zip(*(c.to_pylist() for c in batch.columns)):
                root = registry_object(t, roots.get(src, ROOT_FIELD))
                record = f"{'' if k is None else k}~{digest & (1 << 64) - 1:016x}~"
                for path, up, places, i, no, holder, own in visit(root, fields) if root is not None else ():
                    if (known := tags.get((src, path))) is None:
                        if len(tags) > 10_000:
                            tags.clear()
                        known = tags[src, path] = tag_of(src, path), plain(path)
                    new = (src, known[0], k, known[1], plain(up), places, i, f"{record}{no}", None if holder is None else f"{record}{holder}", _payload(own))
                    for column, v in zip(rows, new):
                        column.append(v)
                if len(rows[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _TYPES)], _NAMES)
                    rows = [[] for _ in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _TYPES)], _NAMES)

    digest = F.xxhash64("text")  # tells records of one key apart
    return sources.where("text is not null").select("src", "key", "text", digest.alias("digest")).mapInArrow(run, TAGGED)


def write_tables(tagged: DataFrame, path: str) -> None:
    """One folder per tag. Tags are few (paths of the schema, not of the data), and a task writes one of its files at a time."""
    tagged.write.mode("overwrite").option("compression", "zstd").partitionBy("tag").parquet(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the tables written, without a schema for their payloads."""
    return spark.read.schema(TAGGED).parquet(path)


def read_table(spark: SparkSession, path: str, src: str, list_path: str, schema: str) -> DataFrame:
    """One flat table of those written: keys, parents' keys and the typed fields of ``schema``; ``list_path`` is empty for the records.

    A struct in the schema stands for an object within the object; its fields become columns ``object_field``. A field of the
    payload that doesn't fit its type gives null. Repeated rows count once.
    """
    rows = read_rows(spark, path).where((F.col("tag") == tag_of(src, list_path)) & (F.col("list_path") == list_path))
    once = rows.select("record_key", "parent_pos", "pos", "row_key", "parent_key", "payload").distinct()

    def flat(c: Column, kind: T.StructType, name: str) -> Iterator[Column]:
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                yield from flat(c[f.name], f.dataType, f"{name}{f.name}_")
            else:
                yield c[f.name].alias(name + f.name)

    out = once.withColumn("f", F.from_json("payload", schema, {"mode": "PERMISSIVE"}))
    return out.select("record_key", "parent_pos", "pos", "row_key", "parent_key", *flat(F.col("f"), T._parse_datatype_string(schema), ""))


def links(rows: DataFrame) -> DataFrame:
    """Per table: src, list_path, rows, records, and rows whose holder is a row too (all but the records); repeated rows count once."""
    once = rows.select("src", "list_path", "record_key", "row_key", "parent_key").distinct()
    there = once.select("src", F.col("row_key").alias("parent_key"), F.lit(True).alias("held"))
    return once.join(there, ["src", "parent_key"], "left").groupBy("src", "list_path").agg(F.count("*").alias("n_rows"), F.countDistinct("record_key").alias("n_records"), F.count("held").alias("n_linked"))
