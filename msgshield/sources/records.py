"""Text records that span lines, read by all tasks: CSV with line breaks in fields, and JSON arrays in one file.

Spark cuts a file at any separator it is given, here the line feed or the closing brace, and a task reads the pieces of
its byte ranges. Whether a piece begins inside a quoted string depends on all quotes before it in the file: tasks count
quotes within their range, for both cases of its beginning, and the ranges' totals, one row each, settle the case and
the number of records before. Only records of several pieces are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCAN = "key long, q long, gap boolean"
COUNTED = "before long, ended_out long, ended_in long, place long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every piece, within its range: quotes before it, records ended before it if the range begins outside or
    inside a string, and its place. The last three input columns are the range, the quotes and whether it is a gap."""
    key, carry = None, np.zeros(4, dtype=np.int64)
    for batch in batches:
        n = batch.num_rows
        width = batch.num_columns - 3
        keys = batch.column(width).to_numpy()
        quotes = batch.column(width + 1).to_numpy()
        gaps = batch.column(width + 2).to_numpy(zero_copy_only=False)
        out = np.zeros((4, n), dtype=np.int64)
        limits = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if n else np.zeros(0, np.int64)
        for a, b in zip(limits.tolist(), [*limits[1:].tolist(), n], strict=True):
            if keys[a] != key:
                key, carry = keys[a], np.zeros(4, dtype=np.int64)
            after = carry[0] + np.cumsum(quotes[a:b])
            even = after % 2 == 0
            # Outside at the end: a record ends, unless the piece is nothing but a gap between records.
            steps = np.stack([quotes[a:b], even & ~gaps[a:b], ~even & ~gaps[a:b], np.ones(b - a, dtype=np.int64)]).astype(np.int64)
            sums = carry[:, None] + np.cumsum(steps, axis=1)
            out[:, a:b] = sums - steps
            carry = sums[:, -1]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], [*batch.schema.names, *COUNTED_NAMES])


COUNTED_NAMES = ["before", "ended_out", "ended_in", "place"]


def _pieces(spark: SparkSession, path: str | list[str], separator: str, quotes, gap) -> tuple[DataFrame, list[str]]:
    raw = spark.read.option("lineSep", separator).text(path)
    folders = [c for c in raw.columns if c != "value"]
    value = F.make_valid_utf8("value")
    rows = raw.select(*folders, value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    value = F.col("value")
    rows = rows.withColumns({"key": F.xxhash64("file", "block"), "q": quotes(value).cast("long"), "gap": gap(value)})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_count, f"{fields}, {COUNTED}"), folders


def records(
    spark: SparkSession, path: str | list[str], separator: str, quotes, gap, headers: int = 0
) -> tuple[DataFrame, list[str]]:
    """(rows, partition columns): ``value``, the record without its last separator, ``number`` in its file and ``ordinal`` in all.

    ``quotes`` gives the number of quotes of a piece, ``gap`` whether a piece outside strings is no record. Both take a
    column. Ordinals follow file path and position; the first ``headers`` records of a file have none.
    """
    pieces, folders = _pieces(spark, path, separator, quotes, gap)
    # One row for each byte range that the driver plans the scan with.
    ranges = pieces.groupBy("file", "block").agg(
        F.sum("q").alias("q"),
        (F.max("ended_out") + F.max_by(((F.col("before") + F.col("q")) % 2 == 0).cast("long") * (~F.col("gap")).cast("long"), "place")).alias("out"),
        (F.max("ended_in") + F.max_by(((F.col("before") + F.col("q")) % 2 == 1).cast("long") * (~F.col("gap")).cast("long"), "place")).alias("in"),
    )
    earlier = (Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(*earlier)
    ranges = ranges.withColumn("start", F.coalesce(F.sum("q").over(in_file), F.lit(0)) % 2)
    ranges = ranges.withColumn("ended", F.when(F.col("start") == 0, F.col("out")).otherwise(F.col("in")))
    ranges = ranges.withColumn("ended_before", F.coalesce(F.sum("ended").over(in_file), F.lit(0)))
    files = ranges.groupBy("file").agg(F.greatest(F.sum("ended") - headers, F.lit(0)).alias("n"))
    by_file = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(*earlier)
    files = files.select("file", F.coalesce(F.sum("n").over(by_file), F.lit(0)).alias("first"))
    ranges = ranges.join(files, "file").select("file", "block", "start", "ended_before", "first")

    rows = pieces.join(F.broadcast(ranges), ["file", "block"])
    begins = (F.col("start") + F.col("before")) % 2
    ends = (F.col("start") + F.col("before") + F.col("q")) % 2
    ended = F.when(F.col("start") == 0, F.col("ended_out")).otherwise(F.col("ended_in"))
    rows = rows.select(*folders, "value", "file", "block", "place", "first", "gap", begins.alias("begins"), ends.alias("ends"), (F.col("ended_before") + ended).alias("number"))
    rows = rows.filter(~(F.col("gap") & (F.col("begins") == 0) & (F.col("ends") == 0)))
    whole = (F.col("begins") == 0) & (F.col("ends") == 0)
    # The condition stands in the value as well: expressions on it may be evaluated before the rows are filtered.
    single = rows.filter(whole).select(*folders, F.when(whole & ~F.col("gap"), F.col("value")).alias("value"), "file", "number", "first")
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    joined = F.array_join(F.transform(parts, lambda p: p["value"]), separator)
    cut = rows.filter(~whole).groupBy(*folders, "file", "number", "first").agg(joined.alias("value"))
    out = single.unionByName(cut.select(*folders, "value", "file", "number", "first"))
    ordinal = F.when(F.col("number") >= headers, F.col("first") + F.col("number") - headers)
    return out.withColumn("ordinal", ordinal).drop("first"), folders


def json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The flat objects of one JSON array per file, with ``ordinal``; missing fields are null.

    Pieces end at a closing brace; escaped quotes do not count. An object inside an object is an error.
    """
    bare = lambda v: F.regexp_replace(v, r"\\.", "")
    quotes = lambda v: F.regexp_count(bare(v), F.lit('"'))
    gap = lambda v: F.rlike(v, F.lit(r"^[\s,\[\]]*$"))
    rows, folders = records(spark, path, "}", quotes, gap)
    text = F.concat(F.regexp_replace("value", "^[\\s,\\[﻿]+", ""), F.lit("}"))
    flat = F.when(F.startswith(text, F.lit("{")), F.from_json(text, schema))
    said = F.concat(F.lit("not an array of flat objects: "), F.substring(text, 1, 80))
    flat = flat.when(F.col("value").isNotNull(), F.raise_error(said))
    return rows.select(*folders, flat.alias("row"), "ordinal").select("row.*", *folders, "ordinal")


def csv_table(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """The rows of CSV files with a header and doubled quotes, all columns as text, with ``__ordinal``.

    ``columns`` are those of the header; a file with another header is an error. Blank lines between records are
    skipped, as Spark's reader does.
    """
    quotes = lambda v: F.regexp_count(v, F.lit('"'))
    gap = lambda v: F.rlike(v, F.lit(r"^\s*$"))
    rows, folders = records(spark, path, "\n", quotes, gap, headers=1)
    schema = ", ".join(f"`c{i}` string" for i in range(len(columns)))
    options = {"escape": '"', "nullValue": "\u0000", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    line = F.regexp_replace("value", "\r$", "")
    head = F.when(F.col("number") == 0, F.regexp_replace(line, "^﻿", "")).otherwise(line)
    parsed = rows.select(*folders, F.from_csv(head, schema, options).alias("row"), "value", "number", "ordinal")
    cells = [F.col(f"row.c{i}") for i in range(len(columns))]
    # A null line is no record yet; see ``records``.
    same = F.col("value").isNull() | (F.array(*[F.coalesce(c, F.lit("")) for c in cells]) == F.array(*map(F.lit, columns)))
    wrong = F.raise_error(F.lit("a file has another header than the first"))
    kept = F.when(F.col("number") > 0, F.lit(True)).when(same, F.lit(False)).otherwise(wrong.cast("boolean"))
    return parsed.filter(kept).select(*[c.alias(name) for c, name in zip(cells, columns, strict=True)], *folders, F.col("ordinal").alias("__ordinal"))
