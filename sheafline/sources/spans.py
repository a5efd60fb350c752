"""Text lines from spans or the bytes of files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as tx
from ..session import scratch_path
from .documents import parsed_batches

SPAN_SCHEMA = (
    "document string, page int, block int, block_type int, line int, span_no int, text string, "
    "size double, font string, x0 double, y0 double, x1 double, y1 double"
)

# What of the first span of a line goes on to the line.
FIRST = ("size", "font", "x0", "y0", "x1", "y1")


def _runs(spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each run of neighbouring spans with equal ``keys``: numbers, texts, and ``FIRST`` of the lowest number.

    A line may be in several runs. Only adding up is done here: spans in any order give the same lines, those in reading order
    (as files are read) give few runs, so that neither a sort nor the shuffle holds rows of single spans.
    """
    held = spans.select(*keys, "span_no", "text", F.struct(*FIRST).alias("first"))
    schema = T.StructType(
        [
            *(held.schema[k] for k in keys),
            T.StructField("numbers", T.ArrayType(held.schema["span_no"].dataType)),
            T.StructField("texts", T.ArrayType(T.StringType())),
            T.StructField("lowest", held.schema["span_no"].dataType),
            held.schema["first"],
        ]
    )
    types = [f.type for f in to_arrow_schema(schema)][len(keys) : len(keys) + 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for column in batch.columns[: len(keys)]:
                # A null beside a null begins a run, too: the runs meet in the groups.
                differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), True)
                new[1:] |= differs.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            number, text, first = batch.columns[len(keys) :]
            # The place of the lowest number of each run; nulls come last and stay null.
            order = pc.sort_indices(
                pa.table({"run": np.cumsum(new), "number": number}), sort_keys=[("run", "ascending"), ("number", "ascending")]
            ).take(pa.array(starts))
            edges = pa.array(np.append(starts, n).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, c).cast(t) for c, t in zip((number, text), types)]
            heads = [c.take(pa.array(starts)) for c in batch.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*heads, *lists, number.take(order), first.take(order)], names=schema.names)

    return held.mapInArrow(run, schema)


def lines_from_spans(spans: DataFrame, keys: tuple[str, ...] = ("doc_id", "page", "block", "line")) -> DataFrame:
    """Text lines of the text blocks (type 0): trimmed spans joined by blanks, empty lines dropped.

    Font, size and box are those of the first span of the line. Runs of spans are put together before they are shuffled, and
    dealt before they are grouped, so that no task sorts more than its share of the lines.
    """
    trimmed = spans.filter(F.col("block_type") == 0).withColumn("text", tx.strip(F.col("text")))
    parts = F.flatten(F.collect_list(F.arrays_zip("numbers", "texts")))
    return (
        _runs(trimmed, keys)
        .repartition(*keys)
        .groupBy(*keys)
        .agg(
            tx.strip(F.array_join(F.transform(F.array_sort(parts), lambda s: s["texts"]), " ")).alias("text"),
            F.min_by("first", "lowest").alias("_f"),
        )
        .filter(F.col("text") != "")
        .select(
            *keys,
            "text",
            F.bround("_f.size", 2).alias("font_size"),
            F.col("_f.font").alias("font_name"),
            "_f.x0", "_f.y0", "_f.x1", "_f.y1",
        )
    )


def parse_files(
    spark: SparkSession,
    path: str,
    parser: Callable[[str, bytes], Iterable[dict]],
    glob: str = "*.pdf",
    schema: str = SPAN_SCHEMA,
) -> DataFrame:
    """Rows a user's ``parser(file name, bytes)`` makes of each file, e.g. the spans of a PDF.

    A file the parser fails on gives no rows, a row with a value of another type than the schema's is left out; neither stops
    the others. ``failed_files`` names both; ``parse_once`` gives both from one pass.
    """
    return _parsed(spark, path, parser, glob, schema).filter("_error is null").drop("_file", "_error")


def failed_files(
    spark: SparkSession,
    path: str,
    parser: Callable[[str, bytes], Iterable[dict]],
    glob: str = "*.pdf",
    schema: str = SPAN_SCHEMA,
) -> DataFrame:
    """(file, error) of the files that the parser fails on, and of rows with values of another type."""
    failed = _parsed(spark, path, parser, glob, schema).filter("_error is not null")
    return failed.select(F.col("_file").alias("file"), F.col("_error").alias("error"))


def parse_once(
    spark: SparkSession,
    path: str,
    parser: Callable[[str, bytes], Iterable[dict]],
    glob: str = "*.pdf",
    schema: str = SPAN_SCHEMA,
) -> tuple[DataFrame, DataFrame]:
    """(rows, failed) from one pass over the files, whose result is stored in the shared folder."""
    held = scratch_path(spark, "parsed")
    _parsed(spark, path, parser, glob, schema).write.parquet(held)
    stored = spark.read.parquet(held)
    failed = stored.filter("_error is not null").select(F.col("_file").alias("file"), F.col("_error").alias("error"))
    return stored.filter("_error is null").drop("_file", "_error"), failed


def _parsed(spark: SparkSession, path: str, parser, glob: str, schema: str) -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "content")
    )
    schema = f"{schema}, _file string, _error string"
    shape = to_arrow_schema(T.StructType.fromDDL(schema))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                yield from parsed_batches(file.as_py().rsplit("/", 1)[-1], content.as_py, parser, shape)

    return files.mapInArrow(parse, schema)
