"""Blocks whose fields no schema names: one VARIANT a block, its fields found in the data.

``sources.blocks_json.read_any_blocks`` reads them. Flattened field names are the keys on the way to a value, joined by ``_``; lists are
values. Names are discovered one level of nesting at a time: the keys of all objects of a level are exploded and counted by path and
kind, combined in the tasks, so what reaches the driver is a row a distinct field, however many blocks there are.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "block"
IDS = ("document", "doc_id", "line_no")
LABEL = "label"

_NUMBER = ("DECIMAL", "DOUBLE", "FLOAT")


def _kind(v: Column) -> Column:
    """First word of a value's type, with that of its entries for a list of plain values."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(ARRAY<[A-Z]+|[A-Z]+)", 1)


def field_kinds(blocks: DataFrame, block: str = BLOCK) -> DataFrame:
    """(path, kind, n): how often each field has a value of each kind; an empty object has no fields."""
    spark = blocks.sparkSession
    level = blocks.select(F.col(block).alias("_v"), F.array().cast("array<string>").alias("_path"))
    found = None
    while True:
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).select("key", "value"))
        inner = inner.filter("key is not null").select(F.col("value").alias("_v"), F.concat("_path", F.array("key")).alias("_path"), _kind(F.col("value")).alias("kind"))
        own = inner.filter("kind <> 'OBJECT'").groupBy(F.col("_path").alias("path"), "kind").agg(F.count("*").alias("n"))
        found = own if found is None else found.unionByName(own)
        level = inner.filter("kind = 'OBJECT'").select("_v", "_path")
        if level.isEmpty():
            return found


def _sql_type(kinds: set[str]) -> str:
    """The type that holds values of all these kinds; VARIANT if no plain one does."""
    kinds = kinds - {"VOID"}
    if kinds == {"BIGINT"}:
        return "bigint"
    if kinds and kinds <= {"BIGINT", *_NUMBER}:
        return "double"
    if kinds == {"BOOLEAN"}:
        return "boolean"
    if kinds == {"STRING"}:
        return "string"
    if kinds and kinds <= {f"ARRAY<{k}" for k in ("BIGINT", "VOID", *_NUMBER)}:
        return "array<double>"
    if kinds == {"ARRAY<STRING"}:
        return "array<string>"
    return "variant"


class Fields:
    """The flattened fields of a set of blocks: name -> (paths, type). Bounded by the distinct fields."""

    def __init__(self, kinds: list[tuple[tuple[str, ...], str]], sep: str = "_", reserved: tuple[str, ...] = IDS):
        paths: dict[str, set[tuple[str, ...]]] = defaultdict(set)
        held: dict[str, set[str]] = defaultdict(set)
        for path, kind in kinds:
            paths[sep.join(path)].add(path)
            held[sep.join(path)].add(kind)
        self.columns: dict[str, tuple[list[tuple[str, ...]], str]] = {}
        taken = {c.lower() for c in reserved}
        # Sorted, so that names which differ in case only, or hide an id, get their suffix alike each time.
        for name in sorted(paths):
            free = name
            while free.lower() in taken:
                free += f"{sep}nested"
            taken.add(free.lower())
            self.columns[free] = (sorted(paths[name], key=lambda p: (len(p), p)), _sql_type(held[name]))

    @classmethod
    def of(cls, *frames: DataFrame, block: str = BLOCK, sep: str = "_") -> Fields:
        """Fields of all frames together."""
        rows = [r for df in frames for r in field_kinds(df, block).collect()]
        return cls([(tuple(r["path"]), r["kind"]) for r in rows], sep)

    def header(self) -> list[str]:
        """Sorted names of all fields, plus ``label``: a dataset header."""
        return sorted({*self.columns, LABEL})


def _value(block: str, path: tuple[str, ...], kind: str) -> Column:
    steps = []
    for key in path:
        quote = '"' if '"' not in key else "'"
        if quote in key:
            steps = None
            break
        steps.append(f"[{quote}{key}{quote}]")
    if steps is not None:
        return F.try_variant_get(F.col(block), "$" + "".join(steps), kind)
    at = F.col(block)
    for key in path:  # a key with both quotation marks: no path names it
        at = F.try_variant_get(at, "$", "map<string,variant>")[key]
    return F.try_variant_get(at, "$", kind)


def flatten_any(blocks: DataFrame, fields: Fields, block: str = BLOCK) -> DataFrame:
    """The ids and a column a field, null where a block has none; of several paths to one name the shortest with a value counts.

    A field that holds an object in some blocks and something else in others is a column of the latter beside those of the
    object's fields; values of several kinds stay VARIANT.
    """
    ids = [c for c in IDS if c in blocks.columns]
    columns = []
    for name, (paths, kind) in fields.columns.items():
        values = [_value(block, path, kind) for path in paths]
        if kind in ("variant", "string"):  # objects have columns of their own, a null is no value
            plain = [~F.schema_of_variant(_value(block, path, "variant")).rlike("^(OBJECT|VOID)") for path in paths]
            values = [F.when(is_plain, v) for is_plain, v in zip(plain, values)]
        columns.append(F.coalesce(*values).alias(name))
    return blocks.select(*ids, *columns)


def union_any(*frames: DataFrame, block: str = BLOCK) -> DataFrame:
    """Blocks of several sources flattened under one header; a field that a source lacks is null."""
    fields = Fields.of(*frames, block=block)
    flat = [flatten_any(df, fields, block) for df in frames]
    out = flat[0]
    for df in flat[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def dataset(flat: DataFrame, label: Column | None = None) -> DataFrame:
    """Flattened blocks as a table of text for a CSV file: sorted columns plus ``label``, lists and mixed values as JSON."""

    def text(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        return F.to_json(c) if kind.startswith(("array", "variant")) else c.cast("string")

    columns = {name: text(name, kind).alias(name) for name, kind in flat.dtypes if name not in IDS}
    if label is not None or LABEL not in columns:
        columns[LABEL] = (F.lit(None) if label is None else label).cast("string").alias(LABEL)
    return flat.select(*[c for c in IDS if c in flat.columns], *[columns[name] for name in sorted(columns)])
