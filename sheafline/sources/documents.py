"""Documents as files, one each: a committing writer, and a partitioned reader through a parser, as Spark data sources.

Writing. Rows of a document come one after another; a task streams them into a file under the job's temporary folder, and only when
every task has ended are the files moved to their names. A job that fails, or a lost executor's attempt, leaves no file and changes none;
what is moved is whole. A document that two tasks wrote is an error. No document is gathered in a row or in memory.

Reading. Files are dealt into partitions by size; a task parses each of its files once. What a parser cannot read, and rows whose values
have another type than the schema says, are rows with ``_error`` set; the other files and rows go on.

Names. ``report.pdf`` is written as ``report_outline.json`` and so on. What a file name cannot hold (``/``, a leading ``.`` or
``_``, ``%``) is written as in a URL and read back. Paths go through pyarrow's file systems: local or mounted folders, HDFS, S3, GCS.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "document_files"
TEMPORARY = "_temporary"
PART_BYTES = 32 << 20
PART_FILES = 1000
FILE = "document string, head string, entry string, tail string"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it; a plain path is local."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def file_name(document: str, suffix: str) -> str:
    """``report.pdf`` to ``report`` and the suffix; other names get it behind."""
    stem = document.removesuffix(".pdf")
    stem = stem.replace("%", "%25").replace("/", "%2F").replace("\0", "%00")
    return (f"%{ord(stem[0]):02X}{stem[1:]}" if stem[:1] in (".", "_") else stem) + suffix


def document_of(name: str, suffix: str) -> str:
    return unquote(name.removesuffix(suffix))


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (temporary path, name)


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", ".json"), overwrite
        self.held = f"{_place(self.path)[1]}/{TEMPORARY}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, _ = _place(self.path)
        folder = f"{self.held}/{uuid.uuid4().hex}"
        fs.create_dir(folder)
        files: list[tuple[str, str]] = []
        names: set[str] = set()
        out = now = tail = None

        def close() -> None:
            if out is not None:
                out.write((tail or "").encode())
                out.close()

        for batch in iterator:
            for document, head, entry, end in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("document", "head", "entry", "tail"))):
                if document is None:
                    raise ValueError("a document without a name")
                if document != now or out is None:
                    close()
                    name = file_name(document, self.suffix)
                    if name in names:
                        raise ValueError(f"the rows of {document!r} do not follow each other")
                    names.add(name)
                    files.append((f"{folder}/{len(files)}", name))
                    out, now, tail, first = fs.open_output_stream(files[-1][0]), document, end, True
                    out.write((head or "").encode())
                if entry is not None:
                    out.write((entry if first else f",\n{entry}").encode())
                    first = False
        close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = _place(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = {name for _, name in files}
        if len(names) < len(files):
            self._clear()
            raise ValueError("a document was written by several tasks: deal the rows by document")
        for held, name in files:
            fs.move(held, f"{path}/{name}")
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(path)):
                if info.type == pafs.FileType.File and info.base_name.endswith(self.suffix) and info.base_name not in names:
                    fs.delete_file(info.path)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, _ = _place(self.path)
        if fs.get_file_info(self.held).type != pafs.FileType.NotFound:
            fs.delete_dir(self.held)
        above = os.path.dirname(self.held)
        if fs.get_file_info(above).type != pafs.FileType.NotFound and not fs.get_file_info(pafs.FileSelector(above)):
            fs.delete_dir(above)


@dataclass
class _Files(InputPartition):
    paths: list[str]


def error_rows(shape: pa.Schema, name: str, errors: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"_file": name, "_error": e} for e in errors], schema=shape)


def typed_batches(name: str, rows: Iterable[dict], shape: pa.Schema, step: int = 5000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of ``shape``, with ``_file``; a row with a value of another type is an error row, the others stay."""
    rows = list(rows)

    def batch(part: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**row, "_file": name} for row in part], schema=shape)

    for lo in range(0, len(rows), step):
        part = rows[lo : lo + step]
        try:
            yield batch(part)
            continue
        except Exception:  # noqa: BLE001 - some row of the part; found below
            pass
        good, errors = [], []
        for k, row in enumerate(part, lo):
            try:
                batch([row])
                good.append(row)
            except Exception as error:  # noqa: BLE001 - one bad row must not end the job
                errors.append(f"row {k}: {type(error).__name__}: {error}")
        yield batch(good)
        yield error_rows(shape, name, errors)


def parsed_batches(name: str, read: Callable[[], bytes], parser, shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What ``parser(name, bytes)`` makes of one file; a file it fails on is one error row and no other."""
    try:
        rows = list(parser(name, read()))
    except Exception as error:  # noqa: BLE001 - one bad file must not end the job
        yield error_rows(shape, name, [f"{type(error).__name__}: {error}"])
        return
    yield from typed_batches(name, rows, shape)


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType, parser):
        self.path, self.suffix, self.parser = options["path"], options.get("suffix", ".json"), parser
        self.shape = to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        fs, path = _place(self.path)
        found = [
            (info.path, info.size or 0)
            for info in fs.get_file_info(pafs.FileSelector(path, recursive=True))
            if info.type == pafs.FileType.File and info.base_name.endswith(self.suffix) and not any(p[:1] in "._" for p in info.path[len(path) :].strip("/").split("/"))
        ]
        parts: list[_Files] = []
        held = PART_BYTES
        for file, size in sorted(found):
            if held + size > PART_BYTES or len(parts[-1].paths) >= PART_FILES:
                parts.append(_Files([]))
                held = 0
            parts[-1].paths.append(file)
            held += size
        return parts or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _place(self.path)
        for path in partition.paths:

            def content(path: str = path) -> bytes:
                with fs.open_input_stream(path) as stream:
                    return stream.read()

            yield from parsed_batches(document_of(path.rsplit("/", 1)[-1], self.suffix), content, self.parser, self.shape)


def _whole(name: str, content: bytes) -> list[dict]:
    return [{"document": name, "value": content.decode()}]


class DocumentFiles(DataSource):
    """``document_files``: options ``path`` and ``suffix``; reads (document, value, _file, _error), writes ``FILE`` rows."""

    parser = staticmethod(_whole)
    rows = "document string, value string"
    named = FORMAT

    @classmethod
    def name(cls) -> str:
        return cls.named

    def schema(self) -> str:
        return f"{self.rows}, _file string, _error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DocumentReader(dict(self.options), schema, self.parser)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return DocumentWriter(dict(self.options), overwrite)


def register_parser(spark: SparkSession, name: str, parser: Callable[[str, bytes], Iterable[dict]], schema: str) -> None:
    """Make ``spark.read.format(name)`` parse files: ``schema`` rows with ``_file`` and ``_error``, each file read once."""
    spark.dataSource.register(type(f"Parsed_{name}", (DocumentFiles,), {"parser": staticmethod(parser), "rows": schema, "named": name}))


def write_documents(rows: DataFrame, path: str, suffix: str, order: tuple[str, ...] = (), replace_all: bool = False) -> None:
    """``FILE`` rows to one file a document: its head, its entries in ``order`` with commas between, its tail.

    Head and tail are those of the first row; a row with a null entry adds none. Other documents in the folder stay, unless
    ``replace_all``.
    """
    rows.sparkSession.dataSource.register(DocumentFiles)
    kept = rows.select("document", "head", "entry", "tail", *order).repartition("document").sortWithinPartitions("document", *order)
    out = kept.select("document", "head", "entry", "tail").write.format(FORMAT).option("path", path).option("suffix", suffix)
    out.mode("overwrite" if replace_all else "append").save()


def read_documents(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(document, value, _file, _error): the files of a folder whose names end in ``suffix``, whole."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format(FORMAT).option("suffix", suffix).load(path)


def outline_rows(titled: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A titled outline as ``FILE`` rows and ``seq``: ``{title, outline: [{level, text, page}, ...]}``."""
    head = F.concat(F.regexp_replace(F.to_json(F.struct("title")), r"\}\z", ""), F.lit(', "outline": [\n'))
    entry = F.when(F.col("seq").isNotNull(), F.to_json(F.struct("level", "text", "page")))
    return titled.select(F.col(doc).cast("string").alias("document"), head.alias("head"), entry.alias("entry"), F.lit("\n]}").alias("tail"), "seq")
