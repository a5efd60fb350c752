"""Label and outline documents whose blocks arrive in pieces, over any number of micro-batches and restarts.

Blocks are kept in the state of their document (RocksDB, checkpointed) until it is whole: some block of a document says how many it has
(``n_blocks``), and a document is whole when as many different line numbers have come. A document to which nothing was added for
``patience`` seconds when other pieces come is given out as it is: time is that of the micro-batch which reads a piece, so no piece is
too old to be read, and a run that only reads what is there (``availableNow``) ends. Then the ordinary job runs on the documents that
ended in the micro-batch. What comes after a document was given out is kept apart as ``late``.

A line number that comes again is ignored. Documents are dealt into ``BUCKETS`` by a hash, and the state is called for a bucket:
what a micro-batch brings of its documents is gone through together, and a document's new blocks are one value of the state. Of a
document's lines only the numbers seen are held in memory, as intervals, and at most ``HELD`` blocks of a bucket that are not
stored yet. Lines without a document, and what is no array, go to ``broken``; a line without a number has its place in its array.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import labels as lb
from ..operators import outline as ol
from ..operators.ordering import group_profile
from ..sources import blocks_json as bj

LINE = "line_no bigint, page int, text string, font_size double, font_name string, weight int, x0 double, y0 double, x1 double, y1 double, x_center double, y_center double"
_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType()}
LINE_TYPE = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in LINE.split(", "))])
# Documents that wait for lines: the numbers seen, how many there are to be, when patience ends, and values of blocks stored.
WAITING = "seen string, total bigint, due bigint, parts int"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = 10_000
# Groups of documents whose state is called together, and blocks of a group that are held at once.
BUCKETS = 1024
HELD = 50_000


class Numbers:
    """A set of whole numbers as sorted, disjoint intervals."""

    def __init__(self, text: str = ""):
        self.spans = [tuple(map(int, part.split(":"))) for part in text.split(",") if part]

    def __str__(self) -> str:
        return ",".join(f"{a}:{b}" for a, b in self.spans)

    def __len__(self) -> int:
        return sum(b - a + 1 for a, b in self.spans)

    def add(self, numbers: list[int]) -> list[int]:
        """Take in ``numbers``; those that are new, sorted."""
        given = sorted(set(numbers))
        new, spans, k = [], self.spans, 0
        for n in given:
            while k < len(spans) and spans[k][1] < n:
                k += 1
            if k == len(spans) or n < spans[k][0]:
                new.append(n)
        merged: list[tuple[int, int]] = []
        for a, b in sorted([*spans, *((n, n) for n in new)]):
            if merged and a <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        self.spans = merged
        return new


class Gather(StatefulProcessor):
    """Rows of a bucket's documents in, all rows of a document out when it ends; ``status`` tells how it did."""

    def __init__(self, patience: float, numeric: bool):
        self.patience = int(patience * 1000)
        self.numeric = numeric

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "doc string", WAITING)
        self.done = handle.getMapState("done", "doc string", "status string")
        self.blocks = handle.getMapState("blocks", "doc string, part int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = _Out(self.numeric)
        known: dict[str, list | None] = {}  # [seen, total, due, parts], None once done
        fresh: dict[str, list[tuple]] = {}
        held = 0
        for frame in rows:
            for doc, lines, total, came in _by_document(frame):
                if doc not in known:
                    known[doc] = self._state(doc)
                state = known[doc]
                if state is None:
                    yield from out.add(doc, lines, "late")
                    continue
                state[1] = total if state[1] is None else state[1]
                state[2] = max(state[2], came + self.patience)
                first = {line[0]: line for line in reversed(lines)}
                new = [first[n] for n in state[0].add(list(first))]
                fresh.setdefault(doc, []).extend(new)
                held += len(new)
            if held >= HELD:
                for doc, lines in fresh.items():
                    self._store(doc, known[doc], lines)
                fresh, held = {}, 0
        dues = set()
        for doc, state in known.items():
            if state is None:
                continue
            if state[1] is not None and len(state[0]) >= state[1]:
                yield from self._end(out, doc, state[3], "whole", fresh.get(doc, []))
            else:
                self._store(doc, state, fresh.get(doc, []))
                self.waiting.updateValue((doc,), (str(state[0]), *state[1:]))
                dues.add(state[2])
        for due in dues:
            self.handle.registerTimer(due)
        yield from out.rest()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = _Out(self.numeric)
        now = expiredTimerInfo.getExpiryTimeInMs()
        ended = [(doc[0], held[3]) for doc, held in self.waiting.iterator() if held[2] <= now]
        for doc, parts in ended:
            yield from self._end(out, doc, parts, "timeout", [])
        yield from out.rest()

    def _state(self, doc: str) -> list | None:
        held = self.waiting.getValue((doc,)) if self.waiting.exists() else None
        if held:
            return [Numbers(held[0]), held[1], held[2], held[3]]
        return None if self.done.exists() and self.done.getValue((doc,)) else [Numbers(), None, 0, 0]

    def _store(self, doc: str, state: list, lines: list[tuple]) -> None:
        for lo in range(0, len(lines), ROWS):
            self.blocks.updateValue((doc, state[3]), (pickle.dumps(lines[lo : lo + ROWS]),))
            state[3] += 1

    def _end(self, out: _Out, doc: str, parts: int, status: str, lines: list[tuple]) -> Iterator[pd.DataFrame]:
        for part in range(parts):
            yield from out.add(doc, pickle.loads(self.blocks.getValue((doc, part))[0]), status)
            self.blocks.removeKey((doc, part))
        yield from out.add(doc, lines, status)
        if self.waiting.exists():
            self.waiting.removeKey((doc,))
        self.done.updateValue((doc,), (status,))

    def close(self) -> None:
        pass


def _by_document(frame: pd.DataFrame) -> Iterator[tuple[str, list[tuple], int | None, int]]:
    """(document, its lines, its number of blocks if one tells it, time) of a frame, lines in the order they came."""
    columns = [[_plain(v) for v in frame[name].tolist()] for name in LINE_TYPE.names]
    counts = [_plain(v) for v in frame["n_blocks"].tolist()]
    lines: dict[str, list[tuple]] = {}
    totals: dict[str, int] = {}
    for doc, total, line in zip(frame["doc_id"].astype(str).tolist(), counts, zip(*columns)):
        lines.setdefault(doc, []).append((int(line[0]), *line[1:]))
        if total is not None:
            totals.setdefault(doc, int(total))
    came = int(frame["came"].max())
    for doc, own in lines.items():
        yield doc, own, totals.get(doc), came


class _Out:
    """Rows given out, in frames of bounded size whatever their documents."""

    def __init__(self, numeric: bool):
        self.numeric = numeric
        self.rows: list[tuple] = []

    def add(self, doc: str, lines: list[tuple], status: str) -> Iterator[pd.DataFrame]:
        self.rows.extend((int(doc) if self.numeric else doc, *line, status) for line in lines)
        if len(self.rows) >= ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.rows:
            frame = pd.DataFrame(self.rows, columns=["doc_id", *LINE_TYPE.names, "status"])
            for name in ("line_no", "page", "weight"):
                frame[name] = frame[name].astype("Int64")
            self.rows = []
            yield frame


def _plain(v):
    """A value of a frame as the state holds it."""
    return None if v is None or v is pd.NA or v != v else v


def whole_documents(blocks: DataFrame, patience: float) -> DataFrame:
    """A stream of blocks (``doc_id``, the columns of ``LINE``, ``n_blocks``) -> the blocks of documents that ended, with ``status``."""
    blocks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = blocks.schema["doc_id"].dataType.simpleString()
    rows = blocks.select("doc_id", *LINE_TYPE.names, "n_blocks", F.current_timestamp().alias("_read")).withWatermark("_read", "0 seconds")
    rows = rows.withColumn("came", F.unix_millis("_read"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Gather(patience, kind != "string"),
        outputStructType=f"doc_id {kind}, {LINE}, status string",
        outputMode="Append",
        timeMode="EventTime",
    )


def gather_documents(
    spark: SparkSession, inbox: str, out: str, checkpoint: str, patience: float = 3600.0, files_per_batch: int = 10_000
) -> StreamingQuery:
    """Read arrays of blocks, one a line, as files arrive in ``inbox``; append ``labels``, ``outlines``, ``late`` and ``broken`` to ``out``.

    A batch that is run again writes its own folders again, so a restart neither loses nor repeats rows.
    """
    raw = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(inbox)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )
    good, broken = bj.split_arrays(raw, whole_files=False, more="n_blocks:bigint")
    blocks = bj.with_box_columns(good)
    usable = F.col("doc_id").isNotNull() & F.col("line_no").isNotNull()
    gathered = whole_documents(blocks.filter(usable), patience)

    def run(batch: DataFrame, batch_id: int) -> None:
        held = f"{out}/ended/batch={batch_id}"
        batch.write.mode("overwrite").parquet(held)  # the state is read once
        ended = spark.read.parquet(held)
        ended.filter("status = 'late'").write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
        labels = f"{out}/labels/batch={batch_id}"
        lb.with_rule_labels(ended.filter("status <> 'late'")).write.mode("overwrite").parquet(labels)
        stored = spark.read.parquet(labels)
        _, largest = group_profile(stored, ["doc_id"])
        ol.titled_outline(stored, largest=largest).write.mode("overwrite").parquet(f"{out}/outlines/batch={batch_id}")

    def put_aside(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/broken/batch={batch_id}")

    odd = blocks.filter(~usable).select("document", F.to_json(F.struct("doc_id", "line_no", "text")).alias("value"))
    rest = broken.unionByName(odd).writeStream.foreachBatch(put_aside)
    rest.option("checkpointLocation", f"{checkpoint}/broken").trigger(availableNow=True).start().awaitTermination()
    return (
        gathered.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{checkpoint}/documents")
        .trigger(availableNow=True)
        .start()
    )
