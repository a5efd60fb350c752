"""Label and outline documents as their files arrive.

No operator before ranking looks across documents, so a batch of new files needs no state from earlier
ones: the file source's checkpoint remembers what was read, and each batch runs the ordinary job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import labels as lb
from ..operators import outline as ol
from ..operators.ordering import group_profile
from ..sources import blocks_json as bj


def incremental_classify(
    spark: SparkSession,
    inbox: str,
    out: str,
    checkpoint: str,
    whole_files: bool = True,
    files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Read the files of ``inbox`` not seen before, and append ``labels``, ``outlines`` and ``broken`` to ``out``.

    A document is its file's name unless its blocks carry an id. All lines of a document must arrive together. What is not
    an array goes to ``broken`` with its name. A batch that is run again writes its own folders again, so a restart
    neither loses nor repeats rows.
    """
    arrivals = (
        spark.readStream.format("text")
        .option("wholetext", whole_files)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(inbox)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        good, broken = bj.split_arrays(batch, whole_files)
        broken.write.mode("overwrite").parquet(f"{out}/broken/batch={batch_id}")
        blocks = bj.with_box_columns(good).select(
            "doc_id", "line_no", "page", "text", "font_size", "font_name", "weight",
            "x0", "y0", "x1", "y1", "x_center", "y_center",
        )
        labels = f"{out}/labels/batch={batch_id}"
        lb.with_rule_labels(blocks).write.mode("overwrite").parquet(labels)
        stored = spark.read.parquet(labels)
        _, largest = group_profile(stored, ["doc_id"])
        ol.titled_outline(stored, largest=largest).write.mode("overwrite").parquet(f"{out}/outlines/batch={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
