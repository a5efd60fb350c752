"""From extracted lines to labels, outlines and answers, in one go.

Lines -> merged titles -> rule label on the merged blocks -> a model's label where it is sure -> styles and levels repaired ->
outlines -> answers. The labelled blocks are stored once (a reliable checkpoint) and everything behind reads them from there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import labels as lb
from .answers import job_answer
from .merge import merge_titles
from .outline import modified_documents, repair_levels, titled_outline


@dataclass
class Workflow:
    """``labelled``: merged blocks with ``rule_label``, ``confidence`` and the final ``label``; ``modified``: documents the repair changed."""

    labelled: DataFrame
    modified: DataFrame
    outlines: DataFrame
    answer: DataFrame | None


def classified(lines: DataFrame, predict: Callable[[DataFrame], DataFrame] | None = None, largest: int | None = None) -> DataFrame:
    """Merged blocks with ``rule_label``, ``confidence`` and the gated ``label``.

    ``predict`` adds ``predicted`` and ``confidence`` to the merged blocks, for example by a stored ensemble. Where it gives none, or
    none that is sure enough, and without it, the rule's label stands; the confidence is 0 where there is none.
    """
    merged = merge_titles(lines, largest=largest)
    ruled = lb.with_rule_labels(merged, out="rule_label", largest=largest)
    if predict is None:
        return ruled.withColumns({"confidence": F.lit(0.0), "label": F.col("rule_label")})
    voted = predict(ruled)
    label = lb.confidence_gate(F.col("confidence"), F.col("predicted"), F.col("rule_label"))
    return voted.withColumns({"label": label, "confidence": F.coalesce("confidence", F.lit(0.0))}).drop("predicted")


def repaired(blocks: DataFrame, largest: int | None = None) -> DataFrame:
    """Blocks with labels by style in documents of few sizes, and headings at most one level below the one before; adds ``old_label``."""
    styled = lb.with_repair_relabel(blocks.withColumn("old_label", F.col("label")), largest=largest)
    return repair_levels(styled, largest=largest).withColumn("label", F.col("new_label")).drop("new_label")


def process_documents(
    lines: DataFrame,
    manifest: DataFrame | None = None,
    jobs: DataFrame | None = None,
    predict: Callable[[DataFrame], DataFrame] | None = None,
    repair: bool = True,
    largest: int | None = None,
    docs_per_job: int | None = None,
    encode: Callable[[Column], Column] | None = None,
    summarize: Callable[[Column], Column] | None = None,
) -> Workflow:
    """Labels and outlines of all documents and, with requests, the answers; see the module."""
    blocks = classified(lines, predict, largest)
    blocks = repaired(blocks, largest) if repair else blocks.withColumn("old_label", F.col("label"))
    blocks = cut_lineage(blocks)
    modified = modified_documents(blocks.select("doc_id", F.col("old_label").alias("label"), F.col("label").alias("new_label")))
    answer = None
    if manifest is not None and jobs is not None:
        answer = job_answer(blocks, manifest, jobs, largest, docs_per_job, encode, summarize)
    return Workflow(blocks, modified, titled_outline(blocks, largest=largest), answer)
