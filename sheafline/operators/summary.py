"""Extractive summaries: the sentences that share most with the text they stand in."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Length of a summary in words.
MIN_WORDS = 50
MAX_WORDS = 120


def _best(sentences, n_words, min_words: int, max_words: int) -> list[int]:
    """Places, in text order, of the sentences taken; ``sentences`` are lists of tokens."""
    used = Counter(t for tokens in sentences for t in tokens)
    scores = {k: sum(used[t] for t in set(tokens)) / len(set(tokens)) for k, tokens in enumerate(sentences) if len(tokens)}
    taken, total = [], 0
    for k in sorted(scores, key=lambda k: (-scores[k], k)):
        if total + n_words[k] <= max_words or total < min_words:
            taken.append(k)
        total += n_words[k]
    return sorted(taken)


def extractive_summary(
    contents: DataFrame,
    keys: Sequence[str],
    content: str = "content",
    min_words: int = MIN_WORDS,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """(keys, summary) of a row a content: best sentences up to ``max_words`` (at least ``min_words``), in text order.

    A sentence scores the mean, over its different tokens, of how often the whole text uses them. Contents are only mapped:
    nothing is shuffled or sorted, and a task holds the tokens of one batch of contents.
    """

    @F.pandas_udf("array<int>")
    def chosen(tokens: pd.Series, n_words: pd.Series) -> pd.Series:
        split = ([line.split(" ") if line else [] for line in text.split("\n")] for text in tokens)
        return pd.Series([_best(t, n, min_words, max_words) for t, n in zip(split, n_words)], dtype=object)

    own = [F.col(k) for k in keys]
    parts = contents.select(*own, tx.sentences(F.col(content)).alias("_s")).filter(F.col(content).isNotNull())
    # Tokens have neither blanks nor line ends in them: one string a text is handed over, a line a sentence.
    tokens = F.array_join(F.transform("_s", lambda s: F.array_join(tx.tokens(s), " ")), "\n")
    taken = parts.withColumn("_at", chosen(tokens, F.transform("_s", tx.word_count)))
    joined = F.array_join(F.transform("_at", lambda k: F.get("_s", k)), " ")
    return taken.filter(F.size("_at") > 0).select(
        *keys, F.array_join(F.slice(tx.words(joined), 1, max_words), " ").alias("summary")
    )
