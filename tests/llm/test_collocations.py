"""Summaries keep what is frequent; phrases, scores and ranks equal a plain count."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheafline.llm import collocations as c


def plain(rows, threshold, longest=5, first=2000):
    """{(lang, rank): (phrase, a, l, r, n, score)} by counting everything."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    often = {k: v for k, v in f.items() if v >= threshold}
    by = collections.defaultdict(list)
    inside = collections.defaultdict(int)
    for (lang, p), a in often.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                inside[lang, p[i : i + size]] = max(inside[lang, p[i : i + size]], a)
    for (lang, p), a in often.items():
        if len(p) > 1 and inside[lang, p] < a:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            by[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = {}
    for lang, found in by.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:first], 1):
            out[lang, rank] = (phrase.decode(), -a, l, r, n[lang], -score)
    return out


def mined(df, **kw):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in c.collocations(df, **kw).collect()}


@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=6), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_merged_summaries_keep_what_is_frequent(streams, capacity):
    """A key with more than mass / (capacity + 1) occurrences keeps a counter; no counter is too large or too small by more than ``taken``."""
    merged = c.Summary(capacity)
    for stream in streams:
        own = c.Summary(capacity)
        for lo in range(0, len(stream), 7):
            part = np.array(stream[lo : lo + 7], np.uint64)
            own.add(*c.summed(part, np.ones(len(part), np.int64)))
        keys, counts = own.trim()
        merged.add(keys, counts, own.taken)
    keys, counts = merged.trim()
    true = collections.Counter(x for s in streams for x in s)
    mass = sum(true.values())
    assert len(keys) <= capacity and merged.taken <= mass / (capacity + 1)
    kept = dict(zip(keys.tolist(), counts.tolist()))
    for key, n in true.items():
        assert n - merged.taken <= kept.get(key, 0) <= n


@pytest.mark.parametrize("limit", [40, 200, 1 << 20])
def test_stretches_show_every_phrase_once(limit):
    rng = np.random.default_rng(limit)
    texts = ["", "one", "x" * 500, " ".join(["ab"] * 300), "a b c. d e f\ng " * 40, "long " + "y" * 300 + " end of it, really", "\t.. "]
    texts += ["".join(rng.choice(list("ab .,\t"), 300)) for _ in range(5)]
    found = collections.Counter()
    langs = np.zeros(len(texts), np.uint64)
    for data, offsets, rows, ends in c.stretches(pa.array(texts, pa.large_string()), 4, limit):
        words = c.Words(data, offsets, ends, langs[rows])
        begins = None
        for size in range(1, 6):
            begins = words.begins(size, begins)
            for i in np.flatnonzero(begins & words.own).tolist():
                found[words.phrase(i, size).decode()] += 1
    want = collections.Counter()
    for text in texts:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            want.update(" ".join(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    assert found == want


def test_odd_rows(spark, odd):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    want = plain(rows, 2)
    assert want and mined(odd, threshold=2) == want
    assert mined(odd.repartition(5), threshold=2, limit=300) == want
    assert mined(odd, threshold=2, first=3) == {k: v for k, v in want.items() if k[1] <= 3}


def test_small_table(spark, docs):
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert mined(docs, threshold=12) == plain(rows, 12)


def test_too_small_a_summary_is_made_again(spark, docs, monkeypatch):
    """One hot partition and hardly any capacity: the guarantee is checked, so nothing is lost."""
    rows = [(r["text"], r["lang"]) for r in docs.limit(60).collect()]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    sizes = []
    run = c._pass

    def small(docs, sizes_, n_parts, capacity, *rest):
        sizes.append(capacity)
        return run(docs, sizes_, n_parts, max(1, capacity // 400), *rest)

    monkeypatch.setattr(c, "_pass", small)
    assert mined(df, threshold=5) == plain(rows, 5)
    assert len(sizes) > 3  # at least one pass was made again


def test_large_products(spark):
    """The products pass 64 bits and stay exact."""
    big = 3_000_000_007
    rows = [("en", 0, None, 10**12 + 39), ("en", 1, "a", big), ("en", 1, "b", big + 2), ("en", 2, "a b", big - 4)]
    got = c.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f bigint"), 100).collect()
    assert [r["score"] for r in got] == [1000 * (big - 4) * (10**12 + 39) // (big * (big + 2))]


def test_empty_table(spark, none):
    assert mined(none) == {}
