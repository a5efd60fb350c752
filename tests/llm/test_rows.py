"""Stages under clashing column names, repeated ids, very long texts, and draws under one hot id."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_data import PASSAGE, SMALL
from pyspark.sql import functions as F

from sheafline.llm import byte_rnn, pairwise_quality, repeated_windows, simhash_tiles, streaming_viterbi, suffix_automaton


def sentence(seed, n=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


A, B, C, D = (sentence(i) for i in range(4))
NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint, _score int, _key string, _parts string, _one int, _two int, _id int, ids string, n_ids int, key int"


def named(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or ""), 1, "k", "p", 1, 2, 3, "ids", 4, 5) for i, t in rows], NAMES)


def test_rows_of_one_id_with_other_texts_stay(spark):
    rows = [(1, A), (5, A), (5, B), (7, C), (7, D), (7, D), (None, B), (None, sentence(9)), (9, None), (8, ""), (9, "")]
    for parts in (1, 4):
        got = simhash_tiles.keep_first(named(spark, rows).repartition(parts))
        assert got.columns == [x.split()[0] for x in NAMES.split(", ")]
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, A), (5, B), (7, C), (7, D), (None, sentence(9)), (8, "")], key=str)


def test_equal_rows_with_other_columns_are_chosen_alike(spark):
    rows = [(1, A, i) for i in range(8)]
    got = {simhash_tiles.keep_first(spark.createDataFrame(rows[k:] + rows[:k], "doc_id int, text string, other int").repartition(3)).first()["other"] for k in range(3)}
    assert len(got) == 1


def test_names_that_stages_use_themselves(spark):
    rows = [(i, sentence(100 + i, 90)) for i in range(6)] + [(10, f"{A} {PASSAGE}"), (11, f"{B} {PASSAGE}")]
    df = named(spark, rows)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bench = spark.createDataFrame([("x", PASSAGE)], "item_id string, text string")
    for stage in (lambda d: pairwise_quality.keep_good(d, labels), repeated_windows.remove_repeats, lambda d: suffix_automaton.remove_spans(d, bench)):
        out = stage(df)
        assert out.columns == df.columns and out.count() <= len(rows)
    cut = {r["doc_id"]: r["text"] for r in repeated_windows.remove_repeats(df).collect()}
    assert cut[10].strip() == A and cut[3] == sentence(103, 90)


def test_near_copies_in_one_large_group(spark):
    """Many near copies, many texts that share half, one common passage: links are those of all pairs."""
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(w if j != (i * 7) % 120 else f"x{i}" for j, w in enumerate(base))) for i in range(150)]
    rows += [(1000 + i, " ".join(base[:60]) + f" {sentence(5000 + i, 60)}") for i in range(150)]
    rows += [(2000 + i, " ".join(f"own{i}z{k}" for k in range(20)) + " " + " ".join(base[20:40])) for i in range(100)]
    for tiles in ({}, {"tile_rows": 40, "tile_shingles": 2000}):
        kept = {r["doc_id"] for r in simhash_tiles.keep_first(named(spark, rows).repartition(5), **tiles).collect()}
        sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
        root = {i: i for i in sets}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in sets:
            for j in sets:
                if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        assert kept == {find(i) for i in sets}


@pytest.mark.parametrize("width", [1, 5])
def test_sets_and_fingerprints_against_loops(width):
    texts = ["", "a", "A b C d e f", "x " * 2000, sentence(1, 700), " ".join(f"t{i}" for i in range(600))]
    hashes, sizes = simhash_tiles.shingle_sets(pa.array(texts, pa.large_string()), width)
    own = np.split(hashes, np.cumsum(sizes)[:-1])
    for text, found in zip(texts, own):
        w = text.lower().split()
        assert len(found) == len({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else ())
        assert (np.diff(found.astype(object)) > 0).all()
    some = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[some]
    assert simhash_tiles._bit_majorities(hashes, first, sizes[some]).tolist() == [simhash_tiles.fingerprint(own[k], 1)[0] for k in some]


def test_streamed_lanes_are_the_streaming_search():
    """Long stretches without a blank, side by side: the same ids as the search byte by byte, and as decoded."""
    pieces = streaming_viterbi.Pieces(*streaming_viterbi.load(streaming_viterbi.default_vocabulary()))
    r = random.Random(4)
    texts = ["".join(r.choice("abcdeéstinr中") for _ in range(n)) for n in (1, 30, 70, 200, 400, 900, *[260] * 40)]
    texts += ["ab" * 700, "x" * 1500, " ".join(texts), "   " + "y  z" * 50, "", "▁ ▁"]
    ids, counts, data, lengths = pieces.encode_slice(pa.array(texts, pa.large_string()))
    assert pieces.spelled_right(ids, counts, data, lengths).all()
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == (list(pieces.search(b" " + text.encode())) if text else [])


def test_a_long_text_is_cut_in_front_of_blanks():
    pieces = streaming_viterbi.Pieces(*streaming_viterbi.load(streaming_viterbi.default_vocabulary()))
    for text in (" ".join(sentence(i) for i in range(8)), "  a  " * 90 + "q" * 700 + "  b", "z" * 900, " " * 500):
        raw = np.frombuffer(text.encode(), np.uint8)
        for limit in (50, 333, 10_000):
            ids, same = pieces.encode_long(raw, limit)
            assert same and ids.tolist() == list(pieces.search(b" " + text.encode()))


def test_draws_under_one_hot_id(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)] + [(1, 1, 0)] * 50, "doc_id bigint, quality int, toxic int")
    rows = [(1, f"text number {i}") for i in range(3000)] + [(1, "the same")] * 500 + [(2, "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    picked = pairwise_quality.labelled_sample(docs, labels, "quality", F.lit(True), 10)
    held = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    assert held[1] <= 60 and held[0] == 1
    hot = spark.createDataFrame([(None, f"words {i}", "en") for i in range(2000)] + [(i, "mots", "fr") for i in range(20)], "doc_id bigint, text string, lang string")
    labels, _ = byte_rnn.fit(hot, F.lit(True), per_language=10, windows=1)
    assert set(labels) <= {"en", "fr"}


def test_benchmark_items_over_many_automata(spark, docs):
    """One pass an automaton: the same hits, item ids and cut texts as with one, for repeated ids and clashing names too."""
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    texts = [r["text"] for r in bench.orderBy("item_id").limit(6).collect()]
    rows = [(1, f"{A} {texts[0]} {B}"), (1, f"{texts[1]} {C}"), (None, texts[2]), (5, f"{texts[3]} {texts[4]} {A} {B}"), (6, D), (7, None), (8, "")]
    df = named(spark, rows).withColumns({"_row": F.lit(1), "_spans": F.lit("x")})
    for table in (df, docs):
        one, many = (sorted(map(str, suffix_automaton.contamination(table, bench, shard_words=n).collect())) for n in (10**6, 150))
        assert one == many and any("contaminated=True" in r for r in one)
        one, many = (sorted(map(str, suffix_automaton.remove_spans(table, bench, shard_words=n).collect())) for n in (10**6, 150))
        assert one == many
