"""Operators with exact results, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_data import SMALL, PASSAGE, ROWS, frame

from sheafline.llm import adaptive_rules, fm_index, repeated_windows, simhash_tiles, streaming_viterbi, suffix_automaton

WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


def test_fm_index_cover_against_counts():
    for seed in range(150):
        r = np.random.default_rng(seed)
        width, letters = int(r.integers(2, 9)), int(r.integers(1, 6))
        base = r.integers(1, letters + 1, 40)
        parts = []
        for _ in range(int(r.integers(1, 6))):
            a = int(r.integers(0, 30))
            part = base[a : a + int(r.integers(1, 40))].copy() if r.random() < 0.6 else r.integers(1, letters + 1, int(r.integers(1, 40)))
            parts.append(part)
        text, start = [0], []
        for part in parts:
            start.append(len(text))
            text += [*part, 0]
        text, start = np.array(text), np.array(start)
        windows = np.array([max(0, len(p) - width + 1) for p in parts])
        counts = Counter(tuple(p[i : i + width]) for p in parts for i in range(len(p) - width + 1))
        want = [{x for i in range(len(p) - width + 1) if counts[tuple(p[i : i + width])] > 1 for x in range(i, i + width)} for p in parts]
        index = fm_index.FMIndex(text, width)
        got = [set() for _ in parts]
        for k, at in zip(*fm_index.repeated_cover(index, text, start, windows, width, np.full(len(parts), 2))):
            got[k] |= set(range(at, at + width))
        assert got == want, seed


def brute_removed(rows, width=35):
    counts = Counter()
    for _, text in rows:
        w = words(text)
        counts.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for key, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_words", [1_000_000, 500])
def test_substring_digest_against_brute_force(odd, shard_words):
    got = [tuple(r) for r in repeated_windows.digest(odd, shard_words=shard_words).collect()]
    assert sorted(got, key=str) == brute_removed([(r[0], r[1]) for r in ROWS])


def test_substring_removal_keeps_columns_and_clean_texts(spark, odd, none):
    out = repeated_windows.remove_repeats(odd)
    assert out.columns == odd.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] == "Alpha beta end one." and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[3]["text"] is None and rows[9]["text"] == ROWS[-1][1]
    assert repeated_windows.digest(none).count() == 0


def test_suffix_automaton_against_search():
    for seed in range(400):
        r = random.Random(seed)
        window, letters = r.choice([2, 3, 4]), [b"a", b"b", b"c"][: r.choice([1, 2, 3])]
        items = [(k, [r.choice(letters) for _ in range(r.randint(0, 7))]) for k in range(r.randint(0, 5))]
        text = [r.choice([*letters, b"z"]) for _ in range(r.randint(0, 14))]
        hit, found = set(), set()
        for k, (_, item) in enumerate(items):
            parts = [item[a : a + window] for a in range(len(item) - window + 1)] or ([item] if item else [])
            for part in parts:
                for a in range(len(text) - len(part) + 1):
                    if text[a : a + len(part)] == part:
                        hit |= set(range(a, a + len(part)))
                        found.add(k)
        spans, got = suffix_automaton.Automaton(items, window).scan(text)
        assert ({x for a, b in spans for x in range(a, b)}, got) == (hit, found)


def test_decontamination_edges(spark, odd, none):
    items = spark.createDataFrame(
        [(1, " ".join(PASSAGE.split()[:20])), (2, "TIE tie tie"), (3, None), (4, ""), (None, "a row"), (11, PASSAGE)], "item_id bigint, text string"
    )
    got = {(r["doc_id"], r["n_words"]): r for r in suffix_automaton.contamination(odd, items).collect()}
    assert got[1, 64]["n_hit"] == 60 and got[1, 64]["n_items"] == 2
    assert got[1, 64]["items_sha256"] == hashlib.sha256(b"1,11").hexdigest()
    assert got[5, 80]["n_hit"] == 80 and not got[3, 0]["contaminated"]
    shards = suffix_automaton.contamination(odd, items, shard_words=20).collect()
    assert sorted(map(tuple, shards), key=str) == sorted(map(tuple, got.values()), key=str) or len(shards) == len(ROWS)
    out = suffix_automaton.remove_spans(odd, items)
    assert out.columns == odd.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 1 not in rows and 5 not in rows and rows[9] == ROWS[-1][1]
    assert suffix_automaton.contamination(none, items).count() == 0
    assert not any(r["contaminated"] for r in suffix_automaton.contamination(odd, items.limit(0)).collect())


def test_decontamination_cuts_passages(spark):
    doc = frame(spark, [(1, "Keep this, " + "word " * 40 + "-- One two; three four five six seven eight nine TEN, and the rest.", "en", "a")])
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    text = suffix_automaton.remove_spans(doc, items).first()["text"]
    assert text == "Keep this, " + "word " * 40 + "-- and the rest."


def simhash(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile_rows", [32_768, 10])
def test_simhash_against_all_pairs(docs, tile_rows):
    prints = {r["doc_id"]: simhash(r["text"]) for r in docs.collect()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = simhash_tiles.near_duplicates(docs, tile_rows=tile_rows).collect()
    assert {r["doc_id"]: (r["fingerprint"].hex(), r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_simhash_edges(odd, none):
    got = [(r["doc_id"], r["fingerprint"].hex(), r["component_id"]) for r in simhash_tiles.near_duplicates(odd).collect()]
    assert len(got) == len(ROWS)
    by_id = {i: (f, c) for i, f, c in got}
    assert by_id[3] == by_id[4] == by_id[7] == ("0" * 16, 3) and by_id[6][1] == 5
    assert simhash_tiles.near_duplicates(none).count() == 0
    kept = sorted((r["doc_id"] for r in simhash_tiles.keep_first(odd).collect()), key=str)
    assert kept.count(5) == 1 and 6 not in kept and None in kept and 9 in kept
    assert simhash_tiles.keep_first(none).count() == 0


def overlapping(n, shared, key):
    """Two texts of ``n`` five-word shingles each, of which they share ``shared``."""
    one = [f"w{key}x{i}" for i in range(n + 4)]
    return " ".join(one), " ".join(one[: shared + 4] + [f"v{key}x{i}" for i in range(n - shared)])


def test_keep_first_decides_on_the_shingle_sets(spark):
    cases = {0.75: (70, 60), 0.79: (179, 158), 0.80: (90, 80), 0.82: (91, 82), 0.85: (185, 170), 0.90: (95, 90)}
    rows, gone = [], set()
    for k, (index, (n, shared)) in enumerate(cases.items()):
        for i in range(20):
            key = 1000 * k + 2 * i
            rows += zip((key, key + 1), overlapping(n, shared, key))
            if index >= 0.8:
                gone.add(key + 1)
    # 4 of 5 shingles; one much repeated line in texts that share nothing else.
    rows += [(9000, "a b c d e f g h"), (9001, "a b c d e f g h i")]
    gone.add(9001)
    for i in range(2):
        rows.append((9010 + i, "read more of this here now " * 200 + " ".join(f"own{i}x{j}" for j in range(100))))
    # A chain: 0.85 between neighbours, less than 0.8 between the ends.
    chain = [f"c{i}" for i in range(234)]
    rows += [(9020 + i, " ".join(chain[15 * i : 15 * i + 189])) for i in range(4)]
    gone |= {9021, 9022, 9023}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for tiles in ({}, {"tile_rows": 25, "tile_shingles": 300}):
        kept = {r["doc_id"] for r in simhash_tiles.keep_first(docs, **tiles).collect()}
        assert {i for i, _ in rows} - kept == gone


def test_keep_first_against_all_pairs(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(10**6 + i, " ".join(w for j, w in enumerate(words(t)) if (j + i) % 40)) for i, t in rows[::3]]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) else set() for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    made = docs.sparkSession.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in simhash_tiles.keep_first(made).collect()}
    assert kept == {find(i) for i in ids} and len(kept) < len(ids)


def test_viterbi_streams_like_the_whole_table():
    for seed in range(150):
        r = random.Random(seed)
        weights = {}
        for _ in range(r.randint(1, 12)):
            piece = " " * r.randint(0, 2) + "".join(r.choice("abé") for _ in range(r.randint(0, 4)))
            if piece:
                weights[piece.encode()] = -r.randint(0, 5)
        pieces = streaming_viterbi.Pieces(list(weights), [300 + i for i in range(len(weights))], list(weights.values()), 0, 3)
        texts = ["".join(r.choice("ab é▁") for _ in range(r.choice([0, 3, 30, 200]))) for _ in range(4)]
        ids, counts, _, _ = pieces.encode_slice(pa.array(texts, pa.large_string()))
        at = 0
        for text, n in zip(texts, counts):
            stream = b" " + text.encode() if text else b""
            best, back, own = [0], [0], [0]
            for end in range(1, len(stream) + 1):
                top, size, id_ = best[-1] - 3, 1, stream[end - 1]
                for k in range(1, end + 1):
                    found = pieces.known.get(stream[end - k : end])
                    if found and best[end - k] + found[1] >= top:
                        top, size, id_ = best[end - k] + found[1], k, found[0]
                best.append(top), back.append(size), own.append(id_)
            want = pieces._path(len(stream), back, own)
            assert list(pieces.search(stream)) == want == ids[at : at + n].tolist()
            at += n


def test_encoding_round_trip(odd, none):
    path = streaming_viterbi.default_vocabulary()
    encoded = streaming_viterbi.encode(odd, path)
    assert set(odd.columns) - {"text"} <= set(encoded.columns)
    back = streaming_viterbi.decode(encoded, path)
    got = sorted(((r["doc_id"], r["text"], r["same"]) for r in back.collect()), key=str)
    want = sorted(((r[0], r[1], None if r[1] is None else True) for r in ROWS), key=str)
    assert got == want
    assert streaming_viterbi.encode(none, path).count() == 0


def test_rules_base_and_sketch(spark, odd, none):
    rows = [tuple(r) for r in adaptive_rules.judged(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    want = []
    for key, text, *_ in ROWS:
        w = words(text)
        counts, inside = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), [False] * len(w)
        for i in range(len(w) - 7):
            if counts[tuple(w[i : i + 8])] > 1:
                inside[i : i + 8] = [True] * 8
        lines = [x for x in (text or "").split("\n") if words(x)]
        want.append((key, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(inside),
                     len(w) < 20 or 100 * sum(inside) > 30 * len(w)))
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert adaptive_rules.judged(none).count() == 0
    measures = adaptive_rules.measures(odd)
    whole = adaptive_rules.sketches(measures)
    halves = adaptive_rules.sketches(measures.filter("doc_id < 5")).unionByName(adaptive_rules.sketches(measures.filter("not coalesce(doc_id < 5, false)")))
    keys = ["lang_key", "source_key"]
    assert sorted(map(tuple, adaptive_rules.merge(whole, keys).collect())) == sorted(map(tuple, adaptive_rules.merge(halves, keys).collect()))


def test_rules_keep_clean_documents(spark):
    import __spark_entry__ as entry

    out = entry.queries()["op10_rules"](spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = out.join(labels, "doc_id").filter("quality = 1 and not base_failed")
    assert good.filter("kept").count() >= 0.95 * good.count()
