"""Adaptive thresholds against plain quantiles, and sources full of junk."""

import math
import random
from collections import defaultdict

import pytest

from sheafline.llm import adaptive_rules as ar


def words(r, n=60, size=6):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, size))) for _ in range(n))


def clean(r):
    return ". ".join(words(r, 12) for _ in range(5))


def junk(r, kind):
    if kind == "symbols":
        return " ".join(f"{w} #|*&$" for w in words(r, 40).split())
    if kind == "capitals":
        return words(r, 60).upper()
    if kind == "length":
        return " ".join("x" * r.randint(30, 40) for _ in range(30))
    return "\n".join([words(r, 6)] * 2 + [words(r, 6) for _ in range(2)] + ["menu item one two"] * 8)


@pytest.mark.parametrize("share", [0.1, 0.3, 0.45, 0.6])
def test_junk_in_one_source_does_not_move_its_threshold(spark, share):
    r = random.Random(7)
    rows, bad = [], set()
    for source in ("a", "b", "c", "d"):
        rows += [(len(rows) + k, clean(r), "en", source) for k in range(150)]
    for kind in ("symbols", "capitals", "lines") + (("length",) if share < 0.5 else ()):
        n = 200
        for k in range(n):
            is_bad = k < share * n
            rows.append((10_000 + len(rows), junk(r, kind) if is_bad else clean(r), "en", f"mixed {kind}"))
            if is_bad:
                bad.add(rows[-1][0])
    got = {x["doc_id"]: x for x in ar.judged(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()}
    good = {i for i, *_ in rows} - bad
    assert all(got[i]["kept"] for i in good)
    assert not any(got[i]["kept"] for i in bad)


def test_thresholds_against_plain_quantiles(spark, docs):
    measured = [x.asDict() for x in ar.measures(docs).collect()]
    top = lambda k: 0.0 if k == 0 else ar.SMALLEST * (1 + ar.WIDTH) ** k

    def bucket(v):
        return 0 if v < ar.SMALLEST else math.floor(math.log(v / ar.SMALLEST) / math.log(1 + ar.WIDTH)) + 1

    held = defaultdict(list)
    for x in measured:
        if not x["base_failed"]:
            for key in ((x["lang_key"], x["source_key"]), (x["lang_key"],), ()):
                held[key].append(x)

    def limit(key, m):
        values = sorted(bucket(x[m]) for x in held[key])
        low, high = (top(values[math.ceil(share * len(values)) - 1]) for share in (ar.LOW, ar.HIGH))
        return high + max(ar.LEAST_GAPS[m], ar.REACH * (high - low))

    def threshold(x, m):
        keys = [(x["lang_key"], x["source_key"]), (x["lang_key"],), ()]
        own = next((k for k in keys[:2] if len(held[k]) >= ar.LEAST_ROWS), ())
        wide = keys[1] if len(held[keys[1]]) >= ar.LEAST_ROWS else ()
        bound = limit(wide, m) if m in ar.BY_LANGUAGE else min(limit(wide, m), limit((), m))
        return min(limit(own, m), bound + ar.LEAST_GAPS[m])

    want = {}
    for x in measured:
        known = (x["lang_key"], x["source_key"]) in held
        want[x["doc_id"]] = not x["base_failed"] and known and all(x[m] <= threshold(x, m) + 1e-9 for m in ar.LEAST_GAPS)
    got = {x["doc_id"]: x["kept"] for x in ar.judged(docs).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)
