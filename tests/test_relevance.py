import random

import pytest
from pyspark.sql import functions as F

from sheafline.operators import answers as an
from sheafline.operators import relevance as rv
from sheafline.operators.summary import extractive_summary


@pytest.mark.parametrize("limit", [None, 15])
def test_nearest_bodies_equal_brute_force(spark, limit):
    rng = random.Random(2)
    rows = [
        (d, i, rng.randint(1, 2), float(rng.randint(0, 12)), rng.choice(["Body", "Body", "H1"]), f"t{i}")
        for d in range(6) for i in range(40)
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, line_no bigint, page int, y_center double, label string, text string")
    heads = df.filter("label = 'H1'").select("doc_id", "page", "y_center", F.col("line_no").alias("head_no"))
    got = sorted(
        (r["doc_id"], r["head_no"], r["near_rank"], r["body_no"])
        for r in rv.nearest_bodies(heads, df, limit=limit or 10_000).collect()
    )
    want = []
    for d, i, page, y, label, _ in rows:
        if label == "H1":
            near = sorted((abs(b[3] - y), b[1]) for b in rows if b[0] == d and b[2] == page and b[4] == "Body")
            want += [(d, i, k + 1, n[1]) for k, n in enumerate(near[:3])]
    assert got == sorted(want)


@pytest.fixture(scope="module")
def request_data(spark):
    rng = random.Random(8)
    words = ["menu", "salad", "city", "tips", "bar", "soup", "plan"]
    sections = [
        (d, s, " ".join(rng.choices(words, k=rng.randint(1, 4))), rng.randint(1, 3)) for d in range(30) for s in range(1, 5)
    ]
    manifest = [(j, o, d) for j in range(3) for o, d in enumerate(range(j, 30, 2))]
    jobs = [(0, "p0", "plan a menu with soup"), (1, "p1", "city tips"), (2, "p2", "!!")]
    return (
        spark.createDataFrame(sections, "doc_id bigint, seq int, text string, page int"),
        spark.createDataFrame(manifest, "job_id bigint, doc_ord bigint, doc_id bigint"),
        spark.createDataFrame(jobs, "job_id bigint, persona string, task string"),
        sections, manifest, jobs,
    )


def plain_cosine(a, b):
    x = {w: a.split().count(w) for w in a.split()}
    y = {w: b.split().count(w) for w in b.split() if w != "!!"}
    size = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y.get(k, 0) for k, v in x.items()) / size if size else 0.0


@pytest.mark.parametrize("largest,docs_per_job", [(10, 15), (None, None), (None, 10**6)])
def test_scores_and_top_sections(spark, request_data, largest, docs_per_job):
    sections, manifest, jobs, s_rows, m_rows, j_rows = request_data
    scored = rv.relevance_scores(sections, manifest, jobs, largest=largest, docs_per_job=docs_per_job)
    got = {(r["job_id"], r["doc_id"], r["seq"]): r["score"] for r in scored.collect()}
    tasks = {j: t for j, _, t in j_rows}
    want = {
        (j, d, s): plain_cosine(text, tasks[j]) for j, _, d in m_rows for dd, s, text, _ in s_rows if dd == d
    }
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    rank = {"city": 1, "tips": 4, "bar": 5}
    texts = {(d, s): t for d, s, t, _ in s_rows}
    order = {(j, d): o for j, o, d in m_rows}

    def importance(t):
        return min((rank[w] for w in t.split() if w in rank), default=99)

    top = rv.top_sections(scored).collect()
    for j in tasks:
        mine = [(r["doc_id"], r["seq"]) for r in sorted((r for r in top if r["job_id"] == j), key=lambda r: r["rank"])]
        rows = sorted(
            (k for k in want if k[0] == j),
            key=lambda k: (importance(texts[k[1:]]), -got[k], order[j, k[1]], k[2]),
        )
        assert mine == [k[1:] for k in rows[:5]]


def test_spread_vectors_equal_plain_join(spark, request_data):
    sections, manifest, jobs, *_ = request_data
    listed = rv.request_sections(sections, manifest)
    vectors = rv.job_vectors(jobs)
    spread = rv.attach_jobs(listed, manifest, vectors, docs_per_chunk=4).select("job_id", "doc_id", "seq", "_norm")
    plain = rv.attach_jobs(listed, manifest, vectors, docs_per_job=1).select("job_id", "doc_id", "seq", "_norm")
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


def test_summary_keeps_order_and_length(spark):
    text = " ".join(f"Sentence {i} tells of soup and bread in some {'more ' * (i % 5)}words." for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "One short line."), (3, "")], "k int, content string")
    got = {r["k"]: r["summary"] for r in extractive_summary(df, ["k"]).collect()}
    assert 3 not in got and got[2] == "One short line."
    assert 50 <= len(got[1].split()) <= 120
    numbers = [int(w) for w, before in zip(got[1].split()[1:], got[1].split()) if before == "Sentence"]
    assert numbers == sorted(numbers)


def test_one_very_long_sentence_is_cut(spark):
    df = spark.createDataFrame([(1, "word " * 500)], "k int, content string")
    assert len(extractive_summary(df, ["k"]).first()["summary"].split()) == 120


def test_missing_and_unprocessed(spark):
    m = spark.createDataFrame([(1, 0, 5), (1, 1, 6)], "job_id bigint, doc_ord bigint, doc_id bigint")
    d = spark.createDataFrame([(5,)], "doc_id bigint")
    assert [r["doc_id"] for r in an.missing_documents(m, d).collect()] == [6]
    assert [r["doc_id"] for r in an.listed_documents(m, d).collect()] == [5]


def test_own_encoder_and_summarizer_reach_the_answer(spark):
    from sheafline.operators import encoders as en

    blocks = spark.createDataFrame(
        [
            (d, n, 1, text, label, 10.0 * n, size)
            for d in (1, 2)
            for n, text, label, size in [
                (1, "Salad menu", "H1", 16.0), (2, "cut the leaves. then wash.", "Body", 12.0), (3, "Night bar", "H2", 15.0)
            ]
        ],
        "doc_id bigint, line_no bigint, page int, text string, label string, y_center double, font_size double",
    )
    manifest = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (8, 0, 2)], "job_id bigint, doc_ord bigint, doc_id bigint")
    jobs = spark.createDataFrame([(7, "p", "bar"), (8, "q", "salad")], "job_id bigint, persona string, task string")

    def load_encoder():
        import numpy as np

        return lambda texts: np.array([["bar" in t.lower(), "salad" in t.lower()] for t in texts], dtype="float32")

    encode = en.encoder(load_encoder)
    summarize = en.summarizer(lambda: lambda texts: [t.upper() for t in texts])
    out = an.job_answer(blocks, manifest, jobs, largest=3, docs_per_job=2, encode=encode, summarize=summarize).collect()
    scores = {(r["job_id"], r["doc_id"], r["section_title"]): r["score"] for r in out}
    assert scores[7, 1, "Night bar"] == scores[7, 2, "Night bar"] == scores[8, 2, "Salad menu"] == 1.0
    assert scores[7, 1, "Salad menu"] == scores[8, 2, "Night bar"] == 0.0
    assert {r["refined_text"] for r in out} == {"CUT THE LEAVES. THEN WASH."}


def test_summaries_are_only_mapped(spark):
    """Contents do not move, whatever their number; ties go to the first sentence, and a text without tokens has no summary."""
    df = spark.createDataFrame([(1, "One two. Three four. One five."), (2, "..."), (3, None), (4, "A b c. D e f.")], "k int, content string")
    out = extractive_summary(df, ["k"], min_words=2, max_words=4)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["summary"] for r in out.collect()} == {1: "One two. One five.", 4: "A b c."}
