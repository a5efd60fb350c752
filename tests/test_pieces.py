"""Documents in pieces: whole over several runs, given out by patience, late pieces, repeated and odd lines."""

import json
import time

import pytest

from sheafline.streaming.pieces import Numbers, gather_documents


def block(doc, n, total=None, text=None):
    b = {"doc_id": doc, "line_no": n, "page": 1, "text": text or f"Line {n}", "font_size": 20.0 if n == 1 else 12.0, "font_name": "A", "bbox": [0, 1, 9, 2], "x_center": 1.0, "y_center": float(n or 0)}
    return b if total is None else {**b, "n_blocks": total}


def test_numbers():
    seen = Numbers()
    assert seen.add([3, 1, 2, 3]) == [1, 2, 3] and str(seen) == "1:3" and len(seen) == 3
    assert seen.add([2, 5, 4, 9]) == [4, 5, 9] and str(seen) == "1:5,9:9"
    again = Numbers(str(seen))
    assert again.add([1, 6, 7, 8, 9, 20]) == [6, 7, 8, 20] and str(again) == "1:9,20:20" and len(again) == 10


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def arrive(folder, name, *blocks):
    (folder / "in" / name).write_text(json.dumps(list(blocks)) + "\n")


def run(spark, folder, patience):
    gather_documents(spark, *(str(folder / n) for n in ("in", "out", "progress")), patience=patience).awaitTermination()


def table(spark, folder, name):
    return spark.read.parquet(str(folder / "out" / name))


def test_documents_over_runs(spark, folders):
    arrive(folders, "a.txt", block(1, 2), block(1, 1, 3), block(2, 1, 2), block(3, 1), block(None, 4), block(5, None))
    (folders / "in" / "bad.txt").write_text("no array\n")
    run(spark, folders, 3600)
    assert table(spark, folders, "ended").count() == 0
    arrive(folders, "b.txt", block(1, 2, text="again"), block(1, 3), block(3, 2))
    run(spark, folders, 3600)
    got = sorted((r["doc_id"], r["line_no"], r["text"], r["status"]) for r in table(spark, folders, "ended").collect())
    assert got == [(1, n, f"Line {n}", "whole") for n in (1, 2, 3)]
    arrive(folders, "c.txt", block(1, 4), block(2, 2))
    run(spark, folders, 3600)
    late = [(r["doc_id"], r["line_no"]) for r in table(spark, folders, "late").collect()]
    assert late == [(1, 4)]
    labels = sorted((r["doc_id"], r["line_no"]) for r in table(spark, folders, "labels").collect())
    assert labels == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    assert {r["doc_id"] for r in table(spark, folders, "outlines").collect()} == {1, 2}
    broken = sorted(r["value"] for r in table(spark, folders, "broken").collect())
    assert len(broken) == 2 and "no array" in broken  # a block without a number has its place
    run(spark, folders, 3600)  # nothing new: nothing is given out twice
    assert table(spark, folders, "labels").count() == 5


def test_patience_gives_out_what_is_there(spark, folders):
    arrive(folders, "a.txt", block(1, 1, 5), block(1, 2))
    run(spark, folders, 1)
    time.sleep(2)
    arrive(folders, "b.txt", block(2, 1, 9))
    run(spark, folders, 1)
    got = sorted((r["doc_id"], r["line_no"], r["status"]) for r in table(spark, folders, "ended").collect())
    assert got == [(1, 1, "timeout"), (1, 2, "timeout")]


def test_arriving_files_are_made_by_all_tasks(spark, monkeypatch):
    """The arrays of the arriving files are made before they are dealt into the few files of a batch."""
    from sheafline.plans import io_queries as io
    from sheafline.sources import blocks_json as bj

    seen = []
    made = bj.block_arrays

    def watched(blocks, *rest):
        seen.append(blocks._jdf.queryExecution().optimizedPlan().toString())
        return made(blocks, *rest)

    monkeypatch.setattr(bj, "block_arrays", watched)
    io.incremental_classify(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "RepartitionByExpression [doc_id" not in seen[0]


def test_documents_of_a_bucket_share_the_state(spark, folders, monkeypatch):
    """All documents in one bucket, blocks stored in small values: the same documents come out whole, late or by patience."""
    from sheafline.streaming import pieces

    monkeypatch.setattr(pieces, "BUCKETS", 1)
    arrive(folders, "a.txt", *(block(d, n, 6 if n == 1 else None) for d in (1, 2, 3) for n in (1, 3, 5)))
    run(spark, folders, 1)
    arrive(folders, "b.txt", *(block(d, n) for d in (1, 2) for n in (2, 4, 6, 6)), block(4, 1, 1), block(7, 2, 2))
    run(spark, folders, 3600)
    time.sleep(2)
    arrive(folders, "c.txt", block(1, 9), block(8, 1, 1), block(4, 2))
    run(spark, folders, 3600)
    got = sorted((r["doc_id"], r["line_no"], r["text"], r["status"]) for r in table(spark, folders, "ended").collect())
    want = [(d, n, f"Line {n}", "whole") for d in (1, 2) for n in range(1, 7)] + [(4, 1, "Line 1", "whole"), (8, 1, "Line 1", "whole")]
    want += [(3, n, f"Line {n}", "timeout") for n in (1, 3, 5)] + [(1, 9, "Line 9", "late"), (4, 2, "Line 2", "late")]
    assert got == sorted(want)
