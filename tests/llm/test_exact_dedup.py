"""Exact deduplication against a plain grouping, and the index over several batches."""

import hashlib

from lectern.llm import exact_dedup
from lectern.llm.common import shared_path

ROWS = [
    (1, "a", "x"), (2, "a", "y"), (5, "a", "y"), (3, None, None), (4, "", "x"), (6, " a", "x"),
    (7, "b" * 50_000, "x"), (8, "b" * 50_000, "x"), (9, "b" * 50_000 + "c", "x"),
    (10, "r", "x"), (10, "r", "x"), (None, "n", "x"), (None, "a", "x"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string")


def test_groups(spark):
    rows = exact_dedup.exact_duplicates(frame(spark, ROWS)).collect()
    got = {(r.doc_id, r.text_sha256): r for r in rows}
    assert len(rows) == len(ROWS) and len(got) == len(set(ROWS)) == 12
    for doc_id, text, _ in ROWS:
        same = [d for d, t, _ in ROWS if (t or "") == (text or "")]
        keep = max((d for d in same if d is not None), default=None)
        row = got[doc_id, hashlib.sha256((text or "").encode()).hexdigest()]
        assert (row.keep_id, row.group_size, row.kept) == (keep, len(same), doc_id == keep)


def test_stage_keeps_one_row_of_each_text(spark):
    rows = exact_dedup.drop_copies(frame(spark, ROWS)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text, r.keep_id) for r in rows if r.doc_id is not None) == [
        (False, 4, "", "x"), (False, 5, "a", "y"), (False, 6, " a", "x"), (False, 8, "b" * 50_000, "x"),
        (False, 9, "b" * 50_000 + "c", "x"), (False, 10, "r", "x"),
    ]
    assert [r.text for r in rows if r.doc_id is None] == ["n"]


def test_index_over_batches(spark):
    path = shared_path(spark, "digests")
    index = exact_dedup.DigestIndex(spark, path, 4)
    assert [r.kept for r in index.admit(frame(spark, [(1, "a", "")])).collect()] == [True]
    later = exact_dedup.DigestIndex(spark, path, 4)
    rows = {r.doc_id: r for r in later.admit(frame(spark, [(7, "a", ""), (8, "new", "")])).collect()}
    assert (rows[7].keep_id, rows[7].kept, rows[8].keep_id, rows[8].kept) == (1, False, 8, True)
    assert later.admit(frame(spark, [])).count() == 0
    assert later.table().count() == 2


def test_a_repeated_batch_gets_the_same_answer(spark):
    path = shared_path(spark, "digests")
    index = exact_dedup.DigestIndex(spark, path, 4)
    index.admit(frame(spark, [(1, "a", "")]), "monday").collect()
    rows = [(7, "a", ""), (8, "new", ""), (9, "new", "")]
    first = sorted(index.admit(frame(spark, rows), "tuesday").collect())
    assert [r.kept for r in first] == [False, False, True]
    assert sorted(exact_dedup.DigestIndex(spark, path, 4).admit(frame(spark, rows), "tuesday").collect()) == first
    spark.sql(f"DROP TABLE {index.name}")  # a new session has no table, only the folder
    later = exact_dedup.DigestIndex(spark, path, 4)
    assert sorted(later.admit(frame(spark, rows), "tuesday").collect()) == first
    assert later.table().count() == 2
    assert [r.kept for r in later.admit(frame(spark, rows[1:]), "it's {wednesday}").collect()] == [False, False]


def test_a_batch_that_dies_after_its_digests_were_added(spark, monkeypatch):
    index = exact_dedup.DigestIndex(spark, shared_path(spark, "digests"), 4)
    rows = [(1, "a", ""), (2, "b", "")]

    def dies(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as broken:
        broken.setattr(exact_dedup, "join_groups", dies)
        try:
            index.admit(frame(spark, rows), "monday")
        except RuntimeError:
            pass
    assert index.table().count() == 2
    assert [r.kept for r in index.admit(frame(spark, rows), "monday").collect()] == [True, True]


def test_folders_of_one_name(spark):
    one, two = (exact_dedup.DigestIndex(spark, f"{shared_path(spark, 'digests')}/same", 4) for _ in range(2))
    for index in (one, two):
        assert index.admit(frame(spark, [(1, "a", "")])).first().kept


def test_anti_join_reads_the_index_in_place(spark):
    index = exact_dedup.DigestIndex(spark, shared_path(spark, "digests"), 4)
    index.admit(frame(spark, ROWS)).collect()
    groups = frame(spark, ROWS).selectExpr("unhex(sha2(text, 256)) AS digest").groupBy("digest").count()
    plan = groups.hint("merge").join(index.table().select("digest"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1
