"""The corpus pipeline, stage by stage, against plain rules on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import CLASHING, check_packing, docs, empty_docs, table

SF = "/root/testdata/sf0.01"


def test_registered_with_the_operators():
    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


def test_stages_follow_from_their_input(spark):
    given = table(spark, SF, "documents")
    original = given.columns
    before = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, SF), "test")
        assert after.columns == original, name
        old = {r["doc_id"]: r["text"] for r in before.collect()}
        new = {r["doc_id"]: r["text"] for r in after.collect()}
        assert new.keys() <= old.keys()
        if name == "quality":
            marks = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
            assert sum(marks.get(i) == 1 for i in old.keys() - new.keys()) <= 4
            assert sum(marks.get(i) == 0 for i in new) <= 6
        elif name == "exact_dedup":
            norm = lambda t: " ".join(t.split())
            first = {}
            for i in sorted(old):
                first.setdefault(norm(old[i]), i)
            assert set(first.values()) == set(new)
        elif name == "near_dedup":
            assert 0.9 * len(old) < len(new) <= len(old)
        elif name == "pii":
            assert new.keys() == old.keys() and any(new[i] != old[i] for i in old)
        before = after
    name, last = corpus_pipeline.STAGES[-1]
    check_packing(before, last(spark, before, SF).collect())


def test_near_stage_against_brute_force(spark):
    """Of all texts that chains of three bits connect, the smallest id stays."""
    given = table(spark, SF, "documents")
    rows = sorted((r["doc_id"], brute.fingerprint(r["text"])) for r in given.collect())
    ids, prints = [i for i, _ in rows], np.array([f for _, f in rows], dtype=np.uint64)
    least = dict(zip(ids, ids))
    changed = True
    close = [np.flatnonzero(np.bitwise_count(prints ^ f) <= 3) for f in prints]
    while changed:
        changed = False
        for i, near in zip(ids, close):
            low = min(least[ids[j]] for j in near)
            changed |= low < least[i]
            least[i] = low
    kept = {r["doc_id"] for r in corpus_pipeline.unlike_documents(spark, given, SF).collect()}
    assert kept == {i for i in ids if least[i] == i} and len(kept) < len(ids)


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_packed_sequences_hold_their_tokens(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert all(len(r["ids"]) == 4 * r["length"] > 0 for r in got.select("ids", "length").collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, name, stage):
    assert stage(spark, empty_docs(spark), SF).count() == 0
    rows = [(1, None), (1, None), (None, "x y z"), (2, ""), (3, "a" * 200_000), (3, "b c")]
    out = stage(spark, docs(spark, rows, CLASHING), SF)
    assert out.count() >= 0
    if name != "packing":
        assert out.columns == docs(spark, [], CLASHING).columns


def test_no_document_is_made_up(spark):
    given = table(spark, "/root/testdata/sf0.001", "documents")
    kept = corpus_pipeline.good_documents(spark, given, "/root/testdata/sf0.001")
    assert kept.join(given, given.columns, "left_anti").count() == 0
    assert brute.fingerprint("") == 0 and kept.where(F.col("doc_id").isNull()).count() == 0
