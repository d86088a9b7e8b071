"""The mix against a plain computation, its defined cases and its plan."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from innsight.llm import mixing
from innsight.llm.tables import read_table

SF = "/root/testdata/sf0.001"


def plain_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    stopped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        weights = sum(w for s, w in weight.items() if s not in stopped)
        over = {s for s in sizes if s not in stopped and weights and weight[s] * left >= 3 * sizes[s] * weights}
        if not over:
            break
        stopped |= over
    return {s: 3.0 * sizes[s] if s in stopped else weight[s] * left / weights for s in sizes}


def check(rows, documents):
    size_of = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in documents}
    source_of = {i: s for i, _, s in documents}
    total: dict = {}
    for i, n in size_of.items():
        total[source_of[i]] = total.get(source_of[i], 0) + n
    targets = plain_targets(total)
    taken: dict = dict.fromkeys(total, 0)
    for r in rows:
        s = source_of[r.doc_id]
        assert (r.size, r.source_size) == (size_of[r.doc_id], total[s])
        assert r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    largest = {s: max(size_of[i] for i in size_of if source_of[i] == s) for s in total}
    for s in total:
        assert targets[s] - largest[s] <= taken[s] <= targets[s]
    return taken, targets


def test_mix_on_documents(spark):
    rows = mixing.op7_mixing(spark, SF).collect()
    documents = [(r.doc_id, r.text, r.source) for r in read_table(spark, SF, "documents").collect()]
    assert len(rows) == len(documents)
    check(rows, documents)
    assert sorted(rows) == sorted(mixing.op7_mixing(spark, SF).collect())


def test_mix_cases(spark):
    documents = [(i, "w " * (i % 7), "big") for i in range(1, 200)]
    documents += [(300, "a b c", None), (301, None, "tiny"), (302, "x", "tiny"), (303, "", ""), (304, " \t", "")]
    df = spark.createDataFrame([(*d, "s", 1) for d in documents], "doc_id long, text string, source string, mix_row string, size int")
    rows = mixing.mix_documents(df).collect()
    taken, targets = check(rows, documents)
    assert targets["tiny"] == 3 and taken["tiny"] == 3 and taken[None] == 9 and taken[""] == 0
    order = mixing.training_order(df)
    assert order.columns == df.columns
    copies = {r.doc_id: r.copies for r in rows if r.copies}
    assert {r.doc_id: r["count"] for r in order.groupBy("doc_id").count().collect()} == copies


def test_no_document_left_fits(spark):
    """A long document at the boundary of the partial pass leaves a gap that many short ones must close."""
    rank = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    ids = sorted(range(300), key=rank)
    size = {i: 5 + i % 7 for i in ids} | {ids[30]: 1500}
    documents = [(i, "w " * n, "a") for i, n in size.items()]
    documents += [(1000 + i, "w " * 10, s) for s in "bcd" for i in range(50)]
    df = spark.createDataFrame(documents, "doc_id long, text string, source string")
    rows = [r for r in mixing.mix_documents(df).collect() if r.doc_id < 1000]
    gap = rows[0].target - sum(r.taken for r in rows)
    passes = int(rows[0].target // rows[0].source_size)
    smallest = min(r.size for r in rows if r.copies == passes)
    assert passes == 0 and 0 <= gap < smallest
    assert sum(r.copies for r in rows) > 30 + 4
    # the documents taken stand one after the other in the schedule, none on top of another
    positions = sorted((r.positions[0], r.size) for r in rows if r.copies)
    start, end = mixing.SCHEDULE[1]
    ahead = 0
    for p, n in positions:
        asked = (start * p + (end - start) * p * p / 2) / ((start + end) / 2)
        assert asked * rows[0].target == pytest.approx(ahead + n / 2, abs=1e-6)
        ahead += n


def test_mix_empty_null_and_repeated(spark):
    schema = "doc_id long, text string, source string"
    empty = spark.createDataFrame([], schema)
    assert mixing.mix_documents(empty).count() == 0 and mixing.training_order(empty).count() == 0
    same = spark.createDataFrame([(None, "a b", "s"), (None, "a b", "s"), (7, "c", "s"), (7, "c", "s")], schema)
    rows = mixing.mix_documents(same).collect()
    assert sum(r.taken for r in rows) == 6 and {r.target for r in rows} == {6.0}
    assert mixing.training_order(same).count() == 4
    wordless = spark.createDataFrame([(1, " ", "s"), (2, None, None)], schema)
    assert [(r.target, r.taken) for r in mixing.mix_documents(wordless).collect()] == [(0.0, 0)] * 2


def test_partial_pass_takes_what_fits_in_hash_order(spark):
    """The plan of a source equals a plain walk through its documents."""
    import random

    rng = random.Random(5)
    documents = [(i, "w " * rng.choice([1, 3, 9, 40, 200]), rng.choice("aab")) for i in range(400)]
    documents += [(1000 + i, "w " * 3000, "c") for i in range(20)]
    df = spark.createDataFrame(documents, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.mix_documents(df).collect()}
    for source in "abc":
        own = sorted((i for i, _, s in documents if s == source), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        target, whole = rows[own[0]].target, rows[own[0]].source_size
        passes, gap = int(target // whole), int(target - target // whole * whole)
        for i in own:
            extra = rows[i].size <= gap
            gap -= extra * rows[i].size
            assert rows[i].copies == passes + extra


def test_rows_that_are_alike_do_not_meet(spark):
    """Many equal rows: each is matched to its plan by a number of its own."""
    df = spark.range(60_000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("n")
    )
    assert mixing.training_order(df).agg(F.count("n"), F.sum("n")).first() == (60_000, 60_000)


def test_positions_follow_the_schedule(spark):
    """At every time, each source has about as many words placed as its integrated weight asks."""
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source")
    )
    placed = mixing.mix_documents(df).select("doc_id", "size", "target", F.explode("positions").alias("p")).toPandas()
    for k, (start, end) in enumerate([mixing.SCHEDULE[1], mixing.SCHEDULE[2], mixing.SCHEDULE[3]]):
        own = placed[placed.doc_id % 3 == k]
        for t in (0.25, 0.5, 0.75):
            asked = (start * t + (end - start) * t * t / 2) / ((start + end) / 2)
            assert abs(own[own.p <= t]["size"].sum() / own.target.iloc[0] - asked) < 0.02


def test_mix_plan_is_native(spark):
    plan = mixing.op7_mixing(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hash_order_is_md5(spark):
    key = spark.range(1).select(mixing.id_hash(F.lit(12)).alias("k")).first().k
    assert key == hashlib.md5(b"12").hexdigest()
