"""Exact and near de-duplication against brute force, and the defined cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.llm import exact_dedup, near_dedup
from innsight.llm.components import connected_components
from innsight.llm.tables import read_table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, digest string, DOC_ID_ string"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def brute_components(texts: dict[int, str | None], width: int, percent: int):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return set()
        if len(words) < width:
            return {tuple(words)}
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}

    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_misra_gries_bound():
    rng = random.Random(1)
    values = [rng.choice("ab") if rng.random() < 0.5 else str(rng.random()) for _ in range(5000)]
    kept = exact_dedup.misra_gries(values, 20)
    assert len(kept) <= 20
    for v in "ab":
        assert values.count(v) - 5000 / 21 <= kept[v] <= values.count(v)


def test_exact_on_documents(spark):
    found = rows_of(exact_dedup.op3_exact_dedup(spark, SF))
    groups: dict[str, list[int]] = {}
    for r in read_table(spark, SF, "documents").collect():
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()
        groups.setdefault(digest, []).append(r.doc_id)
    assert sum(map(len, groups.values())) == len(found)
    for digest, ids in groups.items():
        for i in ids:
            r = found[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), digest)


@pytest.mark.parametrize("counters", [2, 1000])
def test_exact_cases(spark, counters):
    """Nulls, white space, repeated rows and a digest that most rows share, on both paths."""
    rows = [(i, "same  text") for i in range(60, 20, -1)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, "same text"), (5, "x"), (5, "x"), (None, "y"), (None, "y")]
    df = spark.createDataFrame([(i, t, "en", "d", "e") for i, t in rows], SCHEMA).repartition(3)
    out = exact_dedup.exact_duplicates(df, counters=counters).collect()
    assert len(out) == len(rows)
    hot = [r for r in out if r.group_size == 41]
    assert len(hot) == 41 and {r.keep_id for r in hot} == {21} and [r.doc_id for r in hot if r.kept] == [21]
    by_id = {r.doc_id: r for r in out}
    assert (by_id[2].keep_id, by_id[2].kept, by_id[1].kept, by_id[1].group_size) == (1, False, True, 2)
    assert by_id[3].keep_id == 3
    assert [r.kept for r in out if r.doc_id == 5].count(True) == 1
    y = [r for r in out if r.doc_id is None and r.keep_id is None]
    assert len(y) == 2 and [r.kept for r in y].count(True) == 1
    left = exact_dedup.drop_exact_copies(df, counters=counters)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 5, 21]


def test_exact_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def test_frequent_digest_is_found(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("d"))
    assert [r.digest for r in exact_dedup.frequent_digests(df.repartition(5), 50).collect()] == ["hot"]


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)]
    links += [(500, 500), (400, 440)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert found == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    multipliers = near_dedup._multipliers()
    for similarity in (0.95, 0.85):
        shared = int(2000 * 2 * similarity / (1 + similarity))
        other = np.concatenate([base[:shared], rng.integers(0, 2**63, 2000 - shared, dtype=np.uint64)])
        a, b = (near_dedup.odd_sketch(near_dedup.minimum_hashes(np.unique(x), multipliers)) for x in (base, other))
        differing = sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
        assert abs(differing - near_dedup.most_differing_bits(similarity)) < 30
        assert differing <= near_dedup.most_differing_bits(similarity - near_dedup.MARGIN)


def test_near_on_documents(spark):
    found = rows_of(near_dedup.op8_near_dedup(spark, SF))
    expected = brute_components({r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}, 3, 85)
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == expected
    assert all(r.kept == (r.component_id == i) for i, r in found.items())


def test_near_group_over_several_tiles(spark):
    """A group of many near copies is split into tiles and still found whole."""
    rng = random.Random(8)
    base = [str(rng.randrange(10**6)) for _ in range(300)]
    texts = {}
    for i in range(600):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(300)] = f"w{rng.random()}"
        texts[i + 10] = " ".join(words)
    texts[1] = "one two"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = rows_of(near_dedup.near_duplicates(df, width=3, percent=85))
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == brute_components(texts, 3, 85)


def test_near_cases(spark):
    long_text = "a b c d e f g h i j k l m n o p " * 500
    rows = [(9, "One two"), (4, "one  TWO"), (5, "one"), (6, None), (7, ""), (8, " \n"), (3, long_text), (12, long_text + "z"), (None, "one two"), (4, "one  TWO")]
    df = spark.createDataFrame([(i, t, "en", "d", "e") for i, t in rows], SCHEMA)
    out = near_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.component_id, r.kept) for r in out}
    assert got == {(9, 4, False), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 8, True), (3, 3, True), (12, 3, False), (None, None, True)}
    assert {r.doc_id: r.n_shingles for r in out}[5] == 1 and {r.doc_id: r.n_shingles for r in out}[6] == 0
    left = near_dedup.drop_near_copies(df)
    # of equal texts one row stays, also of those without an id or with the same one
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7, 8]
    assert near_dedup.near_duplicates(df.filter("1 = 0")).count() == 0


def test_near_copies_go_by_row_not_by_id(spark):
    """Unlike texts under one id stay; ids may be texts."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (7, a), (7, b), (5, b + " more"), (None, a), (None, "alone one two three four five six")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {(r.doc_id, r.text) for r in near_dedup.drop_near_copies(df).collect()}
    assert left == {(3, a), (5, b + " more"), rows[-1]}
    named = spark.createDataFrame([("x", a), ("w", a), ("x", b)], "doc_id string, text string")
    assert {(r.doc_id, r.text) for r in near_dedup.drop_near_copies(named).collect()} == {("w", a), ("x", b)}


def test_star_steps_are_planned_one_at_a_time(spark, monkeypatch):
    """No frame that is written holds a star step's plan several times over, and none broadcasts hubs where there are none."""
    from innsight.llm import components

    plans, write = [], components.materialize
    monkeypatch.setattr(
        components, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, label)
    )
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 5)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in components.connected_components(frame).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 105), 100)}
    assert max(plan.count("Join ") for plan in plans) <= 2
