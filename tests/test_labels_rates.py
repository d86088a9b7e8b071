"""Rate labels and rate frequency on hand-made rows."""

from __future__ import annotations

from pyspark.sql import Row

from innsight.operators import labels as lab
from innsight.operators import rates
from innsight.sources.search_log import LABELS_COLUMN, SEARCH_LOG_SCHEMA, SearchWindow

R, T = "CWT_RATE_SORTED_RANK", "CWT_RATE_TYPE"


def L(i, t, v):  # noqa: E743 - a label struct
    return Row(id=i, type=t, value=v)


# rate id -> (labels, expected type, expected rank); None as expectation = dropped
CASES = {
    "r_none": (None, None),
    "r_empty": ([], None),
    "r_nullel": ([None], (None, None)),
    "r_nullid": ([L(None, None, None)], (None, None)),
    "r_two": ([L(R, R, "2"), L(T, T, "BAR")], ("BAR", "2")),
    "r_nomatch": ([L("X", "X", "1"), L("Y", "Z", "2")], None),
    "r_nullplus": ([L(None, None, None), L("X", "X", "1")], None),
    "r_typemis": ([L(T, "OTHER", "BAR")], None),
    "r_rankonly": ([L(R, R, "3.5")], (None, "3.5")),
    "r_dup": ([L(T, T, "A"), L(T, T, "B")], ("A", None)),
}


def _log(spark):
    rows = [(2019, 5, 25, "s1", "h1", rid, labels) for rid, (labels, _) in CASES.items()]
    return spark.createDataFrame(rows, SEARCH_LOG_SCHEMA)


def test_array_form_label_cases(spark):
    df = lab.with_label_columns(_log(spark).withColumnRenamed("id", "rate_id"))
    got = {r["rate_id"]: (r[T], r[R]) for r in df.collect()}
    want = {rid: exp for rid, (_, exp) in CASES.items() if exp is not None}
    assert got == want


def test_explode_pivot_form_agrees_with_array_form(spark):
    log = _log(spark).withColumnRenamed("id", "rate_id")
    keys = ["rate_id", LABELS_COLUMN]
    pivoted = lab.pivot_labels(lab.explode_labels(log), keys)
    got = {r["rate_id"]: (r[T], r[R]) for r in pivoted.collect()}
    want = {rid: exp for rid, (_, exp) in CASES.items() if exp is not None}
    # r_dup: ``first`` over a shuffle has no defined order; only the array form fixes it.
    assert got.pop("r_dup")[0] in ("A", "B")
    want.pop("r_dup")
    assert got == want


def test_top3_flag(spark):
    df = spark.createDataFrame([(v,) for v in ["1", "3", "3.0", "0", "4", "2.5", "x", None, "-1"]], "r string")
    got = [r["top3_rate_flag"] for r in lab.with_top3_flag(df, "r").collect()]
    assert got == [1, 1, 1, 0, 0, 1, 0, 0, 0]


def test_rate_frequency_counts_distinct_rates(spark):
    rows = [
        # same rate twice in one session -> counted once
        (2019, 5, 24, "s1", "h1", "a", [L(R, R, "1"), L(T, T, "BAR")]),
        (2019, 5, 24, "s1", "h1", "a", [L(R, R, "1"), L(T, T, "BAR")]),
        (2019, 5, 24, "s1", "h1", "b", [L(R, R, "2"), L(T, T, "BAR")]),
        (2019, 5, 24, "s1", "h1", "c", [L(R, R, "9"), L(T, T, "BAR")]),
        (2019, 5, 24, "s1", "h1", "d", [L(None, None, None)]),
        # outside the window
        (2019, 5, 23, "s1", "h1", "a", [L(R, R, "1"), L(T, T, "BAR")]),
        (2019, 6, 24, "s1", "h1", "a", [L(R, R, "1"), L(T, T, "BAR")]),
    ]
    log = spark.createDataFrame(rows, SEARCH_LOG_SCHEMA)
    lookup = spark.createDataFrame([("a", "CNR"), ("b", "CNR")], "rate_id string, new_rate_bucket string")
    freq = rates.rate_frequency(log, lookup, SearchWindow.between("2019-05-24", "2019-05-30"))
    got = sorted(((r["new_rate_bucket"], r[T], r["top3_rate_flag"], r["responses"]) for r in freq.collect()), key=repr)
    assert got == sorted([("CNR", "BAR", 1, 2), ("OTHER", None, 0, 1), ("OTHER", "BAR", 0, 1)], key=repr)
    summary = {(r[T], r["top3_rate_flag"]): r["total_responses"] for r in rates.rate_summary(freq).collect()}
    assert summary == {("BAR", 1): 2, ("BAR", 0): 1, (None, 0): 1}


def test_rate_frequency_equals_explode_pivot_path_on_fixture(spark):
    """The flagship (array form) equals the source job's explode + pivot + count path."""
    from pyspark.sql import functions as F

    from innsight.sources import fixtures as fx

    sf = "/root/testdata/sf0.01"
    log, lookup = fx.fixture_search_log(spark, sf), fx.fixture_rate_lookup(spark, sf)
    unique = rates.distinct_rates(rates.attach_rate_bucket(rates.select_window(log, fx.FIXTURE_WINDOW), lookup))
    pivoted = lab.pivot_labels(lab.explode_labels(unique), rates.RATE_ROW_KEYS)
    textbook = lab.with_top3_flag(pivoted).groupBy(*rates.FREQUENCY_KEYS).agg(F.count(F.lit(1)).alias("responses"))
    ours = rates.rate_frequency(log, lookup, fx.FIXTURE_WINDOW)
    assert ours.count() == textbook.count() > 0
    assert ours.exceptAll(textbook.select(*ours.columns)).count() == 0


def test_rate_frequency_with_lineage_cut_is_unchanged(spark):
    from innsight.sources import fixtures as fx

    sf = "/root/testdata/sf0.001"
    log, lookup = fx.fixture_search_log(spark, sf), fx.fixture_rate_lookup(spark, sf)
    plain = rates.rate_frequency(log, lookup, fx.FIXTURE_WINDOW)
    cut = rates.rate_frequency(log, lookup, fx.FIXTURE_WINDOW, checkpoint=True)
    assert cut.count() == plain.count() > 0
    assert cut.exceptAll(plain).count() == 0
