"""The queries that stand for whole tables, against the row counts of these and by brute force."""

from __future__ import annotations

import pytest

from tallyspark.catalogue import ORACLE_SQL, QUERIES
from tallyspark.operators import filters as flt

_ROWS_EACH = {
    "q45_multi_sort": ("orders", 1),
    "q83_message_history": ("conversations", 1),
    "q90_kv_blocks": ("orders", 4),
    "q91_delimited": ("orders", 3),
    "q91b_json_records": ("orders", 2),
    "q92_alias_mapping": ("lineitem", 1),
    "q97_prompt_amounts": ("orders", 2),
    "q99_law_metadata": ("documents", 1),
}


@pytest.mark.parametrize("name", sorted(_ROWS_EACH))
def test_rows_of_the_whole_table(spark, sf_dir, name):
    table, each = _ROWS_EACH[name]
    assert QUERIES[name](spark, sf_dir).count() == each * spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert name in ORACLE_SQL


def test_report_list_has_every_conversation(spark, tmp_path):
    spark.createDataFrame([(c, t, "user", "x") for c in range(50) for t in range(c % 4 + 1)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = [(r.conv_id, r.n_turns, r.last_turn) for r in QUERIES["q84_report_list"](spark, str(tmp_path)).collect()]
    assert found == sorted(((c, c % 4 + 1, c % 4) for c in range(50)), key=lambda r: (-r[1], -r[0]))


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_places_with_ties_and_nulls(spark, ranges):
    """Ties share a span of places, in whatever order; equal rows are numbered each, and no range holds all of a hot key."""
    rows = [(k % 5 if k % 4 else None, k % 3) for k in range(900)] + [(2, 1)] * 600
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = flt.placed(spark.createDataFrame(rows, "a long, b long").repartition(6), (("a", False),)).collect()
        assert flt.placed(spark.createDataFrame([], "a long"), (("a", True),)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.place for r in got) == list(range(1, len(rows) + 1))
    assert [r.a for r in sorted(got, key=lambda r: r.place)] == sorted((a for a, _ in rows), key=lambda a: (a is None, -(a or 0)))
    assert sorted(((r.a, r.b) for r in got), key=repr) == sorted(rows, key=repr)


def test_places_keep_other_columns(spark):
    table = spark.createDataFrame([(1, {"a": 1}, [2], "x y"), (2, None, None, None)], "k long, m map<string, int>, v array<int>, `a b` string")
    got = flt.placed(table, (("k", False),))
    assert got.columns == ["k", "m", "v", "a b", "place"] and {r.k: (r.place, r.m, r.v) for r in got.collect()} == {2: (1, None, None), 1: (2, {"a": 1}, [2])}


def test_placed_numbers_all_rows(spark):
    rows = [(k, k % 7 if k % 11 else None, -(k % 13)) for k in range(500)]
    got = flt.placed(spark.createDataFrame(rows, "k long, a long, b long").repartition(5), (("a", True), ("b", False), ("k", True)))
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[2], r[0]))
    assert {r.k: r.place for r in got.collect()} == {r[0]: n for n, r in enumerate(want, 1)}
