"""Every reference query against its SQL twin, and the operators' small cases."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.plans.registry import ORACLES, QUERIES


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def clean(v):
        if pd.isna(v):
            return None
        return str(v) if isinstance(v, (str, bool)) or not hasattr(v, "__float__") else round(float(v), 9)

    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"create view {file.split('.')[0]} as select * from '{data}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, data, name):
    frame = QUERIES[name](spark, data)
    got, want = frame.toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("score", "team", "pct", "cap", "want"), [(8, True, 50, None, 400), (8, False, 50, None, 800), (25, False, 100, 20, 2000), (8, False, 100, 8, 800), (8, True, 50, 3, 300)])
def test_factor_then_cap(spark, score, team, pct, cap, want):
    from assayer.operators.scoring import item_score

    frame = spark.createDataFrame([(score, team, pct, cap)], "s long, t boolean, p long, c long")
    assert frame.select(item_score(F.col("s"), F.col("t"), F.col("p"), F.col("c"))).first()[0] == want


def test_take_max_is_the_same_in_any_order(spark):
    """The winner is the greatest by score, then the smallest name, whatever the order and the partitions of the rows."""
    import random

    from assayer.operators.scoring import take_max

    rnd = random.Random(12)
    rows = [(f"team{k % 3}", f"n{rnd.randrange(40):02d}-{k}", rnd.randrange(4)) for k in range(60)]
    want = sorted(min((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])) for g in {r[0] for r in rows})
    for parts in (1, 2, 7):
        rnd.shuffle(rows)
        frame = spark.createDataFrame(rows, "g string, id string, score long").repartition(parts)
        assert sorted(tuple(r) for r in take_max(frame, ["g"], [F.desc("score"), F.asc("id")]).collect()) == want


def test_exclusive_groups_keep_the_best_set(spark):
    from assayer.operators.scoring import best_independent

    frame = spark.createDataFrame([(1, 10, 9, 4)], "k long, a long, b long, c long")
    got = best_independent(frame, "k", ["a", "b", "c"], [(0, 1), (1, 2)]).first()
    assert (got["kept"], got["total"]) == ("a,c", 14)


def test_text_functions(spark):
    from assayer.functions import text as T

    frame = spark.createDataFrame([("国家级 一等奖 ab cd 3.5", "2025", "=1+1", "得 1,234.5 分")], "a string, y string, f string, n string")
    got = frame.select(T.norm_key(F.col("a")), T.search_tokens(F.col("a")), T.academic_year(F.col("y")), T.csv_safe(F.col("f")), T.first_number(F.col("n"))).first()
    assert got[0] == "国家级一等奖abcd3.5"
    assert got[1][:2] == ["abcd", "3.5"] and "等奖" in got[1] and "国" in got[1]
    assert list(got)[2:] == ["2025-2026", "'=1+1", 1234.5]
