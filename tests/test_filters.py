"""Filters: the Python matcher against both Spark back ends, and the corner cases."""

import math
import random

import pytest

from vecspan.errors import InvalidConfig
from vecspan.operators import filters as f
from vecspan.types import META, meta_struct

ROWS = [
    {}, {"k": 1}, {"k": 2026}, {"k": 3}, {"k": 2.5}, {"k": "7"}, {"k": "a", "l": True}, {"k": True}, {"k": False, "l": 5}, {"k": math.nan}, {"k": math.inf},
    {"k": -math.inf, "l": "x"}, {"k": (1 << 53) + 1}, {"l": 3}, {"l": 3.0, "k": 0},
]


@pytest.fixture(scope="module")
def rows(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("meta", META)])
    return spark.createDataFrame([(i, meta_struct(m)) for i, m in enumerate(ROWS)], schema).cache()


def check(rows, flt):
    want = [i for i, m in enumerate(ROWS) if flt.matches(m)]
    assert sorted(r.id for r in rows.where(flt.compile(f.MapSource())).collect()) == want, flt
    assert sorted(r.id for r in rows.where(flt.where(f.MapSource())).collect()) == want, flt
    return want


def test_cases(rows):
    assert 0 in check(rows, f.negate(f.eq("k", 1)))
    assert check(rows, f.gt("k", 2025.5)) == [2, 10, 12]
    assert check(rows, f.eq("l", 3.0)) == [13, 14]
    assert check(rows, f.eq("k", 7)) == []
    assert check(rows, f.gt("k", "6")) == []
    assert check(rows, f.eq("k", True)) == [7]
    assert check(rows, f.eq("k", 1 << 53)) == [12]
    assert check(rows, f.eq("k", math.nan)) == []
    assert check(rows, f.gte("k", math.inf)) == []
    assert check(rows, f.eq("k", math.inf)) == [10]
    assert check(rows, f.lt("k", math.inf)) == [1, 2, 3, 4, 11, 12, 14]
    assert check(rows, f.all_of()) == list(range(len(ROWS)))
    assert check(rows, f.any_of()) == check(rows, f.is_in("k", [])) == []
    assert check(rows, f.is_in("k", [3, "a", True])) == [3, 6, 7]


def test_random(rows):
    r = random.Random(3)
    values = [1, 3, 2.5, "7", "a", True, False, math.inf, 0, 2026]

    def make(depth):
        if depth and r.random() < 0.6:
            op = r.choice(["and", "or", "not"])
            return f.negate(make(depth - 1)) if op == "not" else f.Filter(op, parts=tuple(make(depth - 1) for _ in range(r.randrange(3))))
        op = r.choice(["eq", "in", "gt", "gte", "lt", "lte"])
        return f.Filter(op, r.choice("klm"), tuple(r.choice(values) for _ in range(r.randrange(3) if op == "in" else 1)))

    for _ in range(25):
        check(rows, make(3))


def test_columns(spark):
    df = spark.createDataFrame([(1, 5, "a", 1.5, True), (2, None, None, None, None), (3, 7, "b", math.nan, False)], "id long, i long, s string, d double, b boolean")
    get = lambda flt: sorted(r.id for r in df.where(flt.where(f.ColumnSource(df, {"n": "i"}))).collect())
    assert get(f.gt("n", 5)) == [3] and get(f.gt("i", 4.5)) == [1, 3] and get(f.negate(f.eq("s", "a"))) == [2, 3]
    assert get(f.lte("d", 2)) == [1] and get(f.eq("b", True)) == [1] and get(f.eq("nothing", 1)) == [] and get(f.negate(f.eq("nothing", 1))) == [1, 2, 3]


def test_pushed_down(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS x").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(f.all_of(f.gt("x", 4), f.eq("id", 3)).where(f.ColumnSource(df)))._jdf.queryExecution().toString()
    assert "GreaterThan(x,4)" in plan and "EqualTo(id,3)" in plan


@pytest.mark.parametrize("bad", [None, [], {}, {"eq": 1}, {"eq": ["k"]}, {"eq": [1, 2]}, {"near": ["k", 1]}, {"and": {}}, {"in": ["k", 1]}, {"eq": ["k", None]}, {"eq": ["k", 1], "gt": ["k", 1]}, {"eq": ("k", 1)}])
def test_parse_errors(bad):
    with pytest.raises(InvalidConfig):
        f.parse(bad)


def test_parse():
    assert f.parse({"and": [{"eq": ["k", 1]}, {"not": {"in": ["l", ["a", 2.5]]}}]}) == f.all_of(f.eq("k", 1), f.negate(f.is_in("l", ["a", 2.5])))
