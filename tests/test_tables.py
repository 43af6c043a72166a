"""Operators on small tables, against hand-made results."""

import math
from datetime import datetime, timedelta

import pytest

from ordina import ASCENDING, DESCENDING, INT, NULLS_AFTER, NULLS_BEFORE, REAL, TEXT, TIME, Aggregate, Column, ColumnBuilder, Field, Schema, Table
from ordina.functions.expr import ExpressionError, build_predicate, to_json
from ordina.operators.learn import LinearRegression, LogisticRegression

N = None


@pytest.fixture(scope="module")
def t(spark):
    day = lambda *a: datetime(*a)
    return Table.from_lists(
        {
            "a": (INT, [-1, 2, 3, -4, 5]),
            "b": (REAL, [5, 10, 0, -10, -5]),
            "c": (TEXT, ["foo", "bar", "baz", "", "1"]),
            "d": (REAL, [1, 2, N, 4, N]),
            "e": (TIME, [day(2018, 9, 1), day(2018, 9, 2), N, day(2020, 11, 4), N]),
        },
        spark,
    )


def ints(spark, **columns):
    return Table.from_lists({n: (INT, v) for n, v in columns.items()}, spark)


def test_filter(t):
    assert t.filter(lambda r: r["a"] > 0).to_columns()["a"] == [2, 3, 5]
    assert t.filter(lambda r: r["a"] > r["b"]).to_columns()["a"] == [3, -4, 5]
    assert t.filter(lambda r: ~(r["d"] > 1)).to_columns()["a"] == [-1]
    assert t.filter(lambda r: (r["a"] > 0) | (r["d"] < 0)).to_columns()["a"] == [2]
    assert t.filter(lambda r: r["c"] == "foo").to_columns()["a"] == [-1]
    assert t.filter(lambda r: r["c"].starts_with("ba")).to_columns()["c"] == ["bar", "baz"]
    assert t.filter(lambda r: r["c"].matches("ba.")).to_columns()["c"] == ["bar", "baz"]
    assert t.filter(lambda r: r["c"].matches("b")).row_count == 0
    assert t.filter(lambda r: r["e"] > datetime(2018, 9, 1)).to_columns()["a"] == [2, -4]
    assert t.filter('{"predicate": "gt", "arguments": [{"column": "a"}, 2]}').to_columns()["a"] == [3, 5]
    assert t.filter({"boolean": "and", "arguments": [{"predicate": "gt", "arguments": [{"column": "a"}, 0]}, {"predicate": "eq", "arguments": [{"column": "c"}, "baz"]}]}).to_columns()["a"] == [3]


def test_nulls_in_filter(spark):
    rows = ints(spark, a=[N if i % 3 == 0 else i for i in range(256)])
    assert rows.filter(lambda r: r["a"] % 2 == 0).to_columns()["a"] == [i for i in range(256) if i % 3 and i % 2 == 0]


def test_each(t):
    assert t.each(lambda r: r["a"] + 1).to_list() == [0, 3, 4, -3, 6]
    assert t.each(lambda r: r["a"] * r["b"]).to_list() == [-5, 20, 0, 40, -25]
    assert t.each(lambda r: r["a"] / 2).to_list() == [0, 1, 1, -2, 2]
    assert t.each(lambda r: r["a"] % 2).to_list() == [-1, 0, 1, 0, 1]
    assert t.each(lambda r: r["b"] / 0.0).to_list()[0] == math.inf
    assert math.isnan(t.each(lambda r: r["b"] / 0.0).to_list()[2])
    assert t.each(lambda r: r["e"].year()).to_list() == [2018, 2018, N, 2020, N]
    assert t.each(lambda r: -r["a"]).to_list() == [1, -2, -3, 4, -5]
    assert t.each(lambda r: (r["a"] > 0).switch(r["a"], r["a"].negate())).to_list() == [1, 2, 3, 4, 5]
    assert t.each(lambda r: (r["a"] > 0).switch(r["a"], r["d"])).to_list() == [1, 2, N, 4, N]
    assert t.each(7).to_list() == [7] * 5
    assert t.each_to("a", lambda r: abs(r["a"])).column_names[0] == "a"


def test_type_errors(t):
    for wrong in (lambda r: r["c"] > "a", lambda r: r["c"] == 8, lambda r: r["nope"] > 1, lambda r: r["e"] > 1):
        with pytest.raises(ExpressionError):
            t.filter(wrong)
    for wrong in (lambda r: r["c"] + 1, lambda r: r["a"] % 2.0, lambda r: r["a"].year(), lambda r: -r["e"]):
        with pytest.raises(ExpressionError):
            t.each(wrong)
    for wrong in ({"boolean": "and", "arguments": []}, {"predicate": "ge", "arguments": [1, 2]}, {"boolean": "not", "arguments": []}):
        with pytest.raises(ExpressionError):
            t.filter(wrong)


def test_json_round_trip():
    made = build_predicate(lambda r: ((r["a"] * 2 > 1.5) & ~(r["c"] == "x")) | (r["e"] < datetime(2020, 1, 1)))
    assert to_json(build_predicate(to_json(made))) == to_json(made)


def test_columns(t, spark):
    assert t.columns(["c", "a"]).column_names == ["c", "a"]
    assert t.remove("b").column_names == ["a", "c", "d", "e"]
    assert t.remove_at(0).column_names[0] == "b"
    assert t.rename("a", "z").column_names[0] == "z"
    assert t.filter_columns(lambda c: c.is_numeric).column_names == ["a", "b", "d"]
    assert t.set_at("a", t.column("b")).columns(["a"]).to_columns()["a"] == [5, 10, 0, -10, -5]
    foreign = Column.from_list("n", INT, [1, 2, 3], spark)
    assert t.add_column(1, foreign).column_names[:3] == ["a", "n", "b"]
    assert t.add_column(1, foreign).to_columns()["n"] == [1, 2, 3, N, N]
    assert t.each_column(lambda c: c.rename(c.name + "!")).column_names[0] == "a!"
    both = Table.concat([ints(spark, x=[1, 2, 3]), ints(spark, x=[4, N, 6, 7])])
    assert both.to_columns() == {"x": [1, 2, 3, N], "x_1": [4, N, 6, 7]}
    for wrong in (lambda: t.column("q"), lambda: t.remove("q")):
        with pytest.raises(KeyError):
            wrong()
    with pytest.raises(IndexError):
        t.column_at(9)
    with pytest.raises(IndexError):
        t.add_column(9, foreign)
    with pytest.raises(ValueError):
        t.to_column()


def test_metadata(t, spark):
    assert (t.row_count, t.column_count) == (5, 5) and t.short_rep() == "Table<5x5>"
    assert t.kinds == {"a": INT, "b": REAL, "c": TEXT, "d": REAL, "e": TIME}
    assert t.null_counts()["d"] == 2 and t.column("d").null_count() == 2
    assert t == t.take(5) and t != t.take(4) and t != t.rename("a", "z")
    s = Schema.from_fields([Field("x", INT)]).add_field(1, Field("y", TEXT))
    assert s.index_of("y") == 1 and s.field_by_name("q") is None and len(s.remove_field(0)) == 1
    with pytest.raises(IndexError):
        s.field_at(2)
    assert t.to_json().startswith('{"header": ["a"')
    assert "... 3 more rows ..." in t.to_text(2)
    assert Table.int_sequence("i", 5, 10, 2, spark).to_columns() == {"i": [5, 7, 9]}
    assert Column.index(3, spark).to_list() == [0, 1, 2]


def test_local_rows_are_never_cut(t, monkeypatch, tmp_path):
    n = t.row_count
    monkeypatch.setattr("ordina.table.MOST_LOCAL_ROWS", n)
    assert len(t.to_list()) == n
    monkeypatch.setattr("ordina.table.MOST_LOCAL_ROWS", n - 1)
    for call in (t.to_list, t.to_columns, lambda: t.write_xlsx(str(tmp_path / "x.xlsx"))):
        with pytest.raises(ValueError, match="more than"):
            call()


def test_slices(t):
    assert t.take(2).to_columns()["a"] == [-1, 2]
    assert t.drop(3).to_columns()["a"] == [-4, 5]
    assert t.slice(1, 3).to_columns()["a"] == [2, 3, -4]
    assert t.slice(5, 0).row_count == 0
    assert t.sort("a").slice(1, 2).to_columns()["a"] == [-1, 2]
    for wrong in ((0, 6), (6, 0), (-1, 2), (2, -1)):
        with pytest.raises(IndexError):
            t.slice(*wrong)
    with pytest.raises(IndexError):
        t.take(6)


def test_sort(spark):
    rows = Table.from_lists({"i": (INT, [N, 1, 2, N, 1, 2, N, 2, 1]), "d": (REAL, [20, 8, N, N, 16, 9, 10, 3, N]), "s": (TEXT, [N, "one", N, "4", "4", "five", N, "7", "7"]), "at": (INT, range(9))}, spark)
    order = lambda *keys: rows.sort_multiple(keys).to_columns()["at"]
    assert order(("i", ASCENDING, NULLS_BEFORE)) == [0, 3, 6, 1, 4, 8, 2, 5, 7]
    assert order(("i", ASCENDING, NULLS_AFTER)) == [1, 4, 8, 2, 5, 7, 0, 3, 6]
    assert order(("i", DESCENDING, NULLS_BEFORE)) == [0, 3, 6, 2, 5, 7, 1, 4, 8]
    assert order(("i", ASCENDING, NULLS_AFTER), ("d", DESCENDING, NULLS_AFTER)) == [4, 1, 8, 5, 7, 2, 0, 6, 3]
    assert order(("s", ASCENDING, NULLS_AFTER), ("at", DESCENDING, NULLS_AFTER)) == [4, 3, 8, 7, 5, 1, 6, 2, 0]
    assert rows.sort_descending("d").to_columns()["d"] == [20, 16, 10, 9, 8, 3, N, N, N]
    assert rows.sort("d").sort("i").to_columns()["at"] == [1, 4, 8, 7, 5, 2, 6, 0, 3]
    foreign = Column.from_list("k", INT, [9, 8, 7, 6, 5, 4, 3, 2, 1], spark)
    assert rows.sort_multiple([(foreign, ASCENDING, NULLS_AFTER)]).to_columns()["at"] == list(range(8, -1, -1))
    assert rows.permute([2, 0, 2]).to_columns()["at"] == [2, 0, 2]


def test_nulls(spark):
    rows = Table.from_lists({"a": (INT, [0, N, 2, 3, 4]), "b": (REAL, [0, 1, N, 3, 4]), "c": (TEXT, ["0", "1", "2", "3", N])}, spark)
    assert rows.drop_na().to_columns()["a"] == [0, 3]
    assert rows.drop_na_at("a").to_columns()["c"] == ["0", "2", "3", N]
    assert rows.fill_na(8).to_columns() == {"a": [0, 8, 2, 3, 4], "b": [0, 1, 8, 3, 4], "c": ["0", "1", "2", "3", "8"]}
    assert rows.fill_na("4.0").to_columns()["a"][1] == 4 and rows.fill_na("4.0").to_columns()["c"][4] == "4.0"
    assert rows.fill_na(1.5).to_columns() == {"a": [0, 1, 2, 3, 4], "b": [0, 1, 1.5, 3, 4], "c": ["0", "1", "2", "3", "1.500000"]}
    assert rows.fill_na_at("b", 9).to_columns()["b"][2] == 9 and rows.fill_na_at({"a": 5, "c": "x"}).null_counts()["b"] == 1
    assert rows.describe_na().to_list() == [("a", 1, 0.2), ("b", 1, 0.2), ("c", 1, 0.2)]
    with pytest.raises(ValueError):
        rows.fill_na("foo")
    with pytest.raises(KeyError):
        rows.drop_na_at("q")
    nan = Table.from_lists({"x": (REAL, [float("nan"), N, 1])}, spark)
    assert nan.drop_na().row_count == 2


def test_interpolate(spark):
    rows = Table.from_lists({"d": (REAL, [N, N, 1, 2, N, 3, N, N, N, 4, N])}, spark)
    assert rows.interpolate().to_columns()["d"] == [1, 1, 1, 2, 2.5, 3, 3.25, 3.5, 3.75, 4, 4]
    assert Column.from_list("i", INT, [N, 10, N, N, 16, N], spark).interpolate().to_list() == [10, 10, 12, 14, 16, 16]
    days = Column.from_list("t", TIME, [datetime(2020, 1, 1), N, datetime(2020, 1, 3)], spark)
    assert days.interpolate().to_list()[1] == datetime(2020, 1, 2)
    assert Column.from_list("n", REAL, [N, N], spark).interpolate().to_list() == [N, N]
    with pytest.raises(TypeError):
        Column.from_list("s", TEXT, ["a", N], spark).interpolate()


def test_aggregates(spark):
    rows = ints(spark, id=[N, 1, 2, 1, N, 5, 2, 2, 4], a=[5, 8, 3, 1, 5, 2, 8, 7, N])
    made = rows.aggregate_by("id", [("a", list(Aggregate))]).to_columns()
    assert made["id"] == [N, 1, 2, 5, 4]
    assert made["a_min"] == [5, 1, 3, 2, N] and made["a_max"] == [5, 8, 8, 2, N]
    assert made["a_mean"] == [5, 4.5, 6, 2, N] and made["a_length"] == [2, 2, 3, 1, 1]
    assert made["a_median"] == [5, 4.5, 7, 2, N] and made["a_sum"] == [10, 9, 18, 2, 0]
    assert made["a_first"] == [5, 8, 3, 2, N] and made["a_last"] == [5, 1, 7, 2, N]
    assert made["a_std dev"][1] == 3.5 and made["a_RSI"][0] == 100
    texts = Table.from_lists({"k": (TEXT, ["x", "x"]), "v": (TEXT, ["a", N])}, spark)
    assert texts.aggregate("k", "v", Aggregate.LENGTH).to_list() == [("x", 2.0)]
    with pytest.raises(TypeError):
        texts.aggregate("k", "v", Aggregate.MEAN)
    lists = ints(spark, id=[1, 1, 2, N, 1], v=[1, N, 3, 4, 5]).group_to_lists("id").to_list()
    assert lists == [(N, [4]), (1, [1, N, 5]), (2, [3])]
    assert ints(spark, v=[2, N, 2, 1, N]).count_values("v").to_list() == [(2, 2), (1, 1), (N, 2)]
    sorted_first = rows.sort_descending("a").aggregate("id", "a", Aggregate.FIRST)
    assert sorted_first.to_columns()["id"] == [N, 1, 2, 5, 4]


def test_statistics(spark):
    c = Column.from_list("x", INT, [1, N, 2, 4, 9], spark)
    assert [c.value(s) for s in ("min", "max", "mean", "median", "sum")] == [1, 9, 4, 3, 16]
    assert c.value("variance") == pytest.approx(9.5) and c.quantile(0.25).to_list() == [1.5]
    assert c.quantile(0).to_list() == [1] and c.quantile(1).to_list() == [9]
    assert Column.from_list("x", REAL, [-3, -1], spark).value("max") == -1
    assert Column.from_list("x", INT, [5, 10, 6], spark).value("RSI") == 100
    assert Column.from_list("x", INT, [-5, -10, -6], spark).value("RSI") == 0
    assert Column.from_list("x", INT, [N, N], spark).value("RSI") is N
    with pytest.raises(TypeError):
        Column.from_list("s", TEXT, ["a"], spark).min()
    both = ints(spark, a=[1, N, 2, 4, 9], b=[2, 4, 6, 5, 8])
    assert both.correlations().to_columns()["a"][1] == pytest.approx(0.824, abs=1e-3)
    assert both.correlations_with("a").to_columns()["column"] == ["b", "a"]
    assert math.isnan(ints(spark, a=[1, 1], b=[1, 2]).column("a").correlation(ints(spark, b=[1, 2]).column("b")))
    assert both.describe().to_columns()["column"] == ["a", "b"]
    assert both.describe_column("a").to_columns()["quantile 0.250000"] == [1.5]
    assert c.describe().column_names == ["mean", "std dev", "min", "max"]
    s = Column.from_list("x", INT, [1, 2, 3, 2, 5, 6, 7], spark)
    assert s.auto_corr(0) == pytest.approx(1) and s.auto_corr(1) == pytest.approx(s.auto_corr(-1))
    assert math.isnan(s.auto_corr(50))


def test_shift(spark):
    c = Column.from_list("x", INT, [1, 2, 3], spark)
    want = {-4: [N, N, N], -2: [3, N, N], -1: [2, 3, N], 0: [1, 2, 3], 1: [N, 1, 2], 2: [N, N, 1], 3: [N, N, N]}
    assert {k: c.shift(k).to_list() for k in want} == want
    assert c.to_table().shift("x", 1).column_names == ["x", "x_shift_1"]


def test_blocks_agree_with_one_block(spark, monkeypatch):
    """Positions, shifts and lines must not change where blocks are cut."""
    from ordina.operators import timeseries
    from ordina.plans import order

    values = [None if i % 5 in (1, 2) else (i * 37) % 11 for i in range(60)]
    rows = ints(spark, x=values, k=list(range(60))).filter(lambda r: ~(r["k"] % 7 == 3))
    whole = (rows.shift("x", 3).to_list(), rows.shift("x", -2).to_list(), rows.interpolate(["x"]).to_list(), rows.slice(10, 5).to_list())
    for module in (order, timeseries):
        monkeypatch.setattr(module, "BLOCK", 8)
    assert whole == (rows.shift("x", 3).to_list(), rows.shift("x", -2).to_list(), rows.interpolate(["x"]).to_list(), rows.slice(10, 5).to_list())
    assert rows.shift("x", 20).to_columns()["x_shift_20"] == [None] * 20 + rows.to_columns()["x"][:-20]


def test_rolling(spark):
    at = [datetime(2013, 1, 1, 9, 0, s) for s in (0, 2, 3, 5, 6)]
    rows = Table.from_lists({"time": (TIME, at), "val": (REAL, [0, 1, 2, N, 4])}, spark)
    two = timedelta(seconds=2)
    assert rows.rolling("time", two, "val", Aggregate.SUM).to_columns()["val_sum"] == [0, 1, 3, 0, 4]
    assert rows.rolling_widths("time", two).to_columns()["width"] == [1, 1, 2, 1, 2]
    assert rows.rolling("time", two, "val", Aggregate.MEAN).to_columns()["val_mean"] == [0, 1, 1.5, N, 4]
    assert rows.rolling("time", two, "val", Aggregate.STD).to_columns()["val_std dev"] == [N, N, 0.5, N, N]
    with pytest.raises(TypeError):
        rows.rolling("val", two, "val", Aggregate.SUM)


@pytest.mark.parametrize("kind", [INT, REAL])
def test_rolling_ties_against_brute_force(spark, kind):
    import random

    random.seed(4)
    keys = sorted(random.choices(range(40), k=80))
    values = [random.choice([None, *range(10)]) for _ in keys]
    rows = Table.from_lists({"k": (kind, keys), "v": (INT, values)}, spark)
    made = rows.rolling_multiple("k", 5, [("v", [Aggregate.SUM, Aggregate.FIRST, Aggregate.LENGTH, Aggregate.MEDIAN])]).to_columns()
    for i, k in enumerate(keys):
        window = [v for j, v in enumerate(values[: i + 1]) if keys[j] > k - 5]
        valid = [v for v in window if v is not None]
        assert made["v_length"][i] == len(window) and made["v_sum"][i] == sum(valid)
        assert made["v_first"][i] == (valid[0] if valid else None)


@pytest.mark.parametrize("peers", [False, True])
def test_window_functions_against_brute_force(peers):
    """Every function of every window, beside nulls, NaN, infinities and a value that swallows the others."""
    import random
    import statistics

    import numpy as np
    import pyarrow as pa

    from ordina.operators.windows import Windows, evaluate

    random.seed(7)
    for n, odd in ((1, [N]), (2, [N]), (37, [N]), (300, [N]), (300, [N, math.nan, math.inf]), (100, [1e300])):
        keys = np.array(sorted(random.choices(range(n // 2 + 1), k=n)))
        values = [random.choice(odd) if random.random() < 0.3 else 1e9 + random.randrange(100) / 4 for _ in range(n)]
        first = np.searchsorted(keys, keys - 9, "right")
        last = np.searchsorted(keys, keys, "right") - 1 if peers else np.arange(n)
        with np.errstate(all="ignore"):
            made = {f: evaluate(f, Windows(n, first, last), pa.array(values, pa.float64())).to_pylist() for f in Aggregate}
        for i in range(n):
            valid = [v for v in values[first[i] : last[i] + 1] if v is not None]
            known = [v for v in valid if v == v]
            assert made[Aggregate.LENGTH][i] == last[i] - first[i] + 1
            want = {Aggregate.MINIMUM: min(known, default=N), Aggregate.MAXIMUM: max(known, default=N), Aggregate.FIRST: valid[0] if valid else N, Aggregate.LAST: valid[-1] if valid else N}
            want[Aggregate.MEDIAN] = statistics.median(sorted(valid, key=lambda v: (v != v, v))) if valid else N
            want[Aggregate.SUM] = math.fsum(valid) if all(map(math.isfinite, valid)) else sum(valid)
            want[Aggregate.MEAN] = want[Aggregate.SUM] / len(valid) if valid else N
            if all(map(math.isfinite, valid)) and max(valid, default=0) < 1e300:
                want[Aggregate.STD] = statistics.pstdev(valid) if len(valid) > 1 else N
                want[Aggregate.RSI] = N if not valid else 100.0
            for f, w in want.items():
                got = made[f][i]
                assert got is w is N or (got is not N and w is not N and (got == pytest.approx(w, rel=1e-13, abs=1e-9, nan_ok=True))), (f, i, got, w)


def test_rolling_by_long_intervals_reads_no_row_per_window(spark):
    """20,000 rows in one interval: by frames that are added up anew for each row this took 200 million steps a function."""
    import time

    n = 20_000
    df = spark.range(n).selectExpr("id AS k", "CAST(id % 100 AS DOUBLE) AS v", "id * 0.5D AS half")
    began = time.perf_counter()
    t = Table.from_df(df, ["k"])
    made = t.rolling_multiple("k", n, [("v", [Aggregate.MEDIAN, Aggregate.SUM, Aggregate.STD])]).to_columns()
    real = t.rolling("half", float(n), "v", Aggregate.SUM).to_columns()["v_sum"]
    assert made["v_median"][-1] == 49.5 and made["v_sum"][-1] == real[-1] == 49.5 * n and made["v_std dev"][-1] == pytest.approx(28.866070047722118)
    assert time.perf_counter() - began < 30


def test_rolling_by_many_rows_of_equal_time(spark):
    """30,000 rows at three hours: later rows of equal time are not in a window, and no window is added up by itself."""
    import time

    n = 30_000
    df = spark.range(n).selectExpr("id AS k", "timestamp_ntz'2024-01-01' + make_dt_interval(0, CAST(id % 3 AS INT)) AS hour", "CAST(1 AS DOUBLE) AS v")
    began = time.perf_counter()
    t = Table.from_df(df, ["k"])
    made = t.rolling("hour", timedelta(hours=2), "v", Aggregate.SUM).to_columns()["v_sum"]
    third = n // 3
    assert made == [*range(1, third + 1), *range(third + 1, 2 * third + 1), *range(third + 1, 2 * third + 1)]
    assert time.perf_counter() - began < 30


def test_rolling_peers_and_keys_without_place(spark):
    keys = [1.0, 1.0, N, 2.0, math.nan, math.inf, 2.0, -math.inf]
    rows = Table.from_lists({"k": (REAL, keys), "v": (INT, [1, 2, 4, 8, 16, 32, 64, 128])}, spark)
    got = {p: dict(zip([1, 2, 3, 4], rows.filter(lambda r: (r["k"] > 0) & (r["k"] < 9)).rolling_multiple("k", 1.5, [("v", [Aggregate.SUM])], peers=p).to_columns()["v_sum"], strict=True)) for p in (False, True)}
    assert got == {False: {1: 1, 2: 3, 3: 11, 4: 75}, True: {1: 3, 2: 3, 3: 75, 4: 75}}
    assert rows.rolling_widths("k", 1.5, peers=True).row_count == 8
    assert sorted(rows.rolling("k", 1.5, "v", Aggregate.SUM).to_columns()["v_sum"]) == [0, 0, 0, 0, 1, 3, 11, 75]
    large = Table.from_lists({"k": (INT, [2**62, 2**62 + 1, 2**62 + 3]), "v": (INT, [1, 2, 4])}, spark)
    assert large.rolling("k", 2.5, "v", Aggregate.LENGTH).to_columns()["v_length"] == [1, 2, 2]



def test_numpy_without_lists_on_the_driver(spark, monkeypatch):
    import tracemalloc

    import numpy as np
    from pyspark.sql import DataFrame

    from ordina.catalogue import QUERIES

    tracemalloc.start()
    c = Column.from_numpy("v", np.where(np.arange(300_000) % 3 == 0, np.nan, np.arange(300_000.0)), spark)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * 300_000  # a list of rows takes more
    back = c.to_numpy()
    assert back.shape == (300_000,) and np.isnan(back[::3]).all() and (back[1::3] == np.arange(300_000.0)[1::3]).all()
    assert c.null_count() == 100_000
    assert Column.from_list("i", INT, [1, N, 3], spark).map_numpy("r", lambda x: x * 2 - 2).to_list() == [0, N, 4]
    assert Table.from_lists({"a": (INT, [1, N]), "t": (TEXT, ["x", "y"]), "b": (REAL, [0.5, 2])}, spark).to_numpy()[0].tolist() == [1, 0.5]
    assert Table.from_lists({"a": (INT, [])}, spark).to_numpy().shape == (0, 1)
    with pytest.raises(TypeError):
        Column.from_list("s", TEXT, ["x"], spark).map_numpy("r", abs)
    for name in ("toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, name, lambda self: pytest.fail("the column went to the driver"))
    QUERIES["numpy_and_back"](spark, "/root/testdata/sf0.001")


def test_series_are_whole(spark, tmp_path):
    from ordina.catalogue import QUERIES

    spark.range(30_000).selectExpr("id AS s_suppkey", "id * 0.5D AS s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    made = QUERIES["chart_series"](spark, str(tmp_path))
    assert made.count() == 30_000 and made.selectExpr("sum(s_suppkey)", "sum(s_acctbal)").first() == (449985000, 224992500)
    t = Table.read_parquet(str(tmp_path / "supplier.parquet"), spark).sort_descending("s_suppkey")
    assert t.series(["s_suppkey"])[:2] == [(29_999,), (29_998,)] and len(t.series(["s_suppkey"])) == 30_000
    some = [r[0] for r in t.series(["s_suppkey"], 100)]
    assert 50 < len(some) < 200 and some == sorted(some, reverse=True)


def test_reshape(spark):
    rows = Table.from_lists({"n": (TEXT, ["a", N, "c", "d"]), "tags": (TEXT, ["x,y", "z", N, "p;,q"])}, spark)
    assert rows.ungroup_splitting_on("tags", ",;").to_list() == [("a", "x"), ("a", "y"), (N, "z"), ("d", "p"), ("d", ""), ("d", "q")]
    assert rows.split_on("tags", "").to_list()[0] == ["x,y"]
    lists = ints(spark, k=[1, 1, 2], v=[1, 2, 3]).group_to_lists("k")
    assert lists.ungroup("v").to_list() == [(1, 1), (1, 2), (2, 3)]
    assert lists.column("v").flatten().to_list() == [1, 2, 3]
    with pytest.raises(TypeError):
        rows.ungroup("n")


def test_learning(spark):
    rows = Table.from_lists({"x": (REAL, [1, 2, 3, 4, 5]), "y": (REAL, [3, 5, 7, 9, 11])}, spark)
    fitted = rows.fit(LinearRegression(), ["x"], "y")
    assert Table.from_lists({"x": (REAL, [20, N])}, spark).predict(fitted).to_columns()["Predictions"] == [pytest.approx(41), N]
    assert rows.score(fitted, "y") == pytest.approx(1)
    classes = Table.from_lists({"x": (REAL, [0, 1, 9, 10]), "y": (INT, [0, 0, 1, 1])}, spark)
    assert classes.score(classes.fit(LogisticRegression().set_c(10), ["x"], "y"), "y") == 1
    made = Table.from_lists({"s": (TEXT, ["b", "a", N, "b"])}, spark).one_hot("s")
    assert made.to_columns() == {"s: b": [1, 0, 0, 1], "s: a": [0, 1, 0, 0]}
    assert classes.confusion_matrix("y", "y").to_list() == [(0, 0, 2), (1, 1, 2)]
    assert Table.from_lists({"v": (REAL, [0, 1, 2, 10])}, spark).histogram("v", 5).to_columns()["count"] == [2, 1, 0, 0, 1]
    assert Column.from_list("x", INT, [1, N], spark).map("y", INT, lambda x: -1 if x is None else x * 2).to_list() == [2, -1]


def test_builders_and_charts(spark):
    c = ColumnBuilder("x", INT).append(1).append_many([None, 3]).finish(spark)
    assert c.to_list() == [1, N, 3] and (c.min_value(), c.max_value(), c.sum_value(), c.mean_value()) == (1, 3, 4, 2)
    assert Table.from_schema_and_columns(Schema.from_fields([Field("y", INT)]), [c]).to_columns() == {"y": [1, N, 3]}
    with pytest.raises(TypeError):
        Table.from_schema_and_columns(Schema.from_fields([Field("y", TEXT)]), [c])
    assert Column.from_numpy("v", [1.5, math.nan], spark).to_list() == [1.5, N]
    assert math.isnan(c.to_numpy()[1])
    t = Table.from_lists({"v": (REAL, [float(i % 10) for i in range(200)])}, spark)
    made = t.kde("v", 200).to_columns()
    step = made["x"][1] - made["x"][0]
    assert sum(made["density"]) * step == pytest.approx(1, abs=0.01)
    assert len(t.series(["v"])) == 200 and len(t.series(["v"], 50)) < 120
    with_null = Table.from_lists({"v": (REAL, [0, 1, 2, N, 5]), "u": (REAL, [1, 0, N, 2, 2])}, spark)
    made = with_null.kde2("v", "u", 60).to_columns()
    area = (made["x"][60] - made["x"][0]) * (made["y"][1] - made["y"][0])
    assert sum(made["density"]) * area == pytest.approx(1, abs=0.02) and with_null.filter(lambda r: r["v"] > 9).kde2("v", "u").row_count == 0


def test_ranks_of_large_columns(spark):
    """Narrowed brackets give the value of each rank: ties, NaN, few and many values left at the end."""
    import random

    from pyspark.sql import functions as F

    from ordina.operators import ranks

    rng = random.Random(7)
    for values in ([rng.random() for _ in range(3000)], [rng.choice([1.0, 1.0, 2.0, 7.5]) for _ in range(3000)], [5.0] * 500, [math.nan, -1.0, 0.0] * 50 + [None] * 9, list(map(float, range(20)))):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        want = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
        places = sorted({0, len(want) - 1, len(want) // 2, len(want) // 3, 1})
        for few, accuracy in ((10, 20), (2, 100), (100_000, 100)):
            made = ranks.values_at(df, F.col("x"), places, few, accuracy)
            assert all(made[p] == want[p] or made[p] != made[p] and want[p] != want[p] for p in places)


def test_quantiles_do_not_depend_on_the_way(spark, monkeypatch):
    from ordina.operators import ranks

    rows = Table.from_lists({"x": (REAL, [float((i * 37) % 101) for i in range(101)] + [N]), "y": (INT, [i * i for i in range(102)])}, spark)
    made = lambda: (rows.describe().to_list(), rows.describe_column("x").to_list(), rows.column("y").median_value(), rows.column("x").quantile(0.3).to_list())
    at_once = made()
    monkeypatch.setattr(ranks, "AT_ONCE", 5)
    assert made() == at_once


def test_long_slices_go_by_position(spark, monkeypatch):
    from ordina import table

    rows = ints(spark, x=list(range(100))).filter(lambda r: r["x"] % 3 == 0).sort_descending("x")
    top = rows.take(20).to_list()
    monkeypatch.setattr(table, "MOST_TOP_ROWS", 5)
    assert rows.take(20).to_list() == top and len(top) == 20


def test_rows_of_a_query_keep_their_numbers(spark):
    """A table of a shuffled query has one order, however often it is evaluated."""
    df = spark.range(2000).repartition(7).selectExpr("id AS x", "rand() AS r")
    t = Table.from_df(df)
    assert t == t and t.shift("x", 1).to_columns()["x_shift_1"][1:] == t.to_columns()["x"][:-1]
