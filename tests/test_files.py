"""Files in and out."""

from datetime import datetime

import pytest

from ordina import INT, REAL, TEXT, TIME, Table
from ordina.sources.csv import CsvError, records


def test_records():
    assert list(records("a,b\n1,\n")) == [["a", "b"], ["1", ""]]
    assert list(records('"x ""y"", z",2\r\n\n"p\nq",3')) == [['x "y", z', "2"], [""], ["p\nq", "3"]]
    assert list(records('a," 15"run,b')) == [["a", " 15", "un", "b"]]
    assert list(records("﻿foo\n1\n")) == [["foo"], ["1"]]
    assert list(records("")) == [] and list(records("\n")) == [[""]] and list(records("a,")) == [["a", ""]]
    with pytest.raises(CsvError):
        list(records('"open'))


def test_deduction(spark):
    text = "i,r,d,mixed,t,none\n1,1.5,2005-03-16,2005-03-16,x,\n-2,3,2005-3-7,5,,\n,.5,,,z,\n"
    t = Table.parse_csv(text, spark=spark)
    assert t.kinds == {"i": INT, "r": REAL, "d": TIME, "mixed": TEXT, "t": TEXT, "none": TEXT}
    assert t.to_columns()["i"] == [1, -2, None] and t.to_columns()["d"][1] == datetime(2005, 3, 7)
    assert t.to_columns()["t"] == ["x", None, "z"]
    assert Table.parse_csv("2005-03-16 xyz\n", "generated", spark=spark).kinds == {"col0": TEXT}
    late = Table.parse_csv("n\n" + "1\n" * 60 + "x\n", spark=spark).to_columns()["n"]
    assert late == [1] * 60 + [None]


def test_headers(spark):
    assert Table.parse_csv("a,,c\n1,2,3,4", spark=spark).column_names == ["a", "MISSING_1", "c", "MISSING_3"]
    assert Table.parse_csv("1,2", "generated", spark=spark).column_names == ["col0", "col1"]
    assert Table.parse_csv("1,2", ["x"], spark=spark).column_names == ["x", "col1"]
    assert Table.parse_csv("1,2\nq,3", "generated", [INT, REAL], spark=spark).to_list() == [(1, 2.0), (None, 3.0)]
    assert Table.parse_csv("1,2\n3", "generated", spark=spark).to_list() == [(1, 2), (3, None)]


@pytest.fixture(scope="module")
def table(spark):
    return Table.from_lists({"i": (INT, [1, None, 3]), "r": (REAL, [8.5, 2.0, None]), "s": (TEXT, ['q"x', " lead", None]), "t": (TIME, [datetime(2018, 9, 1), None, datetime(2020, 1, 2)])}, spark)


def test_csv_text(table):
    assert table.to_csv() == 'i,r,s,t\n1,8.500000,"q""x",2018-09-01\n,2.000000," lead",\n3,,,2020-01-02'
    assert table.to_csv(header=False, quote_all=True).split("\n")[1] == ',"2.000000"," lead",'


def test_round_trips(spark, table, tmp_path):
    for kind in ("csv", "txt", "feather", "parquet"):
        path = str(tmp_path / f"x.{kind}")
        table.write(path)
        back = Table.read(path, spark=spark) if kind != "parquet" else Table.read_parquet(path, spark)
        assert back.to_list() == table.to_list(), kind
    table.write(str(tmp_path / "x.XLSX"))
    back = Table.read_xlsx(str(tmp_path / "x.XLSX"), types=[INT, REAL, TEXT, TIME], spark=spark)
    assert back.to_columns()["i"] == [1, None, 3] and back.to_columns()["s"] == ['q"x', " lead", ""]
    assert back.to_columns()["t"] == table.to_columns()["t"]
    assert Table.read(str(tmp_path / "x.XLSX"), spark=spark).kinds["i"] == TEXT
    with pytest.raises(ValueError):
        table.write(str(tmp_path / "x.doc"))
    table.write_csv_parts(str(tmp_path / "parts"))
    parts = sorted(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts) == table.to_csv() + "\n"
    assert Table.read(str(tmp_path / "parts"), spark=spark).to_list() == table.to_list()


def test_csv_options(spark, table, tmp_path):
    path = str(tmp_path / "x.csv")
    table.write_csv(path, separator=";", quote="'")
    assert table.to_csv(separator=";", quote="'").split("\n")[1] == "1;8.500000;q\"x;2018-09-01"
    assert Table.read_csv(path, separator=";", quote="'", spark=spark).to_list() == table.to_list()
    assert Table.parse_csv("a;b\n'x;''y';2", separator=";", quote="'", spark=spark).to_list() == [("x;'y", 2)]


def test_lines_and_quoted_line_ends(spark, tmp_path):
    """Files are tokenized line by line only where no quoted field holds a line end; both give what the text gives."""
    many = "\ufeffi,s\n" + "".join(f'{i},"q ""{i}"""\r\n' if i % 3 else f"{i},x\"y\n" for i in range(5000)) + "\n7,last"
    open_ended = 'i,s\n1,"a\nb"\n2,c\n'
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        for k, text in enumerate((many, open_ended, "", "i\n", "i,s\n\n")):
            path = tmp_path / f"{k}.csv"
            path.write_text(text, newline="")
            want = Table.parse_csv(text, spark=spark)
            got = Table.read(str(path), spark=spark)
            assert got.column_names == want.column_names and got.to_list() == want.to_list(), k
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_line_ends_in_many_tasks(spark, tmp_path, monkeypatch):
    """Records of several lines are put together over ends of splits, blocks and files, and no task gets the whole file."""
    import random

    from ordina.sources import csv

    monkeypatch.setattr(csv, "BLOCK", 8)
    seen = tmp_path / "seen"
    seen.mkdir()
    tokenize = csv._records_of_lines

    def watched(separator, quote):
        def run(batches, run=tokenize(separator, quote), folder=str(seen)):
            import uuid

            rows = 0
            for batch in run(batches):
                rows += batch.num_rows
                yield batch
            open(f"{folder}/{uuid.uuid4().hex}", "w").write(str(rows))

        return run

    monkeypatch.setattr(csv, "_records_of_lines", watched)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    random.seed(5)
    cell = lambda: random.choice(["", "x", '"y\nz"', '"a""\n""b"', '"\n\n"', '"q"w"e\nr"', 'm"n', '"end\r\n"', '""', "lone\r"])
    try:
        for k in range(3):
            text = "\ufeffa,b,c\n" + "".join(",".join([str(i), cell(), cell()]) + random.choice(["\n", "\r\n"]) for i in range(700)) + '1,2,"' + "long\n" * 40 + '"'
            path = tmp_path / f"{k}.csv"
            path.write_text(text, newline="")
            got, want = Table.read(str(path), spark=spark), Table.parse_csv(text, spark=spark)
            assert got.column_names == want.column_names and got.to_list() == want.to_list(), k
        counts = [int(p.read_text()) for p in seen.iterdir()]
        assert sum(counts) == 3 * 702 and max(counts) < 702
        (tmp_path / "open.csv").write_text('a\n1\n"x\ny\n')
        with pytest.raises(CsvError):
            Table.read(str(tmp_path / "open.csv"), spark=spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_feather_parts(spark, table, tmp_path, monkeypatch):
    from pyarrow import feather
    from pyspark.sql import DataFrame

    from ordina.catalogue import QUERIES
    from ordina.sources import feather as parts

    path = str(tmp_path / "x")
    table.write_feather_parts(path)
    assert Table.read(path, spark=spark).to_list() == table.to_list() and Table.read(path, spark=spark).kinds == table.kinds
    nothing = table.filter(lambda r: r["r"] > 100)
    nothing.write_feather_parts(path + "0")
    back = Table.read(path + "0", spark=spark)
    assert back.to_list() == [] and back.kinds == table.kinds
    monkeypatch.setattr(parts, "PART_BYTES", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        many = Table.from_df(spark.range(0, 5000, 1, 3).selectExpr("5000 - id AS k", "repeat('\u00e4\n', CAST(id % 7 AS INT)) AS s", "IF(id % 3 = 0, NULL, id / 7) AS v", "array(id, NULL) AS l"), ["k"])
        many.write_feather_parts(path + "1")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    written = sorted(p for p in (tmp_path / "x1").iterdir() if p.suffix == ".feather")
    assert len(written) > 40 and sum(feather.read_table(p).num_rows for p in written) == 5000
    back = Table.read(path + "1", spark=spark)
    assert back.to_list() == many.to_list() and back.sort("k").take(2).to_columns()["k"] == [1, 2]
    (tmp_path / "a.csv").write_text("ARROW1,b\n1,2\n")
    assert Table.read(str(tmp_path / "a.csv"), spark=spark).to_list() == [(1, 2)]
    arrow = DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: made if (made := arrow(self)).num_rows == 0 else pytest.fail("rows went to the driver"))
    QUERIES["feather_file"](spark, "/root/testdata/sf0.001")


def test_read_sniffs_and_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("PK\x03\x04,b\n1,2\n")
    assert Table.read(str(tmp_path / "a.csv"), spark=spark).to_list() == [(1, 2)]
    (tmp_path / "b.parquet").write_bytes(b"PAR1 damaged")
    with pytest.raises(Exception):
        Table.read(str(tmp_path / "b.parquet"), spark=spark)
    with pytest.raises(FileNotFoundError):
        Table.read(str(tmp_path / "none"), spark=spark)
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "c"))
    assert Table.read(str(tmp_path / "c"), spark=spark).to_columns() == {"id": [0, 1, 2, 3, 4]}
    spark.range(3).coalesce(1).selectExpr("id AS x").write.parquet(f"file:{tmp_path}/d")
    Table.read_parquet(f"{tmp_path}/d", spark).write_feather(f"file:{tmp_path}/d.feather")
    assert Table.read(f"{tmp_path}/d.feather", spark=spark).to_columns() == {"x": [0, 1, 2]}


def test_parquet_order_over_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1000, 1, 7).write.parquet(path)
    t = Table.read_parquet(path, spark)
    assert t.to_columns()["id"] == list(range(1000))
    assert t.slice(500, 2).to_columns()["id"] == [500, 501]
    assert t.take(0).row_count == 0
