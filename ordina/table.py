"""Ordered tables and their columns: the package's user interface."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import datetime, timedelta
from typing import Any, Union

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.aggregates import Aggregate
from .functions.compile import compile_predicate, compile_value, present, quoted
from .functions.expr import Source, build_predicate, build_value
from .operators import charts, group, learn, nulls, reshape, stats, timeseries
from .operators.ranks import quantiles
from .plans.order import RID, ROW_ORDER, Key, assign, dense, from_sorted, sorts, stage
from .schema import INT, LIST, REAL, TEXT, TIME, Field, Schema, kind_of, spark_type
from .session import session
from .sources import csv, feather, files, xlsx

ASCENDING, DESCENDING = "ascending", "descending"
NULLS_BEFORE, NULLS_AFTER = "before", "after"

#: Rows that go to the driver at most where a call returns Python values of a whole table or column.
MOST_LOCAL_ROWS = 10_000_000
#: Leading rows up to which a slice is a top-n, which ends in one task; longer ones are cut by position.
MOST_TOP_ROWS = 100_000


def _widened(df: DataFrame) -> list[SparkColumn]:
    """Columns of ``df`` with integers as longs, floats as doubles and dates as timestamps."""
    out = []
    for f in df.schema.fields:
        c, kind = quoted(f.name), kind_of(f.dataType)
        if kind == INT and not isinstance(f.dataType, T.LongType):
            c = c.cast("long")
        elif kind == REAL and not isinstance(f.dataType, T.DoubleType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return out


class Table:
    """Columns of equal length in a fixed order of rows. Every method gives a new table and runs no job
    unless its documentation says that it has to look at the data."""

    def __init__(self, df: DataFrame, names: Sequence[str], order: Sequence[Key] = ROW_ORDER, numbered: bool = False):
        if len(set(names)) != len(names):
            raise ValueError("column names have to differ")
        self._df, self._names, self._order = df, tuple(names), tuple(order)
        self._is_numbered = numbered  # row ids are 0, 1, 2 ... without gaps

    # Sources.

    @staticmethod
    def from_df(df: DataFrame, order_by: Sequence[str] | None = None) -> Table:
        """A table of a DataFrame, its order given by columns that identify a row; without them, that of one pass over
        its partitions, which is staged, as a second evaluation of ``df`` could number its rows otherwise."""
        names = df.columns
        wide = _widened(df)
        if order_by:
            keys = [Key(f"__k{i}") for i in range(len(order_by))]
            return Table(df.select(*wide, *[quoted(c).alias(k.column) for c, k in zip(order_by, keys, strict=True)]), names, keys)
        return Table(stage(df.select(*wide, F.monotonically_increasing_id().alias(RID)), "rows"), names)

    @staticmethod
    def read_parquet(path: str, spark: SparkSession | None = None) -> Table:
        """Rows by file name, then by their place in the file; pushdown and pruning reach the scan."""
        df = (spark or session()).read.parquet(path)
        names = df.columns
        rows = assign(df)
        return Table(rows.select(*_widened(rows.select(*map(quoted, names))), RID), names, numbered=True)

    @staticmethod
    def read_csv(path: str, header: str | Sequence[str] = "read", types: Sequence[str] = (), spark: SparkSession | None = None, separator: str = ",", quote: str = '"') -> Table:
        """One CSV file, or a folder of parts of one; reads it to deduce types (see ``sources.csv``)."""
        return Table(*csv.read_file(spark or session(), path, header, types, separator, quote), numbered=True)

    @staticmethod
    def parse_csv(text: str, header: str | Sequence[str] = "read", types: Sequence[str] = (), spark: SparkSession | None = None, separator: str = ",", quote: str = '"') -> Table:
        return Table(*csv.read_text(spark or session(), text, header, types, separator, quote), numbered=True)

    @staticmethod
    def read_xlsx(path: str, header: str | Sequence[str] = "read", types: Sequence[str] = (), spark: SparkSession | None = None) -> Table:
        """The active sheet of a workbook. Columns without a given type are text, "" where blank."""
        spark = spark or session()
        rows = xlsx.read_cells(files.content(spark, path))
        width = max(map(len, rows), default=0)
        first = ["" if x is None else str(x) for x in rows[0]] if rows and header == "read" else None
        names = csv.unique_names(csv.header_names(header, first, width))
        body = rows[1:] if header == "read" else rows
        kinds = [types[i] if i < len(types) else None for i in range(width)]
        columns = [[_xlsx_value(r[i], kinds[i]) for r in body] for i in range(width)]
        return Table.from_lists({n: (k or TEXT, c) for n, k, c in zip(names, kinds, columns, strict=True)}, spark)

    @staticmethod
    def read_feather(path: str, spark: SparkSession | None = None) -> Table:
        """One Feather file, or a folder of parts of one table; a file is one task's work."""
        df = feather.read(spark or session(), path)
        names = [c for c in df.columns if c != RID]
        return Table(df.select(*_widened(df.drop(RID)), RID), names, numbered=True)

    @staticmethod
    def read(path: str, spark: SparkSession | None = None) -> Table:
        """By signature: XLSX, Feather or Parquet; else CSV, which a file that only begins as XLSX or Feather is too.

        Only the first bytes are looked at; a folder has the signature of its first file. A damaged Parquet file is
        an error.
        """
        spark = spark or session()
        head = files.head(spark, path, 8)
        if head.startswith(b"PAR1"):
            return Table.read_parquet(path, spark)
        for signature, reader in ((b"PK\x03\x04", Table.read_xlsx), (b"FEA1", Table.read_feather), (b"ARROW1", Table.read_feather)):
            if head.startswith(signature):
                try:
                    return reader(path, spark=spark)
                except Exception:  # noqa: BLE001  text may begin with these letters: the next format gets its turn
                    break
        return Table.read_csv(path, spark=spark)

    @staticmethod
    def from_lists(columns: Mapping[str, tuple[str, Sequence[Any]]], spark: SparkSession | None = None) -> Table:
        """name -> (kind, values); shorter columns are padded with nulls."""
        spark = spark or session()
        length = max((len(v) for _, v in columns.values()), default=0)
        fields = [T.StructField(n, spark_type(k)) for n, (k, _) in columns.items()]
        cast = {REAL: float, INT: int, TEXT: str}
        cells = [[None if i >= len(v) or v[i] is None else cast.get(k, lambda x: x)(v[i]) for i in range(length)] for k, v in columns.values()]
        rows = [(*r, i) for i, r in enumerate(zip(*cells, strict=True))] if cells else []
        return Table(spark.createDataFrame(rows, T.StructType([*fields, T.StructField(RID, T.LongType(), False)])), list(columns), numbered=True)

    @staticmethod
    def from_columns(columns: Sequence[Column], spark: SparkSession | None = None) -> Table:
        """Columns side by side, by position; shorter ones are padded with nulls."""
        if not columns:
            return Table.from_lists({}, spark)
        out = columns[0].to_table()
        for c in columns[1:]:
            out = out._paste(c.to_table())
        return out

    @staticmethod
    def from_schema_and_columns(schema: Schema, columns: Sequence[Column], spark: SparkSession | None = None) -> Table:
        """Columns side by side under the names of a schema, whose kinds they have to have."""
        if [f.kind for f in schema.fields] != [c.kind for c in columns]:
            raise TypeError("the columns are not of the schema's kinds")
        return Table.from_columns([c.rename(f.name) for f, c in zip(schema.fields, columns, strict=True)], spark)

    @staticmethod
    def int_sequence(name: str, start: int, stop: int, step: int = 1, spark: SparkSession | None = None) -> Table:
        df = (spark or session()).range(start, stop, step).select(F.col("id").alias(name))
        place = F.expr(f"(`{name}` - {start}L) div {step}L")
        return Table(df.withColumn(RID, place), [name], numbered=True)

    @staticmethod
    def concat(tables: Sequence[Table]) -> Table:
        """Tables side by side; a name that is taken gets a suffix."""
        out = tables[0]
        for t in tables[1:]:
            out = out._paste(t)
        return out

    def __add__(self, other: Table) -> Table:
        return Table.concat([self, other])

    # What it is.

    @property
    def df(self) -> DataFrame:
        """The visible columns in row order."""
        return self._df.orderBy(*sorts(self._order)).select(*map(quoted, self._names))

    @property
    def rows(self) -> DataFrame:
        """The visible columns, in no particular order: for further relational work, without the sort."""
        return self._df.select(*map(quoted, self._names))

    @property
    def column_names(self) -> list[str]:
        return list(self._names)

    @property
    def column_count(self) -> int:
        return len(self._names)

    @property
    def row_count(self) -> int:
        return self._df.count()

    @property
    def kinds(self) -> dict[str, str]:
        return {n: kind_of(self._df.schema[n].dataType) for n in self._names}

    @property
    def schema(self) -> Schema:
        return Schema(tuple(Field(n, kind_of(self._df.schema[n].dataType), self._df.schema[n].nullable) for n in self._names))

    def null_counts(self) -> dict[str, int]:
        row = self._df.agg(*[F.count_if(quoted(n).isNull()).alias(f"n{i}") for i, n in enumerate(self._names)]).first() if self._names else ()
        return dict(zip(self._names, row, strict=True))

    def equals(self, other: Table) -> bool:
        """Same names, types and rows in the same order, nulls and NaN equal to themselves."""
        if self._names != other._names or self.kinds != other.kinds:
            return False
        a, b = self._numbered("__a"), other._numbered("__b")
        theirs = b.select("__b", *[quoted(n).alias(f"__v{i}") for i, n in enumerate(self._names)])
        same = F.col("__a").isNotNull() & F.col("__b").isNotNull()
        for i, n in enumerate(self._names):
            same = same & quoted(n).eqNullSafe(F.col(f"__v{i}"))
        return a.join(theirs, F.col("__a") == F.col("__b"), "full").filter(~same).isEmpty()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Table) and self.equals(other)

    __hash__ = object.__hash__

    def __repr__(self) -> str:
        return f"Table[{', '.join(f'{n}: {k}' for n, k in self.kinds.items())}]"

    def short_rep(self) -> str:
        return f"Table<{self.column_count}x{self.row_count}>"

    def to_list(self) -> list[tuple]:
        """All rows as tuples, on the driver; an error where there are more than MOST_LOCAL_ROWS."""
        rows = self.df.limit(MOST_LOCAL_ROWS + 1).collect()
        if len(rows) > MOST_LOCAL_ROWS:
            raise ValueError(f"the table has more than {MOST_LOCAL_ROWS} rows; write it to files instead")
        return [tuple(r) for r in rows]

    def to_columns(self) -> dict[str, list]:
        rows = self.to_list()
        return {n: [r[i] for r in rows] for i, n in enumerate(self._names)}

    def to_text(self, rows: int = 20) -> str:
        """The first and last rows/2 rows, with the number of rows left out between."""
        total = self.row_count
        if total <= rows:
            parts, gap = self.to_list(), None
        else:
            half = rows // 2
            parts, gap = self.slice(0, half).to_list() + self.slice(total - half, half).to_list(), half
        text = [list(self._names), *[["" if x is None else str(x) for x in r] for r in parts]]
        widths = [max(len(r[i]) for r in text) for i in range(len(self._names))]
        out = [" | ".join(x.rjust(w) for x, w in zip(r, widths, strict=True)) for r in text]
        if gap is not None:
            out.insert(1 + gap, f"... {total - 2 * gap} more rows ...")
        return "\n".join(out)

    def to_json(self) -> str:
        """A preview: header and columns of the first max(10, 1000 / columns) rows."""
        most = max(10, 1000 // max(1, self.column_count))
        rows = self.df.limit(most).collect()
        show = lambda x: str(x) if isinstance(x, datetime) else x
        return json.dumps({"header": list(self._names), "data": [[show(r[i]) for r in rows] for i in range(self.column_count)]})

    def explain(self) -> None:
        self.rows.explain("formatted")

    # Sinks.

    def csv_lines(self, header: bool = True, quote_all: bool = False, separator: str = ",", quote: str = '"') -> Iterator[str]:
        return csv.lines(self._df, self._order, self._names, [self.kinds[n] for n in self._names], header, quote_all, separator, quote)

    def to_csv(self, header: bool = True, quote_all: bool = False, separator: str = ",", quote: str = '"') -> str:
        return "\n".join(self.csv_lines(header, quote_all, separator, quote))

    def write_csv(self, path: str, header: bool = True, quote_all: bool = False, separator: str = ",", quote: str = '"') -> None:
        """One local file, records joined by line ends."""
        with open(path, "w", encoding="utf-8", newline="") as out:
            for i, line in enumerate(self.csv_lines(header, quote_all, separator, quote)):
                out.write(("\n" if i else "") + line)

    def write_csv_parts(self, path: str, header: bool = True, quote_all: bool = False, separator: str = ",", quote: str = '"') -> None:
        """A folder of part files, written by the executors: for tables that no driver should hold.

        In order of their names the parts are the text of ``write_csv``; only the first one has the header.
        """
        rows = self._df.orderBy(*sorts(self._order)).select(csv.rendered(self._df, self._names, [self.kinds[n] for n in self._names], quote_all, separator, quote).alias("value"))
        if header:
            head = self._df.sparkSession.createDataFrame([(csv.header_line(self._names, quote_all, separator, quote),)], "value string")
            rows = head.coalesce(1).unionByName(rows)
        rows.write.option("lineSep", "\n").text(path)

    def write_xlsx(self, path: str, header: bool = True) -> None:
        files.store(self._df.sparkSession, path, xlsx.workbook(self._names if header else None, self.to_list()))

    def write_feather(self, path: str) -> None:
        """One file, by way of the driver."""
        import io

        from pyarrow import feather

        out = io.BytesIO()
        feather.write_feather(self.df.toArrow(), out)
        files.store(self._df.sparkSession, path, out.getvalue())

    def write_feather_parts(self, path: str) -> None:
        """A folder of Feather files in row order, written by the executors: for tables that no driver should hold."""
        feather.write_parts(self.df, path)

    def write_parquet(self, path: str) -> None:
        """A folder of part files in row order."""
        self.df.write.parquet(path)

    def write(self, path: str) -> None:
        """By extension: csv, txt, xlsx, feather or parquet."""
        kind = os.path.splitext(path)[1].lower().lstrip(".")
        writers = {"csv": self.write_csv, "txt": self.write_csv, "xlsx": self.write_xlsx, "feather": self.write_feather, "parquet": self.write_parquet}
        if kind not in writers:
            raise ValueError(f"no format has the extension '{kind}'")
        writers[kind](path)

    # Columns.

    def _check(self, name: str) -> str:
        if name not in self._names:
            raise KeyError(f"Column '{name}' does not exist.")
        return name

    def _hidden(self) -> list[SparkColumn]:
        return [F.col(k.column) for k in self._order]

    def _with(self, df: DataFrame, names: Sequence[str] | None = None, fewer: bool = False) -> Table:
        """A table of ``df`` in this one's order; ``fewer`` if rows may be missing."""
        return Table(df, self._names if names is None else names, self._order, self._is_numbered and not fewer)

    def _numbered(self, position: str = "__pos") -> DataFrame:
        if self._is_numbered and self._order == ROW_ORDER:
            return self._df.withColumn(position, F.col(RID))
        return dense(self._df, self._order, position)

    def _by_id(self) -> Table:
        """The same rows with dense ids as their only key, if they have been sorted since."""
        return self if self._order == ROW_ORDER else Table(from_sorted(self._df, self._order), self._names, numbered=True)

    def column(self, name: str) -> Column:
        return Column(self, self._check(name), quoted(name))

    def column_at(self, index: int) -> Column:
        if not 0 <= index < self.column_count:
            raise IndexError(f"column index {index} is outside 0..{self.column_count - 1}")
        return self.column(self._names[index])

    def columns(self, names: Sequence[str]) -> Table:
        return self._with(self._df.select(*[quoted(self._check(n)) for n in names], *self._hidden()), list(names))

    def at(self, name: str) -> Table:
        return self.columns([name])

    def to_column(self) -> Column:
        if self.column_count != 1:
            raise ValueError(f"a table of {self.column_count} columns is not one column")
        return self.column_at(0)

    def _paste(self, other: Table) -> Table:
        names = csv.unique_names([*self._names, *other._names])
        renamed = dict(zip(other._names, names[self.column_count :], strict=True))
        a = self._numbered("__pos").select("__pos", *map(quoted, self._names))
        b = other._numbered("__pos").select("__pos", *[quoted(n).alias(m) for n, m in renamed.items()])
        return Table(a.join(b, "__pos", "full").withColumnRenamed("__pos", RID), names, numbered=True)

    def _place(self, names: Sequence[str], column: Column, name: str) -> Table:
        """``column`` as ``name`` among ``names``: computed in place, or pasted if it is another table's."""
        if column.table._df is self._df:
            made = [column.expr.alias(name) if n == name else quoted(n) for n in names]
            return self._with(self._df.select(*made, *self._hidden()), names)
        kept = self.columns([n for n in names if n != name])
        pasted = kept._paste(column.rename("__new").to_table())
        made = [quoted("__new").alias(name) if n == name else quoted(n) for n in names]
        return Table(pasted._df.select(*made, RID), names)

    def add_column(self, index: int, column: Column) -> Table:
        if not 0 <= index <= self.column_count:
            raise IndexError(f"column index {index} is outside 0..{self.column_count}")
        if column.name in self._names:
            raise ValueError(f"there is a column '{column.name}' already")
        return self._place([*self._names[:index], column.name, *self._names[index:]], column, column.name)

    def set_at(self, name: str, column: Column) -> Table:
        """Replaces the column, or appends it if there is none of that name."""
        return self._place(list(self._names) if name in self._names else [*self._names, name], column, name)

    replace_column = set_at

    def remove(self, name: str) -> Table:
        self._check(name)
        return self.columns([n for n in self._names if n != name])

    def remove_at(self, index: int) -> Table:
        return self.remove(self.column_at(index).name)

    def rename(self, name: str, new: str) -> Table:
        self._check(name)
        if new != name and new in self._names:
            raise ValueError(f"there is a column '{new}' already")
        made = [quoted(n).alias(new if n == name else n) for n in self._names]
        return self._with(self._df.select(*made, *self._hidden()), [new if n == name else n for n in self._names])

    def filter_columns(self, test: Callable[[Column], bool]) -> Table:
        return self.columns([n for n in self._names if test(self.column(n))])

    def each_column(self, f: Callable[[Column], Column]) -> Table:
        """``f`` of every column; columns that come from elsewhere, or in another length, are pasted and padded."""
        made = [f(self.column(n)) for n in self._names]
        if all(c.table._df is self._df for c in made):
            names = [c.name for c in made]
            return self._with(self._df.select(*[c.expr.alias(c.name) for c in made], *self._hidden()), names)
        return Table.from_columns(made)

    # Rows.

    def filter(self, predicate: Source) -> Table:
        """Rows where the predicate holds and no column that it mentions is null."""
        node = build_predicate(predicate)
        test = compile_predicate(node, self.kinds)
        return self._with(self._df.filter(present(node) & test), fewer=True)

    def each(self, expression: Source) -> Column:
        """The expression of every row; null where any column that it mentions is null."""
        node = build_value(expression)
        made, _ = compile_value(node, self.kinds)
        return Column(self, "Result", F.when(present(node), made))

    def each_to(self, name: str, expression: Source) -> Table:
        return self.set_at(name, self.each(expression))

    def drop_na(self, names: Sequence[str] | None = None) -> Table:
        names = self._names if names is None else [self._check(n) for n in names]
        return self._with(self._df.filter(nulls.all_present(names)), fewer=True)

    def drop_na_at(self, name: str) -> Table:
        return self.drop_na([name])

    def fill_na(self, value: Any) -> Table:
        """Nulls of every column become ``value`` in that column's type; a type that cannot hold it is an error."""
        kinds = self.kinds
        return self._with(self._df.withColumns({n: nulls.filled(n, kinds[n], value) for n in self._names}))

    def fill_na_at(self, name: Union[str, Mapping[str, Any]], value: Any = None) -> Table:
        """One column's nulls, or those of several by a mapping of name to value."""
        given = name if isinstance(name, Mapping) else {name: value}
        kinds = self.kinds
        return self._with(self._df.withColumns({self._check(n): nulls.filled(n, kinds[n], v) for n, v in given.items()}))

    def interpolate(self, names: Sequence[str] | None = None) -> Table:
        """Nulls become the line between their neighbours by position. Looks for nulls in text columns first."""
        chosen = list(self._names if names is None else [self._check(n) for n in names])
        kinds = self.kinds
        texts = [n for n in chosen if kinds[n] not in (INT, REAL, TIME)]
        if texts and not self._df.filter(~nulls.all_present(texts)).isEmpty():
            raise TypeError("only numbers and timestamps can be interpolated")
        lines = [n for n in chosen if n not in texts]
        if not lines:
            return self
        by_id = self._by_id()
        done = timeseries.interpolate(by_id._numbered(), kinds, lines).drop("__pos")
        return Table(done.select(*map(quoted, self._names), RID), self._names, numbered=by_id._is_numbered)

    def slice(self, begin: int, count: int) -> Table:
        """``count`` rows from ``begin``; counts the rows, as a slice beyond the end is an error."""
        total = self.row_count
        if count < 0 or not 0 <= begin <= total or begin + count > total:
            raise IndexError(f"rows {begin}..{begin + count} are outside 0..{total}")
        if begin == 0 and count <= MOST_TOP_ROWS:
            return self._with(self._df.orderBy(*sorts(self._order)).limit(count))
        rows = self._numbered().filter(F.col("__pos").between(begin, begin + count - 1))
        return Table(rows.drop(RID, *[k.column for k in self._order]).withColumnRenamed("__pos", RID), self._names)

    def take(self, count: int) -> Table:
        return self.slice(0, count)

    def drop(self, count: int) -> Table:
        total = self.row_count
        if not 0 <= count <= total:
            raise IndexError(f"cannot drop {count} of {total} rows")
        return self.slice(count, total - count)

    def sort_multiple(self, keys: Sequence[tuple[Union[str, Column], str, str]]) -> Table:
        """Stable sort by (column or name, direction, place of nulls). Columns need not be this table's, but
        have to have its length. It only changes the order keys; rows move when the order is used."""
        table, made = self, []
        for i, (c, direction, place) in enumerate(keys):
            if direction not in (ASCENDING, DESCENDING) or place not in (NULLS_BEFORE, NULLS_AFTER):
                raise ValueError(f"no sort order: {direction}, {place}")
            if isinstance(c, str):
                c = table.column(c)
            elif c.table._df is not self._df:
                table = table._paste(c.rename(f"__by{i}").to_table())
                c = table.column(f"__by{i}")
            made.append((c, Key(f"__s{uuid.uuid4().hex[:8]}", direction == DESCENDING, place == NULLS_BEFORE)))
        hidden = {k.column: (quoted(c.name) if c.table._df is not table._df else c.expr) for c, k in made}
        return Table(table._df.withColumns(hidden), self._names, (*[k for _, k in made], *table._order), table._is_numbered)

    def sort(self, name: str, direction: str = ASCENDING) -> Table:
        return self.sort_multiple([(name, direction, NULLS_AFTER)])

    sort_ascending = sort

    def sort_descending(self, name: str) -> Table:
        return self.sort(name, DESCENDING)

    def permute(self, indices: Sequence[int]) -> Table:
        """Rows by position; a position may come several times."""
        at = self._df.sparkSession.createDataFrame(list(enumerate(indices)), "__new long, __pos long")
        met = at.join(self._numbered(), "__pos", "left").drop("__pos", RID, *[k.column for k in self._order])
        return Table(met.withColumnRenamed("__new", RID), self._names)

    # Groups.

    def aggregate_by(self, key: str, wanted: group.Wanted) -> Table:
        """One row per key, null first, others by first occurrence; ``<col>_<fn>`` as doubles."""
        group.check_functions(self.kinds, wanted)
        made = group.aggregate_by(self._by_id()._df, self._check(key), wanted)
        names = [key, *[f"{n}_{f.value}" for n, fs in wanted for f in fs]]
        return self._grouped(made, key, names)

    def _grouped(self, made: DataFrame, key: str, names: Sequence[str], nulls_last: bool = False) -> Table:
        first = quoted(key).isNull() if nulls_last else quoted(key).isNotNull()
        return Table(made.withColumn("__named", first), names, (Key("__named"), Key("__first")))

    def aggregate(self, key: str, name: str, function: Aggregate) -> Table:
        return self.aggregate_by(key, [(name, [function])])

    def group_to_lists(self, key: str) -> Table:
        rest = [n for n in self._names if n != self._check(key)]
        return self._grouped(group.to_lists(self._by_id()._df, key, rest), key, [key, *rest])

    def count_values(self, name: str) -> Table:
        return self._grouped(group.count_values(self._by_id()._df, self._check(name)), "value", ["value", "count"], True)

    def describe(self) -> Table:
        """A row per numeric column."""
        names = [n for n, k in self.kinds.items() if k in (INT, REAL)]
        heads = ["column", "Mean", "Std dev", "Min", "Quantile 0.25", "Median", "Quantile 0.75", "Max"]
        if not names:
            return Table.from_lists({h: (TEXT if h == "column" else REAL, []) for h in heads}, self._df.sparkSession)
        return Table(stats.describe(self._df, names), heads, (Key("__first"),))

    def describe_column(self, name: str) -> Table:
        return self.column(name)._described([("mean", None), ("std dev", None), ("min", None), ("quantile", 0.25), ("median", None), ("quantile", 0.75), ("max", None)])

    def describe_na(self) -> Table:
        return Table(stats.describe_nulls(self._df, self._names), ["colname", "count", "ratio"], (Key("__first"),))

    def _numeric_names(self) -> list[str]:
        return [n for n, k in self.kinds.items() if k in (INT, REAL)]

    def correlations(self) -> Table:
        """The matrix of coefficients between numeric columns, in one aggregation."""
        names = self._numeric_names()
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        found = dict(zip(pairs, stats.correlations(self._df, pairs), strict=True))
        cell = lambda a, b: 1.0 if a == b else found.get((a, b), found.get((b, a)))
        return Table.from_lists({a: (REAL, [cell(a, b) for b in names]) for a in names}, self._df.sparkSession)

    def correlations_with(self, name: str) -> Table:
        """column, corr_with_<name> for every numeric column, ascending."""
        stats.numeric(self.kinds, self._check(name))
        names = self._numeric_names()
        found = stats.correlations(self._df, [(name, n) for n in names])
        rows = sorted(zip(names, [1.0 if n == name else c for n, c in zip(names, found, strict=True)], strict=True), key=lambda r: (r[1] != r[1], r[1]))
        return Table.from_lists({"column": (TEXT, [r[0] for r in rows]), f"corr_with_{name}": (REAL, [r[1] for r in rows])}, self._df.sparkSession)

    # Series and shape.

    def shift(self, name: str, steps: int) -> Table:
        """Adds ``<name>_shift_<steps>``: values pushed down, or up if negative."""
        out = f"{self._check(name)}_shift_{steps}"
        by_id = self._by_id()
        done = timeseries.shift(by_id._numbered(), name, steps, out)
        return Table(done.drop("__pos"), [*self._names, out], numbered=by_id._is_numbered)

    def rolling_multiple(self, key: str, interval: Union[timedelta, int, float], wanted: group.Wanted, peers: bool = False) -> Table:
        """key and ``<col>_<fn>`` over the rows of (t - interval, t], one row per row, in order of the key.

        Of rows of equal key, only earlier ones are in a row's window; with ``peers`` all are, as in SQL's range frames.
        """
        group.check_functions(self.kinds, wanted)
        return self._rolled(key, interval, {f"{n}_{f.value}": (n, f) for n, fs in wanted for f in fs}, peers)

    def _rolled(self, key: str, interval: Union[timedelta, int, float], functions: Mapping[str, tuple[str, Aggregate]], peers: bool) -> Table:
        kind = self.kinds[self._check(key)]
        if isinstance(interval, timedelta) != (kind == TIME) or kind not in (INT, REAL, TIME):
            raise TypeError(f"an interval of {interval!r} does not fit a key of type {kind}")
        span = interval // timedelta(microseconds=1) if kind == TIME else interval
        inner = {f"__o{i}": f for i, f in enumerate(functions.values())}
        done = timeseries.rolling(self._by_id()._df, key, kind, span, inner, peers)
        columns = [F.col(o).alias(n) for o, n in zip(inner, functions, strict=True)]
        return Table(done.select(quoted(key), *columns, quoted(key).alias("__key"), RID), [key, *functions], (Key("__key"), Key(RID)))

    def rolling(self, key: str, interval: Union[timedelta, int, float], name: str, function: Aggregate, peers: bool = False) -> Table:
        return self.rolling_multiple(key, interval, [(name, [function])], peers)

    def rolling_widths(self, key: str, interval: Union[timedelta, int, float], peers: bool = False) -> Table:
        """key and the number of rows in each row's window."""
        done = self._rolled(key, interval, {"width": (key, Aggregate.LENGTH)}, peers)
        return done._with(done._df.withColumn("width", F.col("width").cast("long")))

    def split_on(self, name: str, separators: str) -> Column:
        return self.column(name).split_on(separators)

    def ungroup(self, name: str, out: str | None = None) -> Table:
        """A row per element of a list column, in place of the list."""
        if self.kinds[self._check(name)] != LIST:
            raise TypeError(f"column '{name}' is no list")
        names = [out or name if n == name else n for n in self._names]
        rows = reshape.ungroup(self._df, quoted(name), "__element", "__place")
        made = [F.col("__element").alias(out or name) if n == name else quoted(n) for n in self._names]
        key = Key(f"__p{uuid.uuid4().hex[:8]}")
        return Table(rows.select(*made, *self._hidden(), F.col("__place").alias(key.column)), names, (*self._order, key))

    def ungroup_splitting_on(self, name: str, separators: str) -> Table:
        """A row per part of a text; the parts' column is ``<name>_splitted`` in the text's place."""
        lists = self.split_on(name, separators)
        made = [lists.expr.alias(lists.name) if n == name else quoted(n) for n in self._names]
        names = [lists.name if n == name else n for n in self._names]
        return self._with(self._df.select(*made, *self._hidden()), names).ungroup(lists.name)

    def histogram(self, name: str, bins: int = 10) -> Table:
        stats.numeric(self.kinds, self._check(name))
        return Table(charts.histogram(self._df, name, bins).withColumn("__bin", F.col("bin")), ["bin", "low", "high", "count"], (Key("__bin"),))

    def kde(self, name: str, points: int = 100) -> Table:
        """x, density of a numeric column."""
        stats.numeric(self.kinds, self._check(name))
        made = charts.kde(self._df, name, points)
        return Table.from_lists({"x": (REAL, [x for x, _ in made]), "density": (REAL, [y for _, y in made])}, self._df.sparkSession)

    def kde2(self, x: str, y: str, points: int = 50, bins: int = 100) -> Table:
        """x, y, density of two numeric columns on a grid."""
        for n in (x, y):
            stats.numeric(self.kinds, self._check(n))
        made = charts.kde2(self._df, x, y, points, bins)
        return Table.from_lists({n: (REAL, [r[i] for r in made]) for i, n in enumerate(("x", "y", "density"))}, self._df.sparkSession)

    def series_table(self, names: Sequence[str], most: int | None = None) -> Table:
        """Rows of the columns for a line, scatter or area chart: all, or with ``most`` a sample of about so many."""
        found = self.columns(names)
        return found._with(charts.series(found._df, most), fewer=most is not None)

    def series(self, names: Sequence[str], most: int | None = None) -> list[tuple]:
        """``series_table`` on the driver, in row order; an error where there are more than MOST_LOCAL_ROWS."""
        return self.series_table(names, most).to_list()

    # Learning.

    def one_hot(self, name: str) -> Table:
        """Replaces nothing: a table of one 0/1 column per value of a text column."""
        if self.kinds[self._check(name)] != TEXT:
            raise TypeError(f"column '{name}' is no text")
        by_id = self._by_id()
        made = learn.one_hot(by_id._df, name, F.col(RID))
        return Table(by_id._df.select(*[c.alias(n) for n, c in made.items()], RID), list(made))

    def fit(self, model: Union[learn.LinearRegression, learn.LogisticRegression], names: Sequence[str], target: str) -> learn.Fitted:
        return model.fit(self._df.select(*map(quoted, self._names)), self.kinds, [self._check(n) for n in names], self._check(target))

    def predict(self, fitted: learn.Fitted) -> Table:
        """Adds Predictions."""
        return self._with(fitted.predictions(self._df, self.kinds), [*self._names, "Predictions"])

    def score(self, fitted: learn.Fitted, target: str) -> float:
        return fitted.score(self._df, self.kinds, self._check(target))

    def confusion_matrix(self, truth: str, guess: str) -> Table:
        made = learn.confusion(self._df, self._check(truth), self._check(guess))
        made = made.withColumn("__t", F.col("truth")).withColumn("__g", F.col("guess"))
        return Table(made, ["truth", "guess", "count"], (Key("__t"), Key("__g")))

    def to_numpy(self):
        """All numeric columns as a matrix on the driver, nulls as NaN; ``Column.map_numpy`` keeps arrays on the executors."""
        import numpy as np

        found = self.columns(self._numeric_names())
        return np.array([np.asarray(c.cast("double")) for c in found.df.toArrow().columns], float).reshape(found.column_count, -1).T


def _xlsx_value(x: Any, kind: str | None) -> Any:
    if kind in (None, TEXT):
        return "" if x is None else str(x)
    if x is None:
        return None
    if kind == TIME:
        return x if isinstance(x, datetime) else None
    try:
        return int(x) if kind == INT else float(x)
    except (TypeError, ValueError):
        return None


class Column:
    """A named expression over a table's rows."""

    def __init__(self, table: Table, name: str, expr: SparkColumn):
        self.table, self.name, self.expr = table, name, expr

    @staticmethod
    def from_list(name: str, kind: str, values: Sequence[Any], spark: SparkSession | None = None) -> Column:
        return Table.from_lists({name: (kind, values)}, spark).column(name)

    @staticmethod
    def from_numpy(name: str, values: Any, spark: SparkSession | None = None) -> Column:
        """Reals of an array on the driver; NaN becomes null."""
        import numpy as np
        import pyarrow as pa

        values = pa.array(np.asarray(values, float), from_pandas=True)
        df = (spark or session()).createDataFrame(pa.table({name: values, RID: pa.array(np.arange(len(values)))}))
        return Table(df, [name], numbered=True).column(name)

    def to_numpy(self):
        """Values as reals on the driver, null as NaN."""
        return self.to_table().to_numpy()[:, 0]

    def map_numpy(self, name: str, f: Callable[[Any], Any]) -> Column:
        """f of the values as arrays of reals (null as NaN), each of a batch of rows, on the executors; NaN of its
        results, which have to be as many, becomes null. For columns of any size, as no array goes to the driver."""
        if not self.is_numeric:
            raise TypeError(f"column '{self.name}' of type {self.kind} is no array of numbers")

        def mapped(x):
            import numpy as np
            import pyarrow as pa

            return pa.array(np.asarray(f(x.to_numpy(zero_copy_only=False)), float), from_pandas=True)

        mapped = F.arrow_udf(mapped, "double", F.ArrowUDFType.SCALAR)
        return Column(self.table, name, mapped(self.expr.cast("double")))

    @staticmethod
    def index(length: int, spark: SparkSession | None = None) -> Column:
        return Table.int_sequence("index", 0, length, spark=spark).column("index")

    def to_table(self) -> Table:
        hidden = [F.col(k.column) for k in self.table._order]
        return Table(self.table._df.select(self.expr.alias(self.name), *hidden), [self.name], self.table._order, self.table._is_numbered)

    @property
    def kind(self) -> str:
        return kind_of(self.table._df.select(self.expr.alias("c")).schema[0].dataType)

    @property
    def is_numeric(self) -> bool:
        return self.kind in (INT, REAL)

    @property
    def length(self) -> int:
        return self.table.row_count

    def null_count(self) -> int:
        return self.table._df.agg(F.count_if(self.expr.isNull())).first()[0]

    count_missing = null_count

    def rename(self, name: str) -> Column:
        return Column(self.table, name, self.expr)

    def to_list(self) -> list:
        return [r[0] for r in self.to_table().to_list()]

    def to_text(self) -> str:
        return self.to_table().to_text()

    def to_json(self) -> str:
        return json.dumps({"header": [self.name], "data": [[str(x) if isinstance(x, datetime) else x for x in (r[0] for r in self.to_table().df.limit(1000).collect())]]})

    def slice(self, begin: int, count: int) -> Column:
        return self.to_table().slice(begin, count).to_column()

    def count_values(self) -> Table:
        return self.to_table().count_values(self.name)

    def _described(self, wanted: Sequence[tuple[str, float | None]]) -> Table:
        """One row of statistics; quantiles and the median count the values first."""
        if not self.is_numeric:
            raise TypeError(f"column '{self.name}' of type {self.kind} has no statistics")
        rows, c = self.table._df.select(self.expr.alias("c")), quoted("c")
        shares = [0.5 if n == "median" else q for n, q in wanted if n == "median" or q is not None]
        ranked = iter(quantiles(rows, c, shares, stats.valid_counts(rows, ["c"])[0]) if shares else ())
        names = [n if q is None else f"quantile {q:f}" for n, q in wanted]
        made = [(next(ranked) if n == "median" or q is not None else stats.statistic(n, c)).alias(name) for (n, q), name in zip(wanted, names, strict=True)]
        return Table(rows.agg(*made).withColumn(RID, F.lit(0).cast("long")), names)

    def stat(self, name: str) -> Column:
        """min, max, mean, median, std dev, variance, sum or RSI as a column of one row."""
        return self._described([(name, None)]).to_column()

    def quantile(self, q: float) -> Column:
        """Hazen's quantile as a column of one row; counts the values first, and beyond ranks.AT_ONCE of them narrows
        the quantile's bracket in a few passes."""
        return self._described([("quantile", q)]).to_column()

    def value(self, name: str) -> Any:
        return self.stat(name).to_list()[0]

    def min(self) -> Column:
        return self.stat("min")

    def max(self) -> Column:
        return self.stat("max")

    def mean(self) -> Column:
        return self.stat("mean")

    def median(self) -> Column:
        return self.stat("median")

    def std(self) -> Column:
        return self.stat("std dev")

    def var(self) -> Column:
        return self.stat("variance")

    def sum(self) -> Column:
        return self.stat("sum")

    def rsi(self) -> Column:
        return self.stat("RSI")

    def describe(self) -> Table:
        return self._described([(n, None) for n in ("mean", "std dev", "min", "max")])

    def min_value(self) -> Any:
        return self.value("min")

    def max_value(self) -> Any:
        return self.value("max")

    def mean_value(self) -> Any:
        return self.value("mean")

    def median_value(self) -> Any:
        return self.value("median")

    def std_value(self) -> Any:
        return self.value("std dev")

    def var_value(self) -> Any:
        return self.value("variance")

    def sum_value(self) -> Any:
        return self.value("sum")

    def correlation(self, other: Column) -> float:
        """Pearson's coefficient over rows where both are valid."""
        both = Table.from_columns([self.rename("x"), other.rename("y")]) if other.table._df is not self.table._df else Table(self.table._df.select(self.expr.alias("x"), other.expr.alias("y"), *self.table._hidden()), ["x", "y"], self.table._order)
        for n in ("x", "y"):
            stats.numeric(both.kinds, n)
        return stats.correlations(both._df, [("x", "y")])[0]

    def auto_corr(self, lag: int) -> float:
        """Correlation with the column shifted by ``lag``; NaN where no two rows meet."""
        shifted = self.rename("x").to_table().shift("x", lag)
        return stats.correlations(shifted._df, [("x", f"x_shift_{lag}")])[0]

    def shift(self, steps: int) -> Column:
        moved = self.to_table().shift(self.name, steps)
        return moved.column(f"{self.name}_shift_{steps}").rename(self.name)

    def interpolate(self) -> Column:
        return self.to_table().interpolate().to_column()

    def split_on(self, separators: str) -> Column:
        if self.kind != TEXT:
            raise TypeError(f"column '{self.name}' is no text")
        return Column(self.table, f"{self.name}_splitted", reshape.split_on(self.expr, separators))

    def flatten(self) -> Column:
        """All elements of a list column, one after the other."""
        return self.to_table().ungroup(self.name).to_column()

    def map(self, name: str, kind: str, f: Callable[[Any], Any]) -> Column:
        """Any Python function of each value (None where null), in Arrow batches: for what expressions cannot say."""
        result = spark_type(kind)

        @F.udf(returnType=result, useArrow=True)
        def mapped(x):
            return f(x)

        return Column(self.table, name, mapped(self.expr))


class ColumnBuilder:
    """Collects values of one kind, None among them, into a column."""

    def __init__(self, name: str, kind: str):
        self.name, self.kind, self.values = name, kind, []
        spark_type(kind)

    def append(self, value: Any) -> ColumnBuilder:
        self.values.append(value)
        return self

    def append_many(self, values: Sequence[Any]) -> ColumnBuilder:
        self.values.extend(values)
        return self

    def finish(self, spark: SparkSession | None = None) -> Column:
        return Column.from_list(self.name, self.kind, self.values, spark)
