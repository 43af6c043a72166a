"""The CSV dialect: tokenizing, type deduction, rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compile import quoted
from ..plans.order import BLOCK, RID, checked_broadcast, sorts, stage
from ..schema import INT, REAL, TEXT, TIME

#: Records that type deduction looks at, the header included.
DEDUCED_RECORDS = 50
INT_TEXT = r"\A-?[0-9]+\z"
REAL_TEXT = r"\A-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DATE_TEXT = r"\A[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}\z"


class CsvError(ValueError):
    """Text that is not in the dialect."""


def records(text: str, separator: str = ",", quote: str = '"', first: bool = True) -> Iterator[list[str]]:
    """Cells of each record.

    A cell is quoted if its first character is a quote; a doubled quote inside is one quote. What follows a
    closing quote other than a separator or line end begins a new cell, its first character swallowed. Blank
    lines are records of one empty cell; a line end at the end of the text begins no record. A byte order mark
    is left out where the text is the ``first`` of a file.
    """
    text = text.removeprefix("﻿") if first else text
    at, end = 0, len(text)
    plain = re.compile(f"[^{re.escape(separator)}\n]*")
    while at < end:
        row: list[str] = []
        while True:
            if at < end and text[at] == quote:
                parts, at = [], at + 1
                while True:
                    stop = text.find(quote, at)
                    if stop < 0:
                        raise CsvError("a quoted field is not closed")
                    parts.append(text[at:stop])
                    at = stop + 1
                    if at < end and text[at] == quote:
                        parts.append(quote)
                        at += 1
                    else:
                        break
                row.append("".join(parts))
                if text.startswith("\r\n", at):
                    at += 1
            else:
                cell = plain.match(text, at)
                at = cell.end()
                cut = at < end and text[at] == "\n" or at == end
                row.append(cell[0][:-1] if cut and cell[0].endswith("\r") else cell[0])
            if at >= end or text[at] == "\n":
                at += 1
                break
            at += 1
        yield row


def _is_date(cell: str) -> bool:
    from datetime import date

    if not re.match(DATE_TEXT.replace(r"\z", r"\Z"), cell):
        return False
    try:
        date(*map(int, cell.split("-")))
    except ValueError:
        return False
    return True


def cell_kind(cell: str) -> str | None:
    """Kind of a cell; None for a missing one."""
    if not cell:
        return None
    if _is_date(cell):
        return TIME
    if re.match(INT_TEXT.replace(r"\z", r"\Z"), cell) and -(2**63) <= int(cell) < 2**63:
        return INT
    return REAL if re.match(REAL_TEXT.replace(r"\z", r"\Z"), cell) else TEXT


def column_kind(cells: Sequence[str]) -> str:
    """A timestamp beside anything else is text; otherwise the widest of text, real, int; text if all are missing."""
    kinds = {cell_kind(c) for c in cells} - {None}
    if kinds == {TIME}:
        return TIME
    if TIME in kinds or TEXT in kinds or not kinds:
        return TEXT
    return REAL if REAL in kinds else INT


def typed(cell: Column, kind: str) -> Column:
    """The cell as ``kind``; missing cells and those that are not written as the kind are null."""
    cell = F.when(cell != "", cell)
    if kind == TEXT:
        return cell
    if kind == INT:
        return F.when(cell.rlike(INT_TEXT), cell.try_cast("long"))
    if kind == REAL:
        return F.when(cell.rlike(REAL_TEXT), cell.try_cast("double"))
    if kind == TIME:
        return F.when(cell.rlike(DATE_TEXT), cell.try_cast("date").cast("timestamp_ntz"))
    raise TypeError(f"no CSV cell is a {kind}")


def header_names(policy: str | Sequence[str], first: Sequence[str] | None, width: int) -> list[str]:
    """Names by policy: "read" (first record), "generated", or given ones."""
    if policy == "read":
        got = list(first or [])
        return [got[i] if i < len(got) and got[i] else f"MISSING_{i}" for i in range(width)]
    given = [] if policy == "generated" else list(policy)
    return [given[i] if i < len(given) else f"col{i}" for i in range(width)]


def unique_names(names: Sequence[str]) -> list[str]:
    """Later duplicates get a suffix, as columns are addressed by name."""
    out: list[str] = []
    for n in names:
        fresh, k = n, 1
        while fresh in out:
            fresh, k = f"{n}_{k}", k + 1
        out.append(fresh)
    return out


def _records_of_lines(separator: str, quote: str):
    """Cells of lines that are each a record; the line numbered 0 may have a byte order mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            cells = [next(records(t + "\n", separator, quote, i == 0)) for i, t in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cells, pa.list_(pa.string()))], names=[RID, "cells"])

    return run


def _open_ends(separator: str, quote: str):
    """Of lines that are numbered: whether a quoted field is open at their end if they begin outside of one, and within."""

    def is_open(text: str, first: bool) -> bool:
        try:
            next(records(text + "\n", separator, quote, first))
        except CsvError:
            return True
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            ends = [(is_open(t, i == 0), is_open(quote + t, False)) for i, t in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([e[k] for e in ends], pa.bool_()) for k in (0, 1)]], names=[RID, "out", "in"])

    return run


def _whole_records(lines: DataFrame, ends: DataFrame) -> DataFrame:
    """(RID, value) of every record, from lines of which some end within a quoted field.

    A line sets, turns or keeps whether a quoted field is open. What blocks of lines do is put together on the driver,
    a row a block, so each block knows how it begins and all of them are walked in parallel; then lines meet by their
    record's number. Numbers pack well in files, so Spark would broadcast far more rows than it takes them for.
    """
    spark, block = lines.sparkSession, F.expr(f"{RID} div {BLOCK}")
    narrow = lines.select(RID).join(ends.hint("merge"), RID, "left").select(RID, block.alias("__block"), F.when(F.col("out") == F.col("in"), F.col("out")).alias("__set"), F.coalesce((F.col("out") & ~F.col("in")).cast("int"), F.lit(0)).alias("__turn"))
    upto = Window.partitionBy("__block").orderBy(RID).rowsBetween(Window.unboundedPreceding, 0)
    walked = narrow.withColumn("__turns", F.sum("__turn").over(upto))
    walked = stage(walked.withColumn("__last", F.when(F.col("__set").isNotNull(), F.struct(F.col("__set").alias("open"), F.col("__turns").alias("at")))).drop("__set"), "csv-quotes")
    is_open, begins = False, []
    for r in walked.groupBy("__block").agg(F.max_by("__last", F.when(F.col("__last").isNotNull(), F.col(RID))).alias("last"), F.sum("__turn").alias("turns")).orderBy("__block").collect():
        begins.append((r["__block"], is_open))
        is_open = (r.last.open if r.last else is_open) ^ bool((r.turns - (r.last.at if r.last else 0)) % 2)
    if is_open:
        raise CsvError("a quoted field is not closed")
    begun = spark.createDataFrame(begins, "__block long, __open boolean")
    before = Window.partitionBy("__block").orderBy(RID).rowsBetween(Window.unboundedPreceding, -1)
    met = walked.join(checked_broadcast(begun), "__block").withColumn("__last", F.last("__last", True).over(before))
    odd = (F.col("__turns") - F.col("__turn") - F.coalesce("__last.at", F.lit(0))) % 2 == 1
    begin = (F.coalesce("__last.open", "__open") == odd).cast("int")
    met = stage(met.select(RID, "__block", begin.alias("__begin")), "csv-records")
    sizes = met.groupBy("__block").agg(F.sum("__begin").alias("__n"))
    offsets = checked_broadcast(sizes.select("__block", (F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before")))
    numbered = met.join(offsets, "__block").select(RID, (F.col("__before") + F.sum("__begin").over(upto) - 1).alias("__record"))
    gathered = lines.join(numbered.hint("merge"), RID).groupBy("__record").agg(F.array_sort(F.collect_list(F.struct(RID, "value"))).alias("__lines"))
    return gathered.select(F.col("__record").alias(RID), F.array_join(F.transform("__lines", lambda x: x["value"]), "\n").alias("value"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(RID, value) of every line: files by name, splits by their start, lines as they come.

    A split's lines are read one after the other by one task, so their ids run without gaps; one count per
    split gives each its first number.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    lines = stage(lines, "csv-lines")
    splits = lines.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    splits = checked_broadcast(splits.withColumn("__before", before).drop("__n"))
    return lines.join(splits, ["__file", "__start"]).select((F.col("__before") + F.col("__at") - F.col("__first")).alias(RID), "value")


def frame(cells: DataFrame, header: str | Sequence[str] = "read", types: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Typed columns of (RID, cells): as many as the longest record has, types given or deduced, and their names."""
    width = cells.agg(F.max(F.size("cells"))).first()[0] or 0
    seen = [r.cells for r in cells.filter(F.col(RID) < DEDUCED_RECORDS).orderBy(RID).select("cells").collect()]
    first, rest = (seen[0] if seen else [], seen[1:]) if header == "read" else (None, seen)
    names = unique_names(header_names(header, first, width))
    kinds = [types[i] if i < len(types) else column_kind([r[i] if i < len(r) else "" for r in rest]) for i in range(width)]
    rows = cells.filter(F.col(RID) > 0).withColumn(RID, F.col(RID) - 1) if header == "read" else cells
    return rows.select(RID, *[typed(F.get("cells", F.lit(i)), k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]), names


def read_file(spark: SparkSession, path: str, header: str | Sequence[str] = "read", types: Sequence[str] = (), separator: str = ",", quote: str = '"') -> tuple[DataFrame, list[str]]:
    """One CSV file, or a folder of parts that follow each other by name, in the exact dialect.

    Lines are records and are tokenized anywhere, if none ends within a quoted field: the first line begins outside of
    quotes, and each that ends outside lets the next begin so. Else, lines are first put together to records. The end
    of a file ends a line. Cells are staged, so text is tokenized once.
    """
    lines = _numbered_lines(spark, path)
    ends = lines.filter(F.contains("value", F.lit(quote))).mapInArrow(_open_ends(separator, quote), f"{RID} long, out boolean, in boolean")
    ends = stage(ends.filter("out OR NOT in"), "csv-ends")
    whole = lines if ends.filter("out").isEmpty() else _whole_records(lines, ends)
    cells = whole.mapInArrow(_records_of_lines(separator, quote), f"{RID} long, cells array<string>")
    return frame(stage(cells, "csv-cells"), header, types)


def read_text(spark: SparkSession, text: str, header: str | Sequence[str] = "read", types: Sequence[str] = (), separator: str = ",", quote: str = '"') -> tuple[DataFrame, list[str]]:
    rows = [(i, r) for i, r in enumerate(records(text, separator, quote))]
    return frame(spark.createDataFrame(rows, f"{RID} long, cells array<string>"), header, types)


def rendered(df: DataFrame, names: Sequence[str], kinds: Sequence[str], quote_all: bool, separator: str = ",", quote: str = '"') -> Column:
    """One record as text: doubles with six decimals, timestamps as dates, nulls empty and never quoted."""
    cells = []
    for n, k in zip(names, kinds, strict=True):
        c = quoted(n)
        if k == REAL:
            s = F.when(F.isnan(c), F.lit("nan")).when(F.abs(c) == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf"))).when(c.isNotNull(), F.format_string("%.6f", c))
        else:
            s = F.date_format(c, "yyyy-MM-dd") if k == TIME else c.cast("string")
        doubled = F.concat(F.lit(quote), F.replace(s, F.lit(quote), F.lit(2 * quote)), F.lit(quote))
        needed = F.lit(True) if quote_all else s.rlike(f"\\A[ \\t]|[ \\t]\\z|[{re.escape(separator + quote)}\\n]")
        cells.append(F.coalesce(F.when(needed, doubled).otherwise(s), F.lit("")))
    return F.concat_ws(separator, *cells) if cells else F.lit("")


def header_line(names: Sequence[str], quote_all: bool, separator: str = ",", quote: str = '"') -> str:
    need = lambda n: quote_all or n[:1] in " \t" or n[-1:] in " \t" or any(x in n for x in (separator, "\n", quote))
    return separator.join(quote + n.replace(quote, 2 * quote) + quote if n and need(n) else n for n in names)


def lines(df: DataFrame, order, names: Sequence[str], kinds: Sequence[str], header: bool, quote_all: bool, separator: str = ",", quote: str = '"') -> Iterator[str]:
    """Header and records in row order, fetched partition by partition."""
    if header:
        yield header_line(names, quote_all, separator, quote)
    for r in df.orderBy(*sorts(order)).select(rendered(df, names, kinds, quote_all, separator, quote).alias("line")).toLocalIterator():
        yield r.line
