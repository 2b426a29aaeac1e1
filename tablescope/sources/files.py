"""File readers and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.results import cell_text
from tablescope.sources.shared import cut_lineage

DELIMITERS = (",", ";", "\t", "|")


def read_file(spark: SparkSession, kind: str, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """csv, json, ndjson, parquet, text or blob. Give a schema for big csv and json: inference reads them twice."""
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "text":
        return spark.read.text(path)
    if kind == "blob":
        return spark.read.format("binaryFile").load(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).option("escape", '"').csv(path)
    return reader.option("multiLine", kind == "json").json(path)


def register_result(df: DataFrame, result_id: str) -> DataFrame:
    """Make a result queryable under its id; one without rows or types has text columns."""
    typed = df.select(
        *[F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`")
          for f in df.schema.fields]
    )
    typed.createOrReplaceTempView(result_id)
    return typed


def register_json_rows(spark: SparkSession, path: str, columns: list[str], result_id: str) -> DataFrame:
    """Rows stored as JSON lines, types inferred over all of them; without rows every column is text."""
    df = spark.read.option("samplingRatio", 1.0).json(path)
    if not df.columns:
        df = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    else:
        missing = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
        df = df.withColumns(missing).select(*columns)
    return register_result(df, result_id)


def save_result(df: DataFrame, path: str, kind: str) -> DataFrame:
    """Write csv (with header) or parquet and return the rows; the query runs once."""
    if not path.endswith(f".{kind}"):
        raise ValueError(f"a {kind} result needs a path ending in .{kind}")
    if kind == "parquet":
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    if kind != "csv":
        raise ValueError(f"unknown format {kind!r}")
    rows = cut_lineage(df, "result")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return rows


FORMULA_START = r"^[=+\-@\t\r]"


def neutralise(df: DataFrame, kind: str = "csv") -> DataFrame:
    """Display text that no spreadsheet runs as a formula; TSV cells lose tabs and line breaks."""
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        safe = F.when(c.rlike(FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)
        out.append((F.regexp_replace(safe, r"[\t\n]", " ") if kind == "tsv" else safe).alias(name))
    return df.select(*out)


def export_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Spreadsheet-safe export; quoting only where a cell needs it."""
    cells = neutralise(cell_text(df), kind)
    header = neutralise(df.sparkSession.createDataFrame([tuple(df.columns)], [f"c{i}" for i in range(len(df.columns))]), kind)
    # one row: the names themselves
    names = list(header.first())
    writer = cells.toDF(*names).write.option("header", True).option("escape", '"')
    if kind == "tsv":
        writer.option("sep", "\t").option("quote", "\u0000").csv(path)
    else:
        writer.csv(path)


def detect_delimiter(record: str) -> str:
    """The candidate seen most often outside quotes; the earlier one on a tie."""
    outside = "".join(record.removeprefix("\ufeff").split('"')[::2])
    return max(DELIMITERS, key=lambda d: (outside.count(d), -DELIMITERS.index(d)))


def column_letters(width: int) -> list[str]:
    """Spreadsheet letters: A..Z, AA, AB ..."""
    names = []
    for i in range(width):
        name = ""
        i += 1
        while i:
            i, digit = divmod(i - 1, 26)
            name = chr(65 + digit) + name
        names.append(name)
    return names


def header_names(cells: list[str | None], width: int) -> list[str] | None:
    """Names from a first row that is a header: full width, no blank cell; a repeat gets `` (2)``."""
    if len(cells) != width or any(c is None or not str(c).strip() for c in cells):
        return None
    names: list[str] = []
    for cell in cells:
        label = str(cell).strip()
        name, suffix = label, 2
        while name in names:
            name, suffix = f"{label} ({suffix})", suffix + 1
        names.append(name)
    return names


def quoted_records(spark: SparkSession, path: str, quoted: bool = True) -> DataFrame:
    """``file, number, record``: the records of delimited files, numbered from 0 in each; blank ones are left out.

    A line break belongs to its record where the quotes before it in the file are odd in number. Every split of the
    scan is counted on its own; sums over the splits of a file then tell whether a split starts inside quotes and how many
    records start before it, so that a second scan cuts records in all splits at once. Records that run over the border of
    a split are put together from their pieces. Without ``quoted`` every line is a record. Line breaks inside quotes
    are read as ``\\n``.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Stretches of lines of one split in their order, with the quotes in each line and whether it is blank."""
        for batch in batches:
            files, places = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            borders = [i for i in range(1, len(files)) if (files[i], places[i]) != (files[i - 1], places[i - 1])]
            for begin, end in zip([0, *borders], [*borders, len(files)]):
                if end > begin:
                    part = batch.slice(begin, end - begin)
                    quotes = pc.count_substring(part.column(0), '"').to_numpy(zero_copy_only=False) if quoted else np.zeros(end - begin, int)
                    blank = pc.equal(pc.ascii_trim_whitespace(part.column(0)), "").to_numpy(zero_copy_only=False)
                    yield (files[begin], places[begin]), part, quotes, blank

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, totals = None, [0, 0, 0]
        for key, _, quotes, blank in runs(batches):
            if key != split:
                if split:
                    yield as_row(split, totals)
                split, totals = key, [0, 0, 0]
            before = (totals[0] + np.cumsum(quotes) - quotes) % 2
            totals = [totals[0] + int(quotes.sum()), *(totals[1 + k] + int(((before == k) & ~blank).sum()) for k in (0, 1))]
        if split:
            yield as_row(split, totals)

    def as_row(split: tuple, totals: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("file", "at", "quotes", "even", "odd"), (*split, *totals)))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, odd, number, held = None, 0, 0, []
        for key, part, quotes, blank in runs(batches):
            if key != split:
                if held:
                    yield as_records(split, [number - 1], ["\n".join(held)], [False])
                split, held = key, []
                odd, number = part.column(3)[0].as_py(), part.column(4)[0].as_py()
                # lines up to the end of these quotes belong to a record of an earlier split
                piece = bool(odd)
            after = (odd + np.cumsum(quotes)) % 2
            before = np.concatenate([[odd], after[:-1]])
            alone = (before == 0) & (after == 0) & ~blank
            starts = number + np.cumsum((before == 0) & ~blank)
            values = part.column(0)
            single = as_records(key, starts[alone] - 1, values.filter(pa.array(alone)), np.ones(int(alone.sum()), bool))
            done = []
            # the lines of records that hold line breaks
            for i in np.flatnonzero((before == 1) | (after == 1)).tolist():
                held.append(values[i].as_py())
                if after[i] == 0:
                    done.append((int(starts[i]) - 1, "\n".join(held), not piece))
                    held, piece = [], False
            if done:
                both = pa.Table.from_batches([single, as_records(key, *zip(*done))])
                yield from both.sort_by("number").combine_chunks().to_batches()
            else:
                yield single
            odd, number = int(after[-1]), int(starts[-1])
        if held:
            yield as_records(split, [number - 1], ["\n".join(held)], [False])

    def as_records(split: tuple, numbers, records, whole) -> pa.RecordBatch:
        count = len(numbers)
        return pa.RecordBatch.from_arrays(
            [pa.array([split[0]] * count, pa.string()), pa.array([split[1]] * count, pa.int64()), pa.array(numbers, pa.int64()),
             pa.array(records, pa.string()), pa.array(whole, pa.bool_())],
            ["file", "at", "number", "record", "whole"],
        )

    counted = lines.mapInArrow(count, "file string, at long, quotes long, even long, odd long")
    counted = cut_lineage(counted, "record-borders")
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2
    borders = counted.withColumn("inside", inside)
    starts = F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd"))
    borders = borders.withColumn("starts", starts).select(
        "file", "at", "inside", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("number"),
        ((F.col("inside") == 1) | ((F.col("inside") + F.col("quotes")) % 2 == 1)).alias("open"),
    )
    shape = "file string, at long, number long, record string, whole boolean"

    def records_of(some: DataFrame) -> DataFrame:
        # one row per split of the scan, as the driver lists them anyway; a broadcast keeps the lines in their order
        known = lines.join(F.broadcast(some), ["file", "at"]).select("value", "file", "at", "inside", "number")
        return known.mapInArrow(cut, shape)

    whole = records_of(borders.drop("open")).filter("whole").select("file", "number", "record")
    # the other splits hold whole records only
    pieces = records_of(borders.filter("open").drop("open")).filter("NOT whole")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "record"))), lambda p: p["record"])
    joined = pieces.groupBy("file", "number").agg(F.array_join(texts, "\n").alias("record"))
    return whole.unionByName(joined)


def cells_in(record: Column, delimiter: str) -> Column:
    """The cells of a record: its delimiters outside quotes, and one."""
    bare = F.regexp_replace(record, r'"[^"]*("|\z)', "")  # the last quotes may be open
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


def read_delimited(
    spark: SparkSession, path: str, delimiter: str | None = None, max_rows: int | None = None, multi_line: bool = True
) -> DataFrame:
    """A csv-family file, or a folder of them, as text columns: delimiter found, byte-order mark dropped.

    Quoted cells may hold delimiters, doubled quotes and line breaks; one large file is still read by many tasks.
    ``multi_line=False`` takes every line for a record. The table is as wide as its widest record; shorter ones end in
    nulls. The first record of the first file names the columns if it has that width and no blank cell, else letters
    do. Such a header is dropped from each file that starts with the same record, and from no other.
    ``max_rows`` keeps the first ones. No records give no columns.
    """
    records = quoted_records(spark, path, multi_line)
    records = records.withColumn("record", F.regexp_replace("record", "^\ufeff", ""))
    top = records.filter("number = 0").agg(F.min_by("record", "file")).first()[0]
    if top is None:
        return spark.createDataFrame([], T.StructType([]))
    delimiter = delimiter or detect_delimiter(top)
    width = records.agg(F.max(cells_in(F.col("record"), delimiter))).first()[0]
    letters = column_letters(width)
    options = {"sep": delimiter, "quote": '"', "escape": '"'}

    def parsed(rows: DataFrame) -> DataFrame:
        shape = ", ".join(f"`{c}` string" for c in letters)
        return rows.select(F.from_csv("record", shape, options).alias("_cells")).select("_cells.*")

    cells = list(parsed(spark.createDataFrame([(top,)], "record string")).first())
    names = header_names(cells, width)
    if names:
        records = records.filter((F.col("number") > 0) | (F.col("record") != top))
    if max_rows is not None:
        records = records.orderBy("file", "number").limit(max_rows)
    return parsed(records).toDF(*(names or letters))
