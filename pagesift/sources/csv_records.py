"""CSV files whose quoted cells hold line feeds, read in parallel.

A reader that cuts a file into blocks does not know whether a block begins inside of a quoted
cell. What a line does to that state is one of four functions of it: leave it, swap it, or set it to
inside or outside, told by two patterns. Functions follow each other: a window over the lines
of a block gives that of every prefix, one over the blocks of a file the state that each
block begins in. A line that begins outside begins a record, and records are numbered
by running counts in the same two steps. Only records of several lines are put together.

A quote counts where a cell begins with it, as in the reader for single lines; two quotes in a
quoted cell are one. Lines end in a line feed, a carriage return or both, and inside of a cell
they are one line feed. Lines without characters outside of a cell are skipped. A cell
that is never closed reaches to the end of its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.sources.staging import new_folder, shuffles_removed, stage

_IN = r'[^"]*+(?:""[^"]*+)*+'  # inside of a quoted cell, up to its end
_CELL = rf'(?:[^",][^,]*+|"{_IN}"[^,]*+)?+'
_OUT_TO_IN = rf'^(?:{_CELL},)*+"{_IN}$'
_IN_TO_IN = rf'^{_IN}(?:"[^,]*+,(?:{_CELL},)*+"{_IN})?+$'

# Characters that no text may exchange stand for line feeds between two passes.
_FEED, _MARK = "\ufdd0", "\ufdd1"
OPTIONS = {"quote": '"', "escape": '"'}
_AS_IT_IS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _after(prefix: Column, start: Column) -> Column:
    """The state after a prefix: what it was set to last, swapped as often as told."""
    since = F.coalesce(prefix["value"], start) + prefix["swaps"]
    return since % 2


def _prefixes(to_out: Column, to_in: Column, order: W) -> Column:
    """What all up to each row do to the state; the columns say where it leads from outside and
    from inside, 1 being inside."""
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    swaps = F.sum(F.when((to_out == 1) & (to_in == 0), 1).otherwise(0)).over(upto)
    return F.struct(swaps.alias("swaps"), F.when(to_out == to_in, to_out).alias("set"))


def _composed(rows: DataFrame, to_out: Column, to_in: Column, keys: list[str], order: str) -> DataFrame:
    """``rows`` with ``prefix``: value set last (or null) and number of swaps after that."""
    frame = W.partitionBy(*keys).orderBy(order)
    upto = frame.rowsBetween(W.unboundedPreceding, W.currentRow)
    told = rows.withColumn("_p", _prefixes(to_out, to_in, frame))
    last = F.last(F.when(F.col("_p.set").isNotNull(), F.col("_p")), ignorenulls=True).over(upto)
    made = told.withColumn("_l", last)
    swaps = F.col("_p.swaps") - F.coalesce(F.col("_l.swaps"), F.lit(0))
    return made.withColumn(
        "prefix", F.struct(F.col("_l.set").alias("value"), swaps.alias("swaps"))
    ).drop("_p", "_l")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, rec, text)``: the records of CSV files with their numbers in the file, header
    included."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",
        F.col("value").rlike(_OUT_TO_IN).cast("int").alias("a"),
        F.col("value").rlike(_IN_TO_IN).cast("int").alias("b"),
    )
    own = ["file", "block"]
    lines = stage(lines, "csv-lines")
    # What tells the states moves without the texts of the lines.
    marks = stage(_composed(lines.drop("value"), F.col("a"), F.col("b"), own, "line"), "csv-marks")

    # The state each block begins in.
    whole = marks.groupBy(*own).agg(F.max_by("prefix", "line").alias("whole"))
    leads = whole.select(
        *own, _after(F.col("whole"), F.lit(0)).alias("a"), _after(F.col("whole"), F.lit(1)).alias("b")
    )
    chain = _composed(leads, F.col("a"), F.col("b"), ["file"], "block")
    before = F.lag(_after(F.col("prefix"), F.lit(0))).over(W.partitionBy("file").orderBy("block"))
    starts = stage(chain.select(*own, F.coalesce(before, F.lit(0)).alias("start")), "csv-blocks")

    in_block = W.partitionBy(*own).orderBy("line")
    upto = in_block.rowsBetween(W.unboundedPreceding, W.currentRow)
    state = _after(F.col("prefix"), F.col("start"))
    told = marks.join(starts, own).select(
        *own, "line", state.alias("after"),
        F.coalesce(F.lag(state).over(in_block), F.col("start")).alias("before"),
    )
    told = stage(
        told.withColumn("n", F.sum(F.when(F.col("before") == 0, 1).otherwise(0)).over(upto)),
        "csv-states",
    )

    # Records before each block.
    counts = told.groupBy(*own).agg(F.max("n").alias("n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*own, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    places = told.join(stage(offsets, "csv-offsets"), own).select(
        "line", "before", "after", (F.col("n") + F.col("offset")).alias("rec")
    )
    # The side that is hashed has numbers only, so the texts need not be sorted.
    placed = lines.select("file", "line", "value").join(places.hint("shuffle_hash"), "line")
    # Behind a generator, so that both kinds of records read the same joined rows.
    columns = ("file", "rec", "line", "value", "before", "after")
    placed = placed.select(F.inline(F.array(F.struct(*columns))))
    alone = (F.col("before") == 0) & (F.col("after") == 0)
    parts = placed.where(~alone).groupBy("file", "rec").agg(
        F.sort_array(F.collect_list(F.struct("line", "value"))).alias("parts")
    )
    joined = parts.select("file", "rec", F.array_join("parts.value", "\n").alias("text"))
    single = placed.where(alone & (F.trim("value") != "")).select("file", "rec", F.col("value").alias("text"))
    return single.unionByName(joined)


def read_csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[str, str]]:
    """The table of CSV files with header rows, types inferred, and two more columns that
    order its rows: their names are given too."""
    records = stage(csv_records(spark, path), "csv-records")
    firsts = stage(records.groupBy("file").agg(F.min("rec").alias("first")), "csv-headers")
    files = firsts.select("file", "first", F.row_number().over(W.orderBy("file")).alias("file_no"))
    header = records.join(firsts.orderBy("file").limit(1), "file").where("rec = first")
    folder = new_folder(spark, "csv-header")
    header.select("text").write.text(folder)
    columns = spark.read.options(header=True, multiLine=True, **OPTIONS).csv(folder).columns
    kinds = ", ".join(f"c{i} string" for i in range(len(columns)))
    split = (
        records.join(files, "file").where(F.col("rec") > F.col("first"))
        .select("file_no", "rec", F.from_csv("text", kinds, OPTIONS).alias("cells"))
        .select("file_no", "rec", "cells.*")
    )
    kept = [
        F.replace(F.replace(F.replace(c, F.lit(_MARK), F.lit(_MARK + ".")), F.lit(_FEED), F.lit(_MARK + ",")),
                  F.lit("\n"), F.lit(_FEED)).alias(c)
        for c in split.columns[2:]
    ]
    folder = new_folder(spark, "csv-cells")
    with shuffles_removed(spark):
        cells = split.select("file_no", "rec", *kept).write.options(header=True, compression="gzip")
        cells.options(**OPTIONS, **_AS_IT_IS).csv(folder)
    back = spark.read.options(header=True, inferSchema=True, **OPTIONS).csv(folder)
    out = [
        F.replace(F.replace(F.replace(c, F.lit(_FEED), F.lit("\n")), F.lit(_MARK + ","), F.lit(_FEED)),
                  F.lit(_MARK + "."), F.lit(_MARK)).alias(c)
        if kind == "string" else F.col(c)
        for c, kind in back.dtypes[2:]
    ]
    order = ("_file", "_record")
    return back.select("file_no", "rec", *out).toDF(*order, *columns), order
