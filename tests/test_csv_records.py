"""Line feeds in quoted cells: blocks of a file against the reader that takes it whole."""

import csv
import io
import random

import pytest

from pagesift.sources.csv_records import csv_records
from pagesift.sources.urls import read_url_csv

CELLS = ["a", "", 'x "y"', "two\nlines", "\n\n", ",", '"', '""', "a,b\n\"c\"\nd", "5\" pipe", " é🙂 ", "'",
         "a\n" * 30, "﷐ and ﷑.", "\\", '\n"']


def text_of(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that most begin inside of a record."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_random_files(spark, tmp_path, small_blocks, end):
    rng = random.Random(6)
    want = []
    for k in range(3):
        rows = [[f"u{k}-{i}", rng.choice(CELLS), rng.choice(CELLS), i] for i in range(120)]
        text = text_of([["url", "no\nte", "b.c", "n"], *rows], end)
        (tmp_path / f"f{k}.csv").write_text(text.replace(end + "u", end + end + "u", 7), newline="")
        want += rows
    got = read_url_csv(spark, str(tmp_path), multiline=True)
    assert got.columns == ["row_id", "url", "no\nte", "b.c", "n"]
    assert dict(got.dtypes)["n"] == "int"
    rows = [list(r) for r in got.orderBy("row_id").collect()]
    line = lambda c: (c.replace("\n", "\n") or None) if isinstance(c, str) else c
    assert [r[1:] for r in rows] == [[line(c) for c in r] for r in want]
    assert [r[0] for r in rows] == list(range(1, len(want) + 1))


def test_rows_and_order_as_read_whole(spark, tmp_path, small_blocks):
    rng = random.Random(8)
    rows = [[f"u{i}", rng.choice(CELLS), rng.choice(["1", "", "x\ny", "2.5"])] for i in range(400)]
    path = str(tmp_path / "one.csv")
    (tmp_path / "one.csv").write_text(text_of([["url", "t", "v"], *rows]), newline="")
    whole = spark.read.options(header=True, inferSchema=True, quote='"', escape='"', multiLine=True).csv(path)
    got = read_url_csv(spark, path, multiline=True).orderBy("row_id")
    assert whole.rdd.getNumPartitions() == 1 and spark.read.text(path).rdd.getNumPartitions() > 50
    assert got.drop("row_id").dtypes == whole.dtypes
    assert [r[1:] for r in map(tuple, got.collect())] == list(map(tuple, whole.collect()))


def test_records_of_many_lines_and_open_ends(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('url,b\n"' + "x\n" * 400 + 'y",1\nq,"never\nclosed\n\nz,3\n')
    (tmp_path / "b.csv").write_text("url,b\n")
    (tmp_path / "c.csv").write_text("")
    got = sorted((r.file[-5:], r.rec, r.text) for r in csv_records(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 1, "url,b"), ("a.csv", 2, '"' + "x\n" * 400 + 'y",1'),
                   ("a.csv", 3, 'q,"never\nclosed\n\nz,3'), ("b.csv", 1, "url,b")]
    assert read_url_csv(spark, str(tmp_path / "b.csv"), multiline=True).count() == 0


def test_lines_move_once_before_records_are_joined(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write('a,b\n' + "".join(f'{i},"x\ny {i}"\n{i},z\n' for i in range(50)))
    records = csv_records(spark, path)
    assert records.count() == 101
    plan = records._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x]
    assert "Window" not in plan and "SortMergeJoin" not in plan  # texts are in no window
    assert len(wide) <= 5
