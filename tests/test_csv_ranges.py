"""CSV files read by byte ranges: the rows of the reader that takes whole files, whatever lies at the edges."""

import csv
import random
from collections import Counter

import pytest

from textpair.functions.rouge import SCORE_COLUMNS
from textpair.session import shared_dir
from textpair.sources import results
from textpair.sources.csv_ranges import csv_records

NAMES = [f.name for f in results.result_schema(["title"], keys=())]
CELLS = [
    "plain", "two\nlines", "\n", "\n\n\n", 'say "so"', '"', '""', '"\n"', ',\n,"', "tab\tcr\r\nend", "é\nü 😀", " lead and trail ", "",
    "long " * 60, "many\n" * 40, 'q"\n' * 30, "x,y", "\\n", "back\\slash\n",
]


def random_rows(seed, n):
    rnd = random.Random(seed)
    return [[*(rnd.choice(CELLS) for _ in range(5)), *(str(rnd.randint(0, 100)) for _ in SCORE_COLUMNS)] for _ in range(n)]


def write_file(path, rows, header=NAMES, end="\n", blank=False):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end)
        if blank:
            out.write(end)
        for row in [header, *rows]:
            writer.writerow(row)
            if blank:
                out.write(end)



def counted(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few bytes: every kind of edge occurs."""
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("size", "n"), [(9, 2), (64, 12), (1000, 300)])
def test_line_breaks_at_the_edges_of_ranges(spark, tmp_path, small_ranges, size, n):
    for seed in range(2):
        write_file(tmp_path / f"{seed}.csv", random_rows(seed, n))
    small_ranges(size)
    got = results.read_results(spark, str(tmp_path), ["title"], keys=())
    expected = Counter()
    for seed in range(2):
        for row in random_rows(seed, n):
            # Python's writer leaves an empty cell bare: a missing value.
            expected[tuple([*row[:5], *map(float, row[5:])])] += 1
    seen = Counter()
    for row, count in counted(got).items():
        seen[tuple("" if c is None else c for c in row)] += count
    assert seen == expected
    assert got.rdd.getNumPartitions() > 2 * 2


@pytest.mark.parametrize("size", [40, 500, 100_000])
def test_same_rows_as_by_whole_files(spark, tmp_path, small_ranges, size):
    write_file(tmp_path / "a.csv", random_rows(5, 30))
    write_file(tmp_path / "b.csv", random_rows(6, 1))
    (tmp_path / "empty.csv").write_text("")
    small_ranges(size)
    by_range = results.read_results(spark, str(tmp_path), ["title"], keys=())
    by_file = results.read_results(spark, str(tmp_path), ["title"], keys=(), by_range=False)
    assert by_range.schema == by_file.schema
    assert counted(by_range) == counted(by_file) and by_file.count() == 31


def test_no_task_reads_a_whole_file(spark, tmp_path, small_ranges):
    write_file(tmp_path / "a.csv", random_rows(5, 2000))
    size = (tmp_path / "a.csv").stat().st_size
    small_ranges(size // 20)
    df = results.read_results(spark, str(tmp_path), ["title"], keys=())
    assert df.rdd.getNumPartitions() >= 20
    assert df.count() == 2000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


@pytest.mark.parametrize("size", [40, 10_000])
def test_carriage_returns_and_blank_lines_end_records(spark, tmp_path, small_ranges, size):
    rows = random_rows(7, 8)
    write_file(tmp_path / "a.csv", rows, end="\r\n", blank=True)
    small_ranges(size)
    got = results.read_results(spark, str(tmp_path), ["title"], keys=()).collect()
    assert Counter(r["title"] or "" for r in got) == Counter(r[0] for r in rows) and len(got) == 8


def test_a_cell_longer_than_many_ranges(spark, tmp_path, small_ranges):
    rows = random_rows(8, 3)
    rows[1][0] = 'line "of" text\n' * 500
    write_file(tmp_path / "a.csv", rows)
    small_ranges(200)
    got = results.read_results(spark, str(tmp_path), ["title"], keys=()).collect()
    assert Counter(r["title"] or "" for r in got) == Counter(r[0] for r in rows)


def test_header_with_a_line_break(spark, tmp_path, small_ranges):
    write_file(tmp_path / "a.csv", [[*r, "z"] for r in random_rows(3, 5)], header=[*NAMES, "free\ntext"])
    small_ranges(8)
    assert results.read_results(spark, str(tmp_path), ["title"], keys=()).count() == 5


@pytest.mark.parametrize("header", [NAMES[::-1], NAMES[:-1], [*NAMES, "more"]])
def test_other_headers_raise(spark, tmp_path, header):
    write_file(tmp_path / "a.csv", random_rows(1, 2))
    write_file(tmp_path / "b.csv", [], header=header)
    with pytest.raises(Exception, match="(?i)header"):
        results.read_results(spark, str(tmp_path), ["title"], keys=()).collect()


@pytest.mark.parametrize("size", [12, 10_000])
@pytest.mark.parametrize("text", ['a,5" pipe,c\nd,e,f\n', 'a,5" pipe,c\nd,6" pipe,f\n', 'a,"open\nd,e,f\n'])
def test_stray_quotes_never_swallow_records(spark, tmp_path, small_ranges, text, size):
    (tmp_path / "a.csv").write_text("x,y,z\n" + text)
    small_ranges(size)
    with pytest.raises(Exception, match="by_range=False"):
        csv_records(spark, str(tmp_path)).collect()


def test_without_rows(spark, tmp_path):
    write_file(tmp_path / "a.csv", [])
    assert results.read_results(spark, str(tmp_path), ["title"], keys=()).count() == 0


def test_written_results_are_the_same_by_range(spark, small_ranges):
    schema = results.result_schema(["title"], keys=())
    rows = [(c, c, c, "m", c, 1.5, None, 0.0, 100.0) for c in [*CELLS, None]]
    df = spark.createDataFrame(rows, schema)
    path = shared_dir(spark, "by-range")
    results.write_results(df, path, "csv")
    small_ranges(50)
    assert counted(results.read_results(spark, path, ["title"], keys=())) == counted(df)
