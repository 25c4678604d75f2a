"""Quoted CSV in splits: equal to Spark's own multi-line reader, whatever the splits."""

import random

import pytest

from testkit import rows
from vidmart.sources.csv_splits import ChangedSplitsError, _lines, _pieces, csv_records, quote_states, read_csv_splits

SCHEMA = "id long, t string, v double"


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(spark, data, path, header=True):
    df = spark.createDataFrame(data, SCHEMA)
    (df.repartition(2).write.option("header", header).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return df


@pytest.mark.parametrize("header", [True, False])
def test_many_splits_equal_the_whole(spark, small_splits, tmp_path, header):
    """Quotes, separators and line breaks in fields; fields that run over many splits; two files."""
    rng = random.Random(1)
    text = lambda: "".join(rng.choice(['a', '"', "\n", ",", "\r\n", " ", "é", '""', "\n\n"]) for _ in range(rng.randint(0, 200)))
    data = [(i, text() if i % 9 else "x\n" * 900, rng.random()) for i in range(200)]
    df = write(spark, data, f"{tmp_path}/c", header)
    assert len(quote_states(_lines(spark, f"{tmp_path}/c"))) > 50
    whole = spark.read.schema(df.schema).option("header", header).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/c")
    got = rows(read_csv_splits(spark, f"{tmp_path}/c", df.schema, header))
    assert got == sorted(((i, t or None, v) for i, t, v in data), key=repr)
    if header:  # without one Spark's reader may take the first field's \r\n for the line end of the file
        assert got == rows(whole)


def test_odd_files(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,t,v\r\n1,plain,0.5\r\n\r\n2,"two\r\nlines",x\r\n3,,\r\n')
    (tmp_path / "b.csv").write_bytes(b'id,t,v\n4,"no end of line",1')
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes(b"id,t,v\n")
    got = rows(read_csv_splits(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema))
    assert got == sorted([(1, "plain", 0.5), (2, "two\r\nlines", None), (3, None, None), (4, "no end of line", 1.0)], key=repr)
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "e.csv").write_bytes(b'id,t,v\n5,"never\nclosed,1\n6,b,2\n')
    assert csv_records(spark, str(tmp_path / "e")).count() == 1


def test_other_splits_than_counted_are_an_error(spark, tmp_path):
    write(spark, [(1, "a", 0.0)], f"{tmp_path}/c")
    with pytest.raises(Exception, match="was no split") as e:
        _lines(spark, f"{tmp_path}/c").mapInArrow(_pieces({}, True), "file string, block long, kind int, record string").collect()
    assert ChangedSplitsError.__name__ in str(e.value)


def test_no_task_writes_all_the_landing_files(spark, small_splits, tmp_path):
    """landed_csv makes its CSV where the table is read, and gives every row, with null and empty texts."""
    from pathlib import Path

    from vidmart.plans.driver import catalogue
    from vidmart.session import checkpoint_root
    data = [(i, "en", None if i % 7 == 0 else f'line {i}\n"two", {i}\n' * (1 + i % 3), i) for i in range(80)]
    (spark.createDataFrame(data, "doc_id long, lang string, text string, n_chars long").repartition(4, "doc_id")
     .write.parquet(f"{tmp_path}/documents.parquet"))
    landed = lambda: set(Path(checkpoint_root(spark)).glob("land-csv-*"))
    before = landed()
    got = rows(catalogue.QUERIES["landed_csv"](spark, str(tmp_path)), "doc_id", "line_breaks")
    assert got == sorted(((i, t and t.count("\n")) for i, _, t, _ in data), key=repr)
    files = list((landed() - before).pop().glob("*.csv"))
    assert len(files) == 4 and all(f.stat().st_size for f in files)
