"""Finely dealt shuffles: tables of few rows are written as few files."""

import glob
import random

import pytest

from vidmart.llm import components, neardup, packing

FINE = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def fine(spark):
    before = {k: spark.conf.get(k) for k in FINE}
    for k, v in FINE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def docs(spark):
    """60 texts and a near copy of each."""
    rng, rows = random.Random(5), []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80 + i)]
        rows += [(i, " ".join(words)), (100 + i, " ".join([*words, "more"]))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def files(path):
    return len(glob.glob(f"{path.removeprefix('file:')}/part-*"))


def test_near_duplicates_writes_small_tables_as_few_files(fine, monkeypatch):
    written, saved = [], neardup.saved

    def counted(df, name, *bucket):
        out = saved(df, name, *bucket)
        written.append((name, files(out.held_at)))
        return out

    monkeypatch.setattr(neardup, "saved", counted)
    monkeypatch.setattr(components, "saved", counted)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(fine)).collect()}
    assert got == {i + k: i for i in range(60) for k in (0, 100)}
    small = {"lists", "pairs", "involved", "chosen", "confirmed", "links", "labelled", "components"}
    assert small <= {name for name, _ in written}
    assert max(n for name, n in written if name in small) <= fine.sparkContext.defaultParallelism


def test_packed_pieces_are_few_files(fine, tmp_path):
    out = packing.pack_documents(docs(fine))
    out.write.parquet(f"{tmp_path}/packed")
    assert files(f"{tmp_path}/packed") <= fine.sparkContext.defaultParallelism
    assert fine.read.parquet(f"{tmp_path}/packed").count() == 120
