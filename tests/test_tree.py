"""A tree of units as a data source: round trips, pruning, and writes that fail."""

import os

import pytest
from pyspark.sql import functions as F

from passagelake.sources import files, tree


def below(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def units(spark, n=30):
    i = F.col("id")
    return spark.range(n).select(F.when(i % 3 == 0, "pilot").otherwise("trainer").alias("source"), i.cast("string").alias("unit_id"), F.concat(F.lit("# Unit é\r\n"), i).alias("content"), F.lit(None).cast("string").alias("error"))


def test_round_trip_and_pruning(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = units(spark).withColumn("content", F.when(F.col("unit_id") != "7", F.col("content"))).withColumn("error", F.when(F.col("unit_id") == "7", "gap"))
    report = {r.unit_id: r for r in files.write_markdown_tree(rows.repartition(4), root).collect()}
    assert report["7"].path is None and report["7"].error == "gap" and report["4"].path == "trainer/unit-04.md"
    assert len(below(f"{tmp_path}/t")) == 29 and not os.path.exists(f"{tmp_path}/t/{tree.STAGING}")
    held = {r.path: r.content for r in files.read_markdown_tree(spark, root).collect()}
    assert held["trainer/unit-04.md"] == "# Unit é\r\n4" and len(held) == 29
    some = tree.read_tree(spark, root, ["pilot", "absent"])
    assert {r.source for r in some.collect()} == {"pilot"} and some.count() == 10
    again = files.write_markdown_tree(units(spark).filter("unit_id = '4'").withColumn("content", F.lit("new")), root)
    assert again.count() == 1 and {r.path: r.content for r in files.read_markdown_tree(spark, root).collect()}["trainer/unit-04.md"] == "new"


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = units(spark).repartition(4).select("source", files.unit_file(F.col("source"), F.col("unit_id")).alias("path"), "content")

    @F.udf("string")
    def late(text):
        if text.endswith("29"):
            import time

            time.sleep(2)  # the others are written by now
            raise RuntimeError("lost")
        return text

    with pytest.raises(Exception, match="lost"):
        tree.write_tree(rows.withColumn("content", late("content")), root)
    assert below(f"{tmp_path}/t") == []
    assert tree.read_tree(spark, root).count() == 0
    tree.write_tree(rows, root)
    assert len(below(f"{tmp_path}/t")) == 30


def test_staged_files_are_not_read(spark, tmp_path):
    root = tmp_path / "t"
    (root / tree.STAGING / "x" / "1" / "pilot").mkdir(parents=True)
    (root / tree.STAGING / "x" / "1" / "pilot" / "unit-01.md").write_text("half")
    (root / "pilot").mkdir()
    (root / "pilot" / "unit-02.md").write_text("whole")
    (root / "pilot" / "notes.md").write_text("no unit")
    assert [tuple(r) for r in tree.read_tree(spark, f"file://{root}").collect()] == [("pilot", "pilot/unit-02.md", "whole")]


def test_partitions_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "PARTITION_BYTES", 25)
    (tmp_path / "s").mkdir()
    for i in range(7):
        (tmp_path / "s" / f"unit-{i:02d}.md").write_text("x" * (40 if i == 3 else 10))
    parts = tree.TreeReader(f"file://{tmp_path}", None).partitions()
    assert [len(p.paths) for p in parts] == [2, 1, 1, 2, 1]
