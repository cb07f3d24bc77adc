"""Runs that are killed, steps that fail, look-ups that read what they need, an entry without its optional part."""

import json
import os
import shutil
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from passagelake.operators import evaluate, questions
from passagelake.operators.sync import Index
from passagelake.ports import AgreeingJudge, QuotingCompleter
from passagelake.scratch import scratch_path

from .test_indexes import files_read

ROOT = Path(__file__).resolve().parent.parent


class Killed(Exception):
    pass


class CountingCompleter(QuotingCompleter):
    """Notes each question it is asked in a folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def complete(self, system: str, user: str) -> str:
        question = user.rpartition("Question: ")[2]
        with open(os.path.join(self.folder, question), "a") as f:
            f.write("x")
        return super().complete(system, user)


def run_tables(spark, n=40):
    items = spark.createDataFrame([(i, f"q{i}") for i in range(n)], "id long, question string")
    passages = items.select(F.col("id").alias("query_id"), F.lit(1).cast("long").alias("rank"), F.concat(F.lit("p"), F.col("id")).alias("id"), F.lit("guide").alias("source"), F.lit("1").alias("unit"), F.array(F.lit("1-1")).alias("pages"), F.array(F.lit("About")).alias("heading_path"), F.lit("theory").alias("content_type"), F.lit("Text.").alias("text"))
    return items, passages


def test_a_killed_run_keeps_what_it_finished(spark, tmp_path, monkeypatch):
    items, passages = run_tables(spark)
    path, noted = scratch_path(spark, "run"), tmp_path / "noted"
    noted.mkdir()
    commits, append = [], questions.append_run

    def dying(results, where):
        if len(commits) == 3:
            raise Killed
        append(results, where)
        commits.append(where)

    monkeypatch.setattr(questions, "append_run", dying)
    with pytest.raises(Killed):
        questions.run_batch(items, passages, CountingCompleter(str(noted)), path, block=5)
    held = {r.id for r in spark.read.parquet(path).filter("answer is not null").collect()}
    assert 0 < len(held) < 40
    asked = {p.name: len(p.read_text()) for p in noted.iterdir()}
    monkeypatch.setattr(questions, "append_run", append)
    counts = questions.run_batch(items, passages, CountingCompleter(str(noted)), path, block=5).first()
    assert tuple(counts) == (40, 0, 0, 40)
    again = {p.name: len(p.read_text()) for p in noted.iterdir()}
    assert all(again[f"q{i}"] == asked[f"q{i}"] == 1 for i in held)  # none that was finished is asked twice
    assert len(again) == 40


def test_a_run_of_a_killed_driver_goes_on(spark, tmp_path):
    """The driver itself is killed, by a signal, between two blocks."""
    path = f"file://{tmp_path}/run"
    code = f"""
        import os, sys
        sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
        from passagelake.operators import questions
        from passagelake.ports import QuotingCompleter
        from tests.test_resilience import run_tables
        append, done = questions.append_run, []
        def dying(results, where):
            append(results, where)
            done.append(1)
            if len(done) == 2:
                os.kill(os.getpid(), 9)
        questions.append_run = dying
        questions.run_batch(*run_tables(spark), QuotingCompleter(), {path!r}, block=10)
    """
    ended = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, timeout=180)
    assert ended.returncode == -9
    held = spark.read.parquet(path).count()
    assert 0 < held < 40
    items, passages = run_tables(spark)
    assert tuple(questions.run_batch(items, passages, QuotingCompleter(), path, block=10).first()) == (40, 0, 0, 40)
    assert spark.read.parquet(path).count() == 40


class Notes:
    def __init__(self):
        self.heard = []

    def start(self, step):
        self.heard.append(("start", step))

    def end(self, step, scores):
        self.heard.append(("end", step, scores.count()))


def test_a_failing_step_ends_its_trace(spark, monkeypatch):
    from passagelake.plans import retrieval as R
    from passagelake.plans import seams

    d, notes = "/root/testdata/sf0.001", Notes()
    score = evaluate.score_step

    def failing(step, *a, **b):
        if step == "hybrid":
            raise RuntimeError("no service")
        return score(step, *a, **b)

    monkeypatch.setattr(evaluate, "score_step", failing)
    with pytest.raises(RuntimeError, match="no service"):
        evaluate.ablation(seams._items(spark, d), seams._gold(spark, d), R._item_vectors(spark, d), completer=seams.ParityCompleter(), judge=AgreeingJudge(), tracer=notes, **seams._given(spark, d))
    assert [x[:2] for x in notes.heard] == [("start", "vector"), ("end", "vector"), ("start", "hybrid"), ("end", "hybrid")]
    assert notes.heard[1][2] > 0 and notes.heard[3][2] == 0


def test_a_look_up_reads_the_asked_folders(spark):
    index = Index(spark, scratch_path(spark, "index"))
    docs = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("h"), "id").alias("content_hash"))
    index.write(docs, docs)
    third = docs.filter("id % 3 = 0")
    index.write(third.withColumn("content_hash", F.lit("new")), third)
    index.write(docs.limit(0), docs.filter("id % 5 = 0"))
    one = spark.createDataFrame([("12",), ("12",), ("absent",), (None,)], "id string")
    assert [tuple(r) for r in index.lookup(one, ["content_hash"]).collect()] == [("12", "new")]
    held = sum(len(spark.read.parquet(f"{index.path}/versions/{v:08d}/{t}").inputFiles()) for v, t in ((1, "base"), (2, "documents"), (2, "touched"), (3, "touched")))
    folder = spark.createDataFrame([("12",)], "id string").select(Index._bucket().alias("b")).first().b
    where = (F.col("_b") == folder) & F.col("id").isin(["12"])
    assert held > 100
    base = spark.read.parquet(f"{index.path}/versions/00000001/base")
    assert files_read(base.filter(where)) == 1
    many = docs.filter("id % 2 = 0").select("id")
    got = {r.id: r.content_hash for r in index.lookup(many, ["content_hash"]).collect()}
    assert got == {str(i): "new" if i % 3 == 0 else f"h{i}" for i in range(0, 4000, 2) if i % 5}


def test_the_entry_without_its_optional_part(tmp_path):
    for name in ("__spark_entry__.py", "passagelake"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    for p in (tmp_path / "passagelake" / "llm").glob("*.py") if (tmp_path / "passagelake" / "llm").exists() else ():
        p.unlink()
    (tmp_path / "passagelake" / "llm").mkdir(exist_ok=True)  # an empty folder is a package to import machinery
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    names, sql = json.loads(out.stdout.strip().splitlines()[-1])
    assert len(names) >= 72 and set(sql) == set(names) and not any(n.startswith("op") and n[2].isdigit() for n in names)
