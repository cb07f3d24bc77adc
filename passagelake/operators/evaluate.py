"""Scoring of retrieval steps: recall, refusals, judges, the ablation curve; all items and steps in one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..ports import NoTracer, Tracer
from ..scratch import materialize
from .answers import REFUSAL, answer, completed, json_object, passage_block, retrieved_passages
from .search import PARENTS, STEPS

UNREADABLE = "The verdict could not be read."
METRICS = ("recall", "refusal", "faithful", "grounded", "correct")
JUDGE = {
    "faithful": "Say whether the cited passages support the answer. Reply with JSON: faithful, grounded, rationale.",
    "grounded": "Say whether the passages contain the answer. Reply with JSON: faithful, grounded, rationale.",
    "correct": "Say whether the answer agrees with the expected one. Reply with JSON: correct, rationale.",
}


def recall_at_k(retrieved: DataFrame, gold: DataFrame, k: int | None = None) -> DataFrame:
    """retrieved (item_id, rank, source, unit, page), gold (item_id, source, unit, page) -> (item_id, recall): 1.0
    if a gold page is among the first k parents' pages, else 0.0; a row for each item that has gold."""
    near = retrieved if k is None else retrieved.filter(F.col("rank") <= k)
    keys = near.select("item_id", "source", "unit", "page").distinct()
    hit = gold.join(keys, ["item_id", "source", "unit", "page"], "left_semi").select("item_id").distinct().withColumn("hit", F.lit(1.0))
    return gold.select("item_id").distinct().join(hit, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(0.0)).alias("recall"))


def refusal_score(grounded: Column, answer: Column, citations: Column, expected: Column) -> Column:
    """Whether an item refused, or answered, as expected; any other expectation is false."""
    refused = ~grounded & (answer == REFUSAL) & (F.size(citations) == 0)
    return F.when(expected == "refuse", refused).when(expected == "answer", grounded).otherwise(False)


def verdict(text: Column, keys: tuple[str, ...]) -> Column:
    """A judge's reply as struct<keys..., rationale>; false throughout, with a fixed rationale, where a key is no boolean."""
    v = json_object(text)
    get = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    good = F.coalesce(v.isNotNull(), F.lit(False))
    for k in keys:
        good = good & (F.coalesce(F.schema_of_variant(get(k)), F.lit("VOID")) == "BOOLEAN")
    said = F.when(F.schema_of_variant(get("rationale")) == "STRING", F.try_variant_get(v, "$.rationale", "string")).otherwise("")
    return F.struct(*[F.coalesce(F.when(good, F.try_variant_get(v, f"$.{k}", "boolean")), F.lit(False)).alias(k) for k in keys], F.when(good, said).otherwise(UNREADABLE).alias("rationale"))


def judged(facts: DataFrame, judge) -> DataFrame:
    """facts with faithful, grounded_ok and correct, asked only for grounded answers to items that expect one; null
    elsewhere. facts needs result_grounded, expected_behavior, answer, cited, passages, expected_answer."""
    ask = F.col("result_grounded") & (F.col("expected_behavior") == "answer")
    yes, no = facts.filter(ask), facts.filter(~F.coalesce(ask, F.lit(False)))
    part = lambda *names: F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names])
    yes = completed(yes.withColumn("_p", part("passages", "cited", "answer")), judge, JUDGE["faithful"], "_p", "_f")
    yes = completed(yes.withColumn("_p", part("passages", "answer")), judge, JUDGE["grounded"], "_p", "_g")
    yes = completed(yes.withColumn("_p", part("expected_answer", "answer")), judge, JUDGE["correct"], "_p", "_c")
    pair = ("faithful", "grounded")
    yes = yes.withColumn("faithful", verdict(F.col("_f"), pair)["faithful"]).withColumn("grounded_ok", verdict(F.col("_g"), pair)["grounded"]).withColumn("correct", verdict(F.col("_c"), ("correct",))["correct"]).drop("_p", "_f", "_g", "_c")
    none = F.lit(None).cast("boolean")
    return yes.unionByName(no.withColumn("faithful", none).withColumn("grounded_ok", none).withColumn("correct", none))


def page_keys(passages: DataFrame) -> DataFrame:
    """passages -> (item_id, rank, source, unit, page): the pages that each passage covers, of its own unit."""
    each = passages.select(F.col("query_id").alias("item_id"), "rank", "source", "unit", F.explode("pages").alias("token"))
    page = F.regexp_extract("token", r"^(.+)-(\d+)$", 2).try_cast("int")
    return each.filter(F.regexp_extract("token", r"^(.+)-(\d+)$", 1) == F.col("unit")).select("item_id", "rank", "source", "unit", page.alias("page")).filter("page is not null")


def score_step(step: str, items: DataFrame, gold: DataFrame, passages: DataFrame, answers: DataFrame, judge, k: int = PARENTS) -> DataFrame:
    """One step's facts, a row an item: (step, item_id, recall, refusal, result_grounded, answer, faithful, grounded_ok, correct).

    items (item_id, question, expected_behavior, expected_answer), gold (item_id, source, unit, page), passages and
    answers as the step gave them. The judge sees the passages as the prompt had them and the citations as JSON.
    """
    recall = recall_at_k(page_keys(passages), gold, k)
    shown = passages.select("query_id", "rank", passage_block(F.col("rank")).alias("block")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    shown = shown.select(F.col("query_id").alias("item_id"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("passages"))
    got = answers.select(F.col("query_id").alias("item_id"), F.col("grounded").alias("result_grounded"), "answer", "citations")
    facts = items.join(got, "item_id").join(shown, "item_id", "left").join(recall, "item_id", "left")
    facts = facts.withColumn("refusal", refusal_score(F.col("result_grounded"), F.col("answer"), F.col("citations"), F.col("expected_behavior"))).withColumn("cited", F.to_json("citations"))
    out = judged(facts, judge)
    return out.select(F.lit(step).alias("step"), "item_id", "recall", "refusal", "result_grounded", "answer", "faithful", "grounded_ok", "correct")


def ablation(items: DataFrame, gold: DataFrame, queries: DataFrame, vectors: DataFrame, texts: DataFrame, parents: DataFrame, completer, judge, steps: tuple[str, ...] = STEPS, k: int = PARENTS, tracer: Tracer | None = None, on_item: Callable[[Row], None] | None = None, **how) -> DataFrame:
    """The curve over retrieval steps: each step retrieves, answers and is scored over all items.

    queries (query_id, text, embedding): an item's id and question. on_item is called with each item's facts as a step
    ends, through an iterator on the driver. A step's sums are observed while its facts are written, so the curve takes no further pass; the tracer hears of each step's start and gets its scores at its end: of a step
    that fails, an empty table, before the error goes on.
    """
    tracer, facts, points = tracer or NoTracer(), [], []
    scores, searched = None, {}  # steps share their searches
    for step in steps:
        tracer.start(step)
        try:
            passages = retrieved_passages(step, queries, vectors, texts, parents, held=searched, **how)
            answers = materialize(answer(queries.select("query_id", F.col("text").alias("question")), passages, completer), "ablation-answers")
            seen = Observation(f"scores-{step}")
            held = score_step(step, items, gold, passages, answers, judge, k).observe(seen, *_sums())
            facts.append(materialize(held, "ablation-facts"))
            points.append(_point(step, seen.get))
            scores = long_metrics(facts[-1].withColumnRenamed("grounded_ok", "grounded"))
        finally:
            tracer.end(step, scores if scores is not None else _no_scores(items))
            scores = None
        if on_item:
            for row in facts[-1].toLocalIterator():
                on_item(row)
    return items.sparkSession.createDataFrame(points, "step string, recall double, refusal double, faithful double, grounded double, correct double, pos int")


#: The facts' columns of the curve's metrics.
_SCORED = ("recall", "refusal", "faithful", "grounded_ok", "correct")


def _sums() -> list[Column]:
    """What is observed of a step's facts as they are written: each metric's sum, and how many items have it."""
    return [c for m in _SCORED for c in (F.sum(F.col(m).cast("double")).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}"))]


def _point(step: str, seen: dict) -> tuple:
    """A step's row of the curve, from what was observed."""
    mean = [seen[f"sum_{m}"] / seen[f"n_{m}"] if seen[f"n_{m}"] else 0.0 if m == "recall" else None for m in _SCORED]
    return (step, *mean, STEPS.index(step) + 1)


def _no_scores(items: DataFrame) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()
    return items.sparkSession.createDataFrame([], f"step string, item_id {kind}, metric string, value double")


def curve(facts: DataFrame) -> DataFrame:
    """facts (step, recall, refusal, faithful, grounded_ok, correct) -> a row a step, in order: recall is 0.0 where no
    item has gold, the others are null where nothing was scored."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    out = facts.groupBy("step").agg(F.coalesce(mean("recall"), F.lit(0.0)).alias("recall"), mean("refusal").alias("refusal"), mean("faithful").alias("faithful"), mean("grounded_ok").alias("grounded"), mean("correct").alias("correct"))
    order = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("step"))
    return out.withColumn("pos", order)


def long_metrics(facts: DataFrame, keys: tuple[str, ...] = ("step", "item_id")) -> DataFrame:
    """facts -> (keys..., metric, value), a row a score; booleans are 1.0 and 0.0, nulls are left out."""
    cast = facts.select(*keys, *[F.col(m).cast("double").alias(m) for m in METRICS])
    return cast.unpivot(list(keys), list(METRICS), "metric", "value").filter("value is not null")


def progress_line() -> Column:
    """A line a result: two digits for numbers, ticks for booleans, a dash for null."""
    tick = lambda c: F.when(F.col(c).isNull(), "—").when(F.col(c).cast("boolean"), "✓").otherwise("✗")
    return F.concat_ws(" ", "step", F.col("item_id").cast("string"), F.when(F.col("recall").isNull(), "—").otherwise(F.format_string("%.2f", F.col("recall"))), *[tick(m) for m in METRICS[1:]])


def report_json(points: DataFrame, items: int, k: int) -> DataFrame:
    """One row: the whole curve as JSON."""
    packed = points.agg(F.array_sort(F.collect_list(F.struct("pos", "step", *METRICS))).alias("p"))
    return packed.select(F.to_json(F.struct(F.lit(items).alias("items"), F.lit(k).alias("k"), F.transform("p", lambda x: x.dropFields("pos")).alias("points")), {"ignoreNullFields": "false"}).alias("report"))
