"""Scores: consensus, disagreement, rollups, calibration drift, tool-call metrics.

Judge scores come long, one row for each (item, judge, axis); every operator is one or two hash aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_scores(rows: DataFrame, keys: list[str], scores: str = "scores") -> DataFrame:
    """Rows (*keys, axis, score) from a map of axis to score; scores that are no numbers are left out."""
    return rows.select(*keys, F.explode(scores).alias("axis", "score")).where("score IS NOT NULL")


def verdict_rank(verdict: Column) -> Column:
    """pass 0, warn 1, fail 2; what is unknown ranks as pass."""
    return F.when(verdict == "fail", 2).when(verdict == "warn", 1).otherwise(0)


def worst_verdict(verdict: Column) -> Column:
    """An aggregate: the worst verdict of a group, pass for none."""
    rank = F.coalesce(F.max(verdict_rank(verdict)), F.lit(0))
    return F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), rank + 1)


def consensus(scores: DataFrame, keys: list[str], method: str = "median") -> DataFrame:
    """Per item and axis, over judges: the lower median, the mean or the minimum."""
    how = {"median": F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY score)"), "mean": F.avg("score"), "min": F.min("score")}
    return scores.groupBy(*keys, "axis").agg(how[method].alias("score"))


def disagreement(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per item and axis: largest less smallest score."""
    return scores.groupBy(*keys, "axis").agg((F.max("score") - F.min("score")).alias("spread"))


def ensemble(scores: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Per item: midpoint medians by axis, the largest spread, and the worst verdict."""
    by_axis = scores.groupBy(*keys, "axis").agg(F.percentile("score", F.lit(0.5)).alias("median"), (F.max("score") - F.min("score")).alias("spread"))
    items = by_axis.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "median")))).alias("medians"), F.max("spread").alias("max_spread"))
    worst = verdicts.groupBy(*keys).agg(worst_verdict(F.col("verdict")).alias("verdict"))
    return items.join(worst, keys, "full")


def axis_rollup(scores: DataFrame, scales: dict[str, int], split: str) -> DataFrame:
    """Mean score over scale by split and, as null, over all splits; an axis without scores is null."""
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("scale")) for a, s in scales.items()]))
    means = scores.groupingSets([[split, "axis"], ["axis"]], split, "axis").agg(F.avg("score").alias("mean"), F.grouping(split).alias("overall"))
    frame = scores.select(split).distinct().select(split, F.lit(0).alias("overall"))
    frame = frame.unionByName(scores.sparkSession.range(1).select(F.lit(None).cast(scores.schema[split].dataType).alias(split), F.lit(1).alias("overall")))
    frame = frame.select(split, "overall", axes.alias("a")).select(split, "overall", "a.axis", "a.scale")
    same = (frame[split].eqNullSafe(means[split])) & (frame["axis"] == means["axis"]) & (frame["overall"] == means["overall"])
    return frame.join(means, same, "left").select(frame[split], frame["axis"], (means["mean"] / frame["scale"]).alias("score"))


def verdict_counts(rows: DataFrame, verdict: str = "verdict") -> DataFrame:
    count = lambda v: F.count_if(F.col(verdict) == v).alias(f"n_{v}")
    return rows.agg(count("pass"), count("warn"), count("fail"))


def turns_to_items(turns: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Per conversation from per turn: mean scores, worst verdict, joined rationales in order, summed tokens."""
    text = F.array_sort(F.collect_list(F.when(F.coalesce("rationale", F.lit("")) != "", F.struct("turn", "rationale"))))
    joined = F.array_join(F.transform(text, lambda x: x["rationale"]), "\n")
    means = [F.avg(a).alias(a) for a in axes]
    return turns.groupBy(*keys).agg(*means, worst_verdict(F.col("verdict")).alias("verdict"), joined.alias("rationale"), F.sum("tokens").alias("tokens"))


def calibration_drift(expected: DataFrame, actual: DataFrame, keys: list[str], threshold: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Items with their largest |actual - expected| and a flag above the threshold; and the largest and mean of all."""
    delta = F.abs(F.col("actual") - F.col("expected")).alias("delta")
    both = expected.withColumnRenamed("score", "expected").join(actual.withColumnRenamed("score", "actual"), [*keys, "axis"]).select(*keys, "axis", delta)
    items = both.groupBy(*keys).agg(F.max("delta").alias("max_delta")).withColumn("flagged", F.col("max_delta") > threshold)
    return items, both.agg(F.max("delta").alias("max_delta"), F.avg("delta").alias("mean_delta"), F.count("*").alias("n_deltas"))


def match_calls(expected: DataFrame, predicted: DataFrame, keys: list[str], failed: DataFrame | None = None) -> DataFrame:
    """Expected against predicted calls by place (*keys, place, name, arguments): match, missing or extra.

    Of the turns in `failed` (*keys), whose request failed, every expected call is missing, with api_failed, and no predicted one counts.
    """
    lost = None if failed is None else failed.select(*keys).distinct().withColumn("api_failed", F.lit(True))
    predicted = predicted if lost is None else predicted.join(lost, keys, "left_anti")
    both = expected.select(*keys, "place", F.col("name").alias("expected_name"), F.col("arguments").alias("expected_arguments"), F.lit(True).alias("e"))
    both = both.join(predicted.select(*keys, "place", F.col("name").alias("predicted_name"), F.col("arguments").alias("predicted_arguments"), F.lit(True).alias("p")), [*keys, "place"], "full")
    kind = F.when(F.col("p").isNull(), "missing").when(F.col("e").isNull(), "extra").otherwise("match")
    both = both.withColumn("type", kind).withColumn("func_match", (kind == "match") & F.col("expected_name").eqNullSafe(F.col("predicted_name"))).drop("e", "p")
    return both if lost is None else both.join(lost, keys, "left").withColumn("api_failed", F.coalesce("api_failed", F.lit(False)))


def call_metrics(calls: DataFrame, split: str | None = None) -> DataFrame:
    """One row of metrics from calls (row, turn, type, func_match, correct, total, accuracy, similarity, api_failed).

    With `split`, a row for each of its values, and one over all with overall = 1.
    """
    valid = calls.where("NOT api_failed")
    good = (F.col("type") == "match") & (F.col("accuracy") == 1.0)
    by = [] if split is None else [split]
    turns = valid.groupBy(*by, "row", "turn").agg(
        F.bool_and(good).alias("perfect"), F.count("*").alias("n"), F.count_if("func_match").alias("functions"),
        F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.sum("similarity").alias("similarity"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    total = F.sum("n")
    grouped = turns.groupBy() if split is None else turns.groupingSets([[split], []], split)
    overall = [] if split is None else [F.grouping(split).alias("overall")]
    return grouped.agg(
        *overall, F.coalesce(total, F.lit(0)).alias("total_calls"), F.count("*").alias("total_turns"), F.coalesce(F.sum("total"), F.lit(0)).alias("total_params"),
        share(F.sum("functions"), total).alias("function_accuracy"), share(F.sum("correct"), F.sum("total")).alias("parameter_accuracy"),
        share(F.count_if("perfect"), F.count("*")).alias("turn_level_parameter_accuracy"), share(F.sum("similarity"), total).alias("argument_similarity"),
    )


def evaluator_metrics(turns: DataFrame) -> DataFrame:
    """One row of micro metrics from turns (tp, fp, fn, ref_count, model_count, name_matches, ref_names, model_names,
    json_valid, hallucinated, out_of_context); ratios are rounded to 4 places, F1 comes of the rounded ones."""
    div = lambda a, b: F.coalesce(F.round(F.try_divide(a.cast("double"), b), 4), F.lit(0.0))
    both = (F.col("ref_count") > 0) & (F.col("model_count") > 0)
    named = lambda f, a, b: F.sum(F.when(both, F.size(f(F.array_distinct(a), F.array_distinct(b)))).otherwise(0))
    parts = turns.agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "json_valid", "hallucinated", "model_count")],
        named(F.array_intersect, "ref_names", "model_names").alias("stp"),
        named(F.array_except, "model_names", "ref_names").alias("sfp"),
        named(F.array_except, "ref_names", "model_names").alias("sfn"),
        F.sum(F.when(both, F.col("name_matches") / F.greatest("ref_count", "model_count"))).alias("matched"),
        F.count_if(both).alias("pairs"),
        F.count_if(F.col("ref_count") > 0).alias("parallel"),
        F.count_if((F.col("ref_count") > 0) & (F.col("ref_count") == F.col("model_count"))).alias("same"),
        F.count_if("out_of_context").alias("outside"),
        F.count_if(F.col("out_of_context") & (F.col("model_count") == 0)).alias("refused"),
    )
    c = F.col
    first = parts.select(
        div(c("tp"), c("tp") + c("fp")).alias("tool_call_precision"), div(c("tp"), c("tp") + c("fn")).alias("tool_call_recall"),
        div(c("stp"), c("stp") + c("sfp")).alias("name_set_precision"), div(c("stp"), c("stp") + c("sfn")).alias("name_set_recall"),
        div(c("matched"), c("pairs")).alias("name_accuracy"), div(c("json_valid"), c("model_count")).alias("json_valid_rate"),
        div(c("hallucinated"), c("model_count")).alias("hallucination_rate"), div(c("same"), c("parallel")).alias("parallel_count_match"),
        F.round(F.try_divide(c("refused"), c("outside")), 4).alias("refusal_rate"),
    )
    f1 = lambda p, r: F.coalesce(F.round(F.try_divide(2 * c(p) * c(r), c(p) + c(r)), 4), F.lit(0.0))
    return first.withColumns({"tool_call_f1": f1("tool_call_precision", "tool_call_recall"), "name_set_f1": f1("name_set_precision", "name_set_recall")})


def confusion(reference_calls: Column, model_calls: Column) -> Column:
    """TP, FP, FN or TN by whether either side called a tool."""
    return F.when((reference_calls > 0) & (model_calls > 0), "TP").when(model_calls > 0, "FP").when(reference_calls > 0, "FN").otherwise("TN")


def metrics_document(items: DataFrame, validations: DataFrame, calls: DataFrame, scales: dict[str, int], totals: dict[str, float]) -> DataFrame:
    """One row (document): the metrics of a run as one JSON text, by split and over all, keys in a fixed order.

    `items` has split, verdict and scores (map of axis to score), `validations` split, kind, verdict and score, `calls` what
    `call_metrics` takes and split; `totals` are further fields of the overall part. Each part comes of one pass of grouping
    sets over (split) and (). A split that has calls or validations only is there, with nulls and zeros; without calls functionCall
    is null; a null split is named by the empty string. Means are rounded to 9 places.
    """
    named = lambda df: df.withColumn("split", F.coalesce("split", F.lit("")))
    items, validations, calls = named(items), named(validations), named(calls)
    whole = F.grouping("split").alias("overall")
    mean = lambda c: F.round(c, 9)
    axes = [mean(F.avg(F.try_element_at("scores", F.lit(a))) / s).alias(a) for a, s in scales.items()]
    verdicts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("pass", "warn", "fail")]
    judged = items.groupingSets([["split"], []], "split").agg(whole, F.struct(*axes).alias("axes"), F.struct(*verdicts).alias("verdictCounts"), F.count("*").alias("totalItems"))
    rate = lambda v: mean(F.avg((F.col("verdict") == v).cast("double"))).alias(f"{v}Rate")
    rates = F.struct(F.count("*").alias("total"), rate("pass"), rate("warn"), rate("fail"), mean(F.avg("score")).alias("meanScore"))
    checked = validations.groupingSets([["split", "kind"], ["kind"]], "split", "kind").agg(F.grouping("split").alias("overall"), rates.alias("r"))
    checked = checked.groupBy("split", "overall").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "r")))).alias("validators"))
    made = call_metrics(calls, "split")
    made = made.where("total_calls > 0").select("split", "overall", F.struct(*[mean(F.col(c).cast("double")).alias(c) if c.endswith(("accuracy", "similarity")) else F.col(c) for c in made.columns if c not in ("split", "overall")]).alias("functionCall"))
    same = lambda a, b: (a["split"].eqNullSafe(b["split"])) & (a["overall"] == b["overall"])
    keys = judged.select("split", "overall").unionAll(checked.select("split", "overall")).unionAll(made.select("split", "overall")).distinct().alias("k")
    rows = keys.join(judged, same(keys, judged), "left").join(checked, same(keys, checked), "left").join(made, same(keys, made), "left")
    zero, none = F.struct(*[F.lit(0).cast("long").alias(v) for v in ("pass", "warn", "fail")]), F.struct(*[F.lit(None).cast("double").alias(a) for a in scales])
    empty = F.create_map().cast(checked.schema["validators"].dataType)
    fields = [F.coalesce("axes", none).alias("axes"), F.coalesce("validators", empty).alias("validators"), "functionCall", F.coalesce("verdictCounts", zero).alias("verdictCounts"), F.coalesce("totalItems", F.lit(0)).alias("totalItems")]
    rows = rows.select(F.col("k.split").alias("split"), F.col("k.overall").alias("overall"), F.struct(*fields).alias("part"))
    more = [F.lit(c).alias(n) for n, c in totals.items()]
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    name = F.regexp_extract(F.to_json(F.struct(F.col("split").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    splits = F.array_sort(F.collect_list(F.when(F.col("overall") == 0, F.struct("split", F.concat(name, F.lit(":"), text("part")).alias("text")))))
    parts = rows.groupBy().agg(F.array_join(F.transform(splits, lambda x: x["text"]), ",").alias("splits"), F.max(F.when(F.col("overall") == 1, text("part"))).alias("overall"))
    # The totals stand behind the overall part's own fields.
    after = F.lit("}") if not totals else F.concat(F.when(F.col("overall").isNull(), "").otherwise(","), F.substring(text(F.struct(*more)), 2, 1 << 30))
    inner = F.concat(F.regexp_replace(F.coalesce("overall", F.lit("{}")), r"\}$", ""), after)
    return parts.select(F.concat(F.lit('{"kind":"chat-replay","splits":{'), "splits", F.lit('},"overall":'), inner, F.lit("}")).alias("document"))
