"""Classification, latency and contract measures as single aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import ratio, words
from corvane.operators.quality import RUNTIME_ISSUES

COUNTS = ("examples", "valid_outputs", "category_correct", "observation_matches", "signal_tp", "signal_fp", "signal_fn", "ordinary_controls", "ordinary_with_extra_signals")


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def case_measures(cases: DataFrame) -> DataFrame:
    """0 or 1 (or a number of signals) for each measure of each case.

    cases: gold_category, gold_signals, gold_issues, the same with pred_, case_kind, seconds.
    An output that the model didn't complete counts as a category, never as a match.
    """
    c = F.col
    valid = ~F.arrays_overlap(c("pred_issues"), words(*RUNTIME_ISSUES))
    category = c("gold_category") == c("pred_category")
    extra = F.size(F.array_except("pred_signals", "gold_signals"))
    ordinary = c("case_kind") == "ordinary"
    match = valid & category & same_set(c("gold_signals"), c("pred_signals")) & same_set(c("gold_issues"), c("pred_issues"))
    measures = {
        "examples": F.lit(1), "valid_outputs": valid, "category_correct": category, "observation_matches": match,
        "signal_tp": F.size(F.array_intersect("gold_signals", "pred_signals")), "signal_fp": extra, "signal_fn": F.size(F.array_except("gold_signals", "pred_signals")),
        "ordinary_controls": ordinary, "ordinary_with_extra_signals": ordinary & (extra > 0),
    }
    return cases.withColumns({f"m_{k}": F.coalesce(v.cast("long"), F.lit(0).cast("long")) for k, v in measures.items()})


def summary_columns() -> list[Column]:
    sums = {k: F.coalesce(F.sum(f"m_{k}"), F.lit(0)).cast("long") for k in COUNTS}
    tp, fp, fn = sums["signal_tp"], sums["signal_fp"], sums["signal_fn"]
    rates = {
        "category_accuracy": ratio(sums["category_correct"], sums["examples"]),
        "observation_match_rate": ratio(sums["observation_matches"], sums["examples"]),
        "signal_precision": ratio(tp, tp + fp),
        "signal_recall": ratio(tp, tp + fn),
        "signal_f1": ratio(2 * tp, 2 * tp + fp + fn),
        "ordinary_extra_signal_rate": ratio(sums["ordinary_with_extra_signals"], sums["ordinary_controls"]),
    }
    return [*[v.alias(k) for k, v in sums.items()], *[v.alias(k) for k, v in rates.items()], F.round(F.avg("seconds"), 3).alias("mean_seconds")]


def summarise(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row of counts and rates: in total, and for each value of each column in ``by``, by grouping sets."""
    measured = case_measures(cases)
    if not by:
        return measured.agg(*summary_columns())
    sets = [[], *[[F.col(x)] for x in by]]
    grouped = measured.groupingSets(sets, *[F.col(x) for x in by])
    return grouped.agg(*summary_columns())


def latency(rows: DataFrame, suite: str, seconds: str) -> DataFrame:
    """Mean and nearest-rank 95th percentile of each suite."""
    return rows.groupBy(F.col(suite).alias("suite")).agg(
        F.count("*").alias("n"), F.round(F.avg(seconds), 3).alias("mean_seconds"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {seconds})").alias("p95_seconds")
    )


def check_counts(rows: DataFrame, suite: str, checks: str) -> DataFrame:
    """suite, check, passed and total, from a map of check results; the check ``*`` is that all of a row's hold."""
    every = F.concat(F.map_entries(checks), F.array(F.struct(F.lit("*").alias("key"), F.forall(F.map_values(checks), lambda x: x).alias("value"))))
    each = rows.select(F.col(suite).alias("suite"), F.explode(every).alias("c"))
    return each.groupBy("suite", F.col("c.key").alias("check")).agg(F.count_if(F.col("c.value")).alias("passed"), F.count("*").alias("total"))


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that differ, with both values; a row of one side only differs too."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def best_checkpoint(history: DataFrame, run: str, epoch: str, order: list[Column]) -> DataFrame:
    """The first epoch of each run that no other beats; ``order`` is best first."""
    ranked = history.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(*order, epoch)))
    return ranked.where("_n = 1").drop("_n")


def weighted_mean(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Weight sums and weighted means; null where nothing weighs."""
    total = F.sum(weight)
    return rows.groupBy(*by).agg(total.alias("weight_sum"), (F.sum(F.col(weight) * F.col(value)) / F.nullif(total, F.lit(0.0))).alias("weighted_mean"))


def length_summary(rows: DataFrame, by: str, length: str, completion: str) -> DataFrame:
    """Shortest, longest and mean token length of each split, and the longest completion."""
    return rows.groupBy(F.col(by).alias("split")).agg(
        F.min(length).alias("min_tokens"), F.max(length).alias("max_tokens"), F.round(F.avg(length), 2).alias("mean_tokens"), F.max(completion).alias("max_completion_tokens")
    )
