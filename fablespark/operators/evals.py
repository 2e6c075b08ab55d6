"""Measures of extraction, linking, retrieval and answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def precision_recall(predicted: DataFrame, gold: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of two row sets over their keys, in all or by a column of both."""
    by = by or []
    both = predicted.select(*keys).distinct().withColumn("_p", F.lit(1)).join(gold.select(*keys).distinct().withColumn("_g", F.lit(1)), keys, "full")
    sums = both.groupBy(*by).agg(F.count("_p").alias("n_predicted"), F.count("_g").alias("n_gold"), F.count(F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), 1)).alias("n_right"))
    p, r = F.try_divide("n_right", "n_predicted"), F.try_divide("n_right", "n_gold")
    return sums.withColumns({"precision": p, "recall": r, "f1": _f1(F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0)))})


def b_cubed(items: DataFrame, predicted: str, gold: str) -> DataFrame:
    """B-cubed over (item, predicted cluster, gold cluster).

    Counts of the cells of the two partitions give the sums, so no item meets
    another and a hot cluster is one number.
    """
    cell = items.groupBy(predicted, gold).agg(F.count("*").alias("n"))
    sized = cell.withColumn("np", F.sum("n").over(Window.partitionBy(predicted))).withColumn("ng", F.sum("n").over(Window.partitionBy(gold)))
    out = sized.agg((F.sum(F.col("n") * F.col("n") / F.col("np")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("ng")) / F.sum("n")).alias("recall"))
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def accuracy(df: DataFrame, predicted: str, gold: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg((F.col(predicted) == F.col(gold)).cast("double")).alias("accuracy"))


def direction_accuracy(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of gold edges found in the right direction among those found in either."""
    p = predicted.select("subject", "predicate", "object").distinct()
    right = gold.join(p, ["subject", "predicate", "object"], "left_semi").agg(F.count("*").alias("n_right"))
    turned = p.select(F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"))
    either = gold.join(p.unionByName(turned).distinct(), ["subject", "predicate", "object"], "left_semi").agg(F.count("*").alias("n_either"))
    return right.crossJoin(either).withColumn("direction_accuracy", F.try_divide("n_right", "n_either"))  # one row each


def link_quality(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Links (book_node, character) held against gold: false merges are counted apart from F1, as are duplicates."""
    pred, g = predicted.select("node", F.col("character").alias("_p")), gold.select("node", F.col("character").alias("_g"))
    cells = pred.join(g, "node").groupBy("_p", "_g").agg(F.count("*").alias("n"))
    merged = cells.groupBy("_p").agg(F.count("*").alias("golds")).agg(F.avg((F.col("golds") > 1).cast("double")).alias("false_merge_rate"))
    twice = cells.groupBy("_g").agg(F.count("*").alias("preds")).agg(F.avg((F.col("preds") > 1).cast("double")).alias("duplicate_rate"))
    pairs = cells.withColumn("p_n", F.sum("n").over(Window.partitionBy("_p"))).withColumn("g_n", F.sum("n").over(Window.partitionBy("_g")))
    c2 = lambda x: F.col(x) * (F.col(x) - 1) / 2
    same = pairs.agg(F.sum(c2("n")).alias("both"))
    by_p = pairs.select("_p", "p_n").distinct().agg(F.sum(c2("p_n")).alias("linked"))
    by_g = pairs.select("_g", "g_n").distinct().agg(F.sum(c2("g_n")).alias("true_links"))
    out = same.crossJoin(by_p).crossJoin(by_g).crossJoin(merged).crossJoin(twice)  # one row each
    return out.withColumns({"link_precision": F.try_divide("both", "linked"), "link_recall": F.try_divide("both", "true_links")})


def retrieval_quality(ranked: DataFrame, relevant: DataFrame, question: str, key: str, cuts: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Recall at each cut and mean reciprocal rank, over questions with relevant chunks."""
    hits = relevant.join(ranked, [question, key], "left")
    per = hits.groupBy(question).agg(*[F.avg((F.coalesce(F.col("rank"), F.lit(1 << 30)) <= c).cast("double")).alias(f"r{c}") for c in cuts], F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return per.agg(F.count("*").alias("n_questions"), *[F.avg(f"r{c}").alias(f"recall_at_{c}") for c in cuts], F.avg("rr").alias("mrr"))


def calibration_curve(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy)."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def expected_calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    c = calibration_curve(df, confidence, correct, bins)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def isotonic_bins(curve: DataFrame) -> DataFrame:
    """Calibrated accuracy a bin: pools neighbours that break the order. Works on a curve's few bins."""
    rows = [(r["bin"], float(r["n"]), r["accuracy"]) for r in curve.orderBy("bin").collect()]  # as many as bins
    pools: list[list] = []
    for b, n, a in rows:
        pools.append([[b], n, a])
        while len(pools) > 1 and pools[-2][2] > pools[-1][2]:
            x, y = pools.pop(-2), pools.pop()
            pools.append([x[0] + y[0], x[1] + y[1], (x[1] * x[2] + y[1] * y[2]) / (x[1] + y[1])])
    return curve.sparkSession.createDataFrame([(b, p[2]) for p in pools for b in p[0]], "bin int, calibrated double")


def platt_scaling(df: DataFrame, confidence: str, correct: str, levels: int = 1000, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of the sigmoid that maps a confidence to the chance that it is right.

    Fitted by Newton steps on counts by confidence level, so the data is read
    once and ``levels`` + 1 rows reach the driver, however many answers there are.
    """
    level = (F.round(F.col(confidence) * levels) / levels).alias("x")
    rows = df.groupBy(level).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("k")).filter("x is not null").orderBy("x").collect()
    x, n, k = (np.array([float(r[c]) for r in rows]) for c in ("x", "n", "k"))
    # Targets are drawn in by Platt's rule, so that clear data has a finite fit.
    hit = k * (k.sum() + 1) / (k.sum() + 2) + (n - k) / ((n - k).sum() + 2)
    slope, offset = 0.0, float(np.log((k.sum() + 1) / ((n - k).sum() + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        w = n * p * (1 - p)
        gradient = np.array([np.sum((n * p - hit) * x) + 1e-6 * slope, np.sum(n * p - hit)])
        step = np.linalg.solve(np.array([[np.sum(w * x * x) + 1e-6, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-9]]), gradient)
        step /= max(1.0, np.abs(step).max() / 5)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(slope), float(offset)


def platt_calibrated(confidence: Column, fit: tuple[float, float]) -> Column:
    return 1 / (1 + F.exp(-(F.lit(fit[0]) * confidence + F.lit(fit[1]))))


def confusion(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    return df.groupBy(actual).pivot(predicted, labels).agg(F.count(F.lit(1))).na.fill(0)


def answer_quality(answers: DataFrame) -> DataFrame:
    """Citation precision, abstention on unanswerable questions, exact set answers, and leaks past the position (must be 0)."""
    return answers.agg(
        F.try_divide(F.sum("n_supported"), F.sum("n_cited")).alias("citation_precision"),
        F.avg(F.when(~F.col("answerable"), F.col("abstained").cast("double"))).alias("abstention_rate"),
        F.avg((F.array_sort(F.array_distinct("answer_set")) == F.array_sort(F.array_distinct("gold_set"))).cast("double")).alias("exact_set_rate"),
        F.sum("n_leaked").alias("leaks"),
    )


def ablation_deltas(runs: DataFrame, baseline: str, tolerance: float = 0.02) -> DataFrame:
    """Each config's metrics against the baseline's: delta, spread over runs, and whether it regressed past the gate."""
    stats = runs.groupBy("config", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"))
    base = stats.filter(F.col("config") == baseline).select("metric", F.col("mean").alias("base"))
    return stats.join(base, "metric").withColumns({"delta": F.col("mean") - F.col("base"), "regressed": F.col("mean") - F.col("base") < -tolerance})
