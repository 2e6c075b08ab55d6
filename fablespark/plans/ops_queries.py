"""Registered queries over telemetry, review, evaluation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fablespark.operators import evals, ops
from fablespark.plans.domain import Domain, query
from fablespark.streaming import streams

#: Rows of a task where a query deals them itself, more or less.
TASK_ROWS = 500_000


@query("SELECT stage, count(*) AS n, round(sum(cost), 4) AS total_cost, round(avg(cost), 6) AS mean_cost FROM stage GROUP BY stage")
def stage_costs(d: Domain) -> DataFrame:
    return ops.stage_costs(d["stage"]).select("stage", "n", F.round("total_cost", 4).alias("total_cost"), F.round("mean_cost", 6).alias("mean_cost"))


@query("SELECT user_id, stage, round(sum(cost), 4) AS total_cost, count(*) AS n, grouping(user_id, stage) AS level FROM stage GROUP BY ROLLUP (user_id, stage)")
def cost_rollup(d: Domain) -> DataFrame:
    return ops.cost_rollup(d["stage"], "user_id", "stage").withColumn("total_cost", F.round("total_cost", 4))


@query("SELECT stage, round(quantile_cont(cost, 0.5), 6) AS p50, round(quantile_cont(cost, 0.95), 6) AS p95, round(quantile_cont(cost, 0.99), 6) AS p99 FROM stage GROUP BY stage")
def latency_percentiles(d: Domain) -> DataFrame:
    return ops.latency_percentiles(d["stage"], exact=True).select("stage", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query("SELECT user_id AS stage, count(*) AS n, round(avg(CASE WHEN failed THEN 1.0::DOUBLE ELSE 0 END), 9) AS failure_rate FROM stage GROUP BY user_id")
def failure_rates(d: Domain) -> DataFrame:
    return ops.failure_rates(d["stage"].drop("stage").withColumnRenamed("user_id", "stage")).withColumn("failure_rate", F.round("failure_rate", 9))


@query("WITH a AS (SELECT user_id AS unit, stage, failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM stage) SELECT unit, arg_max(stage, attempt) AS stage, CAST(max(attempt) AS INT) AS attempt FROM a GROUP BY unit HAVING arg_max(failed, attempt) AND max(attempt) >= 3")
def dead_letters(d: Domain) -> DataFrame:
    from pyspark.sql.window import Window

    rows = d["stage"].withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return ops.dead_letters(rows.select(F.col("user_id").alias("unit"), "stage", "failed", "attempt"), 3)


@query("WITH d AS (SELECT stage, CAST(ts AS DATE) AS day, sum(cost) AS spend FROM stage GROUP BY ALL) SELECT stage, day, round(spend, 4) AS spend, round(sum(spend) OVER (PARTITION BY stage ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 4) AS rolling FROM d")
def rolling_spend(d: Domain) -> DataFrame:
    return ops.rolling_spend(d["stage"], 7, ["stage"]).withColumns({"spend": F.round("spend", 4), "rolling": F.round("rolling", 4)})


@query("SELECT stage, round(sum(CASE WHEN failed THEN 0 ELSE cost END) / sum(cost), 9) AS hit_rate FROM stage GROUP BY stage")
def cache_hit_rate(d: Domain) -> DataFrame:
    rows = d["stage"].withColumn("hit", F.when(F.col("failed"), 0.0).otherwise(F.col("cost")))
    return ops.ratio(rows, "hit", "cost", ["stage"], "hit_rate").withColumn("hit_rate", F.round("hit_rate", 9))


TASKS = "tasks AS (SELECT event_id AS task_id, user_id AS project_id, event_type AS task_type, CASE WHEN event_id % 3 = 0 THEN 'open' WHEN event_id % 3 = 1 THEN 'resolved' ELSE 'dismissed' END AS status, value AS hours, event_id % 5 = 0 AS corrected, CAST(floor(value) AS INT) % 10 AS priority, ts AS created_at FROM events)"


def _tasks(d: Domain) -> DataFrame:
    i = F.col("event_id")
    return d["events"].select(i.alias("task_id"), F.col("user_id").alias("project_id"), F.col("event_type").alias("task_type"), F.when(i % 3 == 0, "open").when(i % 3 == 1, "resolved").otherwise("dismissed").alias("status"), F.col("value").alias("hours"), (i % 5 == 0).alias("corrected"), (F.floor("value").cast("int") % 10).alias("priority"), F.col("ts").alias("created_at"))


@query(f"WITH {TASKS} SELECT task_type, count(*) FILTER (status = 'open') AS depth, round(median(hours) FILTER (status = 'resolved'), 6) AS median_hours, round(avg(CAST(corrected AS INT)) FILTER (status = 'resolved'), 9) AS correction_rate, count(*) FILTER (status = 'open' AND hours > 48) AS overdue FROM tasks GROUP BY task_type")
def review_metrics(d: Domain) -> DataFrame:
    return ops.review_metrics(_tasks(d), exact=True).withColumns({"median_hours": F.round("median_hours", 6), "correction_rate": F.round("correction_rate", 9)})


@query(f"WITH {TASKS} SELECT task_type, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'dismissed') AS dismissed FROM tasks GROUP BY task_type")
def review_outcomes(d: Domain) -> DataFrame:
    return ops.outcome_mix(_tasks(d), ["open", "resolved", "dismissed"])


@query(f"WITH {TASKS} SELECT task_id, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, created_at, task_id) AS queue_no FROM tasks WHERE status = 'open'")
def review_queue(d: Domain) -> DataFrame:
    return ops.review_queue(_tasks(d).filter("status = 'open'")).select("task_id", "queue_no")


@query("""SELECT p_partkey AS task_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 7, p_name, p_partkey) AS by_confidence, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name, p_partkey) AS by_importance, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS by_age FROM part""")
def review_orders(d: Domain) -> DataFrame:
    """The queue by confidence, importance and age."""
    out = d["part"].select(F.col("p_partkey").alias("task_id"), F.col("p_brand").alias("project_id"), F.col("p_name").alias("created_at"), (F.col("p_size") % 7).alias("confidence"), F.col("p_size").alias("importance"))
    for order in ("confidence", "importance", "age"):
        out = ops.review_queue(out, order=order).withColumnRenamed("queue_no", f"by_{order}")
    return out.select("task_id", "by_confidence", "by_importance", "by_age")


@query("SELECT user_id AS task_id, min(event_id) AS resolution_id, arg_min(event_type, event_id) AS outcome FROM events GROUP BY user_id")
def first_resolution(d: Domain) -> DataFrame:
    rows = d["events"].select(F.col("user_id").alias("task_id"), F.col("ts").alias("resolved_at"), F.col("event_id").alias("resolution_id"), F.col("event_type").alias("outcome"))
    return ops.first_resolution(rows).select("task_id", "resolution_id", "outcome")


@query("SELECT q.event_id, p.event_id AS policy_version FROM (SELECT * FROM events WHERE event_type <> 'signup') q ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') p ON q.user_id = p.user_id AND q.event_id >= p.event_id")
def policy_as_of(d: Domain) -> DataFrame:
    e = d["events"]
    policies = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("version"))
    return ops.policy_at(e.filter("event_type <> 'signup'").select("user_id", F.col("event_id").alias("at"), "event_id"), policies, "user_id", "at").select("event_id", "policy_version")


@query("SELECT user_id AS run_id, stage, max(event_id) AS attempt, arg_max(CASE WHEN failed THEN 'failed' ELSE 'succeeded' END, event_id) AS state FROM stage GROUP BY ALL")
def stage_status(d: Domain) -> DataFrame:
    rows = d["stage"].select(F.col("user_id").alias("run_id"), "stage", F.col("event_id").alias("attempt"), F.when(F.col("failed"), "failed").otherwise("succeeded").alias("state"), F.lit(None).cast("int").alias("duration_ms"), F.lit(None).cast("string").alias("error"))
    return ops.stage_status(rows).select("run_id", "stage", "attempt", "state")


CELLS = "WITH c AS (SELECT vec_id % 12 AS p, label AS g, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY p) AS np, sum(n) OVER (PARTITION BY g) AS ng FROM c)"


@query(f"{CELLS}, r AS (SELECT sum(n * n / np) / sum(n) AS p, sum(n * n / ng) / sum(n) AS r FROM s) SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM r")
def b_cubed(d: Domain) -> DataFrame:
    rows = d["embeddings"].select((F.col("vec_id") % 12).alias("p"), F.col("label").alias("g"))
    return evals.b_cubed(rows, "p", "g").select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("WITH x AS (SELECT doc_id, doc_id % 3 = 0 AS p, toxic = 1 AS g FROM labels), s AS (SELECT count(*) FILTER (p) AS n_predicted, count(*) FILTER (g) AS n_gold, count(*) FILTER (p AND g) AS n_right FROM x) SELECT *, round(n_right / n_predicted, 9) AS precision, round(n_right / n_gold, 9) AS recall, round(2 * n_right / (n_predicted + n_gold), 9) AS f1 FROM s")
def roster_prf(d: Domain) -> DataFrame:
    out = evals.precision_recall(d["labels"].filter("doc_id % 3 = 0"), d["labels"].filter("toxic = 1"), ["doc_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("WITH p AS (SELECT DISTINCT subject, predicate, object FROM assertion WHERE book_order <= 3), g AS (SELECT DISTINCT subject, predicate, object FROM assertion WHERE book_order >= 2 AND chapter <= 2), s AS (SELECT predicate, count(p.subject) AS n_predicted, count(g.subject) AS n_gold, count(*) FILTER (p.subject IS NOT NULL AND g.subject IS NOT NULL) AS n_right FROM (SELECT * FROM p) p FULL JOIN (SELECT * FROM g) g USING (subject, predicate, object) GROUP BY predicate) SELECT predicate, n_predicted, n_gold, n_right, round(n_right / n_predicted, 9) AS precision, round(n_right / n_gold, 9) AS recall FROM s")
def relation_prf(d: Domain) -> DataFrame:
    a = d["assertion"]
    out = evals.precision_recall(a.filter("book_order <= 3"), a.filter("book_order >= 2 and chapter <= 2"), ["subject", "predicate", "object"], ["predicate"])
    return out.select("predicate", "n_predicted", "n_gold", "n_right", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("WITH p AS (SELECT DISTINCT subject, predicate, object FROM assertion WHERE page % 40 = 0), g AS (SELECT DISTINCT subject, predicate, object FROM assertion WHERE page % 40 = 1) SELECT (SELECT count(*) FROM g SEMI JOIN p USING (subject, predicate, object)) AS n_right, (SELECT count(*) FROM g WHERE EXISTS (SELECT 1 FROM p WHERE p.predicate = g.predicate AND ((p.subject = g.subject AND p.object = g.object) OR (p.subject = g.object AND p.object = g.subject)))) AS n_either")
def direction_accuracy(d: Domain) -> DataFrame:
    a = d["assertion"].select("subject", "predicate", "object", "page")
    return evals.direction_accuracy(a.filter("page % 40 = 0"), a.filter("page % 40 = 1").select("subject", "predicate", "object").distinct()).select("n_right", "n_either")


@query(f"{CELLS} SELECT (SELECT sum(n * (n - 1) / 2) FROM s) AS both, (SELECT sum(np * (np - 1) / 2) FROM (SELECT DISTINCT p, np FROM s)) AS linked, (SELECT sum(ng * (ng - 1) / 2) FROM (SELECT DISTINCT g, ng FROM s)) AS true_links, (SELECT round(avg(CASE WHEN k > 1 THEN 1.0::DOUBLE ELSE 0 END), 9) FROM (SELECT p, count(*) AS k FROM s GROUP BY p)) AS false_merge_rate, (SELECT round(avg(CASE WHEN k > 1 THEN 1.0::DOUBLE ELSE 0 END), 9) FROM (SELECT g, count(*) AS k FROM s GROUP BY g)) AS duplicate_rate")
def link_quality(d: Domain) -> DataFrame:
    e = d["embeddings"]
    out = evals.link_quality(e.select(F.col("vec_id").alias("node"), (F.col("vec_id") % 12).alias("character")), e.select(F.col("vec_id").alias("node"), F.col("label").alias("character")))
    return out.select("both", "linked", "true_links", F.round("false_merge_rate", 9).alias("false_merge_rate"), F.round("duplicate_rate", 9).alias("duplicate_rate"))


@query("WITH r AS (SELECT l_orderkey AS q, l_suppkey AS k, min(l_linenumber) AS rank FROM lineitem GROUP BY ALL), g AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS k FROM lineitem WHERE l_quantity > 30), p AS (SELECT g.q, avg(CASE WHEN r.rank <= 2 THEN 1.0::DOUBLE ELSE 0 END) AS r2, avg(CASE WHEN r.rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS r5, 1.0::DOUBLE / min(r.rank) AS rr FROM g LEFT JOIN r USING (q, k) GROUP BY g.q) SELECT count(*) AS n_questions, round(avg(r2), 9) AS recall_at_2, round(avg(r5), 9) AS recall_at_5, round(avg(rr), 9) AS mrr FROM p")
def recall_mrr(d: Domain) -> DataFrame:
    li = d["lineitem"].select(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("rank"), "l_quantity")
    # All steps go by the question, so they share one deal of the rows, into as many tasks as these need.
    li = li.repartition(max(2, 1 + li.count() // TASK_ROWS), "q")
    out = evals.retrieval_quality(li.groupBy("q", "k").agg(F.min("rank").alias("rank")), li.filter("l_quantity > 30").select("q", "k").distinct(), "q", "k", (2, 5))
    return out.select("n_questions", *[F.round(c, 9).alias(c) for c in ("recall_at_2", "recall_at_5", "mrr")])


CURVE = "WITH x AS (SELECT confidence, assertion_type = 'narrated' AS correct FROM assertion ), b AS (SELECT CAST(least(floor(confidence * 20), 19) AS INT) AS bin, confidence, correct FROM x), c AS (SELECT bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(CAST(correct AS INT)) AS accuracy FROM b GROUP BY bin)"


@query(f"{CURVE} SELECT bin, n, round(mean_confidence, 9) AS mean_confidence, round(accuracy, 9) AS accuracy FROM c")
def calibration_curve(d: Domain) -> DataFrame:
    rows = d["assertion"].withColumn("correct", F.col("assertion_type") == "narrated")
    return evals.calibration_curve(rows, "confidence", "correct", 20).withColumns({"mean_confidence": F.round("mean_confidence", 9), "accuracy": F.round("accuracy", 9)})


@query(f"{CURVE} SELECT round(sum(n * abs(mean_confidence - accuracy)) / sum(n), 9) AS ece FROM c")
def ece(d: Domain) -> DataFrame:
    rows = d["assertion"].withColumn("correct", F.col("assertion_type") == "narrated")
    return evals.expected_calibration_error(rows, "confidence", "correct", 20).withColumn("ece", F.round("ece", 9))


@query(f"""{CURVE}, spans AS (SELECT x.bin AS lo, y.bin AS hi, sum(c.n * c.accuracy) / sum(c.n) AS mean FROM c x JOIN c y ON x.bin <= y.bin JOIN c ON c.bin BETWEEN x.bin AND y.bin GROUP BY ALL),
least AS (SELECT b.bin, lo, min(mean) AS mean FROM c b JOIN spans ON lo <= b.bin AND hi >= b.bin GROUP BY ALL) SELECT bin, round(max(mean), 9) AS calibrated FROM least GROUP BY bin""")
def isotonic_calibration(d: Domain) -> DataFrame:
    """Pooling neighbours gives the greatest of the least means of the spans around a bin, as the SQL says."""
    rows = d["assertion"].withColumn("correct", F.col("assertion_type") == "narrated")
    return evals.isotonic_bins(evals.calibration_curve(rows, "confidence", "correct", 20)).withColumn("calibrated", F.round("calibrated", 9))


@query("SELECT event_type AS actual, count(*) FILTER (user_id % 3 = 0) AS low, count(*) FILTER (user_id % 3 = 1) AS mid, count(*) FILTER (user_id % 3 = 2) AS high FROM events GROUP BY 1")
def router_confusion(d: Domain) -> DataFrame:
    u = F.col("user_id") % 3
    rows = d["events"].select(F.col("event_type").alias("actual"), F.when(u == 0, "low").when(u == 1, "mid").otherwise("high").alias("predicted"))
    return evals.confusion(rows, "actual", "predicted", ["low", "mid", "high"])


@query("SELECT round(sum(l_linenumber % 4) / sum(l_linenumber), 9) AS citation_precision, round(avg(CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END END), 9) AS abstention_rate, round(avg(CASE WHEN l_partkey % 5 = l_suppkey % 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS exact_set_rate, CAST(0 AS BIGINT) AS leaks FROM lineitem")
def answer_quality(d: Domain) -> DataFrame:
    rows = d["lineitem"].select((F.col("l_linenumber") % 4).alias("n_supported"), F.col("l_linenumber").alias("n_cited"), (F.col("l_returnflag") != "N").alias("answerable"), (F.col("l_linestatus") == "O").alias("abstained"), F.array(F.col("l_partkey") % 5, F.col("l_partkey") % 5).alias("answer_set"), F.array(F.col("l_suppkey") % 5).alias("gold_set"), F.lit(0).alias("n_leaked"))
    return evals.answer_quality(rows).select(*[F.round(c, 9).alias(c) for c in ("citation_precision", "abstention_rate", "exact_set_rate")], "leaks")


@query("WITH s AS (SELECT CAST(user_id % 4 AS VARCHAR) AS config, event_type AS metric, avg(value) / 100 AS mean, stddev_samp(value) / 100 AS spread FROM events GROUP BY ALL), b AS (SELECT metric, mean AS base FROM s WHERE config = '0') SELECT config, metric, round(mean - base, 9) AS delta, round(spread, 9) AS spread, mean - base < -0.02 AS regressed FROM s JOIN b USING (metric)")
def ablation_deltas(d: Domain) -> DataFrame:
    rows = d["events"].select((F.col("user_id") % 4).cast("string").alias("config"), F.col("event_type").alias("metric"), (F.col("value") / 100).alias("value"))
    return evals.ablation_deltas(rows, "0").select("config", "metric", F.round("delta", 9).alias("delta"), F.round("spread", 9).alias("spread"), "regressed")


@query("SELECT (quality = 1) AS kept, count(*) AS n, round(avg(CASE WHEN toxic = quality THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM labels GROUP BY 1")
def tier_accuracy(d: Domain) -> DataFrame:
    return evals.accuracy(d["labels"].withColumn("kept", F.col("quality") == 1), "toxic", "quality", ["kept"]).withColumn("accuracy", F.round("accuracy", 9))


@query("WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, epoch(min(ts))::BIGINT AS start_s, count(*) AS turns, max(value) AS peak FROM s GROUP BY user_id, n")
def conversation_sessions(d: Domain) -> DataFrame:
    rows = d["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(rows, gap="12 hours").select("user_id", F.round(F.unix_micros("start") / 1e6).cast("long").alias("start_s"), "turns", "peak")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_type || '-' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried_scope FROM events")
def carried_scope(d: Domain) -> DataFrame:
    rows = d["events"].withColumn("scope", F.when(F.col("event_type") == "view", F.concat_ws("-", "event_type", "event_id")))
    return streams.carried_scope(rows, "user_id", "event_id", "scope").select("event_id", "carried_scope")


@query("SELECT event_id AS task_id FROM events WHERE event_type = 'error' AND event_id % 3 <> 1")
def pending_threads(d: Domain) -> DataFrame:
    tasks = d["events"].filter("event_type = 'error'").select(F.col("event_id").alias("task_id"))
    return streams.pending_threads(tasks, d["events"].filter("event_id % 3 = 1").select(F.col("event_id").alias("task_id")))


@query("SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOURS")
def expired_threads(d: Domain) -> DataFrame:
    threads = d["events"].groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    return streams.expired(threads, "2024-01-30 12:00:00").select("user_id")


@query("WITH w AS (SELECT CAST(ts AS DATE) AS day, stage, round(sum(cost), 4) AS spend, count(*) AS n FROM stage GROUP BY ALL) SELECT * FROM w WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM stage) - INTERVAL 2 DAYS")
def stream_spend(d: Domain) -> DataFrame:
    """Daily spend from the stream: windows that the 48-hour watermark has passed."""
    import uuid

    from fablespark.operators.components import checkpoint_folder

    folder = f"{checkpoint_folder(d.spark)}/spend_{uuid.uuid4().hex}"
    raw = d.spark.readStream.schema(d["events"].schema).option("pathGlobFilter", "events.parquet").parquet(d.sf_dir)
    stream = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.col("value").alias("cost"))
    spent = streams.run_available(streams.tumbling_spend(stream), f"{folder}/table", f"{folder}/progress")
    return spent.select(F.to_date("start").alias("day"), "stage", F.round("spend", 4).alias("spend"), "n")
