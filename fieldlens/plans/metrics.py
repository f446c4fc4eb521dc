"""Metric queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldlens.operators import metrics as M
from fieldlens.plans.registry import query


@query("rolling_meter",
    "SELECT meter, step, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS most, value AS last, quantile_disc(value, 0.5) OVER "
    "w AS middle FROM fx_metric_log WINDOW w AS (PARTITION BY meter ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def rolling(t):
    return M.rolling(t.metric_log).withColumn("mean", F.round("mean", 6))


@query("metric_meter", "SELECT meter, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM fx_metric_log GROUP BY 1")
def meter(t):
    return M.meters(t.metric_log).withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("metric_rank_mean", "SELECT meter, step // 8 AS step, round(avg(value), 6) AS mean FROM fx_metric_log GROUP BY ALL")
def rank_mean(t):
    """The ranks' values of eight events are those of a step."""
    return M.rank_means(t.metric_log.withColumn("step", F.floor(F.col("step") / 8))).withColumn("mean", F.round("mean", 6))


_BATCHES = "SELECT event_type AS meter, event_id // 300 AS epoch, row_number() OVER (PARTITION BY event_type, event_id // 300 ORDER BY event_id) - 1 AS batch, value FROM events"


@query("block_loss",
    "SELECT meter, epoch, batch // 10 AS block, epoch * any_value(n) + max(batch) AS step, round(avg(value), 6) AS loss FROM (SELECT *, "
    f"count(*) OVER (PARTITION BY meter, epoch) AS n FROM ({_BATCHES})) GROUP BY 1, 2, 3 HAVING count(*) = 10")
def block(t):
    log = t.metric_log.withColumn("epoch", F.floor(F.col("step") / 300))
    batch = F.row_number().over(Window.partitionBy("meter", "epoch").orderBy("step")) - 1
    return M.block_means(log.withColumn("batch", batch.cast("long"))).withColumn("loss", F.round("loss", 6))
