"""Reduce large tables and event streams to the few rows a chart needs."""

from chartfold.functions.measures import Measure, count, exact_total, greatest, least, mean, total
from chartfold.operators.bins import density2d, heatmap, heatmap_wide, histogram
from chartfold.operators.distribution import box_summary, ecdf
from chartfold.operators.fit import corr_matrix, trend_line
from chartfold.operators.sample import keyed_sample
from chartfold.operators.series import bucket_series, dense_series, moving_avg, ohlc
from chartfold.operators.shares import cumulative, funnel, topk_share
from chartfold.operators.totals import grouped_totals, hierarchy
from chartfold.plans.eager import Lookup
from chartfold.plans.running import running_total
from chartfold.plans.session import session
from chartfold.sources.tables import load, load_stream
from chartfold.streaming.live import append_series, drain_series, latest_series, live_series, upsert_series

__all__ = [
    "Lookup", "Measure", "append_series", "box_summary", "bucket_series", "corr_matrix", "count",
    "cumulative", "dense_series", "density2d", "drain_series", "ecdf", "exact_total", "funnel", "greatest", "grouped_totals",
    "heatmap", "heatmap_wide", "hierarchy", "histogram", "keyed_sample", "latest_series", "least",
    "live_series", "load", "load_stream", "mean", "moving_avg", "ohlc", "running_total", "session",
    "topk_share", "total", "trend_line", "upsert_series",
]
