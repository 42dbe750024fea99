"""Registered queries: every operator over whole fixture tables, with its SQL.

``QUERIES`` maps a name to ``(spark, directory) -> DataFrame`` and ``SQL`` maps
the same name to a statement for the oracle.  Floating results are rounded on
both sides, as the order of summation differs between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import chartfold as cf
from chartfold.sources.scratch import shared_dir

QUERIES = {}
SQL = {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def _hundredths(column: str):
    """A money or percentage column of two decimals, as a whole number."""
    return F.rint(F.col(column) * 100).cast("bigint")


def _revenue() -> cf.Measure:
    units = _hundredths("l_extendedprice") * (100 - _hundredths("l_discount"))
    return cf.exact_total("revenue", units, scale=4)


SQL_REVENUE = (
    "sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))"
)


def _places(spark: SparkSession, d: str) -> list[cf.Lookup]:
    return [
        cf.Lookup(cf.load(spark, d, "nation"), "c_nationkey", "n_nationkey", small=True),
        cf.Lookup(cf.load(spark, d, "region"), "n_regionkey", "r_regionkey", small=True),
    ]


def _daily_events(spark: SparkSession, d: str, by=()) -> DataFrame:
    return cf.dense_series(cf.load(spark, d, "events"), "ts", "day", by)


# --- totals -----------------------------------------------------------------


@query(f"""
    SELECT r_name, count(*) AS items, round(CAST({SQL_REVENUE} AS DOUBLE), 2) AS revenue
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name
""")
def grouped_totals(spark, d):
    return cf.grouped_totals(
        cf.load(spark, d, "lineitem"), "r_name",
        [cf.count("items"), _revenue()],
        [
            cf.Lookup(cf.load(spark, d, "orders"), "l_orderkey", "o_orderkey"),
            cf.Lookup(cf.load(spark, d, "customer"), "o_custkey", "c_custkey"),
            *_places(spark, d),
        ],
    ).withColumn("revenue", F.round(F.col("revenue").cast("double"), 2))


@query("""
    SELECT r_name, n_name,
           CAST(CASE WHEN grouping(r_name) = 1 THEN 0 WHEN grouping(n_name) = 1 THEN 1 ELSE 2 END AS INTEGER) AS depth,
           count(*) AS customers,
           round(CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE), 2) AS balance
    FROM customer
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name)
""")
def hierarchy(spark, d):
    return cf.hierarchy(
        cf.load(spark, d, "customer"), ["r_name", "n_name"],
        [cf.count("customers"), cf.exact_total("balance", _hundredths("c_acctbal"), 2)],
        _places(spark, d),
    ).withColumn("balance", F.round(F.col("balance").cast("double"), 2))


# --- series -----------------------------------------------------------------


@query("""
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders,
           round(CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE), 2) AS amount
    FROM orders GROUP BY 1
""")
def bucket_series(spark, d):
    return cf.bucket_series(
        cf.load(spark, d, "orders"), "o_orderdate", "month",
        [cf.count("orders"), cf.exact_total("amount", _hundredths("o_totalprice"), 2)],
        out="month",
    ).withColumn("amount", F.round(F.col("amount").cast("double"), 2))


@query("""
    SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, max(value) AS peak
    FROM events GROUP BY 1, 2
""")
def bucket_series_hourly(spark, d):
    return cf.bucket_series(
        cf.load(spark, d, "events"), "ts", "hour",
        [cf.count(), cf.greatest("peak", F.col("value"))], "event_type", out="hour",
    )


@query("""
    WITH days AS (
        SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day
    ), types AS (SELECT DISTINCT event_type FROM events),
    daily AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT types.event_type, days.day, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM days CROSS JOIN types
    LEFT JOIN daily ON daily.day = days.day AND daily.event_type = types.event_type
""")
def dense_series(spark, d):
    return cf.dense_series(
        cf.load(spark, d, "events"), "ts", "day", "event_type", "2024-01-01", "2024-02-05", out="day"
    )


@query("""
    WITH ends AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders),
    days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ends),
    daily AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
    SELECT days.day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM days LEFT JOIN daily USING (day)
""")
def dense_series_from_data(spark, d):
    return cf.dense_series(cf.load(spark, d, "orders"), "o_orderdate", "day", out="day")


@query("""
    WITH daily AS (SELECT CAST(ts AS DATE) AS bucket, count(*) AS n FROM events GROUP BY 1)
    SELECT bucket, n,
           round(avg(n) OVER (ORDER BY bucket ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS moving_avg
    FROM daily
""")
def moving_avg(spark, d):
    return cf.moving_avg(_daily_events(spark, d), "bucket", "n", 7).withColumn(
        "moving_avg", F.round("moving_avg", 4)
    )


@query("""
    WITH ends AS (
        SELECT o_orderpriority, min(CAST(o_orderdate AS DATE)) AS first FROM orders GROUP BY 1
    ), span AS (SELECT min(first) AS a, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) AS b FROM ends),
    days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS bucket FROM span),
    daily AS (
        SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS bucket, count(*) AS n FROM orders GROUP BY 1, 2
    ), dense AS (
        SELECT ends.o_orderpriority, days.bucket, CAST(coalesce(n, 0) AS BIGINT) AS n
        FROM days CROSS JOIN ends
        LEFT JOIN daily ON daily.bucket = days.bucket AND daily.o_orderpriority = ends.o_orderpriority
    )
    SELECT o_orderpriority, bucket, n,
           round(avg(n) OVER (PARTITION BY o_orderpriority ORDER BY bucket
                              ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 4) AS moving_avg
    FROM dense
""")
def moving_avg_by_priority(spark, d):
    daily = cf.dense_series(cf.load(spark, d, "orders"), "o_orderdate", "day", "o_orderpriority")
    return cf.moving_avg(daily, "bucket", "n", 30, "o_orderpriority").withColumn(
        "moving_avg", F.round("moving_avg", 4)
    )


@query("""
    WITH ends AS (SELECT min(date_trunc('hour', ts)) AS a, max(date_trunc('hour', ts)) AS b FROM events),
    hours AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS bucket FROM ends),
    types AS (SELECT DISTINCT event_type FROM events),
    hourly AS (SELECT event_type, date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2),
    dense AS (
        SELECT types.event_type, hours.bucket, CAST(coalesce(n, 0) AS BIGINT) AS n
        FROM hours CROSS JOIN types
        LEFT JOIN hourly ON hourly.bucket = hours.bucket AND hourly.event_type = types.event_type
    )
    SELECT event_type, bucket, n,
           round(avg(n) OVER (PARTITION BY event_type ORDER BY bucket
                              ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS moving_avg
    FROM dense
""")
def moving_avg_hourly(spark, d):
    hourly = cf.dense_series(cf.load(spark, d, "events"), "ts", "hour", "event_type")
    return cf.moving_avg(hourly, "bucket", "n", 24, "event_type").withColumn(
        "moving_avg", F.round("moving_avg", 4)
    )


@query("""
    SELECT event_type, CAST(ts AS DATE) AS day, arg_min(value, ts) AS open, max(value) AS high,
           min(value) AS low, arg_max(value, ts) AS close, count(*) AS n
    FROM events GROUP BY 1, 2
""")
def ohlc(spark, d):
    return cf.ohlc(cf.load(spark, d, "events"), "ts", "value", "day", "event_type", out="day")


# --- bins -------------------------------------------------------------------


def _sql_histogram(table: str, value: str, bins: int) -> str:
    return f"""
    WITH ends AS (SELECT min({value}) AS lo, (max({value}) - min({value})) / {bins} AS w FROM {table}),
    near AS (
        SELECT {value} AS v, lo, w, CAST(floor(({value} - lo) / w) AS BIGINT) AS b FROM {table} CROSS JOIN ends
    ), counts AS (
        SELECT greatest(0, least(CASE WHEN v < lo + b * w THEN b - 1 WHEN v >= lo + (b + 1) * w THEN b + 1 ELSE b END,
                                 {bins - 1})) AS bin, count(*) AS n
        FROM near GROUP BY 1
    ), frame AS (SELECT unnest(generate_series(0, {bins - 1})) AS bin)
    SELECT CAST(frame.bin AS INTEGER) AS bin, round(lo + frame.bin * w, 6) AS bin_lo,
           round(lo + (frame.bin + 1) * w, 6) AS bin_hi, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM frame CROSS JOIN ends LEFT JOIN counts ON counts.bin = frame.bin
    """


def _rounded_edges(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("bin_lo", "bin_hi")})


@query(_sql_histogram("events", "value", 20))
def histogram(spark, d):
    return _rounded_edges(cf.histogram(cf.load(spark, d, "events"), "value", 20))


@query(_sql_histogram("lineitem", "l_extendedprice", 50))
def histogram_price(spark, d):
    return _rounded_edges(cf.histogram(cf.load(spark, d, "lineitem"), "l_extendedprice", 50))


@query("""
    SELECT CAST(isodow(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n
    FROM events GROUP BY 1, 2
""")
def heatmap(spark, d):
    events = cf.load(spark, d, "events").select(
        (F.weekday("ts") + 1).alias("weekday"), F.hour("ts").alias("hour")
    )
    return cf.heatmap(events, "weekday", "hour")


@query("""
    SELECT event_type, """ + ", ".join(
        f'CAST(sum(CASE WHEN isodow(ts) = {i} THEN 1 ELSE 0 END) AS BIGINT) AS {name}'
        for i, name in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"), 1)
    ) + " FROM events GROUP BY event_type")
def heatmap_wide(spark, d):
    events = cf.load(spark, d, "events").select("event_type", (F.weekday("ts") + 1).alias("weekday"))
    wide = cf.heatmap_wide(events, "event_type", "weekday", [1, 2, 3, 4, 5, 6, 7])
    return wide.toDF("event_type", "mon", "tue", "wed", "thu", "fri", "sat", "sun")


@query("""
    SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS x_bin,
           CAST(floor(l_extendedprice / 10000) AS BIGINT) AS y_bin,
           floor(l_quantity / 5) * 5.0 AS x_lo, floor(l_extendedprice / 10000) * 10000.0 AS y_lo,
           count(*) AS n
    FROM lineitem GROUP BY 1, 2, 3, 4
""")
def density2d(spark, d):
    return cf.density2d(cf.load(spark, d, "lineitem"), "l_quantity", 5, "l_extendedprice", 10000)


# --- distribution -----------------------------------------------------------


def _sql_box(table: str, value: str, by: str) -> str:
    return f"""
    WITH q AS (
        SELECT {by} AS g, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
               quantile_cont({value}, 0.75) AS q3
        FROM {table} GROUP BY 1
    ), f AS (SELECT *, {value} BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside
             FROM {table} JOIN q ON {by} = g)
    SELECT {by}, count(*) AS n, round(min({value}), 4) AS min,
           round(min(CASE WHEN inside THEN {value} END), 4) AS whisker_lo,
           round(max(q1), 4) AS q1, round(max(median), 4) AS median, round(max(q3), 4) AS q3,
           round(max(CASE WHEN inside THEN {value} END), 4) AS whisker_hi, round(max({value}), 4) AS max,
           CAST(sum(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS outliers
    FROM f GROUP BY {by}
    """


def _rounded_box(df: DataFrame) -> DataFrame:
    return df.withColumns({
        c: F.round(c, 4) for c in ("min", "whisker_lo", "q1", "median", "q3", "whisker_hi", "max")
    })


@query(_sql_box("events", "value", "event_type"))
def box_summary(spark, d):
    return _rounded_box(cf.box_summary(cf.load(spark, d, "events"), "value", "event_type"))


@query(_sql_box("lineitem", "l_extendedprice", "l_returnflag"))
def box_summary_price(spark, d):
    return _rounded_box(cf.box_summary(cf.load(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"))


def _sql_ecdf(table: str, value: str, by: str) -> str:
    return f"""
    SELECT DISTINCT {by}, {value}, count(*) OVER (PARTITION BY {by}, {value}) AS n,
           cume_dist() OVER (PARTITION BY {by} ORDER BY {value}) AS cume_dist
    FROM {table}
    """


@query(_sql_ecdf("customer", "c_acctbal", "c_mktsegment"))
def ecdf(spark, d):
    return cf.ecdf(cf.load(spark, d, "customer"), "c_acctbal", "c_mktsegment")


@query(_sql_ecdf("lineitem", "l_extendedprice", "l_returnflag"))
def ecdf_price(spark, d):
    return cf.ecdf(cf.load(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")


# --- fit --------------------------------------------------------------------

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in MEASURES for b in MEASURES
))
def corr_matrix(spark, d):
    return cf.corr_matrix(cf.load(spark, d, "lineitem"), MEASURES).withColumn("corr", F.round("corr", 6))


@query("""
    SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
           round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
           min(l_quantity) AS x_min, max(l_quantity) AS x_max, count(*) AS n
    FROM lineitem GROUP BY 1
""")
def trend_line(spark, d):
    lines = cf.trend_line(cf.load(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return lines.withColumns({
        "slope": F.round("slope", 4), "intercept": F.round("intercept", 4), "r2": F.round("r2", 6),
    })


# --- shares -----------------------------------------------------------------


@query("""
    WITH g AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1)
    SELECT p_type, n,
           CAST(sum(n) OVER (ORDER BY n DESC, p_type ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative,
           CAST(sum(n) OVER (ORDER BY n DESC, p_type ROWS UNBOUNDED PRECEDING) AS DOUBLE)
               / CAST(sum(n) OVER () AS DOUBLE) AS cumulative_share
    FROM g
""")
def cumulative(spark, d):
    return cf.cumulative(cf.load(spark, d, "part"), "p_type")


@query("""
    WITH g AS (
        SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem GROUP BY 1
    )
    SELECT l_partkey, CAST(quantity AS BIGINT) AS quantity,
           CAST(sum(quantity) OVER w AS BIGINT) AS cumulative,
           CAST(sum(quantity) OVER w AS DOUBLE) / CAST(sum(quantity) OVER () AS DOUBLE) AS cumulative_share
    FROM g WINDOW w AS (ORDER BY quantity DESC, l_partkey ROWS UNBOUNDED PRECEDING)
""")
def cumulative_by_part(spark, d):
    return cf.cumulative(
        cf.load(spark, d, "lineitem"), "l_partkey",
        cf.total("quantity", F.col("l_quantity").cast("bigint")),
    )


@query("""
    WITH g AS (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS place FROM g)
    SELECT CASE WHEN place <= 5 THEN p_brand END AS p_brand, place > 5 AS is_other,
           CAST(sum(n) AS BIGINT) AS n,
           CAST(sum(n) AS DOUBLE) / (SELECT CAST(sum(n) AS DOUBLE) FROM g) AS share
    FROM r GROUP BY 1, 2
""")
def topk_share(spark, d):
    return cf.topk_share(
        cf.load(spark, d, "lineitem"), "p_brand", 5,
        lookups=[cf.Lookup(cf.load(spark, d, "part"), "l_partkey", "p_partkey")],
    )


@query("""
    WITH u AS (
        SELECT user_id, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS a,
               max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS b,
               max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS c
        FROM events GROUP BY 1
    )
    SELECT 1 AS step, 'view' AS event_type, CAST(sum(a) AS BIGINT) AS users FROM u
    UNION ALL SELECT 2, 'click', CAST(sum(a * b) AS BIGINT) FROM u
    UNION ALL SELECT 3, 'purchase', CAST(sum(a * b * c) AS BIGINT) FROM u
""")
def funnel(spark, d):
    return cf.funnel(cf.load(spark, d, "events"), "user_id", "event_type", ["view", "click", "purchase"])


@query("SELECT event_id, ts, value FROM events WHERE event_id % 97 = 13")
def keyed_sample(spark, d):
    # the remainder filter is the operator itself
    return cf.keyed_sample(cf.load(spark, d, "events").select("event_id", "ts", "value"), "event_id", 97, 13)


# --- streams ----------------------------------------------------------------


def _upserted(spark: SparkSession, d: str, **windows) -> DataFrame:
    """Drain the event files through an update-mode stream and read its sink."""
    series = cf.live_series(
        cf.load_stream(spark, d), "ts", by="event_type", watermark="1 hour",
        measures=[cf.count(), cf.greatest("peak", F.col("value"))], **windows,
    )
    out = shared_dir(spark, "live")
    cf.upsert_series(series, f"{out}/series", f"{out}/state", True).awaitTermination()
    return cf.latest_series(spark, f"{out}/series", series.schema, "event_type")


@query("""
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
           event_type, count(*) AS n, max(value) AS peak
    FROM events GROUP BY 1, 2, 3
""")
def live_series(spark, d):
    return _upserted(spark, d, window="1 day")


@query("""
    WITH e AS (
        SELECT date_trunc('day', ts) + INTERVAL 12 HOUR * CAST(floor(hour(ts) / 12) AS INTEGER) AS half, *
        FROM events
    ), w AS (
        SELECT half AS window_start, event_type, value FROM e
        UNION ALL SELECT half - INTERVAL 12 HOUR, event_type, value FROM e
    )
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n,
           max(value) AS peak
    FROM w GROUP BY 1, 2, 3
""")
def live_series_sliding(spark, d):
    return _upserted(spark, d, window="1 day", slide="12 hours")


@query("""
    WITH g AS (
        SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
                       THEN 0 ELSE 1 END AS opens
        FROM events
    ), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
    t AS (
        SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n
        FROM s GROUP BY user_id, session
    )
    SELECT * FROM t
""")
def live_series_sessions(spark, d):
    """All sessions of a stream that ends, those still open included."""
    series = cf.live_series(
        cf.load_stream(spark, d), "ts", None, "user_id", "1 hour", session_gap="30 minutes"
    )
    out = shared_dir(spark, "sessions")
    cf.drain_series(series, f"{out}/series", f"{out}/state").awaitTermination()
    return cf.latest_series(spark, f"{out}/series", series.schema, "user_id")
