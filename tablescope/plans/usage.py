"""Usage, cost, budget and metric queries."""

import datetime as dt

from pyspark.sql import functions as F

from tablescope.functions import dates
from tablescope.operators import metrics as met
from tablescope.operators import usage as us
from tablescope.plans.bindings import (
    CLASSES,
    INFERENCES_SQL,
    MESSAGES_SQL,
    PRICES_SQL,
    inferences,
    literal,
    local_rows,
    messages,
    priced_sql,
    prices,
    values_sql,
)
from tablescope.plans.registry import query

FORMATS = {"hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d", "month": "%Y-%m"}


def as_of(t):
    return t.events.agg(F.max("ts")).scalar()


AS_OF = "(SELECT max(ts) FROM events)"


def rounded(df, places=9):
    """Round the double measures, as the oracle does."""
    return df.select(*[F.round(c, places).alias(c) if d == "double" else F.col(c) for c, d in df.dtypes])


COUNTS_SQL = ", ".join(
    ["count(DISTINCT CASE WHEN role = 'user' THEN message_id END) AS message_count"]
    + [f"count(DISTINCT CASE WHEN role = 'user' AND source = '{s}' THEN message_id END) AS {us.snake(s)}_message_count"
       for s in us.SOURCES])
SUMS_SQL = ", ".join([f"CAST(sum({c}) AS BIGINT) AS {c}" for c in [f"{c}_tokens" for c in CLASSES] + ["total_tokens"]]
                     + [f"sum({c}_cost) AS {c}_cost" for c in CLASSES + ["total"]])


def usage_sql(granularity, rows=MESSAGES_SQL):
    return f"""SELECT strftime(created_at, '{FORMATS[granularity]}') AS date, {COUNTS_SQL}, {SUMS_SQL}
        FROM ({priced_sql(rows)}) GROUP BY 1"""


def inference_sql(granularity, rows=INFERENCES_SQL):
    zeros = ", ".join(f"0 AS {c}" for c in us.COUNT_COLUMNS)
    return f"""SELECT strftime(created_at, '{FORMATS[granularity]}') AS date, {zeros}, {SUMS_SQL}
        FROM ({priced_sql(rows)}) GROUP BY 1"""


def round_sql(inner):
    whole = [*us.COUNT_COLUMNS, *[c for c in us.SUM_COLUMNS if c.endswith("tokens")]]
    cost = [c for c in us.SUM_COLUMNS if c.endswith("cost")]
    return f"""SELECT date, {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in whole)},
        {', '.join(f'round(coalesce(sum({c}), 0), 9) AS {c}' for c in cost)} FROM ({inner}) GROUP BY date"""


@query("us_price_list", "US-01", "SQL-21", oracle=f"""SELECT c.provider, c.model_id, count(*) AS n,
    max(p.input_no_cache) AS input_no_cache, max(p.input_cache_read) AS input_cache_read,
    max(p.input_cache_write) AS input_cache_write, max(p.output) AS output
    FROM ({MESSAGES_SQL}) c LEFT JOIN ({PRICES_SQL}) p ON c.provider = p.provider AND c.model_id = p.model_id
    GROUP BY 1, 2""")
def _(t):
    rates = prices(t).select(F.col("provider").alias("p"), F.col("model_id").alias("m"), *us.TOKEN_CLASSES)
    joined = messages(t).select("provider", "model_id").join(
        rates, (F.col("provider") == F.col("p")) & (F.col("model_id") == F.col("m")), "left")
    return joined.groupBy("provider", "model_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in us.TOKEN_CLASSES])


@query("us_message_cost", "US-02", oracle=f"""SELECT message_id,
    {', '.join(f'round({c}_cost, 9) AS {c}_cost' for c in CLASSES + ['total'])} FROM ({priced_sql(MESSAGES_SQL)})""")
def _(t):
    priced = us.with_cost(messages(t), prices(t))
    return rounded(priced.select("message_id", *[f"{c}_cost" for c in (*us.TOKEN_CLASSES, "total")]))


@query("us_message_usage_day", "US-03", "US-05", oracle=round_sql(usage_sql("day")))
def _(t):
    return rounded(us.message_usage(us.with_cost(messages(t), prices(t)), "day"))


@query("us_message_usage_hour", "US-03", "US-05", oracle=round_sql(usage_sql("hour")))
def _(t):
    return rounded(us.message_usage(us.with_cost(messages(t), prices(t)), "hour"))


@query("us_combined_usage", "US-04", "SQL-13",
       oracle=round_sql(usage_sql("day") + " UNION ALL " + inference_sql("day")))
def _(t):
    price = prices(t)
    return rounded(us.combine_usage(us.message_usage(us.with_cost(messages(t), price), "day"),
                                    us.inference_usage(us.with_cost(inferences(t), price), "day")))


def lookback_sql(unit, value):
    return f"date_trunc('{unit}', {AS_OF}) - INTERVAL {value - 1} {unit}"


@query("us_lookback", "US-06", oracle=" UNION ALL ".join(
    f"SELECT '{u}' AS unit, count(*) AS n, min(created_at) AS first_at FROM ({MESSAGES_SQL}) "
    f"WHERE created_at >= {lookback_sql(u, v)}" for u, v in (("hour", 12), ("day", 7), ("month", 1))))
def _(t):
    out = None
    for unit, value in (("hour", 12), ("day", 7), ("month", 1)):
        part = us.in_lookback(messages(t), as_of(t), unit, value).agg(
            F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at")).withColumn("unit", F.lit(unit))
        out = part if out is None else out.unionByName(part)
    return out


def filled_sql(unit, value, granularity):
    within = f"SELECT * FROM ({MESSAGES_SQL}) WHERE created_at >= {lookback_sql(unit, value)}"
    infer = f"SELECT * FROM ({INFERENCES_SQL}) WHERE created_at >= {lookback_sql(unit, value)}"
    inner = usage_sql(granularity, within) + " UNION ALL " + inference_sql(granularity, infer)
    measures = [*us.COUNT_COLUMNS, *us.SUM_COLUMNS]
    return f"""WITH u AS ({round_sql(inner)}),
        d AS (SELECT strftime(unnest(generate_series(date_trunc('{granularity}', {lookback_sql(unit, value)}),
              date_trunc('{granularity}', {AS_OF}), INTERVAL 1 {granularity})), '{FORMATS[granularity]}') AS date)
        SELECT d.date, {', '.join(f'coalesce(u.{c}, 0) AS {c}' for c in measures)} FROM d LEFT JOIN u USING (date)"""


def filled(t, unit, value, granularity, most=None):
    now, price = as_of(t), prices(t)
    said = us.in_lookback(messages(t), now, unit, value)
    ran = us.in_lookback(inferences(t), now, unit, value)
    usage = us.combine_usage(us.message_usage(us.with_cost(said, price), granularity),
                             us.inference_usage(us.with_cost(ran, price), granularity))
    return rounded(us.fill_buckets(usage, now, unit, value, granularity, most))


@query("us_gap_filled_hours", "US-07", "US-04", oracle=filled_sql("hour", 24, "hour"))
def _(t):
    return filled(t, "hour", 24, "hour")


@query("us_gap_filled_days", "US-07", oracle=filled_sql("day", 45, "day"))
def _(t):
    return filled(t, "day", 45, "day")


@query("us_coarsened_buckets", "US-08", "US-09", oracle=filled_sql("hour", 200, "day"))
def _(t):
    # the choice depends on the period alone; any instant inside the data gives the same one
    at = dt.datetime(2024, 1, 30, 12)
    granularity = dates.chart_granularity("hour", 200, at)
    return filled(t, "hour", 200, granularity, dates.CHART_MOST)


PROVIDER_ASOF = f"""WITH m AS ({MESSAGES_SQL}) SELECT a.message_id, a.user_id, a.role, a.source, a.chat_id, a.created_at,
    CASE WHEN a.role = 'user' THEN (
      SELECT n.provider FROM m n WHERE n.chat_id = a.chat_id AND n.role = 'assistant' AND n.provider IS NOT NULL
        AND n.created_at > a.created_at AND NOT EXISTS (SELECT 1 FROM m u WHERE u.chat_id = a.chat_id
          AND u.role = 'user' AND u.created_at > a.created_at AND u.created_at < n.created_at)
      ORDER BY n.created_at LIMIT 1) ELSE a.provider END AS usage_provider FROM m a"""
# the correlated form above is quadratic per chat; the oracle uses the equivalent window form
# times cut to six hours, so that many messages of a chat share an instant
TIED = "time_bucket(INTERVAL 6 HOUR, created_at)"
TIED_SQL = f"SELECT * REPLACE ({TIED} AS created_at) FROM ({MESSAGES_SQL})"
PROVIDER_WINDOW = f"""WITH m AS ({TIED_SQL}), a AS (SELECT chat_id, created_at, arg_min(provider, message_id) AS p FROM m
      WHERE role = 'assistant' AND provider IS NOT NULL GROUP BY 1, 2),
    u AS (SELECT DISTINCT chat_id, created_at FROM m WHERE role = 'user'),
    next_answer AS (SELECT u.chat_id, u.created_at, a.created_at AS at, a.p FROM u ASOF JOIN a
      ON u.chat_id = a.chat_id AND u.created_at < a.created_at),
    next_user AS (SELECT u.chat_id, u.created_at, v.created_at AS at FROM u ASOF JOIN u v
      ON u.chat_id = v.chat_id AND u.created_at < v.created_at)
    SELECT m.*, CASE WHEN m.role = 'user' THEN CASE WHEN NOT coalesce(n.at < s.at, false) THEN s.p END ELSE m.provider END
      AS usage_provider
    FROM m LEFT JOIN next_answer s ON m.chat_id = s.chat_id AND m.created_at = s.created_at
    LEFT JOIN next_user n ON m.chat_id = n.chat_id AND m.created_at = n.created_at"""
SOURCE_ASOF = f"""SELECT a.*, CASE WHEN a.role = 'assistant' THEN u.s.source ELSE a.source END AS usage_source
    FROM ({TIED_SQL}) a ASOF LEFT JOIN (SELECT chat_id, created_at, arg_max({{'source': source}}, message_id) AS s
      FROM ({TIED_SQL}) WHERE role = 'user' GROUP BY 1, 2) u ON a.chat_id = u.chat_id AND a.created_at >= u.created_at"""


def tied_messages(t):
    return messages(t).withColumn("created_at", F.window("created_at", "6 hours")["start"].cast("timestamp_ntz"))


@query("us_message_provider", "US-10", "SQL-06",
       oracle=f"SELECT message_id, usage_provider FROM ({PROVIDER_WINDOW})")
def _(t):
    return us.with_message_provider(tied_messages(t)).select("message_id", "usage_provider")


@query("us_message_source", "US-11", "SQL-06", oracle=f"SELECT message_id, usage_source FROM ({SOURCE_ASOF})")
def _(t):
    return us.with_message_source(tied_messages(t)).select("message_id", "usage_source")


@query("us_inference_source", "US-12", oracle=f"""SELECT i.inference_id, u.source AS usage_source
    FROM ({INFERENCES_SQL}) i ASOF LEFT JOIN (SELECT chat_id, created_at, source FROM ({MESSAGES_SQL})
      WHERE role = 'user') u ON i.chat_id = u.chat_id AND i.created_at >= u.created_at""")
def _(t):
    return us.with_inference_source(inferences(t), messages(t)).select("inference_id", "usage_source")


@query("us_totals", "US-13", oracle=f"""SELECT count(DISTINCT CASE WHEN role = 'user' THEN message_id END) AS total_messages,
    count(DISTINCT user_id) AS unique_users FROM ({MESSAGES_SQL})""")
def _(t):
    return us.usage_totals(messages(t))


@query("us_providers", "US-14", oracle=f"""SELECT provider FROM ({MESSAGES_SQL}) WHERE provider IS NOT NULL
    UNION SELECT provider FROM ({INFERENCES_SQL})""")
def _(t):
    return us.used_providers(messages(t), inferences(t))


@query("us_filtered_totals", "US-15", oracle=f"""SELECT count(DISTINCT CASE WHEN p.role = 'user' THEN p.message_id END)
      AS total_messages, count(DISTINCT p.user_id) AS unique_users
    FROM ({PROVIDER_WINDOW}) p JOIN ({SOURCE_ASOF}) s ON p.message_id = s.message_id
    WHERE p.usage_provider IN ('alpha', 'beta') AND s.usage_source IN ('slack', 'web', 'teams')
      AND p.user_id IN ({', '.join(map(str, range(0, 40, 3)))})""")
def _(t):
    rows = us.with_message_source(us.with_message_provider(tied_messages(t)))
    return us.usage_totals(us.filter_usage(rows, ["alpha", "beta"], list(range(0, 40, 3)), ["slack", "web", "teams"]))


@query("us_period_starts", "US-16", oracle="""SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day_start,
    date_trunc('week', o_orderdate)::TIMESTAMP AS week_start, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start,
    (date_trunc('day', o_orderdate) + INTERVAL 1 DAY)::TIMESTAMP AS next_day,
    (date_trunc('week', o_orderdate) + INTERVAL 7 DAY)::TIMESTAMP AS next_week,
    (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS next_month FROM orders""")
def _(t):
    day = F.col("o_orderdate")
    starts = [dates.period_start(day, p).cast("timestamp_ntz").alias(f"{p}_start") for p in ("day", "week", "month")]
    nexts = [dates.next_period_start(day, p).cast("timestamp_ntz").alias(f"next_{p}") for p in ("day", "week", "month")]
    return t.orders.select("o_orderkey", *starts, *nexts)


BUDGET_COLUMNS = "provider string, period string, limit_usd double, per_user_limit_usd double"
PROJECT_BUDGETS = [("alpha", "day", 5.0, 1.0), ("beta", "week", 2.0, 0.05), ("gamma", "month", 100.0, None)]
CONFIG_BUDGETS = [("alpha", "month", 4.0, 0.2), ("delta", "day", 0.0, 3.0)]
BUDGET_NAMES = [c.split()[0] for c in BUDGET_COLUMNS.split(", ")]
BUDGETS_SQL = f"""SELECT *, 'config' AS origin FROM {values_sql(CONFIG_BUDGETS, BUDGET_NAMES)} UNION ALL
    SELECT *, 'project' AS origin FROM {values_sql(PROJECT_BUDGETS, BUDGET_NAMES)}
    WHERE provider NOT IN ({', '.join(literal(b[0]) for b in CONFIG_BUDGETS)})"""
SPEND_SQL = f"""SELECT r.provider, r.user_id, sum(r.total_cost) AS spend FROM ({priced_sql(MESSAGES_SQL)}) r
    JOIN ({BUDGETS_SQL}) b ON r.provider = b.provider AND r.created_at >= date_trunc(b.period, {AS_OF})
    GROUP BY 1, 2"""


def budgets(t):
    return us.effective_budgets(local_rows(t.spark, PROJECT_BUDGETS, BUDGET_COLUMNS),
                                local_rows(t.spark, CONFIG_BUDGETS, BUDGET_COLUMNS))


def spend(t):
    return us.period_spend(us.with_cost(messages(t), prices(t)), budgets(t), as_of(t))


@query("us_period_spend", "US-17", "SQL-23", oracle=f"SELECT provider, user_id, round(spend, 9) AS spend FROM ({SPEND_SQL})")
def _(t):
    return rounded(spend(t))


@query("us_project_spend", "US-18", oracle=f"SELECT provider, round(sum(spend), 2) AS spend FROM ({SPEND_SQL}) GROUP BY 1")
def _(t):
    return us.project_spend(spend(t))


@query("us_user_spend", "US-18", oracle=f"SELECT provider, user_id, round(spend, 2) AS spend FROM ({SPEND_SQL})")
def _(t):
    return us.user_spend(spend(t))


@query("us_effective_budgets", "US-19", oracle=f"""SELECT b.provider, b.period, b.limit_usd::DOUBLE AS limit_usd,
    b.per_user_limit_usd::DOUBLE AS per_user_limit_usd, b.origin, count(m.message_id) AS messages
    FROM ({BUDGETS_SQL}) b LEFT JOIN ({MESSAGES_SQL}) m ON m.provider = b.provider GROUP BY ALL""")
def _(t):
    used = messages(t).groupBy("provider").agg(F.count(F.lit(1)).alias("messages"))
    return budgets(t).join(used, "provider", "left").na.fill(0, ["messages"])


@query("us_budget_status", "US-20", oracle=f"""WITH s AS ({SPEND_SQL}),
    p AS (SELECT provider, round(sum(spend), 2) AS ps FROM s GROUP BY 1),
    w AS (SELECT s.provider, s.user_id, greatest(
        CASE WHEN limit_usd > 0 THEN ps / limit_usd END,
        CASE WHEN per_user_limit_usd > 0 THEN round(s.spend, 2) / per_user_limit_usd END) AS r
      FROM s JOIN p USING (provider) JOIN ({BUDGETS_SQL}) b USING (provider))
    SELECT provider, user_id, round(CAST(r AS DOUBLE), 4) AS worst_ratio,
      CASE WHEN r >= 1 THEN 'exceeded' WHEN r >= 0.8 THEN 'warning' ELSE 'ok' END AS level FROM w""")
def _(t):
    return us.budget_status(spend(t), budgets(t))


TOTAL_COLUMNS = [f"{c}_tokens" for c in CLASSES] + ["total_tokens"]


@query("us_chat_totals", "US-21", oracle=f"""SELECT chat_id,
    {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in TOTAL_COLUMNS)} FROM ({MESSAGES_SQL}) GROUP BY 1""")
def _(t):
    return us.chat_token_totals(messages(t))


@query("us_storage_by_user", "US-22", oracle="""SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes
    FROM documents GROUP BY 1 ORDER BY bytes DESC, source""")
def _(t):
    return us.storage_by_user(t.documents, "source", "n_chars")


AGG_SQL = {"SUM": "round(sum({0}), 2)", "COUNT": "count({0})", "COUNT_DISTINCT": "count(DISTINCT {0})",
           "AVG": "round(avg({0}), 4)", "MIN": "min({0})", "MAX": "max({0})"}
METRIC_CASES = [("SUM", "o_totalprice", "month"), ("COUNT", "o_orderkey", "day"),
                ("COUNT_DISTINCT", "o_custkey", "quarter"), ("AVG", "o_totalprice", "year"),
                ("MIN", "o_totalprice", "week"), ("MAX", "o_totalprice", "month")]


def register_metric(aggregation, column, grain):
    sql = f"""SELECT strftime(date_trunc('{grain}', o_orderdate), '%Y-%m-%d') AS period, o_orderpriority,
        {AGG_SQL[aggregation].format(column)} AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2"""

    @query(f"met_{aggregation.lower()}_{grain}", "MET-01", oracle=sql)
    def _(t):
        spec = met.Metric("value", column, aggregation, "o_orderdate", grain, ("o_orderpriority",), ("o_orderstatus <> 'P'",))
        out = met.metric(t.orders, spec)
        places = {"SUM": 2, "AVG": 4}.get(aggregation)
        return rounded(out, places) if places else out


for case in METRIC_CASES:
    register_metric(*case)


@query("met_cohort_conversion", "MET-02", oracle="""WITH f AS (SELECT o_custkey, min(o_orderdate) AS signed_up_at
      FROM orders GROUP BY 1), s AS (SELECT o.o_custkey, f.signed_up_at, o.o_orderdate AS converted_at, c.c_mktsegment
      FROM orders o JOIN f USING (o_custkey) JOIN customer c ON c.c_custkey = o.o_custkey
      WHERE o.o_orderdate > f.signed_up_at)
    SELECT strftime(date_trunc('month', signed_up_at), '%Y-%m-%d') AS period, c_mktsegment,
      round(count(DISTINCT CASE WHEN date_diff('day', signed_up_at, converted_at) <= 30 THEN o_custkey END)::DOUBLE
      / nullif(count(DISTINCT o_custkey), 0), 9) AS rate FROM s GROUP BY 1, 2""")
def _(t):
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("signed_up_at"))
    later = (t.orders.join(first, "o_custkey").filter(F.col("o_orderdate") > F.col("signed_up_at"))
             .join(t.customer, F.col("o_custkey") == F.col("c_custkey")))
    out = met.cohort_ratio(later, "rate", "o_custkey", "signed_up_at", "o_orderdate", 30, "month", ("c_mktsegment",))
    return rounded(out)
