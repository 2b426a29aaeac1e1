"""Application-shaped tables derived from the test tables, as expressions both engines can run."""

from pyspark.sql import functions as F

USER_TYPES = "event_type IN ('click', 'view', 'signup')"

MESSAGES = [
    "event_id AS message_id",
    "user_id AS chat_id",
    "user_id % 40 AS user_id",
    "ts AS created_at",
    f"CASE WHEN {USER_TYPES} THEN 'user' ELSE 'assistant' END AS role",
    f"""CASE WHEN {USER_TYPES} THEN CASE event_id % 10 WHEN 0 THEN 'slack' WHEN 1 THEN 'teams'
        WHEN 2 THEN 'telegram' WHEN 3 THEN 'mattermost' WHEN 4 THEN 'whatsapp' WHEN 5 THEN 'web' WHEN 6 THEN 'mcp'
        WHEN 7 THEN 'contextRecommendations' WHEN 8 THEN 'admin' ELSE NULL END END AS source""",
    f"""CASE WHEN NOT ({USER_TYPES}) AND event_id % 7 <> 0 THEN CASE event_id % 3 WHEN 0 THEN 'alpha'
        WHEN 1 THEN 'beta' ELSE 'gamma' END END AS provider""",
    "CASE event_id % 2 WHEN 0 THEN 'large' ELSE 'small' END AS model_id",
    "CAST(floor(value * 100) AS BIGINT) AS input_no_cache_tokens",
    "CAST(floor(value * 40) AS BIGINT) AS input_cache_read_tokens",
    "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS input_cache_write_tokens",
    "CAST(floor(value * 25) AS BIGINT) AS output_tokens",
    "CAST(floor(value * 165) AS BIGINT) AS total_tokens",
]
MESSAGES_SQL = f"SELECT {', '.join(MESSAGES)} FROM events"

INFERENCES = [
    "o_orderkey AS inference_id",
    "o_custkey % 150 AS chat_id",
    "(o_custkey % 150) % 40 AS user_id",
    "CASE o_orderkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'delta' END AS provider",
    "CASE o_orderkey % 2 WHEN 0 THEN 'large' ELSE 'small' END AS model_id",
    "CAST(floor(o_totalprice / 100) AS BIGINT) AS input_no_cache_tokens",
    "CAST(floor(o_totalprice / 300) AS BIGINT) AS input_cache_read_tokens",
    "CAST(floor(o_totalprice / 900) AS BIGINT) AS input_cache_write_tokens",
    "CAST(floor(o_totalprice / 200) AS BIGINT) AS output_tokens",
    "CAST(floor(o_totalprice / 60) AS BIGINT) AS total_tokens",
]
INFERENCES_SQL = f"""SELECT {', '.join(INFERENCES)},
    make_timestamp((1704067200 + (o_orderkey % 43200) * 60) * 1000000) AS created_at FROM orders"""

PRICE_COLUMNS = "provider string, model_id string, input_no_cache double, input_cache_read double, " \
    "input_cache_write double, output double"
BUILTIN_PRICES = [
    ("alpha", "large", 3.0, 0.3, 3.75, 15.0),
    ("alpha", "small", 0.8, None, 1.0, 4.0),
    ("beta", "large", 2.5, 1.25, None, 10.0),
    ("delta", "large", 1.0, 0.1, 1.25, 5.0),
]
DECLARED_PRICES = [
    ("alpha", "small", None, 0.08, 1.5, None),
    ("beta", "small", 0.15, 0.075, 0.0, 0.6),
    ("delta", "large", 0.9, None, None, None),
]


def literal(v):
    if v is None:
        return "NULL"
    return f"'{v}'" if isinstance(v, str) else repr(v)


def values_sql(rows, columns):
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({', '.join(columns)})"


PRICE_NAMES = [c.split()[0] for c in PRICE_COLUMNS.split(", ")]
PRICES_SQL = "SELECT provider, model_id, " + ", ".join(
    f"CAST(coalesce(d.{c}, b.{c}, 0.0) AS DOUBLE) AS {c}" for c in PRICE_NAMES[2:]
) + f" FROM (SELECT * FROM {values_sql(BUILTIN_PRICES, PRICE_NAMES)}) b FULL JOIN " \
    f"(SELECT * FROM {values_sql(DECLARED_PRICES, PRICE_NAMES)}) d USING (provider, model_id)"


def messages(t):
    return t.events.selectExpr(*MESSAGES)


def inferences(t):
    stamped = F.timestamp_seconds(F.lit(1704067200) + F.col("inference_id") % 43200 * 60)
    return t.orders.selectExpr(*INFERENCES).withColumn("created_at", stamped.cast("timestamp_ntz"))


def prices(t):
    from tablescope.operators.usage import merge_prices

    return merge_prices(
        local_rows(t.spark, BUILTIN_PRICES, PRICE_COLUMNS), local_rows(t.spark, DECLARED_PRICES, PRICE_COLUMNS)
    )


def local_rows(spark, rows, columns):
    """A small list as a relation of known size, so that joins with it are planned as broadcasts."""
    names, types = zip(*(c.split() for c in columns.split(", ")))
    casts = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, types))
    return spark.sql(f"SELECT {casts} FROM {values_sql(rows, names)}")


CLASSES = ["input_no_cache", "input_cache_read", "input_cache_write", "output"]


def priced_sql(rows):
    costs = [f"coalesce({c}_tokens, 0) * coalesce(p.{c}, 0.0) / 1000000.0" for c in CLASSES]
    return f"""SELECT r.*, {', '.join(f'{e} AS {c}_cost' for e, c in zip(costs, CLASSES))},
        {' + '.join(costs)} AS total_cost
        FROM ({rows}) r LEFT JOIN ({PRICES_SQL}) p ON r.provider = p.provider AND r.model_id = p.model_id"""
