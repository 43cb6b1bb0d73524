"""Subscription, entitlement and topic selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import config
from eventlens.catalog import listed, query, stamp
from eventlens.catalog import sql as s
from eventlens.functions import numbers as nm
from eventlens.operators import subscriptions, topics
from eventlens.plans import tables as tb

_STATE = """, latest AS (
  SELECT 'cus_' || o_custkey AS customer_id, o_orderdate AS created, o_orderdate + INTERVAL 180 DAY AS period_end,
    CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'past_due' ELSE 'canceled' END AS status
  FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1),
state AS (
  SELECT customer_id, status AS subscription_status, created,
    CASE WHEN status IN ('active', 'past_due') OR period_end > TIMESTAMP '2001-09-01' THEN 'pro' ELSE 'free' END AS subscription_tier,
    CASE WHEN status = 'past_due' THEN period_end + INTERVAL 3 DAY
         WHEN status = 'active' OR period_end > TIMESTAMP '2001-09-01' THEN period_end END AS expires
  FROM latest)"""


@query(
    "subscription_state",
    "WITH x AS (SELECT 1)" + _STATE + f""" SELECT customer_id, subscription_status, subscription_tier,
    {s.STAMP.format('created')} AS state_created_at, {s.STAMP.format('expires')} AS entitlement_expires_at FROM state""",
)
def subscription_state(spark, d):
    rows = subscriptions.subscription_state(tb.subscription_events(spark, d), tb.SUBSCRIPTION_AS_OF)
    return rows.select(
        "customer_id", "subscription_status", "subscription_tier", stamp("state_created_at"), stamp("entitlement_expires_at")
    )


@query(
    "receipts_once",
    "SELECT o_orderkey AS event_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS created FROM orders",
)
def receipts_once(spark, d):
    """Every event delivered twice, the second time with a later date."""
    rows = tb.subscription_events(spark, d)
    again = rows.withColumn("arrival", F.col("arrival") + 1_000_000_000).withColumn(
        "created", F.col("created") + F.expr("INTERVAL 1 DAY")
    )
    return subscriptions.dedupe_receipts(rows.unionByName(again)).select("event_id", stamp("created"))


@query(
    "entitlements",
    "WITH x AS (SELECT 1)" + _STATE + """ SELECT c_custkey AS user_id,
      CASE WHEN s.subscription_tier = 'pro' AND s.expires > TIMESTAMP '2001-09-01' THEN 'pro'
           WHEN s.customer_id IS NULL AND c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 'pro'
           WHEN s.customer_id IS NULL AND c_custkey % 8 = 0 THEN 'pro' ELSE 'free' END AS tier,
      CASE WHEN tier = 'pro' THEN 5 ELSE 0 END AS features
    FROM customer LEFT JOIN state s ON s.customer_id = 'cus_' || c_custkey""",
)
def entitlements(spark, d):
    state = subscriptions.subscription_state(tb.subscription_events(spark, d), tb.SUBSCRIPTION_AS_OF)
    users = subscriptions.apply_state(tb.users(spark, d), state)
    access = nm.entitlement("subscription_tier", "entitlement_expires_at", tb.SUBSCRIPTION_AS_OF)
    return users.select("user_id", access["tier"].alias("tier"), F.size(access["features"]).alias("features"))


_NAMES = "['llm','agents','vision','open_source','research','policy','robotics','infrastructure']"
_REQUESTS = f"""requests AS (
  SELECT o_orderkey AS request_id, o_custkey AS user_id, CASE o_orderkey % 4
    WHEN 0 THEN [n[o_orderkey % 8 + 1], n[(o_orderkey + 3) % 8 + 1]] WHEN 1 THEN [n[1], n[1]]
    WHEN 2 THEN [n[1], n[2], n[3], n[o_orderkey % 5 + 4]] ELSE [n[1], 'unknown'] END AS topics
  FROM orders, (SELECT {_NAMES} AS n)),
checked AS (
  SELECT request_id, user_id, topics,
    list_filter([CASE WHEN len(list_distinct(topics)) <> len(topics) THEN 'repeated' END,
      CASE WHEN list_contains(topics, 'unknown') THEN 'unknown' END,
      CASE WHEN len(topics) > 3 AND NOT (user_id % 4 = 0 AND (user_id % 8 <> 0 OR user_id % 3 - 1 > 0)) THEN 'over_limit' END],
      lambda v: v IS NOT NULL) AS violations
  FROM requests)"""


def _requests(spark, d):
    names = F.array(*map(F.lit, config.TOPICS))
    key = F.col("o_orderkey")
    at = lambda i: F.element_at(names, (i + 1).cast("int"))
    chosen = (
        F.when(key % 4 == 0, F.array(at(key % 8), at((key + 3) % 8)))
        .when(key % 4 == 1, F.array(at(F.lit(0)), at(F.lit(0))))
        .when(key % 4 == 2, F.array(at(F.lit(0)), at(F.lit(1)), at(F.lit(2)), at(key % 5 + 3)))
        .otherwise(F.array(at(F.lit(0)), F.lit("unknown")))
    )
    return tb.read(spark, d, "orders").select(
        key.alias("request_id"), F.col("o_custkey").alias("user_id"), chosen.alias("topics")
    )


@query(
    "topic_requests",
    f"WITH {_REQUESTS} SELECT request_id, array_to_string(violations, '|') AS violations FROM checked",
)
def topic_requests(spark, d):
    rows = topics.check_requests(_requests(spark, d), tb.users(spark, d), tb.AS_OF)
    return rows.select("request_id", listed("violations", "violations"))


@query(
    "topic_selection",
    f"""WITH {_REQUESTS}, newest AS (SELECT user_id, arg_max(topics, request_id) AS topics FROM checked
      WHERE len(violations) = 0 GROUP BY user_id),
    current AS (SELECT DISTINCT c_custkey AS user_id, unnest([n[c_custkey % 8 + 1], n[(c_custkey + c_custkey % 5) % 8 + 1]]) AS topic
      FROM customer, (SELECT {_NAMES} AS n) WHERE c_custkey % 9 <> 0)
    SELECT user_id, topic FROM current WHERE user_id NOT IN (SELECT user_id FROM newest)
    UNION ALL SELECT user_id, unnest(topics) FROM newest""",
)
def topic_selection(spark, d):
    return topics.save_topics(tb.user_topics(spark, d), _requests(spark, d), tb.users(spark, d), tb.AS_OF)


@query(
    "profiles",
    f"""WITH current AS (SELECT DISTINCT c_custkey AS user_id, unnest([n[c_custkey % 8 + 1], n[(c_custkey + c_custkey % 5) % 8 + 1]]) AS topic
      FROM customer, (SELECT {_NAMES} AS n) WHERE c_custkey % 9 <> 0)
    SELECT c_custkey AS user_id, lower(c_name) AS email,
      CASE WHEN c_custkey % 4 = 0 AND (c_custkey % 8 <> 0 OR c_custkey % 3 - 1 > 0) THEN 'pro' ELSE 'free' END AS subscription_tier,
      CASE WHEN c_custkey % 4 = 0 AND (c_custkey % 8 <> 0 OR c_custkey % 3 - 1 > 0) THEN 8 ELSE 3 END AS topic_limit,
      coalesce((SELECT string_agg(topic, '|' ORDER BY topic) FROM current u WHERE u.user_id = c_custkey), '') AS topics
    FROM customer""",
)
def profiles(spark, d):
    rows = topics.profiles(tb.users(spark, d), tb.user_topics(spark, d), tb.AS_OF)
    return rows.select("user_id", "email", "subscription_tier", "topic_limit", listed("topics", "topics"))


@query(
    "ensured_profiles",
    """WITH known AS (SELECT c_custkey AS user_id, lower(c_name) AS email, CASE WHEN c_custkey % 4 = 0 THEN 'pro' ELSE 'free' END AS tier
      FROM customer WHERE c_custkey % 2 = 0),
    latest AS (SELECT o_custkey AS user_id, arg_max(o_orderkey, o_orderkey) || '@x' AS email FROM orders GROUP BY o_custkey)
    SELECT coalesce(k.user_id, l.user_id) AS user_id, coalesce(l.email, k.email) AS email, coalesce(k.tier, 'free') AS subscription_tier
    FROM known k FULL JOIN latest l ON k.user_id = l.user_id""",
)
def ensured_profiles(spark, d):
    known = tb.users(spark, d).where(F.col("user_id") % 2 == 0)
    visits = tb.read(spark, d, "orders").select(
        F.col("o_custkey").alias("user_id"), F.concat("o_orderkey", F.lit("@x")).alias("email"), F.col("o_orderkey").alias("seen_at")
    )
    return topics.ensure_profiles(known, visits).select("user_id", "email", "subscription_tier")
