"""Output contracts, costs, budgets, queue and cache queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.catalog import big, listed, query, stamp
from eventlens.catalog import sql as s
from eventlens.operators import contracts, feed, ledger
from eventlens.plans import tables as tb

# Landed outputs built from the conversations: well formed and spoiled in turn.
_PIECES = (
    "list_append(string_split(text, '. ')[1:CAST(1 + conv_id % 5 AS INTEGER)], "
    "array_to_string(string_split(text, '. ')[CAST(2 + conv_id % 5 AS INTEGER):], '. '))"
)
_SUMMARIES = f"""summaries AS (
  SELECT conv_id * 1000 + turn AS call_id, CASE (conv_id + turn) % 6
    WHEN 1 THEN CAST(json_object('sentences', {_PIECES}, 'note', 'x') AS VARCHAR)
    WHEN 2 THEN '{{"sentences": [' WHEN 3 THEN '{{"sentences":[1,2,3]}}'
    WHEN 4 THEN CAST(json_object('text', text) AS VARCHAR)
    ELSE CAST(json_object('sentences', {_PIECES}) AS VARCHAR) END AS content
  FROM conversations)"""


def _outputs(spark, d, build):
    rows = tb.read(spark, d, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"), build(rows).alias("content"))


def _summary_content(_):
    # The first sentences one by one, all the rest as the last.
    split, first = F.split("text", r"\. "), (F.col("conv_id") % 5 + 1).cast("int")
    rest = F.slice(split, first + 1, F.greatest(F.lit(0), F.size(split) - first))
    pieces = F.array_append(F.slice(split, F.lit(1), first), F.array_join(rest, ". "))
    kind = (F.col("conv_id") + F.col("turn")) % 6
    return (
        F.when(kind == 1, F.to_json(F.struct(pieces.alias("sentences"), F.lit("x").alias("note"))))
        .when(kind == 2, '{"sentences": [')
        .when(kind == 3, '{"sentences":[1,2,3]}')
        .when(kind == 4, F.to_json(F.struct("text")))
        .otherwise(F.to_json(F.struct(pieces.alias("sentences"))))
    )


@query(
    "summary_violations",
    f"""WITH {_SUMMARIES}, parsed AS (SELECT call_id, CASE WHEN json_valid(content) THEN CAST(content AS JSON) END AS j FROM summaries),
    items AS (SELECT call_id, j, CASE WHEN json_type(j, '$.sentences') = 'ARRAY' THEN CAST(json_extract(j, '$.sentences') AS JSON[]) END AS i FROM parsed)
    SELECT call_id, array_to_string(list_filter([
      CASE WHEN coalesce(json_type(j), '') <> 'OBJECT' THEN 'object' END,
      CASE WHEN j IS NULL OR json_keys(j) <> ['sentences'] THEN 'keys' END,
      CASE WHEN i IS NULL OR len(i) NOT BETWEEN 3 AND 5 THEN 'sentences' END,
      CASE WHEN len(list_filter(coalesce(i, []), lambda x: json_type(x) <> 'VARCHAR'
        OR length(trim(x ->> '$', ' ' || chr(10))) NOT BETWEEN 1 AND 1200)) > 0 THEN 'sentence_text' END],
      lambda v: v IS NOT NULL), '|') AS violations FROM items""",
)
def summary_violations(spark, d):
    rows = _outputs(spark, d, _summary_content)
    return rows.select("call_id", listed(contracts.summary_violations("content"), "violations"))


_SCORES = ["5", "true", "\"5\"", "5.5", "0", "10", "11"]


def _analysis_content(_):
    key = F.col("conv_id") + F.col("turn")
    score = F.element_at(F.array(*map(F.lit, _SCORES)), (key % 7 + 1).cast("int"))
    kind = F.when(key % 5 == 0, "rumour").otherwise("paper")
    hype = F.when(key % 11 == 0, "wild").otherwise("accurate")
    link = F.when(key % 4 == 0, "https://u:p@github.com/a").when(key % 4 == 1, "https://x.example/a b").otherwise(
        "https://github.com/a/b"
    )
    why = F.to_json(F.struct(F.col("text").alias("v")))
    return F.concat(
        F.lit('{"event_type":"'), kind, F.lit('","technical_significance":'), score,
        F.when(key % 3 == 0, F.lit(',"who_should_care":[]')).otherwise(',"who_should_care":["AI engineers"]'),
        F.lit(',"why_it_matters":'), F.expr("substring(to_json(struct(text as v)), 6, length(to_json(struct(text as v))) - 6)"),
        F.lit(',"what_to_watch":"next","code_paper_links":["'), link, F.lit('"],"hype_check":"'), hype, F.lit('"'),
        F.when(key % 13 == 0, ',"extra":1').otherwise(""), F.lit("}"),
    )


@query(
    "analysis_violations",
    """WITH k AS (SELECT conv_id * 1000 + turn AS call_id, conv_id + turn AS key, text FROM conversations)
    SELECT call_id, array_to_string(list_filter([
      CASE WHEN key % 13 = 0 THEN 'keys' END,
      CASE WHEN key % 5 = 0 THEN 'event_type' END,
      CASE WHEN key % 7 NOT IN (0, 5) THEN 'technical_significance' END,
      CASE WHEN key % 3 = 0 THEN 'who_should_care' END,
      CASE WHEN length(trim(text, ' ' || chr(10))) NOT BETWEEN 1 AND 2400 THEN 'why_it_matters' END,
      CASE WHEN key % 4 IN (0, 1) THEN 'code_paper_links' END,
      CASE WHEN key % 11 = 0 THEN 'hype_check' END], lambda v: v IS NOT NULL), '|') AS violations FROM k""",
)
def analysis_violations(spark, d):
    rows = _outputs(spark, d, _analysis_content)
    return rows.select("call_id", listed(contracts.analysis_violations("content"), "violations"))


@query(
    "violation_report",
    """WITH k AS (SELECT turn % 2 AS parity, conv_id + turn AS key, text FROM conversations)
    SELECT parity, violation, count(*) AS outputs FROM (
      SELECT parity, 'event_type' AS violation FROM k WHERE key % 5 = 0
      UNION ALL SELECT parity, 'hype_check' FROM k WHERE key % 11 = 0
      UNION ALL SELECT parity, 'keys' FROM k WHERE key % 13 = 0
      UNION ALL SELECT parity, 'technical_significance' FROM k WHERE key % 7 NOT IN (0, 5)
      UNION ALL SELECT parity, 'why_it_matters' FROM k WHERE length(trim(text, ' ' || chr(10))) NOT BETWEEN 1 AND 2400
      UNION ALL SELECT parity, 'code_paper_links' FROM k WHERE key % 4 IN (0, 1)
      UNION ALL SELECT parity, 'who_should_care' FROM k WHERE key % 3 = 0) GROUP BY parity, violation""",
)
def violation_report(spark, d):
    rows = _outputs(spark, d, _analysis_content).withColumn("parity", F.col("call_id") % 1000 % 2)
    checked = rows.withColumn("violations", contracts.analysis_violations("content"))
    return contracts.violation_report(checked, "parity")


def _payload(_):
    key = F.col("conv_id") + F.col("turn")
    size = F.octet_length("text")
    out = F.when(key % 6 == 0, -1).otherwise(7)
    hit = F.when(key % 5 == 0, size + 1).otherwise(0)
    total = F.when(key % 7 == 0, size + 99).otherwise(size + out)
    reason = F.when(key % 8 == 0, "length").when(key % 9 == 0, "tool_calls").otherwise("stop")
    content = F.when(key % 10 == 0, "  ").otherwise(F.col("text"))
    return F.to_json(
        F.struct(
            F.struct(
                size.alias("prompt_tokens"), hit.alias("prompt_cache_hit_tokens"),
                out.alias("completion_tokens"), total.alias("total_tokens"),
            ).alias("usage"),
            F.lit("m").alias("model"),
            F.when(key % 4 == 0, "").otherwise("r").alias("id"),
            F.array(F.struct(F.struct(content.alias("content")).alias("message"), reason.alias("finish_reason"))).alias("choices"),
        )
    )


@query(
    "completion_violations",
    """SELECT conv_id * 1000 + turn AS call_id, CASE
      WHEN key % 6 = 0 OR key % 5 = 0 OR key % 7 = 0 THEN 'invalid_usage'
      WHEN key % 4 = 0 THEN 'invalid_response' WHEN key % 8 = 0 THEN 'truncated_output'
      WHEN key % 9 = 0 THEN 'incomplete_output' WHEN key % 10 = 0 OR trim(text, ' ' || chr(10)) = '' THEN 'empty_output' END AS error
    FROM (SELECT *, conv_id + turn AS key FROM conversations)""",
)
def completion_violations(spark, d):
    rows = _outputs(spark, d, _payload)
    return rows.select("call_id", contracts.completion_error("content").alias("error"))


_CALLS = """calls AS (
  SELECT conv_id * 1000 + turn AS call_id, conv_id % 50 AS run_id, conv_id AS cluster_id,
    CASE WHEN turn % 2 = 0 THEN 'summary' ELSE 'analysis' END AS stage,
    CASE WHEN turn % 2 = 0 THEN 'deepseek-flash' ELSE 'deepseek-v4-pro' END AS model,
    md5(text) AS cache_key,
    CASE WHEN role = 'system' THEN 'started' WHEN role = 'user' AND conv_id % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
    strlen(text) AS size, strlen(text) // 4 AS cached, len(regexp_extract_all(text, '\\S+')) AS words,
    CASE WHEN turn % 2 = 0 THEN 0.006 ELSE 0.044 END AS hit, CASE WHEN turn % 2 = 0 THEN 0.30 ELSE 1.32 END AS miss,
    CASE WHEN turn % 2 = 0 THEN 1.20 ELSE 3.96 END AS outp, CASE WHEN turn % 2 = 0 THEN 768 ELSE 2048 END AS most,
    TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 10 + turn AS INTEGER)) AS created_at
  FROM conversations),
ledger AS (
  SELECT *, ((size + 2304) * miss + most * outp)::DOUBLE / 1e6 AS reservation, status <> 'succeeded' AS cost_is_upper_bound,
    CASE WHEN status = 'succeeded' THEN (cached * hit + (size - cached) * miss + words * outp)::DOUBLE / 1e6
         ELSE ((size + 2304) * miss + most * outp)::DOUBLE / 1e6 END AS cost
  FROM calls)"""


def _ledger(spark, d):
    calls = tb.calls(spark, d)
    known = calls.where(F.col("status") == "succeeded").withColumn("returned_model", F.col("model"))
    return ledger.settle(calls, known)


def _usd(name: str):
    return F.round(F.col(name) + 1e-12, 9).alias(name)


@query(
    "cost_ledger",
    f"""WITH {_CALLS} SELECT call_id, run_id, stage, status, cost_is_upper_bound, round(reservation + 1e-12, 9) AS reservation,
    round(cost + 1e-12, 9) AS estimated_cost_usd FROM ledger""",
)
def cost_ledger(spark, d):
    return _ledger(spark, d).select(
        "call_id", "run_id", "stage", "status", "cost_is_upper_bound", _usd("reservation"), _usd("estimated_cost_usd")
    )


@query(
    "run_costs",
    f"WITH {_CALLS} SELECT run_id, round(sum(cost), 6) AS estimated_cost_usd, count(*) AS calls FROM ledger GROUP BY run_id",
)
def run_costs(spark, d):
    return ledger.run_costs(_ledger(spark, d)).select("run_id", F.round("estimated_cost_usd", 6).alias("estimated_cost_usd"), "calls")


@query("total_cost", f"WITH {_CALLS} SELECT round(sum(cost), 6) AS estimated_total_cost_usd FROM ledger")
def total_cost(spark, d):
    return ledger.total_cost(_ledger(spark, d)).select(
        F.round("estimated_total_cost_usd", 6).alias("estimated_total_cost_usd")
    )


@query(
    "recent_calls",
    f"""WITH {_CALLS} SELECT call_id, cluster_id, stage, status, model, round(cost + 1e-12, 9) AS estimated_cost_usd,
    strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM ledger ORDER BY ledger.created_at DESC, call_id LIMIT 20""",
)
def recent_calls(spark, d):
    return ledger.recent_calls(_ledger(spark, d)).select(
        "call_id", "cluster_id", "stage", "status", "model", _usd("estimated_cost_usd"), stamp("created_at")
    )


@query(
    "run_history",
    f"""WITH {_CALLS} SELECT run_id, count(*) AS calls, strftime(min(created_at), '%Y-%m-%d %H:%M:%S.%f') AS started_at
    FROM ledger GROUP BY run_id ORDER BY min(ledger.created_at) DESC, run_id LIMIT 20""",
)
def run_history(spark, d):
    runs = tb.calls(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.min("created_at").alias("started_at"))
    return feed.recent(runs, "started_at", 20, tie="run_id").select("run_id", "calls", stamp("started_at"))


@query(
    "budget_prefix",
    f"""WITH {_CALLS} SELECT call_id, run_id FROM (SELECT *, sum(reservation) OVER (PARTITION BY run_id ORDER BY created_at, call_id) AS spent
    FROM ledger) WHERE spent <= 0.03""",
)
def budget_prefix(spark, d):
    plan = ledger.reserve(tb.calls(spark, d)).select("call_id", "run_id", "created_at", "reservation")
    return ledger.within_budget(plan, 0.03).select("call_id", "run_id")


@query(
    "stage_cache_hits",
    f"""WITH {_CALLS} SELECT DISTINCT k.cache_key, n.call_id AS cached_call_id FROM calls k LEFT JOIN (
      SELECT cache_key, call_id FROM calls WHERE status = 'succeeded'
      QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, call_id) = 1) n USING (cache_key)""",
)
def stage_cache_hits(spark, d):
    calls = tb.calls(spark, d)
    return ledger.cached_outputs(calls, calls.select("cache_key").distinct()).select("cache_key", "cached_call_id")


@query(
    "recovered_calls",
    f"""WITH {_CALLS} SELECT call_id, CASE WHEN status = 'started' THEN 'failed' ELSE status END AS status,
    CASE WHEN status = 'started' THEN 'interrupted' END AS error FROM calls""",
)
def recovered_calls(spark, d):
    calls = tb.calls(spark, d).withColumn("error", F.lit(None).cast("string")).withColumn("finished_at", F.col("created_at"))
    return ledger.recover_calls(calls, tb.AS_OF).select("call_id", "status", "error")


@query(
    "cache_keys",
    f"""WITH {_CALLS} SELECT k.call_id, sha256('{{"max_tokens":' || CASE WHEN k.stage = 'summary' THEN 768 ELSE 2048 END ||
      ',"messages":[{{"content":' || CAST(to_json(c.text) AS VARCHAR) || ',"role":"user"}}],"model":"' || k.model ||
      '","prompt":"summary-v1","provider":"deepseek","stage":"' || k.stage || '"}}') AS cache_key
    FROM calls k JOIN conversations c ON c.conv_id * 1000 + c.turn = k.call_id""",
)
def cache_keys(spark, d):
    calls = tb.calls(spark, d).withColumn("prompt_version", F.lit("summary-v1"))
    message = F.struct(F.lit("user").alias("role"), F.get("messages", F.lit(0)).alias("content"))
    rows = calls.withColumn("messages", F.array(message)).withColumn("max_tokens", F.col("max_tokens").cast("bigint"))
    return ledger.cache_key(rows).select("call_id", "cache_key")


_QUEUE = s.prelude(s.ARTICLES, s.MEMBERS) + """, states AS (
  SELECT cluster_id, max(published_at) AS latest, cluster_id % 4 = 0 AS unchanged, max(words) >= 40 AS enough
  FROM members JOIN articles USING (article_id) GROUP BY cluster_id),
placed AS (SELECT *, row_number() OVER (ORDER BY latest DESC, cluster_id) AS rn,
  coalesce(sum(CASE WHEN NOT unchanged AND enough THEN 1 ELSE 0 END) OVER (ORDER BY latest DESC, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tried
  FROM states),
stop AS (SELECT min(rn) AS rn FROM placed WHERE NOT unchanged AND tried >= 25)
SELECT cluster_id, CASE WHEN unchanged THEN 'cached' WHEN NOT enough THEN 'insufficient_evidence' ELSE 'attempt' END AS outcome
FROM placed WHERE rn < coalesce((SELECT rn FROM stop), 1000000000)"""


def _states(spark, d):
    from eventlens.functions import text as tx

    return (
        tb.members(spark, d)
        .join(tb.articles(spark, d).select("article_id", "published_at", tx.word_count("body").alias("words")), "article_id")
        .groupBy("cluster_id")
        .agg(F.max("published_at").alias("latest_published_at"), (F.max("words") >= 40).alias("enough"))
        .withColumn("unchanged", F.col("cluster_id") % 4 == 0)
    )


@query("analysis_queue", _QUEUE)
def analysis_queue(spark, d):
    return ledger.analysis_queue(_states(spark, d), 25).select("cluster_id", "outcome")


@query(
    "analysis_counts",
    f"""WITH {_CALLS} SELECT count(*) FILTER (status = 'succeeded' AND words >= 8) AS ready, count(*) FILTER (status = 'started') AS cached,
    count(*) FILTER (stage = 'summary') AS summary_cache_hits, count(*) FILTER (stage = 'analysis') AS analysis_cache_hits,
    count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'succeeded' AND words < 8) AS insufficient_evidence FROM calls""",
)
def analysis_counts(spark, d):
    names = F.create_map(*map(F.lit, ("succeeded", "ready", "started", "cached", "failed", "failed")))
    rows = tb.calls(spark, d).select(
        F.when((F.col("status") == "succeeded") & (F.col("output_tokens") < 8), "insufficient_evidence")
        .otherwise(names[F.col("status")])
        .alias("outcome"),
        (F.col("stage") == "summary").alias("summary_cache_hit"),
        (F.col("stage") == "analysis").alias("analysis_cache_hit"),
    )
    return ledger.analysis_counts(rows)


@query(
    "applied_analysis",
    s.BASE + """ SELECT cluster_id, CASE cluster_id % 5 WHEN 0 THEN 'new ' || cluster_id WHEN 1 THEN 'half' WHEN 2 THEN NULL ELSE summary END AS summary,
      CASE cluster_id % 5 WHEN 0 THEN 9 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE significance_score END AS significance_score,
      CASE cluster_id % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'insufficient_evidence' ELSE analysis_status END AS analysis_status
    FROM clusters""",
)
def applied_analysis(spark, d):
    t = tb.load(spark, d)
    clusters = t.clusters.withColumn("analysis_input_hash", F.lit("old")).withColumn("analyzed_at", F.col("latest_published_at"))
    kind = F.col("cluster_id") % 5
    results = clusters.where(kind < 3).select(
        "cluster_id",
        F.when(kind == 0, "ready").when(kind == 1, "failed").otherwise("insufficient_evidence").alias("outcome"),
        F.when(kind == 1, "timeout").alias("error"),
        F.when(kind == 0, F.concat(F.lit("new "), "cluster_id")).when(kind == 1, "half").alias("summary"),
        F.when(kind == 0, "{}").alias("analysis"),
        F.lit(9).alias("significance_score"),
        F.lit("paper").alias("event_type"),
        F.lit("h").alias("input_hash"),
    )
    rows = ledger.apply_analysis(clusters, results, tb.AS_OF)
    return rows.select("cluster_id", "summary", "significance_score", "analysis_status")
