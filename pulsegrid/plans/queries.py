"""Registered queries: the library's operators over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions import scalar as X
from pulsegrid.operators import audit, compare, datasets, gaps, gate, ordering, reference_set, slices, trace, windows
from pulsegrid.schema import NS
from pulsegrid.shared import scratch
from pulsegrid.streaming import jobs

HOUR = 3600 * NS
DAY0 = 1_704_067_200 * NS
NORMAL, INCIDENT = (DAY0, DAY0 + 240 * HOUR), (DAY0 + 360 * HOUR, DAY0 + 600 * HOUR)
W = 6 * HOUR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return schema.messages_from_events(events(spark, d))


def trace_events(spark: SparkSession, d: str) -> DataFrame:
    return schema.trace_events_from_events(events(spark, d))


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


M = "m AS (SELECT 'r' || (user_id % 4) AS run_id, event_type AS topic, epoch_us(ts) * 1000 AS t, event_id AS a, length(props)::BIGINT AS size FROM events)"
TR = "e AS (SELECT 'e' || event_id AS event_id, event_id AS seq, event_type, '/' || event_type AS source_topic, 'n' || (user_id % 3) AS source_node, 'ROS' AS clock_domain, 'LOG' AS time_source, epoch_us(ts) / 1e6 AS ros_time, props AS raw, user_id FROM events)"


def gap_sql(keys: str, source: str, name: str = "g") -> str:
    return f"""{name}0 AS (SELECT {keys}, t, t - lag(t) OVER (PARTITION BY {keys} ORDER BY t) AS gap FROM {source}),
{name} AS (SELECT {keys}, count(*) AS n, min(t) AS f, max(t) AS l, count(gap) AS gn, coalesce(sum(gap::HUGEINT), 0) AS gs, coalesce(sum(gap::HUGEINT * gap::HUGEINT), 0) AS gq, coalesce(max(gap), 0) AS gm FROM {name}0 GROUP BY {keys})"""


STATS = """CASE WHEN n >= 2 THEN (l - f) / 1e9 ELSE 0 END AS span_sec,
CASE WHEN n >= 2 AND l > f THEN (n - 1) / ((l - f) / 1e9) ELSE 0 END AS observed_hz,
CASE WHEN n >= 2 THEN gs::DOUBLE / greatest(gn, 1) / 1e9 ELSE 0 END AS avg_gap_sec,
CASE WHEN n >= 2 THEN gm / 1e9 ELSE 0 END AS max_gap_sec,
CASE WHEN n >= 2 THEN sqrt((gn::HUGEINT * gq - gs * gs)::DOUBLE) / greatest(gn, 1) / 1e9 ELSE 0 END AS jitter_sec"""


def jitter_sql(source: str, name: str) -> str:
    return f"""{name}1 AS (SELECT *, CASE WHEN gn > 0 THEN (gn::HUGEINT * gq - gs * gs) // (gn::HUGEINT * gn) ELSE 0 END AS v FROM {source}),
{name}2 AS (SELECT *, floor(sqrt(v::DOUBLE))::HUGEINT AS r FROM {name}1),
{name} AS (SELECT *, (CASE WHEN (CASE WHEN r * r > v THEN r ELSE r + 1 END) * (CASE WHEN r * r > v THEN r ELSE r + 1 END) <= v THEN r + 1 WHEN r * r > v THEN r - 1 ELSE r END)::BIGINT AS jit FROM {name}2)"""


def window_sql(w: int, source: str = "m") -> str:
    return f"""w0 AS (SELECT {source}.*, g0, (t - g0) // {w} AS w FROM {source} JOIN (SELECT run_id, min(t) AS g0 FROM {source} GROUP BY run_id) USING (run_id)),
w1 AS (SELECT *, t - lag(t) OVER (PARTITION BY run_id, topic, w ORDER BY a) AS gap FROM w0),
w2 AS (SELECT run_id, topic, g0, w, count(*) AS n, min(t) AS f, max(t) AS l, count(gap) AS gn, coalesce(sum(gap::HUGEINT), 0) AS gs, coalesce(sum(gap::HUGEINT * gap::HUGEINT), 0) AS gq, coalesce(max(gap), 0) AS gm FROM w1 GROUP BY run_id, topic, g0, w),
{jitter_sql("w2", "win")}"""


PROFILE = f"""p0 AS (SELECT *, f - lag(l) OVER (PARTITION BY run_id, topic ORDER BY w) AS x FROM win),
p1 AS (SELECT run_id, topic, sum(n)::BIGINT AS n, min(f) AS f, max(l) AS l, (sum(gn) + count(x))::BIGINT AS gn, sum(gs)::HUGEINT + coalesce(sum(x::HUGEINT), 0) AS gs, sum(gq)::HUGEINT + coalesce(sum(x::HUGEINT * x::HUGEINT), 0) AS gq, greatest(max(gm), coalesce(max(x), 0)) AS gm, count(*) AS wins FROM p0 GROUP BY run_id, topic),
{jitter_sql("p1", "prof")}"""
PROFILE_COLUMNS = "n AS count, f AS first_ns, l AS last_ns, l - f AS duration_ns, CASE WHEN gn > 0 THEN (gs // greatest(gn, 1))::BIGINT ELSE 0 END AS avg_gap_ns, gm AS max_gap_ns, jit AS jitter_ns, wins AS finalized_window_count"
MISSING = """miss AS (SELECT * FROM (SELECT run_id, topic, w, f, g0, lag(w) OVER (PARTITION BY run_id, topic ORDER BY w) AS b, lag(l) OVER (PARTITION BY run_id, topic ORDER BY w) AS pl FROM win) WHERE w - b > 1)"""


# --- profiles, windows, ranking ------------------------------------------------------------------------------------


@query(f"WITH {M}, s AS (SELECT * FROM m WHERE t >= {NORMAL[0]} AND t < {NORMAL[1]}), {gap_sql('topic', 's')} SELECT topic, count, first_ns, last_ns, round(span_sec, 6) AS span_sec, round(observed_hz, 6) AS observed_hz, round(avg_gap_sec, 6) AS avg_gap_sec, round(max_gap_sec, 6) AS max_gap_sec, round(jitter_sec, 6) AS jitter_sec, round(count / {(NORMAL[1] - NORMAL[0]) / NS}, 6) AS window_hz FROM (SELECT topic, n AS count, f AS first_ns, l AS last_ns, {STATS} FROM g)")
def topic_profile_range(spark, d):
    """Topics of a time range by observed rate."""
    m = slices.time_slice(messages(spark, d), *NORMAL)
    out = gaps.range_stats(m, ["topic"], (NORMAL[1] - NORMAL[0]) / NS)
    return rounded(out, "span_sec", "observed_hz", "avg_gap_sec", "max_gap_sec", "jitter_sec", "window_hz").orderBy(F.desc("observed_hz"), "topic")


@query(f"WITH {M}, {window_sql(W)} SELECT run_id, topic, w AS window, g0 + w * {W} AS start_ns, n AS count, f AS first_ns, l AS last_ns, gm AS gap_max, jit AS jitter_ns FROM win")
def observed_windows(spark, d):
    """Aligned windows that have messages."""
    return windows.observed_windows(messages(spark, d), W).select("run_id", "topic", "window", "start_ns", "count", "first_ns", "last_ns", "gap_max", "jitter_ns")


@query(f"WITH {M}, {window_sql(W)}, {PROFILE} SELECT run_id, topic, {PROFILE_COLUMNS} FROM prof")
def run_profile(spark, d):
    """Exact integer profile of every run and topic."""
    return windows.run_profile(windows.observed_windows(messages(spark, d), W))


def metadata(m: DataFrame) -> DataFrame:
    """Stated rates for the topics before p: what each has over 30 days."""
    return m.where("topic < 'p'").groupBy("topic").agg((F.count(F.lit(1)) / 2_592_000.0).alias("expected_hz")).withColumn("sensor_category", F.lit("stated"))


@query(f"WITH {M}, {window_sql(W)}, md AS (SELECT topic, count(*) / 2592000.0 AS hz FROM m WHERE topic < 'p' GROUP BY topic) SELECT run_id, topic, w AS window, n AS count, coalesce(CASE WHEN hz IS NOT NULL THEN 'stated' END, 'unknown') AS sensor_category, CASE WHEN hz IS NOT NULL THEN greatest(1, round_even(hz * 21600.0, 0)::BIGINT) ELSE first_value(n) OVER (PARTITION BY run_id, topic ORDER BY w) END AS expected_count FROM win LEFT JOIN md USING (topic)")
def expected_counts(spark, d):
    """Expected messages per window, stated or from the first window."""
    m = messages(spark, d)
    return windows.expected_counts(windows.observed_windows(m, W), W / NS, metadata(m)).select("run_id", "topic", "window", "count", "sensor_category", "expected_count")


@query(f"WITH {M}, {window_sql(HOUR)}, {MISSING} SELECT run_id, topic, f - pl AS gap_ns, b + 1 AS first_missing, w AS next_window, w - b - 1 AS missing_window_count, pl AS previous_observed_ns, f AS next_observed_ns FROM miss")
def missing_intervals(spark, d):
    """Stretches of windows without a message."""
    return windows.missing_intervals(windows.observed_windows(messages(spark, d), HOUR)).drop("run_start_ns")


@query(
    f"""WITH {M}, {window_sql(HOUR)}, {MISSING}, ex AS (SELECT *, first_value(n) OVER (PARTITION BY run_id, topic ORDER BY w) AS expected FROM win),
tm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, topic ORDER BY f - pl DESC, b DESC, w DESC) AS k FROM miss) WHERE k <= 5),
pool AS (SELECT run_id, topic, w AS "window", n AS count, expected, gm, jit, 'observed_window' AS evidence_kind, 0 AS missing_window_count FROM ex UNION ALL
SELECT tm.run_id, tm.topic, b + 1, 0, x.expected, f - pl, 0, 'sparse_missing_interval', w - b - 1 FROM tm JOIN (SELECT run_id, topic, max(expected) AS expected FROM ex GROUP BY run_id, topic) x USING (run_id, topic)),
sc AS (SELECT *, 10 * (CASE WHEN expected > 0 THEN greatest(0.0, (expected - count) / expected::DOUBLE) ELSE 0 END) + 10 * (gm / 1e9) + 5 * (jit / 1e9) AS score FROM pool)
SELECT run_id, topic, "window", count, expected AS expected_count, round(count / expected::DOUBLE, 6) AS count_ratio, gm AS max_gap_ns, jit AS jitter_ns, round(score, 6) AS score, evidence_kind, missing_window_count::BIGINT AS missing_window_count, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, topic ORDER BY score DESC, "window" ASC) AS rank FROM sc) WHERE rank <= 5"""
)
def top_evidence(spark, d):
    """The flagship report's ranked windows, observed and missing ones pooled."""
    ranked = windows.timing_report(messages(spark, d), HOUR, 5)[1]
    return rounded(ranked, "count_ratio", "score").select("run_id", "topic", "window", "count", "expected_count", "count_ratio", "max_gap_ns", "jitter_ns", "score", "evidence_kind", "missing_window_count", "rank")


@query(f"WITH {M}, {window_sql(W)}, {PROFILE}, dm AS (SELECT run_id, topic, a, t - CASE WHEN a % 7 = 0 THEN {3 * HOUR} ELSE 0 END AS t FROM m), r1 AS (SELECT *, coalesce(t < max(t) OVER (PARTITION BY run_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {2 * HOUR}, false) AS late FROM dm), r2 AS (SELECT *, coalesce(t < max(CASE WHEN NOT late THEN t END) OVER (PARTITION BY run_id, topic ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ooo FROM r1), dc AS (SELECT run_id, count(*) FILTER (late) AS late, count(*) FILTER (ooo) AS out_of_order FROM r2 GROUP BY 1) SELECT run_id, sum(n)::BIGINT AS total_messages, count(*) AS topics, any_value(late) AS late, any_value(out_of_order) AS out_of_order FROM prof JOIN dc USING (run_id) GROUP BY run_id")
def run_summary(spark, d):
    """Messages and topics per run, with what arrived late and out of order."""
    m = messages(spark, d)
    found = ordering.disorder_counts(ordering.disorder(schema.disordered(m), 2 * HOUR))
    return windows.run_summary(windows.run_profile(windows.observed_windows(m, W)), found)


@query(
    f"""WITH {M}, b AS (SELECT run_id, min(t) AS s FROM m GROUP BY 1), o AS (SELECT run_id, topic, (t - s) // {W} AS k, min(a) AS opened, min(s + ((t - s) // {W} + 1) * {W} + {2 * HOUR}) AS till FROM m JOIN b USING (run_id) GROUP BY 1, 2, 3),
c AS (SELECT o.run_id, opened, min(m.a) AS closed FROM o LEFT JOIN m ON m.run_id = o.run_id AND m.t >= till GROUP BY o.run_id, o.topic, o.k, opened), st AS (SELECT run_id, opened AS pos, 1 AS step FROM c UNION ALL SELECT run_id, closed, -1 FROM c WHERE closed IS NOT NULL), e AS (SELECT run_id, pos, sum(step) AS step FROM st GROUP BY 1, 2)
SELECT run_id, max(n)::BIGINT AS peak_open FROM (SELECT run_id, sum(step) OVER (PARTITION BY run_id ORDER BY pos) AS n FROM e) GROUP BY 1"""
)
def peak_open_windows(spark, d):
    """ST5: the most windows open at once, from the batch rows."""
    return windows.peak_open(messages(spark, d), W, 2 * HOUR)


BOUNDS = "b AS (SELECT min(t) AS s, max(t) AS x FROM m)"
DENSE = f"""{BOUNDS}, grid AS (SELECT topic, w, s + w * {W} AS st, least(s + (w + 1) * {W}, x) AS en FROM b, (SELECT unnest(generate_series(0, 200)) AS w), (SELECT DISTINCT topic FROM m) WHERE s + w * {W} < x),
placed AS (SELECT topic, t, (t - s) // {W} AS w FROM m, b WHERE t < x), {gap_sql('topic, w', 'placed')},
st AS (SELECT topic, w, n, {STATS} FROM g),
dense AS (SELECT grid.topic, grid.w AS w, st AS start_ns, en AS stop_ns, coalesce(n, 0) AS n, coalesce(max_gap_sec, 0) AS max_gap_sec, coalesce(jitter_sec, 0) AS jitter_sec, (en - st) / 1e9 AS duration_sec FROM grid LEFT JOIN st USING (topic, w))"""


def dense(spark, d):
    m = messages(spark, d)
    b = m.agg(F.min("log_time_ns").alias("start_ns"), F.max("log_time_ns").alias("end_ns"))
    return windows.dense_windows(m, m.select("topic").distinct().join(F.broadcast(b), how="cross"), W, ["topic"])  # b is one row


@query(f"WITH {M}, {DENSE} SELECT topic, w AS window, start_ns, stop_ns, n AS count, round(max_gap_sec, 6) AS max_gap_sec, round(jitter_sec, 6) AS jitter_sec, round(n / duration_sec, 6) AS window_hz FROM dense")
def dense_windows(spark, d):
    """All windows between first and last message, empty ones too."""
    return rounded(dense(spark, d), "max_gap_sec", "jitter_sec", "window_hz").select("topic", "window", "start_ns", "stop_ns", "count", "max_gap_sec", "jitter_sec", "window_hz")


def log_sql(a: str, b: str) -> str:
    return f"(CASE WHEN abs({a}) <= 1e-9 AND abs({b}) <= 1e-9 THEN 0 WHEN abs({a}) <= 1e-9 OR abs({b}) <= 1e-9 THEN 10 ELSE abs(ln({a} / {b})) END)"


@query(
    f"""WITH {M}, {DENSE}, med AS (SELECT topic, list_sort(list(n))[count(*) // 2 + 1] AS bn, list_sort(list(max_gap_sec))[count(*) // 2 + 1] AS bg, list_sort(list(jitter_sec))[count(*) // 2 + 1] AS bj FROM dense WHERE n >= 2 GROUP BY topic),
sc AS (SELECT topic, w, n, round({log_sql("n::DOUBLE", "bn::DOUBLE")} + {log_sql("max_gap_sec", "bg")} + {log_sql("jitter_sec", "bj")} + CASE WHEN n = 0 THEN 10 ELSE 0 END, 6) AS score FROM dense JOIN med USING (topic) WHERE duration_sec >= {W / NS} * 0.999)
SELECT topic, w AS window, n AS count, score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, w) AS k FROM sc) WHERE k <= 10"""
)
def baseline_ranking(spark, d):
    """Full windows by their distance from their topic's medians."""
    full = windows.full_windows(dense(spark, d), W / NS)
    scored = full.join(windows.baseline_medians(dense(spark, d), ["topic"]), "topic").withColumn("score", F.round(X.baseline_score("count", "max_gap_sec", "jitter_sec", "base_count", "base_max_gap_sec", "base_jitter_sec"), 6))
    return windows.top_windows(scored, 10, ["topic"]).select("topic", "window", "count", "score")


@query(f"WITH {M}, s AS (SELECT * FROM m WHERE topic IN ('click', 'view') AND t >= {INCIDENT[0]} AND t < {INCIDENT[1]}) SELECT run_id, topic, count(*) AS count, min(t) AS first_ns, min_by(a, t) AS first_seq, max(t) AS last_ns, max_by(a, t) AS last_seq FROM s GROUP BY run_id, topic")
def slice_summary(spark, d):
    """Counts and first / last message of a slice."""
    return slices.slice_summary(slices.time_slice(messages(spark, d), *INCIDENT, topics=["click", "view"]), ["run_id", "topic"])


@query(f"WITH {M}, q AS (SELECT topic || '-' || h AS window_id, topic, h * {HOUR} AS s FROM (SELECT DISTINCT topic FROM m), (SELECT DISTINCT t // {HOUR} AS h FROM m WHERE a % 50 = 0)), x AS (SELECT topic, t // {HOUR} * {HOUR} AS s, count(*) AS n, min(t) AS f, max(t) AS l FROM m GROUP BY 1, 2) SELECT window_id, topic, s AS start_ns, coalesce(n, 0) AS observed_count, 2 AS expected_count, coalesce(n, 0) / 2.0::DOUBLE AS count_ratio, round(coalesce((l - f) / 1e9, 0), 6) AS active_span_sec, round(greatest(0, 3600 - coalesce((l - f) / 1e9, 0)), 6) AS silent_span_sec, CASE WHEN n IS NULL THEN 'OBSERVED_EMPTY_WINDOW' ELSE 'OBSERVED_WINDOW' END AS evidence_level FROM q LEFT JOIN x USING (topic, s)")
def evidence_windows(spark, d):
    """Many stated windows in one job."""
    m = messages(spark, d)
    hours = m.where("arrival_seq % 50 = 0").select(F.floor(F.col("log_time_ns") / F.lit(HOUR).cast("decimal(20,0)")).cast("bigint").alias("h")).distinct()
    q = m.select("topic").distinct().join(hours, how="cross").select(F.concat("topic", F.lit("-"), F.col("h").cast("string")).alias("window_id"), "topic", (F.col("h") * HOUR).alias("start_ns"), F.lit(2).alias("expected_count"))
    return rounded(slices.evidence_window(m, q, HOUR), "active_span_sec", "silent_span_sec").drop("first_ns", "last_ns")


CH = f"ch AS (SELECT run_id || '-' || (t // {24 * HOUR}) AS chunk_id, min(t) AS ms, max(t) AS me FROM m GROUP BY 1), q AS (SELECT a AS query_id, topic, t AS s, t + {12 * HOUR} AS e FROM m WHERE a % 40 = 0)"


def chunks_and_queries(m: DataFrame):
    day = F.floor(F.col("log_time_ns") / F.lit(24 * HOUR).cast("decimal(20,0)")).cast("bigint")
    chunks = m.groupBy(F.concat("run_id", F.lit("-"), day.cast("string")).alias("chunk_id")).agg(F.min("log_time_ns").alias("message_start_ns"), F.max("log_time_ns").alias("message_end_ns"))
    queries = m.where("arrival_seq % 40 = 0").select(F.col("arrival_seq").alias("query_id"), "topic", F.col("log_time_ns").alias("start_ns"), (F.col("log_time_ns") + 12 * HOUR).alias("end_ns"))
    return chunks, queries


@query(f"WITH {M}, {CH} SELECT query_id, chunk_id, s AS start_ns, e AS end_ns, ms AS message_start_ns, me AS message_end_ns FROM q JOIN ch ON ms <= e AND me >= s")
def overlapping_chunks(spark, d):
    """Chunks whose closed range meets a query's, by buckets of their own size."""
    chunks, q = chunks_and_queries(messages(spark, d))
    return slices.overlapping_chunks(q, chunks).select("query_id", "chunk_id", "start_ns", "end_ns", "message_start_ns", "message_end_ns")


@query(f"WITH {M}, {CH}, h AS (SELECT a AS query_id, count(*) AS n FROM m WHERE a % 80 = 0 GROUP BY 1), o AS (SELECT query_id, count(*) AS k FROM q JOIN ch ON ms <= e AND me >= s GROUP BY 1), b AS (SELECT min(t) AS lo, max(t) - {48 * HOUR} AS hi FROM m) SELECT query_id, CASE WHEN n > 0 THEN 'has_result' WHEN e < lo OR s > hi THEN 'outside_range' WHEN k IS NULL THEN 'no_chunk' WHEN topic IS NOT NULL THEN 'topic_silent' ELSE 'sparse' END AS reason FROM q CROSS JOIN b LEFT JOIN o USING (query_id) LEFT JOIN h USING (query_id)")
def no_result_reason(spark, d):
    """why a query has no result."""
    m = messages(spark, d)
    chunks, q = chunks_and_queries(m)
    bounds = m.agg(F.min("log_time_ns").alias("file_start_ns"), (F.max("log_time_ns") - 48 * HOUR).alias("file_end_ns"))
    return slices.no_result_reason(q, bounds, chunks, m.where("arrival_seq % 80 = 0").select(F.col("arrival_seq").alias("query_id")))


@query(f"WITH {M}, {CH}, c AS (SELECT * FROM ch WHERE chunk_id = 'r1-' || {DAY0 // (24 * HOUR) + 3}) SELECT m.run_id, m.topic, count(*) AS count FROM m, c WHERE t BETWEEN ms AND me GROUP BY 1, 2")
def chunk_slice(spark, d):
    """messages in the range of one chunk."""
    m = messages(spark, d)
    return slices.chunk_slice(m, chunks_and_queries(m)[0], f"r1-{DAY0 // (24 * HOUR) + 3}").groupBy("run_id", "topic").agg(F.count(F.lit(1)).alias("count"))


@query(f"WITH {M}, {window_sql(W)}, ex AS (SELECT *, row_number() OVER (PARTITION BY run_id, topic ORDER BY gm DESC, w) AS rank FROM win) , tp AS (SELECT run_id, topic, min_by(n, w) AS usual FROM win GROUP BY 1, 2) SELECT e.run_id, e.topic, e.w AS window, e.rank::INT AS rank, tp.topic AS other_topic, coalesce(o.n, 0) AS other_count, usual AS other_expected_count FROM ex e JOIN tp ON e.run_id = tp.run_id AND e.topic <> tp.topic LEFT JOIN win o ON o.run_id = e.run_id AND o.w = e.w AND o.topic = tp.topic WHERE e.rank <= 3")
def silent_together(spark, d):
    """What other topics did in the windows with the largest gaps, silence included."""
    w = windows.expected_counts(windows.observed_windows(messages(spark, d), W), W / NS)
    return windows.silent_together(windows.top_windows(w, 3, score="gap_max"), w)


# --- comparisons ---------------------------------------------------------------------------------------------------


def sides_sql(keys: str) -> str:
    return f"""s AS (SELECT *, 'n' AS side FROM m WHERE t >= {NORMAL[0]} AND t < {NORMAL[1]} UNION ALL SELECT *, 'i' FROM m WHERE t >= {INCIDENT[0]} AND t < {INCIDENT[1]}), {gap_sql(keys + ", side", "s")},
st AS (SELECT {keys}, side, n, n / 864000.0 AS window_hz, {STATS} FROM g)"""


@query(f"WITH {M}, {sides_sql('topic')}, l AS (UNPIVOT (SELECT topic, side, n::DOUBLE AS count, window_hz::DOUBLE AS window_hz, observed_hz::DOUBLE AS observed_hz, avg_gap_sec::DOUBLE AS avg_gap_sec, max_gap_sec::DOUBLE AS max_gap_sec, jitter_sec::DOUBLE AS jitter_sec FROM st WHERE topic = 'click') ON count, window_hz, observed_hz, avg_gap_sec, max_gap_sec, jitter_sec INTO NAME metric VALUE v) SELECT topic, metric, round(max(v) FILTER (side = 'n'), 6) AS normal, round(max(v) FILTER (side = 'i'), 6) AS incident, round(max(v) FILTER (side = 'i') / max(v) FILTER (side = 'n'), 6) AS ratio FROM l GROUP BY topic, metric")
def compare_topic(spark, d):
    """One topic in two ranges."""
    return rounded(compare.compare_topic(messages(spark, d), "click", NORMAL, INCIDENT), "normal", "incident", "ratio")


@query(
    f"""WITH {M}, {sides_sql('run_id, topic')}, x AS (SELECT run_id, topic, coalesce(max(n) FILTER (side = 'n'), 0) AS nc, coalesce(max(n) FILTER (side = 'i'), 0) AS ic, max(max_gap_sec) FILTER (side = 'n') AS ng, max(max_gap_sec) FILTER (side = 'i') AS ig, max(jitter_sec) FILTER (side = 'n') AS nj, max(jitter_sec) FILTER (side = 'i') AS ij FROM st GROUP BY 1, 2),
r AS (SELECT run_id, topic, nc, ic, ic / nc::DOUBLE AS rc, ig / ng AS rg, ij / nj AS rj FROM x),
c AS (SELECT *, greatest(abs(ln(rc)), abs(ln(rg)), abs(ln(rj))) AS dev, list_filter([{{'d': abs(ln(rc)), 'k': 'count', 'v': rc}}, {{'d': abs(ln(rg)), 'k': 'max_gap', 'v': rg}}, {{'d': abs(ln(rj)), 'k': 'jitter', 'v': rj}}], lambda z: z.v >= 1.5 OR z.v <= 1 / 1.5) AS out FROM r)
SELECT run_id, topic, nc AS n_count, ic AS i_count, round(rc, 6) AS count_ratio, round(rg, 6) AS max_gap_ratio, round(rj, 6) AS jitter_ratio, CASE WHEN least(nc, ic) < 5 THEN 'low' ELSE 'normal' END AS confidence, len(out) > 0 AS highlight, round(dev, 6) AS deviation, CASE WHEN len(out) = 0 THEN 'within_threshold' ELSE list_sort(out, 'DESC')[1].k || '_ratio' END AS reason FROM c"""
)
def compare_topics(spark, d):
    """All topics of all runs in two ranges."""
    m = messages(spark, d)
    out = compare.compare_topics(m, m, NORMAL, INCIDENT, ["run_id", "topic"])
    out = rounded(out, "count_ratio", "max_gap_ratio", "jitter_ratio", "deviation").withColumn("reason", F.split_part("reason", F.lit("="), F.lit(1)))
    return out.select("run_id", "topic", "n_count", "i_count", "count_ratio", "max_gap_ratio", "jitter_ratio", "confidence", "highlight", "deviation", "reason").orderBy(F.desc_nulls_last("deviation"), "run_id", "topic")


FINE = "fm AS (SELECT run_id, topic || '_' || (a % 400) AS topic FROM m)"


@query(f"WITH {M}, {FINE}, r AS (SELECT DISTINCT topic FROM fm WHERE run_id = 'r0'), g AS (SELECT DISTINCT topic FROM fm WHERE run_id = 'r1') SELECT coalesce(r.topic, g.topic) AS topic, CASE WHEN r.topic IS NULL THEN 'target_only' WHEN g.topic IS NULL THEN 'reference_only' ELSE 'common' END AS side FROM r FULL JOIN g ON r.topic = g.topic")
def topic_sides(spark, d):
    """Topics of two runs as common or of one side only."""
    fine = messages(spark, d).withColumn("topic", F.concat("topic", F.lit("_"), (F.col("arrival_seq") % 400).cast("string")))
    return compare.topic_sides(fine.where("run_id = 'r0'"), fine.where("run_id = 'r1'"), ["topic"])


def pairs(m: DataFrame) -> DataFrame:
    runs = m.select("run_id").distinct()
    return runs.select(F.col("run_id").alias("reference_id")).join(runs.select(F.col("run_id").alias("target_id")), F.col("reference_id") < F.col("target_id"))


def fields(spark, d):
    m = messages(spark, d)
    w = windows.expected_counts(windows.observed_windows(m, HOUR), 3600.0)
    profile = windows.run_profile(w)
    ranked = windows.top_windows(windows.evidence(w, windows.missing_intervals(w)), 5)
    return m, profile, compare.evidence_summary(profile, ranked), ranked


FIELDS = f"""{M}, {window_sql(HOUR)}, {PROFILE}, pf AS (SELECT run_id, topic, {PROFILE_COLUMNS} FROM prof),
l AS (UNPIVOT (SELECT run_id, topic, count::DOUBLE AS count, duration_ns::DOUBLE AS duration_ns, avg_gap_ns::DOUBLE AS avg_gap_ns, max_gap_ns::DOUBLE AS max_gap_ns, jitter_ns::DOUBLE AS jitter_ns, finalized_window_count::DOUBLE AS finalized_window_count FROM pf) ON count, duration_ns, avg_gap_ns, max_gap_ns, jitter_ns, finalized_window_count INTO NAME k VALUE v),
cf AS (SELECT a.run_id AS reference_id, b.run_id AS target_id, a.topic, 'profile.' || a.k AS field, a.v AS reference, b.v AS target FROM l a JOIN l b ON a.topic = b.topic AND a.k = b.k AND a.run_id < b.run_id)"""


@query(f"WITH {FIELDS} SELECT reference_id, target_id, topic, field, reference, target, target - reference AS delta, round(CASE WHEN reference = 0 AND target = 0 THEN 1 WHEN reference = 0 THEN NULL ELSE target / reference END, 6) AS ratio, CASE WHEN reference = 0 AND target = 0 THEN 'both_zero' WHEN reference = 0 THEN 'reference_zero' ELSE 'finite' END AS ratio_state, reference <> target AS changed FROM cf")
def compare_profiles(spark, d):
    """Nine-number profiles of all pairs of runs."""
    m, profile, _, _ = fields(spark, d)
    return rounded(compare.compare_fields(pairs(m), profile), "ratio").drop("non_comparable")


EVIDENCE = f"""{M}, {window_sql(HOUR)}, {MISSING}, ex AS (SELECT *, first_value(n) OVER (PARTITION BY run_id, topic ORDER BY w) AS expected FROM win),
pool AS (SELECT run_id, topic, w AS "window", n AS count, expected, gm, jit FROM ex UNION ALL SELECT miss.run_id, miss.topic, b + 1, 0, x.expected, f - pl, 0 FROM miss JOIN (SELECT run_id, topic, max(expected) AS expected FROM ex GROUP BY run_id, topic) x USING (run_id, topic)),
sc AS (SELECT *, 10 * (CASE WHEN expected > 0 THEN greatest(0.0, (expected - count) / expected::DOUBLE) ELSE 0 END) + 10 * (gm / 1e9) + 5 * (jit / 1e9) AS score FROM pool),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, topic ORDER BY score DESC, "window" ASC) AS rank FROM sc) WHERE rank <= 5),
es AS (SELECT run_id, topic, count(*) AS selected_window_count, max(score) AS max_score, avg(score) AS mean_score, min(count / expected::DOUBLE) AS min_count_ratio, max(gm) AS max_gap_ns, max(jit) AS max_jitter_ns FROM top GROUP BY run_id, topic)"""


@query(f"WITH {EVIDENCE} SELECT run_id, topic, selected_window_count, round(max_score, 5) AS max_score, round(mean_score, 5) AS mean_score, round(min_count_ratio, 6) AS min_count_ratio, max_gap_ns, max_jitter_ns FROM es")
def evidence_summary(spark, d):
    """The selected windows of every run and topic in six numbers."""
    return rounded(rounded(fields(spark, d)[2], "max_score", "mean_score", places=5), "min_count_ratio")


@query(f"WITH {EVIDENCE}, l AS (UNPIVOT (SELECT run_id, topic, selected_window_count::DOUBLE AS selected_window_count, max_score::DOUBLE AS max_score, mean_score::DOUBLE AS mean_score, min_count_ratio::DOUBLE AS min_count_ratio, max_gap_ns::DOUBLE AS max_gap_ns, max_jitter_ns::DOUBLE AS max_jitter_ns FROM es) ON selected_window_count, max_score, mean_score, min_count_ratio, max_gap_ns, max_jitter_ns INTO NAME k VALUE v) SELECT a.run_id AS reference_id, b.run_id AS target_id, a.topic, 'evidence.' || a.k AS field, round(a.v, 4) AS reference, round(b.v, 4) AS target, round(b.v - a.v, 4) AS delta, CASE WHEN a.v = 0 AND b.v = 0 THEN 'both_zero' WHEN a.v = 0 THEN 'reference_zero' ELSE 'finite' END AS ratio_state FROM l a JOIN l b ON a.topic = b.topic AND a.k = b.k AND a.run_id < b.run_id")
def compare_evidence(spark, d):
    """Evidence summaries of all pairs of runs."""
    m, profile, summary, _ = fields(spark, d)
    out = compare.compare_fields(pairs(m), profile, summary).where("field like 'evidence.%'").drop("ratio", "changed", "non_comparable")
    return rounded(out, "reference", "target", "delta", places=4)


@query(f"WITH {FIELDS} SELECT reference_id, target_id, topic, string_agg(CASE WHEN reference <> target THEN field END, ',' ORDER BY field) AS changed_fields FROM cf GROUP BY 1, 2, 3")
def changed_fields(spark, d):
    """Sorted changed fields."""
    m, profile, _, _ = fields(spark, d)
    return compare.changed_fields(compare.compare_fields(pairs(m), profile)).withColumn("changed_fields", F.array_join("changed_fields", ","))


@query(f"WITH {FIELDS} SELECT reference_id, target_id, split_part(field, '.', 1) AS namespace, count(*) AS changed FROM cf WHERE reference <> target GROUP BY 1, 2, 3")
def namespace_counts(spark, d):
    """Changed fields by namespace."""
    m, profile, _, _ = fields(spark, d)
    return compare.namespace_counts(compare.compare_fields(pairs(m), profile))


@query(f"WITH {FIELDS}, x AS (SELECT reference_id, target_id, topic, bool_or(reference <> target) AS c FROM cf GROUP BY 1, 2, 3) SELECT reference_id, target_id, count(*) AS common, 0::BIGINT AS reference_only, 0::BIGINT AS target_only, count(*) FILTER (c) AS profile_changed, count(*) FILTER (NOT c) AS profile_identical FROM x GROUP BY 1, 2")
def comparison_summary(spark, d):
    """Identical and changed topics of all pairs."""
    m, profile, _, _ = fields(spark, d)
    p = pairs(m)
    f = compare.compare_fields(p, profile)
    return compare.comparison_summary(f, f.select("reference_id", "target_id", "topic").distinct().withColumn("side", F.lit("common"))).drop("evidence_changed", "evidence_identical")


@query(f"WITH {FIELDS} SELECT a.run_id AS reference_id, b.run_id AS target_id, a.topic, x.f AS field, CASE x.f WHEN 'timestamps.first_ns' THEN a.first_ns <> b.first_ns ELSE a.last_ns <> b.last_ns END AS changed FROM pf a JOIN pf b ON a.topic = b.topic AND a.run_id < b.run_id, (VALUES ('timestamps.first_ns'), ('timestamps.last_ns')) x(f)")
def compare_context(spark, d):
    """Context by equality, first and last times apart."""
    m, profile, _, _ = fields(spark, d)
    return compare.compare_context(pairs(m), profile)


def manifests(spark, d):
    """A manifest per user of the events table; every seventh uses another window, every eleventh another engine version."""
    u = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("user_id")
    return u.select(
        F.concat(F.lit("b"), k.cast("string")).alias("run_id"), F.lit("timing_bundle").alias("schema_name"), F.when(k % 13 == 5, None).otherwise(F.lit("1")).alias("schema_version"),
        F.struct(F.lit("bundle").alias("name"), F.lit("1").alias("version")).alias("bundle_schema"), F.struct(F.lit("engine").alias("name"), F.when(k % 11 == 0, "2").otherwise("1").alias("version")).alias("engine"),
        F.struct(F.lit("mcap").alias("format")).alias("source"),
        F.struct(F.lit("observed").alias("semantics"), F.lit("windowed").alias("mode"), F.lit("ns").alias("timestamp_unit"), F.when(k % 7 == 0, 2.0).otherwise(1.0).alias("window_sec"), F.lit(2.0).alias("allowed_lateness_sec"), F.when(k % 17 == 3, 0).otherwise(5).alias("top")).alias("extraction"),
    )


def members(spark, d):
    """Reference sets of up to three users: revision v<user div 3>."""
    return events(spark, d).select("user_id").distinct().select(F.concat(F.lit("v"), F.floor(F.col("user_id") / 3).cast("string")).alias("revision_id"), F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("report_bundle_id"))


MEM = "u AS (SELECT DISTINCT user_id AS k FROM events), mem AS (SELECT 'v' || (k // 3) AS revision_id, 'b' || k AS report_bundle_id, k FROM u)"
GATE = f"""{MEM}, anc AS (SELECT revision_id, min(report_bundle_id) AS anchor FROM mem GROUP BY 1), pr AS (SELECT a.k AS rk, m.k AS tk, anc.anchor AS reference_id, m.report_bundle_id AS target_id, m.revision_id FROM mem m JOIN anc USING (revision_id) JOIN mem a ON a.report_bundle_id = anc.anchor WHERE m.report_bundle_id <> anc.anchor),
gt AS (SELECT *, (CASE WHEN rk % 13 = 5 OR tk % 13 = 5 THEN 1 ELSE 0 END) + (CASE WHEN (rk % 7 = 0) <> (tk % 7 = 0) THEN 1 ELSE 0 END) + (CASE WHEN rk % 17 = 3 OR tk % 17 = 3 THEN 1 ELSE 0 END) AS blocking, (CASE WHEN (rk % 11 = 0) <> (tk % 11 = 0) THEN 1 ELSE 0 END) AS warnings FROM pr)"""


@query(f"WITH {GATE} SELECT reference_id, target_id, blocking::BIGINT AS blocking, warnings::BIGINT AS warnings, blocking = 0 AS compatible FROM gt")
def compatibility(spark, d):
    """The gate over all anchor pairs in one job."""
    p = reference_set.anchor_pairs(members(spark, d)).select("reference_id", "target_id")
    return gate.compatibility(gate.checks(p, manifests(spark, d)))


@query(f"WITH {GATE} SELECT revision_id, bool_and(blocking = 0) AS compatible, count(*) FILTER (blocking > 0) AS incompatible FROM gt GROUP BY 1")
def creation_check(spark, d):
    """Members against their anchor."""
    return reference_set.creation_check(members(spark, d), manifests(spark, d))


@query(f"WITH {MEM} SELECT revision_id, report_bundle_id, 'ref_' || lpad((row_number() OVER (PARTITION BY revision_id ORDER BY report_bundle_id))::VARCHAR, 4, '0') AS membership_id FROM mem")
def numbered_members(spark, d):
    """Deterministic membership numbers."""
    return reference_set.numbered_members(members(spark, d))


@query(f"WITH {MEM}, x AS (SELECT 'w' || (k % 5) AS revision_id, 'b' || (k // 10) AS b FROM mem) SELECT revision_id, count(*) AS members, count(DISTINCT b) AS bundles, count(*) <= 32 AND count(*) = count(DISTINCT b) AS valid FROM x GROUP BY 1")
def member_limits(spark, d):
    """Sizes of sets, and repeats in them."""
    u = events(spark, d).select("user_id").distinct()
    return reference_set.member_limits(u.select(F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string")).alias("revision_id"), F.concat(F.lit("b"), F.floor(F.col("user_id") / 10).cast("string")).alias("report_bundle_id")))


def evaluation(spark, d):
    """Runs r1 to r3 against reference r0 and, for r2 and r3, r1, on finer topics."""
    m = messages(spark, d).withColumn("topic", F.concat("topic", F.lit("_"), (F.col("arrival_seq") % 400).cast("string")))
    profile = m.groupBy("run_id", "topic").agg(F.count(F.lit(1)).alias("count"), (F.max("log_time_ns") - F.min("log_time_ns")).alias("duration_ns"))
    p = pairs(m)
    r = p.join(profile.select(F.col("run_id").alias("reference_id"), "topic", F.lit(1).alias("_r")), "reference_id")
    t = p.join(profile.select(F.col("run_id").alias("target_id"), "topic", F.lit(1).alias("_t")), "target_id")
    side = F.when(F.col("_r").isNull(), "target_only").when(F.col("_t").isNull(), "reference_only").otherwise("common")
    sides = r.join(t, ["reference_id", "target_id", "topic"], "full_outer").select("reference_id", "target_id", "topic", side.alias("side"))
    return p, sides, compare.compare_fields(p, profile)


EV = f"""{M}, pf AS (SELECT run_id, topic || '_' || (a % 400) AS topic, count(*) AS n, max(t) - min(t) AS dur FROM m GROUP BY 1, 2), rs AS (SELECT DISTINCT run_id FROM pf), pr AS (SELECT x.run_id AS reference_id, y.run_id AS target_id FROM rs x JOIN rs y ON x.run_id < y.run_id),
sd AS (SELECT pr.*, tp.topic, CASE WHEN r.n IS NULL THEN 'target_only' WHEN g.n IS NULL THEN 'reference_only' ELSE 'common' END AS side, r.n AS rn, g.n AS gn, r.dur AS rd, g.dur AS gd FROM pr CROSS JOIN (SELECT DISTINCT topic FROM pf) tp LEFT JOIN pf r ON r.run_id = reference_id AND r.topic = tp.topic LEFT JOIN pf g ON g.run_id = target_id AND g.topic = tp.topic WHERE r.n IS NOT NULL OR g.n IS NOT NULL),
fc AS (SELECT target_id, topic, f AS field, count(*) AS eligible, count(*) FILTER (CASE f WHEN 'profile.count' THEN rn <> gn ELSE rd <> gd END) AS changed FROM sd, (VALUES ('profile.count'), ('profile.duration_ns')) x(f) WHERE side = 'common' GROUP BY 1, 2, 3),
fo AS (SELECT *, eligible - changed AS unchanged, CASE WHEN changed = eligible THEN 'all' ELSE 'some' END AS scope FROM fc WHERE changed > 0),
tc AS (SELECT target_id, topic, count(*) FILTER (side = 'common') AS common, count(*) FILTER (side = 'target_only') AS target_only, count(*) FILTER (side = 'reference_only') AS reference_only, nr - count(*) AS absent, nr AS "references" FROM sd JOIN (SELECT target_id, count(*) AS nr FROM pr GROUP BY 1) USING (target_id) GROUP BY target_id, topic, nr)"""


@query(f"WITH {EV} SELECT target_id, topic, field, eligible, changed, unchanged, scope FROM fo")
def field_counts(spark, d):
    """Fields that changed against references of a target."""
    return reference_set.field_counts(evaluation(spark, d)[2])


@query(f"WITH {EV} SELECT target_id, topic, common, target_only, reference_only, absent, \"references\" FROM tc")
def topic_counts(spark, d):
    """Where a topic stands in the references."""
    p, sides, _ = evaluation(spark, d)
    return reference_set.topic_counts(p, sides)


@query(f"WITH {EV} SELECT t.target_id, t.topics, t.nr AS \"references\", coalesce(changed_topics, 0) AS changed_topics, coalesce(field_records, 0) AS field_records, coalesce(scope_all, 0) AS scope_all, coalesce(scope_some, 0) AS scope_some FROM (SELECT target_id, count(*) AS topics, max(\"references\") AS nr FROM tc GROUP BY 1) t LEFT JOIN (SELECT target_id, count(DISTINCT topic) AS changed_topics, count(*) AS field_records, count(*) FILTER (scope = 'all') AS scope_all, count(*) FILTER (scope = 'some') AS scope_some FROM fo GROUP BY 1) f USING (target_id)")
def evaluation_summary(spark, d):
    """The evaluation of each target in one row."""
    p, sides, f = evaluation(spark, d)
    return reference_set.evaluation_summary(reference_set.field_counts(f), reference_set.topic_counts(p, sides))


@query(f"WITH {GATE}, tg AS (SELECT 'b' || k AS target_id, 'v' || ((k + 3) // 3) AS revision_id, k FROM u), ep AS (SELECT tg.target_id, tg.revision_id, m.report_bundle_id AS reference_id, tg.k AS tk, m.k AS rk FROM tg JOIN mem m USING (revision_id)), bad AS (SELECT DISTINCT target_id FROM ep WHERE rk % 13 = 5 OR tk % 13 = 5 OR (rk % 7 = 0) <> (tk % 7 = 0) OR rk % 17 = 3 OR tk % 17 = 3) SELECT target_id, revision_id, reference_id FROM ep WHERE target_id NOT IN (SELECT target_id FROM bad)")
def admitted_targets(spark, d):
    """Pairs of targets of which all references are compatible."""
    targets = events(spark, d).select("user_id").distinct().select(F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("target_id"), F.concat(F.lit("v"), F.floor((F.col("user_id") + 3) / 3).cast("string")).alias("revision_id"))
    return reference_set.admitted(reference_set.evaluation_pairs(members(spark, d), targets), manifests(spark, d)).select("target_id", "revision_id", "reference_id")


@query("SELECT event_id AS subject_id, array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN 'required_missing' END, CASE WHEN event_id % 3 = 0 THEN 'match_differs' END, CASE WHEN event_id % 7 = 0 THEN 'axis_not_varying' END, CASE WHEN event_id % 7 = 0 THEN 'axis_is_matched' END, CASE WHEN event_id % 5 = 0 AND event_id % 7 <> 0 THEN 'axis_without_value' END], lambda x: x IS NOT NULL), ',') AS violations FROM events")
def policy_violations(spark, d):
    """E5: dimension policies."""
    i = F.col("event_id")
    family = F.when(i % 3 == 0, "other").otherwise("road")
    dims = F.when(i % 5 == 0, F.create_map(F.lit("family"), family)).otherwise(F.create_map(F.lit("family"), family, F.lit("scene"), i.cast("string")))
    subjects = events(spark, d).select(i.alias("subject_id"), dims.alias("dimensions"), F.create_map(F.lit("family"), F.lit("road")).alias("match_values"), F.array(F.lit("scene")).alias("vary_keys"), F.array(F.lit("family"), F.lit("scene")).alias("required_keys"), F.when(i % 7 == 0, F.array(F.lit("family"))).otherwise(F.array(F.lit("scene"))).alias("axis_keys"))
    return reference_set.policy_violations(subjects).withColumn("violations", F.array_join("violations", ","))


@query("WITH RECURSIVE r AS (SELECT event_id % 200 AS b, event_id AS i, CASE WHEN event_id % 200 = 7 AND event_id = 7 THEN 207 WHEN event_id % 200 = 9 AND event_id = 209 THEN NULL WHEN event_id % 200 = 11 AND event_id = 211 THEN -1 WHEN event_id >= 200 THEN event_id - 200 END AS p FROM events), reach AS (SELECT b, i FROM r WHERE p IS NULL OR p NOT IN (SELECT i FROM r) UNION ALL SELECT r.b, r.i FROM r JOIN reach ON r.p = reach.i AND r.b = reach.b), s AS (SELECT b, count(*) AS revisions, count(*) FILTER (p IS NULL) AS roots, count(*) FILTER (p IS NOT NULL AND p NOT IN (SELECT i FROM r)) AS unknown FROM r GROUP BY b) SELECT s.b AS baseline_id, roots, revisions, unknown AS unknown_parents, revisions - coalesce(n, 0) AS unreachable, roots = 1 AND unknown = 0 AND revisions = coalesce(n, 0) AS valid FROM s LEFT JOIN (SELECT b, count(*) AS n FROM reach GROUP BY b) x USING (b)")
def lineage(spark, d):
    """One root, known parents, no cycle."""
    i, b = F.col("event_id"), F.col("event_id") % 200
    parent = F.when((b == 7) & (i == 7), 207).when((b == 9) & (i == 209), None).when((b == 11) & (i == 211), -1).when(i >= 200, i - 200)
    return reference_set.lineage(events(spark, d).select(b.alias("baseline_id"), i.alias("revision_id"), parent.cast("bigint").alias("parent_revision_id")))


@query("SELECT b AS baseline_id, c AS current_revision_id, c < n AS found FROM (SELECT event_id % 200 AS b, max(event_id) + CASE WHEN event_id % 200 = 3 THEN 200 ELSE 0 END AS c FROM events GROUP BY event_id % 200), (SELECT count(*) AS n FROM events)")
def current_revision(spark, d):
    """The named current revision of each baseline."""
    r = events(spark, d).select((F.col("event_id") % 200).alias("baseline_id"), F.col("event_id").alias("revision_id"))
    named = r.groupBy("baseline_id").agg(F.max("revision_id").alias("m")).select("baseline_id", (F.col("m") + F.when(F.col("baseline_id") == 3, 200).otherwise(0)).alias("current_revision_id"))
    return reference_set.current_revision(named, r)


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT 'v' || event_id AS record_id, 'evaluation_revision_unknown' AS code FROM events WHERE event_id % 3 = 0 AND event_id % 90 = 0 UNION ALL SELECT 'w' || event_id, 'review_evaluation_unknown' FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT 'w' || event_id, 'review_revision_differs' FROM events WHERE event_id % 3 = 0 AND event_id % 90 <> 0 AND event_id % 50 = 0 UNION ALL SELECT 'w' || event_id, 'review_revision_differs' FROM events WHERE event_id % 90 = 0 AND event_id % 50 = 0")
def reference_violations(spark, d):
    """Foreign keys that lead nowhere."""
    e, i = events(spark, d), F.col("event_id")
    revisions = e.select(i.alias("revision_id"))
    evaluations = e.where(i % 3 == 0).select(F.concat(F.lit("v"), i.cast("string")).alias("evaluation_id"), F.when(i % 90 == 0, -i - 1).otherwise(i).alias("revision_id"))
    reviews = e.select(F.concat(F.lit("w"), i.cast("string")).alias("review_id"), F.concat(F.lit("v"), i.cast("string")).alias("evaluation_id"), F.when(i % 50 == 0, i + 1).when(i % 90 == 0, -i - 1).otherwise(i).alias("revision_id"))
    return reference_set.reference_violations(reviews, evaluations, revisions)


@query(
    """WITH RECURSIVE r AS (SELECT event_id AS i, event_id % 100 AS s, CASE WHEN event_id = 105 THEN NULL WHEN event_id = 206 THEN 6 WHEN event_id = 107 THEN -1 WHEN event_id = 108 THEN 208 WHEN event_id = 109 THEN 10 WHEN event_id = 111 THEN 111 WHEN event_id >= 100 THEN event_id - 100 END AS p FROM events),
reach AS (SELECT i FROM r WHERE p IS NULL OR p NOT IN (SELECT i FROM r) UNION ALL SELECT r.i FROM r JOIN reach ON r.p = reach.i), t AS (SELECT s, count(*) AS n, max(i) AS m FROM r WHERE i NOT IN (SELECT p FROM r WHERE p IS NOT NULL) GROUP BY s),
f AS (SELECT DISTINCT s FROM (SELECT s, p FROM r WHERE p IS NOT NULL GROUP BY s, p HAVING count(*) > 1)), k AS (SELECT s, count(*) FILTER (p IS NULL) AS roots, count(*) FILTER (p = i) AS own, count(*) FILTER (p IS NOT NULL AND p NOT IN (SELECT i FROM r)) AS lost, count(*) FILTER (i NOT IN (SELECT i FROM reach)) AS ring, count(*) FILTER (p IN (SELECT i FROM r) AND p % 100 <> s) AS moved FROM r GROUP BY s),
v AS (SELECT k.s, m, array_to_string(list_filter([CASE WHEN roots <> 1 THEN 'roots' END, CASE WHEN coalesce(n, 0) <> 1 THEN 'terminals' END, CASE WHEN f.s IS NOT NULL THEN 'fork' END, CASE WHEN own > 0 THEN 'self_link' END, CASE WHEN ring > 0 THEN 'cycle' END, CASE WHEN lost > 0 THEN 'supersedes_unknown' END, CASE WHEN moved > 0 THEN 'subject_changed' END], lambda x: x IS NOT NULL), ',') AS violations FROM k LEFT JOIN t ON k.s = t.s LEFT JOIN f ON k.s = f.s)
SELECT s AS subject, CASE WHEN violations = '' THEN m END AS effective_review_id, violations FROM v"""
)
def review_chains(spark, d):
    """The effective review of each subject."""
    i = F.col("event_id")
    prev = F.when(i == 105, None).when(i == 206, 6).when(i == 107, -1).when(i == 108, 208).when(i == 109, 10).when(i == 111, 111).when(i >= 100, i - 100)
    return reference_set.review_chains(events(spark, d).select(i.alias("review_id"), (i % 100).alias("subject"), prev.cast("bigint").alias("supersedes_review_id"))).withColumn("violations", F.array_join("violations", ","))


# --- order, trace events -------------------------------------------------------------------------------------------

DIS = f"{M}, dm AS (SELECT run_id, topic, a, t - CASE WHEN a % 7 = 0 THEN {3 * HOUR} ELSE 0 END AS t FROM m), r1 AS (SELECT *, coalesce(t < max(t) OVER (PARTITION BY run_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {2 * HOUR}, false) AS late FROM dm), r2 AS (SELECT *, coalesce(t < max(CASE WHEN NOT late THEN t END) OVER (PARTITION BY run_id, topic ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ooo FROM r1)"


@query(f"WITH {DIS} SELECT run_id, topic, count(*) AS received, count(*) FILTER (late) AS late_count, count(*) FILTER (ooo) AS out_of_order_count FROM r2 GROUP BY 1, 2")
def disorder(spark, d):
    """Late and out-of-order rows by a running maximum over the run's arrival order."""
    return ordering.disorder_counts(ordering.disorder(schema.disordered(messages(spark, d)), 2 * HOUR))


@query(f"WITH {DIS} SELECT run_id, topic, count(*) AS count, min(t) AS first_ns, max(t) AS last_ns FROM r2 WHERE NOT late GROUP BY 1, 2")
def accepted_rows(spark, d):
    """W5, ST2: what is left without late rows."""
    m = ordering.accepted(ordering.disorder(schema.disordered(messages(spark, d)), 2 * HOUR))
    return m.groupBy("run_id", "topic").agg(F.count(F.lit(1)).alias("count"), F.min("log_time_ns").alias("first_ns"), F.max("log_time_ns").alias("last_ns"))


@query("WITH x AS (SELECT event_id AS s, lag(event_id) OVER (ORDER BY event_id) AS p FROM events WHERE event_id % 11 NOT IN (3, 4)) SELECT p AS prev_sequence, s AS next_sequence, s - p - 1 AS gap_size FROM x WHERE s - p - 1 > 0")
def sequence_gaps(spark, d):
    """Jumps of the sequence, in file order, stitched over blocks."""
    return ordering.sequence_gaps(trace_events(spark, d).where("sequence_index % 11 not in (3, 4)").withColumn("at", F.col("sequence_index")), "at")


BATCH = """b AS (SELECT 'e' || event_id AS id, event_id * 200 AS pos, CASE WHEN event_id % 83 = 7 THEN NULL WHEN event_id % 101 = 3 THEN event_id + 1 WHEN event_id % 101 = 4 THEN event_id - 1 ELSE event_id END AS seq, sha256('e' || event_id) AS h, CASE WHEN event_id % 89 = 5 THEN 'x' ELSE sha256('e' || (event_id - 1)) END AS ph FROM events WHERE event_id > 0 AND event_id % 97 <> 0)"""


def batch(spark, d):
    """Trace events with gaps, swapped and missing sequence numbers, and wrong hashes, each with its place in the file."""
    i = F.col("sequence_index")
    e = trace_events(spark, d).withColumn("byte_offset", i * 200).where("sequence_index > 0 and sequence_index % 97 <> 0").withColumn("prev_event_hash", F.when(i % 89 == 5, "x").otherwise(F.col("prev_event_hash")))
    return e.withColumn("sequence_index", F.when(i % 83 != 7, F.when(i % 101 == 3, i + 1).when(i % 101 == 4, i - 1).otherwise(i)))


@query(
    f"""WITH {BATCH}, x AS (SELECT *, CASE WHEN row_number() OVER o = 1 THEN 0 ELSE lag(seq) OVER o END AS ps, CASE WHEN row_number() OVER o = 1 THEN sha256('e0') ELSE lag(h) OVER o END AS eh FROM b WINDOW o AS (ORDER BY pos)),
c AS (SELECT id AS event_id, seq AS sequence_index, ps AS expected_after, CASE WHEN seq IS NULL THEN 'sequence_missing' WHEN seq IS DISTINCT FROM ps + 1 THEN 'sequence_break' WHEN ph IS DISTINCT FROM eh THEN 'hash_break' END AS code FROM x) SELECT * FROM c WHERE code IS NOT NULL"""
)
def append_violations(spark, d):
    """Breaks of the chain in a batch, in file order, against the stored tail."""
    tail = trace_events(spark, d).where("sequence_index = 0").select(F.col("sequence_index").alias("last_indexed_seq"), F.col("event_hash").alias("last_event_hash"))
    return ordering.append_violations(batch(spark, d), tail, "byte_offset")


@query("SELECT max(event_id) AS last_by_sequence, max(event_id) AS last_by_offset, true AS agrees FROM events")
def tail_agrees(spark, d):
    """The tail by sequence is the tail by offset."""
    return ordering.tail_agrees(trace_events(spark, d).withColumn("byte_offset", F.col("sequence_index") * 200), "byte_offset")


@query(f"WITH {M}, s AS (SELECT run_id, min(t) AS f, max(t) - min(t) AS span FROM m GROUP BY 1), o AS (SELECT run_id, coalesce(sum(span + {HOUR}) OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - f AS shift FROM s) SELECT run_id, topic, count(*) AS count, (min(t + shift))::BIGINT AS first_ns, (max(t + shift))::BIGINT AS last_ns FROM m JOIN o USING (run_id) GROUP BY 1, 2")
def end_to_end(spark, d):
    """Runs laid end to end."""
    return slices.slice_summary(ordering.end_to_end(messages(spark, d), HOUR), ["run_id", "topic"]).drop("first_seq", "last_seq")


@query(f"WITH {DIS} SELECT run_id, count(*) AS messages, count(*) FILTER (t < p) AS regressions FROM (SELECT *, lag(t) OVER (PARTITION BY run_id ORDER BY a) AS p FROM dm) GROUP BY 1")
def regressions(spark, d):
    """How often time goes back in arrival order."""
    return ordering.regressions(schema.disordered(messages(spark, d)), ["run_id"])


@query(f"WITH {TR} SELECT 'event_type' AS category, event_type AS name, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'source_topic', source_topic, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'source_node', source_node, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'clock_domain', clock_domain, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'time_source', time_source, count(*) FROM e GROUP BY 2")
def category_counts(spark, d):
    """Five categorical counts in one pass."""
    return trace.category_counts(trace_events(spark, d))


@query(f"WITH {TR}, h AS (SELECT * FROM e WHERE event_type = 'click' AND raw LIKE '%1%') SELECT 'source_node' AS category, source_node AS name, count(*) AS n FROM h GROUP BY 2 UNION ALL SELECT 'clock_domain', clock_domain, count(*) FROM h GROUP BY 2")
def search_facets(spark, d):
    """Facets of search hits."""
    return trace.facets(slices.search(trace_events(spark, d), event_type="click", contains="1"), ("source_node", "clock_domain"))


@query("WITH g AS (SELECT count(*) AS gaps FROM (SELECT event_id - lag(event_id) OVER (ORDER BY event_id) AS x FROM events WHERE event_id % 11 <> 3) WHERE x > 1) SELECT count(*) AS events, 0::BIGINT AS bad_records, round(min(epoch_us(ts)) / 1e6, 6) AS min_ros_time, round(max(epoch_us(ts)) / 1e6, 6) AS max_ros_time, count(DISTINCT event_type) AS event_types, count(DISTINCT event_type) AS topics, count(DISTINCT user_id % 3) AS nodes, max(gaps) AS gaps FROM events, g WHERE event_id % 11 <> 3")
def index_summary(spark, d):
    """What an index build reports."""
    e = trace_events(spark, d).where("sequence_index % 11 <> 3").withColumn("at", F.col("sequence_index"))
    return rounded(trace.index_summary(e, ordering.sequence_gaps(e, "at")), "min_ros_time", "max_ros_time")


@query("SELECT s.event_id AS seed_id, count(*) AS n, min(e.event_id) AS first_seq, max(e.event_id) AS last_seq FROM events s JOIN events e ON e.event_id BETWEEN s.event_id - 20 AND s.event_id + 20 WHERE s.event_id % 10 = 0 GROUP BY 1")
def neighbourhoods(spark, d):
    """Events around every tenth one, by a band join on buckets."""
    e = trace_events(spark, d)
    seeds = e.where("sequence_index % 10 = 0").select(F.col("sequence_index").alias("seed_id"), "sequence_index")
    return trace.neighbourhood(seeds, e, 20, []).groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"), F.min("sequence_index").alias("first_seq"), F.max("sequence_index").alias("last_seq"))


@query("WITH x AS (SELECT s.event_id AS seed_id, e.event_id AS sequence_index, e.event_type, sign(e.event_id - s.event_id)::INT AS side, row_number() OVER (PARTITION BY s.event_id, sign(e.event_id - s.event_id), e.event_type ORDER BY abs(e.event_id - s.event_id)) AS k FROM events s JOIN events e ON e.event_id BETWEEN s.event_id - 20 AND s.event_id + 20 AND (e.event_id = s.event_id OR e.event_type IN ('view', 'click')) WHERE s.event_id % 10 = 0) SELECT seed_id, sequence_index, event_type, side FROM x WHERE k <= CASE WHEN side = 0 THEN 1 WHEN side < 0 THEN CASE WHEN event_type = 'view' THEN 2 ELSE 1 END ELSE CASE WHEN event_type = 'view' THEN 4 ELSE 1 END END")
def focused_chains(spark, d):
    """Nearest events of two types around every tenth one."""
    e = trace_events(spark, d)
    seeds = e.where("sequence_index % 10 = 0").select(F.col("sequence_index").alias("seed_id"), "sequence_index")
    return trace.chains(seeds, e, "minimal_context", "view", "click").select("seed_id", "sequence_index", "event_type", "side")


@query("WITH sd AS (SELECT CASE WHEN event_id % 100 = 0 THEN 'x' || event_id ELSE 'e' || event_id END AS seed_id, event_id AS q FROM events WHERE event_id % 20 = 0), k AS (SELECT sd.seed_id, e.event_id AS s, e.event_type AS ty FROM sd LEFT JOIN events e ON sd.seed_id = 'e' || e.event_id), c AS (SELECT k.seed_id, count(*) AS n, count(*) FILTER (e.event_type NOT IN ('click', 'view')) AS sk, count(*) FILTER (e.event_type IN ('click', 'view') AND e.event_id < s) AS b, count(*) FILTER (e.event_type IN ('click', 'view') AND e.event_id > s) AS f FROM k JOIN events e ON e.event_id BETWEEN s - 20 AND s + 20 GROUP BY 1) SELECT k.seed_id, CASE WHEN s IS NULL THEN 'seed_missing' WHEN ty NOT IN ('click', 'view') THEN 'seed_topic_excluded' ELSE 'ok' END AS status, coalesce(n, 0) AS rows_in_radius, coalesce(sk, 0) AS skipped_by_topic, coalesce(b, 0) AS before, coalesce(f, 0) AS after FROM k LEFT JOIN c USING (seed_id)")
def chain_summaries(spark, d):
    """What each seed's retrieval saw."""
    e = trace_events(spark, d)
    seeds = e.where("sequence_index % 20 = 0").select(F.when(F.col("sequence_index") % 100 == 0, F.concat(F.lit("x"), F.col("sequence_index").cast("string"))).otherwise(F.col("event_id")).alias("seed_id"))
    return trace.chain_summary(seeds, e, 20, ["/click", "/view"])


@query(f"WITH {TR} SELECT event_id, seq AS sequence_index, (event_type = 'click')::INT + (source_topic = '/view')::INT + (raw LIKE '%99%')::INT AS match_count FROM e WHERE event_type = 'click' OR source_topic = '/view' OR raw LIKE '%99%' ORDER BY 3 DESC, 2 LIMIT 500")
def ranked_search(spark, d):
    """Hits by how many predicates they meet; a top-k report."""
    hits = slices.ranked_search(trace_events(spark, d), "click", "/view", "99")
    return slices.search_order(hits, "match_count", 500).select("event_id", "sequence_index", "match_count")


# --- datasets, integrity, functions --------------------------------------------------------------------------------

DS = "ds AS (SELECT k, CASE k % 5 WHEN 0 THEN 'lidar_' || k WHEN 1 THEN 'imu_cmd_' || k WHEN 2 THEN 'plain_' || k ELSE 'imu_' || k END AS name, k % 4 = 0 AS incident, CASE WHEN k % 10 = 3 THEN '/view' END AS declared FROM (SELECT DISTINCT user_id % 60 AS k FROM events)), rt AS (SELECT user_id % 60 AS k, CASE event_type WHEN 'click' THEN '/imu' WHEN 'error' THEN '/scan' ELSE '/' || event_type END AS topic, count(*) / 100.0::DOUBLE AS hz FROM events WHERE (user_id + event_id) % 3 <> 1 GROUP BY 1, 2)"


def dataset_table(spark, d):
    k = F.col("k")
    text = k.cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("lidar_"), text)).when(k % 5 == 1, F.concat(F.lit("imu_cmd_"), text)).when(k % 5 == 2, F.concat(F.lit("plain_"), text)).otherwise(F.concat(F.lit("imu_"), text))
    topic = F.when(F.col("event_type") == "click", "/imu").when(F.col("event_type") == "error", "/scan").otherwise(F.concat(F.lit("/"), F.col("event_type")))
    counts = events(spark, d).where("(user_id + event_id) % 3 <> 1").groupBy((F.col("user_id") % 60).alias("k"), topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("topics")).select(name.alias("dataset_name"), F.when(k % 4 == 0, "incident").otherwise("normal").alias("dataset_type"), "topics", F.lit(100.0).alias("duration_sec"), F.when(k % 10 == 3, "/view").alias("declared_topic"))


@query(f"WITH {DS} SELECT name AS dataset_name, topic, round(hz, 6) AS hz FROM ds JOIN rt USING (k)")
def dataset_rates(spark, d):
    """Topic rates of datasets."""
    return rounded(datasets.topic_rates(dataset_table(spark, d)).select("dataset_name", "topic", "hz"), "hz")


@query(f"WITH {DS} SELECT topic, round(avg(hz), 6) AS normal_hz FROM ds JOIN rt USING (k) WHERE NOT incident GROUP BY 1")
def mean_normal_rates(spark, d):
    """Mean rates over normal datasets."""
    return rounded(datasets.mean_normal_rates(datasets.topic_rates(dataset_table(spark, d))), "normal_hz")


VERIFY = f"""{DS}, mn AS (SELECT topic, avg(hz) AS nhz FROM ds JOIN rt USING (k) WHERE NOT incident GROUP BY 1),
cd AS (SELECT name, topic, hz, coalesce(nhz, 0) AS nhz, CASE WHEN coalesce(nhz, 0) <= 1e-9 OR hz <= 1e-9 THEN 1e300 ELSE abs(ln(hz / nhz)) END AS score FROM ds JOIN rt USING (k) LEFT JOIN mn USING (topic) WHERE incident AND greatest(coalesce(nhz, 0), hz) >= 0.1),
tp AS (SELECT name, topic, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, topic) AS k FROM cd) WHERE k = 1),
xp AS (SELECT name, CASE WHEN declared IS NOT NULL THEN 'DECLARED' WHEN k % 5 = 1 THEN 'AMBIGUOUS' WHEN k % 5 = 2 THEN 'NO_DECLARATION' ELSE 'INFERRED_FROM_NAME' END AS status, CASE WHEN declared IS NOT NULL THEN declared WHEN k % 5 = 0 THEN '/scan' WHEN k % 5 IN (3, 4) THEN '/imu' END AS expected FROM ds WHERE incident),
vf AS (SELECT name, status, expected, topic, CASE WHEN status IN ('AMBIGUOUS', 'NO_DECLARATION') THEN status WHEN topic IS NOT DISTINCT FROM expected THEN 'PASS' ELSE 'REVIEW' END AS result FROM xp LEFT JOIN tp USING (name))"""


@query(f"WITH {VERIFY} SELECT name AS dataset_name, status, expected AS expected_topic, topic AS top_topic, result FROM vf")
def verify_datasets(spark, d):
    """Incident datasets against normal ones."""
    return datasets.verify(dataset_table(spark, d)).select("dataset_name", "status", "expected_topic", "top_topic", "result")


@query(f"WITH {VERIFY} SELECT result, count(*) AS n FROM vf GROUP BY 1")
def verification_tallies(spark, d):
    """Results by kind."""
    return datasets.tallies(datasets.verify(dataset_table(spark, d)))


@query("WITH w AS (SELECT 'f' || event_id AS path, array_to_string(list_filter([CASE WHEN event_id % 13 = 0 THEN 'SUMMARY_PRESENCE_MISMATCH' END, CASE WHEN event_id % 17 = 0 THEN 'TIME_RANGE_INCONSISTENT' END, CASE WHEN event_id % 19 = 0 THEN 'CHUNK_COUNT_MISMATCH' END], lambda x: x IS NOT NULL), ',') AS warnings FROM events) SELECT path, warnings, CASE WHEN warnings = '' THEN 'ok' ELSE 'degraded' END AS status FROM w")
def structural_audit(spark, d):
    """Q1, M3 to M6: consistency of recordings, all warnings of each."""
    e, i = events(spark, d), F.col("event_id")
    path = F.concat(F.lit("f"), i.cast("string")).alias("path")
    files = e.select(path, F.lit(1000).alias("size_bytes"), F.lit(500).alias("summary_start"), F.lit(700).alias("summary_offset_start"), (i % 13 != 0).alias("has_summary"), F.lit(5).alias("start_ns"), F.when(i % 17 == 0, 4).otherwise(6).alias("end_ns"), F.lit(1).alias("channel_count"), F.when(i % 19 == 0, 3).otherwise(1).alias("chunk_count"))
    return audit.structural_audit(files, e.select(path), e.select(path)).withColumn("warnings", F.array_join("warnings", ","))


@query("SELECT 'f' || (user_id % 50) AS path, string_agg(DISTINCT CASE WHEN event_type < 'f' THEN 'lz4' ELSE 'zstd' END, ',' ORDER BY CASE WHEN event_type < 'f' THEN 'lz4' ELSE 'zstd' END) AS compressions FROM events GROUP BY 1")
def compression_sets(spark, d):
    """Compressions of a file's chunks."""
    return audit.compression_sets(events(spark, d).select(F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("path"), F.when(F.col("event_type") < "f", "lz4").otherwise("zstd").alias("compression")))


@query("WITH c AS (SELECT DISTINCT user_id % 50 AS r, event_type FROM events WHERE NOT (user_id % 50 = 7 AND event_type = 'view')), x AS (SELECT r, string_agg(event_type, ',' ORDER BY event_type) AS s FROM c GROUP BY 1) SELECT 'r' || r AS run_id, s = (SELECT min_by(s, 'r' || r) FROM x) AS same FROM x")
def same_contract(spark, d):
    """Whether sources declare the same channels, by an order-free digest."""
    c = events(spark, d).where("not (user_id % 50 = 7 and event_type = 'view')").select(F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("run_id"), "event_type").distinct()
    return audit.same_contract(c, ["event_type"]).select("run_id", "same")


ART = "ar AS (SELECT 'r' || (user_id % 50) AS run_id, 'a' || event_id || CASE event_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.mcap' ELSE '.csv' END AS path, length(props)::BIGINT AS size_bytes, sha256(props) AS sha256, event_id AS i FROM events)"


def artifacts(spark, d):
    i = F.col("event_id")
    return events(spark, d).select(F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("run_id"), F.concat(F.lit("a"), i.cast("string"), F.when(i % 4 == 0, ".json").when(i % 4 == 1, ".mcap").otherwise(".csv")).alias("path"), F.lit("data").alias("role"), F.length("props").cast("bigint").alias("size_bytes"), F.sha2("props", 256).alias("sha256"), i.alias("i"))


@query(f"WITH {ART} SELECT run_id, path, CASE WHEN i % 31 = 0 THEN 'undeclared' WHEN i % 29 = 0 THEN 'missing' WHEN i % 23 = 0 THEN 'size_differs' WHEN i % 19 = 0 THEN 'hash_differs' ELSE 'ok' END AS status FROM ar WHERE NOT (i % 31 = 0 AND i % 29 = 0)")
def artifact_integrity(spark, d):
    """Declared artifacts against actual ones."""
    a = artifacts(spark, d)
    actual = a.where("i % 29 <> 0").select("run_id", "path", (F.col("size_bytes") + F.when(F.col("i") % 23 == 0, 1).otherwise(0)).alias("size_bytes"), F.when(F.col("i") % 19 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return audit.artifact_integrity(a.where("i % 31 <> 0"), actual)


@query(f"WITH {ART} SELECT run_id, count(*) AS artifacts, sum(size_bytes)::BIGINT AS total_bytes FROM ar GROUP BY 1")
def artifact_totals(spark, d):
    """Artifacts per bundle."""
    return audit.artifact_totals(artifacts(spark, d))


@query(f"WITH {ART} SELECT run_id, path, 'raw_log' AS violation FROM ar WHERE i % 4 = 1")
def raw_log_violations(spark, d):
    """F8: raw logs among artifacts."""
    return slices.raw_log_violations(artifacts(spark, d)).select("run_id", "path", "violation")


@query(f"""WITH {ART}, t AS (SELECT run_id, string_agg('{{"path":"' || path || '","role":"data","sha256":"' || sha256 || '","size_bytes":' || size_bytes || '}}', ',' ORDER BY path) AS s FROM ar GROUP BY 1) SELECT run_id, sha256('{{"artifacts":[' || s || '],"run_id":"' || run_id || '"}}') AS identity FROM t""")
def bundle_identity(spark, d):
    """Canonical JSON identity of a bundle."""
    a = artifacts(spark, d)
    return audit.bundle_identity(a.select("run_id").distinct(), a, ["run_id"])


@query(f"WITH {MEM} SELECT revision_id, report_bundle_id, CASE WHEN k % 9 = 0 THEN 'missing' WHEN k % 8 = 0 THEN 'changed' ELSE 'ok' END AS status FROM mem")
def manifest_pins(spark, d):
    """Q10: pinned manifests."""
    m = members(spark, d).withColumn("report_manifest_sha256", F.sha2("report_bundle_id", 256))
    k = F.substring("report_bundle_id", 2, 20).cast("bigint")
    now = members(spark, d).where(k % 9 != 0).select(F.col("report_bundle_id").alias("run_id"), F.when(k % 8 == 0, "x").otherwise(F.sha2("report_bundle_id", 256)).alias("sha256"))
    return audit.manifest_pins(m, now)


@query(f"WITH {MEM} SELECT report_bundle_id AS path, CASE WHEN k % 9 = 0 THEN 'missing' WHEN k % 8 = 0 THEN 'truncated' WHEN k % 7 = 0 THEN 'prefix_changed' ELSE 'ok' END AS status FROM mem")
def append_source(spark, d):
    """Q5: whether sources may be appended from."""
    k = F.substring("report_bundle_id", 2, 20).cast("bigint")
    m = members(spark, d)
    before = m.select(F.col("report_bundle_id").alias("path"), F.lit(100).alias("indexed_end"), F.lit("p").alias("prefix_sha256"))
    now = m.where(k % 9 != 0).select(F.col("report_bundle_id").alias("path"), F.when(k % 8 == 0, 50).otherwise(200).alias("size_bytes"), F.when(k % 7 == 0, "q").otherwise("p").alias("prefix_sha256"))
    return audit.append_source(before, now)


@query("SELECT user_id % 30 AS user, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, d):
    """Repeated keys."""
    return audit.duplicates(events(spark, d).select((F.col("user_id") % 30).alias("user"), "event_type"), ["user", "event_type"])


@query("SELECT count(*) AS written, count(*) FILTER (event_id % 2 = 0) AS read, false AS equal FROM events")
def reconciled(spark, d):
    """Q6: rows written against rows read."""
    e = events(spark, d)
    return audit.reconciled(e, e.where("event_id % 2 = 0"))


@query("SELECT 'v' || (event_id // 4) AS evaluation_id, CASE WHEN count(DISTINCT CASE WHEN event_id % 50 = 3 THEN 1 ELSE 0 END) > 1 THEN 'times_differ' ELSE '' END || CASE WHEN count(DISTINCT CASE WHEN event_id % 50 = 3 THEN 1 ELSE 0 END) > 1 AND count(DISTINCT user_id) < count(*) THEN ',' ELSE '' END || CASE WHEN count(DISTINCT user_id) < count(*) THEN 'reference_repeated' ELSE '' END AS violations FROM events GROUP BY 1")
def report_consistency(spark, d):
    """Q8: pairwise reports of an evaluation agree."""
    i = F.col("event_id")
    return audit.report_consistency(events(spark, d).select(F.concat(F.lit("v"), F.floor(i / 4).cast("string")).alias("evaluation_id"), F.when(i % 50 == 3, 1).otherwise(0).alias("generated_at"), F.lit("t").alias("target_id"), F.col("user_id").alias("reference_id"), F.lit(True).alias("compatible")))


@query(f"WITH {EV} SELECT reference_id, target_id, topic, 'in_two_sets' AS code FROM sd WHERE side = 'reference_only' UNION ALL SELECT reference_id, target_id, topic, 'compared_not_common' FROM sd WHERE side = 'target_only'")
def topic_state_violations(spark, d):
    """Q9: topics in two sets, compared topics that aren't common."""
    _, sides, f = evaluation(spark, d)
    twice = sides.where("side = 'reference_only'").withColumn("side", F.lit("target_only"))
    stray = sides.where("side = 'target_only'").select("reference_id", "target_id", "topic")
    return audit.topic_state_violations(sides.union(twice), f.select("reference_id", "target_id", "topic").union(stray))


@query(f"WITH {M}, {FINE} SELECT DISTINCT topic FROM fm WHERE run_id = 'r0' AND topic NOT IN (SELECT topic FROM fm WHERE run_id = 'r1')")
def missing_topics(spark, d):
    """requested topics that no channel has."""
    fine = messages(spark, d).withColumn("topic", F.concat("topic", F.lit("_"), (F.col("arrival_seq") % 400).cast("string")))
    return slices.missing_topics(fine.where("run_id = 'r0'").select("topic").distinct(), fine.where("run_id = 'r1'"))


@query(f"WITH {M}, {FINE}, x AS (SELECT DISTINCT run_id, topic FROM fm), p AS (SELECT DISTINCT run_id, topic || '_' || (a % 400) AS topic FROM m WHERE a % 3 <> 0), w AS (SELECT DISTINCT run_id, topic || '_' || (a % 400) AS topic FROM m WHERE a % 3 <> 1) SELECT *, 'no_windows' AS code FROM (SELECT * FROM p EXCEPT SELECT * FROM w) UNION ALL SELECT *, 'no_profile' FROM (SELECT * FROM w EXCEPT SELECT * FROM p)")
def topic_set_mismatches(spark, d):
    """O3: topics of one table only."""
    fine = messages(spark, d).withColumn("topic", F.concat("topic", F.lit("_"), (F.col("arrival_seq") % 400).cast("string")))
    return compare.topic_set_mismatches(fine.where("arrival_seq % 3 <> 0"), fine.where("arrival_seq % 3 <> 1"))


@query(f"WITH {M} SELECT run_id, topic || a AS topic, 'count' AS field, 'negative' AS code FROM m WHERE a % 41 = 0 UNION ALL SELECT run_id, topic || a, 'jitter_ns', 'missing' FROM m WHERE a % 43 = 0")
def metric_violations(spark, d):
    """Q3: numbers that are no measurement."""
    m = messages(spark, d)
    i = F.col("arrival_seq")
    return compare.metric_violations(m.select("run_id", F.concat("topic", i.cast("string")).alias("topic"), F.when(i % 41 == 0, -1).otherwise(1).alias("count"), F.when(i % 43 == 0, None).otherwise(0.5).alias("jitter_ns")))


@query(f"WITH {M}, {window_sql(W)}, {PROFILE} SELECT run_id, topic, {PROFILE_COLUMNS} FROM prof")
def shareable_profile(spark, d):
    """timing metadata only."""
    return slices.shareable(windows.run_profile(windows.observed_windows(messages(spark, d), W)).withColumn("payload", F.lit("x")))


@query("SELECT event_id, (epoch_us(ts) * 1000 // 1000000000)::VARCHAR || '.' || lpad((epoch_us(ts) * 1000 % 1000000000)::VARCHAR, 9, '0') AS text, epoch_us(ts) * 1000 AS ns, event_id % 4 <> 0 AS is_iso FROM events")
def time_functions(spark, d):
    """Ns texts and back, ISO times with an offset."""
    e = events(spark, d).select("event_id", (schema.micros("ts") * 1000).alias("n"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 4 == 0, "").otherwise("+02:00")).alias("iso"))
    return e.select("event_id", X.ns_text("n").alias("text"), X.seconds_to_ns(X.ns_text("n")).alias("ns"), X.iso_time("iso").isNotNull().alias("is_iso"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'k=v' || event_id || ',z=' || event_type END AS dims, CASE WHEN event_type = 'click' THEN 'cmd linear_x=' || event_id || ' angular_z=None type=' || event_type WHEN event_type = 'view' THEN 'motion vx=None wz=None' ELSE 'scan min_range=None valid=None invalid=None' END AS detail FROM events")
def map_functions(spark, d):
    """Canonical dimension maps, event details."""
    i = F.col("event_id")
    dims = F.create_map(F.lit(" z "), F.col("event_type"), F.when(i % 5 == 0, "z").otherwise("k"), F.concat(F.lit("v"), i.cast("string"), F.lit(" ")))
    kind = F.when(F.col("event_type") == "click", "COMMAND_SUMMARY").when(F.col("event_type") == "view", "MOTION_SUMMARY").otherwise("PERCEPTION_SUMMARY")
    summary = F.create_map(F.lit("linear_x"), i.cast("string"), F.lit("message_type"), F.col("event_type"))
    e = events(spark, d).select("event_id", X.canonical_map(dims).alias("m"), X.detail_text(kind, summary).alias("detail"))
    return e.select("event_id", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("dims"), "detail")


# --- streaming -----------------------------------------------------------------------------------------------------


def streamed(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a streaming job over the events table gives, written to the shared folder and read again."""
    out = scratch(spark, name)
    raw = spark.readStream.schema(events(spark, d).schema).option("pathGlobFilter", "events*").parquet(d)
    stream = build(raw)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def timed(e: DataFrame) -> DataFrame:
    """A stream of messages with the time in microseconds for its watermark."""
    return schema.messages_from_events(e).withColumn("ts", F.timestamp_micros(F.expr("log_time_ns div 1000")))


@query(f"WITH {M}, b AS (SELECT max(t) - {HOUR} AS mark FROM m), x AS (SELECT run_id, topic, t // {24 * HOUR} AS k, t, t - lag(t) OVER (PARTITION BY run_id, topic, t // {24 * HOUR} ORDER BY t) AS gap FROM m) SELECT run_id, topic, k AS day, count(*) AS count, min(t) AS first_ns, max(t) AS last_ns, coalesce(max(gap), 0) AS max_gap_ns FROM x, b GROUP BY run_id, topic, k, mark HAVING (k + 1) * {24 * HOUR} <= mark")
def stream_windows(spark, d):
    """ST1, ST2, ST4: tumbling windows of a stream with a watermark; the last open ones stay in its state."""
    out = streamed(spark, d, lambda e: jobs.stream_windows(timed(e), "1 day", "1 hour", "1 hour"), "windows")
    return out.select("run_id", "topic", (F.unix_micros("start") / 86_400_000_000).cast("bigint").alias("day"), "count", "first_ns", "last_ns", "max_gap_ns")


@query(f"""WITH {M}, x AS (SELECT run_id, topic, (t - {DAY0}) // {24 * HOUR} AS k, t, t - lag(t) OVER (PARTITION BY run_id, topic, (t - {DAY0}) // {24 * HOUR} ORDER BY t) AS gap, max(t) OVER (PARTITION BY run_id, topic) AS top, max(t) OVER () AS newest FROM m),
c AS (SELECT run_id, topic, k, count(*) AS count, coalesce(max(gap), 0) AS max_gap_ns FROM x GROUP BY run_id, topic, k, top, newest HAVING {DAY0} + (k + 1) * {24 * HOUR} <= top - {2 * HOUR} OR top + {26 * HOUR} < newest - {2 * HOUR})
SELECT run_id, topic, k AS "window", count, max_gap_ns, 0::BIGINT AS late_count, 0::BIGINT AS out_of_order_count, coalesce(k - lag(k) OVER (PARTITION BY run_id, topic ORDER BY k) - 1, 0) AS missing_before FROM c""")
def stream_fold(spark, d):
    """ST3, ST4: the fold in arrival order with state per run and topic; a topic long silent is flushed whole."""
    return streamed(spark, d, lambda e: jobs.arrival_fold(timed(e), DAY0, 24 * HOUR, 2 * HOUR), "fold")


@query("SELECT event_id, event_type FROM (SELECT 'e' || event_id AS event_id, event_type FROM events WHERE event_type = 'click' AND props LIKE '%99%')")
def stream_search(spark, d):
    """ST7, F3: a search over a stream."""
    return streamed(spark, d, lambda e: slices.search(schema.trace_events_from_events(e), event_type="click", contains="99"), "search").select("event_id", "event_type")


@query(f"WITH {M}, dm AS (SELECT run_id, topic, a, t - CASE WHEN a % 7 = 0 THEN {3 * HOUR} ELSE 0 END AS t FROM m), x AS (SELECT *, max(t) OVER (PARTITION BY run_id, topic ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM dm) SELECT run_id, topic, count(*) AS received, count(*) FILTER (t < top - {2 * HOUR}) AS late_count, count(*) FILTER (t < top) AS out_of_order_count FROM x GROUP BY 1, 2")
def stream_late(spark, d):
    """ST2: late and out-of-order rows counted by a stream, per run and topic."""
    out = streamed(spark, d, lambda e: jobs.late_counts(schema.disordered(schema.messages_from_events(e)), 2 * HOUR), "late")
    return out.groupBy("run_id", "topic").agg(*[F.max(c).alias(c) for c in ("received", "late_count", "out_of_order_count")])
