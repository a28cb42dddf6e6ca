"""Streaming jobs run to the end of the available data; results read back from their sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import fresh_path
from ..sources.ingest import read_mentions
from ..sources.views import QUESTION_COUNT, TABLES, Views
from ..streaming import mentions as ms
from ..streaming.respondents import ingest_stream
from .base_sql import he, joined, with_views
from .registry import query


class StreamViews(Views):
    """The same views over streaming reads of the tables."""

    def __init__(self, v: Views) -> None:
        super().__init__(v.spark, v.root)

    def raw(self, name: str) -> DataFrame:
        return self.spark.readStream.schema(TABLES[name]).option("pathGlobFilter", f"{name}.parquet").parquet(self.root)


def run(v: Views, name: str, stream: DataFrame) -> DataFrame:
    path = fresh_path(v.spark, name)
    ms.run_available(stream, f"{path}/out", f"{path}/offsets")
    return v.spark.read.schema(stream.schema).parquet(f"{path}/out")


@query(
    "stream_mention_dedup",
    with_views("mentions") + """ SELECT event_id, project_id, external_id, source, published_at, author, engagement, sentiment, narrative, topic_id
    FROM (SELECT *, row_number() OVER (PARTITION BY project_id, external_id ORDER BY published_at, event_id) AS rn FROM mentions) WHERE rn = 1""",
)
def stream_mention_dedup(v: Views) -> DataFrame:
    """A repeated id in another project stays."""
    rows = StreamViews(v).mentions().select(
        "event_id", "project_id", "external_id", "source", "published_at", "author", "engagement", "sentiment", "narrative", "topic_id"
    )
    path = fresh_path(v.spark, "mention-dedup")
    ms.ingest_mentions(rows, f"{path}/out", f"{path}/offsets", ["project_id", "external_id"], ["published_at", "event_id"]).awaitTermination()
    out = v.spark.read.parquet(f"{path}/out").drop("batch")
    return out.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query(
    "stream_author_sessions",
    with_views("mentions") + """, g AS (SELECT *, CASE WHEN published_at - lag(published_at) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS opens
      FROM mentions WINDOW w AS (PARTITION BY project_id, author ORDER BY published_at, event_id)),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY project_id, author ORDER BY published_at, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT project_id, author, min(published_at) AS session_start, max(published_at) AS session_end, count(*) AS mentions,
      CAST(sum(engagement) AS BIGINT) AS engagement, round(avg(sentiment), 6) AS mean_sentiment
    FROM n GROUP BY project_id, author, session HAVING max(published_at) + INTERVAL 1 DAY <= (SELECT max(published_at) - INTERVAL 1 DAY FROM mentions)""",
)
def stream_author_sessions(v: Views) -> DataFrame:
    out = run(v, "author-sessions", ms.author_sessions(StreamViews(v).mentions()))
    return out.withColumns({
        "session_start": F.col("session_start").cast("timestamp_ntz"), "session_end": F.col("session_end").cast("timestamp_ntz"),
        "mean_sentiment": F.round("mean_sentiment", 6),
    })


@query(
    "stream_weekly_signals",
    with_views("mentions") + """, p AS (SELECT project_id, source, sentiment, DATE '1970-01-01' + CAST(floor(epoch(published_at)/604800)*7 AS INTEGER) AS period_start FROM mentions)
    SELECT CAST(period_start AS DATE) AS period_start, CAST(period_start + 7 AS DATE) AS period_end, project_id, source, count(*) AS volume, round(avg(sentiment), 6) AS mean_sentiment
    FROM p WHERE period_start + 7 <= (SELECT max(published_at) - INTERVAL 1 DAY FROM mentions) GROUP BY ALL""",
)
def stream_weekly_signals(v: Views) -> DataFrame:
    out = run(v, "weekly-signals", ms.weekly_signals(StreamViews(v).mentions()))
    return out.withColumn("mean_sentiment", F.round("mean_sentiment", 6))


@query(
    "stream_momentum",
    with_views("mentions") + f""", d AS (SELECT project_id, narrative, CAST(published_at AS DATE) AS day FROM mentions WHERE narrative IS NOT NULL),
    w AS (SELECT project_id, narrative, CAST(day + CAST(k AS INTEGER) AS DATE) AS window_end, count(*) AS n FROM d, range(1, 8) r(k)
          WHERE day + CAST(k AS INTEGER) <= (SELECT max(published_at) - INTERVAL 1 DAY FROM mentions) GROUP BY ALL),
    s AS (SELECT *, 100*n/CAST(sum(n) OVER (PARTITION BY project_id, window_end) AS DOUBLE) AS share FROM w)
    SELECT a.project_id, a.window_end, a.narrative, a.n, {he('a.share', 2)} AS volume_pct, {he('a.share - b.share', 2)} AS momentum_7d
    FROM s a LEFT JOIN s b ON a.project_id = b.project_id AND a.narrative = b.narrative AND b.window_end = a.window_end - 7""",
)
def stream_momentum(v: Views) -> DataFrame:
    named = StreamViews(v).mentions().filter(F.col("narrative").isNotNull())
    return ms.momentum_of_windows(run(v, "momentum", ms.sliding_counts(named)))


def respondent_documents(v: Views, code: str = "o_orderkey") -> DataFrame:
    """Orders as nested respondent documents with their eight answers, one per value of ``code`` and year."""
    key = F.col("o_orderkey")

    def answer(q):
        scored = 1 + (key * 13 + q * q * 7 + F.floor("o_totalprice")) % 5
        return F.struct(
            q.cast("string").alias("question_id"),
            F.when(key % 9 == 0, 3).otherwise(scored).cast("double").alias("value_num"),
            F.lit(None).cast("string").alias("value_text"),
            F.lit(None).cast("string").alias("value_json"),
        )

    nothing = F.lit(None).cast("string")
    return v.raw("orders").select(
        F.lit("org").alias("org_id"),
        F.year("o_orderdate").cast("string").alias("survey_id"),
        # no two at the same time
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + key).alias("completed_at"),
        F.struct(
            F.col(code).cast("string").alias("anon_code"), nothing.alias("age_band"), F.col("o_orderstatus").alias("gender"),
            nothing.alias("education"), nothing.alias("occupation"), nothing.alias("province_code"),
            F.col("o_orderpriority").alias("urbanicity"), F.floor(F.col("o_totalprice") / 400).cast("int").alias("duration_sec"),
        ).alias("respondent"),
        F.transform(F.sequence(F.lit(1), F.lit(QUESTION_COUNT)), answer).alias("answers"),
    )


@query(
    "stream_respondent_ingest",
    with_views("responses") + f""", r AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS survey_id, CAST(o_custkey AS VARCHAR) AS anon_code, o_orderkey AS respondent_id,
      CAST(floor(o_totalprice/400) AS INTEGER) AS dur, (month(o_orderdate) + 5) // 6 AS half, o_orderdate FROM orders),
    k AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY survey_id, anon_code) AS sent FROM r WINDOW w AS (PARTITION BY survey_id, anon_code ORDER BY o_orderdate, respondent_id)),
    m AS (SELECT survey_id, h.half, quantile_cont(dur, 0.5) AS med FROM k JOIN (VALUES (1), (2)) h(half) ON k.half <= h.half WHERE rn = 1 GROUP BY ALL),
    f AS (SELECT respondent_id, min(value_num) = max(value_num) AS flat, stddev_pop(value_num) < 0.25 AS low FROM responses GROUP BY 1),
    j AS (SELECT survey_id, anon_code, sent, half, med > 0 AND dur < med*CAST(0.35 AS DOUBLE) AS speed, flat, low AND NOT flat AS low
      FROM k JOIN m USING (survey_id, half) JOIN f USING (respondent_id) WHERE rn = 1)
    SELECT survey_id, anon_code, CAST(half - 1 AS INTEGER) AS batch, CAST(100 - CASE WHEN speed THEN 30 ELSE 0 END - CASE WHEN flat THEN 35 WHEN low THEN 10 ELSE 0 END AS INTEGER) AS quality_score,
      {joined(('SPEEDING', 'speed'), ('STRAIGHT_LINING', 'flat'))} AS quality_flags, sent - 1 AS repeats FROM j""",
)
def stream_respondent_ingest(v: Views) -> DataFrame:
    """The documents of each half of the year land and are ingested one after the other; repeats are rejected in both."""
    root = fresh_path(v.spark, "respondent-ingest")
    cores = v.spark.sparkContext.defaultParallelism
    docs = respondent_documents(v, "o_custkey")  # a customer who orders again in a year repeats
    for half in (1, 2):
        docs.filter(F.ceil(F.month("completed_at") / 6) == half).write.mode("append").parquet(f"{root}/landing")
        landing = v.spark.readStream.schema(docs.schema).parquet(f"{root}/landing")
        ingest_stream(landing, root, f"{root}/offsets", cores).awaitTermination()
    repeats = v.spark.read.parquet(f"{root}/rejected_documents").groupBy("survey_id", "anon_code").agg(F.count(F.lit(1)).alias("repeats"))
    people = v.spark.read.parquet(f"{root}/respondents").join(repeats, ["survey_id", "anon_code"], "left")
    return people.select(
        "survey_id", "anon_code", "batch", "quality_score", F.array_join("quality_flags", ",").alias("quality_flags"),
        F.coalesce("repeats", F.lit(0)).alias("repeats"),
    )


@query(
    "mention_landing",
    with_views("mentions") + " SELECT project_id, count(*) AS n, round(avg(sentiment), 6) AS mean_sentiment, min(external_id) AS first_id FROM mentions GROUP BY 1",
)
def mention_landing(v: Views) -> DataFrame:
    """Mentions written as a connector drops them, one JSON object a line, and read again by the landing reader."""
    path = fresh_path(v.spark, "mention-landing")
    m = v.mentions()
    m.select(
        F.col("project_id").cast("string").alias("project_id"), F.lit("feed").alias("connector"),
        F.col("external_id").cast("string").alias("external_id"), "source", "published_at", "sentiment",
    ).write.json(path)
    got = read_mentions(v.spark, path)
    return got.groupBy(F.col("project_id").cast("bigint").alias("project_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("sentiment").cast("double")), 6).alias("mean_sentiment"),
        F.min(F.col("external_id").cast("bigint")).alias("first_id"),
    )
