"""Survey and signal views derived from the star-schema test tables.

These stand in for the base tables in queries and bench. Integer conversions use
floor before the cast, so that other engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column types of the test tables, so that no job is spent on reading file footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
QUESTION_COUNT = 8
DIMENSION_BY_MOD = {0: "sentiment", 1: "approval", 2: "trust", 3: "satisfaction"}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.root = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}.parquet")

    # --- surveys ---------------------------------------------------------
    def respondents(self) -> DataFrame:
        o, c, n = self.raw("orders"), self.raw("customer"), self.raw("nation")
        return (
            o.join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .select(
                F.col("n_regionkey").alias("project_id"),
                (F.col("n_regionkey") * 100 + F.year("o_orderdate") - 1994).alias("survey_id"),
                F.col("o_orderkey").alias("respondent_id"),
                F.when(F.col("o_orderkey") % 23 != 0, F.col("c_mktsegment")).alias("age_band"),
                F.col("o_orderstatus").alias("gender"),
                F.col("n_name").alias("province_code"),
                F.col("o_orderpriority").alias("urbanicity"),
                F.floor(F.col("o_totalprice") / 400).cast("int").alias("duration_sec"),
                F.col("o_orderdate").alias("completed_at"),
                (1 + (F.col("o_orderkey") % 5) * F.lit(0.1)).cast("double").alias("weight"),
            )
        )

    def responses(self) -> DataFrame:
        q = F.explode(F.sequence(F.lit(1), F.lit(QUESTION_COUNT)))
        key = F.col("o_orderkey")
        answer = 1 + (key * 13 + F.col("q") * F.col("q") * 7 + F.floor("o_totalprice")) % 5
        return (
            self.raw("orders")
            .select("o_orderkey", "o_totalprice", q.alias("q"))
            .select(
                key.alias("respondent_id"),
                F.col("q").alias("question_id"),
                F.when(key % 9 == 0, 3).otherwise(answer).cast("double").alias("value_num"),
            )
        )

    def questions(self) -> DataFrame:
        """Questionnaire of eight scale items, the same in every survey."""
        q = F.col("id") + 1
        dim = F.element_at(F.create_map(*[F.lit(x) for kv in DIMENSION_BY_MOD.items() for x in kv]), (q % 4).cast("int"))
        return self.spark.range(QUESTION_COUNT).select(
            q.cast("int").alias("question_id"),
            F.lit("LIKERT").alias("type"),
            dim.alias("poi_dimension"),
            (q % 2 == 0).alias("reverse_scored"),
            F.lit(5).alias("scale_points"),
        )

    def census(self, column: str = "c_mktsegment", name: str = "age_band") -> DataFrame:
        """Population share per project and category (column of customer or nation)."""
        c, n = self.raw("customer"), self.raw("nation")
        counts = (
            c.join(n, c.c_nationkey == n.n_nationkey)
            .groupBy(F.col("n_regionkey").alias("project_id"), F.col(column).alias(name))
            .agg(F.count(F.lit(1)).alias("c"))
        )
        total = counts.groupBy("project_id").agg(F.sum("c").alias("t"))
        return counts.join(total, "project_id").select(
            "project_id", name, (F.col("c") / F.col("t")).alias("census_share")
        )

    # --- signals ---------------------------------------------------------
    @staticmethod
    def source_of(event_type: Column) -> Column:
        return (
            F.when(event_type == "click", "SOCIAL")
            .when(event_type == "view", "MEDIA")
            .when(event_type == "error", "DIGITAL")
            .otherwise("SURVEY")
        )

    @staticmethod
    def metric_of(event_type: Column) -> Column:
        return (
            F.when(event_type == "click", "sentiment")
            .when(event_type == "purchase", "approval")
            .when(event_type == "signup", "trust")
            .when(event_type == "view", "issue_perception")
            .otherwise("satisfaction")
        )

    @staticmethod
    def week_end(ts: Column) -> Column:
        return F.date_add(F.date_trunc("week", ts).cast("date"), 6)

    def events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            "event_id",
            (F.col("user_id") % 5).alias("project_id"),
            "user_id",
            "event_type",
            self.source_of(kind).alias("source"),
            F.col("ts").cast("timestamp").alias("ts"),
            "value",
        )

    def snapshots(self) -> DataFrame:
        """National weekly metric snapshots of five index dimensions."""
        return (
            self.events()
            .groupBy(
                "project_id",
                self.metric_of(F.col("event_type")).alias("metric"),
                "source",
                self.week_end(F.col("ts")).alias("period_end"),
            )
            .agg(
                F.avg(F.least("value", F.lit(100.0))).alias("value"),
                (F.count(F.lit(1)) * 3).cast("int").alias("effective_n"),
            )
        )

    def positive_readings(self) -> DataFrame:
        """Weekly share of low-value events per source, as <source>_positive metrics."""
        return (
            self.events()
            .groupBy("project_id", "source", self.week_end(F.col("ts")).alias("period_end"))
            .agg(
                (100 * F.avg(F.when(F.col("value") < 50, 1.0).otherwise(0.0))).alias("value"),
                F.count(F.lit(1)).cast("int").alias("effective_n"),
            )
            .withColumn("metric", F.concat(F.lower("source"), F.lit("_positive")))
        )

    def segments(self) -> DataFrame:
        c, n = self.raw("customer"), self.raw("nation")
        counts = (
            c.join(n, c.c_nationkey == n.n_nationkey)
            .groupBy(F.col("n_regionkey").alias("project_id"), F.col("c_mktsegment").alias("name"))
            .agg(F.count(F.lit(1)).alias("c"))
        )
        total = counts.groupBy("project_id").agg(F.sum("c").alias("t"))
        base = (
            F.when(F.col("name") == "AUTOMOBILE", 70).when(F.col("name") == "BUILDING", -60)
            .when(F.col("name") == "FURNITURE", 15).when(F.col("name") == "HOUSEHOLD", -31).otherwise(2)
        )
        return counts.join(total, "project_id").select(
            "project_id",
            "name",
            (F.lit(100.0) * F.col("c") / F.col("t")).alias("size_pct"),
            (base * (F.lit(0.2) + F.lit(0.3) * F.col("project_id"))).cast("double").alias("sentiment"),
        )

    def mentions(self) -> DataFrame:
        e = F.col("event_id")
        return self.events().select(
            "event_id",
            "project_id",
            (e - F.when((e % 10 == 0) & (e > 0), 1).otherwise(0)).alias("external_id"),
            "source",
            F.col("ts").alias("published_at"),
            F.col("user_id").alias("author"),
            F.floor("value").cast("int").alias("engagement"),
            ((F.floor(F.col("value") * 100) % 201 - 100) / F.lit(100.0)).alias("sentiment"),
            F.when(e % 16 != 0, F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (e % 4 + 1).cast("int"))).alias("narrative"),
            (e % 10).cast("int").alias("topic_id"),
            (e % 200).alias("doc_id"),
            "event_type",
            "value",
        )

    def timeline(self) -> DataFrame:
        return self.events().filter(F.col("event_type") == "error").select(
            "event_id", "project_id", F.col("ts").alias("occurred_at"), "value"
        )

    # --- governance ------------------------------------------------------
    def ai_outputs(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        tail = (
            F.when(conv % 7 == 0, " disebabkan oleh harga").when(conv % 11 == 0, " pasti akan naik").otherwise("")
        )
        source = F.when(conv % 3 == 0, "SURVEY").when(conv % 3 == 1, "SOCIAL").otherwise("MEDIA")
        return (
            self.raw("conversations")
            .filter(F.col("role") == "assistant")
            .select(
                (conv * 1000 + turn).alias("id"),
                (conv % 5).alias("project_id"),
                F.to_json(F.struct(F.concat("text", tail).alias("summary"))).alias("payload"),
                F.when(conv % 3 == 0, "difference-in-differences").otherwise("RAG agregat").alias("method"),
                F.lit("v1").alias("model_version"),
                F.when(turn % 3 == 0, "LOW").when(turn % 3 == 1, "HIGH").otherwise("MEDIUM").alias("confidence"),
                F.array(
                    F.struct(
                        F.lit("metric_snapshot").alias("kind"),
                        F.col("text").alias("label"),
                        ((conv * 7 + turn * 3) % 400).cast("int").alias("n"),
                        source.alias("source"),
                    )
                ).alias("evidence"),
                (conv % 5 == 0).alias("is_simulation"),
                F.when(conv % 10 == 0, "hasil simulasi, bukan prediksi").when(conv % 13 == 0, "")
                .otherwise("satu gelombang survei").alias("limitations"),
                F.lit("PENDING").alias("human_review"),
            )
        )
