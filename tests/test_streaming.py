import json
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opinionweave.operators import responses
from opinionweave.sources.ingest import read_documents
from opinionweave.streaming import mentions as ms
from opinionweave.streaming import respondents
from opinionweave.streaming.respondents import ingest_stream

SCHEMA = "project_id int, connector string, external_id string, source string, narrative string, published_at timestamp, sentiment double"


def files(spark, root, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/f{i}")
    return (
        spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(root)
    )


def mention(day, key, source="SOCIAL", narrative="A", sentiment=0.0):
    return (1, "x", key, source, narrative, datetime(2024, 1, 1) + timedelta(days=day), sentiment)


def test_dedup_over_batches(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), [[mention(0, "a"), mention(0, "a"), mention(0.1, "b")], [mention(0.2, "a"), mention(0.3, "c")]])
    out = str(tmp_path / "out")
    ms.run_available(ms.dedup_mentions(stream), out, str(tmp_path / "cp"))
    assert sorted(r.external_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_weekly_stream_equals_batch(spark, tmp_path):
    batches = [[mention(d + 0.01 * k, f"{d}-{k}", sentiment=k / 10) for k in range(5)] for d in range(0, 30, 3)]
    out = str(tmp_path / "out")
    ms.run_available(ms.weekly_signals(files(spark, str(tmp_path / "in"), batches)), out, str(tmp_path / "cp"))
    batch = ms.weekly_signals(spark.createDataFrame([m for b in batches for m in b], SCHEMA))
    newest = max(m[5] for b in batches for m in b) - timedelta(days=1)
    closed = batch.filter(F.col("period_end").cast("timestamp") <= F.lit(newest))
    key = lambda df: sorted((r.period_start, r.source, r.volume, round(r.mean_sentiment, 9)) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(closed) and closed.count() > 1


def test_momentum_of_windows(spark):
    rows = [mention(0, "1"), mention(0, "2", narrative="B"), mention(7, "3"), mention(7, "4"), mention(7, "5", narrative="B")]
    windows = ms.sliding_counts(spark.createDataFrame(rows, SCHEMA))
    got = {(str(r.window_end), r.narrative): r.momentum_7d for r in ms.momentum_of_windows(windows).collect()}
    assert got[("2024-01-09", "A")] == 16.67 and got[("2024-01-02", "A")] is None


class Landing:
    """Documents dropped as files and ingested run by run."""

    def __init__(self, spark, folder):
        self.spark, self.files, self.root, self.checkpoint = spark, folder / "in", str(folder / "out"), str(folder / "cp")
        self.files.mkdir(parents=True)

    def drop(self, name, docs):
        lines = [
            {"org_id": "o", "survey_id": survey, "completed_at": f"2024-01-01T00:00:{second:02}Z", "respondent": {"anon_code": code, "duration_sec": duration},
             "answers": [{"question_id": "q", "value_num": 1.0}, {"question_id": "q", "value_num": 2.0}]}
            for survey, code, duration, second in docs
        ]
        (self.files / name).write_text("\n".join(map(json.dumps, lines)))

    def run(self):
        ingest_stream(read_documents(self.spark, str(self.files), streaming=True), self.root, self.checkpoint).awaitTermination()

    def table(self, name):
        return self.spark.read.parquet(f"{self.root}/{name}")

    def tables(self):
        return {n: sorted(map(str, (r.asDict(recursive=True) for r in self.table(n).collect()))) for n in respondents.PARTS}


BATCHES = [
    [("s", "a", 100, 3), ("s", "b", 100, 1), ("s", "b", 7, 2), ("t", "a", 50, 1), ("s", None, 100, 1)],
    [("s", "c", 30, 1), ("s", "a", 5, 0), ("s", None, 9, 9)],
    [("t", "b", 10, 1), ("t", "a", 50, 1), ("s", "d", None, 1)],
]


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    landing = Landing(spark, tmp_path_factory.mktemp("ingest"))
    for i, batch in enumerate(BATCHES):
        landing.drop(f"{i}.json", batch)
        landing.run()
    return landing


def test_respondent_stream_scores_against_all_so_far(spark, ingested):
    people = {(r.survey_id, r.anon_code): r for r in ingested.table("respondents").collect()}
    assert set(people) == {("s", "a"), ("s", "b"), ("s", None), ("s", "c"), ("s", "d"), ("t", "a"), ("t", "b")}
    assert people["s", "a"].duration_sec == 100 and people["s", "b"].duration_sec == 100
    assert people["s", "c"].quality_flags == ["SPEEDING"] and people["s", "b"].quality_flags == [] and people["t", "b"].quality_flags == ["SPEEDING"]
    rejected = sorted((r.batch, r.anon_code or "") for r in ingested.table("rejected_documents").collect())
    assert rejected == [(0, "b"), (1, ""), (1, "a"), (2, "a")]
    assert ingested.table("responses").count() == ingested.table("rejected_responses").count() == 7
    whole = responses.ingest_batch(read_documents(spark, str(ingested.files / "0.json")))["respondents"]
    first = {k: r for k, r in people.items() if r.batch == 0}
    assert {(r.survey_id, r.anon_code): r.quality_score for r in whole.collect()} == {k: r.quality_score for k, r in first.items()}


def test_batches_read_state_only(spark, tmp_path, ingested):
    """Stored respondents are not read again, and the counts are one row a duration, in at most two versions a bucket."""
    landing = Landing(spark, tmp_path / "x")
    for i, batch in enumerate(BATCHES):
        landing.drop(f"{i}.json", batch)
        landing.run()
        for name in respondents.PARTS:
            if i < len(BATCHES) - 1:
                shutil.rmtree(f"{landing.root}/{name}", ignore_errors=True)
    last = {r.anon_code: (r.survey_id, r.quality_score) for r in landing.table("respondents").collect()}
    want = {r.anon_code: (r.survey_id, r.quality_score) for r in ingested.table("respondents").filter("batch = 2").collect()}
    assert last == want and landing.table("rejected_documents").count() == 1
    for i in range(3, 9):  # the same durations again and again
        landing.drop(f"{i}.json", [("s", f"x{i}{k}", 100 + k, 0) for k in range(3)])
        landing.run()
    versions = {}
    for path in (tmp_path / "x" / "out" / "durations").glob("batch=*/bucket=*"):
        versions.setdefault(path.name, []).append(path)
    assert all(len(v) <= 2 for v in versions.values())
    newest = [str(max(v, key=lambda p: int(p.parent.name.split("=")[1]))) for v in versions.values()]
    counts = {(r.survey_id, r.duration_sec): r.n for r in spark.read.parquet(*newest).collect()}
    assert counts == {("s", 100): 3 + 6, ("s", 30): 1, ("s", 101): 6, ("s", 102): 6, ("t", 50): 1, ("t", 10): 1}


@pytest.mark.parametrize("table", ["respondents", "responses", "rejected_responses"])
def test_restart_in_the_middle_of_a_batch(spark, tmp_path, monkeypatch, ingested, table):
    """A batch that fails after some of its tables are written is run again and gives the same tables."""
    landing, write = Landing(spark, tmp_path / "x"), respondents.overwrite_partitions
    for i, batch in enumerate(BATCHES):
        landing.drop(f"{i}.json", batch)
        if i == 1:
            def broken(df, path, by):
                write(df, path, by)
                if path.endswith(f"/{table}"):
                    raise RuntimeError("lost")

            monkeypatch.setattr(respondents, "overwrite_partitions", broken)
            with pytest.raises(Exception, match="lost"):
                landing.run()
            monkeypatch.setattr(respondents, "overwrite_partitions", write)
        landing.run()
    assert landing.tables() == ingested.tables()


def test_mentions_are_kept_once_per_project(spark, tmp_path):
    def row(project, key, minute, source):
        return (project, "x", key, source, None, datetime(2024, 1, 1, 0, minute), float(minute))

    batches = [[row(1, "a", 5, "late"), row(1, "a", 1, "early"), row(2, "a", 3, "other"), row(1, None, 1, "none")], [row(1, "a", 0, "too late"), row(1, None, 0, "again"), row(1, "b", 0, "new")]]
    stream = files(spark, str(tmp_path / "in"), batches)
    ms.ingest_mentions(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.batch, r.project_id, r.source, r.sentiment) for r in got.collect()) == [(0, 1, "early", 1.0), (0, 1, "none", 1.0), (0, 2, "other", 3.0), (1, 1, "new", 0.0)]


def test_author_sessions(spark, tmp_path):
    """Sessions go on over batches, close a gap after their last mention, and are told apart by author."""
    schema = "project_id int, author int, published_at timestamp, engagement int, sentiment double"
    at = lambda author, hours: (1, author, datetime(2024, 1, 1) + timedelta(hours=hours), 1, hours / 10)
    batches = [[at(1, 0), at(1, 20), at(2, 1)], [at(1, 43), at(2, 26)], [at(3, 200)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/f{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    ms.run_available(ms.author_sessions(stream), out, str(tmp_path / "cp"))
    hours = lambda t: (t - datetime(2024, 1, 1)).total_seconds() / 3600
    got = sorted((r.author, hours(r.session_start), hours(r.session_end), r.mentions) for r in spark.read.parquet(out).collect())
    assert got == [(1, 0, 43, 3), (2, 1, 1, 1), (2, 26, 26, 1)]
