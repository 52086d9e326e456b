"""Records as state of a stream against the batch run's keyed merges."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import merge
from tidemark.streaming.record_state import latest, record_changes

START = datetime(2026, 3, 1)
COLUMNS = "source_slug string, external_id string, url string, raw string, seq long, crawl_at timestamp"


def crawls(rng, n):
    """What each crawl of a source shows; records change, go and come back."""
    for k in range(n):
        at = START + timedelta(hours=k)
        yield at, [("s", str(i), f"u{k}", f'{{"v":{rng.randint(0, 1)}}}', j, at) for j, i in enumerate(rng.sample(range(6), rng.randint(3, 5)))]


def test_stream_gives_the_records_of_the_batch_run(spark, tmp_path):
    shown = list(crawls(random.Random(1), 5))
    records, kinds = spark.createDataFrame([], schemas.SOURCE_RECORD), []
    for at, rows in shown:
        batch = spark.createDataFrame(rows, COLUMNS)
        merged = merge.upsert_records(records, batch, F.lit(at))
        new = F.when(F.col("was").isNull(), "new").when(F.col("was") == "gone", "revived").when(F.col("changed"), "changed").otherwise("same")
        kinds += [(r.external_id, r.kind, at) for r in merged.filter(F.col("last_seen_at") == F.lit(at)).select("external_id", new.alias("kind")).collect()]
        records = merge.tombstone(merged.drop("changed", "was"), "s", batch, F.lit(at))
        records = spark.createDataFrame(records.collect(), schemas.SOURCE_RECORD)
    landing = tmp_path / "landing"
    landing.mkdir()
    changes = record_changes(spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(landing)), 3600)
    for _, rows in [*shown, (None, [("other", "x", "u", "{}", 0, START + timedelta(hours=4.5))])]:
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(str(landing))
        # stopped and started again for each crawl: the state is in the checkpoint
        query = changes.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "changes")))
        query.option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
    said = spark.read.parquet(str(tmp_path / "changes")).filter("source_slug = 's'")
    assert sorted((r.external_id, r.change, r.at) for r in said.filter("change <> 'gone'").collect()) == sorted(kinds)
    columns = [f.name for f in schemas.SOURCE_RECORD]
    got = sorted(tuple(r) for r in latest(said).select(columns).collect())
    wanted = sorted(tuple(r) for r in records.select(columns).collect())
    assert [x[:8] for x in got] == [x[:8] for x in wanted]
    assert [x[8] for x in got] == [x[8] for x in wanted] and any(x[8] for x in wanted) and said.filter("change = 'revived'").count() > 0
