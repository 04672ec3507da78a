"""Streams over the given tables, with the SQL of what they must end in."""

from __future__ import annotations

from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.events import decision_log
from .plans.materialize import shared_folder
from .queries import LOG_SQL
from .registry import query
from .sources.corpus import table
from .streaming import running

#: Days of event time that arrive together, and that an event waits for its predecessor.
STEP_DAYS, WAIT_DAYS = 8, 16
_DAY = 86_400_000


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def faulty_log(spark, sf_dir) -> DataFrame:
    """The decision logs with an event lost, one sent again under another number, and one with a wrong digest, in some bundles; ``arrival`` numbers the files' order: every ninth event is late."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    log = decision_log(events).join(events.select("event_id", "ts"), "event_id").where(~((F.col("bundle_id") % 7 == 0) & (F.col("sequence") == 4)))
    twice = (F.col("bundle_id") % 5 == 0) & (F.col("sequence") == 3)
    log = log.withColumn("copy", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    wrong = (F.col("bundle_id") % 11 == 0) & (F.col("sequence") == 6)
    late = (F.col("event_id") % 9 == 0).cast("int")
    start = events.agg(F.unix_millis(F.min("ts")).alias("start"))
    log = log.crossJoin(F.broadcast(start)).withColumn("arrival", F.floor((F.unix_millis("ts") - F.col("start")) / (STEP_DAYS * _DAY)).cast("int") + late)
    return log.select("bundle_id", "sequence", (F.col("event_id") + 1_000_000_000 * F.col("copy")).alias("event_id"), "finding_id", "decision", F.when(wrong, "x").otherwise(F.col("previous_digest")).alias("previous_digest"), "event_digest", "ts", "arrival")


@query(f"""WITH {LOG_SQL}, raw AS (SELECT log.*, epoch_ms(ts) AS ms, unnest(CASE WHEN bundle_id % 5 = 0 AND sequence = 3 THEN [0, 1] ELSE [0] END) AS copy FROM log JOIN events USING (event_id) WHERE NOT (bundle_id % 7 = 0 AND sequence = 4)),
bad AS (SELECT bundle_id, least(CASE WHEN bundle_id % 7 = 0 THEN 5 ELSE 1000000000 END, CASE WHEN bundle_id % 11 = 0 THEN 6 ELSE 1000000000 END) AS stop FROM (SELECT DISTINCT bundle_id FROM raw)),
x AS (SELECT raw.*, stop, copy = 0 AND sequence < stop AS good FROM raw JOIN bad USING (bundle_id)),
y AS (SELECT *, good AND row_number() OVER (PARTITION BY bundle_id, finding_id, good ORDER BY sequence) > 1 AS again FROM x),
z AS (SELECT *, CASE WHEN good THEN CASE WHEN again THEN 'repeated-finding' END WHEN copy = 0 AND sequence = stop AND bundle_id % 7 <> 0 THEN 'previous-digest' ELSE 'sequence' END AS error,
  sum((good AND NOT again AND decision = 'approve')::INTEGER) OVER w AS yes, sum((good AND NOT again AND decision <> 'approve')::INTEGER) OVER w AS no FROM y WINDOW w AS (PARTITION BY bundle_id ORDER BY sequence, copy))
SELECT bundle_id, event_id + 1000000000 * copy AS event_id, sequence, error, CASE WHEN error IS NULL THEN yes::BIGINT END AS approved, CASE WHEN error IS NULL THEN no::BIGINT END AS rejected FROM z
-- What waits for a predecessor is still open at the end of the stream, unless its time has come.
WHERE copy = 1 OR sequence < stop OR (sequence = stop AND bundle_id % 7 <> 0) OR ms + {WAIT_DAYS * _DAY} <= (SELECT max(epoch_ms(ts)) FROM events)""")
def str_running_verdict(spark, sf_dir):
    """STR-02: the decision logs as a stream of files, some events late, with the state kept from run to run."""
    base = f"{shared_folder(table(spark, sf_dir, 'events'))}/{uuid4().hex}"
    log = faulty_log(spark, sf_dir)
    log.repartition("arrival").write.partitionBy("arrival").parquet(f"{base}/all")
    schema = log.drop("arrival").schema
    arrivals = [r["arrival"] for r in spark.read.parquet(f"{base}/all").select("arrival").distinct().orderBy("arrival").collect()]
    with setting(spark, *running.STORE):
        for a in arrivals:
            spark.read.schema(schema).parquet(f"{base}/all/arrival={a}").write.mode("append").parquet(f"{base}/in")
            stream = running.running_verdicts(spark.readStream.schema(schema).parquet(f"{base}/in"), WAIT_DAYS * _DAY)
            stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(running.OUTPUT).parquet(f"{base}/out")
