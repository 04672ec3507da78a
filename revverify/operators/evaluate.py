"""Benchmark metrics over case results (source, contract_id, format, operator, expectation, text_verdict, rule_ids, chars, duration_s, error)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import clause_bucket, wilson
from ..plans.materialize import kept


def case_grid(contracts: DataFrame, formats: list[str], operators: list[str]) -> DataFrame:
    """JN-13: every contract in every format with every operator, without a join: the two dimensions are exploded lists."""
    return contracts.select("contract_id", F.explode(F.array(*map(F.lit, formats))).alias("format")).select("*", F.explode(F.array(*map(F.lit, operators))).alias("operator"))


def discriminating(cases: DataFrame) -> DataFrame:
    """JN-14: blocking cases whose contract and format had its authorized edit accepted."""
    good = cases.where("operator = 'authorized' AND expectation = 'accept' AND text_verdict = 'pass' AND error IS NULL").select("source", "contract_id", "format").distinct()
    return cases.where("expectation = 'block'").join(good, ["source", "contract_id", "format"], "left_semi")


def false_pass(cases: DataFrame) -> DataFrame:
    """AGG-11: blocking cases that passed, overall, by format and by operator, with Wilson intervals; errors are out."""
    c = cases.where("expectation = 'block' AND error IS NULL")
    level = F.when(F.grouping("operator") == 0, "operator").when(F.grouping("format") == 0, "format").otherwise("overall")
    g = c.groupingSets([[], ["format"], ["operator"]], "format", "operator").agg(level.alias("level"), F.count_if(F.col("text_verdict") == "pass").alias("passed"), F.count("*").alias("total"))
    lo, hi = wilson(F.col("passed"), F.col("total"))
    return g.select("level", "format", "operator", "passed", "total", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def blocked_split(cases: DataFrame) -> DataFrame:
    """AGG-12: blocked cases by operator: fail or review."""
    return cases.where("expectation = 'block' AND error IS NULL").groupBy("operator").agg(F.count_if(F.col("text_verdict") == "fail").alias("failed"), F.count_if(F.col("text_verdict") == "review").alias("review"))


def acceptance(cases: DataFrame) -> DataFrame:
    """AGG-13: accepted and all accept cases; errors are not accepted."""
    return cases.where("expectation = 'accept'").agg(F.count_if((F.col("text_verdict") == "pass") & F.col("error").isNull()).alias("accepted"), F.count("*").alias("total"))


def false_block_reasons(cases: DataFrame) -> DataFrame:
    """AGG-13, ORD-04: rules that kept accept cases from passing, by falling count."""
    bad = cases.where("expectation = 'accept' AND (text_verdict IS DISTINCT FROM 'pass' OR error IS NOT NULL)")
    rule = F.explode(F.when(F.col("error").isNotNull(), F.array(F.lit("runner-error"))).otherwise(F.col("rule_ids")))
    return bad.select(rule.alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id")


def acceptance_by_bucket(cases: DataFrame) -> DataFrame:
    """AGG-14, JN-16: acceptance by length of the edited clause; buckets without cases show zeros."""
    got = cases.where("expectation = 'accept'").groupBy(clause_bucket(F.col("chars")).alias("bucket")).agg(F.count_if((F.col("text_verdict") == "pass") & F.col("error").isNull()).alias("accepted"), F.count("*").alias("total"))
    dim = cases.sparkSession.createDataFrame([("<1k",), ("1-2k",), ("2-5k",), (">5k",)], "bucket string")
    return dim.join(got, "bucket", "left").select("bucket", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("total", F.lit(0)).alias("total"))


def durations(cases: DataFrame) -> DataFrame:
    """AGG-17: median and nearest-rank 95th percentile of the durations of cases without error; 0 without any.

    Equal values are counted first; the values are cut into ranges and ranked range by range, so no task holds all of them.
    """
    values = cases.where("error IS NULL AND duration_s IS NOT NULL").groupBy(F.col("duration_s").cast("double").alias("v")).agg(F.count("*").alias("c"))
    d = kept(values.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = d.groupBy("part").agg(F.sum("c").alias("n"))  # one row a range
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"), F.sum("n").over(W.Window.partitionBy()).alias("n"))
    upto = F.sum("c").over(W.Window.partitionBy("part").orderBy("v"))
    ranked_ = d.withColumn("upto", upto).join(F.broadcast(parts), "part").withColumn("upto", F.col("below") + F.col("upto"))
    at = lambda rank: F.max(F.when((rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto")), F.col("v")))
    low, high, p95 = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2)), at(F.ceil(F.col("n") * 0.95) - 1)
    return ranked_.agg(F.coalesce((low + high) / 2, F.lit(0.0)).alias("median"), F.coalesce(p95, F.lit(0.0)).alias("p95"))


def run_counts(cases: DataFrame) -> DataFrame:
    """AGG-18 and AGG-26: counts of a run, and whether it passes the gate."""
    bad = (F.col("expectation") == "block") & (F.col("text_verdict") == "pass") & F.col("error").isNull()
    held = (F.col("expectation") == "accept") & ((F.col("text_verdict") != "pass") | F.col("text_verdict").isNull() | F.col("error").isNotNull())
    c = cases.agg(F.count("*").alias("cases"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(bad).alias("false_passes"), F.count_if(held).alias("held_back"), F.count_distinct("operator").alias("operators"))
    return c.withColumn("gate", (F.col("errors") == 0) & (F.col("false_passes") == 0) & (F.col("held_back") == 0))


def ranked(df: DataFrame, key: str, count: str) -> DataFrame:
    """ORD-04 as a column: rank by falling count, then key."""
    return df.withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc(count), key)))
