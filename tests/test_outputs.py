"""Links, edit targets, published bundles, records, lines and the running verdict on small tables."""

import difflib
import json
import random
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from revverify.operators import links, outputs, targets
from revverify.operators.clauses import clauses_of
from revverify.operators.events import manifest_digest
from revverify.streaming import running

PLACE = "page_index int, x0 double, y0 double, x1 double, y1 double"


def similar(a, b):
    return a == b or difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.98


@pytest.mark.parametrize("seed", range(3))
def test_links_are_those_of_all_pairs(spark, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ab cde" if seed else "ab") for _ in range(rnd.choice([0, 3, 24, 25, 60, 120, 300]))) for _ in range(25)]

    def changed(t):
        t = list(t)
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice(["x", "", "ü", "yy"])
        return "".join(t)

    logical = [(d, i, rnd.choice(base)) for d in range(3) for i in range(20)]
    rendered = [(d, i, changed(rnd.choice(base)), None if rnd.random() < 0.1 else 1, 0.0, 0.0, 1.0, 1.0) for d in range(3) for i in range(20)]
    lg, rd = spark.createDataFrame(logical, "doc_id long, ordinal int, norm string"), spark.createDataFrame(rendered, f"doc_id long, ordinal int, norm string, {PLACE}")
    got = {(r["doc_id"], r["ordinal"]): (r["rendered"], r["eligible"]) for r in links.link_rendered(lg, rd).collect()}
    want = {}
    for d, i, x in logical:
        partners = [r for r in rendered if r[0] == d and similar(x, r[2])]
        alone = len(partners) == 1 and sum(e == d and similar(y, partners[0][2]) for e, _, y in logical) == 1
        want[d, i] = (partners[0][1] if alone and partners[0][3] is not None else None, len(partners))
    assert got == want
    status = {r["doc_id"]: r["incomplete"] for r in links.link_status(links.link_rendered(lg, rd), rd).collect()}
    assert status == {d: any(want[d, i][0] is None for i in range(20)) for d in range(3)}


def test_all_linked_is_complete(spark):
    lg = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, ordinal int, norm string")
    rd = spark.createDataFrame([(1, 5, "b", 0, 0.0, 0.0, 1.0, 1.0), (1, 6, "a", 0, 0.0, 0.0, 1.0, 1.0)], f"doc_id long, ordinal int, norm string, {PLACE}")
    assert links.link_status(links.link_rendered(lg, rd), rd).first()["incomplete"] is False
    assert links.link_status(links.link_rendered(lg, rd.limit(1)), rd.limit(1)).first()["incomplete"] is True
    assert links.link_rendered(lg.limit(0), rd).count() == 0


def test_edit_targets(spark):
    docs = {
        1: ["Article I Term", "The term of this agreement is 30 days from signing."],
        2: ["Article I Price", "The price to be paid is $12,34 or 5.5% of it."],
        3: ["Article I Price", "Pay one half (50%) now and thirty (30) days later the rest of 7 months."],
        4: ["Article I Price", "The price in full is $1,900 (one thousand nine hundred)."],
        5: ["12 years"],
        6: ["Article I Fee", "The fee falls due in 9 months here.", "It was $ 250 before."],
        7: ["Nothing to change."],
    }
    paragraphs = spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "contract_id long, ordinal int, text string")
    got = {r["contract_id"]: r for r in targets.choose_edit(paragraphs, clauses_of(paragraphs, "contract_id")).collect()}
    pick = lambda d: (got[d]["before"], got[d]["after"], got[d]["paragraph"], got[d]["reason"])
    assert pick(1) == ("30 days", "45 days", 1, None) and got[1]["anchor"] == "The term of this agreement is" and got[1]["label"] == "Article I"
    assert pick(2) == ("5.5%", "6.5%", 1, None)
    assert pick(3) == ("7 months", "22 months", 1, None)
    assert pick(4) == (None, None, None, "no-unique-target")
    assert pick(5) == (None, None, None, "no-unique-anchor")
    assert pick(6) == ("9 months", "24 months", 1, None)
    assert pick(7) == (None, None, None, "no-unique-target")
    tried = targets.first_places(targets.edit_places(paragraphs, clauses_of(paragraphs, "contract_id"))).where("contract_id = 3").orderBy("place_no").collect()
    assert [(r["before"], r["rejected"]) for r in tried] == [("7 months", None)]
    every = {(r["before"], r["rejected"]) for r in targets.edit_places(paragraphs, clauses_of(paragraphs, "contract_id")).where("contract_id IN (3, 4, 5)").collect()}
    assert every == {("7 months", None), ("50%", "restated"), ("$1,900", "restated"), ("12 years", "no-anchor")}


def test_bundles_are_published_once(spark, tmp_path):
    root = f"{tmp_path}/bundles"
    rows = [(b, f"core/{i}", f"content {b % 2} {i}") for b in range(4) for i in range(3)]
    p = spark.createDataFrame(rows, "bundle_id long, path string, content string")
    assert outputs.publish_bundles(p, root).count() == 2  # equal bundles are one
    assert outputs.publish_bundles(p, root).count() == 0
    more = p.union(spark.createDataFrame([(9, "core/0", "other")], p.schema))
    assert [r["bundle_id"] for r in outputs.publish_bundles(more, root).collect()] == ["9"]
    listed = more.where("bundle_id IN (0, 1, 9)").select("bundle_id", "path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("size_bytes"))
    want = {r["digest"] for r in manifest_digest(listed).collect()}
    got = outputs.verify_published(spark, root).collect()
    assert {r["manifest_digest"] for r in got} == want and all(r["valid"] and r["times"] == 1 for r in got)
    # Payloads of a run that never wrote its manifests are not seen; a run that lost a payload is told.
    spark.read.parquet(f"{root}/payloads").withColumn("run", F.lit("lost")).withColumn("content", F.lit(b"x")).write.mode("append").parquet(f"{root}/payloads")
    assert all(r["valid"] for r in outputs.verify_published(spark, root).collect())
    bad = spark.read.parquet(f"{root}/manifests").limit(1).withColumn("manifest_digest", F.lit("0" * 64))
    bad.write.mode("append").parquet(f"{root}/manifests")
    assert {r["manifest_digest"]: r["valid"] for r in outputs.verify_published(spark, root).collect()} == {**dict.fromkeys(want, True), "0" * 64: False}
    assert outputs.verify_published(spark, f"{root}/none").count() == 0


def test_records_fit_or_fail(spark):
    heads = spark.createDataFrame([(1, "ü", None), (2, 'q"', 5), (3, "", 1)], "pair_id long, name string, size long")
    child = spark.createDataFrame([(1, 2, '{"b":2}'), (1, 1, '{"a":1}'), (2, 1, '"' + "x" * 90 + '"')], "pair_id long, ordinal int, json string")
    got = {r["pair_id"]: r for r in outputs.verification_records(heads, {"facts": child, "zero": child.limit(0)}, 90).collect()}
    assert json.loads(got[1]["record"]) == {"facts": [{"a": 1}, {"b": 2}], "name": "ü", "size": None, "zero": []}
    assert got[1]["record"] == json.dumps(json.loads(got[1]["record"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert all(r["size_bytes"] == len(r["record"].encode()) for r in got.values() if r["record"])
    assert (got[2]["record"], got[2]["error"]) == (None, "oversize") and got[3]["error"] is None


def test_lines_are_numbered_over_ranges(spark, tmp_path):
    rnd = random.Random(1)
    cases = [(rnd.choice("abc"), rnd.randrange(40), rnd.choice([None, "t"])) for _ in range(500)]
    lines = outputs.result_lines(spark.createDataFrame(cases, "source string, contract_id long, error string").repartition(7), ["source", "contract_id"])
    got = sorted(map(tuple, lines.collect()))
    told = sorted(((s, c), json.dumps({"contract_id": c, "error": e, "source": s}, separators=(",", ":"))) for s, c, e in cases)
    assert got == [(i + 1, x) for i, (_, x) in enumerate(told)]
    path = tmp_path / uuid4().hex
    outputs.write_lines(lines, str(path))
    assert [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()] == [x for _, x in told]


LOG = "bundle_id long, sequence long, event_id long, finding_id long, decision string, previous_digest string, event_digest string, ts timestamp"


def test_running_verdict_in_any_order(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for b in range(8):
        for s in range(1, 13):
            if (b, s) == (1, 5):
                continue
            wrong = (b, s) == (2, 4)
            rows.append((b, s, b * 100 + s, rnd.randrange(9), rnd.choice(["approve", "reject"]), "?" if wrong else f"{b}-{s - 1}", f"{b}-{s}", s))
    rows.append((3, 2, 399, 1, "approve", "3-1", "3-2", 2))
    batches = [[], [], []]
    for r in rows:
        batches[rnd.randrange(3) if r[:2] != (3, 2) else 1].append(r)
    batches.append([(99, 1, 9999, 0, "approve", "", "z", 4000)])  # the watermark passes all that wait
    source, spark_ = f"{tmp_path}/in", spark
    before = spark_.conf.get(running.STORE[0], None)
    spark_.conf.set(*running.STORE)
    try:
        for batch in [*batches, [(98, 1, 9998, 0, "approve", "", "y", 4001)]]:
            df = spark_.createDataFrame([(*r[:7], r[7]) for r in batch], LOG.replace("ts timestamp", "t long")).withColumn("ts", F.timestamp_seconds(F.col("t") * 60)).drop("t")
            df.write.mode("append").parquet(source)
            stream = running.running_verdicts(spark_.readStream.schema(LOG).parquet(source), 3_600_000)
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark_.conf.unset(running.STORE[0]) if before is None else spark_.conf.set(running.STORE[0], before)
    got = {tuple(r) for r in spark_.read.schema(running.OUTPUT).parquet(f"{tmp_path}/out").where("bundle_id < 90").collect()}
    whole = spark_.createDataFrame([r[:7] for r in rows], LOG.replace(", ts timestamp", ""))
    want = {tuple(r) for r in running.effective_log(whole).collect()}
    assert got == want
    assert {r[3] for r in want} == {None, "sequence", "previous-digest", "repeated-finding"}
