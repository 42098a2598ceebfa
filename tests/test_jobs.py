"""Calibration fits, sources and sinks, streams."""

import datetime
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import calibrate as C
from fieldtrust.operators import crossdoc as X
from fieldtrust.operators import merge as M
from fieldtrust.operators import ops as O
from fieldtrust.operators import review as V
from fieldtrust.operators import synth as Y
from fieldtrust.sources import rulesets as L
from fieldtrust.sources import tables as S
from fieldtrust.streaming import stateful as T


def test_logistic_equals_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))).astype(float)
    a, w = np.hstack([x, np.ones((300, 1))]), np.zeros(4)
    reg = np.diag([1.0, 1, 1, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + reg, a.T @ (p - y) + reg @ w)
    rows = [("all", r.tolist(), float(v)) for r, v in zip(x, y, strict=True)] + [(None, r.tolist(), float(v)) for r, v in zip(-x, y, strict=True)] + [("none", None, 1.0), ("none", [1.0, 2.0, 3.0], None)]
    got = {r.grp: [*r.weights, r.bias] for r in C.fit_logistic(spark.createDataFrame(rows, "grp string, vector array<double>, y double")).collect()}
    assert got.keys() == {"all", None} and got["all"] == pytest.approx(w.tolist(), abs=1e-7)
    assert got[None] == pytest.approx([*(-w[:3]), w[3]], abs=1e-7)
    assert C.fit_logistic(spark.createDataFrame([], "grp string, vector array<double>, y double")).count() == 0


def test_isotonic_blocks_of_all_ranges_equal_one_pass(spark):
    """Groups that lie in many ranges, with ties, against pooling the points one after another."""
    rng = random.Random(3)
    rows = [(g, round(rng.random(), 3), int(rng.random() < (0.2 if g == "flat" else 0.1 + 0.8 * rng.random()))) for g in ("a", "flat", None) for _ in range(1500)]
    rows += [("a", p / 100, int(rng.random() < p / 100)) for p in range(100)] + [("one", 0.5, 1), ("a", None, 1), ("a", 0.5, None)]
    got = {}
    for r in C.isotonic_blocks(spark.createDataFrame(rows, "grp string, p double, y int").repartition(5)).collect():
        got.setdefault(r.grp, []).append((r.lo, r.hi, r.n, r.mean))
    for g in ("a", "flat", None, "one"):
        points = {}
        for k, p, y in rows:
            if k == g and p is not None and y is not None:
                n, s = points.get(p, (0, 0))
                points[p] = (n + 1, s + y)
        blocks = []
        for p, (n, s) in sorted(points.items()):
            blocks.append([p, p, n, s])
            while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
                _, hi, n, s = blocks.pop()
                blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + n, blocks[-1][3] + s]
        assert sorted(got[g]) == [(lo, hi, n, pytest.approx(s / n)) for lo, hi, n, s in blocks]
    knots = {r.grp: r for r in C.fit_isotonic(spark.createDataFrame(rows, "grp string, p double, y int")).collect()}
    assert knots["a"].iso_x == sorted(knots["a"].iso_x) and knots["a"].iso_y == sorted(knots["a"].iso_y)


def test_calibrators(spark, tmp_path):
    rng = random.Random(1)
    rows = [("names", "calibration", {"agreement": (a := rng.random())}, int(rng.random() < a)) for _ in range(400)] + [("dates", "tune", {"agreement": 0.5}, 1)] * 5
    df = spark.createDataFrame(rows, "grp string, split string, features map<string,double>, y int")
    table = C.fit_calibrators(df)
    C.save_calibrators(table, str(tmp_path), "1")
    got = {r.grp: r for r in C.load_calibrators(spark, str(tmp_path), "1").collect()}
    assert got["dates"].weights == M.WEIGHTS and got["names"].iso_x == sorted(got["names"].iso_x)
    probe = spark.createDataFrame([("names", {"agreement": 0.95}), ("names", {"agreement": 0.1}), ("none", {})], "grp string, features map<string,double>")
    p = [r.confidence for r in C.with_confidence(probe, table).orderBy(F.desc("grp"), F.desc(F.element_at("features", "agreement"))).collect()]
    assert max(p) > 0.75 and min(p) < 0.3
    with pytest.raises(ValueError):
        C.fit_calibrators(df.withColumn("split", F.lit("test")))
    C.save_calibrators(table.withColumn("features", F.reverse("features")), str(tmp_path), "2")
    with pytest.raises(ValueError):
        C.load_calibrators(spark, str(tmp_path), "2")


def test_default_scores_and_interpolation(spark):
    full = {n: 1.0 for n in ("agreement", "pair_similarity", "self_consistency", "readers_ok", "format_valid")}
    half = full | {"agreement": 0.5, "pair_similarity": 0.5, "self_consistency": 0.5}
    got = [r.p for r in spark.createDataFrame([(full,), (half,)], "f map<string,double>").select(M.scored(M.feature_vector(F.col("f"))).alias("p")).collect()]
    assert got[0] > 0.99 and got[1] < 0.9
    xs, ys = F.array(*map(F.lit, [0.2, 0.4, 0.4, 0.9])), F.array(*map(F.lit, [0.1, 0.3, 0.5, 0.95]))
    points = [0.0, 0.2, 0.3, 0.4, 0.65, 0.9, 1.0]
    got = [r.v for r in spark.createDataFrame([(p,) for p in points], "p double").select(M.interpolated(F.col("p"), xs, ys).alias("v")).collect()]
    assert got == pytest.approx([0.1, 0.1, 0.2, 0.5, 0.725, 0.95, 0.95])


def test_unknown_matcher_is_refused(spark):
    with pytest.raises(ValueError):
        X.resolved(spark, [X.PairRule("r", "a.b", "c.d", "magic")], spark.createDataFrame([("a", "b")], "slot string, field string"))


def test_identifier_hash_is_hmac(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("id", "199012345678")], "k string, v string").select(O.identifier_hash(F.col("k"), F.col("v"), "secret").alias("h")).first().h
    assert got == hmac.new(b"secret", b"id:199012345678", hashlib.sha256).hexdigest()


def test_sources(spark, tmp_path):
    lines = [json.dumps({"image": f"{i}.png", "session_id": f"s{i % 3}", "slot": f"d{i}", "capture": "c1", "split": ["tune", "test"][i % 2], "as_of": "2026-01-01", "fields": {"a": str(i)}, "variants": ["v"], "human_expected": i == 1}, ensure_ascii=False) for i in range(6)]
    (tmp_path / "m.jsonl").write_text("\n\n".join(lines), encoding="utf-8")
    rows = S.read_manifest(spark, str(tmp_path / "m.jsonl"))
    assert rows.count() == 6 and S.load_split(rows, "tune").count() == 3 and S.load_split(rows, "all").count() == 6
    S.write_manifest(rows, str(tmp_path / "out"))
    assert S.load_split(spark.read.json(str(tmp_path / "out")), "test").count() == 3
    (tmp_path / "truth.json").write_text(json.dumps({"variants": [], "as_of": "2026-01-01", "documents": {"tax_card": {"fields": {"a": "1", "b": "2"}, "glare_over": "a"}}}, indent=1))
    assert {(r.slot, r.field, r.value, r.glare_over) for r in S.read_ground_truth(spark, str(tmp_path / "truth.json")).collect()} == {("tax_card", "a", "1", "a"), ("tax_card", "b", "2", "a")}
    images = tmp_path / "images"
    images.mkdir()
    for n, data in (("a.png", b"x"), ("b.JPG", b"x"), ("c.bin", b"y")):
        (images / n).write_bytes(data)
    found = S.scan_images(spark, str(images)).collect()
    assert len({r.sha256 for r in found}) == 2 and {r.mime for r in found} == {"image/png", "image/jpeg", "application/octet-stream"}
    todo = S.pending_images(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "reader string, sha256 string"), spark.createDataFrame([("a", "1", "ok"), ("a", "2", "ok"), ("a", "2", "unavailable")], "reader string, sha256 string, status string"))
    assert {tuple(r) for r in todo.collect()} == {("a", "2"), ("b", "1")}


def test_tables_with_contracts(spark, tmp_path):
    assert len(S.TABLES) == 17 and all(S.table_schema(t).fieldNames() for t in S.TABLES)
    assert all((t, c) in [(t, x.name) for x in S.contract(t)] for t, c in S.DEFAULTS) and all({*S.CODES[t]} <= {x.name for x in S.contract(t)} for t in S.CODES)
    path = str(tmp_path / "tables")
    rows = [("r1", "a", "custom", "t", "2026-01-31", "2026-01-01", "sent"), ("r2", "b", "custom", "t", "2026-01-31", "2026-01-01", None), ("r3", "a", "odd", "t", "31.1.", "2026-01-01", "gone"), ("r4", "a", None, "t", "2026-01-31", None, "sent")]
    S.append_table(spark.createDataFrame([(*r, "extra") for r in rows], "id string, tenant_id string, kind string, title string, due_at string, notify_at string, status string, raw_of_theirs string"), "reminders", path)
    got = S.scan_table(spark, "reminders", path)
    assert got.schema.fieldNames() == S.table_schema("reminders").fieldNames() and got.schema["due_at"].dataType.typeName() == "date"
    assert sorted((r.id, r.status, r.created_at is not None) for r in got.collect()) == [("r1", "sent", True), ("r2", "scheduled", True)]
    assert {json.loads(r.raw)["id"]: r.problems for r in S.rejected_rows(spark, "reminders", path).collect()} == {"r3": ["code:kind", "code:status", "type:due_at"], "r4": ["null:kind", "null:notify_at"]}
    assert json.loads(S.rejected_rows(spark, "reminders", path).where("raw LIKE '%r3%'").first().raw)["due_at"] == "31.1."
    one = S.scan_table(spark, "reminders", path, "b")
    assert [r.id for r in one.collect()] == ["r2"] and "PartitionFilters: [isnotnull(accepted" in one._jdf.queryExecution().toString() and "(tenant_id#" in one._jdf.queryExecution().toString().split("PartitionFilters:")[1].split("]")[0]
    S.append_table(spark.createDataFrame([("x", "first", None), (None, "second", None), ("z", None, None)], "id string, name string, created_at timestamp"), "tenants", path)
    assert [r.id for r in S.scan_table(spark, "tenants", path).collect()] == ["x"] and S.rejected_rows(spark, "tenants", path).count() == 2
    S.append_table(spark.createDataFrame([("x", 1, "a", "e", '{"k": [1, 2]}'), ("x", 2, "a", "e", "{k")], "tenant_id string, id int, actor string, event string, detail string").withColumns({"prev_hash": F.lit("0"), "hash": F.lit("1")}), "audit_log", path)
    assert [(r.id, r.detail) for r in S.scan_table(spark, "audit_log", path, "x").collect()] == [(1, '{"k": [1, 2]}')]
    with pytest.raises(ValueError):
        S.scan_table(spark, "nothing", path)


def test_evaluation_export(spark):
    page = lambda session, slot, capture, fields, gone=None, bucket=None: (session, slot, capture, datetime.date(2026, 1, 1), fields, gone, bucket, ["alef"] if session == "s1" else ["clean"], session == "s1")
    rows = [page("s1", "tax_card", "a/s1_tax_c2.jpg", {"tax_number": "1", "holder_name_ar": "n", "issue_date": "d"}, ["tax_number"], "worst"), page("s1", "national_id_front", "a/s1_front_c2.jpg", {"sex": "M", "unknown": "x"}), page("s1", "tax_card", "a/s1_tax.png", {"tax_number": "1"}, [], "good"), page("s2", "other", "b.png", {"x": "1"})]
    manifest = spark.createDataFrame(rows, "session_id string, slot string, capture string, as_of date, fields map<string,string>, gt_unreadable array<string>, bucket string, variants array<string>, human_expected boolean").repartition(3)
    out = {r.id: (json.loads(r.question), json.loads(r.answer)) for r in S.export_eval_dataset(manifest, L.field_specs(spark)).collect()}
    assert out.keys() == {"s1-2", "s1-clean", "s2-clean"}
    question, answer = out["s1-2"]
    assert question == {"as_of": "2026-01-01", "documents": [{"slot": "national_id_front", "capture": "a/s1_front_c2.jpg"}, {"slot": "tax_card", "capture": "a/s1_tax_c2.jpg"}]}
    assert list(answer["fields"])[:2] == ["national_id_front.full_name_ar", "national_id_front.surname_ar"] and len(answer["fields"]) == 11 and "unknown" not in str(answer)
    assert (answer["fields"]["tax_card.tax_number"], answer["fields"]["tax_card.holder_name_ar"], answer["fields"]["national_id_front.sex"], answer["fields"]["tax_card.expiry_date"]) == (None, "n", "M", None)
    assert answer["unreadable"] == ["tax_card.tax_number"] and len(answer["required"]) == 9 and answer["buckets"] == [None, "worst"] and (answer["variants"], answer["human_expected"]) == (["alef"], True)
    assert out["s1-clean"][1]["fields"]["tax_card.tax_number"] == "1" and out["s2-clean"][1]["fields"] == {} and out["s2-clean"][1]["required"] == []


def test_report_has_its_run(spark, tmp_path):
    metrics = spark.createDataFrame([("exact", 0.5), ("cer", 0.25)], "metric string, value double")
    S.write_report(metrics, str(tmp_path / "report"), run="r1", split="tune", manifest="abc")
    S.write_report(metrics.where("metric = 'cer'"), str(tmp_path / "report2"), run="r2", split="test", manifest="abc")
    got = spark.read.parquet(str(tmp_path / "report"))
    assert {tuple(r) for r in got.select("metric", "value", "run", "split", "manifest").collect()} == {("exact", 0.5, "r1", "tune", "abc"), ("cer", 0.25, "r1", "tune", "abc")}


@pytest.fixture
def requests(spark, tmp_path):
    rng = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    rows = [(str(i % 2), i % 5, start + datetime.timedelta(minutes=rng.randrange(4000)), i, f"h{rng.randrange(2)}") for i in range(120)]
    df = spark.createDataFrame(rows, "tenant_id string, key long, ts timestamp, request_id long, hash string")
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


def run(spark, stream, tmp_path, name):
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_streams_equal_batch(spark, requests, tmp_path):
    source = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    got = run(spark, T.idempotent(source.withWatermark("ts", "3 days")), tmp_path, "verdicts")
    assert {tuple(r) for r in got.select("tenant_id", "key", "request_id", "verdict").collect()} == {tuple(r) for r in O.idempotent(requests).collect()}
    events = requests.select("key", F.col("request_id").alias("event_id"), "ts")
    limits = run(spark, T.rate_limit(source.select("key", F.col("request_id").alias("event_id"), "ts").withWatermark("ts", "3 days"), 1), tmp_path, "limits")
    want = {r.event_id: r for r in O.rate_limit(events, 1).collect()}
    for r in limits.collect():
        assert r.allowed == want[r.event_id].allowed and math.isclose(r.wait_seconds, want[r.event_id].wait_seconds, abs_tol=1e-6)
    seen = []
    T.sweep(source, lambda batch: seen.append(batch.count()), str(tmp_path / "cp-sweep")).awaitTermination()
    assert sum(seen) == 120


def one_file_a_batch(spark, tmp_path, schema, batches):
    """A stream of several micro-batches, in the order given."""
    for i, rows in enumerate(batches):
        path = tmp_path / f"w{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        part = next(path.glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        target = tmp_path / "in" / f"{i}.parquet"
        part.rename(target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def held(spark, tmp_path, name):
    return spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / f"cp-{name}")).select("key.*", "value.*").collect()


def test_session_assembly(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    at = lambda m: t + datetime.timedelta(minutes=m)
    batches = [
        [(1, "a", at(0)), (1, "b", at(1)), (2, "a", at(0)), (1, "b", at(2)), (3, None, at(0))],
        [(1, "a", at(20)), (2, "a", at(25))],  # again, within the hour: neither a new session nor a new slot
        [(9, "a", at(200))],
        [(2, "b", at(201)), (9, "b", at(202))],  # after its end session 2 begins anew
        [(8, "a", at(400))],
    ]
    source = one_file_a_batch(spark, tmp_path, "session_id long, slot string, ts timestamp", batches)
    got = run(spark, T.assemble_sessions(source.withWatermark("ts", "1 minute"), 2), tmp_path, "assembled").collect()
    assert sorted((r.session_id, r.slots, r.complete) for r in got) == [(1, ["a", "b"], True), (2, ["a"], False), (2, ["b"], False), (3, [], False), (9, ["a", "b"], True)]
    assert [(r.session_id, r.slots, r.complete) for r in held(spark, tmp_path, "assembled")] == [(8, "a", False)]


def test_full_buckets_leave_no_state(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    at = lambda s: t + datetime.timedelta(seconds=s)
    batches = [[(1, i, at(i)) for i in range(6)] + [(2, 10, at(3))], [(1, 20, at(20)), (2, 21, at(21))], [(3, 30, at(600))], [(1, 40, at(601)), (4, 41, at(602))]]
    source = one_file_a_batch(spark, tmp_path, "key long, event_id long, ts timestamp", batches)
    got = run(spark, T.rate_limit(source.withWatermark("ts", "1 second"), 3), tmp_path, "buckets").collect()
    want = O.rate_limit(spark.createDataFrame([r for b in batches for r in b], "key long, event_id long, ts timestamp"), 3).collect()
    assert sorted((r.event_id, r.allowed, round(r.wait_seconds, 6)) for r in got) == sorted((r.event_id, r.allowed, round(r.wait_seconds, 6)) for r in want)
    assert sum(not r.allowed for r in got) >= 3 and sorted(r.key for r in held(spark, tmp_path, "buckets")) == [1, 3, 4]


def test_a_repeated_batch_leaves_the_same_table(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    batches = [[(1, "a", t), (1, "b", t)], [(2, "a", t), (2, "b", t), (3, "b", t)]]
    source = one_file_a_batch(spark, tmp_path, "session_id long, slot string, ts timestamp", batches)
    lines = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (7, "q")], "session_id long, text string")
    out, write, broken = str(tmp_path / "out"), T.batch_table(str(tmp_path / "out")), []

    def stopped_once(rows, batch_id):
        write(rows, batch_id)
        if batch_id == 1 and not broken:
            broken.append(batch_id)
            raise RuntimeError("stopped after its rows were written")

    def go(sink):
        score = lambda rows, batch: rows.groupBy("session_id").count().join(batch, "session_id")
        T.scored_stream(T.assemble_sessions(source.withWatermark("ts", "1 minute"), 2), lines, score, sink, str(tmp_path / "cp")).awaitTermination()

    with pytest.raises(Exception, match="stopped"):
        go(stopped_once)
    once = sorted(tuple(r) for r in T.batch_rows(spark, out).select("session_id", "count").collect())
    go(stopped_once)
    assert broken == [1] and sorted(tuple(r) for r in T.batch_rows(spark, out).select("session_id", "count").collect()) == once == [(1, 2), (2, 1)]


def test_hot_keys_are_not_gathered_in_one_row(spark):
    events = spark.range(20_000).selectExpr("'t' AS tenant_id", "'k' AS key", "id", "id AS event_id", "id AS request_id", "cast(id AS string) AS body", "'h' AS hash", "timestamp_seconds(id * 10) AS ts")
    made = [O.idempotent(events), O.rate_limit(events, 3), O.append_audit(events)]
    assert not any("collect_list" in x._jdf.queryExecution().toString() for x in made)
    ids = {r.request_id for r in made[0].where("verdict = 'run'").collect()}
    assert ids == {0, 8640, 17280} and made[0].count() == 20_000
    assert 10_000 <= made[1].where("allowed").count() <= 10_004 and made[2].select("hash").distinct().count() == 20_000


def test_rulesets(spark, tmp_path):
    rules = L.load_ruleset(spark)
    assert [p.rule for p in rules.pairs] == ["name_id_vs_license", "name_id_vs_tax", "business_name_license_vs_tax"] and rules.after_today.count() == 3
    assert rules.lifetimes.collect() == [("national_id", 10, 30)] and rules.adult_age == 18
    (tmp_path / "r.json").write_text(json.dumps(L.RULES))
    assert L.load_ruleset(spark, str(tmp_path / "r.json")).formats.collect() == rules.formats.collect()
    for bad in ({"id": "r", "left": "a.b", "right": "c.d", "matcher": "guess"}, {"id": "r", "left": "ab", "right": "c.d", "matcher": "exact"}):
        with pytest.raises(ValueError):
            L.load_ruleset(spark, L.RULES | {"rules": [bad]})
    # each reference meets the slot that carries its field
    assert {(r.left_slot, r.right_slot) for r in X.resolved(spark, rules.pairs, L.field_specs(spark)).collect()} == {("national_id_front", "commercial_registration"), ("national_id_front", "tax_card"), ("commercial_registration", "tax_card")}


def test_delivery_retries(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    at = lambda s: t + datetime.timedelta(seconds=s)
    rows = [(1, at(0), False, t), (1, at(30), False, t), (1, at(200), True, t), (1, at(300), False, t), (2, at(0), True, t), (3, at(86395), False, t)]
    spark.createDataFrame(rows, "delivery_id long, ts timestamp, ok boolean, created_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("delivery_id long, ts timestamp, ok boolean, created_at timestamp").parquet(str(tmp_path / "in"))
    got = run(spark, T.delivery_retries(source.withWatermark("ts", "1 hour")), tmp_path, "retries").collect()
    assert sorted((r.delivery_id, r.attempts, r.status, r.next_at) for r in got if r.delivery_id == 1) == [(1, 1, "pending", at(30)), (1, 2, "pending", at(150)), (1, 3, "delivered", None)]
    assert {(r.delivery_id, r.status) for r in got if r.delivery_id > 1} == {(2, "delivered"), (3, "failed")}


def test_scored_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "a", t), (1, "b", t), (2, "a", t)], "session_id long, slot string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("session_id long, slot string, ts timestamp").parquet(str(tmp_path / "in"))
    lines = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "session_id long, text string")
    seen = {}
    score = lambda rows, batch: rows.groupBy("session_id").count().join(batch, "session_id")
    T.scored_stream(T.assemble_sessions(source.withWatermark("ts", "1 minute"), 2), lines, score, lambda out, i: seen.update({i: out.collect()}), str(tmp_path / "cp")).awaitTermination()
    assert [(r.session_id, r["count"], r.complete) for rows in seen.values() for r in rows if r.session_id == 1] == [(1, 2, True)]


def test_payloads_and_results_nest_a_session(spark):
    fields = spark.createDataFrame([(1, "b", "y", "ok", "secret", 0.9), (1, "a", "x", "unreadable", None, 0.0), (2, "a", "x", "ok", "hidden", 0.5)], "session_id long, slot string, field string, status string, value string, confidence double")
    payload = {r.session_id: json.loads(r.payload) for r in V.reviewer_payload(fields).collect()}
    assert payload[1] == {"fields": [{"slot": "a", "field": "x", "status": "unreadable", "confidence": 0.0, "placeholder": "{field:a.x}"}, {"slot": "b", "field": "y", "status": "ok", "confidence": 0.9, "placeholder": "{field:b.y}"}]}
    assert "secret" not in str(payload) and "hidden" not in str(payload)
    decisions = spark.createDataFrame([(1, "human_review"), (2, "auto_pass"), (3, "auto_pass")], "session_id long, outcome string")
    got = {r.session_id: r for r in V.session_result(decisions, fields).collect()}
    assert [(f.slot, f.value) for f in got[1].fields] == [("a", None), ("b", "secret")] and got[2].outcome == "auto_pass" and got[3].fields is None


def test_planned_variants(spark):
    rows = Y.plan_variants(spark, 5000, 3).collect()
    assert all((r.variants == ["clean"]) == (r.i % 5 < 2) for r in rows)
    others = [r for r in rows if r.variants != ["clean"]]
    assert {len(r.variants) for r in others} == {1, 2} and abs(sum(len(r.variants) == 1 for r in others) / len(others) - 0.7) < 0.03
    assert all(r.variants == sorted(set(r.variants)) and set(r.variants) <= set(Y.VARIANTS) for r in others) and len({v for r in others for v in r.variants}) == len(Y.VARIANTS)
    assert all(r.human_expected == any(Y.VARIANTS.get(v, False) for v in r.variants) for r in rows)
    assert rows == Y.plan_variants(spark.newSession(), 5000, 3).collect() != Y.plan_variants(spark, 5000, 4).collect()


def test_identifiers_are_found_by_their_hash(spark):
    rows = spark.createDataFrame([("t", "id", "12 34", 1), ("t", "id", "١٢٣٤", 2), ("u", "id", "1234", 3), ("t", "id", None, 4), ("t", "name", "1234", 5)], "tenant_id string, field string, value string, session_id long")
    hashed = rows.withColumn("hash", O.lookup_hash(F.lit("digits"), F.col("field"), F.col("value"), "key"))
    asked = hashed.where("session_id = 1").unionByName(hashed.where("session_id = 1")).unionByName(hashed.where("session_id = 4"))
    assert sorted(r.session_id for r in O.find_identifier(hashed, asked).collect()) == [1, 2]
