"""Features, searches and scoring against golden values and SQL."""

import gzip
import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from nearmark import catalogue
from nearmark.config import SearchParams, switch
from nearmark.functions import keys
from nearmark.functions.features import parse_payload, vectorize, vectorize_fixed
from nearmark.operators import ann, evaluate, knn, stats
from nearmark.plans.score import score, score_bodies
from nearmark.sources import fixtures
from nearmark.sources.references import build_info, content_hash, fast_paths_allowed, index_info, read_evaluation, read_index, read_references, with_keys, write_index
from nearmark.streaming.score_stream import score_stream

SF = "/root/testdata/sf0.001"
#: A quiet and a loud payload of our own; QUIET_D and LOUD_D are worked out by hand.
QUIET = {
    "id": "q-1", "transaction": {"amount": 250.0, "installments": 3, "requested_at": "2025-06-02T10:30:00Z"},
    "customer": {"avg_amount": 500.0, "tx_count_24h": 4, "known_merchants": ["M-1", "M-2"]},
    "merchant": {"id": "M-2", "mcc": "5912", "avg_amount": 125.0}, "terminal": {"is_online": True, "card_present": False, "km_from_home": 12.5},
    "last_transaction": {"timestamp": "2025-06-02T09:18:59Z", "km_from_current": 40.0},
}
LOUD = {
    "id": "l-1", "transaction": {"amount": 8000.0, "installments": 12, "requested_at": "2025-06-08T23:05:00Z"},
    "customer": {"avg_amount": 100.0, "tx_count_24h": 30, "known_merchants": []},
    "merchant": {"id": "M-9", "mcc": "7995", "avg_amount": 20000.0}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 900.0}, "last_transaction": None,
}
# 250/10000; 3/12; 0.5/10; 10/23 = .43478; Monday; 72 minutes/1440; 40/1000; 12.5/1000; 4/20; online; no card; known; .20; 125/10000
QUIET_D = [250, 2500, 500, 4348, 0, 500, 400, 125, 2000, 10000, 0, 0, 2000, 125]
# 8000/10000; 12/12; 80/10 capped; 23/23; Sunday 6/6; no last; 900/1000; 30/20 capped; card; unknown; .85; capped
LOUD_D = [8000, 10000, 10000, 10000, 10000, -10000, -10000, 9000, 10000, 0, 10000, 10000, 8500, 10000]


def near_to(d, *steps):
    return [[-1.0 if x == -10000 else min(max(x / 10000 + step, 0), 1) for x in d] for step in steps]


REFS = [*((v, "legit") for v in near_to(QUIET_D, 0, 0.01, 0.02)), *((v, "fraud") for v in near_to(LOUD_D, 0, -0.01, -0.02))]


def bodies(spark, *payloads):
    return spark.createDataFrame([(i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)], "id long, body string")


def changed(**sections):
    return {k: {**v, **sections[k]} if isinstance(sections.get(k), dict) and v else sections.get(k, v) for k, v in QUIET.items()}


def test_vectors_by_hand(spark):
    rows = [list(r) for r in vectorize(parse_payload(bodies(spark, QUIET, LOUD))).orderBy("id").select(*(f"d{i}" for i in range(14))).collect()]
    assert rows == [QUIET_D, LOUD_D]


def test_bad_bodies_are_approved(spark, tmp_path):
    path = tmp_path / "refs.json"
    path.write_text(json.dumps([{"vector": v, "label": l} for v, l in REFS]))
    refs = with_keys(read_references(spark, str(path)))
    missing = {k: v for k, v in QUIET.items() if k != "last_transaction"}
    bad = [missing, {**QUIET, "last_transaction": {}}, "{", "", None, changed(transaction={"requested_at": "2026-13-01T00:00:00Z"}), changed(id="x" * 9000)]
    out = {r["id"]: r for r in score_bodies(bodies(spark, QUIET, LOUD, *bad), refs).collect()}
    assert len(out) == 2 + len(bad)
    assert (out[0]["frauds"], out[0]["approved"], out[1]["frauds"], out[1]["approved"]) == (2, True, 3, False)
    assert all(out[i]["approved"] and out[i]["fraud_score"] == 0 and out[i]["parse_error"] for i in range(2, 2 + len(bad)))


def test_unknown_label_and_no_rows(spark, tmp_path):
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError, match="no reference"):
        read_references(spark, str(tmp_path / "none.json"))
    (tmp_path / "odd.json").write_text(json.dumps([{"vector": [0.0] * 14, "label": "other"}]))
    with pytest.raises(Exception, match="unknown label"):
        read_references(spark, str(tmp_path / "odd.json")).collect()


def test_neighbour_order_covers_all(spark):
    keys = spark.createDataFrame([(0,), (1234,), (4095,)], "bucket_key int")
    got = stats.neighbour_order(keys).groupBy("bucket_key").agg(F.countDistinct("key").alias("n"), F.max("rank").alias("last"), F.min(F.when(F.col("rank") == 0, F.col("key"))).alias("first")).collect()
    assert all((r["n"], r["last"], r["first"]) == (4096, 4095, r["bucket_key"]) for r in got) and len(got) == 3


def test_ties_and_few_references(spark):
    refs = spark.createDataFrame([(i, i % 2, *([0] * 14), 0) for i in range(9)], "ref_id long, label int, " + ", ".join(f"d{i} int" for i in range(14)) + ", kd_key int")
    q = refs.where("ref_id = 0").select(F.lit(7).cast("long").alias("id"), *(f"d{i}" for i in range(14)), "kd_key")
    for found in (knn.flat(q, refs), knn.two_pass(q, refs), knn.kd(q, refs)):
        assert [r["ref_id"] for r in found.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert knn.fraud_counts(q, knn.flat(q, refs.where("ref_id < 2"))).first()["frauds"] == 1


def test_scores_and_ranks(spark):
    assert spark.range(100).select(F.col("id").cast("double").alias("v")).transform(lambda d: evaluate.nearest_rank(d, "v", 0.99)).first()["p99"] == 98.0
    row = spark.range(1).select(evaluate.final_score(F.lit(1.0), evaluate.detection_score(F.lit(0), F.lit(0.0), F.lit(0.0))).alias("s"), evaluate.p99_score(F.lit(2001.0)).alias("late")).first()
    assert (row["s"], row["late"]) == (6000.0, -3000.0)


def test_parameters_and_info(spark):
    p = SearchParams.from_settings({"profile_fast": "yes", "min_candidates": "10", "max_candidates": "5"})
    assert (p.profile_fast, p.max_candidates, p.early_candidates, p.without_fast_paths().profile_fast) == (True, 10, 10, False)
    assert {r["key"]: r["value"] for r in build_info(spark, {"a": "x\n", "b": " "}).collect()} == {"a": "x?"}
    assert fast_paths_allowed("AB", "cd, ab") and not fast_paths_allowed(None, "ab")


@pytest.mark.parametrize("name", ["vectorize", "fixed_point_vectorize", "payload_variants", "quantize_refs", "profile_stats", "knn_kd", "kd_counters", "bucket_bounds", "ann_prefix", "score", "score_with_shortcuts", "confusion_bodies", "path_stats"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    cursor = con.execute(catalogue.ORACLE_SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", ["knn_two_pass", "embedding_knn"])
def test_blocks_of_queries(spark, monkeypatch, name):
    """Queries that come in several blocks get what they get in one."""
    expected = sorted(map(repr, catalogue.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(knn, "QUERY_BLOCK", 12)
    assert sorted(map(repr, catalogue.QUERIES[name](spark, SF).collect())) == expected


@pytest.mark.parametrize("name", ["knn_flat_top5", "knn_kd", "knn_kd_capped", "score"])
def test_many_references(spark, monkeypatch, name):
    """References too many to send, dealt in many slices and chunks, give what a broadcast gives."""
    expected = sorted(map(repr, catalogue.QUERIES[name](spark, SF).collect()))
    for setting, value in (("FEW_REFS", 0), ("REF_SLICE", 100), ("QUERY_CHUNK", 20), ("COLUMNS", 16), ("ROWS", 8)):
        monkeypatch.setattr(knn, setting, value)
    assert sorted(map(repr, catalogue.QUERIES[name](spark, SF).collect())) == expected


def test_stop_rules(spark):
    """Both bucket searches against a walk bucket by bucket, with limits that cut, stop early and stop strong."""
    q, r = fixtures.queries(spark, SF), fixtures.references(spark, SF)
    refs = [x.asDict() for x in r.orderBy("ref_id").collect()]
    dims = [f"d{i}" for i in range(14)]
    order = {}
    for x in stats.neighbour_order(q).orderBy("bucket_key", "rank").collect():
        order.setdefault(x["bucket_key"], []).append(x["key"])
    by_bucket = {}
    for x in refs:
        by_bucket.setdefault(x["bucket_key"], []).append(x)
    for p in (SearchParams(early_candidates=100, min_candidates=300, max_candidates=350), SearchParams(early_candidates=50, min_candidates=700, max_candidates=700, edge_fallback=True)):
        expected, early = set(), 0
        for x in q.collect():
            found, scanned = [], 0
            for turn, key in enumerate(order[x["bucket_key"]]):
                held = by_bucket.get(key, [])[: p.max_candidates - scanned]
                if not held:
                    continue
                found += [(sum((x[d] - y[d]) ** 2 for d in dims), turn, y["ref_id"], y["label"]) for y in held if y["ordinal"] != x["id"]]
                found, scanned = sorted(found)[:5], scanned + len(held)
                frauds = sum(y for *_, y in found)
                if scanned >= p.max_candidates or scanned >= p.min_candidates:
                    break
                if scanned >= p.early_candidates and (frauds in (0, 5) or p.edge_fallback and frauds in (1, 4)):
                    early += 1
                    break
            expected |= {(x["id"], k + 1, ref, label, dist, scanned) for k, (dist, _, ref, label) in enumerate(found)}
        assert early
        for f in (ann.search, ann.search_by_joins):
            assert set(map(tuple, f(q, r, p, own="ordinal").collect())) == expected


def test_ids_that_repeat(spark, monkeypatch):
    """Null and repeated ids are rows of their own, on every path."""
    q, r = fixtures.queries(spark, SF), fixtures.references(spark, SF)
    truth = {x["id"]: x["frauds"] for x in score(q, r).collect()}
    far = [k for k, v in truth.items() if v == 5][:2] + [k for k, v in truth.items() if v == 0][:2]
    same = q.where(F.col("id").isin(far)).withColumn("id", F.when(F.col("id").isin(far[::2]), F.lit(None)).otherwise(F.lit(7)).cast("long"))
    expected = sorted([(None, 5), (None, 0), (7, 5), (7, 0)], key=repr)
    for p in (SearchParams(kd=True), SearchParams(flat=True), SearchParams(), SearchParams(exact_fallback="risky")):
        got = sorted(((x["id"], x["frauds"]) for x in score(same, r, p).collect()), key=repr)
        assert got == expected, p
    monkeypatch.setattr(knn, "FEW_REFS", 0)
    assert sorted(((x["id"], x["frauds"]) for x in score(same, r).collect()), key=repr) == expected


def test_recall(spark):
    """Bucketed searches find nine of ten true neighbours at least."""
    sf = "/root/testdata/sf0.01"
    true = {(x["id"], x["ref_id"]) for x in catalogue.QUERIES["knn_flat_top5"](spark, sf).collect()}
    for name in ("ann_prefix", "ann_early_stop", "ann_exact_fallback"):
        assert len(true & {(x["id"], x["ref_id"]) for x in catalogue.QUERIES[name](spark, sf).collect()}) >= 0.9 * len(true)


def test_planted_rows_reach_rules(spark):
    flags = catalogue.QUERIES["fallback_flags"](spark, SF)
    names = [c for c in flags.columns if c != "id"]
    row = flags.agg(*(F.count_if(c).alias(c) for c in names), F.count("*").alias("n")).first()
    assert all(0 < row[c] < row["n"] for c in names)
    risky, plain = (catalogue.QUERIES[n](spark, SF) for n in ("risky_knn", "knn_flat_top5"))
    assert risky.exceptAll(plain).count() and catalogue.QUERIES["risky_hist"](spark, SF).count()


def test_bucket_bounds_hold(spark):
    """No reference is nearer than its bucket's bound."""
    q, r = fixtures.queries(spark, SF), fixtures.references(spark, SF)
    pairs = knn.as_queries(q).crossJoin(r.select("bucket_key", *(f"d{i}" for i in range(14)))).select("id", F.col("bucket_key").alias("key"), knn.distance().alias("dist"))
    least = pairs.groupBy("id", "key").agg(F.min("dist").alias("dist"))
    assert least.join(catalogue.QUERIES["bucket_bounds"](spark, SF), ["id", "key"]).where("dist < bound").count() == 0


def test_large_numbers_fall_back(spark):
    """An amount that no fixed-point form holds takes the value in doubles, and ends nothing."""
    odd = changed(transaction={"amount": 1e16}, merchant={"avg_amount": 1e20}, terminal={"km_from_home": 1e18})
    row = vectorize_fixed(parse_payload(bodies(spark, odd, QUIET))).orderBy("id").select(*(f"d{i}" for i in range(14))).collect()
    assert (row[0]["d0"], row[0]["d7"], row[0]["d13"]) == (10000, 10000, 10000)
    assert list(row[1]) == QUIET_D


def test_index_round_trip(spark, tmp_path):
    """What is written is read again; another shape, other references or too much info is refused."""
    refs, path = fixtures.references(spark, SF), str(tmp_path / "index")
    write_index(refs, path, {"reference_sha256": "AB12", "dim": 14, "scale": 10000, "k": 5, "note": "a\tb", "blank": " "})
    index = read_index(spark, path, "cd, ab12")
    assert index["refs"].count() == refs.count() and index["partitions"].count() == stats.partition_boxes(refs).count()
    assert {x["key"]: x["value"] for x in index_info(spark, path).collect()} == {"reference_sha256": "AB12", "dim": "14", "scale": "10000", "k": "5", "note": "a?b"}
    q = fixtures.queries(spark, SF)
    assert sorted(map(repr, knn.kd(q, index["refs"]).collect())) == sorted(map(repr, knn.kd(q, refs).collect()))
    with pytest.raises(ValueError, match="other references"):
        read_index(spark, path, "cd")
    for info, message in (({"dim": 13}, "another shape"), ({"note": "x" * 5000}, "bytes of build info")):
        build_info(spark, info).write.mode("overwrite").parquet(f"{path}/build_info")
        with pytest.raises(ValueError, match=message):
            read_index(spark, path)


def test_content_and_order(spark, tmp_path):
    """Hashes are of what files hold; ordinals follow file names and places."""
    parts = [[(near_to(QUIET_D, 0.01 * k)[0], "legit") for k in range(3)], [(near_to(LOUD_D, -0.01 * k)[0], "fraud") for k in range(2)]]
    for name, part in zip(("b.json", "a.json.gz"), parts, strict=True):
        raw = json.dumps([{"vector": v, "label": y} for v, y in part]).encode()
        (tmp_path / name).write_bytes(gzip.compress(raw) if name.endswith("gz") else raw)
        assert hashlib.sha256(raw).hexdigest() in {x["sha256"] for x in content_hash(spark, str(tmp_path)).collect()}
    got = read_references(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(x["ordinal"], x["label"]) for x in got] == [(0, 1), (1, 1), (2, 0), (3, 0), (4, 0)] and [x["d0"] for x in got[2:]] == [250, 350, 450]


def test_evaluation_to_dumps(spark, tmp_path):
    """A corpus with a body that doesn't parse, scored, counted and dumped, errors with their request."""
    entries = [{"request": r, "expected_approved": e} for r, e in ((QUIET, True), (LOUD, False), (LOUD, True), ({**QUIET, "merchant": None}, False), (QUIET, True))]
    (tmp_path / "corpus.json").write_text(json.dumps({"stats": {"total": 5}, "entries": entries}))
    (tmp_path / "refs.json").write_text(json.dumps([{"vector": v, "label": y} for v, y in REFS]))
    corpus = read_evaluation(spark, str(tmp_path / "corpus.json"), limit=4)
    refs = with_keys(read_references(spark, str(tmp_path / "refs.json")))
    found = score_bodies(corpus.select("id", "body"), refs).join(corpus.select("id", "expected_approved"), "id")
    v = vectorize(parse_payload(corpus.select("id", "body"))).withColumns({"profile_key": keys.profile_key(), "bucket_key": keys.bucket_key()})
    scored = found.join(v.select("id", "profile_key", "bucket_key", *(f"d{i}" for i in range(14))), "id")
    row = evaluate.confusion(scored).first()
    assert (row["total"], row["correct"], row["fp"], row["fn"], row["parse_errors"], row["weighted_errors"]) == (4, 2, 1, 1, 1, 4)
    evaluate.write_report(scored, str(tmp_path / "out"), corpus)
    read = lambda name: spark.read.json(str(tmp_path / "out" / name))
    assert read("rows").count() == 3 and read("figures").first()["fn"] == 1
    assert {(x["id"], x["request"]["id"]) for x in read("errors").collect()} == {(2, "l-1"), (3, "q-1")}
    assert {(x["path"], x["n"], x["errors"]) for x in read("path_stats").collect()} == {("native_kdtree", 3, 1), ("parse_error", 1, 1)}
    assert [(x["fp"], x["fn"]) for x in read("error_groups").collect()] == [(1, 0)]


def test_stream(spark, tmp_path):
    """A stream of bodies is scored batch by batch as a table is."""
    (tmp_path / "refs.json").write_text(json.dumps([{"vector": v, "label": y} for v, y in REFS]))
    refs = with_keys(read_references(spark, str(tmp_path / "refs.json")))
    for k, payload in enumerate((QUIET, LOUD)):
        bodies(spark, payload, "{").withColumn("id", F.col("id") + 10 * k).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_stream(source, refs, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = {x["id"]: (x["approved"], x["parse_error"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (True, False), 1: (True, True), 10: (False, False), 11: (True, True)}


def test_switches():
    assert switch("yes") and switch("TRUE") and not switch("Yes") and switch("Yes", any_case=True) and not switch("on", any_case=True)
    p = SearchParams.from_settings({"profile_min_count": "7", "fraud_min": "9"})
    assert (p.legit_min, p.fraud_min) == (7, 9)


def test_sweep(spark):
    rows = {(x["profile"], x["max_partitions"]): x for x in catalogue.QUERIES["parameter_sweep"](spark, SF).collect()}
    assert set(rows) == {(p, m) for p in (0, 2) for m in (1, 4, 256)} and all(x["total"] == 105 for x in rows.values())
    assert rows[0, 1]["avg_searched"] == 1 and rows[0, 256]["avg_searched"] >= rows[0, 4]["avg_searched"] > 1


def test_blocks_are_counted(spark):
    with pytest.raises(ValueError):
        knn.blocks(spark.range(1).selectExpr("explode(sequence(1, 50)) n", "7 id"), 10)


def test_positions(spark):
    ids = [7, 3, 250, 99, 100, 1000]
    got = stats.positions(spark.createDataFrame([(i,) for i in ids], "id long"), "id", 100).collect()
    assert {r["id"]: r["position"] for r in got} == {i: k + 1 for k, i in enumerate(sorted(ids))}
