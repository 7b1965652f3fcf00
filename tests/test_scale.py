"""What has to hold where tables are large, on small ones."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmark import catalogue
from nearmark.config import SearchParams
from nearmark.operators import ann, knn, wide
from nearmark.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["kd_counters", "knn_kd_capped", "knn_two_pass", "fallback_flags"])
def test_cells(spark, monkeypatch, name):
    """References dealt in cells give what a broadcast gives, counters included."""
    expected = sorted(map(repr, catalogue.QUERIES[name](spark, SF).collect()))
    for setting, value in (("FEW_REFS", 0), ("REF_SLICE", 100), ("QUERY_CHUNK", 20), ("LEAF", 16), ("NODE", 2)):
        monkeypatch.setattr(knn, setting, value)
    assert sorted(map(repr, catalogue.QUERIES[name](spark, SF).collect())) == expected


def test_tree_compares_few(monkeypatch):
    """The tree finds what all pairs find, ties and a query's own row included, and compares few of them."""
    rng = np.random.default_rng(5)
    n = 40_000
    v = (rng.integers(0, 20, (n, knn.DIM)) * (rng.random((1, knn.DIM)) < 0.4) * 300).astype(np.int16)
    v[::7] = v[0]
    args = rng.permutation(n), (v[:, 0] > 900).astype(np.int32), v, (v.sum(1) % 3).astype(np.int64), np.arange(n)
    ids = np.arange(0, n, 400)
    compared, compare = [], knn.References._compare
    monkeypatch.setattr(knn.Tree, "_compare", lambda self, found, at, q, own, begin, end: (compared.append(len(at) * (end - begin)), compare(self, found, at, q, own, begin, end))[1])
    true, flat = knn.References(*args).flat(ids, v[ids]), knn.Tree(*args).flat(ids, v[ids])
    near = ~(v[ids] == v[0]).all(1)
    for got in (flat, knn.Tree(*args).pruned(ids, v[ids], args[3][ids])[0]):
        assert (got.dist == true.dist).all() and (got.ref == true.ref).all() and (got.label == true.label).all()
    compared.clear()
    knn.Tree(*args).flat(ids[near], v[ids[near]])
    assert sum(compared) < 0.25 * near.sum() * n


def test_known_merchants(spark):
    """A user's earlier merchants, in order, none of them twice."""
    rows = fixtures.transactions(spark, SF).select("event_id", "p.customer.known_merchants").collect()
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).orderBy("us", "event_id").collect()
    met, expected = {}, {}
    for e in events:
        mine = met.setdefault(e["user_id"], set())
        expected[e["event_id"]] = [f"MERC-{m:03d}" for m in sorted(mine)]
        mine.add(e["event_id"] * 13 % 97)
    assert {x["event_id"]: x["known_merchants"] for x in rows} == expected


def test_wide_vectors_in_pieces(spark, monkeypatch):
    """All pairs, dealt in many slices and chunks, give what SQL gives."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    monkeypatch.setattr(wide, "SLICE", 30)
    monkeypatch.setattr(wide, "CHUNK", 4)
    cursor = con.execute(catalogue.ORACLE_SQL["embedding_knn"])
    got = catalogue.QUERIES["embedding_knn"](spark, SF).select([d[0] for d in cursor.description])
    assert sorted(map(tuple, got.collect())) == sorted(cursor.fetchall())


def test_buckets_in_chunks(spark, monkeypatch):
    """Queries of a bucket in several chunks get what they get by broadcast, with no join of pairs in the plan."""
    p = SearchParams(early_candidates=100, min_candidates=300, max_candidates=350)
    q, r = fixtures.queries(spark, SF), fixtures.references(spark, SF)
    expected = sorted(map(tuple, ann.search(q, r, p, own="ordinal").collect()))
    monkeypatch.setattr(ann, "QUERY_CHUNK", 2)
    got = ann.search_by_joins(q, r, p, own="ordinal")
    assert sorted(map(tuple, got.collect())) == expected
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("pruned", [True, False])
def test_copies_in_cells(spark, monkeypatch, pruned):
    """Of many equal references a tree keeps what can be a neighbour; slices of them are put together, numbers are of all rows."""
    monkeypatch.setattr(knn, "FEW_REFS", 0)
    monkeypatch.setattr(knn, "REF_SLICE", 100)
    monkeypatch.setattr(knn, "QUERY_CHUNK", 50)
    rng = np.random.default_rng(3)
    n = 3000
    v = rng.integers(0, 4, (n, knn.DIM)) * 2000
    v[: n // 2], v[n // 2 : n // 2 + 400] = v[0], v[-1]
    label, ref, key = v[:, 1] // 2000 % 2, rng.permutation(n), v[:, 0] // 4000
    rows = spark.createDataFrame([(int(i), int(r), int(y), int(p), *map(int, x)) for i, (r, y, p, x) in enumerate(zip(ref, label, key, v))], f"ordinal long, ref_id long, label int, kd_key int, {', '.join(f'{d} int' for d in knn.DIMS)}").cache()
    ids = np.arange(0, n, 10)
    true = knn.References(ref, label.astype(np.int32), v.astype(np.int16), key, np.arange(n)).flat(ids, v[ids])
    queries = rows.where("ordinal % 10 = 0").withColumnRenamed("ordinal", "id")
    got = sorted(map(tuple, (knn.kd if pruned else knn.flat)(queries, rows, own="ordinal").collect()))
    assert got == [(i, k + 1, true.ref[a, k], true.label[a, k], true.dist[a, k]) for a, i in enumerate(ids.tolist()) for k in range(5)]
    slim = knn.slim(rows, "ordinal")
    places = knn.Places.over(slim)
    assert (places.slices > 2).any()
    trees = knn.grown(knn.placed(slim, places), places, 5).drop("tree").collect()
    assert sum(x["n"] for x in trees) == n and sum(x["kept"] for x in trees) <= n - 1500 - 400 + 2 * 6 + 2
    assert len({x["cell"] for x in trees}) == len(trees)
    if pruned:
        counted = knn.count_frauds(queries, rows, own="ordinal").select("id", "searched", "scanned")
        monkeypatch.setattr(knn, "FEW_REFS", n)
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, knn.count_frauds(queries, rows, own="ordinal").select("id", "searched", "scanned").collect()))


def test_bodies_derived_once(spark):
    """What is read of bodies comes from the table they are written to; users' histories are not sorted again for it."""
    plan = catalogue.QUERIES["score_bodies"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan and "to_json" not in plan and "structstojson" not in plan.lower()
