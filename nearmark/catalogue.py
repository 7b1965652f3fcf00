"""All registered queries of the scoring pipeline, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as o
from .config import DIM, DIMS, SearchParams
from .functions import keys
from .functions.features import parse_payload, vectorize, vectorize_fixed
from .operators import ann, evaluate, knn, predicates, shortcuts, stats, wide
from .plans.score import score, score_bodies
from .plans.sweep import sweep
from .sources import fixtures, payloads
from .storage import written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def both(spark: SparkSession, d: str, kd_profile: int = 0) -> tuple[DataFrame, DataFrame]:
    return fixtures.queries(spark, d, kd_profile), fixtures.references(spark, d, kd_profile)


@register("vectorize", o.VEC + f" SELECT event_id, label, {o.DS} FROM v")
def _vectorize(spark, d):
    return fixtures.vectors(spark, d)


@register("json_roundtrip", o.VEC + f" SELECT event_id, false AS parse_error, {o.DS} FROM v0")
def _json_roundtrip(spark, d):
    """Payloads written as JSON, parsed again and vectorized."""
    bodies = fixtures.transactions(spark, d).select("event_id", F.to_json("p", {"ignoreNullFields": "false"}).alias("body"))
    return vectorize(parse_payload(bodies)).select("event_id", "parse_error", *DIMS)



def _cents(x: str, k: int = 100) -> str:
    return f"CAST(floor(CAST({x} AS DECIMAL(24,9)) * {k} + 0.5) AS BIGINT)"


def _bound(x: str) -> str:
    return f"CAST(least(greatest({x}, 0), 10000) AS INTEGER)"


_FIXED = {
    "d0": _bound(f"({_cents('amount')} + 50) // 100"), "d1": _bound("(((event_id * 7) % 12 + 1) * 10000 + 6) // 12"),
    "d2": f"CASE WHEN {_cents('avg_amount')} <= 0 THEN 10000 ELSE {_bound(f'({_cents('amount')} * 1000 + {_cents('avg_amount')} // 2) // greatest({_cents('avg_amount')}, 1)')} END",
    "d3": _bound("((us // 3600000000 % 24) * 10000 + 11) // 23"), "d4": _bound("((us // 86400000000 + 3) % 7 * 10000 + 3) // 6"),
    "d5": f"CASE WHEN last_us IS NULL THEN -10000 ELSE {_bound('(greatest(us // 60000000 - last_us // 60000000, 0) * 10000 + 720) // 1440')} END",
    "d6": f"CASE WHEN last_us IS NULL THEN -10000 ELSE {_bound('abs(k - last_k) * 10 * 10')} END", "d7": _bound("k * 10 * 10"), "d8": _bound("tx24 * 500"),
    "d13": _bound(f"({_cents('seller_avg')} + 50) // 100"),
}


@register("fixed_point_vectorize", o.VEC + ", x AS (SELECT event_id, " + ", ".join(f"{x} AS {d}" for d, x in _FIXED.items()) + " FROM t) SELECT x.*, v0.d9, v0.d10, v0.d11, v0.d12 FROM x JOIN v0 USING (event_id)")
def _fixed(spark, d):
    return vectorize_fixed(fixtures.transactions(spark, d)).select("event_id", *DIMS)


@register("payload_variants", o.VEC + f" SELECT event_id, variant, false AS parse_error, {o.DS} FROM v0, (SELECT unnest(['reordered', 'spaced', 'padded', 'legacy']) AS variant)")
def _payload_variants(spark, d):
    """Payloads with reordered keys, white space, unknown keys and padding parse to the same features, as does the
    search for quoted keys."""
    t = fixtures.transactions(spark, d)
    parsed = [vectorize(parse_payload(payloads.variant(t, name))).select("event_id", F.lit(name).alias("variant"), "parse_error", *DIMS) for name in ("reordered", "spaced", "padded")]
    legacy = vectorize(payloads.search_keys(payloads.variant(t, "spaced"))).select("event_id", F.lit("legacy").alias("variant"), "parse_error", *DIMS)
    return reduce(DataFrame.unionByName, [knn.keep(rows, large=True) for rows in (*parsed, legacy)])


def _key_query(name: str, column: str, expression: str, make) -> None:
    sql = o.VEC + f" SELECT event_id, CAST({expression} AS INTEGER) AS {column} FROM v"
    register(name, sql)(lambda spark, d: fixtures.vectors(spark, d).select("event_id", make().alias(column)))


_key_query("bucket_keys", "bucket_key", o.BUCKET, keys.bucket_key)
_key_query("fine_keys", "fine_key", o.FINE, keys.fine_key)
_key_query("profile_keys", "profile_key", o.PROFILE, keys.profile_key)
for _p in range(11):
    _key_query(f"kd_keys_p{_p}", "kd_key", o.kd(_p), lambda p=_p: keys.kd_key(p))


@register("quantize_refs", o.KEYED + f" SELECT ref_id, label, {o.DS}, bucket_key, kd_key, is_risky FROM r")
def _refs(spark, d):
    """References from vectors of doubles: quantized again, keyed and numbered."""
    from .functions.features import quantize_reference
    from .sources.references import with_keys

    v = fixtures.vectors(spark, d)
    raw = v.select(F.col("event_id").alias("ordinal"), "label", F.array(*(F.col(x) / 10000.0 for x in DIMS)).alias("vector"))
    quantized = written(spark, f"quantized {d}", lambda: quantize_reference(raw).drop("vector"))
    return with_keys(quantized).select("ref_id", "label", *DIMS, "bucket_key", "kd_key", "is_risky")


@register("bucket_hist", o.KEYED + " SELECT bucket_key, count(*) AS n, min(ref_id) AS start FROM r GROUP BY bucket_key")
def _bucket_hist(spark, d):
    return stats.bucket_histogram(fixtures.references(spark, d))


@register("bucket_label_stats", o.KEYED + " SELECT bucket_key, count(*) AS n, CAST(sum(label) AS BIGINT) AS frauds FROM r GROUP BY bucket_key")
def _bucket_label_stats(spark, d):
    return stats.bucket_stats(fixtures.references(spark, d))


@register("profile_stats", o.KEYED + o.STATS + " SELECT * FROM ps")
def _profile_stats(spark, d):
    return stats.profile_stats(fixtures.references(spark, d))


_EMPTY = {0: (0, 7, 8), 2: (3, 7, 8), 7: (6, 7, 8), 3: (9, 3, 4)}


def _centre_sql(i: int) -> str:
    if i in _EMPTY:
        at, mask, n = _EMPTY[i]
        k = f"((b.key >> {at}) & {mask})"
        low = f"CASE WHEN {k} = 0 THEN 0 ELSE ({k} * 10001 + {n - 1}) // {n} END"
        high = f"CASE WHEN {k} = {n - 1} THEN 10000 ELSE (({k} + 1) * 10001 - 1) // {n} END"
        return f"(({low}) + ({high})) // 2"
    if i == 5:
        return "CASE WHEN (b.key >> 11) & 1 = 0 THEN 5000 ELSE -10000 END"
    return "5000" if i in (1, 4, 6, 8, 12, 13) else "0"


CENTRES = (
    ", b AS (SELECT CAST(range AS INTEGER) AS key FROM range(4096)), g AS (SELECT bucket_key, count(*) AS n, "
    + ", ".join(f"CAST(round(CAST(sum(d{i}) AS DOUBLE) / count(*)) AS INTEGER) AS c{i}" for i in range(DIM))
    + " FROM r GROUP BY bucket_key), ce AS (SELECT b.key AS bucket_key, coalesce(g.n, 0) AS n, "
    + ", ".join(f"CAST(coalesce(g.c{i}, {_centre_sql(i)}) AS INTEGER) AS c{i}" for i in range(DIM))
    + " FROM b LEFT JOIN g ON g.bucket_key = b.key)"
)


@register("centroids", o.KEYED + CENTRES + " SELECT * FROM ce")
def _centroids(spark, d):
    return stats.centroids(fixtures.references(spark, d))


@register("kd_partition_boxes", o.KEYED + " SELECT kd_key, count(*) AS n, " + ", ".join(f"min(d{i}) AS lo{i}, max(d{i}) AS hi{i}" for i in range(DIM)) + " FROM r GROUP BY kd_key")
def _boxes(spark, d):
    return stats.partition_boxes(fixtures.references(spark, d))


@register("risky_refs", o.KEYED + " SELECT ref_id, label, fine_key FROM r WHERE is_risky")
def _risky_refs(spark, d):
    return fixtures.references(spark, d).where("is_risky").select("ref_id", "label", "fine_key")


@register("risky_hist", o.KEYED + " SELECT bucket_key, count(*) AS n, count(DISTINCT fine_key) AS fine_keys FROM r WHERE is_risky GROUP BY bucket_key")
def _risky_hist(spark, d):
    return stats.risky_histogram(fixtures.references(spark, d))


_ORDER = f" SELECT s.bucket_key, b.key, {o.ring('b.key', 's.bucket_key')} AS ring, row_number() OVER (PARTITION BY s.bucket_key ORDER BY {o.ring('b.key', 's.bucket_key')}, {o.order_by('b.key')}) - 1 AS rank FROM (SELECT DISTINCT bucket_key FROM qs) s, (SELECT CAST(range AS INTEGER) AS key FROM range(4096)) b"


@register("neighbor_order", o.KEYED + _ORDER)
def _neighbour_order(spark, d):
    return stats.neighbour_order(fixtures.queries(spark, d))


_CDIST = " + ".join(f"CAST(x.c{i} - y.c{i} AS BIGINT) * (x.c{i} - y.c{i})" for i in range(DIM))


@register("ivf_order", o.KEYED + CENTRES + f" SELECT x.bucket_key, y.bucket_key AS key, {_CDIST} AS distance, row_number() OVER (PARTITION BY x.bucket_key ORDER BY {_CDIST}, y.bucket_key) - 1 AS rank FROM ce x, ce y WHERE x.bucket_key IN (SELECT bucket_key FROM qs)")
def _centroid_order(spark, d):
    q, r = both(spark, d)
    return stats.centroid_order(q, stats.centroids(r))


@register("knn_flat_top5", o.KNN_SQL)
def _flat(spark, d):
    return knn.flat(*both(spark, d), own="ordinal")


@register("knn_two_pass", o.KNN_SQL)
def _two_pass(spark, d):
    return knn.two_pass(*both(spark, d), own="ordinal")


@register("knn_kd", o.KNN_SQL)
def _kd(spark, d):
    return knn.kd(*both(spark, d), own="ordinal")


_LB = o.LOWER
_BOXES = ", bx AS (SELECT kd_key, " + ", ".join(f"min(d{i}) AS lo{i}, max(d{i}) AS hi{i}" for i in range(DIM)) + " FROM r GROUP BY kd_key)"
_CAPPED = (
    o.KEYED + _BOXES + o.near("own", where="r.kd_key = a.kd_key")
    + f", ub AS (SELECT id, max(dist) FILTER (WHERE rank = 5) AS ub FROM own GROUP BY id), ca AS (SELECT * FROM (SELECT a.id, bx.kd_key, row_number() OVER (PARTITION BY a.id ORDER BY {_LB}, bx.kd_key) AS turn FROM qs a LEFT JOIN ub ON ub.id = a.id, bx WHERE bx.kd_key <> a.kd_key AND (ub.ub IS NULL OR {_LB} <= ub.ub)) WHERE turn <= 2)"
    + f", n AS (SELECT * FROM (SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY {o.DIST}, r.ref_id) AS rank, r.ref_id, r.label, {o.DIST} AS dist FROM qs a, r WHERE a.id <> r.event_id AND (r.kd_key = a.kd_key OR EXISTS (SELECT 1 FROM ca WHERE ca.id = a.id AND ca.kd_key = r.kd_key))) WHERE rank <= 5)"
)


@register("knn_kd_capped", _CAPPED + " SELECT id, rank, ref_id, label, dist FROM n")
def _kd_capped(spark, d):
    return knn.kd(*both(spark, d), max_partitions=3, own="ordinal")


@register("kd_counters", o.KEYED + o.COUNTED + " SELECT id, searched, scanned FROM sv")
def _kd_counters(spark, d):
    """Partitions that each query has to search, its own included, and the references in them."""
    return knn.count_frauds(*both(spark, d), own="ordinal").select("id", "searched", "scanned")


def _bound_sql(d: str, at: int, n: int) -> str:
    k = f"((b.key >> {at}) & {n - 1})"
    low, high = f"CASE WHEN {k} = 0 THEN 0 ELSE ({k} * 10001 + {n - 1}) // {n} END", f"CASE WHEN {k} = {n - 1} THEN 10000 ELSE (({k} + 1) * 10001 - 1) // {n} END"
    return f"CAST(greatest({low} - a.{d}, 0, a.{d} - ({high})) AS BIGINT) * greatest({low} - a.{d}, 0, a.{d} - ({high}))"


_LAST = "CASE WHEN (b.key >> 11) & 1 = 1 THEN CAST(a.d5 + 10000 AS BIGINT) * (a.d5 + 10000) ELSE CAST(greatest(-a.d5, 0, a.d5 - 10000) AS BIGINT) * greatest(-a.d5, 0, a.d5 - 10000) END"


@register("bucket_bounds", o.KEYED + ", b AS (SELECT DISTINCT bucket_key AS key FROM r) SELECT a.id, b.key, " + " + ".join([_bound_sql("d0", 0, 8), _bound_sql("d2", 3, 8), _bound_sql("d7", 6, 8), _bound_sql("d3", 9, 4), _LAST]) + " AS bound FROM qs a, b")
def _bucket_bounds(spark, d):
    """The distance below which no reference of a filled bucket (4096 at most) can lie."""
    q, r = both(spark, d)
    filled = r.select(F.col("bucket_key").alias("key")).distinct()
    return q.drop("bucket_key").crossJoin(F.broadcast(filled)).select("id", "key", knn.bucket_bound(F.col("key")).alias("bound"))


#: The default limits: 30,000, 36,000 and 72,000 candidates.
ANN = SearchParams(early_candidates=36_000)


@register("ann_prefix", o.KEYED + o.visits(36_000, 72_000) + " SELECT id, rank, ref_id, label, dist FROM n")
def _ann_prefix(spark, d):
    """Early = min: the buckets that a query visits follow from their sizes alone."""
    return ann.search(*both(spark, d), ANN, own="ordinal").select(*knn.RESULT)


@register("ann_general", o.KEYED + o.visits(36_000, 72_000) + " SELECT id, rank, ref_id, label, dist FROM n")
def _ann_general(spark, d):
    """The same by joins, the way for references that are too many to send."""
    return ann.search_by_joins(*both(spark, d), ANN, own="ordinal").select(*knn.RESULT)


@register("ann_early_stop")
def _ann_early(spark, d):
    return ann.search(*both(spark, d), SearchParams(), own="ordinal")


_UNCERTAIN = ", af AS (SELECT id, CAST(sum(label) AS INTEGER) AS frauds FROM n GROUP BY id), fx AS (SELECT * FROM qs WHERE id IN (SELECT id FROM af WHERE frauds BETWEEN 1 AND 4))"


@register("ann_exact_fallback", o.KEYED + o.visits(36_000, 72_000) + _UNCERTAIN + o.near("ex", "fx") + " SELECT id, rank, ref_id, label, dist FROM n WHERE id NOT IN (SELECT id FROM fx) UNION ALL SELECT id, rank, ref_id, label, dist FROM ex")
def _ann_exact(spark, d):
    return ann.with_fallback(*both(spark, d), SearchParams(early_candidates=36_000, exact_fallback="uncertain"), own="ordinal").select(*knn.RESULT)


@register("risky_knn", o.KEYED + ", rr AS (SELECT * FROM r WHERE is_risky OR (SELECT count(*) FROM r WHERE is_risky) < 5)" + o.near("n", refs="rr") + o.FRAUDS + f", fl AS (SELECT * FROM f WHERE {o.F6})" + o.near("ex", "fl")
          + " SELECT id, rank, ref_id, label, dist FROM n WHERE id NOT IN (SELECT id FROM fl) UNION ALL SELECT id, rank, ref_id, label, dist FROM ex")
def _risky_knn(spark, d):
    return ann.risky_search(*both(spark, d), own="ordinal")


@register("score", o.SCORED + " SELECT id, frauds, fraud_score, approved FROM s")
def _score(spark, d):
    return score(*both(spark, d), own="ordinal").select("id", "frauds", "fraud_score", "approved")


#: Bodies of these ids are cut off, so that they don't parse.
BROKEN = "id % 140 = 0"


def _bodies(spark, d) -> DataFrame:
    t = fixtures.transactions(spark, d).where("event_id % 20 = 0").select(F.col("event_id").alias("id"), F.to_json("p", {"ignoreNullFields": "false"}).alias("body"), "label")
    return t.withColumn("body", F.when(F.expr(BROKEN), F.substring("body", 1, 60)).otherwise(F.col("body")))


def _scored_bodies(spark, d) -> DataFrame:
    # Written, as bodies are read for what parses, for what doesn't and for the truth.
    rows = knn.keep(_bodies(spark, d), large=True)
    found = score_bodies(rows.select("id", "body"), fixtures.references(spark, d), limit_bytes=False, own="ordinal")
    return found.join(rows.select("id", (F.col("label") == 0).alias("expected_approved")), "id")


_BODIES_SQL = o.SCORED + f", sb AS (SELECT id, CASE WHEN {BROKEN} THEN 0 ELSE frauds END AS frauds, CASE WHEN {BROKEN} THEN 0.0::DOUBLE ELSE fraud_score END AS fraud_score, approved OR {BROKEN} AS approved, {BROKEN} AS parse_error, expected_approved FROM s WHERE id < 1000000000)"


@register("score_bodies", _BODIES_SQL + " SELECT id, frauds, fraud_score, approved, parse_error FROM sb")
def _score_bodies(spark, d):
    """From JSON bodies to decisions; bodies that don't parse are approved, as a body beyond the length limit would be."""
    return _scored_bodies(spark, d).select("id", "frauds", "fraud_score", "approved", "parse_error")


FAST = SearchParams(kd=True, profile_fast=True, dominant_fast=True, bucket_fast=True, legit_min=2, fraud_min=2, dominant_min=3, dominant_max_opposite=1, bucket_legit_min=3, bucket_fraud_min=3)


def _marked(spark, d, p: SearchParams = FAST) -> DataFrame:
    q, r = both(spark, d)
    return shortcuts.shortcut(q, stats.profile_stats(r), stats.bucket_stats(r), p)


@register("shortcut_profile", o.KEYED + o.STATS + " SELECT qs.id, CASE WHEN ps.mask = 1 AND ps.n >= 2 THEN 0 WHEN ps.mask = 2 AND ps.n >= 2 AND (qs.d0 >= 300 OR qs.d5 < 0 AND qs.d0 >= 200 OR qs.d7 >= 4750 AND qs.d8 >= 4250 OR qs.d7 >= 5500 OR qs.d8 >= 6250) THEN 5 END AS by_profile FROM qs LEFT JOIN ps USING (profile_key)")
def _shortcut_profile(spark, d):
    p = SearchParams(profile_fast=True, legit_min=2, fraud_min=2, fraud_amount_min=300, low_amount=True, mid_amount_no_last=True, mid_amount_min=200)
    return _marked(spark, d, p).select("id", "by_profile")


@register("shortcut_dominant", o.KEYED + o.STATS + " SELECT qs.id, CASE WHEN ps.frauds >= 3 AND ps.n - ps.frauds <= 1 THEN 5 WHEN ps.n - ps.frauds >= 3 AND ps.frauds <= 1 THEN 0 END AS by_profile FROM qs LEFT JOIN ps USING (profile_key)")
def _shortcut_dominant(spark, d):
    return _marked(spark, d, SearchParams(dominant_fast=True, dominant_min=3, dominant_max_opposite=1)).select("id", "by_profile")


@register("shortcut_bucket", o.KEYED + o.STATS + o.SHORT + " SELECT id, by_bucket FROM sc")
def _shortcut_bucket(spark, d):
    return _marked(spark, d).select("id", "by_bucket")


_FAST_SQL = (
    o.NEAR + o.FRAUDS + o.STATS + o.SHORT
    + ", w AS (SELECT f.id, f.frauds AS safe, CAST(coalesce(sc.by_profile, sc.by_bucket, f.frauds) AS INTEGER) AS frauds, CASE WHEN sc.by_profile IS NOT NULL THEN 'profile_fast_path' WHEN sc.by_bucket IS NOT NULL THEN 'bucket_fast_path' ELSE 'native_kdtree' END AS path FROM f JOIN sc ON sc.id = f.id)"
)


@register("score_with_shortcuts", _FAST_SQL + " SELECT id, frauds, path, frauds / 5.0::DOUBLE AS fraud_score, frauds < 3 AS approved FROM w")
def _score_fast(spark, d):
    return score(*both(spark, d), FAST, own="ordinal").drop("searched", "scanned")


@register("canary_diff", _FAST_SQL + " SELECT id, frauds AS fast_frauds, safe AS safe_frauds FROM w WHERE frauds <> safe")
def _canary(spark, d):
    q, r = both(spark, d)
    return evaluate.compare(score(q, r, FAST, "ordinal"), score(q, r, FAST.without_fast_paths(), "ordinal"))


@register("canary_sample", o.KEYED + " , p AS (SELECT id, row_number() OVER (ORDER BY id) AS position FROM qs) SELECT id FROM p WHERE position <= 10 OR position % 7 = 0")
def _canary_sample(spark, d):
    q = stats.positions(fixtures.queries(spark, d).select("id"), "id")
    return q.where(predicates.canary_sample(F.col("position"), 10, 7)).select("id")


@register("fallback_flags", o.NEAR + o.FRAUDS + f" SELECT id, {o.F4} AS high_risk_online, {o.F5} AS profile_tiebreak, {o.F3} AS strong_risk, {o.F6} AS full_tiebreak, frauds BETWEEN 1 AND 4 OR {o.F3} AS needs_exact, frauds IN (0, 5) AS strong, frauds <= 1 OR frauds >= 4 AS strong_edges, is_risky FROM f")
def _flags(spark, d):
    q, r = both(spark, d)
    f = q.join(knn.count_frauds(q, r, pruned=False, own="ordinal").select("id", "frauds"), "id")
    n, p = F.col("frauds"), SearchParams(exact_fallback="risky")
    return f.select(
        "id", predicates.high_risk_online().alias("high_risk_online"), predicates.strong_profile_tiebreak(n).alias("profile_tiebreak"), predicates.strong_fallback_risk(n).alias("strong_risk"),
        predicates.needs_full_tiebreak(n).alias("full_tiebreak"), predicates.needs_exact(n, p).alias("needs_exact"), predicates.strong_decision(n).alias("strong"),
        predicates.strong_decision(n, True).alias("strong_edges"), predicates.risky().alias("is_risky"),
    )


def evaluated(spark, d, p: SearchParams = SearchParams(kd=True)) -> DataFrame:
    q, r = both(spark, d)
    truth = q.withColumn("expected_approved", F.col("label") == 0).drop("label")
    return score(q, r, p, "ordinal").join(truth, "id")


_CONFUSION = "SELECT count(*) AS total, count(*) FILTER (WHERE approved = expected_approved) AS correct, count(*) FILTER (WHERE expected_approved AND NOT approved) AS fp, count(*) FILTER (WHERE NOT expected_approved AND approved) AS fn, 0::BIGINT AS parse_errors FROM s"


@register("confusion", o.SCORED + f", c AS ({_CONFUSION}) SELECT *, fp + 3 * fn AS weighted_errors, (fp + fn + parse_errors) / CAST(total AS DOUBLE) AS failure_rate, (fp + 3 * fn) / CAST(total AS DOUBLE) AS epsilon, correct / CAST(total AS DOUBLE) AS accuracy FROM c")
def _confusion(spark, d):
    return evaluate.confusion(evaluated(spark, d))


@register("detection_score", o.SCORED + f", c AS ({_CONFUSION}), x AS (SELECT fp + 3 * fn AS w, (fp + fn) / CAST(total AS DOUBLE) AS failure, (fp + 3 * fn) / CAST(total AS DOUBLE) AS eps FROM c) SELECT round(CASE WHEN failure > 0.15 THEN -3000.0 ELSE 1000 * log10(1 / greatest(eps, 0.001::DOUBLE)) - 300 * log10(1 + w) END, 6)::DOUBLE AS score FROM x")
def _detection(spark, d):
    return evaluate.confusion(evaluated(spark, d)).select(evaluate.detection_score(F.col("weighted_errors"), F.col("failure_rate"), F.col("epsilon")).alias("score"))


@register("fraud_histogram", o.SCORED + " SELECT CAST(g.range AS INTEGER) AS frauds, count(s.id) AS n FROM range(6) g LEFT JOIN s ON s.frauds = g.range GROUP BY g.range")
def _histogram(spark, d):
    return evaluate.fraud_histogram(evaluated(spark, d))


@register("confusion_bodies", _BODIES_SQL + f", c AS ({_CONFUSION.replace('0::BIGINT', 'count(*) FILTER (WHERE parse_error)').replace('FROM s', 'FROM sb')}) SELECT *, fp + 3 * fn AS weighted_errors, (fp + fn + parse_errors) / CAST(total AS DOUBLE) AS failure_rate, (fp + 3 * fn) / CAST(total AS DOUBLE) AS epsilon, correct / CAST(total AS DOUBLE) AS accuracy FROM c")
def _confusion_bodies(spark, d):
    """With bodies that don't parse: they are approved, counted as errors of their own, and as right or wrong besides."""
    return evaluate.confusion(_scored_bodies(spark, d))


def _rank_sql(p: str) -> str:
    return f"max(scanned) FILTER (WHERE pos = CAST(round_even((m - 1) * {p}::DOUBLE, 0) AS BIGINT))"


_PATHS = (
    _FAST_SQL + o.COUNTED
    + ", y AS (SELECT w.path, w.frauds, (w.frauds < 3) <> (qs.label = 0) AS wrong, CASE WHEN w.path = 'native_kdtree' THEN sv.searched ELSE 0 END AS searched, CASE WHEN w.path = 'native_kdtree' THEN sv.scanned ELSE 0 END AS scanned FROM w JOIN qs ON qs.id = w.id JOIN sv ON sv.id = w.id)"
    + ", z AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned) - 1 AS pos, count(*) OVER (PARTITION BY path) AS m FROM y)"
    + " SELECT path, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM y) AS pct, CAST(sum(frauds) AS BIGINT) AS frauds, count(*) FILTER (WHERE wrong) AS errors, avg(searched) AS avg_searched, avg(scanned) AS avg_scanned, "
    + ", ".join(f"{_rank_sql(p)} AS {n}_scanned" for p, n in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99"))) + " FROM z GROUP BY path"
)


@register("path_stats", _PATHS)
def _path_stats(spark, d):
    return evaluate.path_stats(evaluated(spark, d, FAST))


@register("parameter_sweep")
def _sweep(spark, d):
    """Two partition profiles by one, four or all partitions."""
    def inputs(profile: int):
        q, r = both(spark, d, profile)
        return q.withColumn("expected_approved", F.col("label") == 0), r

    return sweep(inputs, (0, 2), (1, 4, 256), "ordinal").select("profile", "max_partitions", "total", "fp", "fn", "accuracy", "score_det", "avg_searched", "avg_scanned")


_VECTOR = "'[' || concat_ws(',', " + ", ".join(o.D) + ") || ']'"


@register("error_groups_top20", o.SCORED + f", g AS (SELECT profile_key, frauds, bucket_key, path, {_VECTOR} AS vector, count(*) FILTER (WHERE expected_approved) AS fp, count(*) FILTER (WHERE NOT expected_approved) AS fn FROM s WHERE approved <> expected_approved GROUP BY ALL) SELECT *, fp + fn AS total FROM g ORDER BY total DESC, fn DESC, fp DESC, profile_key, vector LIMIT 20")
def _error_groups(spark, d):
    return evaluate.top_error_groups(evaluated(spark, d))


@register("nearest_rank", o.VEC + ", x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS p99 FROM x WHERE pos = CAST(round_even((n - 1) * 0.99::DOUBLE, 0) AS BIGINT)")
def _nearest_rank(spark, d):
    return evaluate.nearest_rank(spark.read.parquet(f"{d}/events.parquet").select("event_type", "value"), "value", 0.99, "event_type")


_EMB = "list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT))"


@register("embedding_knn", f"WITH e AS (SELECT vec_id, label, {_EMB} AS v FROM embeddings), p AS (SELECT a.vec_id AS id, b.vec_id AS ref_id, b.label, CAST(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS BIGINT) AS dist FROM e a, e b WHERE a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY dist, ref_id) AS rank, ref_id, label, dist FROM p) WHERE rank <= 5")
def _embedding_knn(spark, d):
    """Five nearest of every vector whose id is divisible by 20, against all others."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 10000, 0).cast("long"))
    rows = e.where("vec_id is not null").select("vec_id", "label", v.alias("v"))
    return wide.nearest(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "v"), rows.select(F.col("vec_id").alias("ref_id"), "label", "v"))
