"""DuckDB SQL for the scoring queries, written over the events and embeddings tables."""

from __future__ import annotations

from .sources.fixtures import PLANTED, PLANTED_EACH, PLANTED_FROM, REST

D = [f"d{i}" for i in range(14)]
DS = ", ".join(D)

TX = r"""
e AS (
  SELECT event_id, user_id, event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents, epoch_us(ts) AS us,
         CAST(regexp_extract(props, '"k":\s*(-?[0-9]+)', 1) AS BIGINT) AS k, (event_id * 13) % 97 AS m
  FROM events),
t AS (
  SELECT *, CAST(20.0 AS DOUBLE) * CAST(sum(cents) OVER (PARTITION BY user_id) AS DOUBLE) / count(*) OVER (PARTITION BY user_id) / 100.0::DOUBLE AS avg_amount,
         CAST(20.0 AS DOUBLE) * CAST(sum(cents) OVER (PARTITION BY m) AS DOUBLE) / count(*) OVER (PARTITION BY m) / 100.0::DOUBLE AS seller_avg,
         count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS tx24,
         row_number() OVER (PARTITION BY user_id, m ORDER BY us, event_id) > 1 AS known,
         lag(us) OVER o AS last_us, lag(k) OVER o AS last_k, cents * 20 / 100.0::DOUBLE AS amount
  FROM e WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)),
"""


def q(x: str) -> str:
    return f"CAST(round({x} * 10000) AS INTEGER)"


def c(x: str) -> str:
    return f"least(greatest(CAST({x} AS DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)"


_MINUTES = "(CAST(floor(us / 60000000.0) AS BIGINT) - CAST(floor(last_us / 60000000.0) AS BIGINT))"
_DAY = "CAST(floor(us / 86400000000.0) AS BIGINT)"
_HOUR = "(CAST(floor(us / 3600000000.0) AS BIGINT) % 24)"
_RISK = "list_extract([0.15,0.30,0.20,0.45,0.80,0.75,0.85,0.35,0.25,0.50,0.50,0.50], CAST(m % 12 AS INTEGER) + 1)"
VALUES = [
    q(c("amount / 10000")), q(c("(((event_id * 7) % 12) + 1) / 12.0::DOUBLE")), q(c("CASE WHEN avg_amount <= 0 THEN 1.0 ELSE amount / avg_amount / 10 END")),
    q(f"{_HOUR} / 23.0::DOUBLE"), q(f"(({_DAY} + 3) % 7) / 6.0::DOUBLE"),
    f"CASE WHEN last_us IS NULL THEN -10000 ELSE {q(c(f'greatest({_MINUTES}, 0) / 1440.0::DOUBLE'))} END",
    f"CASE WHEN last_us IS NULL THEN -10000 ELSE {q(c('abs(k - last_k) * 10 / 1000.0::DOUBLE'))} END",
    q(c("k * 10 / 1000.0::DOUBLE")), q(c("tx24 / 20.0::DOUBLE")),
    "CASE WHEN event_type IN ('click', 'view') THEN 10000 ELSE 0 END", "CASE WHEN event_type = 'purchase' THEN 10000 ELSE 0 END",
    "CASE WHEN known THEN 0 ELSE 10000 END", f"CAST(round({_RISK} * 10000) AS INTEGER)", q(c("seller_avg / 10000")),
]
LABEL = "CAST(k * 7 + CASE WHEN amount > 2000 THEN 300 ELSE 0 END + CASE WHEN event_type = 'error' THEN 250 ELSE 0 END >= 450 AS INTEGER) AS label"


def b(d: str, n: int) -> str:
    return f"(CASE WHEN {d} <= 0 THEN 0 ELSE least({d} * {n} // 10001, {n - 1}) END)"


def on(x: str, at: int) -> str:
    return f"CAST({x} AS INTEGER) * {1 << at}"


BUCKET = f"{b('d0', 8)} + {b('d2', 8)} * 8 + {b('d7', 8)} * 64 + {b('d3', 4)} * 512 + {on('(d5 < 0)', 11)}"
FINE = f"({BUCKET}) * 8 + {on('(d9 > 0)', 0)} + {on('(d10 > 0)', 1)} + {on('(d11 > 0)', 2)}"
PROFILE = (
    f"{b('d2', 16)} + {b('d7', 8)} * 16 + {b('d8', 4)} * 128 + {b('d12', 4)} * 512 + {b('d0', 4)} * 2048 + {on('(d5 < 0)', 13)} + {on('(d9 > 0)', 14)} + "
    f"{on('(d10 > 0)', 15)} + {on('(d11 > 0)', 16)} + {b('d6', 4)} * 131072 + {on('(d1 > 1000)', 19)} + {b('d13', 4)} * 1048576"
)


def kd(profile: int = 0) -> str:
    flags = f"{on('(d5 < 0)', 0)} + {on('(d9 > 0)', 1)} + {on('(d10 > 0)', 2)} + {on('(d11 > 0)', 3)}"
    pair = {2: "d2", 3: "d7", 4: "d3", 5: "d12", 6: "d13"}.get(profile)
    if pair:
        return f"{flags} + {b('d0', 4)} * 16 + {b(pair, 4)} * 64"
    top = {1: "d2", 7: "d7", 8: "d3", 9: "d12", 10: "d13"}.get(profile, "d8")
    return f"{flags} + {b('d0', 8)} * 16 + {on(f'({top} >= 3500)', 7)}"


RISKY = "d0 BETWEEN 350 AND 3200 AND d1 BETWEEN 2000 AND 6500 AND d2 >= 750 AND d7 BETWEEN 200 AND 4300 AND d8 BETWEEN 1500 AND 6000 AND d13 BETWEEN 0 AND 450"
VARY = {"d0": "j % 7 - 3", "d3": "j * 13 % 101", "d7": "j % 11 - 5"}


def planted_rows() -> str:
    def one(k: int, label: int | None, values: dict) -> str:
        dims = ", ".join(f"CAST({ {**REST, **values}[d]} + {VARY.get(d, '0')} AS INTEGER) AS {d}" for d in D)
        return f"SELECT {PLANTED_FROM + k * PLANTED_EACH} + j AS event_id, CAST({'j % 2' if label is None else label} AS INTEGER) AS label, {dims} FROM (SELECT range AS j FROM range({PLANTED_EACH}))"

    return " UNION ALL ".join(one(k, *x) for k, x in enumerate(PLANTED))


VEC = (
    "WITH RECURSIVE " + TX.strip() + " v0 AS (SELECT event_id, " + LABEL + ", " + ", ".join(f"{x} AS {d}" for x, d in zip(VALUES, D, strict=True)) + " FROM t), "
    + f"v AS (SELECT * FROM v0 UNION ALL {planted_rows()})"
)
KEYED = VEC + f""", k AS (SELECT *, CAST({BUCKET} AS INTEGER) AS bucket_key, CAST({FINE} AS INTEGER) AS fine_key, CAST({PROFILE} AS INTEGER) AS profile_key,
 CAST({kd()} AS INTEGER) AS kd_key, {RISKY} AS is_risky FROM v),
r AS (SELECT row_number() OVER (ORDER BY bucket_key, event_id) - 1 AS ref_id, * FROM k),
qs AS (SELECT event_id AS id, * FROM k WHERE event_id % 20 = 0)"""
DIST = "+".join(f"CAST(a.{d} - r.{d} AS BIGINT) * (a.{d} - r.{d})" for d in D)


def near(name: str, queries: str = "qs", refs: str = "r", where: str = "true") -> str:
    """A CTE of the five nearest references by (dist, ref_id)."""
    return f""", {name} AS (SELECT * FROM (SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, r.ref_id) AS rank, r.ref_id, r.label, {DIST} AS dist
 FROM {queries} a, {refs} r WHERE a.id <> r.event_id AND {where}) WHERE rank <= 5)"""


NEAR = KEYED + near("n")
FRAUDS = ", f AS (SELECT qs.*, CAST(coalesce((SELECT sum(n.label) FROM n WHERE n.id = qs.id), 0) AS INTEGER) AS frauds FROM qs)"
SCORED = NEAR + FRAUDS + ", s AS (SELECT *, frauds / 5.0::DOUBLE AS fraud_score, frauds < 3 AS approved, label = 0 AS expected_approved, 'native_kdtree' AS path FROM f)"
LOWER = " + ".join(f"pow(greatest(bx.lo{i} - a.d{i}, 0, a.d{i} - bx.hi{i}), 2)" for i in range(14))
#: Partitions that each query has to search, and the references in them.
COUNTED = (
    ", bx AS (SELECT kd_key, count(*) AS n, " + ", ".join(f"min(d{i}) AS lo{i}, max(d{i}) AS hi{i}" for i in range(14)) + " FROM r GROUP BY kd_key)"
    + near("own", where="r.kd_key = a.kd_key") + ", ub AS (SELECT id, max(dist) FILTER (WHERE rank = 5) AS ub FROM own GROUP BY id)"
    + f", sv AS (SELECT a.id, count(*) FILTER (WHERE bx.kd_key <> a.kd_key) + 1 AS searched, CAST(sum(bx.n) AS BIGINT) AS scanned FROM qs a LEFT JOIN ub ON ub.id = a.id, bx WHERE bx.kd_key = a.kd_key OR ub.ub IS NULL OR {LOWER} <= ub.ub GROUP BY a.id)"
)
KNN_SQL = NEAR + " SELECT id, rank, ref_id, label, dist FROM n"


def ring(key: str, source: str) -> str:
    def gap(at: int, mask: int) -> str:
        return f"abs((({source} >> {at}) & {mask}) - (({key} >> {at}) & {mask}))"

    return f"greatest({gap(0, 7)}, {gap(3, 7)}, {gap(6, 7)}, {gap(9, 3)}, 2 * {gap(11, 1)})"


def order_by(key: str) -> str:
    return ", ".join(f"(({key} >> {at}) & {mask})" for at, mask in ((0, 7), (3, 7), (6, 7), (9, 3), (11, 1)))


def visits(least: int, most: int) -> str:
    """CTEs vis: the buckets each query scans, with early = min = least."""
    return f""", h AS (SELECT bucket_key AS key, count(*) AS n, min(ref_id) AS start FROM r GROUP BY bucket_key),
o AS (SELECT s.bucket_key, h.key, h.n, h.start, row_number() OVER (PARTITION BY s.bucket_key ORDER BY {ring('h.key', 's.bucket_key')}, {order_by('h.key')}) AS turn
 FROM (SELECT DISTINCT bucket_key FROM qs) s, h),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY bucket_key ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o),
vis AS (SELECT qs.id, c.key, c.turn, c.start, least(c.n, {most} - c.ahead) AS take FROM qs JOIN c ON c.bucket_key = qs.bucket_key WHERE c.ahead < {least} AND c.ahead < {most}),
n AS (SELECT * FROM (SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, vis.turn, r.ref_id) AS rank, r.ref_id, r.label, {DIST} AS dist
 FROM qs a JOIN vis ON vis.id = a.id JOIN r ON r.bucket_key = vis.key AND r.ref_id - vis.start < vis.take AND a.id <> r.event_id) WHERE rank <= 5)"""


def boxed(**bounds: tuple) -> str:
    return " AND ".join([f"{d} >= {lo}" for d, (lo, _) in bounds.items() if lo is not None] + [f"{d} <= {hi}" for d, (_, hi) in bounds.items() if hi is not None])


F4 = "(d12 >= 8000 AND d1 >= 5500 AND d6 BETWEEN 1000 AND 1700 AND d7 BETWEEN 300 AND 4200 AND d8 BETWEEN 3800 AND 6000 AND ((d0 BETWEEN 450 AND 600 AND d2 <= 1200) OR (d0 BETWEEN 2500 AND 3100 AND d2 >= 9000)))"
F5 = """(d5 >= 0 AND d13 <= 220 AND CASE WHEN frauds = 0 THEN
 (d9 = 0 AND d10 > 0 AND d12 >= 7500 AND d0 BETWEEN 450 AND 600 AND d2 BETWEEN 1000 AND 1200 AND d7 BETWEEN 400 AND 600 AND d8 BETWEEN 4000 AND 5000) OR
 (d9 > 0 AND d10 = 0 AND d12 <= 2500 AND d0 BETWEEN 2100 AND 2300 AND d2 BETWEEN 4400 AND 4900 AND d7 BETWEEN 700 AND 950 AND d8 BETWEEN 2000 AND 3000) OR
 (d9 > 0 AND d10 = 0 AND d11 > 0 AND d12 BETWEEN 4000 AND 5000 AND d0 BETWEEN 1200 AND 1500 AND d2 BETWEEN 3300 AND 3800 AND d7 BETWEEN 3300 AND 3900 AND d8 BETWEEN 2000 AND 3000)
 ELSE d9 = 0 AND d10 > 0 AND d12 <= 2500 AND d0 BETWEEN 2700 AND 3000 AND d2 >= 9000 AND d7 BETWEEN 3500 AND 4000 AND d8 BETWEEN 2500 AND 3500 END)"""
F3 = f"""(frauds IN (0, 5) AND ((frauds = 0 AND {F4}) OR {F5} OR
 (frauds = 5 AND d5 BETWEEN 600 AND 850 AND d9 = 0 AND d10 = 0 AND d11 = 0 AND d12 <= 2000 AND d0 BETWEEN 1100 AND 1300 AND d2 BETWEEN 4000 AND 4600 AND d7 BETWEEN 550 AND 750 AND d8 BETWEEN 2000 AND 3000 AND d13 BETWEEN 220 AND 320) OR
 (d5 >= 0 AND d10 = 0 AND d0 BETWEEN 450 AND 1100 AND d2 BETWEEN 900 AND 2500 AND d7 BETWEEN 500 AND 2000 AND d8 BETWEEN 2000 AND 4500)))"""
F6 = f"""(d5 >= 0 AND d9 > 0 AND d10 = 0 AND CASE WHEN frauds >= 3 THEN d11 = 0 AND d12 <= 1700 AND d0 BETWEEN 500 AND 900 AND d2 BETWEEN 1000 AND 2200 AND d7 BETWEEN 350 AND 900 AND d8 BETWEEN 1800 AND 3000 ELSE {F4} END)"""
STATS = """, ps AS (SELECT profile_key, least(count(*), 65535) AS n, CAST(least(sum(label), 65535) AS BIGINT) AS frauds, bit_or(CASE WHEN label = 1 THEN 2 ELSE 1 END) AS mask FROM r GROUP BY profile_key),
bs AS (SELECT bucket_key, count(*) AS n, CAST(sum(label) AS BIGINT) AS frauds FROM r GROUP BY bucket_key)"""
SHORT = """, sc AS (SELECT qs.*,
 CASE WHEN ps.mask = 1 THEN CASE WHEN ps.n >= 2 THEN 0 END WHEN ps.mask = 2 THEN CASE WHEN ps.n >= 2 THEN 5 END
      WHEN ps.frauds >= 3 AND ps.n - ps.frauds <= 1 THEN 5 WHEN ps.n - ps.frauds >= 3 AND ps.frauds <= 1 THEN 0 END AS by_profile,
 CASE WHEN bs.frauds = 0 AND bs.n >= 3 THEN 0 WHEN bs.frauds = bs.n AND bs.n >= 3 THEN 5 END AS by_bucket
 FROM qs LEFT JOIN ps USING (profile_key) LEFT JOIN bs USING (bucket_key))"""
