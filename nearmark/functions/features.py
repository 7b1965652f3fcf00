"""The 14 features: payload parsing, derivation and quantization, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AMOUNT_RATIO, DIM, DIMS, MAX_AMOUNT, MAX_INSTALLMENTS, MAX_KM, MAX_MERCHANT_AVG, MAX_MINUTES, MAX_TX_24H, MCC_DEFAULT, MCC_RISK, SCALE
from ..schema import PAYLOAD

#: Leaves that must be there for a payload to count, besides last_transaction's own.
REQUIRED = [
    "transaction.amount", "transaction.installments", "transaction.requested_at", "customer.avg_amount", "customer.tx_count_24h",
    "customer.known_merchants", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home",
]
TEXT_LEAVES = ["$.transaction.requested_at", "$.merchant.id", "$.merchant.mcc"]


def clamp(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def quantize(x: Column) -> Column:
    """Half away from zero at SCALE."""
    return F.round(x * SCALE, 0).cast("int")


def parse_payload(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds p (the payload) and parse_error.

    A body fails if it is no JSON object, lacks a section or leaf (last_transaction may be null but not absent),
    has an empty last_transaction, or a month outside 1 to 12."""
    schema = PAYLOAD + ", _bad string"
    parsed = df.withColumn("p", F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    there = F.array_contains(F.json_object_keys(body), "last_transaction")
    last = F.col("p.last_transaction")
    last_ok = last.isNull() | (F.col("p.last_transaction.timestamp").isNotNull() & F.col("p.last_transaction.km_from_current").isNotNull())
    ok = F.col("p").isNotNull() & F.col("p._bad").isNull() & F.coalesce(there, F.lit(False)) & last_ok
    for leaf in REQUIRED:
        ok = ok & F.col(f"p.{leaf}").isNotNull()
    month = timestamp_part(F.col("p.transaction.requested_at"), 6, 2)
    ok = ok & F.coalesce(~timestamp_ok(F.col("p.transaction.requested_at")) | month.between(1, 12), F.lit(False))
    return parsed.withColumn("parse_error", ~F.coalesce(ok, F.lit(False)))


def timestamp_ok(text: Column) -> Column:
    """16 characters with digits where year, month, day, hour and minute stand; separators are free."""
    return F.regexp_like(text, F.lit(r"^\d{4}.\d\d.\d\d.\d\d.\d\d"))


def timestamp_part(text: Column, at: int, n: int) -> Column:
    return F.try_cast(F.substring(text, at, n), "int") if hasattr(F, "try_cast") else F.substring(text, at, n).try_cast("int")


def civil_days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar; d isn't range-checked."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    of_era = yy - era * 400
    day = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + day - 719468).cast("long")


def minutes_of(text: Column) -> Column:
    """Minutes since 1970 of a valid timestamp text; null for others."""
    days = civil_days(timestamp_part(text, 1, 4), timestamp_part(text, 6, 2), timestamp_part(text, 9, 2))
    return F.when(timestamp_ok(text), days * 1440 + timestamp_part(text, 12, 2) * 60 + timestamp_part(text, 15, 2))


def mcc_risk(mcc: Column) -> Column:
    pairs = [F.lit(x) for pair in MCC_RISK.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), mcc), F.lit(MCC_DEFAULT))


#: 2026-01-01T00:00, which stands in for an unreadable request time.
DEFAULT_MINUTES = 20454 * 1440


def timed(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds name_ok, name_days, name_hour and name_minutes of a timestamp text.

    Each is a column of a step of its own: as one expression, the text would be made again for every use of a part."""
    df = df.withColumn(f"{name}_text", text)
    t = F.col(f"{name}_text")
    parts = {"y": (1, 4), "m": (6, 2), "d": (9, 2), "hour": (12, 2), "minute": (15, 2)}
    df = df.withColumns({f"{name}_ok": timestamp_ok(t), **{f"{name}_{part}": timestamp_part(t, *place) for part, place in parts.items()}})
    c = lambda part: F.col(f"{name}_{part}")
    df = df.withColumn(f"{name}_days", F.when(c("ok"), civil_days(c("y"), c("m"), c("d"))))
    df = df.withColumn(f"{name}_minutes", F.when(c("ok"), c("days") * 1440 + c("hour") * 60 + c("minute")))
    return df.drop(*(f"{name}_{x}" for x in ("text", "y", "m", "d", "minute")))


def vectorize(df: DataFrame, p: str = "p") -> DataFrame:
    """Adds d0 to d13 from the payload column p."""
    f = lambda name: F.col(f"{p}.{name}")
    columns = df.columns
    df = timed(timed(df, f("transaction.requested_at"), "_at"), f("last_transaction.timestamp"), "_last")
    now = F.coalesce("_at_minutes", F.lit(DEFAULT_MINUTES))
    hour = F.when(F.col("_at_ok"), F.col("_at_hour")).otherwise(0)
    # The day of week follows the date alone, also where the hour is out of range.
    date_days = F.coalesce(F.col("_at_days"), F.floor(now / 1440))
    ratio = F.when(f("customer.avg_amount") <= 0, 1.0).otherwise(f("transaction.amount") / f("customer.avg_amount") / AMOUNT_RATIO)
    no_last = f("last_transaction").isNull()
    before = F.coalesce(F.col("_last_minutes"), now)
    known = F.array_contains(f("customer.known_merchants"), f("merchant.id")) & (F.length(f("merchant.id")) > 0)
    flag = lambda c: F.when(c, SCALE).otherwise(0)
    sentinel = lambda c: F.when(no_last, -SCALE).otherwise(c)
    values = [
        quantize(clamp(f("transaction.amount") / MAX_AMOUNT)),
        quantize(clamp(f("transaction.installments") / MAX_INSTALLMENTS)),
        quantize(clamp(ratio)),
        quantize(hour / 23),
        quantize(F.pmod(date_days + 3, F.lit(7)) / 6),
        sentinel(quantize(clamp(F.greatest(now - before, F.lit(0)) / MAX_MINUTES))),
        sentinel(quantize(clamp(f("last_transaction.km_from_current") / MAX_KM))),
        quantize(clamp(f("terminal.km_from_home") / MAX_KM)),
        quantize(clamp(f("customer.tx_count_24h") / MAX_TX_24H)),
        flag(f("terminal.is_online")),
        flag(f("terminal.card_present")),
        flag(~F.coalesce(known, F.lit(False))),
        quantize(mcc_risk(f("merchant.mcc"))),
        quantize(clamp(f("merchant.avg_amount") / MAX_MERCHANT_AVG)),
    ]
    return df.withColumns(dict(zip(DIMS, values, strict=True))).select(*(c for c in columns if c not in DIMS), *DIMS)


def vectorize_fixed(df: DataFrame, p: str = "p") -> DataFrame:
    """d0 to d13 in fixed-point arithmetic: cents first, then half-up integer divisions.

    Numbers that don't fit the fixed-point form take the value in doubles, as their payload would take the other parser."""
    f = lambda name: F.col(f"{p}.{name}")
    scaled = lambda c, k: F.round(c.try_cast("decimal(24,9)") * k, 0).try_cast("long")
    div = lambda a, b: F.floor(a / b)
    bound = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0)), F.lit(SCALE)).cast("int"))
    cents, avg = scaled(f("transaction.amount"), 100), scaled(f("customer.avg_amount"), 100)
    base = vectorize(df, p)
    hour = timestamp_part(f("transaction.requested_at"), 12, 2)
    last = f("last_transaction").isNull()
    minutes = F.greatest(minutes_of(f("transaction.requested_at")) - minutes_of(f("last_transaction.timestamp")), F.lit(0))
    days = F.floor(minutes_of(f("transaction.requested_at")) / 1440)
    fixed = {
        "d0": bound(div(cents + 50, 100)),
        "d1": bound(div(scaled(f("transaction.installments"), 1) * SCALE + 6, 12)),
        "d2": F.when(avg <= 0, SCALE).otherwise(bound(div(cents * 1000 + div(avg, 2), F.greatest(avg, F.lit(1))))),
        "d3": bound(div(hour * SCALE + 11, 23)),
        "d4": bound(div(F.pmod(days + 3, F.lit(7)) * SCALE + 3, 6)),
        "d5": F.when(last, -SCALE).otherwise(bound(div(minutes * SCALE + 720, 1440))),
        "d6": F.when(last, -SCALE).otherwise(bound(scaled(f("last_transaction.km_from_current"), 10))),
        "d7": bound(scaled(f("terminal.km_from_home"), 10)),
        "d8": bound(scaled(f("customer.tx_count_24h"), 1) * 500),
        "d13": bound(div(scaled(f("merchant.avg_amount"), 100) + 50, 100)),
    }
    return base.withColumns({d: F.coalesce(c, F.col(d)) for d, c in fixed.items()})


def quantize_reference(df: DataFrame, vector: str = "vector") -> DataFrame:
    """d0 to d13 of a reference's doubles: -0.9999 and less is the sentinel."""
    def one(i: int) -> Column:
        x = F.get(F.col(vector), F.lit(i))
        return F.when(x <= -0.9999, -SCALE).otherwise(quantize(clamp(x)))

    return df.withColumns({f"d{i}": one(i) for i in range(DIM)})


def vector_key() -> Column:
    """The vector as text: [d0,...,d13]."""
    return F.concat(F.lit("["), F.concat_ws(",", *(F.col(d).cast("string") for d in DIMS)), F.lit("]"))
