"""Transactions, references and queries derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DIMS, MCC_RISK
from ..functions.features import vectorize
from ..storage import written
from .references import with_keys

MCCS = [*MCC_RISK, "0000", "9999"]
DAY_US = 86_400_000_000
#: Fixed: merchants of the fixture, and how many of them a long holds as bits.
SELLERS, BITS = 97, 60


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with what came before them: of their user (avg, tx24, last_ts, last_k, and merchants as bits) and seller.

    Written once a session, as features and each form of bodies are made of them and all users are sorted for it."""
    return written(spark, f"histories {sf_dir}", lambda: _histories(spark, sf_dir))


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(
        "event_id", "user_id", "event_type", "ts", F.floor(F.col("value") * 100 + 0.5).alias("cents"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), F.pmod(F.col("event_id") * 13, F.lit(SELLERS)).alias("m"),
    )
    user = Window.partitionBy("user_id")
    order = user.orderBy("us", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    average = lambda total, n: F.lit(20.0) * total / n / 100.0
    # SELLERS rows, and one for nulls.
    bit = lambda at: F.when(F.col("m").between(at, at + BITS - 1), F.expr(f"shiftleft(1L, cast(m - {at} as int))"))
    sellers = e.groupBy(F.col("m").alias("seller")).agg(average(F.sum("cents"), F.count("*")).alias("seller_avg"))
    return (
        e.withColumn("avg", average(F.sum("cents").over(user), F.count("*").over(user)))
        .withColumn("tx24", F.count("*").over(user.orderBy("us").rangeBetween(-DAY_US, -1)))
        .withColumn("met_low", F.coalesce(F.bit_or(bit(0)).over(before), F.lit(0).cast("long")))
        .withColumn("met_high", F.coalesce(F.bit_or(bit(BITS)).over(before), F.lit(0).cast("long")))
        .withColumn("last_ts", F.lag("ts").over(order))
        .withColumn("last_k", F.lag("k").over(order))
        .join(F.broadcast(sellers), F.col("m").eqNullSafe(F.col("seller")))
        .drop("user_id", "us", "seller")
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, payload p and label (1 = fraud) for each event."""
    e = histories(spark, sf_dir)
    name = lambda m: F.concat(F.lit("MERC-"), F.lpad(m.cast("string"), 3, "0"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    names = F.array(*(F.lit(f"MERC-{m:03d}") for m in range(SELLERS)))
    met = lambda m: F.when(m < BITS, F.getbit("met_low", m)).otherwise(F.getbit("met_high", F.greatest(m - BITS, F.lit(0)))) == 1
    # In order of names, as the remainders are; no array is made where only its members are asked for.
    earlier = F.filter(names, lambda x, i: met(i))
    amount = F.col("cents") * 20 / 100.0
    last = F.when(F.col("last_ts").isNotNull(), F.struct(stamp(F.col("last_ts")).alias("timestamp"), (F.abs(F.col("k") - F.col("last_k")) * 10).cast("double").alias("km_from_current")))
    p = F.struct(
        F.concat(F.lit("tx-"), F.col("event_id").cast("string")).alias("id"),
        F.struct(amount.alias("amount"), (F.pmod(F.col("event_id") * 7, F.lit(12)) + 1).cast("double").alias("installments"), stamp(F.col("ts")).alias("requested_at")).alias("transaction"),
        F.struct(F.col("avg").alias("avg_amount"), F.col("tx24").cast("double").alias("tx_count_24h"), earlier.alias("known_merchants")).alias("customer"),
        F.struct(name(F.col("m")).alias("id"), F.element_at(F.array(*map(F.lit, MCCS)), F.pmod(F.col("m"), F.lit(12)).cast("int") + 1).alias("mcc"), F.col("seller_avg").alias("avg_amount")).alias("merchant"),
        F.struct(F.col("event_type").isin("click", "view").alias("is_online"), (F.col("event_type") == "purchase").alias("card_present"), (F.col("k") * 10).cast("double").alias("km_from_home")).alias("terminal"),
        last.alias("last_transaction"),
    )
    weight = F.col("k") * 7 + F.when(amount > 2000, 300).otherwise(0) + F.when(F.col("event_type") == "error", 250).otherwise(0)
    return e.select("event_id", p.alias("p"), (weight >= 450).cast("int").alias("label"))


#: Planted rows, PLANTED_EACH for each: label (None: alternating) and quantized features; the others have REST.  They lie
#: inside the bounds that few transactions meet: the risky filter, then each fallback and tie-break rule.
PLANTED_EACH, PLANTED_FROM = 100, 1_000_000_000
REST = dict(d0=1000, d1=5000, d2=2000, d3=5000, d4=3333, d5=100, d6=500, d7=1000, d8=3000, d9=0, d10=0, d11=0, d12=5000, d13=1000)
PLANTED = [
    (None, dict(d0=1000, d1=4000, d2=2000, d7=1000, d8=3000, d13=200)),
    (0, dict(d0=500, d1=6000, d2=1000, d6=1300, d7=1000, d8=4500, d12=8500)),
    (0, dict(d0=2800, d1=6000, d2=9500, d6=1300, d7=1000, d8=4500, d12=8500)),
    (0, dict(d0=500, d2=1100, d7=500, d8=4500, d10=10000, d12=8000, d13=100)),
    (0, dict(d0=2200, d2=4600, d7=800, d8=2500, d9=10000, d12=2000, d13=100)),
    (0, dict(d0=1300, d2=3500, d7=3600, d8=2500, d9=10000, d11=10000, d12=4500, d13=100)),
    (1, dict(d0=2800, d2=9500, d7=3700, d8=3000, d10=10000, d12=2000, d13=100)),
    (1, dict(d0=1200, d2=4300, d5=700, d7=650, d8=2500, d12=1500, d13=270)),
    (0, dict(d0=700, d2=1500, d7=1000, d8=3000)),
    (1, dict(d0=700, d2=1500, d7=600, d8=2500, d9=10000, d12=1500)),
    (0, dict(d0=500, d1=6000, d2=1000, d6=1300, d7=1000, d8=4500, d9=10000, d12=8500)),
]


def planted(spark: SparkSession) -> DataFrame:
    """event_id, label, d0..d13 of the planted rows; d0, d3 and d7 vary a little."""
    j, box = F.pmod("id", F.lit(PLANTED_EACH)), F.floor(F.col("id") / PLANTED_EACH).cast("int")
    pick = lambda values: F.element_at(F.array(*(F.lit(v).cast("int") for v in values)), box + 1)
    vary = {"d0": F.pmod(j, F.lit(7)) - 3, "d3": F.pmod(j * 13, F.lit(101)), "d7": F.pmod(j, F.lit(11)) - 5}
    label = F.coalesce(pick([y for y, _ in PLANTED]), F.pmod(j, F.lit(2)).cast("int"))
    values = [(pick([{**REST, **v}[d] for _, v in PLANTED]) + vary.get(d, F.lit(0))).cast("int").alias(d) for d in DIMS]
    return spark.range(len(PLANTED) * PLANTED_EACH).select((F.col("id") + PLANTED_FROM).alias("event_id"), label.alias("label"), *values)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label, d0..d13: the feature table and the planted rows, written once a session."""
    made = lambda: vectorize(transactions(spark, sf_dir)).select("event_id", "label", *DIMS).unionByName(planted(spark))
    return written(spark, f"vectors {sf_dir}", made, large=True)


def references(spark: SparkSession, sf_dir: str, kd_profile: int = 0) -> DataFrame:
    """The keyed and numbered reference table of all rows, written once a session like the index it stands for.

    ordinal is the event_id, so that a query can leave out its own row."""
    def build() -> DataFrame:
        return with_keys(vectors(spark, sf_dir).withColumnRenamed("event_id", "ordinal"), kd_profile)

    return written(spark, f"references {kd_profile} {sf_dir}", build)


def queries(spark: SparkSession, sf_dir: str, kd_profile: int = 0) -> DataFrame:
    """id, d0..d13 and keys of every row whose id is divisible by 20; label is the truth."""
    from ..functions import keys

    rows = vectors(spark, sf_dir).where("event_id % 20 = 0").withColumnRenamed("event_id", "id")
    return rows.withColumns({"bucket_key": keys.bucket_key(), "fine_key": keys.fine_key(), "profile_key": keys.profile_key(), "kd_key": keys.kd_key(kd_profile)})
