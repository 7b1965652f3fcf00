"""Payload bodies in other forms, and the parse that searches for quoted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANTS = ("reordered", "spaced", "padded")


def variant(transactions: DataFrame, name: str) -> DataFrame:
    """event_id and body of rows with the payload p: keys in reverse order, with white space between tokens, or with
    unknown keys in front that make the body longer."""
    options = {"ignoreNullFields": "false"}
    plain = F.to_json("p", options)
    if name == "spaced":
        body = F.to_json("p", {**options, "pretty": "true"})
    elif name == "padded":
        filler = F.to_json(F.struct(F.repeat(F.lit("x"), 300).alias("padding"), F.array(F.lit(1), F.lit(2)).alias("numbers"), F.struct(F.lit("]}").alias("deep")).alias("more")))
        body = F.concat(F.expr("substring(filler, 1, length(filler) - 1)"), F.lit(","), F.substring(plain, 2, 1_000_000_000))
        return transactions.withColumn("filler", filler).select("event_id", body.alias("body"))
    elif name == "reordered":
        inner = lambda section: F.struct(*(F.col(f"p.{section}.{c}").alias(c) for c in reversed(fields[section])))
        fields = {f.name: [x.name for x in f.dataType.fields] for f in transactions.schema["p"].dataType.fields if hasattr(f.dataType, "fields")}
        last = F.when(F.col("p.last_transaction").isNotNull(), inner("last_transaction")).alias("last_transaction")
        sections = [last, *(inner(s).alias(s) for s in ("terminal", "merchant", "customer", "transaction")), F.col("p.id").alias("id")]
        body = F.to_json(F.struct(*sections), options)
    else:
        raise ValueError(f"unknown variant {name!r}")
    return transactions.select("event_id", body.alias("body"))


def search_keys(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds p and parse_error by searching each section's, then each field's quoted key at its first place.

    Needs id as well; a section is what lies between its braces, and last_transaction may be null.  Escaped quotes and
    braces in strings aren't understood: this is the simple parser that others are held against."""
    def section(name: str) -> Column:
        return F.regexp_extract(body, rf'"{name}"\s*:\s*(\{{[^{{}}]*\}}|null)', 1)

    def text(s: Column, key: str) -> Column:
        return F.nullif(F.regexp_extract(s, rf'"{key}"\s*:\s*"([^"]*)"', 1), F.lit(""))

    def number(s: Column, key: str) -> Column:
        return F.regexp_extract(s, rf'"{key}"\s*:\s*(-?[0-9][0-9.eE+-]*)', 1).try_cast("double")

    def flag(s: Column, key: str) -> Column:
        return F.regexp_extract(s, rf'"{key}"\s*:\s*(true|false)', 1).try_cast("boolean")

    t, c, m, x, last = (section(n) for n in ("transaction", "customer", "merchant", "terminal", "last_transaction"))
    known = F.regexp_extract(c, r'"known_merchants"\s*:\s*\[([^\]]*)\]', 1)
    previous = F.struct(text(last, "timestamp").alias("timestamp"), number(last, "km_from_current").alias("km_from_current"))
    p = F.struct(
        text(F.col(body), "id").alias("id"),
        F.struct(number(t, "amount").alias("amount"), number(t, "installments").alias("installments"), text(t, "requested_at").alias("requested_at")).alias("transaction"),
        F.struct(number(c, "avg_amount").alias("avg_amount"), number(c, "tx_count_24h").alias("tx_count_24h"), F.regexp_extract_all(known, F.lit(r'"([^"]*)"'), F.lit(1)).alias("known_merchants")).alias("customer"),
        F.struct(text(m, "id").alias("id"), text(m, "mcc").alias("mcc"), number(m, "avg_amount").alias("avg_amount")).alias("merchant"),
        F.struct(flag(x, "is_online").alias("is_online"), flag(x, "card_present").alias("card_present"), number(x, "km_from_home").alias("km_from_home")).alias("terminal"),
        F.when(last != "null", previous).alias("last_transaction"),
    )
    leaves = ["id", "transaction.amount", "transaction.installments", "transaction.requested_at", "customer.avg_amount", "customer.tx_count_24h", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home"]
    out = df.withColumn("p", p)
    bad = (last == "") | F.col(body).isNull()
    for leaf in leaves:
        bad = bad | F.col(f"p.{leaf}").isNull()
    return out.withColumn("parse_error", F.coalesce(bad, F.lit(True)))
