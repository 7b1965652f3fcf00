"""Predicates on quantized queries; the boxes' bounds are fixed values, all inclusive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PREBUILT_RISKY, K, RiskyFilter, SearchParams

ANY = (None, None)


def box(**bounds: tuple[int | None, int | None]) -> Column:
    """All of the dims within their bounds; None is open."""
    tests = []
    for dim, (low, high) in bounds.items():
        if low is not None:
            tests.append(F.col(dim) >= low)
        if high is not None:
            tests.append(F.col(dim) <= high)
    return reduce(lambda a, b: a & b, tests)


ON, OFF = (1, None), (0, 0)


def risky(f: RiskyFilter = RiskyFilter()) -> Column:
    return box(d0=f.amount, d1=f.installments, d2=(f.ratio_min, None), d7=f.km_home, d8=f.tx_24h, d13=f.merchant_avg)


def risky_prebuilt() -> Column:
    return risky(PREBUILT_RISKY)


def high_risk_online() -> Column:
    common = box(d12=(8000, None), d1=(5500, None), d6=(1000, 1700), d7=(300, 4200), d8=(3800, 6000))
    return common & (box(d0=(450, 600), d2=(None, 1200)) | box(d0=(2500, 3100), d2=(9000, None)))


def strong_profile_tiebreak(frauds: Column) -> Column:
    none = (
        box(d9=OFF, d10=ON, d12=(7500, None), d0=(450, 600), d2=(1000, 1200), d7=(400, 600), d8=(4000, 5000))
        | box(d9=ON, d10=OFF, d12=(None, 2500), d0=(2100, 2300), d2=(4400, 4900), d7=(700, 950), d8=(2000, 3000))
        | box(d9=ON, d10=OFF, d11=ON, d12=(4000, 5000), d0=(1200, 1500), d2=(3300, 3800), d7=(3300, 3900), d8=(2000, 3000))
    )
    some = box(d9=OFF, d10=ON, d12=(None, 2500), d0=(2700, 3000), d2=(9000, None), d7=(3500, 4000), d8=(2500, 3500))
    return box(d5=(0, None), d13=(None, 220)) & F.when(frauds == 0, none).otherwise(some)


def strong_fallback_risk(frauds: Column) -> Column:
    all_five = box(d5=(600, 850), d9=OFF, d10=OFF, d11=OFF, d12=(None, 2000), d0=(1100, 1300), d2=(4000, 4600), d7=(550, 750), d8=(2000, 3000), d13=(220, 320))
    known = box(d5=(0, None), d10=OFF, d0=(450, 1100), d2=(900, 2500), d7=(500, 2000), d8=(2000, 4500))
    hit = ((frauds == 0) & high_risk_online()) | strong_profile_tiebreak(frauds) | ((frauds == K) & all_five) | known
    return frauds.isin(0, K) & hit


def needs_exact(frauds: Column, p: SearchParams) -> Column:
    mixed = (frauds > 0) & (frauds < K)
    return F.when(mixed, F.lit(p.exact_fallback in ("uncertain", "risky"))).otherwise(F.lit(p.exact_fallback == "risky") & strong_fallback_risk(frauds))


def needs_full_tiebreak(frauds: Column) -> Column:
    many = box(d11=OFF, d12=(None, 1700), d0=(500, 900), d2=(1000, 2200), d7=(350, 900), d8=(1800, 3000))
    return box(d5=(0, None), d9=ON, d10=OFF) & F.when(frauds >= 3, many).otherwise(high_risk_online())


def strong_decision(frauds: Column, edges: bool = False) -> Column:
    return (frauds <= 1) | (frauds >= K - 1) if edges else frauds.isin(0, K)


def fraud_amount_allowed(p: SearchParams) -> Column:
    out = F.col("d0") >= p.fraud_amount_min
    if p.mid_amount_no_last:
        out = out | ((F.col("d0") >= p.mid_amount_min) & (F.col("d5") < 0))
    if p.low_amount:
        out = out | ((F.col("d7") >= p.low_amount_km_min) & (F.col("d8") >= p.low_amount_tx_min)) | (F.col("d7") >= 5500) | (F.col("d8") >= 6250)
    return out


def canary_sample(position: Column, first: int, every: int) -> Column:
    """The first rows, and every so many after."""
    return (position <= first) | (F.lit(every > 0) & (F.pmod(position, F.lit(max(every, 1))) == 0))
