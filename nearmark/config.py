"""Fixed values and parameters of the scoring pipeline."""

from __future__ import annotations

from dataclasses import dataclass, replace

DIM = 14
K = 5
SCALE = 10_000
MAX_BODY_BYTES = 8192
DIMS = [f"d{i}" for i in range(DIM)]
#: Fixed divisors of the normalised features.
MAX_AMOUNT, MAX_INSTALLMENTS, AMOUNT_RATIO, MAX_MINUTES, MAX_KM, MAX_TX_24H, MAX_MERCHANT_AVG = 10_000, 12, 10, 1440, 1000, 20, 10_000
#: Fixed risk of merchant categories; others get the default.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
MCC_DEFAULT = 0.50


#: Fixed texts that turn a switch on; indexes are built with settings in any letter case.
ON = ("1", "true", "TRUE", "yes", "YES")


def switch(text: str, any_case: bool = False) -> bool:
    return text.lower() in ("1", "true", "yes") if any_case else text in ON


@dataclass(frozen=True)
class RiskyFilter:
    """Fixed inclusive bounds, quantized, on dims 0, 1, 2, 7, 8 and 13; dim 2 has a lower bound only."""

    amount: tuple[int, int] = (350, 3200)
    installments: tuple[int, int] = (2000, 6500)
    ratio_min: int = 750
    km_home: tuple[int, int] = (200, 4300)
    tx_24h: tuple[int, int] = (1500, 6000)
    merchant_avg: tuple[int, int] = (0, 450)


#: The narrower filter of prebuilt indexes.
PREBUILT_RISKY = RiskyFilter((400, 3000), (2200, 6200), 850, (250, 4000), (1500, 5800), (0, 420))


@dataclass(frozen=True)
class SearchParams:
    """Search and shortcut parameters, clamped so that K <= early <= min <= max; the defaults are fixed values."""

    min_candidates: int = 36_000
    max_candidates: int = 72_000
    early_candidates: int = 30_000
    flat: bool = False
    profile_fast: bool = False
    legit_min: int = 20
    fraud_min: int = 20
    fraud_amount_min: int = 0
    low_amount: bool = False
    low_amount_km_min: int = 4750
    low_amount_tx_min: int = 4250
    mid_amount_no_last: bool = False
    mid_amount_min: int = 3000
    no_last_only: bool = False
    dominant_fast: bool = False
    dominant_min: int = 15
    dominant_max_opposite: int = 2
    dominant_legit: bool = True
    dominant_fraud: bool = True
    bucket_fast: bool = False
    bucket_legit_min: int = 32
    bucket_fraud_min: int = 32
    bucket_no_last_only: bool = False
    exact_fallback: str = "off"  # off, uncertain, risky, profile_miss
    edge_fallback: bool = False
    kd: bool = False
    max_partitions: int = 256
    native_fallthrough: bool = False

    def __post_init__(self) -> None:
        if self.exact_fallback not in ("off", "uncertain", "risky", "profile_miss"):
            raise ValueError(f"unknown exact_fallback {self.exact_fallback!r}")
        object.__setattr__(self, "max_candidates", max(self.max_candidates, self.min_candidates))
        object.__setattr__(self, "early_candidates", min(max(self.early_candidates, K), self.min_candidates))
        object.__setattr__(self, "max_partitions", min(max(self.max_partitions, 1), 256))

    def without_fast_paths(self) -> SearchParams:
        return replace(self, profile_fast=False, dominant_fast=False, bucket_fast=False)

    @staticmethod
    def from_settings(settings: dict[str, str]) -> SearchParams:
        """From text settings by field name; profile_min_count stands for both profile minima where they are not set."""
        out = {}
        if "profile_min_count" in settings:
            both = settings["profile_min_count"]
            settings = {"legit_min": both, "fraud_min": both, **settings}
        for name, f in SearchParams.__dataclass_fields__.items():
            if name in settings:
                kind = type(f.default)
                out[name] = switch(settings[name]) if kind is bool else kind(settings[name])
        return SearchParams(**out)
