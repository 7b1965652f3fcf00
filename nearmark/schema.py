"""Schemas of payloads, references and evaluation entries."""

from __future__ import annotations

PAYLOAD = (
    "id string, transaction struct<amount: double, installments: double, requested_at: string>, "
    "customer struct<avg_amount: double, tx_count_24h: double, known_merchants: array<string>>, "
    "merchant struct<id: string, mcc: string, avg_amount: double>, "
    "terminal struct<is_online: boolean, card_present: boolean, km_from_home: double>, "
    "last_transaction struct<timestamp: string, km_from_current: double>"
)
REFERENCE = "vector array<double>, label string"
EVALUATION = f"entries array<struct<request: struct<{PAYLOAD.replace(' struct', ': struct').replace('id string', 'id: string', 1)}>, expected_approved: boolean>>"
