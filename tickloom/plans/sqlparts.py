"""Pieces of checking SQL used by several queries."""

from __future__ import annotations

from ..constants import NATIVE_MINT as NATIVE


def quote_dec(trade: str, meta: str = "m") -> str:
    return (
        f"(CASE WHEN {trade} = {meta}.quote_mint THEN {meta}.quote_decimals "
        f"WHEN {trade} = '{NATIVE}' THEN 9 ELSE {meta}.quote_decimals END)"
    )


def scaled(raw: str, dec: str) -> str:
    return f"(CASE WHEN {dec} IS NULL THEN CAST({raw} AS DOUBLE) ELSE CAST({raw} AS DOUBLE) / pow(10.0, {dec}) END)"


def price(q: str, t: str, td: str, qd: str) -> str:
    return (
        f"(CASE WHEN {t} IS NULL OR {t} = 0 THEN NULL "
        f"WHEN {td} IS NOT NULL AND {qd} IS NOT NULL THEN "
        f"(CAST({q} AS DOUBLE) / pow(10.0, {qd})) / (CAST({t} AS DOUBLE) / pow(10.0, {td})) "
        f"ELSE CAST({q} AS DOUBLE) / CAST({t} AS DOUBLE) END)"
    )


def normalized(raw: str, td: str, qd: str) -> str:
    return f"(CASE WHEN {td} IS NULL OR {qd} IS NULL THEN {raw} ELSE {raw} * pow(10.0, {td} - {qd}) END)"
