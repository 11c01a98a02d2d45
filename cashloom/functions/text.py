"""Identifiers in free text, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what identifiers look like, and words that say nothing
UTR = r"\b[A-Z]\d{12,20}\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
INVOICE = r"\bINV[-_\s]?\d{2,6}\b"
#: The same with numbers of any length, as tables of a million invoices and more have them.
LONG_INVOICE = r"\bINV[-_\s]?\d{2,}\b"
NOISE = r"\b(NEFT|IMPS|RTGS|UPI|PAYMENT|SETTLEMENT|CREDIT)\b"


def normalize_ref(ref: Column) -> Column:
    return F.regexp_replace(F.upper(ref), r"[-_\s]", "")


def utrs(text: Column) -> Column:
    """All UTRs in the order they stand; an empty array for null."""
    return F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(UTR), 0)


def ifscs(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(IFSC), 0)


def invoice_refs(text: Column, pattern: str = INVOICE) -> Column:
    found = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)
    return F.transform(found, normalize_ref)


def residual(text: Column, invoice: str = INVOICE) -> Column:
    """What is left without identifiers, noise words and separators."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    tokens = F.concat(utrs(text), ifscs(text))
    rest = F.aggregate(tokens, upper, lambda acc, token: F.replace(acc, token, F.lit(" ")))
    for pattern in (invoice, NOISE, r"[-_/]+", r"\s+"):
        rest = F.regexp_replace(rest, pattern, " ")
    return F.trim(rest)


def is_valid_ifsc(code: Column) -> Column:
    return F.coalesce(F.upper(code).rlike(r"^[A-Z]{4}0[A-Z0-9]{6}$"), F.lit(False))
