"""Small lookup tables. They must be these for right results."""

from __future__ import annotations

import datetime as dt

# fixed values: units of INR for one unit of a currency
FX_TO_INR = {"USD": 87.42, "EUR": 94.15, "GBP": 110.63, "SGD": 64.88, "AED": 23.8}
# fixed values: holidays that fall on one date each year, of 2026
HOLIDAYS = (dt.date(2026, 1, 26), dt.date(2026, 8, 15), dt.date(2026, 10, 2))
# fixed values: branch codes with bank, branch and city
BRANCHES = {
    "HDFC0000001": ("HDFC Bank", "Branch 0001 (fixture)", "Mumbai"),
    "ICIC0000123": ("ICICI Bank", "Branch 0123 (fixture)", "Bengaluru"),
    "SBIN0001234": ("State Bank of India", "Branch 1234 (fixture)", "Delhi"),
    "UTIB0000456": ("Axis Bank", "Branch 0456 (fixture)", "Pune"),
    "KKBK0000789": ("Kotak Mahindra Bank", "Branch 0789 (fixture)", "Chennai"),
    "YESB0000321": ("Yes Bank", "Branch 0321 (fixture)", "Hyderabad"),
}
# fixed values: what a controller reads where an exception has no summary of its own
GENERIC_COPY = {
    "orphan": "This doesn't tie back to anything on the other side — likely still outstanding.",
    "low_confidence": "The closest candidate falls short of our auto-approval bar — worth a second look.",
    "ambiguous_multiple_candidates": "More than one candidate is equally plausible — needs a human to pick between them.",
    "fee_math_break": "The settlement math doesn't add up — worth flagging to the payment processor.",
    "fx_unresolved": "Couldn't be compared in INR — a currency conversion is missing.",
    "duplicate_suspected": "Looks like a repeat of an invoice that is already settled.",
    "invalid_bank_details": "The bank details on file don't look right — worth confirming before paying out.",
}
# fixed values: kinds of discrepancy, in the order of reports
CLASSES = (
    "clean", "timing_drift", "holiday_delayed", "fx_settlement", "split_settlement", "partial_refund", "duplicate_entry",
    "typo_reference", "wrong_ifsc", "true_orphan", "ambiguous_near_duplicate",
)
# fixed values: thresholds of the score curve
THRESHOLDS = (0.0, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.92, 0.94, 0.96, 0.98, 0.99)
