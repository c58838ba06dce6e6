"""Checks that need Unicode folding or JSON in its written order, as Arrow functions."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def folded(text: str) -> str:
    """NFKC form, lower case, letters and digits alone."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def quoted(quote: str | None, source: str | None) -> bool:
    """Whether a quotation stands in a source; parts between ellipses must follow in order, and a quote without letters doesn't count."""
    if not quote or not source:
        return False
    parts = [p for p in (folded(x) for x in quote.replace("…", "...").split("...")) if p]
    text, at = folded(source), 0
    for p in parts:
        at = text.find(p, at)
        if at < 0:
            return False
        at += len(p)
    return bool(parts)


@F.pandas_udf(BooleanType())
def quote_found(quote: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([quoted(q, s) for q, s in zip(quote, source)])


def canonical(text: str | None) -> str | None:
    """JSON with sorted keys and no spaces; null for what isn't JSON."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if text is not None else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_hash(text: pd.Series) -> pd.Series:
    """SHA-256 of canonical JSON."""
    return pd.Series([None if (c := canonical(x)) is None else hashlib.sha256(c.encode()).hexdigest() for x in text])


STATUSES = ("pass", "partial", "fail")


def audit(text: str | None, metrics: list[str], checks: int = 3) -> tuple[bool, str, float]:
    """Verdict, first problem and score of an audit: every metric in the given order, each with as many checks of a known status; a check that passed has evidence, one that failed a defect."""
    try:
        told = json.loads(text or "")
    except ValueError:
        return False, "not JSON", 0.0
    if not isinstance(told, dict) or list(told) != metrics:
        return False, "metrics differ", 0.0
    points = 0.0
    for m in metrics:
        rows = told[m]
        if not isinstance(rows, list) or len(rows) != checks:
            return False, f"{m}: wrong number of checks", 0.0
        for k, c in enumerate(rows):
            if not isinstance(c, dict) or c.get("id") != f"{m}.{k + 1}":
                return False, f"{m}: wrong check id", 0.0
            if c.get("status") not in STATUSES:
                return False, f"{m}: unknown status", 0.0
            evidence, defect = c.get("evidence") or [], str(c.get("defect") or "").strip()
            if c["status"] == "pass" and not evidence:
                return False, f"{m}: a pass without evidence", 0.0
            if c["status"] == "fail" and not defect:
                return False, f"{m}: a fail without a defect", 0.0
            points += {"pass": 1.0, "partial": 0.5, "fail": 0.0}[c["status"]]
    return True, "", round(100 * points / (len(metrics) * checks), 2)


def audit_udf(metrics: list[str], checks: int = 3):
    @F.pandas_udf("valid boolean, problem string, score double")
    def judged(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([audit(x, metrics, checks) for x in text], columns=["valid", "problem", "score"])

    return judged
