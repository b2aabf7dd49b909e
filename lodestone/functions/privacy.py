"""Personal data and structures: spans by category, redaction, canonical JSON, blind indexes."""

from __future__ import annotations

import hashlib
import hmac
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories of personal data and their patterns, in order of precedence.
CATEGORIES = (
    ("credential", r"(?i)\b(?:password|passwd|secret|token|api_?key)\s*[:=]\s*\S+"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("government_id", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("card", r"\b\d(?:[ -]?\d){12,18}\b"),
    ("phone", r"(?<!\w)\+?\d{0,3} ?\(?\d{3}\)?[ -]\d{3}[ -]\d{4}\b"),
)
SENSITIVE_KEYS = frozenset({"password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "cookie"})
MOST_DEPTH = 32


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, category) in order; where spans overlap, the earlier and then the longer one counts."""
    found = []
    for category, pattern in CATEGORIES:
        for m in re.finditer(pattern, text):
            if category != "card" or luhn(re.sub(r"\D", "", m.group())):
                found.append((m.start(), -m.end(), category))
    out, reach = [], 0
    for start, end, category in sorted(found, key=lambda x: x[:2]):
        if start >= reach:
            out.append((start, -end, category))
            reach = -end
    return out


def scrub(text: str) -> str:
    for start, end, category in reversed(spans(text)):
        text = f"{text[:start]}[REDACTED:{category}]{text[end:]}"
    return text


def scrub_structure(value, depth: int = 0):
    """`value` with values of sensitive keys and personal data in strings replaced, below MOST_DEPTH levels cut."""
    if depth > MOST_DEPTH:
        return "[REDACTED:depth]"
    if isinstance(value, dict):
        return {k: "[REDACTED:credential]" if str(k).lower() in SENSITIVE_KEYS and v else scrub_structure(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [scrub_structure(v, depth + 1) for v in value]
    return scrub(value) if isinstance(value, str) else value


def canonical(raw: str | None) -> str | None:
    """JSON with sorted keys and no spaces, or null if it is none."""
    try:
        return json.dumps(json.loads(raw), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (TypeError, ValueError):
        return None


def _each(kind: str, function):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else function(x))

    return F.pandas_udf(run, kind)


def scrubbed(text: Column) -> Column:
    return _each("string", scrub)(text)


def personal_spans(text: Column) -> Column:
    """array of struct(start, end, category)."""
    return _each("array<struct<start:int,end:int,category:string>>", lambda t: [{"start": a, "end": b, "category": c} for a, b, c in spans(t)])(text)


def scrub_json(raw: str) -> str:
    """Canonical JSON of the scrubbed structure; what is no JSON, or is nested too deeply to parse, is scrubbed as text."""
    try:
        return json.dumps(scrub_structure(json.loads(raw)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return scrub(raw)


def scrubbed_json(raw: Column) -> Column:
    return _each("string", scrub_json)(raw)


def content_hash(raw: Column) -> Column:
    """SHA-256 of canonical JSON: the same for any order of keys."""
    return F.sha2(_each("string", canonical)(raw).cast("binary"), 256)


def blind_index(value: Column, key: bytes) -> Column:
    """Keyed hash of an identity, for joining without the identity."""
    return _each("string", lambda v: hmac.new(key, v.encode(), hashlib.sha256).hexdigest())(value)


def receipt_summary(df: DataFrame, text: str) -> DataFrame:
    """How many spans of each category `df` holds, and in how many rows."""
    named = df.select(F.transform(personal_spans(F.col(text)), lambda x: x["category"]).alias("all"))
    counted = F.transform(F.array_distinct("all"), lambda c: F.struct(c.alias("category"), F.size(F.filter("all", lambda x: x == c)).alias("n")))
    each = named.select(F.explode(counted).alias("c"))
    return each.groupBy("c.category").agg(F.sum("c.n").alias("n"), F.count(F.lit(1)).alias("n_rows"))
