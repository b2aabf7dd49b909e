"""Text functions as columns: redaction, entities, terms, keys, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of secrets and personal data, in order of replacement.
REDACTIONS = (
    ("credential", r"(?i)\b(?:password|passwd|secret|token|api_?key)\s*[:=]\s*[^\s,;]+"),
    ("credential", r"AKIA[0-9A-Z]{16}"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("government_id", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("phone", r"\+?[0-9]{0,2} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}"),
)

# Kinds of entities and their patterns, in order.
ENTITIES = (
    ("url", r"https?://[^\s<>\"')]+"),
    ("uuid", r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("ip", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("ticket", r"\b[A-Z]{2,10}-[0-9]+\b"),
    ("pull_request", r"#[0-9]+\b"),
    ("path", r"(?:/[A-Za-z0-9_.-]+){2,}"),
)

# Words that carry no information in a query.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")


def redact(text: Column) -> Column:
    """`text` with secrets and personal data replaced by [REDACTED:kind]."""
    for kind, pattern in REDACTIONS:
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return text


def entities(text: Column) -> Column:
    """array of struct(kind, value), distinct, in the order of kinds."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.array_distinct(F.concat(*[of(kind, pattern) for kind, pattern in ENTITIES]))


def informative_terms(query: Column) -> Column:
    """Distinct lowered terms without stopwords; short ones only with a digit."""
    terms = F.regexp_extract_all(F.lower(query), F.lit(r"[a-z0-9][a-z0-9_./#-]*"), F.lit(0))
    kept = F.filter(terms, lambda t: (F.length(t) > 2) | t.rlike("[0-9]"))
    return F.array_except(F.array_distinct(kept), F.array(*[F.lit(w) for w in STOPWORDS]))


def evidence_key(text: Column) -> Column:
    """Lowered text with single spaces, for comparing evidence."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def clip(text: Column, most: int) -> Column:
    """Head and tail of a text that is longer than `most` characters, around a mark."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("\n…\n"), F.right(text, F.lit(half))))


def content_window(text: Column, needle: str, width: int) -> Column:
    """Up to `width` characters of `text` around the first place of `needle`, any case."""
    at = F.greatest(F.instr(F.lower(text), F.lit(needle.lower())), F.lit(1))
    return F.substring(text, F.greatest(at - width // 2, F.lit(1)), F.lit(width))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def html_text(html: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags; the commonest entities decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def turn_text(question: Column, answers: Column) -> Column:
    return F.concat(F.lit("Q: "), question, F.lit("\nA: "), F.array_join(answers, "\n"))


def opaque_id(prefix: str, *parts: Column) -> Column:
    """`prefix_` and 32 hexadecimal digits over the parts."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256), 1, 32))
