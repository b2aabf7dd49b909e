"""Redaction as column expressions: secrets by line to a fixpoint, personal data by span.

Every function gives null for a null text. Patterns run with Unicode classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
BLOCK_MARK, LINE_MARK = "[redacted-private-key-block]", "[redacted-secret-line]"

# Secrets of a line, secrets that may cross lines, and blocks.
PROVIDER_KEYS = (
    r"sk-(?:proj|svcacct|admin)-[A-Za-z0-9_-]{40,}|sk-(?!ant-|or-v1-)[A-Za-z0-9_-]{32,}|"
    r"sk-ant-(?:api03|admin01)-[A-Za-z0-9_-]{80,}AA|sk-or-v1-[A-Za-z0-9_-]{20,}|gsk_[A-Za-z0-9]{20,}|"
    r"xai-[A-Za-z0-9_-]{20,}|pplx-[A-Za-z0-9_-]{20,}|csk-[A-Za-z0-9_-]{20,}|xox[baprs]-[A-Za-z0-9-]{20,}|"
    r"(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{20,}|ops_[A-Za-z0-9_-]{20,}|A[KS]IA[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|"
    r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}|pcsk_[A-Za-z0-9_-]{20,}|lsv2_[A-Za-z0-9_-]{20,}"
)
SECRET = (
    r"""["']?(?:api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|token|secret|password|bearer|authorization|\bkey)["']?\s*[=:]\s*["']?(?:Bearer\s+)?\S{12,}|"""
    + PROVIDER_KEYS
    + r"|Bearer\s+[A-Za-z0-9._~+/=-]{20,}|[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@"
)
ASSIGNMENT = (
    r"""(?<![A-Za-z0-9_.-])["']?[A-Za-z0-9_.-]*(?:api[_-]?key|apikey|api|token|secret|password|passwd|pass|credential|creds|key|access|private[_-]?key|"""
    r"""access[_-]?key|client[_-]?secret|authorization|auth)[A-Za-z0-9_.-]*["']?\s*[:=]\s*["']?(?:Bearer\s+)?[^\s,"']{12,}"""
)
NEARBY = (
    r"\bsntryu_[a-f0-9]{64}\b|sentry(?:.|[\n\r]){0,40}?\b[a-f0-9]{64}\b|"
    r"(?:phrase|accessToken|access_token)(?:.|[\n\r]){0,40}?\b[a-z0-9]{64}\b"
)
KEY_BLOCK = r"-----BEGIN (?<label>[A-Z0-9 ]*PRIVATE KEY)-----.*?-----END \k<label>-----"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"

# What every match of the patterns above has: cheap tests that keep most texts and lines from them.
# The two odd letters are those that case folding takes for k and s.
MAY_HOLD_KEY = r"[A-Za-z0-9._~+/=\u017F\u212A-]{20}"
MAY_HOLD_SECRET = "[:=]|" + MAY_HOLD_KEY
MAY_CROSS = r"(?iU)(?<!\s)[^\S\n\r]*+[\n\r]\s*+[:=]|[:=][^\S\n\r]*+[\n\r]|bearer[^\S\n\r]*+[\n\r]"
MAY_BE_NEAR = r"[A-Za-z0-9\u017F\u212A]{64}"

# Categories of personal data, their patterns, and whether the last group alone is the span.
PERSONAL = (
    ("credential", r"(?i)\b(?:api[_-]?key|password|secret|access[_-]?token|refresh[_-]?token)\s*[=:]\s*[^\s,;]+", False),
    ("credential", r"(?i)\bBearer\s+[^\s,;]+", False),
    ("credential", rf"(?i)(?<![A-Za-z0-9_])(?:{PROVIDER_KEYS})(?![A-Za-z0-9_-])", False),
    ("email", r"(?i)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w.-])", False),
    ("phone", r"(?<![\w.])(?:(?:\+1\s+|\(\d{3}\)\s*)\d{3}[- ]\d{4}|\+1\s+\d{3}[- ]\d{3}[- ]\d{4})(?![\w.-])", False),
    ("phone", r"(?<![\w.])\d{3}-\d{3}-\d{4}(?![\w.-])", False),
    ("government_id", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", False),
    ("financial_id", r"(?<![\d.])(?:\d[ -]?){12,18}\d(?![\d.-])", False),
    ("medical_id", r"(?i)\b(?:MRN|medical record(?: number)?)\s*:\s*([A-Z0-9-]{6,})", True),
    ("postal_address", r"(?i)\bAddress\s*:\s*([^\n]+)", True),
)
#: What every match of the patterns of PERSONAL has, in their order.
GATES = ("[=:]", "[Bb][Ee][Aa][Rr][Ee][Rr]", MAY_HOLD_KEY, "@", r"\p{Nd}{3}", r"\p{Nd}-", r"\p{Nd}-", r"\p{Nd}[ -]?\p{Nd}[ -]?\p{Nd}[ -]?\p{Nd}", ":", ":")
SPANS = "array<struct<start:int,end:int,category:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _has(text: Column, pattern: str, flags: str = "(?iU)") -> Column:
    return F.rlike(text, F.lit(flags + pattern))


def _lines(text: Column) -> Column:
    """Lines without their ends; an end at the very end begins no further line."""
    return _let(F.split(text, LINE_END, -1), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def _round(text: Column) -> Column:
    crossing = F.exists(F.regexp_extract_all(text, F.lit("(?iU)" + ASSIGNMENT), F.lit(0)), lambda m: F.rlike(m, F.lit(r"[\n\r]")))
    secret = lambda line: _has(line, MAY_HOLD_SECRET, "") & (_has(line, SECRET) | _has(line, ASSIGNMENT))
    blocked = F.when(F.contains(text, F.lit("-----BEGIN ")), F.regexp_replace(text, "(?s)" + KEY_BLOCK, BLOCK_MARK)).otherwise(text)
    by_line = F.array_join(F.transform(_lines(blocked), lambda line: F.when(secret(line), F.lit(LINE_MARK)).otherwise(line)), "\n")
    whole = (_has(text, MAY_CROSS, "") & crossing) | (_has(text, MAY_BE_NEAR, "") & _has(text, NEARBY))
    return F.when(whole, F.lit(LINE_MARK)).otherwise(by_line)


def without_secrets(text: Column) -> Column:
    """`text` with key blocks and lines that hold a secret replaced, until it stays as it is.

    A marker may itself look like the value of a key on the line above, so rounds follow
    until one changes nothing; what still changes in the last of ROUNDS is replaced whole,
    as is a text with a secret across lines. Line ends become \\n and the last one goes. A
    round is one step of a fold, so the expression does not grow with their number, and
    texts that are done cost no further round.
    """
    first = F.struct(text.alias("text"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        new = _let(_round(acc["text"]), lambda n: F.struct(n.alias("text"), ((n == acc["text"]) | (n == LINE_MARK)).alias("done")))
        return F.when(acc["done"], acc).otherwise(new)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step, lambda acc: F.when(acc["done"], acc["text"]).otherwise(F.lit(LINE_MARK)))
    return F.when(text.isNotNull(), done)


def public_text(text: Column) -> Column:
    """`without_secrets` with the markers that leave the system."""
    return F.replace(F.replace(without_secrets(text), F.lit(BLOCK_MARK), F.lit("[REDACTED-PRIVATE-KEY]")), F.lit(LINE_MARK), F.lit("[REDACTED]"))


def _found(text: Column, rank: int, category: str, pattern: str, last_group: bool) -> Column:
    """Spans of one pattern as (start, -end, rank, category).

    A match stands after the pieces and matches before it, whose lengths are summed.
    """
    full = F.lit("(?U)" + pattern)
    whole = F.regexp_extract_all(text, full, F.lit(0))
    inner = F.regexp_extract_all(text, full, F.lit(1)) if last_group else whole
    pairs = F.arrays_zip(F.split(text, "(?U)" + pattern, -1).alias("gap"), whole.alias("whole"), inner.alias("inner"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,minus_end:int,rank:int,category:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["whole"]), F.lit(0))
        span = F.struct((end - F.length(x["inner"])).alias("start"), (-end).alias("minus_end"), F.lit(rank).alias("rank"), F.lit(category).alias("category"))
        counts = x["whole"].isNotNull()
        if category == "financial_id":
            counts = counts & F.call_function("luhn_check", F.regexp_replace(x["whole"], "[^0-9]", ""))
        return F.struct(end.alias("at"), F.when(counts, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<start:int,minus_end:int,rank:int,category:string>>")
    return F.when(F.rlike(text, F.lit(GATES[rank])) & F.rlike(text, full), F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(none)


def personal_spans(text: Column) -> Column:
    """(start, end, category) of personal data, in code points and in order.

    Where spans overlap, the one that starts first counts, and of those the longest; of
    equal ones the first category.
    """
    every = F.array_sort(F.concat(*[_found(text, k, *rule) for k, rule in enumerate(PERSONAL)]))
    zero = F.struct(F.lit(0).alias("reach"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct(x["start"].alias("start"), (-x["minus_end"]).alias("end"), x["category"].alias("category"))
        taken = F.struct((-x["minus_end"]).alias("reach"), F.array_append(acc["out"], span).alias("out"))
        return F.when(x["start"] >= acc["reach"], taken).otherwise(acc)

    return F.when(text.isNotNull(), F.aggregate(every, zero, step, lambda acc: acc["out"]))


def rendered(text: Column, spans: Column) -> Column:
    """`text` with each of `spans` (in order, apart) replaced by its category."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        mark = F.concat(F.lit("[REDACTED:"), x["category"], F.lit("]"))
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(gap, mark)).alias("out"))

    end = lambda acc: F.array_join(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))), "")
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, end))


def policy(text: Column, mode: str = "scrub") -> Column:
    """struct(action, value, categories, reason) of the privacy policy.

    `off` keeps all; `scrub` replaces spans; `drop` gives no value for a text that has
    any. `categories` is an array of (category, n) by category.
    """
    counts = "array<struct<category:string,n:int>>"

    def result(action, value, categories, reason):
        return F.struct(F.lit(action).alias("action"), value.alias("value"), categories.alias("categories"), F.lit(reason).alias("reason"))

    nothing = F.array().cast(counts)
    if mode == "off":
        return result("keep", text, nothing, "policy_off")
    if mode not in ("scrub", "drop"):
        raise ValueError("mode must be off, scrub or drop")

    def decide(spans: Column) -> Column:
        names = F.transform(spans, lambda x: x["category"])
        tally = F.transform(F.array_sort(F.array_distinct(names)), lambda c: F.struct(c.alias("category"), F.size(F.filter(spans, lambda x: x["category"] == c)).alias("n")))
        value = rendered(text, spans) if mode == "scrub" else F.lit(None).cast("string")
        return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, result("keep", text, nothing, "no_match")).otherwise(result(mode, value, tally, "sensitive_match"))

    return _let(personal_spans(text), decide)
