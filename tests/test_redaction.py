import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone import plans
from lodestone.functions import redaction as R

PEM = "-----BEGIN RSA PRIVATE KEY-----\nMIIE\nabc\n-----END RSA PRIVATE KEY-----"
HEX = "0123456789abcdef" * 4


def python(pattern):
    return pattern.replace("(?<label>", "(?P<label>").replace(r"\k<label>", "(?P=label)")


def plain_without_secrets(text):
    """The definition, on one text."""
    seen = []
    while len(seen) < R.ROUNDS:
        if re.search(R.NEARBY, text, re.I) or any(re.search(r"[\n\r]", m) for m in (m.group() for m in re.finditer(R.ASSIGNMENT, text, re.I))):
            return R.LINE_MARK
        lines = re.sub(python(R.KEY_BLOCK), R.BLOCK_MARK, text, flags=re.S).splitlines()
        seen.append(text)
        text = "\n".join(R.LINE_MARK if re.search(R.SECRET, x, re.I) or re.search(R.ASSIGNMENT, x, re.I) else x for x in lines)
        if text == seen[-1]:
            return text
    return R.LINE_MARK


def plain_spans(text):
    """Personal spans of one text, by trying places from left to right."""
    found = {}
    for category, pattern, last_group in R.PERSONAL:
        for m in re.finditer(pattern, text):
            digits = [int(x) for x in re.sub(r"\D", "", m.group())][::-1]
            if category == "financial_id" and sum(digits[::2] + [d * 2 - 9 * (d > 4) for d in digits[1::2]]) % 10:
                continue
            found.setdefault(m.start(1) if last_group else m.start(), []).append((m.end(), category))
    out, at = [], 0
    for start in sorted(found):
        if start >= at:
            end, category = max(found[start], key=lambda x: x[0])
            out.append((start, end, category))
            at = end
    return out


SECRETS = {
    "plain": "plain", "": "", "a\r\nb\x0bc d\n": "a\nb\nc\nd", "a\n\n": "a",
    "x\npassword = abcdefghijklmn\ny": f"x\n{R.LINE_MARK}\ny",
    "short password=abc": "short password=abc",
    "u postgres://me:word@host/db": R.LINE_MARK,
    "Bearer abcdefghij0123456789XYZ": R.LINE_MARK,
    "k gh" + "p_" + "a1" * 12: R.LINE_MARK,
    f"one\n{PEM}\ntwo": f"one\n{R.BLOCK_MARK}\ntwo",
    f"token:\n{'q' * 14}": R.LINE_MARK,
    f"sentry x\n y {HEX}": R.LINE_MARK,
    f"my key:\n{PEM}": R.LINE_MARK,
    "api:\nsecret = abcdefghijklmn": R.LINE_MARK,
}


def test_secrets_to_a_fixpoint(spark):
    df = spark.createDataFrame([(t,) for t in SECRETS], "t string")
    got = {r[0]: r[1] for r in df.select("t", R.without_secrets(F.col("t"))).collect()}
    assert got == {t: plain_without_secrets(t) for t in SECRETS} == SECRETS
    assert spark.createDataFrame([(None,)], "t string").select(R.without_secrets(F.col("t"))).first()[0] is None
    assert df.filter(F.col("t").contains("BEGIN") & F.col("t").startswith("one")).select(R.public_text(F.col("t"))).first()[0] == "one\n[REDACTED-PRIVATE-KEY]\ntwo"


PIECES = [
    "ann@example.com", "+1 555-123-4567", "(555) 123-4567", "555-123-4567", "123-45-6789", "4111 1111 1111 1111", "4111111111111112", "MRN: AB-1234567",
    "Address: 1 Main St, bob@example.org", "Bearer abc.def", "password=hunter22", "api_key: x", "sk-proj-" + "a" * 44, "é", "😀", "\n", " ", "plain words", "1", ";", "-", "token:", "secret = " + "z" * 15, "key:",
]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    texts += ["", None, "x " * 50_000 + "a@b.co", "a@b.co " * 300]
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string")


def test_spans_by_brute_force(mixed):
    got = mixed.select("t", R.personal_spans(F.col("t")).alias("s"), R.policy(F.col("t")).alias("p"), R.policy(F.col("t"), "drop").alias("d")).collect()
    hits = 0
    for t, s, p, d in got:
        if t is None:
            assert s is None and tuple(p) == ("keep", None, [], "no_match") and d["action"] == "keep"
            continue
        want = plain_spans(t)
        assert [tuple(x) for x in s] == want
        value = t
        for a, b, c in reversed(want):
            value = f"{value[:a]}[REDACTED:{c}]{value[b:]}"
        names = [c for *_, c in want]
        tally = [(c, names.count(c)) for c in sorted(set(names))]
        assert (p["value"], [tuple(x) for x in p["categories"]], p["action"]) == (value, tally, "scrub" if want else "keep")
        assert (d["action"], d["value"]) == (("drop", None) if want else ("keep", t))
        hits += len(want)
    assert hits > 500 and {c for t, *_ in got if t for *_, c in plain_spans(t)} == {c for c, *_ in R.PERSONAL}


def test_secrets_by_brute_force(mixed):
    for t, got in mixed.select("t", R.without_secrets(F.col("t"))).collect():
        assert got == (None if t is None else plain_without_secrets(t))


def test_modes(spark):
    assert spark.range(1).select(R.policy(F.lit("a@b.co"), "off").alias("p")).select("p.value", "p.reason").first() == ("a@b.co", "policy_off")
    with pytest.raises(ValueError, match="mode"):
        R.policy(F.lit(""), "other")


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_queries_by_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for r in plans.queries()["str01_fixpoint"](spark, SF).collect():
        want = plain_without_secrets(texts[r["doc_id"]]).replace(R.BLOCK_MARK, "[REDACTED-PRIVATE-KEY]").replace(R.LINE_MARK, "[REDACTED]")
        assert (r["md5"], r["n_chars"]) == (md5(want), len(want))
    some = 0
    for r in plans.queries()["str03_policy"](spark, SF).collect():
        value, spans = texts[r["doc_id"]], plain_spans(texts[r["doc_id"]])
        names = [c for *_, c in spans]
        for a, b, c in reversed(spans):
            value = f"{value[:a]}[REDACTED:{c}]{value[b:]}"
        assert (r["md5"], r["categories"]) == (md5(value), ",".join(f"{c}={names.count(c)}" for c in sorted(set(names))))
        some += len(spans)
    assert some
