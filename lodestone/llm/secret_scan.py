"""Secret scans through a trigram index.

Each rule's regular expression is read as a tree, from which follow the trigrams
that any match must hold: a rule becomes alternatives, each a set of trigrams. The
index lists, for every trigram that some rule asks for, the documents that hold it
(in lower case). A rule's candidates are the intersections of its alternatives'
lists; only these texts meet the expression. A rule that no trigram follows from,
such as a run of hexadecimal digits, scans every text.

Spans count code points, from 0, end exclusive. Matches are leftmost and do not
overlap within a kind; those shorter than the rule's least length are dropped.

Postings name a row by its id and a hash of its text; only rows that may be
candidates, told by a broadcast of hash buckets, go through the join with their text.

Defined results: a null text is empty and has no spans; rows that repeat an id and a
text are one posting and have equal spans; a null id is as good as another; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Literal strings that one part of an expression may stand for before it counts as open.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `group` of each match must have `least` characters."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0
    fold: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.fold else "") + self.regex


#: In the order of kinds. The first three are the base.
RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2, True),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]+", 32),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "[rs]k_live_[0-9A-Za-z]{24,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", "[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._-]{1,64}@[A-Za-z0-9]"),
)
BASE = ("assign", "access", "hex")


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives of trigrams, in lower case, one of which any match holds as a whole.

    [] if no trigram is mandatory. Runs of parts with few literal strings are
    multiplied out; an open part ends a run. Runs of one expression must all hold,
    so the alternatives of the most selective run are extended by the others.
    """

    def strings(op, arg) -> list[str] | None:
        """The strings a part stands for, if they are few."""
        op = str(op)
        if op == "LITERAL":
            return [chr(arg).lower()]
        if op == "IN":
            out: set[str] = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    out.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                    out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return sorted(out) if len(out) <= 8 else None
        if op == "SUBPATTERN":
            return sequence(arg[-1])
        if op == "BRANCH":
            parts = [sequence(p) for p in arg[1]]
            return None if None in parts else sorted({s for p in parts for s in p})
        if op == "MAX_REPEAT":
            low, high, inner = arg
            one = sequence(inner)
            if one is None or high > 5:
                return None
            return sorted({"".join(p) for n in range(low, int(high) + 1) for p in product(one, repeat=n)}) if len(one) ** int(high) <= MOST_STRINGS else None
        return None

    def sequence(parts) -> list[str] | None:
        got = [""]
        for op, arg in parts:
            more = strings(op, arg)
            if more is None or len(got) * len(more) > MOST_STRINGS:
                return None
            got = [a + b for a in got for b in more]
        return got

    runs: list[list[str]] = [[""]]
    for op, arg in re._parser.parse(regex):
        more = strings(op, arg)
        if more is None:
            repeated = str(op) == "MAX_REPEAT" and arg[0] >= 1 and sequence(arg[2])
            if repeated and len(runs[-1]) * len(repeated) <= MOST_STRINGS:
                runs[-1] = [a + b for a in runs[-1] for b in repeated]
            runs.append([""])
        elif len(runs[-1]) * len(more) > MOST_STRINGS:
            runs.append(more)
        else:
            runs[-1] = [a + b for a in runs[-1] for b in more]
    asked = [q for run in runs if all(q := [_trigrams(s) for s in run])]
    out: list[frozenset[str]] = []
    for q in sorted(asked, key=len):
        if not out:
            out = list(dict.fromkeys(q))
        elif len(out) * len(q) <= MOST_STRINGS:
            out = list(dict.fromkeys(a | b for a in out for b in q))
    # an alternative that asks for more than another is no use beside it
    return [a for a in out if not any(b < a for b in out)]


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, __id, __text) of the trigrams that `rules` ask for."""
    asked = sorted({t for r in rules for a in trigram_query(r.regex) for t in a})
    held = C.let(
        F.lower(C.text_or_empty(F.col(f"`{text}`"))),
        lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in asked])),
    )
    return docs.select(F.explode(held).alias("trigram"), *C.row_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """__id, __text, kinds: the rules for which the index does not rule the row out."""
    spark = postings.sparkSession
    plan = [(r.kind, k, t, len(a)) for r in rules for k, a in enumerate(trigram_query(r.regex)) for t in sorted(a)]
    asked = spark.createDataFrame(plan, "kind string, alternative int, trigram string, n int")
    met = postings.distinct().join(F.broadcast(asked), "trigram")
    whole = met.groupBy("__id", "__text", "kind", "alternative").agg(F.count(F.lit(1)).alias("held"), F.first("n").alias("n")).filter("held = n")
    return whole.groupBy("__id", "__text").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, text: Column) -> Column:
    """struct(start, end, kind order) of each match of `rule` that is long enough.

    Splitting at the matches gives what stands between them; the lengths of both
    add up to positions.
    """
    order = RULES.index(rule) if rule in RULES else len(RULES)
    regex = F.lit(rule.java)

    def measured(found: Column, between: Column, counted: Column) -> Column:
        steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("size")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:int>>").alias("out"))
        added = F.aggregate(
            steps,
            start,
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["size"]).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end"), F.lit(order).alias("kind"))).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        return C.let(counted, lambda sizes: F.filter(added, lambda _, i: F.get(sizes, i) >= rule.least))

    found = F.regexp_extract_all(text, regex, F.lit(0))
    counted = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), lambda g: F.length(g))
    return C.let(found, lambda f: C.let(F.split(text, rule.java, -1), lambda b: measured(f, b, counted)))


def _gate(rule: Rule) -> str:
    """An expression that any match long enough fulfils, cheaper than cutting the text at each run."""
    return rule.java[:-1] + f"{{{rule.least}}}" if not trigram_query(rule.regex) and rule.least and rule.java.endswith("]+") else rule.java


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `spans`: array of (start, end, kind) in order of start, then of kinds."""
    names = docs.columns
    found = C.durable(candidates(index(docs, rules, doc_id, text), rules))
    own = F.col(f"`{text}`")
    met = C.left_join_few(C.packed(docs, C.text_or_empty(own).alias("body"), *C.row_key(F.col(f"`{doc_id}`"), own)), found, ["__id", "__text"])
    body, none = F.col("body"), F.array().cast("array<struct<start:int,end:int,kind:int>>")
    each = [
        F.when(
            (F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), r.kind) if trigram_query(r.regex) else F.lit(True)) & body.rlike(_gate(r)),
            _spans(r, body),
        ).otherwise(none)
        for r in rules
    ]
    ordered = F.array_sort(F.concat(*each), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    named = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["kind"]).alias("kind")))
    return met.select(*[F.col("row")[c].alias(c) for c in names if c.lower() != "spans"], named.alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    out = secret_scan(docs.select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for `query`: every rule over every text."""
    quoted = [(r.kind, r.java.replace("'", "''"), r.least, r.group, k) for k, r in enumerate(rules)]
    legs = "\nUNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, {k} AS o, unnest(regexp_extract_all(t, '{rx}')) AS m, unnest(regexp_extract_all(t, '{rx}', {group})) AS g,
  unnest(list_slice(string_split_regex(t, '{rx}'), 1, len(regexp_extract_all(t, '{rx}')))) AS b,
  generate_subscripts(regexp_extract_all(t, '{rx}'), 1) AS i, {least} AS least FROM docs"""
        for kind, rx, least, group, k in quoted
    )
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({legs}),
placed AS (SELECT *, sum(length(b) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM hits),
kept AS (SELECT doc_id, kind, o, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE length(g) >= least),
per AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (WHERE kind IN ({base})) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per p ON p.doc_id = d.doc_id
"""
