"""Weak supervision for document quality: rules vote or abstain, expectation
maximisation estimates how accurate each rule is without labels, and a posterior
probability takes the place of a filter that asks every rule to pass.

Each rule votes 1 (good), -1 (bad) or 0 (abstains). The label model holds that
votes are independent given the quality: `prior` is the share of good documents,
`on_good[j]` and `on_bad[j]` the chance that rule j is right about a good and
about a bad document when it votes. Two accuracies a rule are needed as most
rules see one kind of fault: silence about the others is weak evidence, an alarm
is strong evidence. The votes of the corpus are first counted by pattern (at most
3^rules rows, whatever the corpus), and the iterations fold over that one array.

Defined results: a null or empty text has no words and fails the base rule; a
text without lines, symbols or windows counts zero; rows that repeat are scored
one by one; no row depends on doc_id, so null or repeated ids are harmless; an
empty table gives an empty result; columns of the input that clash with an added
one are replaced. Long texts cost n log n in their words, repeats included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ITERATIONS = 25
#: Where the accuracies and the prior start, and the pseudo-votes that hold them there.
START_GOOD, START_BAD, START_PRIOR, WEIGHT = 0.95, 0.5, 0.8, 20.0
KEEP_AT = 0.5


def n_symbols(text: Column) -> Column:
    text = C.text_or_empty(text)
    return F.length(text).cast("long") - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that the text holds twice or more.

    Windows meet as 64-bit hashes. Only texts in which a window repeats pay for
    sorting windows with their places.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(
            places,
            lambda p, i: F.when(i == F.size(places) - 1, F.lit(window)).otherwise(F.least(F.lit(window), F.get(places, i + 1) - p)),
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(ordered: Column) -> Column:
        again = F.filter(
            ordered,
            lambda x, i: (F.coalesce(F.get(ordered, i - 1)["g"] == x["g"], F.lit(False)))
            | (F.coalesce(F.get(ordered, i + 1)["g"] == x["g"], F.lit(False))),
        )
        return F.sort_array(F.transform(again, lambda x: x["p"]))

    def by_place(hashes: Column) -> Column:
        return C.word_windows(hashes, window, lambda g, i: F.struct(g.alias("g"), i.alias("p")), "struct<g:bigint,p:int>")

    def count(hashes: Column) -> Column:
        grams = C.word_windows(hashes, window, lambda g, i: g, "bigint")
        unique = C.let(grams, lambda g: F.size(F.array_distinct(g)) == F.size(g))
        return F.when(unique, F.lit(0)).otherwise(
            C.let(F.sort_array(by_place(hashes)), lambda o: C.let(repeated(o), covered))
        )

    return C.let(C.hash_each(words), count).cast("long")


FEATURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper_words",
    "n_marked_words",
    "n_letters",
)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with one long column for each of FEATURES."""
    body = F.col(f"`{text}`")

    def measure(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            n_repeat_words(words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    lines = F.filter(F.split(C.text_or_empty(body), "\n", -1), lambda line: line.rlike(C.HAS_WORD))
    measured = C.let(C.words(body), lambda w: C.let(lines, lambda li: measure(w, li)))
    safe = C.text_or_empty(body)
    return (
        C.without(docs, "__m", *FEATURES)
        .withColumn("__m", measured)
        .withColumn("n_symbols", n_symbols(body))
        .withColumn("n_upper_words", F.regexp_count(safe, F.lit("(?<![^\\x20\\x09-\\x0D])\\p{Lu}{2}")).cast("long"))
        .withColumn("n_marked_words", F.regexp_count(safe, F.lit("[!|#*$%&<>]{2}(?![^\\x20\\x09-\\x0D])|(?<![^\\x20\\x09-\\x0D])[|#*$%&<>]")).cast("long"))
        .withColumn("n_letters", F.length(F.regexp_replace(safe, "[^\\p{L}]+", "")).cast("long"))
        .withColumns({f: F.col(f"__m.{f}") for f in ("n_words", "word_chars", "n_dup_lines", "n_repeat_words", "n_lines")})
        .drop("__m")
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), F.lit(-1)).when(F.expr(self.good), F.lit(1)).otherwise(F.lit(0))


RULES = (
    Rule("length", "n_words < 20", "n_words >= 50"),
    Rule("word_length", "word_chars < 2.2 * n_words or word_chars > 15 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    Rule("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.03 * n_words"),
    Rule("marks", "n_marked_words > 0.15 * n_words", "n_marked_words <= 0.03 * n_words"),
    Rule("shouting", "n_upper_words > 0.25 * n_words", "n_upper_words <= 0.1 * n_words"),
    Rule("letters", "n_letters < 0.7 * word_chars", "n_letters >= 0.85 * word_chars"),
    Rule("repeated_lines", "n_dup_lines > 0.3 * n_lines", "n_lines >= 3 and n_dup_lines <= 0.1 * n_lines"),
    Rule("repeated_words", "n_repeat_words > 0.3 * n_words", "n_words >= 50 and n_repeat_words <= 0.1 * n_words"),
)


def votes(scored: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`scored` with `votes`, the array of the rules' votes."""
    return C.without(scored, "votes").withColumn("votes", F.array(*[r.vote() for r in rules]))


def fit(voted: DataFrame, n_rules: int, iterations: int = ITERATIONS) -> DataFrame:
    """One row for each pattern of votes that occurs: votes, p_good, prior, rules."""
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    gathered = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    logit = lambda p: F.log(p / (1 - p))
    add = lambda a, b: a + b

    def posterior(state: Column, vote: Column) -> Column:
        said = F.zip_with(
            vote,
            state["rules"],
            lambda v, r: F.when(v == 1, F.log(r["on_good"] / (1 - r["on_bad"]))).when(v == -1, F.log((1 - r["on_good"]) / r["on_bad"])).otherwise(F.lit(0.0)),
        )
        return 1 / (1 + F.exp(-F.aggregate(said, logit(state["prior"]), add)))

    def step(state: Column, patterns: Column) -> Column:
        weighed = F.transform(patterns, lambda x: F.struct(x["votes"].alias("votes"), x["n"].cast("double").alias("n"), posterior(state, x["votes"]).alias("p")))

        def total(rows: Column, value) -> Column:
            return F.aggregate(rows, F.lit(0.0), lambda a, x: a + value(x))

        def right(rows: Column, j: Column, side: int, share, start: float, least: float) -> Column:
            """Share of rule j's votes on one class that name this class."""
            hits = total(rows, lambda x: F.when(x["votes"][j] == side, x["n"] * share(x)).otherwise(F.lit(0.0)))
            cast = total(rows, lambda x: F.abs(x["votes"][j]) * x["n"] * share(x))
            return F.least(F.greatest((hits + WEIGHT * start) / (cast + WEIGHT), F.lit(least)), F.lit(0.995))

        def maximise(rows: Column) -> Column:
            good, bad = (lambda x: x["p"]), (lambda x: 1 - x["p"])
            prior = (total(rows, lambda x: x["n"] * x["p"]) + WEIGHT * START_PRIOR) / (total(rows, lambda x: x["n"]) + WEIGHT)
            rated = F.transform(
                F.sequence(F.lit(0), F.lit(n_rules - 1)),
                lambda j: F.struct(
                    right(rows, j, 1, good, START_GOOD, 0.6).alias("on_good"),
                    right(rows, j, -1, bad, START_BAD, 0.1).alias("on_bad"),
                ),
            )
            return F.struct(F.least(F.greatest(prior, F.lit(0.05)), F.lit(0.95)).alias("prior"), rated.alias("rules"))

        return C.let(weighed, maximise)

    start = F.struct(
        F.lit(START_PRIOR).alias("prior"),
        F.array_repeat(F.struct(F.lit(START_GOOD).alias("on_good"), F.lit(START_BAD).alias("on_bad")), n_rules).alias("rules"),
    )
    fitted = gathered.withColumn(
        "state",
        C.let(F.col("patterns"), lambda pats: F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, lambda s, _: step(s, pats))),
    )
    return fitted.select("state", F.explode("patterns").alias("x")).select(
        F.col("x.votes").alias("votes"),
        posterior(F.col("state"), F.col("x.votes")).alias("p_good"),
        F.col("state.prior").alias("prior"),
        F.col("state.rules").alias("rules"),
    )


def judge(voted: DataFrame, model: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """`voted` with base_failed, p_good and kept.

    The model has at most 3^rules rows, so it is broadcast.
    """
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rated = C.without(voted, "p_good", "kept", "base_failed").join(F.broadcast(model.select("votes", "p_good")), "votes", "left")
    return rated.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every column of `docs` but the text, with the features, votes, p_good and kept."""
    voted = C.durable(votes(features(docs, text).drop(text), rules))
    return judge(voted, C.durable(fit(voted, len(rules))))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns as they came.

    Rows are written once beside their votes, so each text is measured once and none is shuffled.
    """
    voted = votes(features(C.packed(docs, F.col(f"`{text}`").alias("text")), "text"), rules)
    voted = C.durable(voted.select("row", "votes", "n_words", "n_repeat_words"))
    model = C.durable(fit(voted, len(rules)))
    return C.unpacked(judge(voted, model).filter("kept"), docs.columns)


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of `docs`, then the posterior and the votes."""
    return quality_rules(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("p_good", 6).alias("p_good"),
        F.array_join(F.transform("votes", lambda v: v.cast("string")), ",").alias("votes"),
    )
