"""Passages in their context: metadata, opening and neighbouring passages, chosen greedily within budgets of tokens and bytes.

Partners follow from ordinals (see `passages.context`), so a passage meets at most
opening + 2 x near others by equi joins, and the choice among them is a fold over that
short array: opening passages first, then by distance, each taken if it still fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .passages import context

# The marks of the sections, and of what an excerpt leaves out.
HEAD, TARGET_MARK, SUPPORT_MARK = "[document context]", "[target passage %d]", "[support passage %d]"
LEFT_OUT = "\n[...embedding excerpt clipped...]\n"
OPENING, NEAR, MOST_TOKENS, MOST_BYTES, LEAST_TARGET = 2, 2, 7168, 7000, 512


def excerpt(text: Column, most: Column) -> Column:
    """`text` if it has at most `most` UTF-8 bytes, else its two ends around LEFT_OUT, never inside a character."""
    data = F.encode(text, "UTF-8")
    size = F.octet_length(data)
    rest = most - len(LEFT_OUT.encode())
    end, start = F.floor((rest + 1) / 2).cast("int"), (size - F.floor(rest / 2)).cast("int")
    inside = lambda at: F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")
    for _ in range(3):
        end = F.when(inside(end), end - 1).otherwise(end)
        start = F.when(inside(start), start + 1).otherwise(start)
    part = lambda at, n: F.decode(F.substring(data, at + 1, n), "UTF-8")
    return F.when(size <= most, text).otherwise(F.concat(part(F.lit(0), end), F.lit(LEFT_OUT), part(start, size - start)))


def metadata_lines(values: dict[str, Column]) -> Column:
    """`label: value` of the values that are there and not blank, in order, as an array."""
    trimmed = {label: F.trim(v.cast("string")) for label, v in values.items()}
    return F.array_compact(F.array(*[F.when(v != "", F.concat(F.lit(f"{label}: "), v)) for label, v in trimmed.items()]))


def contextual(parts: DataFrame, metadata: DataFrame, opening: int = OPENING, near: int = NEAR, most_tokens: int = MOST_TOKENS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, ordinal, n_support, context_text and its sha256, of each of `parts` (doc_id, ordinal, n_tokens, text).

    `metadata` has doc_id and lines, an array; a document without it has none. The target
    is always there, as an excerpt if it has to be; what supports it has at most the
    tokens and bytes that the target leaves, stands in the order of the document, and is
    left out whole if it does not fit. Ordinals count from 0 and are unique in a document.
    """
    size = lambda c: F.octet_length(c)
    mark = lambda name, ordinal: F.format_string(name, ordinal)
    target = parts.join(metadata.select("doc_id", "lines"), "doc_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    prefix = F.array_join(F.concat(F.array(F.lit(HEAD)), "lines", F.array(mark(TARGET_MARK, F.col("ordinal")))), "\n")
    body = excerpt(F.col("text"), F.greatest(F.lit(LEAST_TARGET), most_bytes - size(prefix) - 1))
    target = target.select("doc_id", "ordinal", "n_tokens", "lines", prefix.alias("prefix"), body.alias("body"))

    other = parts.select("doc_id", F.col("ordinal").alias("other"), F.col("n_tokens").alias("tokens"), F.col("text").alias("said"))
    asked = context(parts, opening, near).join(other, ["doc_id", "other"])
    first = F.col("other") < opening
    entry = F.struct(
        F.when(first, 0).otherwise(1).alias("late"), F.when(first, F.col("other")).otherwise(F.abs(F.col("other") - F.col("ordinal"))).alias("far"), F.col("other").alias("ordinal"),
        "tokens", (size(mark(SUPPORT_MARK, F.col("other"))) + size(F.col("said")) + 2).alias("cost"), "said",
    )
    support = asked.groupBy("doc_id", "ordinal").agg(F.sort_array(F.collect_list(entry)).alias("support"))  # at most opening + 2 near
    met = target.join(support, ["doc_id", "ordinal"], "left")

    kind = "array<struct<ordinal:int,said:string>>"
    start = F.struct(
        F.greatest(F.lit(0), most_tokens - F.col("n_tokens")).cast("long").alias("tokens"),
        F.greatest(F.lit(0), most_bytes - size(F.col("prefix")) - 1 - size(F.col("body"))).cast("long").alias("bytes"), F.array().cast(kind).alias("kept"),
    )

    def step(s: Column, e: Column) -> Column:
        fits = (e["tokens"] <= s["tokens"]) & (e["cost"] <= s["bytes"])
        one = F.struct(e["ordinal"].cast("int").alias("ordinal"), e["said"].alias("said"))
        left = F.struct((s["tokens"] - e["tokens"]).cast("long").alias("tokens"), (s["bytes"] - e["cost"]).cast("long").alias("bytes"), F.array_append(s["kept"], one).alias("kept"))
        return F.when(fits, left).otherwise(s)

    kept = F.when(F.col("support").isNull(), F.array().cast(kind)).otherwise(F.aggregate("support", start, step, lambda s: s["kept"]))
    chosen = met.withColumn("kept", F.sort_array(kept))
    said = F.flatten(F.transform("kept", lambda k: F.array(mark(SUPPORT_MARK, k["ordinal"]), k["said"])))
    text = F.array_join(F.concat(F.array(F.lit(HEAD)), "lines", said, F.array(mark(TARGET_MARK, F.col("ordinal")), F.col("body"))), "\n")
    return chosen.select("doc_id", "ordinal", F.size("kept").alias("n_support"), text.alias("context_text")).withColumn("context_sha256", F.sha2(F.col("context_text").cast("binary"), 256))
