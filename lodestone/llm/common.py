"""Text expressions and lineage cuts that the operators share.

Words are maximal runs of characters other than space and \\x09-\\x0D; a null
text has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import durable, new_path, scratch_dir  # noqa: F401

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
HAS_WORD = "[^\\x20\\x09-\\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, whatever its uses in `body`."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text_or_empty(text), SPACE_RUN, -1), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z lowered and every other character as it is.

    `lower` agrees with that unless it changes a character beyond ASCII, which
    the text without its ASCII characters shows.
    """
    text = text_or_empty(text)
    other = F.regexp_replace(text, "[\\x00-\\x7F]+", "")
    return F.when(F.lower(other) == other, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def word_windows(hashes: Column, n: int, build: Callable[[Column, Column], Column], kind: str) -> Column:
    """`build(hash of n neighbouring entries, index of the first)` for each window of `hashes`.

    `hashes` is referenced several times: pass a column or a variable of `let`.
    """
    return F.when(
        F.size(hashes) >= n,
        F.transform(
            F.sequence(F.lit(0), F.size(hashes) - n),
            lambda i: build(F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]), i),
        ),
    ).otherwise(F.array().cast(f"array<{kind}>"))


def hash_each(items: Column) -> Column:
    return F.transform(items, lambda w: F.xxhash64(w))


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns that an operator is about to add, in any case of letters."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


#: Rows that the filter in front of a join on few rows can have, whatever the data.
BUCKETS = 1 << 20


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _apart(rows: DataFrame, found: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """`rows` that may meet `found` on `keys`, and those that cannot.

    The filter is a broadcast of hash buckets, at most BUCKETS rows; only the first
    part goes on to a shuffle.
    """
    near = F.broadcast(found.select(bucket(*keys).alias("__bucket")).distinct())
    dealt = rows.withColumn("__bucket", bucket(*keys))
    close, far = (dealt.join(near, "__bucket", how).drop("__bucket") for how in ("left_semi", "left_anti"))
    return close, far


def left_join_few(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of `rows` with `found`, which meets few of them; both hold `keys`, none null."""
    close, far = _apart(rows, found, keys)
    return close.join(found.hint("merge"), keys, "left").unionByName(far, allowMissingColumns=True)


def anti_join_few(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` without those that `found` names by `keys`, which are few; a null key is named by none."""
    close, far = _apart(rows, found, keys)
    return close.join(found.hint("merge"), keys, "left_anti").unionByName(far)


#: A key that holds over this part of the rows is hot; fewer keys than this number can be.
HOT = 1000


def split_hot(counted: DataFrame, n: str = "n") -> tuple[DataFrame, DataFrame]:
    """`counted` (a written table: keys with the number `n` of their rows) as hot keys and others.

    A hot key alone would fill a task. There are fewer than HOT of them, whatever the
    data, so they can be broadcast.
    """
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return counted.filter(F.col(n) * HOT > total), counted.filter(F.col(n) * HOT <= total)


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Inner join of `rows` with `counted`, a written table of one row a key with its number of rows.

    Hot keys are broadcast, the others shuffled, at every size.
    """
    hot, cold = split_hot(counted, n)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold.hint("merge"), key))


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """`docs` as one struct `row` beside `columns`, which so clash with none of its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def unpacked(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col("row")[c].alias(c) for c in names])


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that tell rows apart and put them in order, none null: __id, null ids last, and __text, a hash."""
    return [
        F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1)).alias("__id"),
        F.xxhash64(text_or_empty(text)).alias("__text"),
    ]


def bounded(df: DataFrame, most: int) -> bool:
    """Whether `df`, best a written table, has at most `most` rows.

    A count, as a limit would send that many rows of every partition to one task.
    """
    return df.count() <= most
