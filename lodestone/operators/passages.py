"""Texts cut for storage and retrieval: byte-bounded chunks, token windows, context, rebuilding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_BYTES, LOOK_BACK = 24_000, 2_048
TOKEN_BYTES = 64
TARGET, OVERLAP = 1024, 128
PASSAGES = "doc_id long, ordinal int, first_token int, n_tokens int, start int, end int, text string"
CHUNKS = "doc_id long, ordinal int, text string"


def chunk_text(text: str, most: int = CHUNK_BYTES, back: int = LOOK_BACK) -> Iterator[str]:
    """Slices of at most `most` bytes, ended at a line or a space near the end where there is one."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        while len(text[at:end].encode()) > most:
            end -= max(1, (len(text[at:end].encode()) - most + 3) // 4)
        if end < len(text):
            low = max(at + 1, end - back)
            cut = max(text.rfind("\n", low, end), text.rfind(" ", low, end))
            end = cut + 1 if cut >= 0 else end
        yield text[at:end]
        at = end


def token_ends(text: str, most: int = TOKEN_BYTES) -> list[int]:
    """Ends of tokens: white space belongs to the word after it, the last to the last word; long ones are split."""
    ends = [m.end() for m in re.finditer(r"\S+", text)]
    if not ends:
        return [len(text)] if text else []
    ends[-1] = len(text)
    out, start = [], 0
    for end in ends:
        size, held = 0, 0
        for k in range(start, end):
            size = len(text[k].encode())
            if held + size > most:
                out.append(k)
                held = 0
            held += size
        out.append(end)
        start = end
    return out


def windows(n: int, target: int = TARGET, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Token ranges of `target` tokens, each holding the last `overlap` of the one before."""
    at = 0
    while n:
        yield at, min(at + target, n)
        if at + target >= n:
            return
        at += target - overlap


def passages(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping token windows of each text (doc_id, text), with their spans in code points."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                text = text or ""
                ends = token_ends(text)
                for k, (a, b) in enumerate(windows(len(ends), target, overlap)):
                    start = ends[a - 1] if a else 0
                    rows.append((doc_id, k, a, b - a, start, ends[b - 1], text[start : ends[b - 1]]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PASSAGES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PASSAGES)


def chunks(docs: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, c) for i, t in zip(frame["doc_id"], frame["text"], strict=True) for k, c in enumerate(chunk_text(t or "", most))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, CHUNKS)


def rebuilt(parts: DataFrame, overlap_by: str | None = None) -> DataFrame:
    """doc_id and text put together again; parts that overlap give only what stands beyond those before."""
    if overlap_by is None:
        piece = F.struct("ordinal", "text")
        rows = parts
    else:
        w = W.partitionBy("doc_id").orderBy("ordinal")
        before = F.coalesce(F.lag("end").over(w), F.col("start"))
        rows = parts.withColumn("text", F.substring(F.col("text"), before - F.col("start") + 1, F.col("end") - before))
        piece = F.struct("ordinal", "text")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["text"]), "").alias("text"))


def n_passages(n_tokens: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    return F.when(n_tokens == 0, 0).when(n_tokens <= target, 1).otherwise(1 + F.ceil((n_tokens - target) / (target - overlap)))


def context(parts: DataFrame, opening: int = 2, near: int = 2) -> DataFrame:
    """doc_id, ordinal, other: the opening passages and those within `near`, but not itself.

    Ordinals are counted from 0, so the partners follow by arithmetic and an equi join
    takes the place of a comparison of all pairs.
    """
    slim = parts.select("doc_id", "ordinal")
    wanted = F.array_distinct(F.concat(F.sequence(F.lit(0), F.lit(opening - 1)), F.sequence(F.col("ordinal") - near, F.col("ordinal") + near)))
    asked = slim.withColumn("other", F.explode(wanted)).filter("other != ordinal")
    return asked.join(slim.withColumnRenamed("ordinal", "other"), ["doc_id", "other"], "left_semi").select("doc_id", "ordinal", "other")
