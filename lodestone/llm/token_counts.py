"""Token counts of whole texts under a SentencePiece BPE model, huge texts in overlapping chunks.

A text of up to `CHUNK` characters is encoded at once. A longer one is cut at every
`CHUNK` characters into chunks that run `OVERLAP` characters into the next one; Spark
deals the chunks, so a huge text is no single task. Each chunk is encoded with the
offsets of its tokens. In the overlap of two chunks the first boundary that is proven
stable and that both encodings have is the splice: what stands before it counts in
the left chunk, what stands after it in the right one. Documents in which an overlap
holds no such boundary are cut anew with chunks and overlaps `WIDEN` times as long,
until all their overlaps align, in the end as one chunk.

A boundary is proven stable where no piece of the vocabulary has the two characters
around it side by side. BPE only ever joins two symbols into a piece, so no merge can
cross that place, whatever stands around it, and merges on its two sides do not
depend on each other. A chunk's own start is marked as a start of text, which can
change its tokens up to its first stable boundary; those are counted twice, once
added and once taken off. Needs a model that leaves characters as they are
(identity normalisation, white space kept) and that spells unknown ones in bytes.

Defined results: a null or empty text has 0 tokens and bytes; rows that repeat each
get their count; null ids stay; an empty table gives an empty result; columns that
clash with `n_bytes` and `n_tokens` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MODEL = "piece_bpe_32k.model"
CHUNK = 32_768
OVERLAP = 512
WIDEN = 8
#: Tokens beyond which a text is over the limit of the query.
LIMIT = 4096
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A model with what chunks need: characters a token covers, and pairs that a piece can hold."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.model.vocab_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        of_bytes = [self.model.is_byte(i) for i in ids]
        # of a character's bytes the first counts, the others stand within it
        self.covers = np.array([(0 if 0x80 <= int(p[3:5], 16) < 0xC0 else 1) if b else len(p) for p, b in zip(pieces, of_bytes, strict=True)])
        self.pairs = {p[k : k + 2] for p, b in zip(pieces, of_bytes, strict=True) if not b for k in range(len(p) - 1)}

    def count(self, texts: list[str]) -> list[int]:
        return [len(self.model.encode(t, num_threads=1)) for t in texts]

    def ends(self, text: str) -> np.ndarray:
        """For each token of `text`, the characters up to its end; those of the mark of the start are left out."""
        return np.cumsum(self.covers[self.model.encode(text, num_threads=1)]) - 1

    def splice(self, text: str, ends: np.ndarray, after: int, upto: int, whole: bool) -> tuple[int, int] | None:
        """The first proven boundary in (after, upto] of a chunk's text that is a boundary of its tokens, with the
        number of tokens before it; the end of a document (`whole`: the chunk reaches it) is one."""
        for at in range(after + 1, min(upto, len(text)) + 1):
            if at == len(text):
                if not whole:
                    break
            elif text[at - 1 : at + 1].replace(" ", SPACE) in self.pairs:
                continue
            n = int(np.searchsorted(ends, at, side="right"))
            if n and ends[n - 1] == at:
                return at, n
        return None


def _counter(model: Broadcast) -> Callable:
    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(model.value)
        for t in texts:
            yield pd.Series(encoder.count(t.tolist()), index=t.index)

    return n_tokens


def _cut(chunk: int, overlap: int) -> Callable:
    """Chunks of texts: text_key, part (its number), last, and body with its overlap."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["text_key"], batch["body"], strict=True):
                n = -(-len(text) // chunk)
                for k in range(n):
                    yield pd.DataFrame({"text_key": [key], "part": [k], "last": [k == n - 1], "body": [text[k * chunk : (k + 1) * chunk + overlap + 1]]})

    return cut


#: Of the two sides of a splice `left` tells which; a text's last chunk gives its tokens as a splice without an offset.
SIDES = "text_key string, part int, left boolean, at long, tokens long"


def _encode(model: Broadcast, chunk: int, overlap: int) -> Callable:
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model.value)
        for batch in batches:
            out = []
            for key, part, last, text in zip(batch["text_key"], batch["part"], batch["last"], batch["body"], strict=True):
                ends = encoder.ends(text)
                base = part * chunk
                whole = last or len(text) < chunk + overlap + 1  # the text ends within this chunk's overlap
                if part:
                    found = encoder.splice(text, ends, 0, overlap, whole)
                    out.append((key, part, False, *((base + found[0], found[1]) if found else (None, None))))
                if last:
                    out.append((key, part + 1, True, None, len(ends)))
                else:
                    found = encoder.splice(text, ends, chunk, chunk + overlap, whole)
                    out.append((key, part + 1, True, *((base + found[0], found[1]) if found else (None, None))))
            yield pd.DataFrame(out, columns=["text_key", "part", "left", "at", "tokens"]).astype({"at": "Int64", "tokens": "Int64"})

    return encode


def _long_counts(long: DataFrame, model: Broadcast, chunk: int, overlap: int) -> DataFrame:
    """text_key and n_tokens of the texts of `long` (text_key, body), once for texts that repeat."""
    done, open_ = None, long
    while True:
        chunks = open_.mapInPandas(_cut(chunk, overlap), "text_key string, part int, last boolean, body string")
        dealt = chunks.dropDuplicates(["text_key", "part"])  # deals the chunks, and one of equal texts goes on
        sides = dealt.mapInPandas(_encode(model, chunk, overlap), SIDES)
        splice = sides.groupBy("text_key", "part").agg(
            F.count(F.lit(1)).alias("n_sides"), F.min("at").alias("least"), F.max("at").alias("most"), F.count("at").alias("n_at"),
            F.sum(F.when(F.col("left"), F.col("tokens")).otherwise(-F.col("tokens"))).alias("tokens"),
        )
        aligned = (F.col("n_sides") == 1) | ((F.col("n_at") == 2) & (F.col("least") == F.col("most")))
        texts = C.durable(splice.groupBy("text_key").agg(F.min(aligned).alias("aligned"), F.sum("tokens").alias("n_tokens")))
        found = texts.filter("aligned").select("text_key", "n_tokens")
        done = found if done is None else done.unionByName(found)
        failed = texts.filter("not aligned").select("text_key")
        if failed.isEmpty():
            return done
        open_ = long.join(failed, "text_key", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def token_counts(docs: DataFrame, model: str | None = None, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`docs` with `n_bytes` (UTF-8) and `n_tokens` of its texts under the model file at `model`."""
    with open(model or model_path(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    names = C.without(docs, "n_bytes", "n_tokens").columns
    body = C.text_or_empty(F.col(f"`{text}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), body.alias("body"))
    is_long = F.length("body") > chunk
    short = rows.filter(~is_long).select("row", F.octet_length("body").cast("long").alias("n_bytes"), _counter(sent)("body").alias("n_tokens"))
    long = rows.filter(is_long).withColumn("text_key", F.sha2(F.col("body").cast("binary"), 256))
    counts = _long_counts(long.select("text_key", "body"), sent, chunk, overlap)
    counted = long.select("row", F.octet_length("body").cast("long").alias("n_bytes"), "text_key").join(counts, "text_key", "left")
    every = short.unionByName(counted.drop("text_key"))
    return every.select(*[F.col("row")[c].alias(c) for c in names], "n_bytes", "n_tokens")


def query(docs: DataFrame) -> DataFrame:
    counted = token_counts(docs.select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
