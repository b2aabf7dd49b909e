"""Session transcripts as JSON lines: incremental discovery, parsing, items, exports."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import jsonl

MOST_INPUT, MOST_OUTPUT = 2048, 4096


def discover(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, length, modified and fingerprint (ends of the content, and its size) of the files below `root`.

    Of each file at most 8 KiB are read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    named = files.select("path", "length", F.col("modificationTime").alias("modified"))

    def ends(batches):
        for batch in batches:
            prints = []
            for path, size in zip(batch["path"], batch["length"], strict=True):
                system, place = jsonl.opened(unquote(path))
                with system.open_input_file(place) as file:
                    prints.append(jsonl.fingerprint(file, size))
            yield batch.assign(fingerprint=prints)

    return named.mapInPandas(ends, "path string, length long, modified timestamp, fingerprint string")


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and change of each file of two manifests: new, unchanged, grown, rewritten or gone."""
    a, b = before.alias("a"), now.alias("b")
    met = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    change = (
        F.when(F.col("a.path").isNull(), "new").when(F.col("b.path").isNull(), "gone").when(F.col("a.fingerprint") == F.col("b.fingerprint"), "unchanged")
        .when(F.col("b.length") > F.col("a.length"), "grown").otherwise("rewritten")
    )
    return met.select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change"))


def json_lines(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """path, line (the place of its first byte), raw, record and bad of each line; a last line without an end is left out.

    Files are read in ranges, long ones by several tasks. Records that do not parse are
    kept as `raw`, so they can go to a side table.
    """
    lines = jsonl.lines(spark, path, **options).filter("start is not null")
    return jsonl.parsed(lines.select("path", F.col("start").alias("line"), "raw"), schema)


def file_status(lines: DataFrame) -> DataFrame:
    """path, n_lines, n_bad and status: error where more than half of the lines are bad."""
    got = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("bad").cast("int")).alias("n_bad"))
    return got.withColumn("status", F.when(F.col("n_bad") * 2 > F.col("n_lines"), "error").otherwise("ok"))


FORMAT_A = "type string, timestamp string, cwd string, gitBranch string, message struct<content: string>"
BLOCKS = "array<struct<type: string, text: string, name: string, input: string, content: string>>"
FORMAT_B = "timestamp string, type string, payload struct<type: string, cwd: string, role: string, content: string, name: string, arguments: string, output: string>"


def items_a(lines: DataFrame) -> DataFrame:
    """path, line, at, surface and text of format A: a message is a string or typed blocks; thinking is dropped."""
    content = F.col("record.message.content")
    blocks = F.when(F.startswith(F.trim(content), F.lit("[")), F.from_json(content, BLOCKS)).otherwise(F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("name", "input", "content")])))
    said = lines.filter(~F.col("bad") & F.col("record.type").isin("user", "assistant")).select("path", "line", F.try_to_timestamp(F.col("record.timestamp")).alias("at"), F.col("record.type").alias("role"), F.posexplode(blocks).alias("block", "b"))
    kind = F.col("b.type")
    surface = F.when(kind == "text", F.col("role")).when(kind == "tool_use", "tool_input").when(kind == "tool_result", "tool_output")
    text = F.when(kind == "text", F.col("b.text")).when(kind == "tool_use", F.concat_ws(" ", "b.name", F.substring("b.input", 1, MOST_INPUT))).when(kind == "tool_result", F.substring("b.content", 1, MOST_OUTPUT))
    return said.select("path", "line", "block", "at", surface.alias("surface"), text.alias("text")).filter("surface is not null and text is not null")


def items_b(lines: DataFrame) -> DataFrame:
    """path, line, at, surface and text of format B: messages of typed parts, calls and their outputs."""
    p = F.col("record.payload")
    parts = F.when(F.startswith(F.trim(p["content"]), F.lit("[")), F.array_join(F.transform(F.from_json(p["content"], "array<struct<text: string>>"), lambda x: x["text"]), "\n")).otherwise(p["content"])
    kind = p["type"]
    surface = F.when(kind == "message", p["role"]).when(kind == "function_call", "tool_input").when(kind == "function_call_output", "tool_output")
    text = F.when(kind == "message", parts).when(kind == "function_call", F.concat_ws(" ", p["name"], F.substring(p["arguments"], 1, MOST_INPUT))).when(kind == "function_call_output", F.substring(p["output"], 1, MOST_OUTPUT))
    said = lines.filter(~F.col("bad") & (F.col("record.type") == "response_item"))
    return said.select("path", "line", F.try_to_timestamp(F.col("record.timestamp")).alias("at"), surface.alias("surface"), text.alias("text")).filter("surface is not null and text is not null")


EXPORT = """array<struct<id: string, title: string, mapping: map<string, struct<id: string, parent: string,
 message: struct<id: string, author: struct<role: string>, create_time: double, content: struct<content_type: string, parts: array<string>>>>>>>"""


def export_messages(exports: DataFrame, column: str = "value") -> DataFrame:
    """conversation, message, parent message, role, at and text of conversation exports, a tree of nodes each."""
    talks = exports.select(F.explode(F.from_json(column, EXPORT)).alias("c"))
    nodes = talks.select(F.col("c.id").alias("conversation"), F.col("c.mapping").alias("m"), F.explode("c.mapping").alias("node", "v"))
    message = F.col("v.message")
    return nodes.filter("v.message is not null").select(
        "conversation", message["id"].alias("message"), F.col("m")[F.col("v.parent")]["message"]["id"].alias("parent"), message["author"]["role"].alias("role"),
        F.timestamp_seconds(message["create_time"]).alias("at"), F.array_join(message["content"]["parts"], "\n").alias("text"),
    )


CHAT_LINE = r"^\[?(\d{1,2}/\d{1,2}/\d{2,4}),? (\d{1,2}:\d{2}(?::\d{2})?)\]? (?:- )?([^:]+): (.*)$"


def chat_export(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, n, day, time, author and text of a chat export; lines without a date continue the message above."""
    starts = F.col(text).rlike(CHAT_LINE)
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("n", F.sum(starts.cast("int")).over(w)).filter("n > 0")
    body = F.when(starts, F.regexp_extract(text, CHAT_LINE, 4)).otherwise(F.col(text))
    of = lambda g: F.max(F.when(starts, F.regexp_extract(text, CHAT_LINE, g)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), body.alias("t")))), lambda x: x["t"]), "\n")
    return marked.groupBy(key, "n").agg(of(1).alias("day"), of(2).alias("time"), of(3).alias("author"), joined.alias("text"))


def browser_visits(visits: DataFrame, urls: DataFrame, epoch: str) -> DataFrame:
    """url, title and visited_at of visits (url_id, visit_time) by urls (id, url, title); `epoch` is unix, webkit or apple."""
    t: Column = F.col("visit_time")
    # Seconds from the unix epoch back to 1601 and forward to 2001.
    us = {"unix": t * 1_000_000, "webkit": t - 11_644_473_600 * 1_000_000, "apple": ((t + 978_307_200) * 1_000_000).cast("long")}[epoch]
    return visits.join(urls, visits["url_id"] == urls["id"]).select("url", "title", F.timestamp_micros(us.cast("long")).alias("visited_at"))
