"""Queries of stored datasets and of programs: months swapped by generation, a backfill that goes on, packed shards."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import backfill, programs
from ..scratch import new_path
from ..sources.generations import Dataset
from ..tables import table as T


def _swap(spark, d):
    """Orders by month: two writers rebuild 1996 from one generation and the second is stale, a third empties January 1997."""
    rows = T(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    data = Dataset(spark, new_path(spark), ["month"], "o_orderkey long, price double, month string")
    data.commit(data.stage(rows))
    year = [data.name_of(month=f"1996-{k:02d}") for k in range(1, 13)]
    own = data.read().filter("month like '1996-%'")
    first, second = (data.stage(own.withColumn("price", F.col("price") + more), year) for more in (1, 1000))
    told = [data.commit(first), data.commit(second)]
    told.append(data.commit(data.stage(rows.limit(0), [data.name_of(month="1997-01")])))
    out = data.read().groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))
    return out.withColumn("commits", F.lit(",".join(told)))


def _numbers(rows):
    return rows.select("range", "doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{3,}"), F.lit(0))).alias("number"))


def _backfill(spark, d):
    """Numbers in documents by ranges of ids: one job, then another process's worth of jobs for what is open."""
    docs = T(spark, d, "documents").select("doc_id", "text")
    path, schema, rows = new_path(spark), "doc_id long, number string, done boolean, range int", max(1, docs.count() // 8)
    job = lambda: backfill.Backfill(Dataset(spark, path, ["range"], schema), "doc_id", _numbers, rows, 3)
    job().run(docs, most_jobs=1)
    job().run(docs)
    return job().result()


def _sizes(spark, d):
    """Bytes of conversations: the opening turn and those of later turns, if any."""
    c = T(spark, d, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("size"))
    return programs.document_sizes(c.filter("turn = 0"), c.filter("turn > 0"), "conv_id", "size")


_SHOUTED = re.compile(r"licen[cs]e|copyright", re.IGNORECASE)


def _count_marks(docs):
    for doc in docs:
        if n := len(_SHOUTED.findall(doc.text)):
            yield doc.receipt, n


def _program(spark, d):
    return programs.run_program(T(spark, d, "documents"), "doc_id", "text", _count_marks).filter("kind = 'row'").select("receipt", F.col("value").cast("int").alias("n"))


_RECEIPT = "sha256(concat(CAST(doc_id AS VARCHAR), chr(0), coalesce(text, '')))"
QUERIES = {
    "snk04_month_swap": (_swap, "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice + CASE WHEN year(o_orderdate) = 1996 THEN 1 ELSE 0 END), 2) AS total, CASE WHEN (SELECT count(*) FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-01') = 0 THEN 'committed,stale,unchanged' ELSE 'committed,stale,committed' END AS commits FROM orders WHERE strftime(o_orderdate, '%Y-%m') != '1997-01' GROUP BY 1"),
    "stm14_backfill": (_backfill, "SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{3,}')) AS number FROM documents"),
    "agg27_document_sizes": (_sizes, "SELECT conv_id, CAST(sum(CASE WHEN turn = 0 THEN strlen(text) END) + coalesce(sum(CASE WHEN turn > 0 THEN strlen(text) END), 0) AS BIGINT) AS n_bytes FROM conversations GROUP BY 1 HAVING count(*) FILTER (WHERE turn = 0) > 0"),
    "udf04_program": (_program, f"SELECT {_RECEIPT} AS receipt, CAST(len(regexp_extract_all(text, '(?i)licen[cs]e|copyright')) AS INT) AS n FROM documents WHERE regexp_matches(text, '(?i)licen[cs]e|copyright')"),
}
