"""Queries p4 and p7 to p9 over whole tables and texts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.leakage import leaked_items
from tidelog.llm.subjects import document_subjects
from tidelog.llm.tokenize import encode_corpus
from tidelog.llm.topk import frequent_items

VOCABULARY = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "byte_bpe_50k.json")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _items(log: DataFrame) -> DataFrame:
    """Every argument of every row with a command: ``(command, arg_pos, item)``."""
    return log.where("command IS NOT NULL").select("command", F.posexplode("arguments").alias("arg_pos", "item")).where("item IS NOT NULL")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Arguments on at least 0.5 % of all rows, by command and position."""
    log = _table(spark, d, "wal_log")
    least = -(-log.count() // 200)
    return frequent_items(_items(log), ["command", "arg_pos", "item"], at_least=least).select("command", "arg_pos", F.hex("item").alias("item_hex"))


def p4_top100(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent arguments with their counts; all that tie with the last."""
    return frequent_items(_items(_table(spark, d, "wal_log")), ["command", "arg_pos", "item"], k=100).select("command", "arg_pos", F.hex("item").alias("item_hex"), F.col("n"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(_table(spark, d, "documents"), VOCABULARY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items of which at least ten consecutive words stand in them."""
    return leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of which tiles cover at least half of the item, with the coverage."""
    return leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items"), min_coverage=0.5).select("doc_id", "item_id", "longest", "coverage")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Subjects to which at least a quarter of a document's body is devoted."""
    return document_subjects(*(_table(spark, d, t) for t in ("documents", "subject_labels", "subjects"))).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject: documents on each and their body's mean share of it."""
    out = document_subjects(*(_table(spark, d, t) for t in ("documents", "subject_labels", "subjects")))
    return out.groupBy("subject").agg(F.count("*").alias("documents"), F.avg("share").alias("mean_share"))


QUERIES = {f.__name__: f for f in (p4_found, p4_top100, p7_ids, p8_found, p8_coverage, p9_found, p9_composition)}

_GRAMS = r"""SELECT DISTINCT {id}, w[i:i + 9] AS gram FROM (
 SELECT {id}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {id}, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{Nd}}]+'), lambda x: lower(x)) AS w FROM {table}))"""

_ITEMS = """SELECT command, CAST(arg_pos AS INTEGER) AS arg_pos, item FROM (
  SELECT command, unnest(arguments) AS item, unnest(range(len(arguments))) AS arg_pos FROM wal_log WHERE command IS NOT NULL)
 WHERE item IS NOT NULL"""

# What ten words shared in a row cover of an item, from all shared windows. Tiles, which do not overlap, cover the same unless
# passages of an item compete for the same words of a page.
_SHARED = r"""WITH words AS (SELECT {id}, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{Nd}}]+'), lambda x: lower(x)) AS w FROM {table}),
 places AS (SELECT {id}, w, len(w) AS size, unnest(range(1, len(w) - 8)) AS spot FROM words)
SELECT {id}, size, spot, w[spot:spot + 9] AS gram FROM places"""

SQL = {
    "p4_found": f"""SELECT command, arg_pos, hex(item) AS item_hex FROM ({_ITEMS}) GROUP BY ALL
HAVING count(*) * 200 >= (SELECT count(*) FROM wal_log)""",
    "p4_top100": f"""SELECT command, arg_pos, item_hex, n FROM (
 SELECT command, arg_pos, hex(item) AS item_hex, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS place FROM ({_ITEMS}) GROUP BY 1, 2, 3) WHERE place <= 100""",
    "p8_found": f"""SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(id='doc_id', table='documents')}) d
JOIN ({_GRAMS.format(id='item_id', table='eval_items')}) e USING (gram)""",
    "p8_coverage": f"""WITH met AS (SELECT DISTINCT d.doc_id, e.item_id, d.spot AS i, e.spot AS j, e.size FROM ({_SHARED.format(id='doc_id', table='documents')}) d
  JOIN ({_SHARED.format(id='item_id', table='eval_items')}) e USING (gram)),
 runs AS (SELECT doc_id, item_id, count(*) + 9 AS words FROM (
   SELECT *, j - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY j) AS island FROM met) GROUP BY doc_id, item_id, i - j, island),
 covered AS (SELECT doc_id, item_id, size, count(DISTINCT p) AS n FROM (SELECT doc_id, item_id, size, unnest(range(j, j + 10)) AS p FROM met) GROUP BY 1, 2, 3)
SELECT doc_id, item_id, CAST(max(words) AS INTEGER) AS longest, any_value(n) / any_value(size) AS coverage
FROM covered JOIN runs USING (doc_id, item_id) WHERE n / size >= 0.5 GROUP BY 1, 2""",
}
