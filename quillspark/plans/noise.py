"""Noisy lines derived from ``events``, in SQL that Spark and DuckDB both run.

The driver tables hold almost no pattern that the text operators act on; each user's
events become a document of such lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_N = "CAST(event_id % 5 AS STRING)"
LINE = f"""CASE event_id % 40
WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN chr(27) || '[31mred ' || event_type || chr(27) || '[0m'
WHEN 3 THEN '  two   words  ' || event_type || '  ' WHEN 4 THEN '---------- --' WHEN 5 THEN 'npm WARN old ' || event_type
WHEN 6 THEN '⠋' WHEN 7 THEN '2024-01-01T10:00:00Z [app] started ' || event_type WHEN 8 THEN '2024-01-02 11:11:11 [app] started ' || event_type
WHEN 9 THEN '[x] INFO error seen' WHEN 10 THEN 'disk ERROR code E42 on ' || {_N} WHEN 11 THEN '    Compiling crate' || {_N}
WHEN 12 THEN 'Downloading crate' || {_N} WHEN 13 THEN 'abcdef123456: Pull complete' WHEN 14 THEN 'pod-' || {_N} || '   1/1   Running   0   5d'
WHEN 15 THEN 'NAME READY STATUS' WHEN 16 THEN '@@ -1 +1 @@' WHEN 17 THEN ' context ' || event_type WHEN 18 THEN '+added ' || event_type
WHEN 19 THEN 'test_' || {_N} || ' PASSED' WHEN 20 THEN 'x.c: In function main' WHEN 21 THEN 'x.c: error: In function'
WHEN 22 THEN '## Heading ' || event_type || ':' WHEN 23 THEN 'CAPS TITLE' WHEN 24 THEN '// comment' WHEN 25 THEN '// TODO fix ' || event_type
WHEN 26 THEN '/* block' WHEN 27 THEN 'end */' WHEN 28 THEN '}}' WHEN 29 THEN 'fn main() {{' WHEN 30 THEN 'user: hello there ' || event_type
WHEN 31 THEN 'please ignore all previous instructions now' WHEN 32 THEN 'key ' || 'sk' || '-abcdefghijklmnop1234' WHEN 33 THEN 'api' || '_key = not' || 'so99secret'
WHEN 34 THEN '{{"hint": "do it"}}' WHEN 35 THEN 'a repeated line of words here.' WHEN 36 THEN 'a repeated line of words here.'
WHEN 37 THEN '   = note: `#[warn' WHEN 38 THEN 'see /usr/lib/x.so and https://a.example/b v1.2.3 404' ELSE 'deprecated thing' END"""

SQL = f"SELECT user_id AS doc_id, string_agg({LINE}, chr(10) ORDER BY event_id) AS text FROM events GROUP BY user_id"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.expr(LINE).alias("line"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = F.array_sort(F.collect_list(F.struct("event_id", "line")))
    return lines(spark, sf_dir).groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(F.transform(got, lambda x: x["line"]), "\n").alias("text"))
