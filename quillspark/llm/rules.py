"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule rejects texts whose statistic is above a cutoff. Cutoffs come from labelled
rows: in each stratum (language), among the good ones, the number that a cutoff would
reject must be so small that a share of false rejections above ``risk`` is refuted by an
exact binomial bound at level ``delta`` divided by all tests made (Bonferroni).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

_WORD_GAP = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Statistic of each rule -> cutoffs tried, from the strictest on; fixed before any label is seen.
RULES = {
    "symbol_share": [0.005, 0.01, 0.02, 0.05, 0.1, 0.3],
    "dup_line_share": [0.05, 0.1, 0.2, 0.3, 0.5],
    "repeat_word_share": [0.05, 0.1, 0.2, 0.3, 0.4],
    "capital_share": [0.05, 0.1, 0.2, 0.3, 0.5],
}
RISK, DELTA = 0.05, 0.05


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Struct ``row`` (all columns of ``docs``) and the counts of its whole text.

    Words are runs outside [\\x20\\x09-\\x0D]. ``repeat``: words in three-word windows found
    twice or more in the text. Windows are named by a 64-bit hash of three word hashes;
    sorted with their positions, equal neighbours are the repeated ones, and the words
    covered by sorted window positions p are the sum of min(3, next p - p). All within the
    row: no shuffle, O(n log n) in its words. Null texts count as empty.
    """
    docs = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("t"))
    t = F.col("t")
    trimmed = F.btrim(t, F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WORD_GAP))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    df = docs.withColumns(
        {
            "_h": F.transform(words, lambda w: F.xxhash64(w)),
            "word_chars": F.length(F.translate(t, _BLANKS, "")).cast("long"),
            "symbols": (F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))).cast("long"),
            "dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "lines": F.size(lines).cast("long"),
            "capitals": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long"),
        }
    )
    df = df.withColumn("words", F.size("_h").cast("long"))
    n = F.size("_h")
    windows = F.transform(
        F.arrays_zip(F.slice("_h", 1, F.greatest(n - 2, F.lit(0))).alias("a"), F.slice("_h", 2, F.greatest(n - 2, F.lit(0))).alias("b"), F.slice("_h", 3, F.greatest(n - 2, F.lit(0))).alias("c")),
        lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("w"), i.alias("p")),
    )
    df = df.withColumn("_win", F.when(n >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<struct<w:bigint,p:int>>")))
    m = F.size("_win")
    beside = F.arrays_zip(F.col("_win").alias("x"), F.concat(F.array(F.lit(None).cast("struct<w:bigint,p:int>")), F.slice("_win", 1, F.greatest(m - 1, F.lit(0)))).alias("y"), F.slice("_win", 2, F.greatest(m, F.lit(1))).alias("z"))
    twice = F.filter(beside, lambda r: F.coalesce(r["x"]["w"] == r["y"]["w"], F.lit(False)) | F.coalesce(r["x"]["w"] == r["z"]["w"], F.lit(False)))
    df = df.withColumn("_at", F.when(m > 1, F.sort_array(F.transform(twice, lambda r: r["x"]["p"]))).otherwise(F.array().cast("array<int>")))
    k = F.size("_at")
    gaps = F.zip_with(F.slice("_at", 1, F.greatest(k - 1, F.lit(0))), F.slice("_at", 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
    df = df.withColumn("repeat", F.when(k == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, g: s + g)).cast("long"))
    share = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1)))
    stats = [F.col(c) for c in ("words", "word_chars", "symbols", "dup_lines", "repeat")] + [
        ((F.col("words") < 50) | (100 * F.col("repeat") > 50 * F.col("words"))).alias("base_failed"),
        share("symbols", "word_chars").alias("symbol_share"),
        share("dup_lines", "lines").alias("dup_line_share"),
        share("repeat", "words").alias("repeat_word_share"),
        share("capitals", "word_chars").alias("capital_share"),
    ]
    # a generator of one row keeps later predicates from being copied into the long expressions above
    return df.select("row", F.inline(F.array(F.struct(*stats))))


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k) for k <= n p, exactly, as a sum down from its largest term."""
    odds = math.log(p) - math.log1p(-p)
    start = F.struct(F.lit(0.0).alias("log_top"), F.lit(0.0).alias("tail"))
    # one pass over 1..k: ln C(n, i) grows, and the tail of smaller terms is rescaled to the newest
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))

    def add(acc: Column, i: Column) -> Column:
        ratio = F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct((acc["log_top"] + ratio).alias("log_top"), ((acc["tail"] + 1.0) * F.exp(-ratio)).alias("tail"))

    s = F.aggregate(steps, start, add)
    return n * F.lit(math.log1p(-p)) + s["log_top"] + F.log1p(s["tail"])


def cutoffs(stats: DataFrame, good: Column, stratum: str = "stratum", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Strictest certified cutoff of each rule in each stratum, null where none is.

    ``stats`` holds the statistics of labelled rows that the base keeps, ``good`` marks
    those that must not be rejected. Each rule may falsely reject ``risk`` / number of rules
    of a stratum's good rows, so that all rules together stay within ``risk``. A cutoff is
    certified if seeing so few rejected has a chance of at most ``delta`` / (strata x
    cutoffs) under a larger share; with chance 1 - delta all certified cutoffs hold at once.
    One row per stratum leaves the pre-aggregation; the tests are as many as the grid.
    """
    each = risk / len(RULES)
    grid = [(r, c) for r, cs in RULES.items() for c in cs]
    counted = stats.where(good).groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col(r) > c).cast("long")).alias(f"k{i}") for i, (r, c) in enumerate(grid)])
    counted = staged(counted, "counted")  # read twice below
    tests = counted.select(stratum, "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(grid)])).alias("x"))
    m = tests.groupBy().agg(F.count(F.lit(1)).alias("m"))
    ok = tests.crossJoin(m).where((F.col("x.k") <= F.col("n") * each) & (log_binomial_cdf(F.col("x.k"), F.col("n"), each) <= F.log(F.lit(delta) / F.col("m"))))
    return ok.groupBy(stratum).agg(*[F.min(F.when(F.col("x.rule") == r, F.col("x.cutoff"))).alias(f"most_{r}") for r in RULES])


def _verdict(stats: DataFrame, most: DataFrame) -> DataFrame:
    fits = ~F.col("base_failed")
    for r in RULES:
        fits = fits & (F.col(r) <= F.coalesce(F.col(f"most_{r}"), F.lit(1e9)))
    most = most.withColumnRenamed("stratum", "of")
    return stats.join(most, F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn("kept", fits).drop("of")


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Good labelled rows; a doc_id labelled more than once is good only if all say so."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q")).where(F.col("_q") == 1)
    return stats.join(good, stats["doc_id"] == good["_id"], "left_semi").where(~F.col("base_failed"))


def assess(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts, statistics, cutoffs and verdict of every row.

    A row is kept if it has 50 words or more, at most half of them in repeated three-word
    windows, and no statistic above its stratum's cutoff. Strata with too few labels get no
    cutoff (nothing is certified); a null stratum is one of its own. Null and empty texts
    fail the base; null keys have no label; repeated rows each give a row; a table without
    labels gives the base's verdict. The statistics are written once to the shared folder,
    so the texts are read once.
    """
    s = text_stats(docs.select(docs[key].cast("long").alias("doc_id"), docs[stratum].cast("string").alias("stratum"), docs[text].alias("text")))
    stats = staged(s.select("row.doc_id", "row.stratum", *[c for c in s.columns if c != "row"]), "rule_stats")
    most = cutoffs(_labelled(stats, labels), F.lit(True), risk=risk, delta=delta)
    return _verdict(stats, most)


def kept_rows(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns.

    Rows and their statistics are written once to the shared folder: the cutoffs read the
    statistics of labelled keys from there, without the texts, and the verdict filters the
    rows. No text is looked at twice, and none is shuffled.
    """
    s = staged(text_stats(docs, text).withColumns({"doc_id": F.col("row")[key].cast("long"), "stratum": F.col("row")[stratum].cast("string")}), "rule_rows")
    most = staged(cutoffs(_labelled(s.drop("row"), labels), F.lit(True), risk=risk, delta=delta), "cutoffs")
    return _verdict(s, most).where("kept").select("row.*")


def oracle_sql() -> str:
    """Counts and verdicts of ``documents`` in DuckDB SQL; the binomial bound by log-gamma."""
    each = RISK / len(RULES)
    grid = ", ".join(f"('{r}', {c})" for r, cs in RULES.items() for c in cs)
    least = ", ".join(f"min(cutoff) FILTER (rule = '{r}') AS most_{r}" for r in RULES)
    fits = " AND ".join(f"{r} <= coalesce(most_{r}, 1e9)" for r in RULES)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({each}) + (n - i) * ln(1 - {each}))"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE c > 1) GROUP BY r),
b AS (SELECT d.r, doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(translate(t, '{_SYMBOLS}', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS capitals FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_share,
  n_dup_lines / greatest(lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_word_share, capitals / greatest(word_chars, 1) AS capital_share FROM b),
good AS (SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
tests AS (SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER ({value} > cutoff) AS k FROM good, (VALUES {grid}) v(rule, cutoff) GROUP BY lang, rule, cutoff),
passed AS (SELECT lang, rule, cutoff FROM tests WHERE k <= n * {each}
  AND (SELECT sum({term}) FROM (SELECT unnest(range(CAST(k + 1 AS BIGINT))) AS i)) <= {DELTA} / (SELECT count(*) FROM tests)),
most AS (SELECT lang, {least} FROM passed GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {fits} AS kept
FROM s LEFT JOIN most ON s.lang IS NOT DISTINCT FROM most.lang"""
