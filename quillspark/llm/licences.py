"""Licence scans by lookup of canonical text digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licence_texts
from .common import staged

#: White space, punctuation and symbols but the line break, as a class body for Java and RE2 alike.
MARKS = r"\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f\xa0-\xbf"
#: A line that only states who holds the copyright, in lower case: "copyright" (after marks of a
#: comment) goes on with the sign, a year, a placeholder or "by", so that wrapped sentences about
#: copyright notices and list items "(c)" are none.
COPYRIGHT_LINE = rf"[{MARKS}]*(copyright[ \t:]*(\(c\)|\xa9|[0-9<\[{{]|by[ \t])|\(c\)[ \t]*(copyright|[0-9])|\xa9)[^\n]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """Lower case, no copyright lines, two blanks around every word, one spelling; line breaks stay."""
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    t = F.regexp_replace(F.concat(F.lit("\n"), t), rf"\n{COPYRIGHT_LINE}", "\n")
    t = F.concat(F.replace(F.regexp_replace(t, rf"[{MARKS}]+", "  "), F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    for found, kept in licence_texts.SPELLINGS.items():
        t = F.replace(t, F.lit(f" {found} "), F.lit(f" {kept} "))
    return t


def _joined(words: Column) -> Column:
    """The words of ``_words`` without line breaks, with phrases as one, parted by single blanks."""
    t = F.regexp_replace(words, "[ \n]+", "  ")
    for found, kept in licence_texts.PHRASES.items():
        t = F.replace(t, F.lit(f" {found.replace(' ', '  ')} "), F.lit(f" {kept} " if kept else ""))
    return F.btrim(F.regexp_replace(t, " +", " "))


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no punctuation, one spelling, single blanks, however lines are wrapped."""
    return _joined(_words(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession) -> DataFrame:
    """Licence, kind and digest of all known texts and notices: a fixed table of some hundreds."""
    df = spark.createDataFrame(licence_texts.known(), "licence string, kind string, text string, digest string")
    return df.select("licence", "kind", F.when(F.col("digest") == "", digest(F.col("text"))).otherwise(F.col("digest")).alias("digest"))


def scan(docs: DataFrame, licences: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Find texts that are a known licence, and lines that are a known notice.

    ``licences`` has licence, kind (text, notice) and digest; of several licences with one
    digest the first by name counts. Returns doc_id, digest (of the whole canonical text),
    licence (whose text the document is, or null) and notices (licences named by whole
    lines, sorted, comma-separated, or null).

    Every text gives the digest of its whole and those of its different lines; all of them
    meet the known digests in one hash join, of which Spark broadcasts the known side only
    while its measured size is under its own limit. What has found nothing ends there, so
    little more than a row per text is shuffled, and the texts are read once.

    Null, empty and punctuation-only texts share the digest of the empty text and match
    nothing; repeated rows each give a row; null keys stay; an empty table gives an empty
    one; other columns are ignored.
    """
    empty = F.sha2(F.lit(""), 256)
    licences = known(docs.sparkSession) if licences is None else licences
    # written, so that its size is known when the join is planned and lines need no shuffle to find out
    licences = staged(licences.where(F.col("digest") != empty).groupBy("kind", "digest").agg(F.min("licence").alias("licence")).coalesce(1), "known")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].cast("long").alias("doc_id"), F.inline(F.array(F.struct(_words(docs[text]).alias("words")))))
    mark = lambda kind, d: F.struct(F.lit(kind).alias("kind"), d.alias("digest"))
    lines = F.filter(F.array_distinct(F.transform(F.split("words", "\n"), _joined)), lambda x: x != "")
    marks = F.concat(F.array(mark("text", F.sha2(_joined(F.col("words")), 256))), F.transform(lines, lambda x: mark("notice", F.sha2(x, 256))))
    found = rows.select("row", "doc_id", F.inline(marks)).join(licences, ["kind", "digest"], "left").where((F.col("kind") == "text") | F.col("licence").isNotNull())
    whole = F.col("kind") == "text"
    got = found.groupBy("row", "doc_id").agg(F.max(F.when(whole, F.col("digest"))).alias("digest"), F.max(F.when(whole, F.col("licence"))).alias("licence"), F.array_sort(F.collect_set(F.when(~whole, F.col("licence")))).alias("notices"))
    return got.select("doc_id", "digest", "licence", F.when(F.size("notices") > 0, F.array_join("notices", ",")).alias("notices"))


def oracle_sql() -> str:
    """The scan of ``documents`` in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def words(x: str) -> str:
        t = f"translate(coalesce({x}, ''), '{_UPPER}', '{_LOWER}')"
        t = f"regexp_replace(chr(10) || {t}, '\\n{COPYRIGHT_LINE}', chr(10), 'g')"
        t = f"replace(regexp_replace({t}, '[{MARKS}]+', '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || '  '"
        for found, kept in licence_texts.SPELLINGS.items():
            t = f"replace({t}, ' {found} ', ' {kept} ')"
        return t

    def joined(x: str) -> str:
        t = f"regexp_replace({x}, '[ \\n]+', '  ', 'g')"
        for found, kept in licence_texts.PHRASES.items():
            t = f"replace({t}, ' {found.replace(' ', '  ')} ', '{f' {kept} ' if kept else ''}')"
        return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"

    values = ", ".join(f"({q(k)}, {q(kind)}, {q(t)}, {q(d)})" for k, kind, t, d in licence_texts.known())
    return f"""WITH given(licence, kind, t, d) AS (VALUES {values}),
known AS (SELECT kind, d, min(licence) AS licence FROM (SELECT licence, kind, CASE WHEN d = '' THEN sha256({joined(words("t"))}) ELSE d END AS d FROM given) WHERE d <> sha256('') GROUP BY kind, d),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents),
lines AS (SELECT r, unnest(string_split(w, chr(10))) AS line FROM docs),
noted AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM lines JOIN known ON kind = 'notice' AND sha256({joined("line")}) = d GROUP BY r),
whole AS (SELECT r, doc_id, sha256({joined("w")}) AS digest FROM docs)
SELECT doc_id, digest, known.licence, notices FROM whole
LEFT JOIN known ON kind = 'text' AND digest = d LEFT JOIN noted USING (r)"""
