"""Lexical and hybrid ranking: BM25 over a corpus or over a document's lines, vector blend, rerank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.shared import staged
from .compression import any_of

#: Ranking constants, stop words and technical tokens (fixed values).
K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}_\-./#]+"
STOP = "the and for with this that from into your have been were was are will can may not but all any out use using".split()
STATUS = "200 201 204 301 302 400 401 403 404 409 422 429 500 502 503 504".split()
SIGNALS = "error err warn warning fail failed failure panic fatal exception traceback errno".split()
TECH = [r"^v?\d+\.\d+(\.\d+)?([-+][a-z0-9.]+)?", r"^[0-9a-f]{7,40}$", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"/|::|#"]


#: Runs of token characters that can be tokens: two characters, or one that is not ASCII.
_RUN = r"[\p{L}\p{N}_\-./#]{2,}|[[\p{L}\p{N}]&&[^\x00-\x7f]]"


def tokens(t: Column) -> Column:
    """Tokens of two bytes or more in lower case, without stop words; the text is lowered once."""
    return F.filter(F.regexp_extract_all(tx.ascii_lower(F.coalesce(t, F.lit(""))), F.lit(_RUN), F.lit(0)), lambda x: ~x.isin(STOP))


def query_terms(query: str) -> list[str]:
    import regex

    low = [w.translate(str.maketrans(tx.UPPER, tx.LOWER)) for w in regex.findall(TOKEN, query)]
    return list(dict.fromkeys(w for w in low if len(w.encode()) >= 2 and w not in STOP))


def is_technical(t: Column) -> Column:
    return t.isin(STATUS + SIGNALS) | any_of(t.rlike(p) for p in TECH)


def _technical(word: str) -> bool:
    import re

    return word in STATUS + SIGNALS or any(re.search(p, word) for p in TECH)


def facts_of(toks: Column, terms: list[str]) -> Column:
    """Struct of a token array's length and of those tokens that can count for the terms.

    These are technical tokens, tokens that contain a term, and tokens that are part of one
    (a fixed set of its substrings): one pattern and one lookup for each token, once, while
    the filters of every term then see the few tokens left.
    """
    import re

    parts = sorted({q[i:j] for q in terms for i in range(len(q)) for j in range(i + 1, len(q) + 1) if len(q[i:j].encode()) >= 2})
    pattern = "|".join([*TECH, *(re.escape(q) for q in terms)])
    return F.struct(F.size(toks).alias("dl"), F.filter(toks, lambda x: x.isin(STATUS + SIGNALS + parts) | x.rlike(pattern)).alias("m"))


def counted(facts: Column, raw: Column, terms: list[str]) -> Column:
    """What a score needs of one text, in numbers: dl, count and soft count of each term, technical tokens, alarm."""
    m = facts["m"]
    tech = F.filter(m, is_technical)
    near = tech if any(_technical(q) for q in terms) else F.filter(tech, lambda x: any_of(x.contains(q) | F.lit(q).contains(x) for q in terms))
    exact = lambda q: F.size(F.filter(m, lambda x: x == q))
    soft = lambda q: F.size(F.filter(m, lambda x: x.contains(q) | F.lit(q).contains(x)))
    alarm = raw.rlike("(?i)ERROR|WARN|FAIL|PANIC")
    return F.struct(
        facts["dl"].alias("dl"),
        F.array(*[exact(q) for q in terms]).cast("array<int>").alias("f"),
        F.array(*[soft(q) for q in terms]).cast("array<int>").alias("soft"),
        F.size(F.filter(tech, lambda x: x.isin(terms))).alias("same"),
        F.least(F.size(near), F.lit(3)).alias("near"),
        F.coalesce(alarm, F.lit(False)).alias("alarm"),
    )


def score(x: Column, df: list[Column], n: Column, avgdl: Column) -> Column:
    """BM25 from a text's numbers, with half-weight substring matches, technical and alarm boosts."""
    norm = F.lit(K1) * (1 - B + B * x["dl"] / avgdl)
    idf = lambda d: F.log((n - d + 0.5) / (d + 0.5) + 1)
    total = F.lit(0.0)
    for i, d in enumerate(df):
        f, soft = F.get(x["f"], F.lit(i)), F.get(x["soft"], F.lit(i))
        exact = idf(d) * (f * (K1 + 1)) / (f + norm)
        part = idf(F.when(d > 0, d).otherwise(F.lit(1))) * (soft * (K1 + 1)) / (soft + norm) * 0.5
        total = total + F.when(f > 0, exact).when(soft > 0, part).otherwise(0.0)
    total = F.when((x["dl"] > 0) & (avgdl > 0), total).otherwise(0.0)
    total = total + F.when(x["same"] > 0, x["same"] * 1.5).otherwise(0.15 * x["near"])
    return total + F.when((total > 0) & x["alarm"], 0.35).otherwise(0.0)


def with_counts(df: DataFrame, terms: list[str], text: str, to: str) -> DataFrame:
    """Add the numbers that a score needs; each text is tokenised once."""
    (held,) = tx.free(df, "facts")
    out = tx.once(df, held, facts_of(tokens(F.col(f"`{text}`")), terms))
    return tx.once(out, to, counted(F.col(held), F.coalesce(F.col(f"`{text}`"), F.lit("")), terms)).drop(held)


def bm25_of_counts(df: DataFrame, terms: list[str], counts: str, to: str = "bm25_score") -> DataFrame:
    """Replace the numbers of ``with_counts`` by the score; the corpus is the whole table.

    One aggregation gives the number of rows, the mean length and the document frequency of
    each term, a single row that is broadcast.
    """
    n, avgdl, *dfs = tx.free(df, "n", "avgdl", *[f"df{i}" for i in range(len(terms))])
    x = F.col(counts)
    facts = df.agg(F.count(F.lit(1)).alias(n), F.avg(x["dl"]).alias(avgdl), *[F.sum((F.get(x["f"], F.lit(i)) > 0).cast("long")).alias(d) for i, d in enumerate(dfs)])
    value = score(x, [F.col(d) for d in dfs], F.col(n), F.col(avgdl))
    return df.crossJoin(F.broadcast(facts)).withColumn(to, value).drop(counts, n, avgdl, *dfs)


def bm25(df: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Add bm25_score. The corpus is the whole table; postings are never exploded.

    The table is read twice, for the facts of the corpus and for the rows, as no text is
    kept in between; ``bm25_scores`` needs one scan where the texts are not wanted.
    """
    terms = query_terms(query)
    if not terms:
        return df.withColumn("bm25_score", F.lit(0.0))
    (held,) = tx.free(df, "counts")
    return bm25_of_counts(with_counts(df, terms, text, held), terms, held)


def bm25_scores(df: DataFrame, query: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text by default) and bm25_score, in one scan.

    The numbers of each text, some bytes a term, are written to the shared folder and read
    for the facts of the corpus and for the scores.
    """
    terms = query_terms(query)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    if not terms:
        return df.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("bm25_score"))
    (held,) = tx.free(df, "counts")
    few = with_counts(df.select(*dict.fromkeys([*keep, text])), terms, text, held).select(*[F.col(f"`{c}`") for c in keep], held)
    return bm25_of_counts(staged(few, "bm25"), terms, held)


def line_facts(a: Column, counts: Column, terms: list[str]) -> Column:
    """Document frequency of each term among a document's lines, their number and mean length."""
    n = F.size(a)
    avgdl = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x["dl"]) / F.greatest(n, F.lit(1))
    having = lambda i: lambda x: F.get(x["f"], F.lit(i)) > 0
    return F.array(*[F.size(F.filter(counts, having(i))).cast("double") for i in range(len(terms))], n.cast("double"), avgdl)


def with_line_scores(df: DataFrame, a: str, terms: list[str], to: str) -> DataFrame:
    """Add the scores of the texts in array ``a`` of every row; the corpus is that array."""
    if not terms:
        return df.withColumn(to, F.transform(a, lambda x: F.lit(0.0)))
    met, counts, facts = tx.free(df, "met", "counts", "facts")
    out = tx.once(df, met, F.transform(a, lambda x: facts_of(tokens(x), terms)))
    out = tx.once(out, counts, F.transform(F.arrays_zip(F.col(a).alias("l"), F.col(met).alias("t")), lambda x: counted(x["t"], x["l"], terms)))
    out = tx.once(out, facts, line_facts(F.col(a), F.col(counts), terms))
    at = lambda i: F.get(facts, F.lit(i))
    value = F.transform(counts, lambda x: score(x, [at(i) for i in range(len(terms))], at(len(terms)), at(len(terms) + 1)))
    return tx.once(out, to, value).drop(met, counts, facts)


def keep_lines(df: DataFrame, query: str, text: str = "text", key: str = "doc_id", max_tokens: int = tx.DEFAULT_MAX_TOKENS) -> DataFrame:
    """Replace ``text`` by its lines that matter to the query, in order, within the budget.

    Lines with a positive score stay (the first eight if none has one), and those with a
    technical token of the query; the first line that would exceed the budget ends it. All
    in the row: array functions over the document's lines, no shuffle.
    """
    terms = query_terms(query)
    tech = [q for q in terms if _technical(q)]
    lines, scores = tx.free(df, "lines", "scores")
    out = tx.once(df, lines, F.filter(tx.lines(F.col(text)), lambda x: tx.trim(x) != ""))
    out = with_line_scores(out, lines, terms, scores)
    some = F.exists(scores, lambda s: s > 0)
    need = (lambda x: F.arrays_overlap(tokens(x["l"]), F.array(*[F.lit(q) for q in tech]))) if tech else (lambda x: F.lit(False))
    picked = F.filter(F.arrays_zip(F.col(lines).alias("l"), F.col(scores).alias("s")), lambda x, i: F.when(some, x["s"] > 0).otherwise(i < 8) | need(x))
    out = tx.once(out, lines, F.transform(picked, lambda x: x["l"]))
    # all fits in most texts; only else the lines are added one by one
    whole = tx.unlines(F.col(lines))

    def step(acc: Column, x: Column) -> Column:
        more = F.when(acc["out"] == "", x).otherwise(F.concat(acc["out"], F.lit("\n"), x))
        return F.when(acc["full"], acc).when(tx.token_count(more) > max_tokens, F.struct(acc["out"].alias("out"), F.lit(True).alias("full"))).otherwise(F.struct(more.alias("out"), F.lit(False).alias("full")))

    one_by_one = F.aggregate(lines, F.struct(F.lit("").alias("out"), F.lit(False).alias("full")), step, lambda s: s["out"])
    return tx.once(out, text, F.when(tx.token_count(whole) <= max_tokens, whole).otherwise(one_by_one)).drop(lines, scores)


def filter_relevant(df: DataFrame, query: str, text: str = "text", max_tokens: int = tx.DEFAULT_MAX_TOKENS) -> DataFrame:
    """Add content, lines_kept, lines_total, backend, deterministic, metrics; nothing kept falls back to a cut."""
    out = keep_lines(df.withColumn("content", F.coalesce(F.col(text), F.lit(""))), query, "content", max_tokens=max_tokens)
    out = out.withColumn("content", F.when(F.col("content") == "", tx.truncate(F.coalesce(F.col(text), F.lit("")), max_tokens)).otherwise(F.col("content")))
    return out.withColumns({"lines_kept": F.size(tx.lines(F.col("content"))), "lines_total": F.size(tx.lines(F.col(text))), "backend": F.lit("heuristic"), "deterministic": F.lit(True), "metrics": tx.metrics(F.col(text), F.col("content"))})


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 for empty, unequal or zero vectors, clamped to [-1, 1]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def min_max(df: DataFrame, column: str, to: str) -> DataFrame:
    """Scale a column to [0, 1]; equal values become 1 if positive, else 0. One broadcast row."""
    lo, hi = tx.free(df, "lo", "hi")
    facts = df.agg(F.min(column).alias(lo), F.max(column).alias(hi))
    x = F.col(column)
    scaled = F.when(F.col(hi) > F.col(lo), (x - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(F.when(x > 0, 1.0).otherwise(0.0))
    return df.crossJoin(F.broadcast(facts)).withColumn(to, scaled).drop(lo, hi)


def parse_score(t: Column) -> Column:
    """First number on the first non-blank line; 1 to 100 counts as percent; clamped to [0, 1]."""
    line = F.coalesce(F.get(F.filter(F.transform(tx.lines(t), tx.trim), lambda x: x != ""), F.lit(0)), tx.trim(t))
    v = F.coalesce(line.try_cast("double"), F.nullif(F.regexp_extract(line, r"-?[0-9.]+", 0), F.lit("")).try_cast("double"))
    return F.when(v.between(0, 1), v).when(v.between(1, 100), v / 100).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def rerank(df: DataFrame, query: str, text: str = "text", key: str = "doc_id", embedding: str | None = None, query_vector: list[float] | None = None, alpha: float = 0.55, top_k: int | None = None, min_score: float | None = None, scorer: str | None = None, scorer_top: int = 16, preview: int = 160, include_text: bool = False, digits: int = 3) -> DataFrame:
    """Ranked hits: rank, key, score, bm25_score, embedding_score, cross_encoder_score, preview, backend.

    With an embedding column and a query vector, min-max BM25 and (cos + 1) / 2 are blended.
    ``scorer`` names a column of outside scores: the best ``scorer_top`` by the first score
    that have one come first, by it, then the others in their order. ``min_score`` keeps
    scores at or above it, else ``top_k`` keeps all, else positive ones (all if none); if
    nothing is left, everything comes back at 0. Equal scores (in full precision) are
    ordered by key; scores are given to ``digits`` places.

    The texts are read once: key, preview, numbers for BM25 and similarity are written to
    the shared folder, and what follows reads that. With ``top_k`` Spark keeps the best of
    every task; without it hits are numbered after a sort by ranges, not in one task.
    ``include_text`` joins the texts of the hits back by key, which should then be unique.
    """
    terms = query_terms(query)
    vectors = embedding is not None and query_vector is not None
    held, sim = tx.free(df, "counts", "similarity")
    shown = F.left(F.coalesce(F.col(text), F.lit("")), F.lit(max(32, preview)))
    cos = (cosine(F.col(embedding), F.array(*[F.lit(float(x)) for x in query_vector])) + 1) / 2 if vectors else F.lit(None).cast("double")
    few = with_counts(df, terms, text, held).select(F.col(key).alias("key"), F.col(held).alias("counts"), cos.alias("embedding_score"), (F.col(scorer).cast("double") if scorer else F.lit(None).cast("double")).alias("scorer"), shown.alias("preview"))
    few = staged(few, "candidates")
    out = bm25_of_counts(few, terms, "counts") if terms else few.withColumn("bm25_score", F.lit(0.0)).drop("counts")
    if vectors:
        out = min_max(out, "bm25_score", "scaled").withColumn("score", alpha * F.col("scaled") + (1 - alpha) * F.col("embedding_score")).drop("scaled")
    else:
        out = out.withColumn("score", F.col("bm25_score"))
    out = out.withColumn("part", F.lit(1)).withColumn("cross_encoder_score", F.lit(None).cast("double"))
    if scorer:  # at most 64 rows
        best = out.select(F.col("key").alias("of"), F.lit(1).alias("top"), F.col("score").alias("by")).orderBy(F.desc("by"), "of").limit(max(4, min(64, scorer_top))).drop("by")
        out = out.join(F.broadcast(best), F.col("key") == F.col("of"), "left")
        hit = F.col("top").isNotNull() & F.col("scorer").isNotNull()
        out = out.withColumns({"cross_encoder_score": F.when(hit, F.col("scorer")), "part": F.when(hit, 0).otherwise(1), "score": F.when(hit, F.col("scorer")).otherwise(F.col("score"))}).drop("of", "top")
    limit = F.lit(min_score) if min_score is not None else F.lit(0.0)
    if min_score is not None or top_k is None:  # whether any row passes is one more broadcast row
        passes = (F.col("score") >= limit) if min_score is not None else (F.col("score") > 0)
        some = out.agg(F.coalesce(F.bool_or(passes), F.lit(False)).alias("some"))
        out = out.crossJoin(F.broadcast(some)).where(passes | ~F.col("some"))
        out = out.withColumn("score", F.when(F.col("some"), F.col("score")).otherwise(0.0)) if min_score is not None else out
    order = [F.asc("part"), F.desc("score"), F.asc("key")]
    ranked = numbered(out, order, top_k)
    name = ("cross_encoder+" if scorer else "") + ("hybrid" if vectors else "bm25")
    cols = [F.round(c, digits).alias(c) for c in ("score", "bm25_score", "embedding_score", "cross_encoder_score")]
    hits = ranked.select("rank", F.col("key").alias(key), *cols, "preview", F.lit(name).alias("backend"))
    return hits.join(df.select(F.col(key), F.col(text).alias("text")), key).select("rank", *[c for c in hits.columns if c != "rank"], "text") if include_text else hits


def numbered(df: DataFrame, order: list[Column], most: int | None = None) -> DataFrame:
    """Add ``rank`` from 1 in an order: over the best ``most`` rows, else over ranges of the sorted table.

    The sorted table is written, its partitions (ranges, in order) are numbered on their own,
    and the counts before each, a row for each range, are added.
    """
    if most is not None:
        return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    part, at, before = tx.free(df, "part_no", "at", "before")
    ranged = staged(df.orderBy(*order).withColumn(part, F.spark_partition_id()), "ranged")
    inside = ranged.withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    shift = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(F.col(part).alias("of"), F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return inside.join(shift, F.col(part) == F.col("of")).withColumn("rank", (F.col(before) + F.col(at)).cast("int")).drop(part, at, before, "of").orderBy("rank")


def rerank_metrics(candidates: DataFrame, hits: DataFrame, text: str = "text") -> DataFrame:
    """One row: candidates, hits, original_tokens, result_tokens (of previews, or texts where included) and reduction_ratio."""
    body = F.col("text") if "text" in hits.columns else F.col("preview")
    a = candidates.agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.sum(tx.token_count(F.col(text))), F.lit(0)).alias("original_tokens"))
    b = hits.agg(F.count(F.lit(1)).alias("hits"), F.coalesce(F.sum(tx.token_count(body)), F.lit(0)).alias("result_tokens"))
    saved = F.when((F.col("original_tokens") == 0) | (F.col("result_tokens") >= F.col("original_tokens")), F.lit(0.0)).otherwise((F.col("original_tokens") - F.col("result_tokens")) / F.col("original_tokens"))
    return a.crossJoin(b).select("candidates", "hits", "original_tokens", "result_tokens", saved.alias("reduction_ratio"))
