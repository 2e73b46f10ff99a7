"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Units that one pivotal fold works through; bounds a task's memory and the tree's fan-in.
BLOCK = 128
#: Size classes in an octave; classes that are next to each other share a fold while it has room.
FINE = 8
_BLANKS = " \t\n\x0b\x0c\r"
_WORD_GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, _WORD_GAP))).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target of every source: ``share`` of all sizes by weight, at most ``cap`` times its size.

    ``sizes`` has source and source_size, a row for each source. Weights go to sources by
    code point, null last, repeating. What a cap cuts off is reshared by weight among the
    others until none is above: with L the level at which sum(min(cap_i, L * w_i)) is the
    total, sources in order of cap_i / w_i are capped until one's cap is above the level
    that is left for it and all after it; that level is L (for those after it, the same
    quotient is lower, hence the maximum). Sources of size 0 have target 0.

    The windows run in one task over one narrow row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("rank", F.row_number().over(order) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    t = t.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy()
    rising = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    t = t.select("*", F.sum(F.col("source_size")).over(whole).alias("all_size"), F.sum("weight").over(whole).alias("all_weight"))
    t = t.withColumn("capped", F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("rest", F.col("all_weight") - F.coalesce(F.sum("weight").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("level", (F.col("all_size") * F.lit(float(share)) - F.col("capped")) / F.col("rest"))
    t = t.withColumn("level", F.max(F.when(F.col("most") > F.col("level") * F.col("weight"), F.col("level"))).over(whole))
    return t.select("source", "source_size", F.coalesce(F.least(F.col("most"), F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def _coin(*of: Column) -> Column:
    """A repeatable number in [0, 1) from 52 bits of a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _kind(size: Column) -> Column:
    """Class of a size, FINE to an octave."""
    return F.floor(F.log2(size + F.lit(1.0)) * FINE).cast("int")


def _lanes(kinds: DataFrame) -> DataFrame:
    """Where the units of each size class of a source are folded: lane, and parts it is dealt to.

    ``kinds`` has source, kind, units. From the largest sizes down, classes are cut into
    lanes of BLOCK to 2 BLOCK units, so that units of like size duel and a source of at most
    BLOCK units is one fold. A class of more units is a lane by itself, dealt by hash to as
    many parts as it needs. A row for each class, of which a source has a few hundred at most.
    """
    down = Window.partitionBy("source").orderBy(F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    k = kinds.withColumn("run", F.coalesce(F.sum("units").over(down), F.lit(0)))
    big = F.col("units") > BLOCK
    return k.withColumn("lane", F.when(big, -F.col("kind") - 1).otherwise(F.floor(F.col("run") / BLOCK))).withColumn("parts", F.when(big, F.ceil(F.col("units") / BLOCK)).otherwise(F.lit(1)).cast("long")).drop("run", "units")


_UNIT = "struct<doc_id:bigint,size:bigint,n:bigint,total:bigint,p:double,coin:double>"


def _fold(items: Column) -> Column:
    """One pivotal pass over an array of fractional units.

    The unit in hand and the next one duel: a + b is one mass. Below 1, one of them gets it
    all and the other 0; else one gets 1 and the other the rest. Each keeps its expectation
    and one becomes integral. Returns ``done``, and ``hand``, the one left.
    """

    def unit(u: Column, p: Column) -> Column:
        return F.struct(*[(p if c == "p" else u[c]).alias(c) for c in ("doc_id", "size", "n", "total", "p", "coin")]).cast(_UNIT)

    def step(acc: Column, x: Column) -> Column:
        h = acc["hand"]
        mass = h["p"] + x["p"]
        low = mass < 1.0
        # the chance that the next unit, and not the one in hand, is the one left fractional
        stays = F.when(low, x["p"] / F.greatest(mass, F.lit(1e-300))).otherwise((1.0 - x["p"]) / F.greatest(2.0 - mass, F.lit(1e-300)))
        left = F.when(low, mass).otherwise(mass - 1.0)
        fixed = F.when(low, F.lit(0.0)).otherwise(F.lit(1.0))
        swap = x["coin"] < stays
        hand = F.when(h.isNull(), x).when(swap, unit(x, left)).otherwise(unit(h, left))
        out = F.when(swap, unit(h, fixed)).otherwise(unit(x, fixed))
        done = F.when(h.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(out)))
        return F.struct(hand.alias("hand"), done.alias("done"))

    start = F.struct(F.lit(None).cast(_UNIT).alias("hand"), F.array().cast(f"array<{_UNIT}>").alias("done"))
    return F.aggregate(items, start, step)


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """How often the mix takes every document, so that sources come to their targets.

    A source's documents each have target / source_size expected copies. Whole copies are
    given outright; what is left of each, a probability, goes through pivotal rounding:
    within a source, units are folded from the largest size down, in blocks of neighbours in
    size (``_lanes``); every block hands its one fractional unit to the next round, which
    does the same, until one is left for a source, which a last coin decides. The number of
    taken units is then exact but for that coin. A duel moves words only as far as its two
    units differ, so taken words differ from the target by less than the largest document
    of the source, mostly by far less.

    Rows with equal key, size and source count as one unit of several (pre-aggregated), so
    repeated rows cannot fill a block. Returns doc_id, source, size, source_size, target,
    copies, taken, a row for each input row. Null texts have size 0; a null source is a
    source of its own, last in order; a null key is a key; sources of size 0 take nothing;
    an empty table gives an empty one. Coins are hashes: reruns agree.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), docs[text].alias("text"))
    units = staged(rows.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "units")
    units = units.withColumn("kind", _kind(F.col("size")))
    kinds = units.groupBy("source", "kind").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count(F.lit(1)).alias("units"))
    of = targets(kinds.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    plan = _lanes(kinds.drop("words")).alias("k").join(of.alias("t"), F.col("k.source").eqNullSafe(F.col("t.source")))
    plan = plan.select("k.source", "kind", "source_size", "target", "lane", "parts")
    u = (
        units.alias("u")
        .join(plan.alias("p"), F.col("u.source").eqNullSafe(F.col("p.source")) & (F.col("u.kind") == F.col("p.kind")))
        .select("u.source", "source_size", "target", "lane", "parts", "doc_id", "size", "n")
        .withColumn("mass", F.when(F.col("source_size") > 0, F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) * F.col("n")).otherwise(F.lit(0.0)))
        .withColumn("total", F.floor("mass").cast("long"))
        .withColumn("p", F.col("mass") - F.col("total"))
    )
    group = ["source", "source_size", "target"]
    hash_of = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size"), F.coalesce("source", F.lit("\x00"))]
    u = staged(u, "shares")
    whole = u.where(F.col("p") == 0.0)
    decided = [whole.select(*group, F.struct("doc_id", "size", "n", "total", F.col("p"), F.lit(0.0).alias("coin")).cast(_UNIT).alias("unit"))]
    left = u.where(F.col("p") > 0.0).select(*group, "lane", F.pmod(F.xxhash64(*hash_of, F.lit("block")), F.col("parts")).alias("part"), F.struct("doc_id", "size", "n", "total", "p", _coin(*hash_of, F.lit("coin")).alias("coin")).cast(_UNIT).alias("unit"))
    by = [*group, "lane", "part"]
    while True:
        order = F.struct((-F.col("unit.size")).alias("o"), F.col("unit.coin").alias("c"), F.col("unit.doc_id").alias("i"), F.col("unit").alias("unit"))
        sorted_units = F.transform(F.sort_array(F.collect_list(order)), lambda x: x["unit"])
        folded = staged(left.groupBy(*by).agg(sorted_units.alias("units")).select(*group, _fold(F.col("units")).alias("r")), "round")
        decided.append(folded.select(*group, F.explode("r.done").alias("unit")))
        hands = folded.select(*group, F.col("r.hand").alias("unit"))
        hands = hands.withColumn("kind", _kind(F.col("unit.size")))
        kinds = hands.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("units"))
        if not kinds.groupBy("source").agg(F.sum("units").alias("hands")).where(F.col("hands") > 1).head(1):
            break
        rnd = len(decided)
        hashed = F.xxhash64("unit.doc_id", "unit.size", F.lit(rnd))
        left = (
            hands.alias("h")
            .join(_lanes(kinds).alias("c"), F.col("h.source").eqNullSafe(F.col("c.source")) & (F.col("h.kind") == F.col("c.kind")))
            .select(*[F.col(f"h.{g}").alias(g) for g in group], "lane", F.pmod(hashed, F.col("parts")).alias("part"), F.col("h.unit").alias("unit"))
            .withColumn("unit", F.col("unit").withField("coin", _coin(F.col("unit.doc_id"), F.col("unit.size"), F.lit(rnd), F.lit("duel"))))
        )
    last = _coin(F.col("unit.doc_id"), F.col("unit.size"), F.lit("last")) < F.col("unit.p")
    decided.append(hands.select(*group, F.col("unit").withField("p", last.cast("double")).alias("unit")))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    total, n = F.col("unit.total") + F.col("unit.p").cast("long"), F.col("unit.n")
    return (
        out.select(*group, "unit.doc_id", "unit.size", total.alias("total"), n.alias("n"), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("i"))
        .withColumn("copies", F.expr("total div n") + (F.col("i") <= F.col("total") % F.col("n")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_rows(docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with all their columns.

    Decisions are joined by key, size and source; rows equal in these three share theirs in
    the order of their numbering, so every decision takes effect once.
    """
    chosen = mix(docs, weights, share, cap, text, key, source).where(F.col("copies") > 0).groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    tag = docs.select(*[docs[c].alias(f"_in_{i}") for i, c in enumerate(docs.columns)], docs[key].cast("long").alias("_k"), docs[source].cast("string").alias("_s"), word_count(docs[text]).alias("_n"))
    at = Window.partitionBy("_k", "_s", "_n").orderBy(*[f"_in_{i}" for i in range(len(docs.columns))])
    tag = tag.withColumn("_at", F.row_number().over(at))
    same = F.col("_k").eqNullSafe(F.col("doc_id")) & F.col("_s").eqNullSafe(F.col("source")) & (F.col("_n") == F.col("size"))
    picked = tag.join(chosen, same).where(F.col("_at") <= F.size("copies"))
    picked = picked.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.element_at("copies", F.col("_at")))))
    return picked.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])
