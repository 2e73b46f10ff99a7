"""Near-duplicates by ProbMinHash over weighted word shingles, banding, exact verification."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, mix64, new_path, passes, remove, scratch, staged, table_of, utf8, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 6 registers: a pair of similarity 0.8 shares no band with chance 6e-5.
BANDS, ROWS = 32, 6
#: Rounds that compare each bucket with one of its members before all pairs left over.
CENTRES = 1
#: Members of a block in the comparison of what is left of a bucket.
BLOCK = 256
#: Bytes of text of such a block, but for a single text that is longer.
BLOCK_BYTES = 8 << 20
#: Edges of a node from which on its edges are split, a part for each so many edges.
HUB = 256
#: Parts that rows which share a label, a digest or a hub are dealt to at most.
PARTS = 256

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, 64-bit name and count of every distinct shingle, sorted by text and name.

    Texts of fewer words than ``width`` are one shingle of all their words; texts without
    words have none.
    """
    data, offsets = utf8(texts)
    _, _, doc, h = words_of(data, offsets)
    words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(words) - words
    with np.errstate(over="ignore"):
        name = np.zeros(max(len(h) - width + 1, 0), dtype=_U)
        for k in range(width):
            name = mix64(name * _U(31) + h[k : k + len(name)] + _U(k + 1))
        inside = np.arange(len(name)) + width <= (first + words)[doc[: len(name)]]
        name, of = name[inside], doc[: len(name)][inside]
        short = np.flatnonzero((words > 0) & (words < width))
        whole = np.zeros(len(short), dtype=_U)
        for k in range(width - 1):
            more = words[short] > k
            whole[more] = mix64(whole[more] * _U(31) + h[first[short[more]] + k] + _U(k + 101))
    name, of = np.concatenate((name, whole)), np.concatenate((of, short))
    order = np.lexsort((name, of))
    name, of = name[order], of[order]
    new = np.concatenate(([True], (name[1:] != name[:-1]) | (of[1:] != of[:-1]))) if len(name) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    return of[at], name[at], np.diff(np.concatenate((at, [len(name)])))


def signatures(doc: np.ndarray, name: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """ProbMinHash: register k holds the shingle whose Poisson arrival there is earliest.

    A shingle of weight w sends arrivals at rate w, each to a random register. A document
    needs arrivals up to the time when its last register fills; with total weight W, time
    (ln m + 3) m / W does for most. Shingles past that time stop; the few documents with an
    empty register go on with twice the time. Two documents agree in a register with the
    probability Jaccard similarity of their weights. Documents without shingles get zeros.
    """
    m = registers
    out = np.zeros((docs, m), dtype=_U)
    total = np.bincount(doc, weight, minlength=docs)
    limit = (np.log(m) + 3.0) * m / np.maximum(total, 1e-9)
    todo = np.arange(len(doc))
    while len(todo):
        times = np.full(docs * m, np.inf)
        slots, arrivals, names = [], [], []
        live, clock, block, made = todo, np.zeros(len(todo)), 1, 0
        while len(live):
            with np.errstate(over="ignore"):
                steps = (np.arange(made, made + block, dtype=_U) + _U(1)) * _GOLD
                r = mix64(mix64(name[live])[:, None] + steps[None, :])
            gaps = -np.log(((r >> _U(24)).astype(np.float64) + 0.5) * 2.0**-40)
            gaps[:, 0] += clock
            sums = np.cumsum(gaps, axis=1)
            when = sums / weight[live][:, None]
            keep = when <= limit[doc[live]][:, None]
            slot = doc[live][:, None] * m + ((r & _U(0xFFFFFF)) * _U(m) >> _U(24)).astype(np.int64)
            s, w = slot[keep], when[keep]
            np.minimum.at(times, s, w)
            slots.append(s), arrivals.append(w), names.append(np.broadcast_to(name[live][:, None], keep.shape)[keep])
            on = keep[:, -1]
            live, clock = live[on], sums[on, -1]
            made, block = made + block, min(2 * block, 4096)
        s, w, x = np.concatenate(slots), np.concatenate(arrivals), np.concatenate(names)
        won = w == times[s]
        touched = np.unique(doc[todo])
        flat = out.reshape(-1)
        flat[s[won]] = x[won]
        empty = touched[~np.isfinite(times.reshape(docs, m)[touched]).all(axis=1)]
        limit[empty] *= 2
        again = np.zeros(docs, dtype=bool)
        again[empty] = True
        todo = todo[again[doc[todo]]]
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact similarity of two weighted sets (sorted names, weights): the sum over shared i
    of 1 / sum_j max(a_j / a_i, b_j / b_i), grouped by the ratio a_i / b_i."""
    (na, wa), (nb, wb) = a, b
    _, i, j = np.intersect1d(na, nb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    fa, fb = wa[i].astype(np.float64), wb[j].astype(np.float64)
    only_a, only_b = wa.sum() - fa.sum(), wb.sum() - fb.sum()
    ratio, group = np.unique(fa / fb, return_inverse=True)
    mass = np.bincount(group, fa)
    return float(sum(mass[g] / (only_a + only_b * r + np.maximum(fa, fb * r).sum()) for g, r in enumerate(ratio)))


def _links_between(texts: list[str], comp: np.ndarray, buckets: np.ndarray, band: int, left: np.ndarray, right: np.ndarray, same: bool, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of left x right rows (each pair once if ``same``) in different classes.

    A text whose shingles that others of the group have too are less than the similarity of
    its mass can have no link. For the others, the mass that two texts share comes from a
    product of their count matrices; a pair whose share of either total is below the
    similarity cannot reach it. What is left is looked at in the first band that the pair
    shares, and verified exactly.
    """
    doc, name, count = shingles([t.encode() for t in texts], width)
    n = len(texts)
    total = np.bincount(doc, count, minlength=n)
    _, at, df = np.unique(name, return_inverse=True, return_counts=True)
    alive = np.bincount(doc, count * (df[at] > 1), minlength=n) >= (similarity - 1e-9) * total
    left, right = left[alive[left]], right[alive[right]]
    none = np.zeros(0, dtype=np.int64)
    if not len(left) or not len(right):
        return none, none
    plain = np.bincount(doc, count > 1, minlength=n) == 0
    usable = alive[doc]
    df = np.bincount(at[usable], minlength=len(df))
    column = np.cumsum(df > 1) - 1
    usable &= (df > 1)[at]
    width_ = int((df > 1).sum())
    at_left, at_right = np.full(n, -1), np.full(n, -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    by_left, by_right = np.zeros((2, len(left), len(right)), dtype=np.float32)
    step = max(1, (1 << 21) // max(len(left), len(right)))
    for c in range(0, width_, step):
        here = usable & (column[at] >= c) & (column[at] < c + step)
        mats = []
        for rows, where in ((len(left), at_left), (len(right), at_right)):
            mine = here & (where[doc] >= 0)
            m = np.zeros((rows, min(step, width_ - c)), dtype=np.float32)
            m[where[doc[mine]], column[at[mine]] - c] = count[mine]
            mats.append(m)
        x, y = mats
        by_left += x @ (y > 0).T.astype(np.float32)
        by_right += (x > 0).astype(np.float32) @ y.T
    enough = np.minimum(by_left / total[left][:, None], by_right / total[right][None, :]) >= similarity - 1e-6
    enough &= comp[left][:, None] != comp[right][None, :]
    if same:
        enough &= left[:, None] < right[None, :]
    i, j = np.nonzero(enough)
    first = (buckets[left[i]] == buckets[right[j]]).argmax(axis=1) == band
    i, j = i[first], j[first]
    shared, i, j = by_left[i, j].astype(np.float64), left[i], right[j]
    sets = plain[i] & plain[j]
    ok = np.where(sets, shared / np.maximum(total[i] + total[j] - shared, 1), 0.0) >= similarity
    cut = np.searchsorted(doc, np.arange(n + 1))
    for k in np.flatnonzero(~sets):
        a, b = i[k], j[k]
        ok[k] = probability_jaccard((name[cut[a] : cut[a + 1]], count[cut[a] : cut[a + 1]]), (name[cut[b] : cut[b + 1]], count[cut[b] : cut[b + 1]])) >= similarity
    return i[ok], j[ok]


def _rest(member: DataFrame, labels: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links between members of a bucket that are still in different classes: all of them.

    In each bucket, members outside its largest class meet one another and that class,
    block by block, so a task holds two blocks of texts, of about BLOCK rows and BLOCK_BYTES
    bytes at most (a longer text more), and gives out links alone. Buckets
    of one class are left out; in others the work is (members outside the largest class) x
    (members), which stays small as the rounds before have merged what is alike.
    """
    m = member.join(labels.join(texts.select("key", "bytes"), "key"), "key")
    of = m.groupBy("bucket", "band", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    of = of.groupBy("bucket", "band").agg(F.sum("n").alias("all"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "comp", "bytes")).alias("most"))
    blocks = lambda rows, size: F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    kn, km = blocks(F.col("all") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")), blocks(F.col("most.n"), F.col("most.bytes"))
    of = of.where(F.col("all") > F.col("most.n")).select("bucket", "band", F.col("most.comp").alias("top"), kn.alias("kn"), km.alias("km"))
    m = m.drop("bytes")
    m = m.join(of, ["bucket", "band"]).withColumn("main", F.col("comp") == F.col("top"))
    m = m.withColumn("b", F.pmod(F.xxhash64("key"), F.when(F.col("main"), F.col("km")).otherwise(F.col("kn"))).cast("int"))
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    goes = F.when(F.col("main"), F.transform(upto("kn"), lambda x: F.struct(x.alias("i"), F.col("b").alias("j"), F.lit(True).alias("meets_main")))).otherwise(
        F.concat(
            F.transform(upto("kn"), lambda x: F.struct(F.least(x, F.col("b")).alias("i"), F.greatest(x, F.col("b")).alias("j"), F.lit(False).alias("meets_main"))),
            F.transform(upto("km"), lambda x: F.struct(F.col("b").alias("i"), x.alias("j"), F.lit(True).alias("meets_main"))),
        )
    )
    dealt = m.select("bucket", "band", "key", "comp", "main", "b", F.explode(goes).alias("g")).select("bucket", "band", "key", "comp", "main", "b", "g.i", "g.j", "g.meets_main")
    dealt = dealt.join(texts.select("key", "buckets", "text"), "key")
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        r = {c: group.column(c).to_pylist() for c in ("key", "comp", "main", "b", "text", "buckets")}
        i, j, meets = (group.column(c)[0].as_py() for c in ("i", "j", "meets_main"))
        main, b = np.array(r["main"]), np.array(r["b"])
        same = not meets and i == j
        left = np.flatnonzero(~main if meets or same else b == i)
        right = np.flatnonzero(main if meets else (~main if same else b == j))
        comp = np.unique(np.array([bytes(x).hex() for x in r["comp"]]), return_inverse=True)[1]
        x, y = _links_between(r["text"], comp, np.array(r["buckets"], dtype=np.int64), group.column("band")[0].as_py(), left, right, same, width, similarity)
        return pa.table({"a": [r["key"][k] for k in x], "b": [r["key"][k] for k in y]}, schema=out)

    return dealt.groupBy("bucket", "band", "i", "j", "meets_main").applyInArrow(run, "a binary, b binary")


_REPS = "key binary, doc_id long, buckets array<bigint>"


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Digest, doc_id and bucket names (one for each band) of every row."""
    out = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("buckets", pa.list_(pa.int64()))])
    salt = (np.arange(bands, dtype=_U) + _U(1)) * _GOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in passes(batch.column("text")):
                doc, name, count = shingles(texts, width)
                sig = signatures(doc, name, count.astype(np.float64), b - a, bands * rows).reshape(b - a, bands, rows)
                with np.errstate(over="ignore"):
                    h = np.broadcast_to(salt, (b - a, bands)).copy()
                    for k in range(rows):
                        h = mix64(h * _U(31) + sig[:, :, k])
                some = np.bincount(doc, minlength=b - a) > 0
                yield table_of({"key": batch.column("key").slice(a, b - a), "doc_id": batch.column("doc_id").slice(a, b - a), "buckets": [x if s else [] for x, s in zip(h.view(np.int64), some, strict=True)]}, out)

    return in_batches(docs, run, _REPS)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of digests whose texts have at least the similarity."""
    both = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(maxsize=64)
        def weights(text: str) -> tuple[np.ndarray, np.ndarray]:
            _, name, count = shingles([text.encode()], width)
            return name, count

        for batch in batches:
            ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            ok = [probability_jaccard(weights(x), weights(y)) >= similarity for x, y in zip(ta, tb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=out).filter(pa.array(ok, pa.bool_()))

    return in_batches(both.select("a", "b", "ta", "tb"), run, "a binary, b binary")


def _looked_up(rows: DataFrame, by: str, table: DataFrame, deal: str = "key") -> DataFrame:
    """``rows`` left join ``table`` (a row for each value of ``by``), however many rows share a value.

    Rows are dealt by hash of ``deal`` to PARTS parts; the distinct pairs of value and part
    meet the table, at most PARTS for a value, and bring its row to the parts.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(deal), F.lit(PARTS)))
    return dealt.join(dealt.select(by, "part").distinct().join(table, by), [by, "part"], "left").drop("part")


def _split_hubs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, part) both ways, and (key, parts) of the hubs, the nodes with over HUB edges.

    The edges of a hub are dealt by their other end to ``parts`` parts. To find them, the
    hubs meet the edges with PARTS rows each, which together are fewer than the edges.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both.withColumn("deal", F.pmod(F.xxhash64("a"), F.lit(PARTS)).cast("int")), "edges")
    hubs = both.groupBy(F.col("b").alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB)
    hubs = staged(hubs.select("key", F.least(F.ceil(F.col("n") / HUB), F.lit(PARTS)).cast("int").alias("parts")), "hubs")
    each = hubs.select(F.col("key").alias("b"), "parts", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("deal"))
    split = both.join(each, ["b", "deal"], "left").select("a", "b", F.coalesce(F.col("deal") % F.col("parts"), F.lit(0)).alias("part"))
    return staged(split, "split"), hubs


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest digest reachable from each (key, comp) node over edges (a, b).

    Nodes start as classes of their own (comp is key): labels that stand for earlier links
    would be lost where these are not among the edges; ``merged`` takes such labels. Every
    round takes the least label around a node, then the label's own label; rounds stop when
    no label changes. A hub's edges are split into parts, each with a copy of its label, and
    what it hears is combined before the shuffle; labels' labels are asked for once a part
    (``_looked_up``). Labels are written each round, so lineage is cut, and those of the
    round before are removed.
    """
    spark = nodes.sparkSession
    both, hubs = _split_hubs(edges)
    labels = nodes.select("key", "comp").join(hubs, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    old = []
    while True:
        said = labels.select(F.col("key").alias("b"), "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        heard = both.join(said, ["b", "part"]).groupBy("a").agg(F.min("comp").alias("heard"))
        paths = [new_path(spark, "lower"), new_path(spark, "labels")]
        lower = labels.join(heard, labels["key"] == heard["a"], "left").select("key", "comp", "parts", F.least("comp", F.coalesce("heard", "comp")).alias("least"))
        lower.write.parquet(paths[0])
        lower = spark.read.schema(lower.schema).parquet(paths[0])
        further = lower.where(F.col("least") < F.col("key")).select(F.col("key").alias("least"), F.col("least").alias("further"))
        new = _looked_up(lower, "least", further).select("key", F.coalesce("further", "least").alias("next"), "comp", "parts")
        new.write.parquet(paths[1])
        new = spark.read.schema(new.schema).parquet(paths[1])
        for path in [paths[0], *old]:
            remove(spark, path)
        old = paths[1:]
        labels = new.select("key", F.col("next").alias("comp"), "parts")
        if not new.where(F.col("next") != F.col("comp")).head(1):
            return labels.drop("parts")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (key, comp) joined by further links (a, b) between their members.

    Links are lifted to the classes of their ends, so that whole classes merge, whichever
    members the links name; only classes with such links go through the rounds.
    """
    of = lambda c: labels.select(F.col("key").alias(c), F.col("comp").alias(f"c{c}"))
    lifted = links.select("a", "b").join(of("a"), "a").join(of("b"), "b").where(F.col("ca") != F.col("cb"))
    lifted = staged(lifted.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "lifted")
    heads = lifted.select(F.col("a").alias("key")).unionByName(lifted.select(F.col("b").alias("key"))).distinct()
    found = components(heads.select("key", F.col("key").alias("comp")), lifted).select(F.col("key").alias("comp"), F.col("comp").alias("further"))
    return _looked_up(labels, "comp", found).select("key", F.coalesce("further", "comp").alias("comp"))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Class of every row: rows linked by equal texts or by similarity, however indirectly.

    Returns doc_id, class_id (least doc_id of the class), class_size (rows), kept (one row
    per class is: of the least doc_id, one digest), key (MD5 of the text). Similarity is the
    probability Jaccard of counts of ``width``-word shingles, verified on the texts.

    Equal texts count once from the first shuffle on. Each bucket of texts that share a
    band is compared with one member (that met most others, then one by a hash) and verified pairs
    are merged; only members of a bucket that are still in different classes are then
    compared, all of them, in blocks (``_rest``), so no link between candidates is lost and
    tight groups, however large, cost a few comparisons a member. Null and blank texts have no shingles: equal
    ones (null counts as empty) are not evidence, so each blank row is its own class.
    Repeated rows fall in one class, of which one row is kept; null doc_ids sort last; an
    empty table gives an empty one; other columns are ignored.
    """
    named = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    signed = staged(_signed(named.select("key", "doc_id", "text"), width, bands, rows), "signed")
    full = signed.where(F.size("buckets") > 0)
    reps = staged(full.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("buckets").alias("buckets"), F.count(F.lit(1)).alias("n")), "reps")
    path = new_path(docs.sparkSession, "classes")
    # the classes are written, so tables of texts, buckets and links go before they are read
    with scratch(docs.sparkSession):
        member = reps.select("key", F.posexplode("buckets").alias("band", "bucket"))
        shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        member = staged(member.join(shared, "bucket"), "members")
        involved = member.groupBy("key").agg(F.sum("n").alias("met"))
        # one text for each involved digest, picked by the least doc_id, so that copies are not gathered
        ids = involved.join(reps, "key").select("key", "buckets", F.coalesce("doc_id", F.lit(-1).cast("long")).alias("id"))
        picked = named.withColumn("id", F.coalesce("doc_id", F.lit(-1).cast("long"))).join(ids, ["key", "id"]).select("key", "buckets", "text")
        texts = staged(picked.groupBy("key").agg(F.first("buckets").alias("buckets"), F.first("text").alias("text")).withColumn("bytes", F.octet_length("text")), "texts")
        central = staged(involved, "central")
        labels = central.select("key", F.col("key").alias("comp"))

        def pairs_left(labels: DataFrame, centre: int) -> DataFrame:
            m = member.join(labels, "key").join(central, "key")
            order = F.struct(-F.col("met"), F.col("key")) if centre == 0 else F.struct(F.xxhash64("key", F.lit(centre)), F.col("key"))
            c = m.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), F.col("key").alias("a"), F.col("comp").alias("ca"))).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            c = c.where(F.col("lo") != F.col("hi")).select("bucket", "c.a", "c.ca")
            p = m.join(c, "bucket").where(F.col("comp") != F.col("ca"))
            p = p.select("a", "ca", F.col("key").alias("b"), "comp").distinct()
            # of several centres for one member, only one of a class is asked for in a round
            return p.groupBy("b", "ca").agg(F.min("a").alias("a")).select("a", "b")

        for centre in range(CENTRES):
            links = staged(_verified(pairs_left(labels, centre), texts, width, similarity), "links")
            labels = staged(merged(labels, links), "merged") if centre else components(labels, links)
        links = staged(_rest(member, labels, texts, width, similarity), "links")
        labels = staged(merged(labels, links), "classes", path)

    node = reps.join(labels, "key", "left").select("key", F.coalesce("comp", "key").alias("comp"), "doc_id", "n")
    heads = node.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")).alias("head"), F.sum("n").alias("class_size"))
    of = _looked_up(node.select("key", "comp"), "comp", heads).select("key", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("head"), "class_size")
    rows_in = signed.select("key", "doc_id", (F.size("buckets") > 0).alias("some"))
    seen = _looked_up(rows_in.where("some"), "key", of, deal="doc_id").select("doc_id", "class_id", "class_size", "key", (F.col("key") == F.col("head")).alias("head"))
    blank = rows_in.where(~F.col("some")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "key", F.lit(True).alias("head"))
    out = seen.unionByName(blank)
    return out.withColumn("kept", F.col("head") & F.col("doc_id").eqNullSafe(F.col("class_id"))).drop("head")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` with one of each class left, blank ones untouched.

    The kept keys and digests, a row per class, meet the texts in one join; of rows that
    agree in both, the least is left.
    """
    found = classes(docs, text, key, **options).where("kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), (F.col("class_size") > 1).alias("_many"))
    found = found.groupBy("_id", "_key").agg(F.max("_many").alias("_many"))
    cols = docs.columns
    rows_ = docs.select(F.struct(*[docs[c].alias(f"_{i}") for i, c in enumerate(cols)]).alias("row"), docs[key].cast("long").alias("id"), F.unhex(F.md5(F.coalesce(docs[text], F.lit("")))).alias("k"), F.coalesce(docs[text], F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("some"))
    kept = rows_.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_key")))
    single = kept.where(~F.col("some") | ~F.col("_many")).select("row")
    many = kept.where(F.col("some") & F.col("_many")).groupBy("_id", "_key").agg(F.min("row").alias("row")).select("row")
    return single.unionByName(many).select(*[F.col(f"row._{i}").alias(c) for i, c in enumerate(cols)])
