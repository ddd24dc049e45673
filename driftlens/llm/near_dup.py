"""Near-duplicate classes (operator 3): consistent weighted sampling, bands, weighted Jaccard.

A text is the multiset of its five-word shingles with TF-IDF weights. Two
texts are linked when their weighted Jaccard similarity is 0.8 or more;
classes are the connected components of the links. The steps:

1. document frequencies: every text's distinct shingles are counted in two
   rows of 2**18 hashed counters; a shingle's frequency is the smaller of its
   two, less what the other shingles add to a counter (the mean load and two
   deviations), at least 1. A task sends sums only, and the tasks are bounded by
   the cluster's cores. A shingle weighs its smoothed inverse frequency,
   1 + ln((1 + N) / (1 + df)) / ln(1 + N), scaled so that the rarest weigh 1: a
   shingle of every document weighs half as much. The scale depends on N only
   through the share df / N, so a pair's similarity doesn't drift as N grows;
2. signatures: improved consistent weighted sampling. A shingle's weight W in a
   text is its count times its inverse frequency. For each sample and shingle
   three numbers are drawn by the shingle's hash: r and c of the gamma
   distribution (2, 1) and b of the uniform one. The weight is quantised to
   y = exp(r (t - b)) by t = floor(ln W / r + b), and the shingle of the smallest
   a = c / (y exp(r)) is the sample, told as (shingle, t). Two texts agree in a
   sample with the probability of their weighted Jaccard similarity, for any real
   weights. Gamma variates are taken from 2**16 quantiles by bits of the hash;
3. 16 bands of 4 samples make buckets: a pair at 0.8 shares one with probability
   0.9998. In each bucket all members are compared with its most central text
   (the one with most bucket mates over all bands), not with each other;
4. pairs are verified on their whole texts by exact weighted Jaccard;
   components are found by hooking and pointer jumping over written tables;
5. in buckets of three and more texts that still hold several components, the
   remaining pairs between components are made by an exact prefix filter on
   the shingles and verified, so no candidate is lost to step 3 and a large
   group of loosely similar texts doesn't make all its pairs.

Equal texts are one node throughout (128-bit digest), so copies never make
pairs. Nothing is collected on the driver but the counters (a fixed number).
Defined results: a null text is a class of its own; texts without words (empty
ones) are joined with equal texts only; a text of one to four words has one
shingle, all its words; very long texts are shingled whole; ``class_id`` is the
smallest doc_id of the class (null only if all are null); repeated rows each
get a row; ties of doc_id go to the smallest digest; extra columns of any name
are ignored (``keep_one`` returns them); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import SLICE_ROWS, Block, blocks, doc_of, is_space, map_texts, mix, ngrams, text_blocks
from .shared import drop, written

U64 = np.uint64
#: Bits of a hash that choose one variate.
VARIATE_BITS = 16


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4
    counters: int = 18  # bits of each of the two rows
    block_rows: int = 256  # members of a hot shingle or of a hot central text that meet in a salted part

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def shingles(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (text number in the 12 highest bits, hash below), ascending and distinct; their counts; start pointers."""
    block = Block(texts)
    starts, ends = block.runs(~is_space(block.cps))
    ptr = block.ptr(starts)
    h = block.hashes(starts, ends)
    doc = doc_of(ptr)
    g, at = ngrams(h, ptr, words)
    d = doc[at]
    number = np.diff(ptr)
    for n in range(1, words):  # texts of fewer words
        few = np.flatnonzero(number == n)
        if len(few):
            own = np.zeros(len(few), U64)
            for j in range(n):
                own = mix(own + h[ptr[few] + j] + U64(n))
            g, d = np.concatenate([g, own]), np.concatenate([d, few])
    keys = np.sort((d.astype(U64) << U64(52)) | (g >> U64(12)))
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[new, len(keys)])
    keys = keys[new]
    return keys, counts, np.searchsorted(keys, np.arange(block.n + 1, dtype=U64) << U64(52))


#: Rows of a table that is broadcast at most; larger ones are joined by Spark's choice.
BROADCAST_ROWS = 100_000


def checked(df: DataFrame) -> DataFrame:
    """The written table with a broadcast hint if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def counters_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's counter in each of the two rows (the second row follows the first)."""
    mask = U64((1 << bits) - 1)
    return (keys & mask).astype(np.intp), ((keys >> U64(bits)) & mask).astype(np.intp) + (1 << bits)


def weights_of(keys: np.ndarray, table: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of shingles: the smaller frequency of the two rows counts."""
    one, two = counters_of(keys, s.counters)
    return np.maximum(table[one], table[two])


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    """Smoothed inverse document frequency, from 1/2 (every document) to 1 (no other document)."""
    if n < 2:
        return np.ones(len(df))
    idf = lambda x: 1 + np.log((1 + n) / (1 + x)) / np.log(1 + n)
    return idf(np.clip(df, 1, n)) / idf(1)


def frequencies(docs: DataFrame, text_col: str, s: Settings) -> np.ndarray:
    """Weight of each counter's shingles (float32, two rows of 2**counters entries)."""
    spark = docs.sparkSession

    def run(batches):
        total, seen = np.zeros(2 << s.counters, np.int64), 0
        for batch in batches:
            for a, b, texts in text_blocks(batch.column(0)):
                keys, _, _ = shingles(texts, s.words)
                for at in counters_of(keys, s.counters):
                    total += np.bincount(at, minlength=len(total))
                seen += b - a
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[seen, total[at]])], names=["counter", "n"])

    # A task sends all its counters, so their number follows the cluster, not the input.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = docs.select(F.col(text_col)).coalesce(tasks).mapInArrow(run, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    made = sums.toArrow()  # two rows of counters and one row more
    at, number = made["counter"].to_numpy(), made["n"].to_numpy()
    n = int(number[at == -1].sum())
    total = np.zeros(2 << s.counters, np.int64)
    total[at[at >= 0]] = number[at >= 0]
    load = total.sum() / len(total)
    return inverse_frequency(total - load - 2 * np.sqrt(load), n).astype(np.float32)


@lru_cache(maxsize=1)
def variates() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of r, of 1 / r and of ln c, for r and c of the gamma distribution (2, 1), and of b, uniform."""
    share = (np.arange(1 << VARIATE_BITS) + 0.5) / (1 << VARIATE_BITS)
    low, high = np.zeros(len(share)), np.full(len(share), 64.0)
    for _ in range(80):  # its distribution function 1 - (1 + x) exp(-x) by bisection
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < share
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return tuple(x.astype(np.float32) for x in (low, 1 / low, np.log(low), share))


def signature(keys: np.ndarray, counts: np.ndarray, ptr: np.ndarray, weight: np.ndarray, s: Settings) -> np.ndarray:
    """Matrix texts x samples of (shingle, t) hashes; rows of texts without shingles are 0.

    All shingles of a block draw a sample at once. With x = t - b + 1, ln a is ln c - r x; of equal values the
    shingle of the smallest hash counts.
    """
    n = len(ptr) - 1
    out = np.zeros((n, s.samples), U64)
    some = np.flatnonzero(np.diff(ptr) > 0)
    if not len(some):
        return out
    r_of, inverse_of, log_c_of, b_of = variates()
    own = keys & U64((1 << 52) - 1)
    base = mix(own)
    log_w = np.log(counts * weights_of(keys, weight, s).astype(np.float64)).astype(np.float32)
    begin, number = ptr[some], np.diff(ptr)[some]
    seeds = mix(np.arange(1, 2 * s.samples + 1, dtype=U64)).reshape(2, -1)
    for k in range(s.samples):
        drawn = ((base ^ seeds[0, k]) * (seeds[1, k] | U64(1))).view(np.uint16).reshape(-1, 4)  # the higher the lane, the better mixed
        at = drawn[:, 3].astype(np.intp)
        b = b_of.take(drawn[:, 1])
        t = log_w * inverse_of.take(at)
        t += b
        np.floor(t, out=t)
        x = t - b
        x += 1
        x *= r_of.take(at)
        a = log_c_of.take(drawn[:, 2])
        a -= x
        least = np.minimum.reduceat(a, begin)
        hits = np.flatnonzero(a == np.repeat(least, number))
        first = np.zeros(len(some), np.intp)
        of = np.searchsorted(begin, hits, "right") - 1
        first[of[::-1]] = hits[::-1]
        out[some, k] = mix(own[first] + t[first].astype(np.int64).view(U64) * U64(0xD6E8FEB86659FD93))
    return out


def bands(sig: np.ndarray, s: Settings) -> np.ndarray:
    """Matrix texts x bands of bucket keys."""
    out = np.zeros((len(sig), s.bands), U64)
    for b in range(s.bands):
        h = np.full(len(sig), U64(b + 1))
        for j in range(s.rows):
            h = mix(h + sig[:, b * s.rows + j])
        out[:, b] = h
    return out


def similarities(left: list[str | None], right: list[str | None], weight: np.ndarray, s: Settings) -> np.ndarray:
    """Exact weighted Jaccard similarity of each pair of texts."""
    n = len(left)
    out = np.zeros(n)
    at = 0
    both = [(a or "") + (b or "") for a, b in zip(left, right, strict=True)]
    for at, end in blocks(both):
        sides = [shingles(x[at:end], s.words) for x in (left, right)]
        keys = [k for k, _, _ in sides]
        w = [c * weights_of(k, weight, s).astype(np.float64) for k, c, _ in sides]
        total = [np.bincount((k >> U64(52)).astype(np.int64), weights=x, minlength=end - at) for k, x in zip(keys, w, strict=True)]
        place = np.searchsorted(keys[1], keys[0])
        place = np.minimum(place, max(0, len(keys[1]) - 1))
        shared = keys[1][place] == keys[0] if len(keys[1]) else np.zeros(len(keys[0]), bool)
        low = np.minimum(w[0][shared], w[1][place[shared]])
        both_w = np.bincount((keys[0][shared] >> U64(52)).astype(np.int64), weights=low, minlength=end - at)
        union = total[0] + total[1] - both_w
        out[at:end] = np.divide(both_w, union, out=np.zeros(end - at), where=union > 0)
    return out


def verify(pairs: DataFrame, texts: DataFrame, weight, s: Settings) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) are similar enough, with their similarity."""
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    # A text with many partners is copied to several parts, so that no task gets all its pairs.
    tb, dealt, key = texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), pairs.select("a", "b"), ["b"]
    hot = written(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / s.block_rows).cast("int").alias("salts")).filter("salts > 1"), "hot")
    if not hot.isEmpty():
        hot, salts, key = checked(hot), F.coalesce("salts", F.lit(1)), ["b", "salt"]
        tb = tb.join(hot, "b", "left").select("b", "tb", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        dealt = dealt.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), salts).cast("int").alias("salt"))
    with_texts = dealt.join(ta, "a").join(tb, key).select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            parts = [similarities(*(batch.column(k).slice(at, SLICE_ROWS).to_pylist() for k in (2, 3)), weight.value, s) for at in range(0, batch.num_rows, SLICE_ROWS)]
            sim = np.concatenate([np.zeros(0), *parts])
            ok = pa.array(sim >= s.similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], names=["a", "b", "similarity"]).filter(ok)

    return with_texts.mapInArrow(run, "a string, b string, similarity double")


def with_counts(rows: DataFrame, counts: DataFrame, key: str, s: Settings) -> DataFrame:
    """rows (with node) and n of counts (key, n), null where there is none; rows of a frequent key don't meet in one task.

    Frequent keys are looked up first; what found its number goes on under a key of its own that matches nothing.
    """
    hot = written(counts.filter(F.col("n") > s.block_rows).select(key, F.col("n").alias("hot_n")), "hot")
    if hot.isEmpty():
        return rows.join(counts, key, "left").select(*rows.columns, "n")
    hot = checked(hot)
    first = rows.join(hot, key, "left")
    own = -1 - F.shiftrightunsigned(F.xxhash64(key, "node"), 2)  # keys are from 0 on
    rest = counts.filter(F.col("n") <= s.block_rows).select(F.col(key).alias("rare_key"), F.col("n").alias("rare_n"))
    both = first.withColumn("at", F.when(F.col("hot_n").isNull(), F.col(key)).otherwise(own)).join(rest, F.expr("at = rare_key"), "left")
    return both.withColumn("n", F.coalesce("hot_n", "rare_n")).select(*rows.columns, "n")


def remaining(open_: DataFrame, weight, s: Settings) -> DataFrame:
    """The pairs (a < b) of different components among (node, root, text) that can be similar enough.

    An exact filter in place of all pairs: a text's shingles are ordered from
    the rarest among these texts on. Let t be the first shingle that two texts
    share; neither text's weight before t is shared, so t lies within the
    first (1 - similarity) of both weights, and the overlap is at most what is
    left from t on. Only pairs for which that bound allows the similarity are
    made; texts that differ from all others in a fifth of their weight make none.
    """

    def kernel(texts):
        keys, counts, ptr = shingles(texts, s.words)
        w = counts * weights_of(keys, weight.value, s).astype(np.float64)
        own = (keys & U64((1 << 52) - 1)).view(np.int64)
        rows = pa.StructArray.from_arrays([pa.array(own), pa.array(w)], names=["shingle", "w"])
        return [pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), rows)]

    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("w", pa.float64())]))
    each = map_texts(open_, "text", ["node", "root"], [("held", "array<struct<shingle:bigint,w:double>>", kind)], kernel)
    each = written(each.select("node", "root", F.explode("held").alias("h")).select("node", "root", "h.*"), "shingles")
    common = written(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "common")
    order = Window.partitionBy("node").orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)  # shingles of one text only have a null n
    ranked = with_counts(each, common, "shingle", s).withColumn("before", F.coalesce(F.sum("w").over(order), F.lit(0.0))).withColumn("total", F.sum("w").over(Window.partitionBy("node")))
    slack = 1e-9
    first = ranked.filter((F.col("n") > 1) & (F.col("before") <= (1 - s.similarity + slack) * F.col("total"))).withColumn("left", F.col("total") - F.col("before"))
    lists = written(first.select("shingle", "node", "root", "total", "left"), "prefixes")
    mixed = written(lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("shingle", "n"), "mixed")
    both = with_counts(lists, mixed, "shingle", s).filter("n IS NOT NULL").withColumn("salts", F.ceil(F.col("n") / s.block_rows).cast("int"))
    one = both.select("shingle", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("total").alias("ta"), F.col("left").alias("la"), F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    two = both.select("shingle", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("total").alias("tb"), F.col("left").alias("lb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    least = s.similarity / (1 + s.similarity) - slack
    on = (one["shingle"] == two["shingle"]) & (one["salt"] == two["salt"]) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (F.least("la", "lb") >= least * (F.col("ta") + F.col("tb")))
    return one.join(two, on).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with a link (columns a, b).

    Each round every node that has a smaller neighbour hooks to the smallest;
    chains of hooks are shortened to their ends, then links are renamed and reduced.
    """
    ordered = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = written(ordered, "links")
    roots = None
    while not edges.isEmpty():
        hook = written(edges.groupBy("u").agg(F.min("v").alias("p")), "hooks")
        moved = True
        while moved:  # p < u, so chains end; each turn halves them
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            longer = written(hook.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "hooks")
            moved = not longer.filter("moved").isEmpty()
            drop(hook)
            hook = longer.select("u", "p")
        if roots is None:
            new = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            own = hook.select(F.col("u").alias("root"), "p")
            new = roots.join(own, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
            new = new.unionByName(hook.join(roots.select(F.col("node").alias("u")), "u", "left_anti").select(F.col("u").alias("node"), F.col("p").alias("root")))
        new = written(new, "roots")
        hv = hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left = edges.join(hook, "u", "left").join(hv, "v", "left").select(F.coalesce("p", "u").alias("x"), F.coalesce("pv", "v").alias("y"))
        renamed = written(left.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")
        for old in (edges, roots, hook):
            if old is not None:
                drop(old)
        edges, roots = renamed, new
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots


def digest(text_col: str = "text") -> F.Column:
    return F.md5(F.col(text_col).cast("binary"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of docs: id, node (digest of the text, null for a null text), class_id, class_texts, links, is_first.

    class_texts is the number of different texts in the class, links the number
    of other texts that were verified as similar to this one; is_first marks the
    row or rows with the class's smallest (doc_id, node).
    """
    s, spark = settings, docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = frequencies(docs, "text", s)
    weight = spark.sparkContext.broadcast(table)

    def kernel(texts):
        keys, counts, ptr = shingles(texts, s.words)
        sig = bands(signature(keys, counts, ptr, weight.value, s), s)
        some = np.diff(ptr) > 0
        at = np.r_[0, np.cumsum(some * s.bands)]
        return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sig[some].ravel().view(np.int64)))]

    rows = docs.select("id", digest().alias("node"), "text")
    rows = written(map_texts(rows, "text", ["id", "node"], [("buckets", "array<bigint>", pa.list_(pa.int64()))], kernel), "signatures")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.first("buckets").alias("buckets"))
    each = nodes.select("node", "rep", F.explode("buckets").alias("key"))
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(each.join(counts, "key"), "members")  # key, node, rep, n: buckets with company only
    central = members.groupBy("node").agg(F.sum("n").alias("mates"))
    leads = members.select("key", "node").join(central, "node").groupBy("key").agg(F.max(F.struct("mates", "node")).alias("lead")).select("key", F.col("lead.node").alias("b"))
    star = written(members.select("key", F.col("node").alias("a")).join(leads, "key").filter("a <> b").select("a", "b").distinct(), "stars")
    # Texts of the members, one row a node: found by id and digest, so copies don't meet here.
    wanted = members.select("node", "rep").distinct()
    texts = docs.filter("text IS NOT NULL").select(F.col("id").alias("rep_id"), digest().alias("node_id"), "text")
    texts = texts.join(wanted, F.expr("rep_id <=> rep AND node_id = node")).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "texts")
    links = written(verify(star, texts, weight, s).select("a", "b"), "verified")
    roots = written(components(links), "components")
    # Buckets of three and more with several components: the remaining pairs.
    found = members.filter("n > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = found.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    open_ = found.join(mixed, "key", "left_semi").select("node", "root").distinct()
    rest = remaining(open_.join(texts, "node"), weight, s)
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(rest.join(done, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = written(verify(rest, texts, weight, s).select("a", "b"), "verified")
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = written(components(links), "components")
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = written(ends.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links")), "degrees")
    for old in (star, members, texts, rest):
        drop(old)
    # Classes: the smallest (id, node) stands for the class.
    known = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"))
    known = known.join(roots, "node", "left").join(degree, "node", "left").select("node", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    heads = known.groupBy("root").agg(F.count(F.lit(1)).alias("class_texts"), F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("head"))
    of = written(known.join(heads, "root").select("node", "links", F.col("head.rep").alias("class_id"), "class_texts", (F.col("node") == F.col("head.node")).alias("heads")), "classes")
    out = rows.select("id", "node").join(of, "node", "left")
    return out.select(
        F.col("id").alias(id_col), "node", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_texts", F.lit(1)).alias("class_texts"), F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("node").isNull(), True).otherwise(F.col("heads") & F.col("id").eqNullSafe(F.col("class_id"))).alias("is_first"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of docs with one row of each class: that of the smallest doc_id (of its smallest digest on a tie).

    Rows with a null text all stay. Of rows with equal id and text the one whose columns have the smallest digest stays.
    """
    found = classes(docs, id_col, text_col, settings).select(F.col(id_col).alias("id"), "node", "is_first")
    gone = written(found.filter("NOT is_first").select(F.col("id").alias("gone_id"), F.col("node").alias("gone_node")).distinct(), "copies")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), digest(text_col).alias("node"))  # names can't clash
    kept = packed.join(gone, F.expr("id <=> gone_id AND node = gone_node"), "left_anti")
    twice = found.filter("is_first AND node IS NOT NULL").groupBy("id", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("twice_id"), F.col("node").alias("twice_node"))
    twice = written(twice, "repeated")
    if not twice.isEmpty():
        here = F.expr("id <=> twice_id AND node = twice_node")
        one = kept.join(twice, here, "left_semi").groupBy("id", "node").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
        kept = kept.join(twice, here, "left_anti").select("row").unionByName(one.select("row"))
    return kept.select("row.*")


def op3_minhash_near_dup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select("doc_id", "class_id", "class_texts", "links", "is_first")
