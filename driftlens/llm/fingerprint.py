"""Document fingerprints (operator 6): invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs (pieces between line ends and sentence ends of any script,
distinct) are hashed to 64-bit digests; a piece of more than ``LONG`` code points
is cut further behind every four words (or letters, where there are hardly any
spaces) whose hash falls on one of ``EVERY``, so texts without sentence ends have
pieces that edits elsewhere leave alone. A sketch has three regions of M cells; a digest goes
to one cell of each region, and a cell holds a count, the XOR of its digests
and the XOR of their checks. Subtracting two texts' sketches leaves the
digests in which they differ; peeling takes cells with exactly one digest and
removes it from its other cells until no such cell is left, which recovers both
differences. Likeness is the Jaccard similarity that follows from them.

The printed fingerprint is the sketch of the text alone, with a power of two of
cells a region, at least four times its paragraphs; empty cells aren't printed.
It can be peeled itself (except in about one of 128 n texts of n paragraphs),
so two printed fingerprints determine both sets of digests, the sketches of any
larger size and the likeness of the texts. A pair is compared in sketches sized
by both paragraph counts. Where peeling ends with cells left, it is retried
with 16 times the cells and other places, until nothing is left; there is no
largest size and no other way.

Steps: one table of ids, text digests and sizes, equal rows counted; bounds of
ranges of about ``range_bytes`` of texts in descending order of the id; texts
are dealt once, by range, and meet the next one by a window. All aggregations
of the sketches keep to that; a row's other values go along as one row more of
its cells, so nothing is joined. A range with a hot id is cut within the id, by
the texts' digests; more than ``COPIES`` equal rows are one row with a number.

A peeling step looks at one region only, so a digest is taken from one cell
only, and is one grouped aggregation. Three steps are in one plan; the few rows
that aren't done then peel on in written tables. Only digests are written;
fingerprints are printed from them at the end.

``next`` is the next row by descending id (nulls last; ties by text digest,
equal rows follow each other); after the last comes the first.

Defined results: a null text counts as empty; two texts without paragraphs have
likeness 1; a single row is its own next; repeated rows each get a row; ids may
have any type with an order; very long texts are read whole; extra columns of
any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, written

#: Cells a region for each digest, fewest cells, and the factor of the retries.
SPREAD, LEAST, RETRY = 4, 32, 16
#: Equal rows above this number are one row with a number.
COPIES = 10_000
# Line ends, and sentence ends of scripts that put a space behind them and of those that don't.
SPLIT = r"[.!?]+\s+|[\r\n]+|[。！？｡．؟۔।॥။።]+\s*"
#: Code points from which on a piece is cut by its content, units (words, or letters where there are hardly any words)
#: that decide on a cut, the units from one cut to the next in the mean, and the mean letters of words at most.
LONG, NEAR, EVERY, WORD = 512, 4, 16, 32
UNIT = r"(?<=\s)(?=\S)"
#: Layout of a cell's number: what it belongs to (pair and region), the size's logarithm, the place.
KIND, SIZE = 57, 50
#: Kinds of rows beside cells: recovered digests, counts of the next pair's, values.
TAKEN, COUNTED, KEPT = 6, 7, 8


def cuts(units: Column) -> Column:
    """Places behind which a piece (an array of its units) is cut: a hash of the last few of them decides; ascending, with both ends."""
    here = lambda i: F.xxhash64(F.array_join(F.slice(units, i - NEAR + 1, F.lit(NEAR)), "")).bitwiseAND(F.lit(EVERY - 1)) == 0
    found = F.when(F.size(units) > NEAR, F.filter(F.sequence(F.lit(NEAR), F.greatest(F.size(units) - 1, F.lit(NEAR))), here)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(0)), found, F.array(F.size(units)))


def bound(value: Column, of) -> Column:
    """of(value), an array, with the value computed once: a lambda's variable is, an expression within one isn't."""
    return F.flatten(F.transform(F.array(value), of))


def pieces_of(piece: Column) -> Column:
    """A long piece, cut by its content."""
    def between(units, places):
        spans = F.arrays_zip(F.slice(places, 1, F.size(places) - 1).alias("a"), F.slice(places, 2, F.size(places) - 1).alias("b"))
        return F.transform(spans, lambda s: F.array_join(F.slice(units, s["a"] + 1, s["b"] - s["a"]), ""))

    of = lambda units: bound(cuts(units), lambda places: between(units, places))
    return bound(F.split(piece, UNIT), lambda words: F.when(F.size(words) * WORD >= F.length(piece), of(words)).otherwise(bound(F.split(piece, ""), of)))


def paragraphs(text: str) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    pieces = F.array_remove(F.split(text, SPLIT), "")
    cut = lambda own: F.flatten(F.transform(own, lambda x: F.when(F.length(x) > LONG, pieces_of(x)).otherwise(F.array(x))))
    every = bound(pieces, lambda own: F.when(F.exists(own, lambda x: F.length(x) > LONG), cut(own)).otherwise(own))
    return F.array_distinct(F.transform(every, lambda x: F.xxhash64(x)))


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(0x51ED)).bitwiseAND(F.lit(0xFFFFFFFF))


def left(value: Column, bits) -> Column:
    return F.call_function("shiftleft", value, bits if isinstance(bits, Column) else F.lit(bits))


def right(value: Column, bits) -> Column:
    return F.call_function("shiftrightunsigned", value, bits if isinstance(bits, Column) else F.lit(bits))


def bits_of(n: Column, times: int = 0) -> Column:
    """Logarithm of the cells a region for n digests, grown by 16**times."""
    cells = F.greatest(SPREAD * n, F.lit(LEAST)).cast("double")
    return (F.ceil(F.log2(cells)) + 4 * times).cast("int")


def place(digest: Column, region: Column, bits: Column, times: int) -> Column:
    """Cell of a digest in a region. Sketches up to 2**20 cells take parts of the digest; retries hash it anew."""
    h = right(digest, 21 * region) if not times else F.xxhash64(digest, region, F.lit(times))
    return h.bitwiseAND(left(F.lit(1).cast("long"), bits) - 1)


def number(kind: Column, bits: Column, at: Column) -> Column:
    return left(kind.cast("long"), KIND) + left(bits.cast("long"), SIZE) + at


def choose(number_: Column, values: list[Column]) -> Column:
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(number_ == i, v).otherwise(out)
    return out


def ints(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


# Arrangement: rows beside the next row's text.


def equal_rows(docs: DataFrame) -> DataFrame:
    """id, nd, times, bytes: a row for each id and text; ascending (id, nd) is the descending order, read backwards."""
    return docs.groupBy("id", "nd").agg(F.count(F.lit(1)).alias("times"), F.sum(F.octet_length("text").cast("long") + 32).alias("bytes"))


def bounds_of(equal: DataFrame, ranges: int) -> Column:
    """A literal struct: the greatest (id, nd) of each range in ascending order in chunks of about sqrt(ranges), the last of each chunk, and their number.

    The driver gets one small value a range. It passes as JSON, which holds whatever type the ids have; that it reads back as written is checked.
    """
    width = max(1, round(ranges**0.5))
    tops = equal.select("id", "nd").repartitionByRange(ranges, "id", "nd").groupBy(F.spark_partition_id().alias("range")).agg(F.max(F.struct("id", "nd")).alias("top"))
    every = tops.agg(F.sort_array(F.collect_list("top")).alias("tops"))
    starts = F.sequence(F.lit(1), F.size("tops"), F.lit(width))
    made = every.select(F.transform(starts, lambda i: F.slice("tops", i, width)).alias("chunks"), F.size("tops").alias("n"))
    made = made.select(F.struct(F.transform("chunks", lambda c: F.element_at(c, -1)).alias("tops"), "chunks", "n").alias("bounds"))
    kind, form = made.schema["bounds"].dataType, {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    told = made.select(F.to_json("bounds", form).alias("told"), F.from_json(F.to_json("bounds", form), kind, form).eqNullSafe(F.col("bounds")).alias("same")).first()
    if not told["same"]:
        raise ValueError("ids of this type can't be told as JSON; cast them to a string")
    return F.from_json(F.lit(told["told"]), kind, form)


def arranged(docs: DataFrame, id_col: str, text_col: str, range_bytes: int) -> tuple[DataFrame, int, bool] | None:
    """(rows, number of ranges, whether there are hot equal rows); rows have bucket, r, id, times, text, next, a and c (digests of both)."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("nd", F.bitwise_not(F.xxhash64("text")))
    equal = written(equal_rows(own), "equal")
    found = equal.agg(F.sum("bytes").alias("bytes"), F.max("times").alias("times")).first()
    if not found["bytes"]:
        return None
    ranges = max(16 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found["bytes"] // range_bytes))
    hot_rows = found["times"] > COPIES
    own = own.withColumn("times", F.lit(1).cast("long"))
    if hot_rows:
        hot = equal.filter(F.col("times") > COPIES).select(F.col("id").alias("i"), F.col("nd").alias("d"))
        same = F.expr("id <=> i AND nd = d")
        few = own.join(hot, same, "left_semi").groupBy("id", "nd").agg(F.first("text").alias("text"), F.sum("times").alias("times"))
        own = own.join(hot, same, "left_anti").select("id", "text", "nd", "times").unionByName(few)
    b = bounds_of(equal, ranges)
    key = F.struct("id", "nd")
    chunk = F.size(F.filter(b["tops"], lambda t: t < key))
    below = F.get(b["chunks"], F.col("chunk"))
    row = own.withColumn("chunk", chunk).withColumn("width", F.size(F.get(b["chunks"], F.lit(0)))).withColumn("n", b["n"])
    row = row.withColumn("inside", F.size(F.filter(below, lambda t: t < key))).withColumn("top", F.get(below, F.col("inside")) == key)
    row = row.withColumn("bucket", F.col("chunk") * F.col("width") + F.col("inside"))
    # The greatest row of a range also ends the range above it, and the first row ends the last range.
    up = F.when(F.col("bucket") + 1 == F.col("n"), 0).otherwise(F.col("bucket") + 1)
    places = F.when(F.col("top"), ints(0, 1)).otherwise(ints(0))
    dealt = row.select("id", "nd", "text", "times", "bucket", up.alias("up"), F.explode(places).alias("tail"))
    dealt = dealt.select("id", "nd", "text", "times", "tail", F.when(F.col("tail") == 1, F.col("up")).otherwise(F.col("bucket")).alias("bucket")).repartition(ranges, "bucket")
    dealt = dealt.withColumn("a", paragraphs("text"))
    order = Window.partitionBy("bucket").orderBy("tail", F.col("id").desc_nulls_last(), F.col("nd").desc())
    out = dealt.withColumn("rn", F.row_number().over(order)).withColumn("after", F.lead(F.struct("text", "a")).over(order)).filter("tail = 0")
    out = out.withColumn("r", left(F.col("bucket").cast("long"), 36) + 2 * F.col("rn"))
    if hot_rows:  # all but the last of equal rows are followed by one of them
        after = F.col("after")
        again = F.struct(F.col("r"), F.lit(1).cast("long").alias("times"), after.alias("after"))
        self_ = F.struct((F.col("r") + 1).alias("r"), (F.col("times") - 1).alias("times"), F.struct("text", "a").alias("after"))
        out = out.withColumn("e", F.explode(F.when(F.col("times") > 1, F.array(again, self_)).otherwise(F.array(again)))).select("bucket", "id", "text", "a", "e.*")
    return out.select("bucket", "r", "id", "times", "text", F.col("after.text").alias("next"), "a", F.col("after.a").alias("c")), ranges, hot_rows


def with_digests(rows: DataFrame) -> DataFrame:
    """bucket, r, id, times, n_chars, edited_sha256, and the digests a, b, c of the text, the edited and the next one."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half))
    named = rows.withColumn("edited", edited)
    return named.select("bucket", "r", "id", "times", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "a", paragraphs("edited").alias("b"), "c")


# Sketches and peeling. A table of cells has bucket (its partitioning), r, x (the cell's number), n, k, c, and p, which
# is null but in the one row for each r that carries the row's own values.

VALUES = ["id", "times", "n_chars", "edited_sha256", "a", "b", "c"]


def summed(cells: DataFrame) -> DataFrame:
    """Cells that aren't empty after adding equal ones."""
    return cells.groupBy("bucket", "r", "x", "p").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")).filter("n <> 0 OR k <> 0 OR c <> 0")


def differences(sides: DataFrame, times: int) -> DataFrame:
    """Cells of own minus edited (kinds 0 to 2) and own minus next (3 to 5), and the rows' values."""
    na, nb, nc = (F.size(s) for s in "abc")
    each = sides.select("*", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "a", "b", "c")).alias("i", "k"))
    # Which: 0 own, 1 edited, 2 next, 3 the values.
    which = F.when(F.col("i") == 0, 3).when(F.col("i") <= na, 0).when(F.col("i") <= na + nb, 1).otherwise(2)
    each = each.withColumn("which", which)
    each = each.withColumn("j", F.explode(choose(F.col("which"), [ints(0, 1, 2, 3, 4, 5), ints(0, 1, 2), ints(3, 4, 5), ints(KEPT)])))
    j, k = F.col("j"), F.col("k")
    bits = F.when(j < 3, bits_of(na + nb, times)).otherwise(bits_of(na + nc, times))
    x = F.when(j == KEPT, number(j, F.lit(0), F.lit(0))).otherwise(number(j, bits, place(k, j % 3, bits, times)))
    values = F.when(j == KEPT, F.struct(*VALUES))
    return summed(each.select("bucket", "r", x.alias("x"), F.when(F.col("which").isin(1, 2), -1).otherwise(1).cast("long").alias("n"), "k", check(k).alias("c"), values.alias("p")))


def step(cells: DataFrame, region: int, times: int) -> DataFrame:
    """Takes the lone digests of one region out of the other two and lists them.

    Digests of the edited pair are listed one by one, those of the next pair are counted by sign.
    """
    kind, bits = right(F.col("x"), KIND).cast("int"), right(F.col("x"), SIZE).bitwiseAND(F.lit(127)).cast("int")
    low = F.col("x").bitwiseAND(F.lit((1 << SIZE) - 1))
    k, n = F.col("k"), F.col("n")
    pure = (kind < TAKEN) & (kind % 3 == region) & (F.abs(n) == 1) & (F.col("c") == check(k)) & (low == place(k, F.lit(region), bits, times))
    named = cells.withColumn("j", F.explode(F.when(pure, ints(0, 1, 2)).otherwise(ints(3))))
    first = kind - F.lit(region)
    listed = F.when(first == 0, number(F.lit(TAKEN), F.lit(0), k.bitwiseAND(F.lit((1 << KIND) - 1)))).otherwise(number(F.lit(COUNTED), F.lit(0), (n > 0).cast("long")))
    other = lambda g: number(first + g, bits, place(k, F.lit(g), bits, times))
    rest = [g for g in range(3) if g != region]
    x = choose(F.col("j"), [listed, other(rest[0]), other(rest[1]), F.col("x")])
    moved = F.col("j").isin(1, 2)
    return summed(named.select("bucket", "r", "p", x.alias("x"), F.when(moved, -n).otherwise(n).alias("n"), "k", "c"))


def outcome(cells: DataFrame) -> DataFrame:
    """r, p, ok (no cell is left), only_text, only_edited (recovered digests), gone and come (their numbers for the next text)."""
    kind = right(F.col("x"), KIND)
    one = lambda sign: F.sort_array(F.collect_list(F.when((kind == TAKEN) & (sign * F.col("n") > 0), F.col("k"))))
    many = lambda sign: F.coalesce(F.sum(F.when((kind == COUNTED) & (sign * F.col("n") > 0), F.abs("n"))), F.lit(0))
    return cells.groupBy("bucket", "r").agg(
        F.first("p", ignorenulls=True).alias("p"), (F.count(F.when(kind < TAKEN, 1)) == 0).alias("ok"),
        one(1).alias("only_text"), one(-1).alias("only_edited"), many(1).alias("gone"), many(-1).alias("come"),
    ).drop("bucket")


def peeled_to_the_end(sides: DataFrame, times: int) -> DataFrame:
    """``outcome`` of these rows after peeling until no cell holds a lone digest; each round is a written table."""
    cells = written(differences(sides.withColumn("bucket", F.col("r")).repartition("bucket"), times), "cells")
    taken = -1
    while True:
        again = cells.repartition("bucket")
        for region in range(3):
            again = step(again, region, times)
        again = written(again, "cells")
        drop(cells)
        cells = again
        kind = right(F.col("x"), KIND)
        found = cells.agg(F.count(F.when(kind < TAKEN, 1)).alias("left"), F.sum(F.when(kind.isin(TAKEN, COUNTED), F.abs("n"))).alias("taken")).first()
        if not found["left"] or found["taken"] == taken:
            return outcome(cells.repartition("bucket"))
        taken = found["taken"]


def prints(sides: DataFrame) -> DataFrame:
    """r, fp_0, fp_1: printed sketches of the text and of the edited one.

    A cell is printed as place and region, count (if above 1) and XOR of the digests; it needs no check, for nothing
    was subtracted: a count of 1 is a digest.
    """
    na, nb = F.size("a"), F.size("b")
    each = sides.select("r", na.alias("na"), nb.alias("nb"), F.posexplode(F.concat("a", "b")).alias("i", "k")).withColumn("j", F.explode(ints(0, 1, 2)))
    own = F.col("i") < F.col("na")
    bits = printed_bits(F.when(own, F.col("na")).otherwise(F.col("nb")))
    at = left(left(place(F.col("k"), F.col("j"), bits, 0), 2) + F.col("j"), 1) + F.when(own, 0).otherwise(1)
    cells = each.select("r", at.alias("x"), "k").groupBy("r", "x").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("k").alias("k"))
    text = F.concat(F.hex(right(F.col("x"), 1)), F.when(F.col("n") == 1, ".").otherwise(F.concat(F.lit("."), F.col("n").cast("string"), F.lit("."))), F.hex("k"))
    told = cells.select("r", (F.col("x") % 2).alias("w"), text.alias("text")).select("r", *[F.when(F.col("w") == w, F.col("text")).alias(f"t{w}") for w in (0, 1)])
    lists = [F.array_join(F.sort_array(F.collect_list(f"t{w}")), ";").alias(f"fp_{w}") for w in (0, 1)]
    return told.groupBy("r").agg(*lists)


def printed_bits(n: Column) -> Column:
    return F.least(bits_of(n), F.lit(20))


RECOVERED = ["only_text", "only_edited", "gone", "come"]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 128 << 20) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs,
    only_text and only_edited (the recovered digests of paragraphs that the other version lacks)."""
    spark = docs.sparkSession
    made = arranged(docs, id_col, text_col, range_bytes)
    if made is None:
        empty = docs.select(F.col(id_col)).limit(0)
        kinds = {"n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double", "n_paragraphs": "long", "only_text": "array<bigint>", "only_edited": "array<bigint>"}
        return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    rows, ranges, hot = made
    cells = differences(with_digests(rows), 0)
    for region in range(3):
        cells = step(cells, region, 0)
    done = written(outcome(cells), "sketches")
    out, failed = done.filter("ok"), done.filter("NOT ok")
    times = 0
    while not failed.isEmpty():
        tried = written(peeled_to_the_end(failed.select("r", "p.*"), times).select(*done.columns), "sketches")
        out, failed = out.unionByName(tried.filter("ok")), tried.filter("NOT ok")
        times += 1
    named = out.select("r", "p.id", "p.times", "p.n_chars", "p.edited_sha256", F.size("p.a").cast("long").alias("na"), F.size("p.b").alias("nb"), *RECOVERED).repartition(ranges, "r")
    fps = prints(out.select("r", "p.a", "p.b").repartition(ranges, "r")).hint("shuffle_hash")  # a task holds the strings of its rows
    out = named.join(fps, "r", "left")
    printed = [F.concat(printed_bits(F.col(n)).cast("string"), F.lit("/"), F.coalesce(F.col(f"fp_{w}"), F.lit(""))).alias(name) for w, (n, name) in enumerate((("na", "fingerprint"), ("nb", "edited_fingerprint")))]
    pairs = {"near_edited": (F.size("only_text"), F.size("only_edited")), "near_next": (F.col("gone"), F.col("come"))}
    near = [F.when(F.col("na") + come > 0, (F.col("na") - gone) / (F.col("na") + come)).otherwise(1.0).alias(name) for name, (gone, come) in pairs.items()]
    if hot:  # copies are dealt in parts before they become rows
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {COPIES}")))
        many = out.filter("times > 1").withColumn("part", part).repartition("r", "part")
        many = many.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("times") - F.col("part") * COPIES))))
        out = out.filter("times = 1").unionByName(many.drop("part", "nth"))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", *printed, *near, F.col("na").alias("n_paragraphs"), "only_text", "only_edited")


def op6_iblt_fingerprint(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fingerprints(docs)
