"""Sending changes to those who asked for them, and the log of what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.predicates import Filters, matches_fixed, normal_filters
from ..functions.text import fold, normalize

ALL = "All monitored changes"
#: Letters of an index key, and the routes up to which keys aren't measured (they are broadcast, so no key gathers).
GRAM, FEW = 3, 256
PAGE = "p:"


def grams(value: Column, n: int) -> Column:
    """All substrings of n code points."""
    return F.when(F.length(value) >= n, F.transform(F.sequence(F.lit(1), F.length(value) - n + 1), lambda i: F.substring(value, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def keyed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v))


def subject_keys(lengths: list[int], salts: int) -> Column:
    """Keys under which a change (own_s, own_t, own_e, key) may meet a route."""
    parts = [F.array(F.concat(F.lit("e:"), "own_e"), F.concat(F.lit("u:"), F.pmod(F.xxhash64("key"), F.lit(salts)).cast("string")))]
    parts += [keyed(kind, grams(F.col(f"own_{kind}"), n)) for kind in "st" for n in lengths]
    return F.when(F.col("page"), F.array(F.lit(PAGE))).otherwise(F.array_distinct(F.concat(*parts)))


def tidy_routes(routes: DataFrame) -> DataFrame:
    """row (the route), s, t, e (its filters, normalised and folded), text (whether it takes page text)."""
    s, t, e = normal_filters(F.col("sections"), F.col("titles"), F.col("extensions"))
    folded = lambda a: F.array_distinct(F.transform(a, fold))
    return routes.select(F.struct(*routes.columns).alias("row"), folded(s).alias("s"), folded(t).alias("t"), F.array_distinct(e).alias("e"), F.coalesce("include_page_text", F.lit(False)).alias("text"))


def everything(routes: DataFrame) -> Column:
    return (F.size("s") == 0) & (F.size("t") == 0) & (F.size("e") == 0)


def postings(routes: DataFrame, changes: DataFrame | None, lengths: list[int], salts: int) -> DataFrame:
    """index_key, kind, nth, row, s, t, e: under which keys the changes find each route.

    A route is posted for one of its dimensions only, there under one key for each value: the value's rarest trigram
    among the changes (shorter values: all of it). Of the dimensions the one whose keys are rarest in sum is taken.
    """
    numbered = routes.withColumn("rid", F.monotonically_increasing_id())
    value = lambda kind, values: F.transform(F.col(values), lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), v.alias("value")))
    each = numbered.filter(~everything(numbered)).select("rid", "row", "s", "t", "e", F.explode(F.concat(value("s", "s"), value("t", "t"), value("e", "e"))).alias("x")).select("rid", "row", "s", "t", "e", "x.*")
    length = F.least(F.lit(GRAM), F.length("value"))
    of_length = F.lit(None).cast("array<string>")
    for n in range(1, GRAM + 1):
        of_length = F.when(length == n, grams(F.col("value"), n)).otherwise(of_length)
    found = F.when(F.col("kind") == "e", F.array("value")).otherwise(of_length)
    each = each.withColumn("index_key", F.explode(F.transform(found, lambda g: F.concat("kind", F.lit(":"), g))))
    if changes is None:
        each = each.withColumn("n", F.lit(0).cast("long"))
    else:
        seen = changes.select(F.explode(subject_keys(lengths, salts)).alias("index_key")).groupBy("index_key").agg(F.count(F.lit(1)).alias("n"))
        each = each.join(seen, "index_key", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    best = each.groupBy("rid", "kind", "nth").agg(F.min(F.struct("n", "index_key")).alias("least"), F.first(F.struct("row", "s", "t", "e")).alias("route"))
    of_kind = best.groupBy("rid", "kind").agg(F.sum("least.n").alias("cost"), F.collect_list(F.struct("nth", F.col("least.index_key").alias("index_key"))).alias("keys"), F.first("route").alias("route"))
    chosen = of_kind.groupBy("rid").agg(F.min_by(F.struct("kind", "keys", "route"), F.struct("cost", "kind")).alias("x"))
    values = chosen.select(F.col("x.kind").alias("kind"), F.explode("x.keys").alias("k"), "x.route.*").select("k.index_key", "kind", "k.nth", "row", "s", "t", "e")
    page = routes.filter("text").select(F.lit(PAGE).alias("index_key"), F.lit("p").alias("kind"), F.lit(0).alias("nth"), "row", "s", "t", "e")
    salted = F.explode(F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.concat(F.lit("u:"), i.cast("string"))))
    every = routes.filter(everything(routes)).select(salted.alias("index_key"), F.lit("u").alias("kind"), F.lit(0).alias("nth"), "row", "s", "t", "e")
    return values.unionByName(page).unionByName(every)


def routed(changes: DataFrame, routes: DataFrame) -> DataFrame:
    """Changes x routes where the route's filters match the change's subject; page text only for routes that ask for it.

    An inverted index in place of a test of all pairs: routes stand under rare trigrams of their own values
    (``postings``), changes look up the trigrams of their section and title and their extension, and what meets is
    tested in full. A pair counts where the first matching value of the posted dimension met, so it comes once. Routes
    without any value meet all changes under keys dealt by the change's hash, so no key holds all changes.
    """
    return _met(changes, tidy_routes(routes)).select(*[F.col(f"change.{c}").alias(c) for c in changes.columns], "row.*")


def _met(changes: DataFrame, tidy: DataFrame) -> DataFrame:
    spark = changes.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    page = F.col("category") == "page_text_changed"
    none = F.lit("")
    own = changes.select(
        F.struct(*changes.columns).alias("change"), F.coalesce(page, F.lit(False)).alias("page"), F.coalesce(F.col("key").cast("string"), none).alias("key"),
        fold(F.coalesce("section", none)).alias("own_s"), fold(F.coalesce("title", none)).alias("own_t"), urls.suffix(F.coalesce("url", none)).alias("own_e"),
    )
    value_lengths = tidy.select(F.explode(F.concat("s", "t")).alias("v")).select(F.least(F.lit(GRAM), F.length("v")).alias("n")).distinct()
    lengths = sorted(r["n"] for r in value_lengths.collect() if r["n"])  # three at most
    few = tidy.limit(FEW + 1).count() <= FEW
    index = postings(tidy, None if few else own, lengths, 1 if few else salts)
    both = own.withColumn("index_key", F.explode(subject_keys(lengths, 1 if few else salts))).join(F.broadcast(index) if few else index, "index_key")
    first = lambda values, of: F.array_position(F.transform(values, lambda v: F.contains(of, v)), True) == F.col("nth") + 1
    some = lambda values, of: (F.size(values) == 0) | F.exists(values, lambda v: F.contains(of, v))
    met = F.when(F.col("kind") == "s", first(F.col("s"), F.col("own_s"))).when(F.col("kind") == "t", first(F.col("t"), F.col("own_t"))).otherwise(F.lit(True))
    hit = met & some(F.col("s"), F.col("own_s")) & some(F.col("t"), F.col("own_t")) & ((F.size("e") == 0) | F.array_contains("e", F.col("own_e")))
    return both.filter(F.col("page") | hit).select("change", "row")


def filtered(changes: DataFrame, filters: Filters, include_page_text: bool = False) -> DataFrame:
    """The changes whose subject matches; the page text's only if asked for."""
    page = F.col("category") == "page_text_changed"
    return changes.filter((page & F.lit(include_page_text)) | (~page & matches_fixed(F.col("section"), F.col("title"), F.col("url"), filters)))


def batches(changes: DataFrame, routes: DataFrame, everyone: list[str]) -> DataFrame:
    """label, recipients, n: global recipients get all; a route's other recipients get what it matches.

    Routes without any value aren't met with the changes: these are counted once for all of them.
    """
    known = F.array(*[F.lit(x) for x in everyone]).cast("array<string>")
    tidy = tidy_routes(routes)
    every, some = tidy.filter(everything(tidy)), tidy.filter(~everything(tidy))
    page = F.coalesce(F.col("category") == "page_text_changed", F.lit(False))
    numbers = changes.agg(F.count(F.when(~page, 1)).alias("own"), F.count(F.when(page, 1)).alias("pages"))
    named = lambda d: d.select(F.col("row.name").alias("label"), F.array_except(F.array_distinct("row.recipients"), known).alias("to"), *[c for c in d.columns if c != "row"]).filter(F.size("to") > 0)
    matched = named(_met(changes, some).select("row")).groupBy("label", "to").agg(F.count(F.lit(1)).alias("n"))
    whole = named(every.select("row", (numbers.select("own").scalar() + F.when(F.col("text"), numbers.select("pages").scalar()).otherwise(0)).alias("n")))
    whole = whole.groupBy("label", "to").agg(F.sum("n").alias("n")).filter("n > 0")
    own = matched.unionByName(whole).groupBy("label", "to").agg(F.sum("n").alias("n"))
    all_ = changes.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(ALL).alias("label"), F.array_distinct(known).alias("to"), "n").filter(F.size("to") > 0)
    return all_.unionByName(own).select("label", F.array_join("to", ";").alias("recipients"), "n")


def failure_streaks(events: DataFrame, by: str, ts: str, seq: str, failed: str) -> DataFrame:
    """by, streak: failures since the last success, without ordering all events: those after the newest success are counted."""
    at = F.struct(ts, seq)
    marks = events.groupBy(by).agg(F.max(F.when(~F.col(failed), at)).alias("ok"))
    return events.join(marks, by).groupBy(by).agg(F.count(F.when(F.col(failed) & (F.col("ok").isNull() | (at > F.col("ok"))), 1)).alias("streak"))


def heartbeat_due(last: F.Column, now: F.Column, days: float) -> F.Column:
    """Whether a heartbeat is due: never for 0 days or fewer, always without a readable last time."""
    if days <= 0:
        return F.lit(False)
    passed = F.unix_timestamp(F.to_timestamp(now)) - F.unix_timestamp(F.try_to_timestamp(last.cast("string")))
    return F.coalesce(passed >= days * 86400, F.lit(True))


def error_digest(errors: DataFrame, most: int = 3500) -> DataFrame:
    """One row: all ``title: error`` joined by `` | ``, cut, and their number.

    A line takes four characters at least with the mark between, so the first ``most`` / 4 lines in order fill the text
    whatever follows: no more are gathered.
    """
    said = lambda c, none: F.coalesce(normalize(F.col(c)), F.lit(none))
    line = F.concat_ws(": ", said("title", "Document"), said("error", "Unavailable"))
    first = errors.select("pos", line.alias("line")).orderBy("pos", "line").limit(most // 4 + 2)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " | ")
    told = first.agg(F.when(F.length(joined) > most, F.concat(F.left(joined, F.lit(most - 1)), F.lit("…"))).otherwise(joined).alias("digest"))
    return errors.agg(F.count(F.lit(1)).alias("n")).select(told.scalar().alias("digest"), "n")


def confirmed(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second change set stands if it has any change; with none, the first is suppressed."""
    return second if not second.isEmpty() else first.limit(0)


def retained(history: DataFrame, by: str, most: int) -> DataFrame:
    """The newest rows of each log; Spark limits ranks within tasks before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.col("event_ts").desc(), F.col("seq").desc())
    return history.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, most))
