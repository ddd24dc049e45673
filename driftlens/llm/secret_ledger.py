"""Secret scans (operator 13): an incremental ledger of content-addressed blobs.

A version is a path and its text at some time; a blob is a text under its
SHA-256 address, whatever the number of versions and paths that have it. The
ledger is a folder with one sub-folder a run, each a table of (blob, scanned
rules, spans): the rules with their versions, such as ``hex@1``, that were
applied to the blob, and what they found. A run

1. reduces the given versions to distinct blobs: texts are dropped by a partial
   aggregate within each task before any is sent, so copies cost nothing;
2. joins the blobs with the ledger, by address, and keeps of each the rules
   whose current version the ledger doesn't have for it;
3. scans only these (blob, rule version) pairs, each once, and appends them to
   the ledger. A run's rows count from the moment its ``_SUCCESS`` file is
   there, so a run that is broken off leaves nothing that is read, and a run
   after it scans what was lost;
4. joins the ledger's findings back to all paths by their address. Blobs without
   findings, nearly all, aren't joined.

A changed rule gets a new version and is alone scanned again, over the texts
that are given; what its former versions found is no longer reported.

The three base rules follow the query's contract; ``added`` rules find secrets
by their issuers' published formats. Matches of a rule are leftmost and don't
overlap; spans of different rules may. Offsets are code points, ends exclusive.

Defined results: a null text is empty; empty texts have no findings; very long
texts are scanned whole; repeated rows each get a row; null paths are kept;
extra columns of any name are ignored; an empty table gives no rows and adds an
empty run. Spans are ordered by start, then by the rules' order, then by end.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import SLICE_ROWS
from .shared import shared_dir


def any_case(words: str) -> str:
    """A pattern's ASCII letters in either case; engines' own case folding knows more letters than A to Z."""
    return re.sub("[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}]", words)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, what its match must hold at least, and a version to be raised when any of it changes.

    ``needs`` are lower-case strings of which every match holds one, in any case: texts without any aren't scanned.
    ``least`` is the least length of the group ``of`` (0: the whole match); shorter matches are passed over.
    """

    name: str
    pattern: str
    least: int = 1
    of: int = 0
    needs: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The base patterns and least lengths, and the formats that issuers publish.
BASE = (
    Rule("assign", f"({any_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2, ("passw", "secret", "token", "api")),
    Rule("access", "AKIA[A-Z0-9]+", 20, needs=("akia",)),
    Rule("hex", "[0-9a-f]+", 24),
)
ADDED = (
    Rule("temporary", "ASIA[A-Z0-9]{16,}", needs=("asia",)),
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\x20\\x09-\\x0D]*(-----END [A-Z ]*PRIVATE KEY-----)?", needs=("private key-----",)),
    Rule("forge", "gh[opsur]_[A-Za-z0-9]{36,}", needs=("gh",)),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("maps", "AIza[A-Za-z0-9_-]{35}", needs=("aiza",)),
    Rule("payment", "[rs]k_(live|test)_[A-Za-z0-9]{16,}", needs=("k_live_", "k_test_")),
    Rule("bearer", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", needs=("eyj",)),
    Rule("login", "[A-Za-z][A-Za-z0-9+.-]*://[^\\x00-\\x20/:@\"'<>]+:[^\\x00-\\x20/:@\"'<>]+@", needs=("://",)),
)
RULES = BASE + ADDED

SPAN = "struct<name:string,at:bigint,end:bigint>"
LEDGER = f"blob string, rules array<string>, spans array<{SPAN}>"


def address(text: Column) -> Column:
    """The address of a text's blob."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def spans_of(text: str, low: str, rule: Rule, pattern: re.Pattern) -> list[tuple[str, int, int]]:
    if rule.needs and not any(n in low for n in rule.needs):
        return []
    found = ((m.end(rule.of) - m.start(rule.of), m.span()) for m in pattern.finditer(text))
    return [(rule.name, *span) for size, span in found if size >= rule.least]


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's rows of blobs (blob, text, todo: keys of the rules to apply)."""

    def run(batches):
        known = [(r, re.compile(quick(r))) for r in rules]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = []
                for text, todo in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    low = text.lower()
                    todo = set(todo)
                    found.append([{"name": n, "at": a, "end": b} for r, p in known if r.key in todo for n, a, b in spans_of(text, low, r, p)])
                kind = pa.list_(pa.struct([("name", pa.string()), ("at", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, kind)], names=["blob", "rules", "spans"])

    return blobs.select("blob", "text", "todo").mapInArrow(run, LEDGER)


def quick(rule: Rule) -> str:
    """The pattern; a run of one class that must be long is asked for as such, so short runs are left at once."""
    m = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{m[1]}{{{rule.least},}}" if m and not rule.of else rule.pattern


class Ledger:
    """Scanned (blob, rule version) pairs and their findings below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        if len({r.name for r in rules}) < len(rules):
            raise ValueError("two rules have one name")
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def runs(self) -> list[str]:
        """Folders of the runs that ended."""
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(context._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        folders = [s.getPath() for s in fs.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith("run-")]
        return sorted(p.toString() for p in folders if fs.exists(context._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def rows(self) -> DataFrame:
        """All rows of the ledger."""
        runs = self.runs()
        return self.spark.read.schema(LEDGER).parquet(*runs) if runs else self.spark.createDataFrame([], LEDGER)

    def unseen(self, versions: DataFrame, text_col: str = "text") -> DataFrame:
        """blob, text, todo: the distinct blobs of the versions and the keys of the rules that the ledger lacks for them."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        blobs = versions.select(text.alias("text")).withColumn("blob", F.sha2("text", 256)).groupBy("blob").agg(F.first("text").alias("text"))
        wanted = F.array(*[F.lit(r.key) for r in self.rules])
        if not self.runs():
            return blobs.withColumn("todo", wanted)
        done = self.rows().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        both = blobs.join(done, "blob", "left")
        todo = F.when(F.col("done").isNull(), wanted).otherwise(F.array_except(wanted, F.col("done")))
        return both.select("blob", "text", todo.alias("todo")).filter(F.size("todo") > 0)

    def update(self, versions: DataFrame, text_col: str = "text") -> str:
        """Scans what the ledger lacks and appends it; returns the run's folder."""
        made = f"{self.path}/run-{uuid.uuid4().hex}"
        scan(self.unseen(versions, text_col), self.rules).write.parquet(made)
        return made

    def findings(self) -> DataFrame:
        """blob, spans (ordered, distinct) of the current rule versions; blobs without any aren't listed."""
        keys = {r.key: r.name for r in self.rules}
        # A rule's former version may have found spans under the same name; they were written by a row that names it.
        current = F.array(*[F.lit(n) for n in keys.values()])
        named = F.filter("rules", lambda r: r.isin(*keys))
        names = F.transform(named, lambda r: F.substring_index(r, "@", 1))
        rows = self.rows().filter(F.size("spans") > 0).select("blob", F.filter("spans", lambda s: F.array_contains(names, s["name"])).alias("spans")).filter(F.size("spans") > 0)
        order = F.transform("spans", lambda s: F.struct(s["at"].alias("at"), F.array_position(current, s["name"]).alias("nth"), s["end"].alias("end"), s["name"].alias("name")))
        return rows.select("blob", F.explode(order).alias("span")).groupBy("blob").agg(F.sort_array(F.collect_set("span")).alias("spans"))

    def join_back(self, versions: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """A row for each version: the kept columns and spans (array of name, at, end; empty if there are none)."""
        own = versions.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], address(F.col(text_col)).alias("blob"))
        both = own.join(self.findings(), "blob", "left")
        spans = F.transform(F.coalesce("spans", F.array().cast("array<struct<at:bigint,nth:bigint,end:bigint,name:string>>")), lambda s: F.struct(s["name"].alias("name"), s["at"].alias("at"), s["end"].alias("end")))
        return both.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], spans.alias("spans"))


def of_kinds(spans: Column, names: list[str]) -> Column:
    return F.filter(spans, lambda s: s["name"].isin(*names))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["at"].cast("string"), s["end"].cast("string"))), ",")


def scanned(ledger: Ledger, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Updates the ledger with the versions; a row each: id, n_assign, n_access, n_hex, base_sha256, spans."""
    ledger.update(versions, text_col)
    found = ledger.join_back(versions, [id_col], text_col)
    number = [F.size(of_kinds(F.col("spans"), [r.name])).cast("long").alias(f"n_{r.name}") for r in BASE]
    return found.select(id_col, *number, F.sha2(listed(of_kinds(F.col("spans"), [r.name for r in BASE])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The documents as versions of a new ledger."""
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    return scanned(ledger, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """DuckDB SQL with the query's rows: the pieces between matches give the places of a rule's matches."""
    each = []
    for k, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        size = f"length(regexp_extract(list_extract(hits, i), '{pattern}', {r.of}))" if r.of else "length(list_extract(hits, i))"
        each.append(f"""SELECT doc_id, copy, {k} AS nth, '{r.name}' AS kind, list_extract(places, i) AS lo, list_extract(places, i) + length(list_extract(hits, i)) AS hi
  FROM (SELECT *, list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)) AS places
    FROM (SELECT doc_id, copy, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM docs WHERE regexp_matches(text, '{pattern}'))),
  LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i) WHERE {size} >= {r.least}""")
    numbers = ", ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in BASE)
    line = "string_agg(kind || ':' || lo::BIGINT || ':' || hi::BIGINT, ',' ORDER BY lo, nth, hi)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS copy FROM documents),
found AS ({' UNION ALL '.join(each)}),
grouped AS (
  SELECT copy, {numbers}, {line} FILTER (nth < {len(BASE)}) AS base, {line} AS spans FROM found GROUP BY copy
)
SELECT d.doc_id, {', '.join(f'coalesce(g.n_{r.name}, 0) AS n_{r.name}' for r in BASE)}, sha256(coalesce(g.base, '')) AS base_sha256, coalesce(g.spans, '') AS spans
FROM docs d LEFT JOIN grouped g ON g.copy = d.copy
"""


ORACLE_SQL = _oracle()
