"""Conversation structure repair (operator 12): cost-to-go over turns and grammar state, then a greedy walk.

A turn is blank (no character but spaces), a duplicate (role and text seen
earlier in its conversation) or truncated (its last character that isn't space
doesn't end a sentence); the first fault counts. The repaired roles' initials
must read ``(s?(ua)+)?``. Edits: Keep, Rerole to user or assistant, Delete
(required for blank and duplicate turns), Insert an empty user or assistant turn.

The states of the grammar are: nothing yet, after a system turn, after a user
turn, after an assistant turn. Backwards over the turns, ``value[turn, state]``
is the least cost from there to a legal end. Forwards, each turn takes the
ASCII-least edit among those whose cost and the value behind it equal the value
here. More than one insertion before a kept or reroled turn only costs more (the
grammar alternates), and an insertion before a deletion can follow it, so a
turn's edits are D, IK, IR, K or R, in this order, and the walk gives the
ASCII-least of all cheapest edit strings.

Conversations of up to ``block_turns`` turns are repaired a batch at a time, all
advancing together. A longer one is sorted by ranges, numbered by prefix counts
and cut into blocks; a block's turns are one 4 x 4 matrix in the (min, +)
semiring, values at the blocks' ends follow from the matrices behind them, and
where each block's walk leads from each of the four states settles the states
in which the blocks begin. So results don't depend on ``block_turns`` and no
task holds a long conversation. Only its audit (a letter an edit) and the digest
of its repaired turns are made in one task, from a sorted stream, for a digest
is sequential by nature.

Defined results: turns are ordered by number (nulls first), then role, then
text (equal rows follow each other and are duplicates); a null role or text is
one space; a role counts by its first letter as it stands, and any other than
s, u and a can be reroled or deleted only; null conv_ids are one conversation;
very long texts are read whole; rows marked as absent only keep their
conversation's id in the result; a conversation without rows has zeros, an
empty audit and the digest of the empty string; extra columns of any name are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chat import runs_of, starts_of
from .shared import written

# Costs, edits in ASCII order, faults.
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 3, 4, 3, 3
EDITS = ("D", "IK", "IR", "K", "R")
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
FAULTS = ("", "blank", "duplicate", "truncated")
#: States, the role that an insertion or reroling has in each, and the state after it.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: Insertions that end a conversation legally from each state.
TAIL = np.array([0, 2, 1, 0])
INITIALS = "sua"
INF = 1 << 40


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state [edit][class][state]; a class is 4 * initial (0 for others) + fault."""
    cost, to = np.full((len(EDITS), 16, 4), INF, np.int64), np.zeros((len(EDITS), 16, 4), np.int64)
    for initial, fault, state in itertools.product(range(4), range(4), range(4)):
        c = 4 * initial + fault
        cost[0, c, state], to[0, c, state] = COST_DELETE, state
        if fault in (BLANK, DUPLICATE):
            continue
        extra = COST_TRUNCATED * (fault == TRUNCATED)
        for e, edit in enumerate(EDITS[1:], 1):
            at = NEXT[state] if edit[0] == "I" else state
            own = extra + COST_INSERT * (edit[0] == "I")
            if edit[-1] == "R":
                cost[e, c, state], to[e, c, state] = own + COST_REROLE, NEXT[at]
            elif initial and (initial == NEXT[at] or (initial == SYSTEM and at == NONE)):
                cost[e, c, state], to[e, c, state] = own, initial
    return cost, to


COST, TO = _tables()
#: [class][state before][state after] of the cheapest edit.
MATRIX = np.full((16, 4, 4), INF, np.int64)
for _e, _c, _q in itertools.product(range(len(EDITS)), range(16), range(4)):
    MATRIX[_c, _q, TO[_e, _c, _q]] = min(MATRIX[_c, _q, TO[_e, _c, _q]], COST[_e, _c, _q])
END = COST_INSERT * TAIL


def values(classes: np.ndarray, ptr: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cost-to-go before each turn (turns x 4) of runs laid end to end, given that at the runs' ends."""
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    out, at_end = np.zeros((len(classes), 4), np.int64), np.array(end, np.int64)
    for k in range(int(size.max(initial=0))):
        on = order[: np.searchsorted(-size[order], -k, "left")]
        at = ptr[on + 1] - 1 - k
        c = classes[at]
        best = np.full((len(on), 4), INF, np.int64)
        for e in range(len(EDITS)):
            best = np.minimum(best, COST[e, c] + np.take_along_axis(at_end[on], TO[e, c], 1))
        out[at] = at_end[on] = np.minimum(best, INF)
    return out


def walk(classes: np.ndarray, ptr: np.ndarray, value: np.ndarray, end: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edit number and state before each turn, and the states at the runs' ends, from the states at their beginnings."""
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    edit, before, state = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64), np.array(begin, np.int64)
    for k in range(int(size.max(initial=0))):
        on = order[: np.searchsorted(-size[order], -k, "left")]
        at = ptr[on] + k
        q, c = state[on], classes[at]
        later = np.where((k + 1 < size[on])[:, None], value[np.minimum(at + 1, len(value) - 1)], end[on])
        tight = np.array([COST[e, c, q] + later[np.arange(len(on)), TO[e, c, q]] == value[at, q] for e in range(len(EDITS))])
        chosen = tight.argmax(0)
        edit[at], before[at], state[on] = chosen, q, TO[chosen, c, q]
    return edit, before, state


def block_matrix(classes: np.ndarray) -> np.ndarray:
    """(min, +) product of the turns' matrices, as a tree of pairs."""
    m = MATRIX[classes]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        left, right = m[: len(m) - len(m) % 2 : 2], m[1::2]
        m = np.concatenate([np.minimum((left[:, :, :, None] + right[:, None, :, :]).min(2), INF), odd])
    return m[0]


# Rows: conv, turn, role, text, here (false for rows that only name their conversation), initial (0 to 3), fault.

ORDER = ["conv", "turn", "role", "text"]


def prepared(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, here_col: str | None) -> DataFrame:
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit(" ")), F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    here = F.coalesce(F.col(here_col), F.lit(True)) if here_col else F.lit(True)
    made = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), here.alias("here"))
    made = made.withColumn("initial", F.instr(F.lit(INITIALS), F.substring("role", 1, 1)).cast("int"))
    made = made.withColumn("initial", F.when(F.col("role") == "", 0).otherwise(F.col("initial")))
    bare = F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    return made.withColumn("fault", fault.cast("int"))


def with_duplicates(table: pa.Table, ptr: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """Faults with the turns that repeat an earlier one of their conversation; all conversations are whole and here."""
    if not table.num_rows:
        return fault
    role, text = (table.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("role", "text"))
    conv = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((np.arange(len(conv)), text, role, conv))
    same = np.zeros(len(conv), bool)
    same[order[1:]] = (conv[order[1:]] == conv[order[:-1]]) & (role[order[1:]] == role[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    return np.where(same & (fault != BLANK), DUPLICATE, fault)


DECIDED = "turn bigint, role string, text string, here boolean, initial int, fault int, edit int, state int, tail int"


def decided(table: pa.Table, fault: np.ndarray, edit: np.ndarray, state: np.ndarray, tail: np.ndarray) -> pa.Table:
    columns = {c: table.column(c) for c in ("conv", "turn", "role", "text", "here", "initial")}
    columns |= {k: pa.array(v.astype(np.int32)) for k, v in (("fault", fault), ("edit", edit), ("state", state), ("tail", tail))}
    return pa.table(columns)


def whole(table: pa.Table) -> pa.Table:
    """Decides whole conversations."""
    gone = table.filter(pc.invert(table.column("here")))
    own = table.filter(table.column("here"))
    ptr = starts_of(own, ["conv"]) if own.num_rows else np.zeros(1, np.int64)
    fault = with_duplicates(own, ptr, own.column("fault").to_numpy().astype(np.int64))
    classes = 4 * own.column("initial").to_numpy().astype(np.int64) + fault
    end = np.tile(END, (len(ptr) - 1, 1))
    value = values(classes, ptr, end)
    edit, state, last = walk(classes, ptr, value, end, np.zeros(len(ptr) - 1, np.int64))
    tail = np.full(len(classes), -1)
    tail[ptr[1:] - 1] = last
    zeros = np.zeros(gone.num_rows, np.int64)
    both = pa.concat_tables([decided(own, fault, edit, state, tail), decided(gone, zeros, zeros, zeros, zeros - 1)])
    if gone.num_rows:  # back in order, so that a conversation stays in one run
        conv = table.column("conv").combine_chunks().dictionary_encode(null_encoding="encode").indices
        here = table.column("here")
        number = np.r_[conv.filter(here.combine_chunks()).to_numpy(zero_copy_only=False), conv.filter(pc.invert(here).combine_chunks()).to_numpy(zero_copy_only=False)]
        both = both.take(pa.array(np.argsort(number, kind="stable")))
    return both


def long_rows(rows: DataFrame, block_turns: int) -> DataFrame:
    """The rows of long conversations, decided, with at (their order)."""
    conv = f"conv {rows.schema['conv'].dataType.simpleString()}"
    kept = written(rows, "long").withColumn("salt", F.monotonically_increasing_id())  # parts equal rows; the scan is the same each time
    dealt = kept.repartitionByRange(*ORDER, "salt").sortWithinPartitions(*ORDER, "salt").withColumn("at", F.monotonically_increasing_id())
    placed = written(dealt.withColumn("range", F.shiftright("at", 33)), "ordered")
    spans = placed.groupBy("conv", "range").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo")).select(F.col("conv").alias("c"), F.col("range").alias("r"), "begin")
    # The first row of each role and text, of those that occur more than once.
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    marked = placed.withColumn("digest", digest)
    firsts = marked.groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("fc"), F.col("digest").alias("fd"), "first")
    marked = marked.join(firsts, F.expr("conv <=> fc AND digest = fd"), "left")
    fault = F.when((F.col("at") > F.col("first")) & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")).cast("int")
    marked = marked.join(spans, F.expr("conv <=> c AND `range` = r")).withColumn("block", F.expr(f"(at + begin) div {block_turns}")).withColumn("fault", fault)
    placed = written(marked.select("conv", "turn", "role", "text", "initial", "fault", "block", "at"), "blocks")
    narrow = placed.select("conv", "block", "at", (4 * F.col("initial") + F.col("fault")).cast("int").alias("class"))
    shape = f"{conv}, block bigint"

    def products(pdf):
        return pdf.iloc[:1][["conv", "block"]].assign(m=[block_matrix(pdf.sort_values("at")["class"].to_numpy()).ravel().tolist()])

    def ends(pdf):
        pdf, value, out = pdf.sort_values("block", ascending=False), END.copy(), []
        for m in pdf.m:
            out.append(value.tolist())
            value = np.minimum((np.array(m, np.int64).reshape(4, 4) + value[None, :]).min(1), INF)
        return pdf[["conv", "block"]].assign(end=out)

    matrices = narrow.groupBy("conv", "block").applyInPandas(products, f"{shape}, m array<bigint>")
    behind = written(matrices.groupBy("conv").applyInPandas(ends, f"{shape}, end array<bigint>"), "ends")
    other = behind.select(F.col("conv").alias("c"), F.col("block").alias("b"), "end")

    def leads(pdf):
        """Where the walk through a block leads from each state."""
        classes = pdf.sort_values("at")["class"].to_numpy().astype(np.int64)
        ptr, end = np.array([0, len(classes)]), np.array([list(pdf.end.iloc[0])], np.int64)
        value = values(classes, ptr, end)
        to = [int(walk(classes, ptr, value, end, np.array([q]))[2][0]) for q in range(4)]
        return pdf.iloc[:1][["conv", "block", "end"]].assign(to=[to])

    def begins(pdf):
        pdf, state, out = pdf.sort_values("block"), NONE, []
        for to in pdf["to"]:
            out.append(state)
            state = int(to[state])
        return pdf[["conv", "block", "end"]].assign(begin=out, final=[*[False] * (len(pdf) - 1), True])

    at_end = narrow.join(other, F.expr("conv <=> c AND block = b")).select("conv", "block", "at", "class", "end")
    ways = at_end.groupBy("conv", "block").applyInPandas(leads, f"{shape}, end array<bigint>, to array<int>")
    found = written(ways.groupBy("conv").applyInPandas(begins, f"{shape}, end array<bigint>, begin int, final boolean"), "begins")
    found = found.select(F.col("conv").alias("c"), F.col("block").alias("b"), "end", "begin", "final")
    blocks = placed.join(found, F.expr("conv <=> c AND block = b")).drop("c", "b").withColumn("here", F.lit(True))

    def part(table):
        ptr = starts_of(table, ["conv", "block"])
        fault = table.column("fault").to_numpy().astype(np.int64)
        classes = 4 * table.column("initial").to_numpy().astype(np.int64) + fault
        end = np.array(table.column("end").take(pa.array(ptr[:-1])).to_pylist(), np.int64)
        value = values(classes, ptr, end)
        edit, state, last = walk(classes, ptr, value, end, table.column("begin").to_numpy()[ptr[:-1]])
        tail = np.full(len(classes), -1)
        final = table.column("final").to_numpy(zero_copy_only=False)[ptr[1:] - 1]
        tail[ptr[1:] - 1] = np.where(final, last, -1)
        return decided(table, fault, edit, state, tail).append_column("at", table.column("at"))

    blocks = blocks.repartition("conv", "block").sortWithinPartitions("conv", "block", "at")
    return blocks.mapInArrow(lambda batches: runs_of(batches, ["conv", "block"], part), f"{conv}, {DECIDED}, at bigint")


#: Long conversations up to this number are told to all tasks; above it, rows are joined with them.
BROADCAST_ROWS = 100_000


def split(rows: DataFrame, block_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of short conversations, and those of long ones (None if there are none)."""
    long_ = written(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_turns).select(F.col("conv").alias("c")), "convs")
    many = long_.count()
    if not many:
        return rows, None
    told = F.broadcast(long_) if many <= BROADCAST_ROWS else long_
    return rows.join(told, F.expr("conv <=> c"), "left_anti"), rows.join(told, F.expr("conv <=> c"), "left_semi")


def short_sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions(*ORDER).select(*ORDER, "here", "initial", "fault")


ROLES = ("", "system", "user", "assistant")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", here_col: str | None = None, block_turns: int = 1024) -> DataFrame:
    """A row for each given turn: conv, turn, role, text, fault, edit (D, IK, IR, K, R), new_role (null if deleted),
    inserted (role of the empty turn before it, or null), appended (roles of empty turns after the last one)."""
    rows = prepared(turns, conv_col, turn_col, role_col, text_col, here_col)
    conv = f"conv {rows.schema['conv'].dataType.simpleString()}"
    short, long_ = split(rows, block_turns)
    out = short_sorted(short).mapInArrow(lambda batches: runs_of(batches, ["conv"], whole), f"{conv}, {DECIDED}")
    if long_ is not None:
        out = out.unionByName(long_rows(long_.filter("here"), block_turns).drop("at"))
    edit, roles = F.element_at(F.array(*map(F.lit, EDITS)), F.col("edit") + 1), F.array(*map(F.lit, ROLES))
    after = F.array(*[F.lit(n) for n in NEXT])
    inserts = F.col("edit").isin(1, 2)
    at = F.when(inserts, F.element_at(after, F.col("state") + 1)).otherwise(F.col("state"))
    new = F.when(F.col("edit").isin(2, 4), F.element_at(roles, F.element_at(after, at + 1) + 1)).when(F.col("edit") != 0, F.col("role"))
    added = F.when(F.col("tail") == SYSTEM, F.array(F.lit("user"), F.lit("assistant"))).when(F.col("tail") == USER, F.array(F.lit("assistant")))
    return out.filter("here").select(
        F.col("conv").alias(conv_col), "turn", "role", "text", F.element_at(F.array(*map(F.lit, FAULTS)), F.col("fault") + 1).alias("fault"), edit.alias("edit"), new.alias("new_role"),
        F.when(inserts, F.element_at(roles, at + 1)).alias("inserted"), added.alias("appended"),
    )


class Summary:
    """One conversation's result, from its decided rows in order."""

    NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

    def __init__(self) -> None:
        self.turns, self.low, self.high, self.last_turn = 0, None, None, None
        self.faults, self.illegal, self.cost, self.audit = [0, 0, 0, 0], 0, 0, []
        self.initial, self.digest, self.empty = None, hashlib.sha256(), True

    def tell(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def add(self, turn, role, text, here, initial, fault, edit, state, tail) -> None:
        if not here:
            return
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn
        self.faults[fault] += 1
        if self.initial is not None and (self.initial, initial) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            self.illegal += 1
        self.initial = initial
        self.cost += int(COST[edit, 4 * initial + fault, state])
        name = EDITS[edit]
        self.audit.append(name)
        if name[0] == "I":
            self.tell(ROLES[NEXT[state]], "")
            state = NEXT[state]
        if name[-1] == "R":
            self.tell(ROLES[NEXT[state]], text)
        elif name != "D":
            self.tell(role, text)
        if tail > 0:
            self.cost += int(END[tail])
            for _ in range(int(TAIL[tail])):
                self.audit.append("I")
                self.tell(ROLES[NEXT[tail]], "")
                tail = NEXT[tail]

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


SUMMED = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
COLUMNS = [c.split()[0] for c in DECIDED.split(", ")]


def summed(batches):
    """One row a conversation, from batches whose rows are sorted by conversation and order."""
    held, conv = None, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        ptr = starts_of(table, ["conv"])
        rows = list(zip(*(table.column(c).to_pylist() for c in COLUMNS), strict=True))
        names, done = table.column("conv").take(pa.array(ptr[:-1])).combine_chunks(), []
        for k in range(len(ptr) - 1):
            if held is None or k or not names[k : k + 1].equals(conv):
                if held is not None:
                    done.append((conv, held.result()))
                held, conv = Summary(), names[k : k + 1]
            for row in rows[ptr[k] : ptr[k + 1]]:
                held.add(*row)
        if done:
            yield told(done)
    if held is not None:
        yield told([(conv, held.result())])


def told(done: list) -> pa.RecordBatch:
    columns = [pa.array(list(c), pa.string() if i > 5 else pa.int64()) for i, c in enumerate(zip(*(r for _, r in done), strict=True))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([c for c, _ in done]), *columns], names=["conv", *Summary.NAMES])


def audits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", here_col: str | None = None, block_turns: int = 1024) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = prepared(turns, conv_col, turn_col, role_col, text_col, here_col)
    conv = f"conv {rows.schema['conv'].dataType.simpleString()}"
    short, long_ = split(rows, block_turns)
    out = short_sorted(short).mapInArrow(lambda batches: summed(runs_of(batches, ["conv"], whole)), f"{conv}, {SUMMED}")
    if long_ is not None:
        # Rows that only name a long conversation go along, in case it has no other.
        names = long_.filter("NOT here").select("conv").distinct()
        marks = names.select("conv", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in DECIDED.split(", ") if c.split()[0] != "here"], F.lit(False).alias("here"), F.lit(-1).cast("long").alias("at"))
        streams = long_rows(long_.filter("here"), block_turns).unionByName(marks).repartition("conv").sortWithinPartitions("conv", "at").drop("at")
        out = out.unionByName(streams.mapInArrow(summed, f"{conv}, {SUMMED}"))
    return out.withColumnRenamed("conv", conv_col)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, here: the rows as the query damages them, by crc32 of the ids."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).alias("how")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), how)
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") != 0).alias("here"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return audits(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), here_col="here")


def _oracle() -> str:
    """DuckDB SQL with the query's rows: a recursion over the turns that keeps the best (cost, audit, repaired text) of each state."""

    def step(state: int) -> str:
        extra = f"CASE WHEN fault = {TRUNCATED} THEN {COST_TRUNCATED} ELSE 0 END"
        grow = lambda q, cost, edit, text: f"{{'c': s{q}.c + {cost}, 'a': s{q}.a || '{edit}', 't': s{q}.t || {text}}}"
        ways = [grow(state, COST_DELETE, "D", "''")]
        live = f"fault IN ({BLANK}, {DUPLICATE})"
        if state == SYSTEM:
            ways.append(f"CASE WHEN {live} OR initial <> 1 THEN NULL ELSE {grow(NONE, f'({extra})', 'K', 'line')} END")
        for q in range(4) if state in (USER, ASSISTANT) else ():
            inserted = NEXT[q] != state
            mark, cost = ("I", COST_INSERT) if inserted else ("", 0)
            before = f"'{chr(10)}{ROLES[NEXT[q]]}:'" if inserted else "''"
            ways.append(f"CASE WHEN {live} OR initial <> {state} THEN NULL ELSE {grow(q, f'({extra}) + {cost}', mark + 'K', f'{before} || line')} END")
            ways.append(f"CASE WHEN {live} THEN NULL ELSE {grow(q, f'({extra}) + {cost + COST_REROLE}', mark + 'R', f'''{before} || '{chr(10)}{ROLES[state]}:' || text''')} END")
        return f"list_min([{', '.join(ways)}]) AS s{state}"

    start = ", ".join(f"{{'c': {0 if q == NONE else INF}::BIGINT, 'a': '', 't': ''}} AS s{q}" for q in range(4))
    ends = []
    for q in (NONE, SYSTEM, USER, ASSISTANT):
        role, text = q, ""
        for _ in range(int(TAIL[q])):
            role = NEXT[role]
            text += f"{chr(10)}{ROLES[role]}:"
        ends.append(f"{{'c': s{q}.c + {int(END[q])}, 'a': s{q}.a || '{'I' * int(TAIL[q])}', 't': s{q}.t || '{text}'}}")
    return f"""
WITH RECURSIVE named AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), hashed AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: unicode(substr(k, i::INTEGER, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, bit: xor(x >> 1, (x & 1) * 3988292384::BIGINT)))) % 20 AS how
  FROM named
), changed AS (
  SELECT g, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, how
  FROM hashed WHERE how <> 0
), doubled AS (
  SELECT g, turn, role, text FROM changed UNION ALL SELECT g, turn, role, text FROM changed WHERE how = 3
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM doubled
), judged AS (
  SELECT *, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS initial,
    CASE WHEN regexp_full_match(text, '[\\x20\\x09-\\x0D]*') THEN {BLANK}
      WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN {DUPLICATE}
      WHEN regexp_matches(text, '[^\\x20\\x09-\\x0D.!?][\\x20\\x09-\\x0D]*$') THEN {TRUNCATED} ELSE 0 END AS fault,
    '{chr(10)}' || role || ':' || text AS line
  FROM ordered
), counted AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = {BLANK}) AS blank,
    count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {TRUNCATED}) AS truncated, count(*) FILTER (bad) AS illegal, count(*) AS n
  FROM (SELECT *, i > 1 AND (lag(initial) OVER (PARTITION BY g ORDER BY i), initial) NOT IN ((1, 2), (2, 3), (3, 2)) AS bad FROM judged) GROUP BY g
), walked AS (
  SELECT g, 0::BIGINT AS i, {start} FROM counted
  UNION ALL
  SELECT w.g, w.i + 1, {', '.join(step(q) for q in range(4))}
  FROM walked w JOIN judged j ON j.g = w.g AND j.i = w.i + 1
), ended AS (
  SELECT w.g, list_min([{', '.join(ends)}]) AS best FROM walked w JOIN counted c ON c.g = w.g AND c.n = w.i
)
SELECT d.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(e.best.c, 0) AS cost, coalesce(e.best.a, '') AS audit, sha256(coalesce(substr(e.best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM named) d LEFT JOIN counted c ON c.g = d.g LEFT JOIN ended e ON e.g = d.g
"""


ORACLE_SQL = _oracle()
