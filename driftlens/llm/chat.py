"""Chat formatting (operator 8): minimum-cost role repair over a legal-turn automaton.

Legal sequences: an optional system turn first, then user and assistant turns
in alternation, an assistant turn last. Each given turn is kept or relabelled
and either starts a turn (with empty turns inserted before it where the
automaton needs them) or merges into the turn before. Dynamic programming
over the automaton's states finds the cheapest repair; equal costs are decided
by the order of ``ACTIONS`` and then of ``ROLES``, from the last turn backwards.

A turn is a 4 x 4 matrix in the (min, +) semiring, so a conversation is a
matrix product and can be cut. One of more than ``block_turns`` rows is dealt
by ranges of its order, its rows are numbered by prefix counts, and blocks of
``block_turns`` numbers become one matrix each. The products of the blocks
before give a block the costs with which it begins; from them each block finds,
for each state in which it may end, the state from which it comes by the one
tie rule, and these steps back are followed over the blocks from the last one.
So results don't depend on ``block_turns``, and no task holds a long
conversation; one row a block is the most that meets.

The result has one row per given turn: its new role, action, cost and the
rendered piece; pieces joined in turn order are the rendered conversation.

Defined results: roles are compared lower-cased and trimmed, and a null or
unknown role is relabelled at the usual cost; a null text is empty; a very long
text is rendered whole; turns are ordered by number (nulls last), then role
(nulls first), then text digest; repeated rows are turns of their own and
interchangeable; null conv_ids are one conversation; extra columns of any name
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

# States and costs.
ROLES = ("start", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
UNKNOWN = 0
COST_MERGE, COST_INSERT, COST_RELABEL = 1, 2, 3
ACTIONS = ("keep", "merge", "insert", "relabel", "relabel_merge", "relabel_insert")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
INF = 1 << 40


def between(s: int, q: int) -> list[int] | None:
    """Fewest empty turns that lead from state s to a turn of role q."""
    frontier = [(s, [])]
    for _ in range(len(ROLES)):
        for at, path in frontier:
            if q in NEXT[at]:
                return path
        frontier = [(n, [*path, n]) for at, path in frontier for n in NEXT[at]]
    return None


def steps() -> list[list[list[tuple[int, int, list[int]]]]]:
    """[given role][state before][role after] -> (cost, action number, inserted roles)."""
    out = []
    for given in range(4):
        table = []
        for s in range(4):
            row = []
            for q in range(4):
                ways = [(INF, len(ACTIONS), [])]
                other = 0 if q == given else COST_RELABEL
                if q != START:
                    path = between(s, q)
                    if path is not None:
                        kind = ("keep", "insert") if not other else ("relabel", "relabel_insert")
                        ways.append((other + COST_INSERT * len(path), ACTIONS.index(kind[bool(path)]), path))
                    if q == s:
                        ways.append((other + COST_MERGE, ACTIONS.index("relabel_merge" if other else "merge"), []))
                row.append(min(ways, key=lambda w: w[:2]))
            table.append(row)
        out.append(table)
    return out


STEPS = steps()
COSTS = np.array([[[w[0] for w in row] for row in table] for table in STEPS], np.int64)
#: Empty turns that end a conversation legally from each state.
ENDS = [[USER, ASSISTANT], [USER, ASSISTANT], [ASSISTANT], []]
END_COST = np.array([COST_INSERT * len(x) for x in ENDS], np.int64)


#: Actions, and the inserted roles, as arrays [given role][state before][role after].
WAYS = np.array([[[w[1] for w in row] for row in table] for table in STEPS], np.int64)
INSERTED = np.array([[[len(w[2]) for w in row] for row in table] for table in STEPS], np.int64)
#: Cost, action and state before in one number, so that its minimum follows the tie rule.
KEYED = (COSTS * 8 + WAYS) * 4 + np.arange(4)[None, :, None]


def block_matrix(roles: np.ndarray) -> np.ndarray:
    """(min, +) product of the turns' matrices, as a tree of pairs."""
    m = COSTS[roles]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        left, right = m[: len(m) - len(m) % 2 : 2], m[1::2]
        m = np.concatenate([np.minimum((left[:, :, :, None] + right[:, None, :, :]).min(2), INF), odd])
    return m[0]


def forward(roles: np.ndarray, ptr: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For conversations laid end to end, begun with the costs ``begin`` of the states: the state before each turn for
    each state after it (turns x 4), and the costs at the ends. All conversations advance together, a turn a step."""
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    back, cost = np.zeros((len(roles), 4), np.int8), begin.astype(np.int64).copy()
    for k in range(int(size.max(initial=0))):
        on = order[: np.searchsorted(-size[order], -k, "left")]
        at = ptr[on] + k
        # INF is large enough to stay one after an addition; the low digits hold action and state.
        ways = KEYED[roles[at]] + cost[on][:, :, None] * 32
        best = ways.min(1)
        best[:, START] = INF * 32
        back[at] = best % 4
        cost[on] = np.minimum(best // 32, INF)
    return back, cost


def backward(back: np.ndarray, ptr: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before and after each turn, for the states in which the conversations end."""
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    before, after, q = np.zeros(len(back), np.int64), np.zeros(len(back), np.int64), leave.astype(np.int64).copy()
    for k in range(int(size.max(initial=0))):
        on = order[: np.searchsorted(-size[order], -k, "left")]
        at = ptr[on + 1] - 1 - k
        after[at] = q[on]
        q[on] = before[at] = back[at, q[on]]
    return before, after


def last_state(cost: np.ndarray) -> np.ndarray:
    """The cheapest state to end in, the first on a tie."""
    return np.minimum(cost + END_COST, INF).argmin(-1)


def code(role: F.Column) -> F.Column:
    name = F.lower(F.trim(role))
    out = F.lit(UNKNOWN)
    for i, r in enumerate(ROLES[1:], 1):
        out = F.when(name == r, i).otherwise(out)
    return out.cast("int")


def markup(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSE = "<|end|>\n"


def lead(given: int, s: int, q: int) -> str:
    """What stands before a turn's text."""
    _, action, path = STEPS[given][s][q]
    if action == len(ACTIONS):
        return ""
    return "\n" if "merge" in ACTIONS[action] else CLOSE * (s != START) + "".join(markup(p) + CLOSE for p in path) + markup(q)


LEADS = pa.array([lead(g, s, q) for g in range(4) for s in range(4) for q in range(4)])
TAILS = pa.array([CLOSE + "".join(markup(p) + CLOSE for p in path) for path in ENDS] + [""])
START_COST = np.array([0, INF, INF, INF], np.int64)


def starts_of(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where runs of equal values in these columns begin, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        c = table.column(name).combine_chunks()
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.r_[np.flatnonzero(new), table.num_rows]


def runs_of(batches, names: list[str], made):
    """Calls made(table) on tables that hold whole runs of equal values in the named columns."""
    held: list[pa.RecordBatch] = []  # rows of the last run, which the next batch may continue
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(starts_of(pa.Table.from_batches([batch]), names)[-2])
        if cut == 0 and held:
            pair = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            if len(starts_of(pair, names)) == 2:
                held.append(batch)
                continue
        table = pa.Table.from_batches([*held, batch.slice(0, cut)])
        if table.num_rows:
            yield from made(table).to_batches()
        held = [batch.slice(cut)]
    if held:
        yield from made(pa.Table.from_batches(held)).to_batches()


def spelled(table: pa.Table, before: np.ndarray, after: np.ndarray, last: np.ndarray) -> pa.Table:
    """The result's rows; ``last`` marks turns that end a conversation."""
    given = table.column("code").to_numpy()
    prefix = LEADS.take(pa.array((given * 4 + before) * 4 + after))
    suffix = TAILS.take(pa.array(np.where(last, after, len(TAILS) - 1)))
    text = pc.binary_join_element_wise(prefix, table.column("text").combine_chunks(), suffix, "")
    cost = COSTS[given, before, after] + np.where(last, END_COST[after], 0)
    action = pa.array([*ACTIONS, None], pa.string()).take(pa.array(WAYS[given, before, after]))
    columns = {
        "conv": table.column("conv"), "turn": table.column("turn"), "role": table.column("role"), "new_role": pa.array(ROLES).take(pa.array(after)), "action": action,
        "inserted": pa.array(INSERTED[given, before, after].astype(np.int32)), "cost": pa.array(cost), "rendered": text,
    }
    return pa.table(columns)


ORDER = ["conv", "none", "turn", "role", "digest"]


def long_blocks(rows: DataFrame, block_turns: int) -> DataFrame:
    """The rows of long conversations with block, and of each block start (costs of the states) and leave (last state)."""
    conv = f"conv {rows.schema['conv'].dataType.simpleString()}"
    kept = written(rows, "long").withColumn("salt", F.monotonically_increasing_id())  # parts equal rows; the scan is the same each time
    dealt = kept.repartitionByRange(*ORDER, "salt").sortWithinPartitions(*ORDER, "salt").withColumn("at", F.monotonically_increasing_id())
    placed = written(dealt.withColumn("range", F.shiftright("at", 33)), "ordered")
    spans = placed.groupBy("conv", "range").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo")).select(F.col("conv").alias("c"), F.col("range").alias("r"), "begin")
    placed = placed.join(spans, F.expr("conv <=> c AND `range` = r")).withColumn("block", F.expr(f"(at + begin) div {block_turns}"))
    placed = written(placed.select("conv", "turn", "role", "code", "text", "block", "at"), "blocks")
    narrow = placed.select("conv", "block", "at", "code")

    def products(pdf):
        return pdf.iloc[:1][["conv", "block"]].assign(m=[block_matrix(pdf.sort_values("at").code.to_numpy()).ravel().tolist()])

    def begins(pdf):
        pdf, cost, out = pdf.sort_values("block"), START_COST, []
        for m in pdf.m:
            out.append(cost.tolist())
            cost = np.minimum((cost[:, None] + np.array(m, np.int64).reshape(4, 4)).min(0), INF)
        return pdf[["conv", "block"]].assign(start=out, end=int(last_state(cost)))

    matrices = narrow.groupBy("conv", "block").applyInPandas(products, f"{conv}, block bigint, m array<bigint>")
    starts = written(matrices.groupBy("conv").applyInPandas(begins, f"{conv}, block bigint, start array<bigint>, end int"), "starts")
    other = starts.select(F.col("conv").alias("c"), F.col("block").alias("b"), "start", "end")

    def steps_back(pdf):
        pdf = pdf.sort_values("at")
        roles, ptr = pdf.code.to_numpy(), np.array([0, len(pdf)])
        back, _ = forward(roles, ptr, np.array([list(pdf.start.iloc[0])]))
        q = np.arange(4)
        for row in back[::-1]:
            q = row[q]
        return pdf.iloc[:1][["conv", "block", "start", "end"]].assign(entry=[q.tolist()])

    def leaves(pdf):
        pdf, out = pdf.sort_values("block"), []
        q = int(pdf.end.iloc[0])
        for entry in reversed(pdf.entry.tolist()):
            out.append(q)
            q = int(entry[q])
        return pdf[["conv", "block", "start"]].assign(leave=out[::-1], final=[*[False] * (len(pdf) - 1), True])

    with_start = narrow.join(other, F.expr("conv <=> c AND block = b")).select("conv", "block", "at", "code", "start", "end")
    back = with_start.groupBy("conv", "block").applyInPandas(steps_back, f"{conv}, block bigint, start array<bigint>, end int, entry array<int>")
    found = written(back.groupBy("conv").applyInPandas(leaves, f"{conv}, block bigint, start array<bigint>, leave int, final boolean"), "leaves")
    found = found.select(F.col("conv").alias("c"), F.col("block").alias("b"), "start", "leave", "final")
    return placed.join(found, F.expr("conv <=> c AND block = b")).drop("c", "b")


#: Long conversations up to this number are told to all tasks; above it, rows are joined with them.
BROADCAST_ROWS = 100_000
RESULT = "turn bigint, role string, new_role string, action string, inserted int, cost bigint, rendered string"


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_turns: int = 1024) -> DataFrame:
    """Per given turn: conv, turn, role, new_role, action, inserted (before it), cost (with the end's), rendered."""
    role = F.col(role_col).cast("string")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), code(role).alias("code"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text")).withColumn("none", F.col("turn").isNull())
    result = f"conv {rows.schema['conv'].dataType.simpleString()}, {RESULT}"
    long_ = written(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_turns).select(F.col("conv").alias("c")), "convs")
    many = long_.count()
    told = F.broadcast(long_) if many <= BROADCAST_ROWS else long_
    short = rows.join(told, F.expr("conv <=> c"), "left_anti") if many else rows

    def whole(table):
        ptr = starts_of(table, ["conv"])
        back, cost = forward(table.column("code").to_numpy(), ptr, np.tile(START_COST, (len(ptr) - 1, 1)))
        last = np.zeros(table.num_rows, bool)
        last[ptr[1:] - 1] = True
        return spelled(table, *backward(back, ptr, last_state(cost)), last)

    sorted_rows = short.repartition("conv").sortWithinPartitions(*ORDER).select("conv", "turn", "role", "code", "text")
    out = sorted_rows.mapInArrow(lambda batches: runs_of(batches, ["conv"], whole), result)
    if not many:
        return out

    def part(table):
        ptr = starts_of(table, ["conv", "block"])
        begin = np.array(table.column("start").take(pa.array(ptr[:-1])).to_pylist(), np.int64)
        back, _ = forward(table.column("code").to_numpy(), ptr, begin)
        leave = table.column("leave").to_numpy()[ptr[:-1]]
        last = np.zeros(table.num_rows, bool)
        last[ptr[1:] - 1] = table.column("final").to_numpy(zero_copy_only=False)[ptr[1:] - 1]
        return spelled(table, *backward(back, ptr, leave), last)

    blocks = long_blocks(rows.join(told, F.expr("conv <=> c"), "left_semi"), block_turns)
    blocks = blocks.repartition("conv", "block").sortWithinPartitions("conv", "block", "at").drop("at")
    return out.unionByName(blocks.mapInArrow(lambda batches: runs_of(batches, ["conv", "block"], part), result))


def render(turns: DataFrame, conv_col: str = "conv_id", **options) -> DataFrame:
    """One row per conversation: its cost and rendered text. For conversations that fit one row each."""
    fixed = repair(turns, conv_col, **options)
    both = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("none"), "turn", "role", "rendered")))
    return fixed.groupBy("conv").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("turns"), both.alias("x")).select(F.col("conv").alias(conv_col), "cost", "turns", F.array_join("x.rendered", "").alias("rendered"))


def op8_chat_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(turns).withColumnRenamed("conv", "conv_id")
