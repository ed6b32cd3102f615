"""Repair of conversations' structure by the cheapest edits.

A conversation is sound if the initials of its roles are nothing or ``s?(ua)+``. Edits of a
conversation are paths through a graph of (row, state) nodes; costs from the start and to the
end tell which arcs lie on a cheapest path, the tight ones, and the walk from the start takes the
tight arc of the least letter at each step. Its frontier is all nodes that the letters so far
lead to: of one letter no node has two arcs, so it stays one node.

Conversations aren't gathered. Rows are dealt out by ranges of (conversation, turn, role, text) and
tasks walk over them in order. A conversation that begins and ends inside a range is done there.
One that touches a range's ends, or is longer than a block, is cut in blocks, each with its least
costs from any state to any other; these few numbers, brought together by conversation, give the
costs before and behind each block, with which all blocks are walked at once, from each
state that a cheapest path may enter by. What they lead to chooses the entries in the end.

Rows that are equal in all are one row with a number of times, so copies don't meet in a task either.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessella.llm import common

KEEP, ROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1  # costs; CUT: of a truncated row that stays
FAULTS = ("", "blank", "duplicate", "truncated")
SPACE = r"\x20\x09-\x0D"
#: Rows and characters of a block at most, about.
ROWS, CHARS = 4096, 4 << 20
NEVER = 1 << 60
#: States: nothing yet, after a system row, after a user's, after an assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
SAID, NEXT = ("user", "user", "assistant", "user"), (USER, USER, ASSISTANT, USER)
#: Costs behind the last row: of what must be inserted yet.
CLOSE = [0, 2 * INSERT, INSERT, 0]


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with the faults of the registered query planted, by the checksum of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes its role user. Null
    roles, texts and parts of the checksum's string count as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), h.alias("h")).where("h <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def marked(rows: DataFrame, folder: str) -> DataFrame:
    """Distinct rows with how many ``times`` each comes and the first one's ``fault`` (place in FAULTS).

    A row is a duplicate if its role and text come in an earlier turn of the conversation.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    rows = common.kept(rows.withColumns({"conv": F.struct("conv_id"), "digest": F.sha2("text", 256)}), folder, "distinct")
    when = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    again = rows.groupBy("conv", "role", "digest").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = common.saved(again)
    hot = common.hot_keys(again, ["conv", "role", "digest"])
    rows = common.even_join(rows, again.drop("n"), ["conv", "role", "digest"], hot, "left").drop("digest", "conv")
    bare = F.regexp_replace("text", f"[{SPACE}]+$", "")
    fault = F.when(bare == "", 1).when(when > F.col("first"), 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", "times", fault.alias("fault"))


def steps(role: str, fault: int, state: int) -> list[tuple[str, int, int, str]]:
    """What may become of a row in a state: (letter, cost, next state, role), letters in order."""
    out = [("D", DELETE, state, "")]
    if fault not in (1, 2):
        more = CUT if fault == 3 else 0
        after = {"u": USER if state != USER else None, "a": ASSISTANT if state == USER else None, "s": SYSTEM if state == NONE else None}.get(role[:1])
        if after is not None:
            out.append(("K", KEEP + more, after, role))
        out.append(("R", ROLE + more, NEXT[state], SAID[state]))
    return out


def inserted_before(b: list[int]) -> list[int]:
    """Costs to the end where rows may be inserted first; two at most ever pay."""
    user, assistant = min(b[USER], INSERT + b[ASSISTANT]), min(b[ASSISTANT], INSERT + b[USER])
    return [min(b[NONE], INSERT + user), min(b[SYSTEM], INSERT + user), user, assistant]


def backward(rows: list, after: list[int]) -> list[list[int]]:
    """For each row, and behind the last, the least costs to the end from each state; ``after``: those behind the last."""
    out = [after]
    for _, role, _, times, fault in reversed(rows):
        b = out[-1]
        out.append(inserted_before([(times - 1) * DELETE + min(c + b[t] for _, c, t, _ in steps(role, fault, s)) for s in range(4)]))
    return out[::-1]


def forward(rows: list, start: list[int]) -> list[list[int]]:
    """For each row, and behind the last, the least costs from the start to each state, those of inserted rows before the row included."""
    out, f = [], start
    for _, role, _, times, fault in rows:
        user = min(f[USER], INSERT + min(f[NONE], f[SYSTEM], f[ASSISTANT]))
        f = [f[NONE], f[SYSTEM], user, min(f[ASSISTANT], INSERT + user)]
        out.append(f)
        g = [NEVER] * 4
        for s in range(4):
            for _, c, t, _ in steps(role, fault, s):
                g[t] = min(g[t], f[s] + c + (times - 1) * DELETE)
        f = g
    return [*out, f]


def walk(rows: list, before: list[list[int]], behind: list[list[int]], total: int, state: int, last: bool) -> tuple[int, list]:
    """From a state before the first row along tight arcs, least letters first: (state behind the last, edits as (letter, times, role, text))."""
    out, at = [], 0
    while True:
        arcs = []
        if at < len(rows):
            _, role, text, times, fault = rows[at]
            arcs = [(letter, (c, t, r)) for letter, c, t, r in steps(role, fault, state) if before[at][state] + c + (times - 1) * DELETE + behind[at + 1][t] == total]
        elif not last:
            return state, out
        if before[at][state] + INSERT + behind[at][NEXT[state]] == total:
            arcs.append(("I", (INSERT, NEXT[state], SAID[state])))
        if at == len(rows) and behind[at][state] == 0 and state in (NONE, ASSISTANT):
            return state, out
        letter, (_, state_, role_) = min(arcs)
        if letter == "I":
            out.append(("I", 1, role_, ""))
        else:
            out.append((letter, 1, role_, text) if letter != "D" else ("D", 1, "", ""))
            if times > 1:
                out.append(("D", times - 1, "", ""))
            at += 1
        state = state_


def whole(rows: list) -> tuple[int, list]:
    """The least cost and the edits of a whole conversation."""
    behind, before = backward(rows, CLOSE), forward(rows, [0, NEVER, NEVER, NEVER])
    before[-1] = closed(before[-1])
    return behind[0][NONE], walk(rows, before, behind, behind[0][NONE], NONE, True)[1]


def closed(f: list[int]) -> list[int]:
    """Costs from the start behind the last row, inserted rows included."""
    user = min(f[USER], INSERT + min(f[NONE], f[SYSTEM], f[ASSISTANT]))
    return [f[NONE], f[SYSTEM], user, min(f[ASSISTANT], INSERT + user)]


def told(rows: list) -> tuple:
    """What a block's rows show: first and last turn, least, most and number of distinct turns, first and last initial, faults, illegal neighbours."""
    turns = [r[0] for r in rows]
    some = [t for t in turns if t is not None]
    initials = [r[1][:1] for r in rows]
    # copies of a row stand beside it
    pairs = [(x + y, 1) for x, y in zip(initials, initials[1:], strict=False)] + [(x + x, r[3] - 1) for x, r in zip(initials, rows, strict=True)]
    faults = [0] * 4
    for r in rows:
        faults[r[4]] += 1
        faults[1 if r[4] == 1 else 2] += r[3] - 1
    return turns[0], turns[-1], min(some, default=None), max(some, default=None), len(set(some)), initials[0], initials[-1], *faults[1:], sum(n for p, n in pairs if p not in ("su", "ua", "au"))


EDITS = "array<struct<edit: string, times: long, role: string, text: string>>"
ROW = "array<struct<turn: long, role: string, text: string, times: long, fault: int>>"
TOLD = "turn_first long, turn_last long, least long, most long, n_turns long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long"
TOLD_NAMES = [c.split()[0] for c in TOLD.split(", ")]


def batch_of(rows: list[tuple], schema):
    """Tuples as a batch of an Arrow schema; structs in lists may be tuples too."""
    import pyarrow as pa

    def column(values: list, kind):
        if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
            names = [f.name for f in kind.value_type]
            values = [None if v is None else [x if isinstance(x, dict) else dict(zip(names, x, strict=True)) for x in v] for v in values]
        return pa.array(values, kind)

    return pa.record_batch([column([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def blocks(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """A row for each block of ``marked`` rows: conv_id, block (in order), what it shows (TOLD), and for a whole conversation cost and edits, else its rows and least costs."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    made = f"conv_id {kind}, block long, {TOLD}, cost long, edits {EDITS}, costs array<long>, rows {ROW}"
    schema = to_arrow_schema(StructType.fromDDL(made))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = rows.select("conv_id", F.col("turn").cast("long"), "role", "text", "times", "fault").repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator) -> Iterator:
        conv, own, chars, seen, alone, ready = None, [], 0, False, False, []
        block = TaskContext.get().partitionId() << 33

        def done(ends: bool) -> None:
            """The rows so far become a block; ``ends``: with the end of a conversation that goes no further than this range."""
            nonlocal block, own, chars
            if own and alone and ends:
                ready.append((conv, block, *told(own), *whole(own), None, None))
            elif own:
                costs = [c for s in range(4) for c in forward(own, [0 if x == s else NEVER for x in range(4)])[-1]]
                ready.append((conv, block, *told(own), None, None, costs, own))
            block, own, chars = block + 1, [], 0

        for batch in batches:
            for c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not seen or c != conv:
                    done(True)
                    conv, alone, seen = c, seen, True  # the range's first conversation may have begun before it
                elif len(own) >= most or chars > CHARS:
                    alone = False
                    done(False)
                own.append(tuple(row))
                chars += len(row[2])
                if len(ready) >= 256:
                    yield batch_of(ready, schema)
                    ready.clear()
        done(False)
        yield batch_of(ready, schema)

    return rows.mapInArrow(cut, made)


def ends(parts: DataFrame) -> DataFrame:
    """Of blocks with their least costs: block, the costs ``before`` and ``behind`` it by state, the conversation's ``total`` and whether it is the ``last``."""

    def passed(group):
        import pandas as pd

        group = group.sort_values("block")
        costs = [[list(c[4 * s : 4 * s + 4]) for s in range(4)] for c in group["costs"]]
        before, behind = [[0, NEVER, NEVER, NEVER]], [list(CLOSE)]
        for c in costs[:-1]:
            before.append([min(before[-1][s] + c[s][t] for s in range(4)) for t in range(4)])
        for c in costs[::-1]:
            behind.append([min(c[s][t] + behind[-1][t] for t in range(4)) for s in range(4)])
        n = len(costs)
        return pd.DataFrame({"block": group["block"], "before": before, "behind": behind[:n][::-1], "total": [behind[-1][NONE]] * n, "last": [i == n - 1 for i in range(n)]})

    return parts.groupBy("conv_id").applyInPandas(passed, "block long, before array<long>, behind array<long>, total long, last boolean")


def walked(parts: DataFrame) -> DataFrame:
    """Of blocks with rows and ``ends``: for each state that a cheapest path may enter by, where it leaves and the edits."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    made = f"conv_id {kind}, block long, state int, leaves int, edits {EDITS}"
    schema = to_arrow_schema(StructType.fromDDL(made))

    def take(batches: Iterator) -> Iterator:
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(x["turn"], x["role"], x["text"], x["times"], x["fault"]) for x in r["rows"]]
                behind, before = backward(rows, r["behind"]), forward(rows, r["before"])
                if r["last"]:
                    before[-1] = closed(before[-1])
                enter = [s for s in range(4) if r["before"][s] + behind[0][s] == r["total"]]
                yield batch_of([(r["conv_id"], r["block"], s, *walk(rows, before, behind, r["total"], s, r["last"])) for s in enter], schema)

    return parts.select("conv_id", "block", "rows", "before", "behind", "total", "last").mapInArrow(take, made)


def entered(ways: DataFrame) -> DataFrame:
    """(block, state): by which state each block is entered, from the first block's on."""

    def chain(group):
        import pandas as pd

        to = {(b, s): e for b, s, e in zip(group["block"], group["state"], group["leaves"], strict=True)}
        state, out = NONE, []
        for b in sorted(set(group["block"])):
            out.append((b, state))
            state = to[b, state]
        return pd.DataFrame(out, columns=["block", "state"])

    return ways.select("conv_id", "block", "state", "leaves").groupBy("conv_id").applyInPandas(chain, "block long, state int")


def repair(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """Blocks of repaired conversations: conv_id, block, what it shows of the rows as they came (TOLD), cost and edits.

    ``rows``: conv_id, turn, role, text; others aren't read. Null roles and texts count as one space; a null
    conversation is one like others; null turns come first, rows of a turn by role and text. A
    conversation's edits are those of its blocks in order: letter, how often, and the message that
    stays (none for D). Its cost is the sum of its blocks'. Roles but for system, user and
    assistant go by their first letter; an empty role fits nowhere, so it is changed or deleted.
    An empty table gives no rows. ``most``: rows of a block.
    """
    from tessella.llm import files

    spark = common.ship(rows.sparkSession)
    folder = common.scratch(spark, "repair")
    try:
        rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
        made = common.kept(blocks(marked(rows, folder), most), folder, "blocks")
        own = ["conv_id", "block", *TOLD_NAMES]
        parts = made.where("costs is not null")
        known = common.saved(ends(parts.select("conv_id", "block", "costs")))
        ways = common.kept(walked(parts.join(known, "block")), folder, "ways")
        chosen = ways.join(entered(ways), ["block", "state"]).select("block", "edits")
        parts = parts.select(*own).join(known.select("block", F.when(F.col("last"), F.col("total")).otherwise(0).alias("cost")), "block").join(chosen, "block")
        return common.saved(made.where("costs is null").select(*own, "cost", "edits").unionByName(parts.select(*own, "cost", "edits")))
    finally:
        files.delete(spark, folder)


def messages(repaired: DataFrame) -> DataFrame:
    """The messages that ``repair`` leaves: conv_id, block, place, edit, role, text."""
    rows = repaired.select("conv_id", "block", F.posexplode("edits").alias("place", "e")).where("e.edit <> 'D'")
    return rows.select("conv_id", "block", "place", "e.edit", "e.role", "e.text")


def report(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: its gaps, faults, illegal neighbours, cost, audit and the digest of what is left.

    Those without rows in ``repaired`` have zeros, an empty audit and the digest of an empty string.
    """
    said = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    letters = F.array_join(F.transform("edits", lambda e: F.repeat(e["edit"], e["times"].cast("int"))), "")
    rows = repaired.withColumns({"letters": letters, "said": F.array_join(said, "\n"), "n_said": F.size(said)})
    piece = F.struct("block", "turn_first", "turn_last", "first_role", "last_role", "letters", "said", "n_said")
    sums = [F.sum(c).alias(c) for c in ("n_turns", "blank", "duplicate", "truncated", "illegal", "cost")]
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.min("least").alias("least"), F.max("most").alias("most"), *sums)
    pairs = F.transform(F.slice("p", F.lit(2), F.size("p")), lambda y, i: F.struct(F.get("p", i).alias("x"), y.alias("y")))
    across = F.size(F.filter(pairs, lambda z: ~F.concat(z["x"]["last_role"], z["y"]["first_role"]).isin("su", "ua", "au")))
    shared = F.size(F.filter(pairs, lambda z: F.coalesce(z["x"]["turn_last"] == z["y"]["turn_first"], F.lit(False))))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - (F.col("n_turns") - shared), F.lit(0))
    text = F.array_join(F.transform(F.filter("p", lambda x: x["n_said"] > 0), lambda x: x["said"]), "\n")
    audit = F.array_join(F.transform("p", lambda x: x["letters"]), "")
    rows = rows.select(F.struct("conv_id").alias("conv"), gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + across).alias("illegal"), "cost", audit.alias("audit"), F.sha2(text, 256).alias("repaired_sha256"))
    ids = conversations.select("conv_id").distinct().select(F.struct("conv_id").alias("conv"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).cast("long").alias(c)
    rows = ids.join(rows, "conv", "left")
    return rows.select("conv.conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
