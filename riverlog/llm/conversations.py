"""Operator 11: repair of conversation structure.

Turns of a conversation are marked by windows (blank, duplicate, truncated, illegal neighbours), collected in order as structs, and folded by
``aggregate``: it carries one (cost, audit) struct for each of the four states of the grammar ``(s?(ua)+)?`` over role initials, and each
step takes the ``least`` struct that leads to a state, so the cheapest edits and among them the ASCII-least audit win. No Python runs.
A long conversation is folded in blocks of ``block`` turns, each from every state that it may start in, and the blocks are folded then: the
audits that a step copies stay short, and the time grows with the turns. (An audit is never a proper prefix of another of equal cost: both
hold one letter a turn, and what one has more are insertions, which cost. So the least prefix leads to the least whole.)

A conversation's audit, hash and repaired turns are one value, so its texts are to fit into one (2 GB, Spark's bound).

Defined results: a null role or text is one space; null turns come first; rows that tie on their turn are ordered by role and text; equal
rows of one turn are duplicates; a role without initial can't be kept; rows with a null conv_id are one conversation; a conversation without turns left has
zeros and an empty audit; an empty table gives an empty result; further columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc_sql, read_table

BLANKS = " \t\n\x0b\f\r"
NEVER = 1 << 50  # the cost of a state that can't be reached
START, SYSTEM, USER, ASSISTANT = range(4)  # after nothing, s, ...u, ...a; the first and the last may end a conversation
BLOCK = 512  # turns that are folded at once


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped: rows damaged by their hash. A dropped row stays, so that its conversation does."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("dropped"), F.explode(copies).alias("_copy")).drop("_copy")


def flagged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text and, if rows may be left out, dropped) with place (from 0), fault, illegal and new_turn. All windows share one shuffle."""
    dropped = F.coalesce("dropped", F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped"))
    rows = rows.repartition("conv_id").withColumn("initial", F.substring("role", 1, 1))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    in_order = Window.partitionBy("conv_id", "dropped").orderBy(*order)
    alike = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("place")  # of equal rows of a turn, the later place is the duplicate
    rows = rows.withColumns({"place": F.row_number().over(in_order) - 1, "pair": F.concat(F.lag("initial").over(in_order), "initial"), "before": F.lag("turn").over(in_order)})
    rows = rows.withColumn("nth", F.row_number().over(alike))
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(said == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    new_turn = F.col("turn").isNotNull() & (F.col("before").isNull() | (F.col("before") != F.col("turn")))
    illegal = F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False))
    return rows.select("conv_id", "turn", "role", "text", "dropped", "initial", "place", fault.alias("fault"), illegal.alias("illegal"), new_turn.alias("new_turn"))


# The fold, as text: its lambdas nest. A state is a struct (cost, audit); `p` holds those before a turn `x`.
def _edit(state: str, cost: str, letters: str) -> str:
    return f"named_struct('cost', {state}.cost + {cost}, 'audit', concat({state}.audit, '{letters}'))"


def _filled(p: str) -> str:
    """The four states after insertions: a user turn leads to USER, an assistant turn from there to ASSISTANT."""
    user = f"least({p}[{USER}], {', '.join(_edit(f'{p}[{k}]', '5L', 'I') for k in (START, SYSTEM, ASSISTANT))})"
    last = f"least({p}[{ASSISTANT}], {_edit(f'{p}[{USER}]', '5L', 'I')}, {_edit(f'{p}[{START}]', '10L', 'II')}, {_edit(f'{p}[{SYSTEM}]', '10L', 'II')})"
    return f"array({p}[{START}], {p}[{SYSTEM}], {user}, {last})"


def _step(p: str, x: str) -> str:
    """The four states after a turn, from those after insertions: delete, or keep or rerole along the grammar."""
    bad, cut = f"{x}.fault in ('blank', 'duplicate')", f"if({x}.fault = 'truncated', 5L, 0L)"
    stay = lambda k: _edit(f"{p}[{k}]", "2L", "D")
    keep = lambda k, c: _edit(f"{p}[{k}]", f"if(not ({bad}) and {x}.initial = '{c}', {cut}, {NEVER}L)", "K")
    turn = lambda k: _edit(f"{p}[{k}]", f"if({bad}, {NEVER}L, 1L + {cut})", "R")
    to_user = ", ".join(f"{keep(k, 'u')}, {turn(k)}" for k in (START, SYSTEM, ASSISTANT))
    return f"""array({stay(START)}, least({stay(SYSTEM)}, {keep(START, 's')}), least({stay(USER)}, {to_user}),
        least({stay(ASSISTANT)}, {keep(USER, 'a')}, {turn(USER)}))"""


def _only(k: int) -> str:
    at = lambda j: f"named_struct('cost', {0 if j == k else NEVER}L, 'audit', '')"
    return f"array({', '.join(map(at, range(4)))})"


def _folded(turns: str, start: str) -> str:
    return f"""aggregate({turns}, {start}, (p, x) -> transform(array({_filled('p')}), q -> {_step('q', 'x')})[0],
        p -> transform(p, s -> named_struct('cost', least(s.cost, {NEVER}L), 'audit', if(s.cost < {NEVER}L, s.audit, ''))))"""


def _joined(p: str, block: str) -> str:
    """The four states after a block, from those before it."""
    via = lambda i, j: f"named_struct('cost', {p}[{i}].cost + {block}.ways[{i}][{j}].cost, 'audit', concat({p}[{i}].audit, {block}.ways[{i}][{j}].audit))"
    first = lambda j: f"{block}.ways[0][{j}]"  # noqa: E731  the first block starts with nothing
    return f"if({block}.block = 0, array({', '.join(map(first, range(4)))}), array({', '.join('least(' + ', '.join(via(i, j) for i in range(4)) + ')' for j in range(4))}))"


def repaired(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a conversation of ``turns`` (conv_id, turn, role, text and, if rows may be left out, dropped): gaps, the counts of faults, cost, audit, and ``turns``, the
    repaired array<struct<role, text>>."""
    rows = flagged(turns).withColumn("block", F.expr(f"(place div {block})"))
    there = ~F.col("dropped")
    struct = F.when(there, F.struct("place", "role", "text", "initial", "fault"))
    count = lambda c, name: F.count_if(there & c).alias(name)
    blocks = rows.groupBy("conv_id", "dropped", "block").agg(
        F.array_sort(F.collect_list(struct)).alias("turns"), F.min(F.when(there, F.col("turn"))).alias("low"), F.max(F.when(there, F.col("turn"))).alias("high"),
        count(F.col("new_turn"), "distinct"), *[count(F.col("fault") == f, f) for f in ("blank", "duplicate", "truncated")], count(F.col("illegal"), "illegal"),
    )
    starts = f"if(block = 0, array({_only(0)}), array({', '.join(map(_only, range(4)))}))"
    blocks = blocks.withColumn("ways", F.expr(f"transform({starts}, start -> {_folded('turns', 'start')})"))
    whole = blocks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(there, F.struct("block", "ways", "turns")))).alias("blocks"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("distinct").alias("distinct"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
    )
    end = f"""aggregate(blocks, {_only(0)}, (p, b) -> {_joined('p', 'b')},
        p -> transform(array({_filled('p')}), q -> least(q[{START}], q[{ASSISTANT}]))[0])"""
    whole = whole.withColumn("best", F.expr(end))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("long")
    return whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), _turns(F.flatten(F.col("blocks.turns")), F.col("best.audit")).alias("turns"))


def _turns(rows: Column, audit: Column) -> Column:
    """What an audit makes of the turns. Roles alternate from user on, after a system turn if it is kept."""
    steps = F.regexp_extract_all(audit, F.lit("(I*[DKR])"), F.lit(1))
    tail = F.length(audit) - F.length(F.rtrim(audit, F.lit("I")))
    new = lambda n: F.array_repeat(F.struct(F.lit("I").alias("edit"), F.lit("").alias("role"), F.lit("").alias("text")), n.cast("int"))
    one = lambda step, x: F.concat(new(F.length(step) - 1), F.filter(F.array(F.struct(F.right(step, F.lit(1)).alias("edit"), x["role"].alias("role"), x["text"].alias("text"))), lambda e: e["edit"] != "D"))
    left = F.concat(F.flatten(F.zip_with(steps, rows, one)), new(tail))
    system = F.when((F.get(left, F.lit(0))["edit"] == "K") & F.get(left, F.lit(0))["role"].startswith("s"), 1).otherwise(0)
    role = lambda e, k: F.when(e["edit"] == "K", e["role"]).when((k - system) % 2 == 0, "user").otherwise("assistant")
    return F.transform(left, lambda e, k: F.struct(role(e, k).alias("role"), e["text"].alias("text")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repaired(damaged(read_table(spark, sf_dir, "conversations")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(whole, 256).alias("repaired_sha256"))


def _sql_edit(state: int, cost: str, letters: str) -> str:
    return f"{{'cost': p{state}.cost + {cost}, 'audit': p{state}.audit || '{letters}'}}"


def _sql_step() -> dict[int, str]:
    """The states after the next turn, from q0 to q3, those after insertions."""
    e = lambda k, cost, letter: f"{{'cost': q{k}.cost + {cost}, 'audit': q{k}.audit || '{letter}'}}"
    may = lambda test, cost: f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND {test} THEN {cost} + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END ELSE {NEVER} END"
    keep, turn = lambda k, c: e(k, may(f"initial = '{c}'", "0"), "K"), lambda k: e(k, may("true", "1"), "R")
    to = {START: [], SYSTEM: [keep(START, "s")], USER: [f(k) for k in (START, SYSTEM, ASSISTANT) for f in (lambda k: keep(k, "u"), turn)], ASSISTANT: [keep(USER, "a"), turn(USER)]}
    return {k: f"least({', '.join([e(k, '2', 'D'), *ways])})" if ways else e(k, "2", "D") for k, ways in to.items()}


#: The same by recursion over turns: p0 to p3 are the states before one, q0 to q3 those after insertions.
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
source AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
fates AS (SELECT conv_id, turn, role, text, {crc_sql('k')} % 20 AS fate FROM source, crc_table),
damaged AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM (SELECT * FROM fates UNION ALL SELECT * FROM fates WHERE fate = 3) WHERE fate <> 0),
placed AS (SELECT conv_id, turn, role, text, role[1] AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS previous FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth FROM placed),
turns AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN said[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered),
faults AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
    count_if(fault = 'truncated') AS truncated, count_if(previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
start AS (SELECT DISTINCT conv_id, 0::BIGINT AS place, {{'cost': 0::BIGINT, 'audit': ''}} AS p0, {{'cost': {NEVER}::BIGINT, 'audit': ''}} AS p1, {{'cost': {NEVER}::BIGINT, 'audit': ''}} AS p2, {{'cost': {NEVER}::BIGINT, 'audit': ''}} AS p3 FROM source),
walk AS (SELECT * FROM start UNION ALL
    SELECT conv_id, place, {', '.join(f'{x} AS p{k}' for k, x in _sql_step().items())} FROM (
        SELECT w.conv_id, t.place, t.fault, t.initial, p0 AS q0, p1 AS q1, least(p2, {', '.join(_sql_edit(k, '5', 'I') for k in (START, SYSTEM, ASSISTANT))}) AS q2,
            least(p3, {_sql_edit(USER, '5', 'I')}, {_sql_edit(START, '10', 'II')}, {_sql_edit(SYSTEM, '10', 'II')}) AS q3
        FROM walk AS w JOIN turns AS t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.place = w.place + 1)),
ends AS (SELECT w.conv_id, unnest(least(p0, p3, {_sql_edit(USER, '5', 'I')}, {_sql_edit(START, '10', 'II')}, {_sql_edit(SYSTEM, '10', 'II')}))
    FROM walk AS w LEFT JOIN faults AS f ON w.conv_id IS NOT DISTINCT FROM f.conv_id WHERE w.place = coalesce(f.n, 0)),
letters AS (SELECT conv_id, i, audit[i] AS edit FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS i FROM ends)),
edits AS (SELECT *, count_if(edit <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS place FROM letters),
kept AS (SELECT e.conv_id, e.i, e.edit, t.role, CASE e.edit WHEN 'I' THEN '' ELSE t.text END AS text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.i) AS nth
    FROM edits AS e LEFT JOIN turns AS t ON e.conv_id IS NOT DISTINCT FROM t.conv_id AND e.place = t.place WHERE e.edit <> 'D'),
roles AS (SELECT *, max(CASE WHEN nth = 1 AND edit = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM kept),
hashes AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS whole FROM roles GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ends AS e LEFT JOIN faults AS f ON e.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN hashes AS h ON e.conv_id IS NOT DISTINCT FROM h.conv_id
"""
