"""Repair of conversations by the cheapest edits that make their roles alternate.

Faults are found with windows in Spark. What a search needs of a row is one letter: its role's
initial and whether it must go or is truncated. A conversation's letters are one string, and the
edits a walk through the lattice of (rows read, state of the role pattern). Dijkstra's algorithm
runs from both ends; once the two heaps' least costs together exceed the best meeting, every step
of every cheapest walk is settled from one end at least, so all crossings of that cost are known,
and the walk whose audit is least in ASCII order is read off them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs of edits; Keep is free.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. Where a kept initial leads, and the turn that comes next.
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
_ROLE = {2: "user", 3: "assistant"}
_ENDS = (0, 3)
_SPACE = " \t\n\x0b\x0c\r"

Node = tuple[int, int]


def _onward(rows: str, node: Node) -> Iterator[tuple[str, Node, int]]:
    """Edits that are possible at a node: initial, where it leads, cost."""
    i, q = node
    if i < len(rows):
        code = rows[i]
        yield "D", (i + 1, q), DELETE
        if code != "x":
            more = TRUNCATED if code.isupper() else 0
            if (q, code.lower()) in _KEEP:
                yield "K", (i + 1, _KEEP[q, code.lower()]), more
            yield "R", (i + 1, _NEXT[q]), REROLE + more
    yield "I", (i, _NEXT[q]), INSERT


def _back(rows: str, node: Node) -> Iterator[tuple[str, Node, int]]:
    """The same edits by where they lead."""
    i, q = node
    before = [p for p, to in _NEXT.items() if to == q]
    if i:
        code = rows[i - 1]
        yield "D", (i - 1, q), DELETE
        if code != "x":
            more = TRUNCATED if code.isupper() else 0
            yield from (("K", (i - 1, p), more) for (p, c), to in _KEEP.items() if to == q and c == code.lower())
            yield from (("R", (i - 1, p), REROLE + more) for p in before)
    yield from (("I", (i, p), INSERT) for p in before)


def search(rows: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits; the audit is the least of all of that cost.

    ``rows`` has a letter for each row: x must go; else s, u, a or o (another role), in upper case
    if the row is truncated.
    """
    steps = (_onward, _back)
    known: tuple[dict[Node, int], dict[Node, int]] = ({(0, 0): 0}, {(len(rows), q): 0 for q in _ENDS})
    heaps = tuple([(0, node) for node in sorted(side)] for side in known)
    done: tuple[dict[Node, int], dict[Node, int]] = ({}, {})
    least = min((known[1][x] for x in known[0] if x in known[1]), default=1 << 62)
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= least:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        cost, node = heapq.heappop(heaps[side])
        if node in done[side]:
            continue
        done[side][node] = cost
        for _, to, more in steps[side](rows, node):
            if cost + more < known[side].get(to, 1 << 62):
                known[side][to] = cost + more
                heapq.heappush(heaps[side], (cost + more, to))
            if to in known[1 - side]:
                least = min(least, known[side][to] + known[1 - side][to])
    return least, _least_audit(rows, {(0, 0): 0} | done[0], {(len(rows), q): 0 for q in _ENDS} | done[1], least)


def _least_audit(rows: str, ahead: dict[Node, int], behind: dict[Node, int], least: int) -> str:
    """The least audit over all crossings of cost ``least`` from nodes settled from the start to nodes settled from the end.

    At a node an initial leads to one node only, and no audit of a cost is the beginning of another
    of that cost, so the least initial at each step that stays on a cheapest walk gives the least audit.
    """
    leads = [u for u, cost in ahead.items() if cost + behind.get(u, least + 1) == least or any(cost + more + behind.get(w, least + 1) == least for _, w, more in _onward(rows, u))]
    useful = set(leads)
    while leads:
        u = leads.pop()
        for _, p, more in _back(rows, u):
            if p not in useful and p in ahead and ahead[p] + more == ahead[u]:
                useful.add(p)
                leads.append(p)
    at, cost, audit = (0, 0), 0, []
    while not (at[0] == len(rows) and at[1] in _ENDS and cost == least):
        audit_step, at, cost = min(
            (label, w, cost + more)
            for label, w, more in _onward(rows, at)
            if cost + more + behind.get(w, least + 1) == least or w in useful and ahead[w] == cost + more
        )
        audit.append(audit_step)
    return "".join(audit)


def _plan(rows: str) -> tuple[int, str, list[int], list[str | None]]:
    """Cost, audit, and for each turn of the result its row (-1: inserted) and its new role (none: as it was)."""
    cost, audit = search(rows)
    row, q, taken, roles = 0, 0, [], []
    for edit in audit:
        if edit in "RI":
            q = _NEXT[q]
            taken.append(row if edit == "R" else -1)
            roles.append(_ROLE[q])
        elif edit == "K":
            q = _KEEP[q, rows[row].lower()]
            taken.append(row)
            roles.append(None)
        row += edit != "I"
    return cost, audit, taken, roles


_short_plan = lru_cache(maxsize=1 << 14)(_plan)


def _plans(rows: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_short_plan(x) if len(x) <= 64 else _plan(x) for x in rows], columns=["cost", "audit", "taken", "roles"])


def with_faults(turns: DataFrame, order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """conv_id, turn, role, text, place (from 1), fault (blank, duplicate, truncated or null) and illegal (with the row before).

    A row's first fault counts: blank (no ``[^\\x20\\x09-\\x0D]``), duplicate (role and text seen
    earlier in the conversation), truncated (the last such character is not ``.``, ``!`` or ``?``).
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    own = Window.partitionBy("conv_id").orderBy(*by)
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.row_number().over(own).alias("place"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("place")) > 1
    end = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(end == "", "blank").when(F.col("seen"), "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.left("role", F.lit(1))
    step = F.concat(F.lag(initial).over(Window.partitionBy("conv_id").orderBy("place")), initial)
    return rows.withColumn("seen", seen).withColumn("fault", fault).withColumn("illegal", F.coalesce(~step.isin("su", "ua", "au"), F.lit(False))).drop("seen")


def repair_conversations(turns: DataFrame, order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (long), audit (string) and repaired (array of structs role, text).

    Edits, in the order of the rows: Keep costs 0, Rerole to user or assistant 1, Delete 2 (required
    for blank and duplicate rows), Insert of an empty user or assistant turn anywhere 5; truncated
    rows that stay add 5. The cheapest edits whose role initials read ``(s?(ua)+)?`` are taken, of
    equal ones those whose initials are least in ASCII order, and named by ``audit``.

    Defined cases: a null role or text is one space, so such a text is blank; rows are ordered by
    ``order``, nulls first; gaps are turn numbers that are missing between the least and the
    greatest, nulls left out; repeated rows are duplicates; roles are known by their first
    character, in lower case; a null conv_id is a conversation of its own; extra columns are not
    read; texts may be of any length, but a conversation's texts together are one row of the
    result, and its letters one string of the search; an empty table gives an empty table.
    """
    rows = with_faults(turns, order)
    initial = F.left("role", F.lit(1))
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    code = F.when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("place"))
    rows = rows.withColumn("code", code).withColumn("fresh", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(before))
    counts = [F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("fresh"), F.lit(0).cast("long"))
    whole = rows.groupBy("conv_id").agg(gaps.alias("gaps"), *counts, F.count_if("illegal").alias("illegal"), F.sort_array(F.collect_list(F.struct("place", "code", "role", "text"))).alias("rows"))
    plans = F.pandas_udf(_plans, "cost long, audit string, taken array<int>, roles array<string>")
    planned = whole.withColumn("plan", plans(F.array_join(F.transform("rows", lambda r: r["code"]), "")))
    turn = F.zip_with(
        "plan.taken", "plan.roles",
        lambda k, role: F.struct(F.coalesce(role, F.get(F.col("rows.role"), k)).alias("role"), F.when(k < 0, "").otherwise(F.get(F.col("rows.text"), k)).alias("text")),
    )
    return planned.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "plan.cost", "plan.audit", turn.alias("repaired"))
