import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from strandline.llm import conversation_repair as cr
from strandline.llm.conversation_repair import repair_conversations
from strandline.llm.queries import damaged_turns, op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def plain_search(rows):
    """Uniform search over (row, output so far, edits): the first full match is the cheapest with the least edits."""
    heap, best = [(0, "", 0, "")], {}
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in ("", "a"):
            return cost, audit
        if (i, q) in best and best[i, q] <= (cost, audit):
            continue
        best[i, q] = (cost, audit)
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[q]
        for c in after.replace("s", ""):
            heapq.heappush(heap, (cost + 5, audit + "I", i, c))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q))
            if rows[i] != "x":
                more = 5 * rows[i].isupper()
                if rows[i].lower() in after:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, rows[i].lower()))
                for c in after.replace("s", ""):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, c))


def plain(rows, order):
    """Fields of one conversation: rows are dicts in any order."""
    rows = sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in order])
    seen, codes, count, last, illegal = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}, None, 0
    for r in rows:
        role, text = (" " if r[c] is None else r[c] for c in ("role", "text"))
        end = text.strip(SPACE)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        c = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
        last = role[:1]
    turns = {r["turn"] for r in rows if r["turn"] is not None}
    cost, audit = plain_search(codes)
    out, i, q = [], 0, ""
    for e in audit:
        if e == "K":
            q = codes[i].lower()
            out.append((rows[i]["role"], rows[i]["text"]))
        elif e in "RI":
            q = "a" if q == "u" else "u"
            out.append(({"u": "user", "a": "assistant"}[q], (" " if rows[i]["text"] is None else rows[i]["text"]) if e == "R" else ""))
        i += e != "I"
    assert PATTERN.match("".join(r[:1] for r, _ in out))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, out)


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r["conv_id"], []).append(r)
    return out


def test_search_equals_plain_on_all_short_rows():
    for n in range(6):
        for rows in itertools.product("xsuaoSUAO" if n < 4 else "xsuaoU", repeat=n):
            assert cr.search("".join(rows)) == plain_search("".join(rows)), rows


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_plain_on_random_rows(seed):
    rng = random.Random(seed)
    for _ in range(60):
        rows = "".join(rng.choice("xsuaouauaUAO") for _ in range(rng.randint(6, 40)))
        assert cr.search(rows) == plain_search(rows), rows


def test_search_from_both_ends_settles_about_half():
    seen = []
    back = cr._back
    cr._back = lambda rows, node: (seen.append(node), back(rows, node))[1]
    try:
        assert cr.search("ua" * 500) == (0, "K" * 1000)
    finally:
        cr._back = back
    assert seen and cr.search("o" * 3000) == (3000, "R" * 3000)


def test_edges(spark):
    data = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, None, "system", "S!"), (1, 5, "user", "more?"), (1, 5, "assistant", None),
        (2, None, None, None), (3, 0, "", "q."), (3, 1, "User", "q."), (None, 0, "user", "a" * 300_000 + "."), (None, 1, "assistant", "ok \n\x0b."),
        (4, 0, "user", "x."), (4, 0, "user", "x."), (5, 2, "assistant", "cut"), (6, 0, "user", " "), (6, 1, "assistant", "a. "),
    ]
    rows = spark.createDataFrame([(*d, k, "z") for k, d in enumerate(data)], SCHEMA + ", place int, rows string")
    got = {r.conv_id: r for r in repair_conversations(rows).collect()}
    told = grouped([dict(zip(("conv_id", "turn", "role", "text"), d)) for d in data])
    assert set(got) == set(told)
    for c, r in got.items():
        assert (*r[1:8], r.audit and r.audit, [tuple(t) for t in r.repaired]) == (lambda p: (*p[:7], p[6], p[7]))(plain(told[c], ("turn", "role", "text"))), c


def test_empty_table(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_damage(rows):
    for r in rows:
        shown = [" " if r[c] is None else r[c] for c in ("conv_id", "turn")]
        h = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = (" " if r[c] is None else r[c] for c in ("role", "text"))
        new = {"conv_id": r["conv_id"], "turn": r["turn"], "role": "user" if h == 4 else role, "text": "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text, "was_role": role, "was_text": text}
        for copy in range(0 if h == 0 else 2 if h == 3 else 1):
            yield new | {"copy": copy}


def test_query_against_plain(spark, sf, tmp_path):
    """All conversations, and hand-made ones with nulls, one of them all dropped."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    gone = next((c, t) for c in range(10**6, 10**6 + 99) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    more = [(*gone, "user", "a."), (None, None, "user", "b."), (None, 1, None, None), (-7, None, "assistant", None)]
    turns.union(spark.createDataFrame(more, SCHEMA)).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/conversations.parquet").collect()]
    damaged, want = grouped(plain_damage(rows)), {}
    for c in {r["conv_id"] for r in rows}:
        *counts, audit, out = plain(damaged[c], ("turn", "was_role", "was_text", "copy")) if c in damaged else (0, 0, 0, 0, 0, 0, "", [])
        want[c] = (*counts, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    got = op12_conversation_repair(spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)
    assert damaged_turns(turns).count() > 0 and gone[0] in want and want[gone[0]][6] == ""
