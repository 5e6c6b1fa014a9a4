"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from loreweave.llm import conversation_repair as repair
from loreweave.llm.queries import ORACLE_SQL, QUERIES
from parity import compare

WHITE = " \t\n\x0b\x0c\r"
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}


def cheapest(turns, faults):
    """(cost, audit, repaired lines): best-first search by cost, then audit, over single edits."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(turns) and state in (0, 3):
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        wants, after = NEXT[state], {"u": 2, "a": 3}[NEXT[state]]
        full = {"u": "user", "a": "assistant"}[wants]
        steps = [(3, "I", i, after, (full + ":",))]
        if i < len(turns):
            role, text = turns[i]
            steps.append((4, "D", i + 1, state, ()))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                steps.append((3 + more, "R", i + 1, after, (f"{full}:{text}",)))
                if role[:1] == wants:
                    steps.append((more, "K", i + 1, after, (f"{role}:{text}",)))
                if role[:1] == "s" and state == 0:
                    steps.append((more, "K", i + 1, 1, (f"{role}:{text}",)))
        for c, letter, j, to, new in steps:
            heapq.heappush(heap, (cost + c, audit + letter, j, to, lines + new))
    raise AssertionError


def brute(rows):
    held = {}
    for conv, turn, role, text in rows:
        own = held.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, own in held.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = cheapest([x[1:] for x in own], faults)
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


TURN = "conv_id long, turn long, role string, text string"


def some_rows(seed, n, convs):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "Usher", "sage"]
    texts = ["Yes.", "No", "ok!", " ", "", "\t\n", "What?  ", "x" * 40 + ".", None, "é.", ". a"]
    rows = []
    for _ in range(n):
        text = rng.choice(texts)
        if text and rng.random() < 0.5:
            text = str(rng.randrange(30)) + text
        rows.append((rng.choice(convs), rng.choice([None, -(2**40), *range(max(4, n // 4))]), rng.choice(roles), text))
    return rows


def test_query_agrees_with_search(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op11_conversation_repair"](spark, sf)) == brute(rows)


def test_agrees_with_sql(spark, sf):
    compare(spark, sf, QUERIES["op11_conversation_repair"], ORACLE_SQL["op11_conversation_repair"])


@pytest.mark.parametrize("seed", range(3))
def test_odd_rows_agree_with_search(spark, seed):
    """Nulls in every column, ties of turns, repeated rows, strange roles; most rows in one conversation."""
    rows = some_rows(seed, 400, [1, 1, 1, 2, None, *range(10, 40)])
    rows += rows[:60]
    df = spark.createDataFrame(rows, TURN).repartition(7)
    assert results(repair.repair_damaged(df)) == brute(rows)
    # Conversations cut in pieces of a few turns.
    assert results(repair.repair_damaged(df, hold=90, piece=50)) == brute(rows)


def test_a_hot_conversation_is_dealt_over_tasks(spark):
    rows = some_rows(9, 3000, [7])
    df = spark.createDataFrame(rows, TURN).repartition(5)
    assert results(repair.repair_damaged(df)) == brute(rows)
    told = repair.normal(df).selectExpr("*", "1L as times")
    told = told.groupBy("conv", "known", "turn", "role", "text").agg({"times": "sum"}).withColumnRenamed("sum(times)", "copies").selectExpr("*", "false as again", "right(rtrim(text), 1) as bare")
    key = ("conv", "known", "turn", "role", "text")
    parts = told.repartitionByRange(4, *key).sortWithinPartitions(*key).mapInArrow(repair._stretches(1 << 22, 1 << 16), repair.PART_SQL)
    sizes = sorted(len(r.codes) for r in parts.where("kind = 'run'").collect())
    assert len(sizes) == 4 and sizes[0] > 0.1 * sizes[-1]


def test_identical_rows_are_one_with_a_number(spark):
    rows = [(3, 2, "user", "Same again.")] * 5000 + [(3, 5, "assistant", "Fine.")]
    got = results(repair.repair_damaged(spark.createDataFrame(rows, TURN)))
    assert got == brute(rows) and len(got[3][6]) > 4999


def test_lost_and_empty_conversations(spark):
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    df = spark.createDataFrame([(lost, 0, "user", "Gone.", 1)], TURN + ", codes int")
    assert results(repair.repair_damaged(df)) == {lost: (0, 0, 0, 0, 0, 0, "", empty)}
    assert repair.repair_damaged(df.limit(0)).count() == 0


def test_far_turns_and_clashing_columns(spark):
    kept = next(c for c in range(10_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (-(2**63), 2**63 - 1)))
    df = spark.createDataFrame([(kept, -(2**63), "user", "A.", 1, "x"), (kept, 2**63 - 1, "assistant", "B.", 2, "y")], TURN + ", conv int, digest string")
    assert results(repair.repair_damaged(df))[kept][0] == 2**63 - 1


@pytest.mark.parametrize("seed", range(40))
def test_halving_and_tables_give_the_same_edits(seed):
    """Any cut into stretches, each entered and left as the tables say, gives the edits of the whole."""
    rng = random.Random(seed)
    codes = bytes(rng.choices(range(9), k=rng.randrange(1, 40)))
    end = bytes([repair.END])
    whole = repair.script(codes + end)
    faults = ["blank" if c == 8 else "truncated" if c > 3 else "" for c in codes]
    cost, audit, _ = cheapest([("suax"[c % 4] if c < 8 else "x", "t") for c in codes], faults)
    assert (repair.cost_of(whole, codes), repair.audit_of(whole, {})) == (cost, audit)
    cuts = sorted({0, len(codes), *(rng.randrange(len(codes)) for _ in range(3))})
    parts = [codes[a:b] for a, b in itertools.pairwise(cuts)]
    tables = [*map(repair.stretch_table, parts), repair.TABLES[repair.END]]
    found = repair.crossings(tables, repair.START, repair.ACCEPTED, repair.forward, repair.backward, lambda t: t)
    pieces = [repair.script(p, q, tuple(0 if s == after else None for s in range(4))) for p, (q, after) in zip(parts[:-1], found, strict=False)]
    pieces.append(repair.script(parts[-1] + end, found[len(parts) - 1][0]))
    assert "".join(pieces) == whole
