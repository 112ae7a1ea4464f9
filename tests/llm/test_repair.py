import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

from sparkrecon.llm import registry, repair

NAMES = {"u": "user", "a": "assistant"}


def brute(rows):
    """The cheapest, then least audit over all edit sequences (uniform cost), and the counts, of rows (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done, best = [(0, "", 0, "", ())], set(), None
    while heap:
        cost, audit, at, out, lines = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            best = cost, audit, lines
            break
        key = at, out[:1] == "s", len(out.lstrip("s")) % 2, out in ("", "s"), out == ""
        if key in done:
            continue
        done.add(key)
        due = "ua"[len(out.lstrip("s")) % 2]
        heapq.heappush(heap, (cost + 5, audit + "I", at, out + due, (*lines, NAMES[due] + ":")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, out, lines))
            if faults[at] in ("", "truncated"):
                more, first = (5 if faults[at] else 0), role[:1]
                if first == due or (first == "s" and out == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, out + first, (*lines, f"{role}:{text}")))
                if first != due:
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, out + due, (*lines, f"{NAMES[due]}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def harmed(rows):
    """(conv_id, turn, role, text) as the contract damages them, in order, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        found = out.setdefault(conv, [])
        text = {1: "", 2: re.sub("[.!?]", "", space(text))}.get(kind, space(text))
        found += [(turn, "user" if kind == 4 else space(role), text)] * {0: 0, 3: 2}.get(kind, 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {conv: sorted(found, key=order) for conv, found in out.items()}


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in df.collect()]
    out = {r[0]: r[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def some(rng, conv, n):
    texts = ["a.", "b!", "c?", "d", "", " \t", "e.\n", "ok.", "f.", "long text" * 5 + "."]
    return [(conv, rng.choice([None, *range(n)]) if rng.random() < 0.3 else i, rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]), rng.choice([*texts, *(f"own {i}." for _ in range(20)), None])) for i in range(n)]


def test_random_conversations_against_brute_force(spark):
    rng = random.Random(6)
    rows = [r for conv in range(400) for r in some(rng, conv, rng.randint(1, 9))] + some(rng, None, 6)
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {conv: brute(found) for conv, found in harmed(rows).items()}
    assert got(repair.repaired(repair.damaged(table.selectExpr("*", "1 AS part", "2 AS audit", "3 AS times")))) == want


def test_large_conversation_in_pieces(spark):
    """One of two thirds of all rows, cut into pieces at several places; copies of a row lie in many pieces."""
    rng = random.Random(8)
    rows = some(rng, "big", 4500) + [("big", 7, "user", "again and again.")] * 2500 + [r for c in range(300) for r in some(rng, f"c{c}", rng.randint(1, 8))]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(5)
    want = {conv: brute(found) for conv, found in harmed(rows).items()}
    assert got(repair.repaired(repair.damaged(table))) == want


def test_system_only_at_the_start_across_pieces(spark):
    rows = [("x", i, "system", f"s {i}.") for i in range(2500)] + [("x", 2500, "user", "q."), ("x", 2501, "assistant", "a.")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id string, turn long, role string, text string, times long")
    cost, audit, digest = got(repair.repaired(table))["x"][5:]
    want = brute([r[1:] for r in rows])
    assert (cost, audit, digest) == want[5:]


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(registry.op13_conversation_repair(spark, sf)) == {conv: brute(found) for conv, found in harmed(rows).items()}


def test_odd_rows(spark):
    kind = "conv_id long, turn long, role string, text string, times long"
    rows = [(1, 5, "user", "x.", 0), (2, None, None, None, 1), (3, 1, "user", "y" * 3000000 + ".", 1), (3, 9, "assistant", "z" * 3000000, 3), (4, 1, "user", "q.", 1), (4, 1, "user", "q.", 1)]
    table = spark.createDataFrame(rows, kind)
    empty = hashlib.sha256(b"").hexdigest()
    found = got(repair.repaired(table))
    assert found[1] == (0, 0, 0, 0, 0, 0, "", empty) and found[2] == (0, 1, 0, 0, 0, 2, "D", empty)
    assert found[3] == brute([(1, "user", rows[2][3]), *[(9, "assistant", rows[3][3])] * 3])
    assert found[4] == brute([(1, "user", "q.")] * 2)
    assert got(repair.repaired(table.limit(0))) == {}


def test_replay_follows_the_audit():
    assert repair.replay("KKK", ["system", "user", "assistant"], ["a", "b", "c"]) == (["system:a", "user:b", "assistant:c"], "u")
    assert repair.replay("DRI", ["tool", "tool"], ["a", "b"]) == (["user:b", "assistant:"], "u")
    assert [k for k, _ in groupby(repair.accepted(repair.scanned(repair.began(), "t", 0))[1])] == ["D"]
