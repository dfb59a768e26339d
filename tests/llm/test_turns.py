import hashlib
import heapq
import random
import zlib

from threadmill.llm import turns

from .conftest import SF

SPACE = " \t\n\v\f\r"


def harmed(rows):
    """conv_id -> its rows (turn, role, text) after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else "".join(c for c in text if c not in ".!?") if harm == 2 else text
        kept += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def cheapest(rows, flags):
    """The repair by a search over (row, state), cheapest and then ASCII-least first, with its turns."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        ok = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        full = {"u": "user", "a": "assistant"}
        for k in ok.replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", i, k, (*out, full[k] + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if flags[i] not in ("blank", "duplicate"):
                more = 3 * (flags[i] == "truncated")
                if role[:1] in set(ok):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for k in ok.replace("s", ""):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, k, (*out, f"{full[k]}:{text}")))


def brute(rows):
    out = {}
    for conv, kept in harmed(rows).items():
        flags, seen = [], set()
        for _, role, text in kept:
            end = text.rstrip(SPACE)
            flags.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        numbers = [t for t, _, _ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        cost, audit, text = cheapest(kept, flags)
        count = [flags.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def got(df):
    text = "sha2(array_join(transform(repaired, r -> concat(r.role, ':', r.text)), '\n'), 256)"
    rows = df.selectExpr("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", text + " sha").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string, block int, ways string, fault int"


def frame(spark, rows):
    """rows with columns named as the operator's own."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def test_table_against_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    have = {r[0]: tuple(r[1:]) for r in turns.op13_turn_repair(spark, SF).collect()}
    assert have == want and any("I" in w[6] for w in want.values()) and any("D" in w[6] for w in want.values())


def test_random_conversations(spark):
    """Odd roles, nulls, repeated rows and turns, gaps, negative turns: against the search."""
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]
    said = ["a.", "b!", "c", "d? \n", " \t", "", None, "e.f", "ü."]
    rows = []
    for conv in [None, *range(400)]:
        turn = rng.choice([-3, 0, 250])
        for _ in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(roles), rng.choice(said)))
            turn += rng.choice([0, 1, 1, 1, 2])
    want = brute(rows)
    assert got(turns.repaired(turns.damaged(frame(spark, rows)))) == want and None in want


def test_long_conversations_and_empty_tables(spark):
    """Conversations of many blocks, with long texts; one whose rows are all dropped; an empty table."""
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["x. ", "y", f"{t}!", "z" * 3000 + "."])) for c in range(2) for t in range(0, 1500, c + 1)]
    none = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((none, 0, "user", "hello."))
    have = got(turns.repaired(turns.damaged(frame(spark, rows))))
    assert have == brute(rows) and have[none] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turns.repaired(turns.damaged(frame(spark, rows).where("false"))).count() == 0
