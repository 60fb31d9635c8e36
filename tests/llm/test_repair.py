import hashlib
import random
import zlib

import pytest

from caselight.llm import repair
from caselight.llm.oracles import ORACLE_SQL
from caselight.llm.queries import QUERIES
from tools.check import compare, connect

NAME = "op12_bidirectional_repair"
SPACE = " \t\n\x0b\x0c\r"


def plain(letters, first=0, ends=(0, 3)):
    """Least (cost, audit) by steps over all rows and states, from one end."""
    best = {first: (0, "")}

    def insert(b):
        for _ in range(2):
            for q, (c, a) in list(b.items()):
                way = (c + 3, a + "I")
                b[repair.STEP[q]] = min(b.get(repair.STEP[q], way), way)
        return b

    for letter in letters:
        new = {}
        for q, (c, a) in insert(best).items():
            for edit, cost, to in repair.row_edits(letter, q):
                way = (c + cost, a + edit)
                new[to] = min(new.get(to, way), way)
        best = new
    return min((w for q, w in insert(best).items() if q in ends), default=None)


def test_both_searches_find_the_least_audit():
    rng = random.Random(5)
    for n in [*range(9), 14, 40]:
        for _ in range(60):
            letters = "".join(rng.choice("ADEHIKLMPAEEII") for _ in range(n))
            for p in range(4):
                for q in range(4):
                    assert repair.solve(letters, p, q) == plain(letters, p, (q,))
            cut = rng.randint(0, n)
            parts = [repair._solved(x, False) for x in (letters[:cut], letters[cut:])]
            assert repair.joined(*parts) == repair._solved(letters, False)


def brute(rows, damaged):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20 if damaged else 19
            if kind == 0:
                continue
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        named = lambda t: hashlib.sha256(f"{' ' if conv is None else conv}:{len(t[1])}:{t[1]}{t[2]}".encode()).digest()
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), named(t)))
        faults, seen, letters = [], set(), ""
        for _, role, text in turns:
            bare = text.rstrip(SPACE)
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
            letters += repair.CODES[max("sua".find(role[:1]) if role else -1, -1) % 4 * 4 + faults[-1]]
        cost, audit = plain(letters)
        made, state, i = [], 0, 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else turns[i][1:]
            if edit == "K":
                state = repair.KEEP[role[0]][state]
                made.append(f"{role}:{text}")
            elif edit in "RI":
                state = repair.STEP[state]
                made.append(f"{'user' if state == 2 else 'assistant'}:{text}")
            i += edit != "I"
        ts = [t for t, *_ in turns if t is not None]
        gaps = min(max(ts) - min(ts) + 1 - len(set(ts)), repair.LONG) if ts else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        sha = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, sha)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def whole(df, damaged, **how):
    rows = repair.damage(df) if damaged else df
    found = repair.repair(rows, df.select("conv_id"), **how)
    turns = repair.repaired_turns(rows, found)
    sha = {r.conv_id: r.sha256 for r in repair.turn_digests(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*(r[c] for c in COLUMNS), sha.get(r.conv_id, empty)) for r in found.collect()}


def odd_rows():
    rng = random.Random(8)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([0, 1, 2, 5, 9])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \n", None, "a? \t", "é…", "x" * 3_000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), role, text))
    rows += [(100, t, "user" if t % 2 else "assistant", f"turn {t}" + "." * (t % 3 > 0)) for t in range(300)]
    rows += [(101, 7, "user", "again.")] * 90 + [(102, -(2**63), "user", "a."), (102, 2**63 - 1, "assistant", "b.")]
    return rows


@pytest.mark.parametrize("damaged", [True, False])
@pytest.mark.parametrize(("block", "fan"), [(1_024, 16), (4, 2)])
def test_odd_rows(spark, damaged, block, fan):
    rows = odd_rows()
    schema = "conv_id long, turn long, role string, text string, edit string, audit string"
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], schema).repartition(5)
    assert whole(df, damaged, block=block, fan=fan) == brute(rows, damaged)


def test_query_matches_sql_and_brute_force(spark, sf):
    found = QUERIES[NAME](spark, sf)
    assert compare(found, connect(sf).sql(ORACLE_SQL[NAME])) == ""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows, True)
    assert {r.conv_id: tuple(r[c] for c in (*COLUMNS, "repaired_sha256")) for r in found.collect()} == want


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Rules."), (1, 1, "user", "Hi."), (1, 2, "user", "There?"), (2, 0, "user", ""), (3, 0, "tool", "Out.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.repair(df)
    turns = sorted(tuple(r) for r in repair.repaired_turns(df, found).collect())
    assert [t[2:] for t in turns if t[0] == 1] == [("K", "system", "Rules."), ("K", "user", "Hi."), ("R", "assistant", "There?")]
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (3, "KKR"), 2: (4, "D"), 3: (4, "D")}


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(none, none).count() == 0 and repair.repaired_turns(none, repair.repair(none)).count() == 0
    ids = spark.createDataFrame([(5,), (None,)], "conv_id long")
    assert sorted(r.cost for r in repair.repair(none, ids).collect()) == [0, 0]
