"""Repaired conversations against a plain statement of the rule."""

from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256

import pytest

from clipweave.llm.queries import QUERIES
from clipweave.llm.repair import cheapest, damaged, repair_conversations, repair_report, replay

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, cost string, said int"


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """The cheapest edits, from the best (cost, edits) of all states after each turn and after at most so many inserts, with no queue."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    grammar = re.compile("s?(ua)*u?")
    best = {"": (0, "", [])}  # by what counts of the roles so far

    def better(into, roles, value):
        if grammar.fullmatch(roles):
            k = roles if len(roles) < 3 else roles[-2:]
            k = {"": "", "s": "s"}.get(k, "ua" if k.endswith("a") else "u")
            if k not in into or value[:2] < into[k][:2]:
                into[k] = value

    def inserted(states):
        for _ in range(3):
            for k, (cost, audit, out) in list(states.items()):
                for role in ("user", "assistant"):
                    better(states, k + role[0], (cost + 3, audit + "I", [*out, f"{role}:"]))
        return states

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        more = 3 if fault == "truncated" else 0
        for k, (cost, audit, out) in inserted(best).items():
            better(after, k, (cost + 4, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                if role[:1] in ("s", "u", "a"):
                    better(after, k + role[:1], (cost + more, audit + "K", [*out, f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    better(after, k + new[0], (cost + 3 + more, audit + "R", [*out, f"{new}:{text}"]))
        best = after
    cost, audit, out = min(v for k, v in inserted(best).items() if k in ("", "ua"))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha256("\n".join(out).encode()).hexdigest())


def plain_report(rows, after, h=None):
    groups = {c: [] for c, *_ in rows}
    for r in after:
        groups[r[0]].append(r)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], h(r[3]) if h else 0)
    return sorted(((c, *plain_repair(sorted(g, key=key))) for c, g in groups.items()), key=str)


def as_rows(df):
    return sorted(((r.conv_id, *(r[c] for c in COLUMNS)) for r in df.collect()), key=str)


def made(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        turn = rnd.randint(-2, 3)
        for _ in range(rnd.randint(1, longest)):
            turn += rnd.choice([1, 1, 1, 1, 2])
            rows.append((c, turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(["Yes.", "no", f"t{turn}!", f"x {turn} ", "", " \t", None, "why? \n"])))
    return rows


@pytest.mark.parametrize(("block", "partitions", "longest"), [(512, 4, 9), (1, 3, 7), (3, 7, 30), (7, 2, 60)])
def test_against_plain_rule(spark, block, partitions, longest):
    rows = made(block, 60, longest)
    rows += [(None, t, "user", "a null id.") for t in range(3)] + [(700, None, "user", "A."), (700, 4, "assistant", "B!")]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(5)
    got = repair_report(table, damaged(table), block=block, partitions=partitions)
    assert as_rows(got) == plain_report(rows, plain_damage(rows))


def test_one_long_conversation(spark):
    # Crosses every partition and many blocks; its neighbours are short.
    rows = [(5, t, *r[2:]) for t, r in enumerate(made(3, 40, 60))] + [(4, 0, "user", "Hi."), (6, 0, "user", "Hi.")]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(4)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert as_rows(repair_conversations(table, block=50, partitions=6)) == plain_report(plain, plain)


def test_ties_repeats_and_empty(spark):
    rows = [(1, 1, "user", "A."), (1, 1, "user", "A."), (1, 1, "user", "A."), (1, 2, "assistant", "é" * 100_000 + "!"), (2, None, "user", None), (2, None, "assistant", "ok.")]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    plain = [(c, t, r, " " if x is None else x) for c, t, r, x in rows]
    for block in (1, 2, 512):
        assert as_rows(repair_conversations(table.repartition(3), block=block)) == plain_report(plain, plain)
    assert repair_report(table.limit(0), damaged(table.limit(0))).count() == 0
    gone = repair_report(table.where("conv_id = 2"), table.limit(0)).collect()
    assert [(r.conv_id, r.cost, r.audit, r.repaired_sha256) for r in gone] == [(2, 0, "", sha256(b"").hexdigest())]


def test_edits():
    assert cheapest([]) == (0, "")
    assert cheapest([("system", "s.", ""), ("user", "u.", ""), ("assistant", "a.", "")]) == (0, "KKK")
    assert cheapest([("assistant", "a.", "")]) == (3, "IK")
    assert cheapest([("user", "u.", ""), ("user", "v.", "")]) == (3, "KR")
    assert replay([("user", "u."), ("user", "v.")], "KR", 0) == "user:u.\nassistant:v."


def test_registered_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(QUERIES["op13_conversation_repair"](spark, sf_dir)) == plain_report(rows, plain_damage(rows))
