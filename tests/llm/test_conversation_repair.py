import hashlib
import random
import zlib
from itertools import groupby

import pytest

from lectern.llm import conversation_repair as repair
from lectern.llm.queries import QUERIES

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, part string"


def with_inserts(labels):
    for _ in range(3):
        for q, (cost, audit) in list(labels.items()):
            for role in "ua":
                if (q, role) in STEP:
                    to, new = STEP[q, role], (cost + 2, audit + "I")
                    labels[to] = min(labels.get(to, new), new)
    return labels


def brute(rows):
    """Row by row over all states, in plain Python: rows are (turn, role, text) in order."""
    labels, seen, faults = with_inserts({0: (0, "")}), set(), []
    for _, role, text in rows:
        body = text.strip(SPACES)
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        new = {}
        for q, (cost, audit) in labels.items():
            options = [(q, 3, "D")]
            if fault not in ("b", "d"):
                late = int(fault == "t")
                options += [(STEP[q, role[:1]], late, "K")] if (q, role[:1]) in STEP else []
                options += [(STEP[q, r], 2 + late, "R") for r in "ua" if (q, r) in STEP]
            for to, more, edit in options:
                x = (cost + more, audit + edit)
                new[to] = min(new.get(to, x), x)
        labels = with_inserts(new)
    cost, audit = min(labels[q] for q in (0, 3) if q in labels)
    state, left, lines = 0, iter(rows), []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)[1:]
        if edit == "D":
            continue
        role = role if edit == "K" else ("assistant" if state == 2 else "user")
        lines.append(f"{role}:{text}")
        state = STEP[state, role[:1]]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    """conv_id -> (turn, role, text) in order, in plain Python; rows are (conv_id, turn, role, text)."""
    found = {}
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        found.setdefault(conv, []).extend([(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    return {c: sorted(v, key=order) for c, v in found.items()}


def repaired(df, block=repair.BLOCK):
    from pyspark.sql import functions as F

    got = repair.conversations(repair.repair(repair.damage(df), F.col("absent"), block)).collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(found) == len(got)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_all_states_row_by_row(seed):
    rnd = random.Random(seed)
    for _ in range(400):
        rows = [(k, rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice(["", f"t{k}.", f"t{k}.", f"t{k}", "same."])) for k in range(rnd.randint(0, 12))]
        seen, codes = set(), ""
        for _, role, text in rows:
            codes += (role[0] if role[0] in "sua" else "-") + ("b" if not text else "d" if (role, text) in seen else "." if text.endswith(".") else "t")
            seen.add((role, text))
        assert repair.cheapest(codes) == brute(rows)[5:7]


def test_whole_table(spark, sf):
    want = damaged([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, sf).collect()}
    assert got == {c: brute(rows) for c, rows in want.items()}


@pytest.fixture(params=["true", "false"])
def joined_tasks(spark, request):
    """Small partitions joined, and left as they are, so that conversations go on from task to task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("block", [2, 5, repair.BLOCK])
def test_long_conversations_nulls_ties_and_repeats(spark, block, joined_tasks):
    rnd = random.Random(3)
    text = lambda k: rnd.choice([None, "", " \n", "same.", "same.", f"text {k}.", f"text {k}", f"text {k}?\t", "x" * 3000 + "."])
    rows = [(1, k // 2, rnd.choice(["user", "assistant", "system"]), text(k)) for k in range(90)]  # one conversation of many rows
    rows += [(2, k, ["user", "assistant"][k % 2], f"clean {k}.") for k in range(40)] + [(7, k, ["assistant", "user"][k % 2], f"odd {k}.") for k in range(41)]
    rows += [(rnd.choice([3, 4, None]), rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", "system", None, "", "tool"]), text(k)) for k in range(60)]
    rows += [rows[5]] * 4 + [(9, None, "user", "a."), (9, None, "user", "a."), (9, 4, "user", "a.")]
    lost = next(k for k in range(100, 999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "dropped."))
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    want = {c: brute(v) for c, v in damaged(rows).items()}
    assert want[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(df, block) == want


def test_parts_hold_the_repaired_turns_in_order(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"text {k}.", "", "") for k in range(20)]
    parts = repair.repair(spark.createDataFrame(rows, SCHEMA), block=4).orderBy("conv_id", "part").collect()
    assert len(parts) >= 5 and [t["text"] for p in parts for t in p["turns"]] == [f"text {k}." for k in range(20)]
    assert [p["cost"] for p in parts] == [None] * (len(parts) - 1) + [0]
    for _, same in groupby(parts, key=lambda p: p["conv_id"]):
        assert not any(p["single"] for p in same)


def test_no_rows(spark):
    assert repaired(spark.createDataFrame([], SCHEMA)) == {}
