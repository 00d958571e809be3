"""Conversation repair against an exhaustive search and a plain row-by-row search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

pytest.importorskip("moderata.llm")
from moderata.llm import queries, turn_repair  # noqa: E402


def search(rows):
    """(cost, audit, repaired) of rows (role, text, fault), row by row; the prefixes of every (roles so far mod form) kept."""
    best = {"": (0, "", ())}

    def grown(states):
        for _ in range(3):
            for form, (cost, audit, out) in list(states.items()):
                for role in ("user", "assistant"):
                    new = step(form, role[0])
                    if new is not None:
                        x = (cost + 3, audit + "I", (*out, (role, "")))
                        states[new] = min(states.get(new, x), x)
        return states

    def step(form, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "su", ("a", "u"): "u", ("sa", "u"): "su", ("u", "a"): "a", ("su", "a"): "sa"}.get((form, initial))

    for role, text, fault in rows:
        new = {}
        for form, (cost, audit, out) in grown(best).items():
            x = (cost + 4, audit + "D", out)
            new[form] = min(new.get(form, x), x)
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            for as_, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                to = step(form, as_[:1])
                if to is not None:
                    x = (cost + price + extra, audit + letter, (*out, (as_, text)))
                    new[to] = min(new.get(to, x), x)
        best = new
    return min(x for form, x in grown(best).items() if form in ("", "a", "sa"))


def judged(rows):
    """Rows in order with their first fault."""
    seen, out = set(), []
    for role, text in rows:
        said = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(conversations):
    """The result row of each conversation of (turn, role, text) rows."""
    found = {}
    for conv, rows in conversations.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in rows if r[0] is not None]
        faults = judged([r[1:] for r in rows])
        cost, audit, out = search(faults)
        initials = [r[1][:1] or "-" for r in rows]
        count = lambda f: sum(x[2] == f for x in faults)  # noqa: E731, B023
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest(),
        )
    return found


def collected(spark, conversations, **more):
    rows = [(conv, *row, *more.values()) for conv, found in conversations.items() for row in found]
    schema = "conv_id long, turn long, role string, text string" + "".join(f", `{k}` string" for k in more)
    audits, turns = turn_repair.repair(spark.createDataFrame(rows, schema).repartition(5))
    sums = {r["conv_id"]: r["repaired_sha256"] for r in turn_repair.digests(turns).collect()}
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], sums[r["conv_id"]]) for r in audits.collect()}


def test_cells_equal_an_exhaustive_search():
    """Every string of kinds up to four rows, against all edit strings up to its cost."""
    want = re.compile(r"(s?(ua)+)?")

    def every(kinds):
        options = []
        for k in kinds:
            extra = 3 * k.isupper()
            own = [(4, "D", "")] + ([] if k == "X" else [(3 + extra, "R", "u"), (3 + extra, "R", "a"), (extra, "K", k.lower())])
            options.append(own)
        inserts = [(3 * n, "I" * n, "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n)]
        best = (99, "")
        for edits in itertools.product(*options):
            base = sum(e[0] for e in edits)
            for gaps in itertools.product(inserts, repeat=len(kinds) + 1):
                cost = base + sum(g[0] for g in gaps)
                if cost <= best[0]:
                    said = gaps[0][2] + "".join(e[2] + g[2] for e, g in zip(edits, gaps[1:], strict=True))
                    if want.fullmatch(said):
                        best = min(best, (cost, gaps[0][1] + "".join(e[1] + g[1] for e, g in zip(edits, gaps[1:], strict=True))))
        return best

    for n in range(3):
        for kinds in itertools.product("suaoUAX", repeat=n):
            assert turn_repair.accepted(turn_repair.cell_of("".join(kinds))) == every(kinds), kinds
    r = random.Random(3)
    for _ in range(12):
        kinds = "".join(r.choices("suaoSUAX", k=3))
        assert turn_repair.accepted(turn_repair.cell_of(kinds)) == every(kinds), kinds


def test_every_split_gives_the_same_cell():
    r = random.Random(4)
    for _ in range(30):
        kinds = "".join(r.choices("suaoSUAX", k=r.randint(2, 40)))
        whole = turn_repair.cell_of(kinds)
        for cut in range(len(kinds) + 1):
            assert turn_repair.joined(turn_repair.cell_of(kinds[:cut]), turn_repair.cell_of(kinds[cut:])) == whole


def test_random_conversations(spark):
    r = random.Random(5)
    roles, texts = ["user", "assistant", "system", "admin", "bot", ""], ["a.", "b!", "c", "d?  ", " \t\n", "", "e. ", "f .\n", "g é"]
    talks = {}
    for conv in range(200):
        n = r.randint(1, 14)
        talks[conv] = [(r.choice([None, *range(9)]), r.choices(roles, [6, 6, 2, 1, 1, 1])[0], r.choice(texts) if r.random() < 0.4 else f"{r.random()}{r.choice(['.', ''])}") for _ in range(n)]
    assert collected(spark, talks) == expected(talks)


def test_long_conversations_and_copies_cross_blocks_and_partitions(spark):
    r = random.Random(6)
    long = [(t, r.choice(["user", "assistant"]), f"{t}{r.choice('.?x')}") for t in range(1500)]
    copies = [(3, "user", "again.")] * 700 + [(5, "assistant", "yes.")]
    said = [(t, "user" if t % 2 else "assistant", "ok.") for t in range(600)]
    talks = {1: long, None: copies, -3: said, 7: [(2**40, "user", "x" * 300_000 + ".")]}
    assert collected(spark, talks) == expected(talks)


def test_nulls_are_a_space_and_other_columns_stay_out(spark):
    rows = [(1, None, None, None, "x", "y"), (1, 0, "user", "a.", "x", "y"), (1, 1, None, "b.", "x", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, seq string")
    audits, turns = turn_repair.repair(frame)
    assert [r["audit"] for r in audits.collect()] == ["DKR"]
    assert [(t["edit"], t["role"], t["text"]) for r in turns.collect() for t in r["turns"]] == [("K", "user", "a."), ("R", "assistant", "b.")]


def test_empty_table(spark):
    audits, turns = turn_repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert audits.count() == 0 and turn_repair.digests(turns).count() == 0


def test_query_keeps_every_conversation(spark, tmp_path):
    r = random.Random(8)
    rows = [(c, t, ["user", "assistant"][t % 2], f"{r.random()}.") for c in range(60) for t in range(r.randint(1, 6))] + [(None, None, None, None), (99, None, "user", "hi.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    talks = {}
    for conv, turn, role, text in rows:
        said = talks.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        said += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    want = {c: x for c, x in expected({c: s for c, s in talks.items() if s}).items()} | {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, s in talks.items() if not s}
    got = {x["conv_id"]: (x["gaps"], x["blank"], x["duplicate"], x["truncated"], x["illegal"], x["cost"], x["audit"], x["repaired_sha256"]) for x in queries.QUERIES["op11_turn_repair"](spark, str(tmp_path)).collect()}
    assert got == want
