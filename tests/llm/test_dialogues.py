import hashlib
import itertools
import random
import re
import zlib

import pytest

from postlab.llm import dialogues
from postlab.llm.dialogues import repair
from postlab.llm.queries import dialogues as query

ROWS = "conv_id long, turn long, role string, text string"
BLANK = hashlib.sha256().hexdigest()


def cheapest(turns):
    """(cost, audit, lines) by trying every edit at every turn; turns are (role, text, fault)."""
    def inserted(at):
        for _ in range(8):
            for state, (cost, audit, lines) in list(at.items()):
                role = "assistant" if state == "u" else "user"
                new = (cost + 5, audit + "I", [*lines, f"{role}:"])
                if role[0] not in at or new[:2] < at[role[0]][:2]:
                    at[role[0]] = new
        return at

    at = {"": (0, "", [])}
    for role, text, fault in turns:
        after = {}
        for state, (cost, audit, lines) in inserted(at).items():
            ways = [("D", 2, state, None)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (state + role[:1]) in ("s", "u", "su", "ua", "au") and role:
                    ways.append(("K", extra, role[0], f"{role}:{text}"))
                name = "assistant" if state == "u" else "user"
                ways.append(("R", 1 + extra, name[0], f"{name}:{text}"))
            for edit, price, to, line in ways:
                new = (cost + price, audit + edit, lines + [line] * (line is not None))
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        at = after
    at = inserted(at)
    return min((at[s] for s in ("", "a") if s in at), key=lambda x: x[:2])


def restated(rows):
    """The whole answer of one conversation from its damaged (turn, role, text) rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    firsts = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(firsts))
    cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def hurt(rows):
    """The contract's damage, by conversation, in order."""
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        own += [(turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    return {c: restated(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, own in by.items()}


def noisy(seed, convs=120, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        n = rng.randint(0, longest)
        for turn in range(n):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.6 else rng.choice(["user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No", "Well ?\n", " \t", "", None, "a: b!", "Ünï。", f"turn {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), role, text))
    return rows


def answers(got):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got.collect()}


@pytest.mark.parametrize("seed", range(40))
def test_unrolled_edits_are_the_least(seed):
    rng = random.Random(seed)
    for _ in range(60):
        symbols = "".join(rng.choice("suaxSUAX---ua") * rng.choice([1, 1, 1, 2, 5]) for _ in range(rng.randint(0, 7)))
        fault = lambda c: "blank" if c == "-" else "truncated" if c.isupper() else ""
        want = cheapest([(c.lower().replace("-", "u"), "", fault(c)) for c in symbols])
        assert dialogues.costs(symbols, dialogues._END)[0] == want[0]
        assert dialogues.unrolled(symbols, dialogues._END, 0, True)[0] == want[1], symbols


def test_powers_pass_long_runs():
    assert dialogues.costs("u" * 1001, dialogues._END)[0] == cheapest([("user", "", "")] * 1001)[0]
    assert dialogues.before_run("u", 10 ** 15, dialogues._END)[0] == 10 ** 15 // 2      # every second user becomes an assistant


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_query_is_the_restatement(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(dialogues, "SEGMENT_BITS", bits)
    monkeypatch.setattr(dialogues, "CHUNK", 8)
    rows = noisy(bits) + [(None, 0, "user", "Hi."), (None, None, None, None), (9000, None, "user", "x."), (9001, 5, "assistant", "last")]
    rows += [(9002, i % 7, "user", f"same {i % 5}.") for i in range(300)]
    spark.createDataFrame(rows, ROWS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = query.query(spark, str(tmp_path))
    assert [c for c, _ in got.dtypes][0] == "conv_id" and got.count() == len({r[0] for r in rows})
    assert answers(got) == hurt(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "There?"), (1, 3, "tool", ""), (2, 0, "assistant", "What."), (3, 0, "x", "")]
    got = repair(spark.createDataFrame(rows, ROWS)).turns().orderBy("conv", "place").collect()
    assert [(r.conv, r.edit, r.role, r.text) for r in got] == [
        (1, "K", "system", "Be kind."), (1, "K", "user", "Hi."), (1, "R", "assistant", "There?")]


def test_names_inside_and_empty_tables(spark):
    odd = spark.createDataFrame([("a", 1, "user", "Hi.", 5, "x"), ("a", 2, "assistant", "Yes.", 6, "y")],
                                "conv_id string, turn int, role string, text string, pos int, edits string")
    assert [tuple(r) for r in repair(odd).audits.collect()] == [("a", 0, 0, 0, 0, 0, 0, "KK")]
    assert repair(odd.limit(0)).audits.count() == 0 and repair(odd.limit(0)).hashes().count() == 0
