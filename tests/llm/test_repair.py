import hashlib
import heapq
import random
import re

from lotstack.llm import repair

TURNS = "conv_id long, turn long, role string, text string, before string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def brute(turns):
    """The expected row of one conversation's (turn, role, text), by a search over edits, cheapest and ASCII-least first."""
    turns = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    faults, seen = [], set()
    for _, role, text in turns:
        faults.append("blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if BLANK.findall(text)[-1] not in ".!?" else "")
        seen.add((role, text))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    open_, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, last, said = heapq.heappop(open_)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(turns) and last in ("", "a"):
            digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
            return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        names = {"u": "user", "a": "assistant"}
        for x in legal:
            if x in names:
                heapq.heappush(open_, (cost + 2, audit + "I", at, x, (*said, f"{names[x]}:")))
        if at < len(turns):
            _, role, text = turns[at]
            heapq.heappush(open_, (cost + 3, audit + "D", at + 1, last, said))
            if faults[at] in ("", "truncated"):
                extra = faults[at] == "truncated"
                if role[:1] and role[:1] in legal:
                    heapq.heappush(open_, (cost + extra, audit + "K", at + 1, role[0], (*said, f"{role}:{text}")))
                for x in legal:
                    if x in names:
                        heapq.heappush(open_, (cost + 2 + extra, audit + "R", at + 1, x, (*said, f"{names[x]}:{text}")))


def conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["Fine.", "Well!", "cut", "", " \t", "Fine.  ", "a. b", "Äh?", None, "same."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                rows.append((conv, rng.choice([turn, turn, None, turn * 3]), role, rng.choice([f"{rng.random()}.", *texts]), "x"))
    rng.shuffle(rows)
    return rows


def held(spark, rows, **parameters):
    found, turns = repair.repair(spark.createDataFrame(rows, TURNS), **parameters)
    by_conv = {}
    for conv, turn, role, text, _ in rows:
        by_conv.setdefault(conv, []).append((turn, role, text))
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == {conv: brute(turns) for conv, turns in by_conv.items()}
    said = {}
    for r in sorted(repair.repaired_turns(turns).collect(), key=lambda r: (str(r.conv_id), r.part, r.run, r.place, r.step)):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv in got:
        assert hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == got[conv][-1]


def test_short_conversations_equal_a_search_over_edits(spark):
    held(spark, conversations(1, 150, 8))


def test_long_conversations_go_through_the_tree(spark):
    rows = conversations(2, 6, 60) + [(None, t, r, "x.", "") for t, r in enumerate(["user", "user", "system", "assistant"])]
    held(spark, rows, run_rows=3, fan=2)
    held(spark, rows, run_bytes=40, fan=5)


def test_one_conversation_with_very_many_equal_turns(spark):
    rows = [(7, 1, "user", "again.", "")] * 5000 + [(7, 2, "assistant", "Yes.", "")] + [(7, t, "user", "again.", "") for t in range(3, 700)]
    held(spark, rows, run_rows=64, fan=4)


def test_elements_multiply_alike_in_any_grouping():
    rng = random.Random(5)
    steps = [repair.turn_matrix(rng.choice("suax"), rng.randrange(4)) for _ in range(40)]
    whole = repair.product(steps)
    left = repair.UNIT
    for m in steps:
        left = repair.times(left, m)
    assert whole == left
    cut = rng.randrange(1, 39)
    assert repair.times(repair.product(steps[:cut]), repair.product(steps[cut:])) == whole


def test_an_empty_table_gives_empty_tables(spark):
    found, turns = repair.repair(spark.createDataFrame([], TURNS))
    assert found.count() == 0 and repair.repaired_turns(turns).count() == 0


def test_damage_drops_empties_cuts_repeats_and_reassigns(spark):
    rows = [(None if t == 5 else 1, None if t == 7 else t, "assistant", None if t == 3 else f"Say {t}. Now!", "") for t in range(200)]
    import zlib

    expected = []
    for conv, turn, role, text, _ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        expected += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(tuple, repair.damaged(spark.createDataFrame(rows, TURNS)).collect()), key=str) == sorted(expected, key=str)
