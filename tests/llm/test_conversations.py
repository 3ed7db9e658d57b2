"""op11: cost-to-go and walk against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from sparkreel.llm import conversations

TYPES = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def fits(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def prefix(initials):
    return re.fullmatch("s?(ua)*u?", initials) is not None


def search(rows):
    """(cost, audit, turns) of the cheapest edits, ties by ASCII: best first over (cost, audit)."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, turns = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, turns, kinds
        if (i, last) in done:
            continue
        done.add((i, last))
        steps = [("I", 5, i, role, "") for role in ("user", "assistant")]
        if i < len(rows):
            _, _, role, text = rows[i]
            steps.append(("D", 2, i + 1, None, None))
            if kinds[i] not in ("blank", "duplicate"):
                extra = 5 if kinds[i] == "truncated" else 0
                steps += [("K", extra, i + 1, role, text), ("R", 1 + extra, i + 1, "user", text), ("R", 1 + extra, i + 1, "assistant", text)]
        for edit, c, j, role, text in steps:
            now = last if role is None else role[:1]
            if role is None or (prefix("u" + now if last == "u" else "ua" + now if last == "a" else "s" + now if last == "s" else now) and role):
                heapq.heappush(heap, (cost + c, audit + edit, j, now, turns if role is None else (*turns, (role, text))))
    raise AssertionError


def exact(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in damage(rows):
        convs[r[0]].append(r)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        cost, audit, turns, kinds = search(own)
        assert fits("".join(r[:1] for r, _ in turns))
        numbers = [t for _, t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def found(spark, rows, types=TYPES):
    got = conversations.report(conversations.edits(conversations.damaged(spark.createDataFrame(rows, types))))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_over_all_edits(spark, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "so. ", "x ", " ", "é."]
    rows = []
    for conv in range(150):
        turn = rng.randrange(3)
        for _ in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "under"])
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(100)}."))
            turn += rng.choice([0, 1, 1, 1, 2])
    expected = exact(rows)
    assert len({r[7] for r in expected}) > 60
    assert found(spark, rows) == expected


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, "assistant", None), (None, None, None, "So."), (7, None, "user", "Hi."), (7, None, "user", "Hi."), (8, 5, None, None), (8, -(2**62), "user", "A."), (8, 2**62, "assistant", "B."), (9, 1, "", "")]
    rows += [(20, 3, "user", "Same.")] * 5
    assert found(spark, rows) == exact(rows)
    assert found(spark, []) == []
    top = [r for r in found(spark, [(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "B.")])]
    assert top[0][1] <= 2**63 - 1


def test_a_conversation_that_loses_all_its_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversations_texts_and_other_columns(spark):
    rows = [(i % 2, i // 2, ("user", "assistant")[i // 2 % 2], ("word " * 20_000 if i == 40 else f"Text {i}") + ".") for i in range(9000)]
    assert found(spark, [(*r, 1, "x") for r in rows], TYPES + ", n int, first string") == exact(rows)


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 1), (1, 1, "user", "There.", 2), (1, 2, "tool", "Done.", 1), (2, None, None, None, 0)], TYPES + ", n long")
    edited = conversations.edits(rows)
    assert [(r.role, r.text) for r in conversations.repaired(edited).orderBy("conv_id", "seq").collect()] == [("user", "There."), ("assistant", "Done.")]
    audits = {r.conv_id: (r.audit, r.cost) for r in conversations.report(edited).collect()}
    assert audits == {1: ("DKDR", 5), 2: ("", 0)}
