"""Repair of conversations against a search over all edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shelfwright.llm import queries, repair

SOUND, BEGUN = re.compile(r"(s?(ua)+)?\Z"), re.compile(r"s?(ua)*u?\Z")
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired rows) by trying edit sequences from the cheapest and ASCII-least on.

    Rows are (role, text, must go, truncated); what has been read so far and written so far is a state.
    """
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, out, kept = heapq.heappop(heap)
        if i == len(rows) and SOUND.match(out):
            return cost, audit, kept
        if (i, out) in done:
            continue
        done.add((i, out))
        options = [("I", 2, i, new, "") for new in ("user", "assistant")]
        if i < len(rows):
            role, text, gone, cut = rows[i]
            options.append(("D", 3, i + 1, None, None))
            if not gone:
                options.append(("K", cut, i + 1, role, text))
                options += [("R", 2 + cut, i + 1, new, text) for new in ("user", "assistant")]
        for edit, more, after, role, text in options:
            if role is None:
                heapq.heappush(heap, (cost + more, audit + edit, after, out, kept))
            elif role and BEGUN.match(out + role[0]):
                heapq.heappush(heap, (cost + more, audit + edit, after, out + role[0], (*kept, (role, text))))


def plain(turns):
    """The contract as loops over (id, turn, role, text) rows after damage."""
    out = {}
    for conv in {t[0] for t in turns}:
        rows = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in turns if c == conv]
        rows.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1], hashlib.sha256(y[2].encode()).hexdigest()))
        seen, marked, counts = set(), [], [0, 0, 0, 0]
        for _, role, text in rows:
            cut = text.rstrip(WHITE)
            blank, repeat, short = not cut, (role, text) in seen, cut[-1:] not in (".", "!", "?")
            seen.add((role, text))
            fault = 0 if blank else 1 if repeat else 2 if short else None
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, blank or repeat, int(short)))
        for a, b in zip(rows, rows[1:], strict=False):
            counts[3] += (a[1][:1] + b[1][:1]) not in ("su", "ua", "au")
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, kept = cheapest(tuple(marked))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        out[conv] = (gaps, *counts, cost, audit, digest)
    return out


def run(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = repair.Repair(df)
    digests = {r.conv_id: r.repaired_sha256 for r in made.digests().collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*r[1:], digests.get(r.conv_id, empty)) for r in made.summary().collect()}


def conversations(rng, n, longest):
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None, "", "Sam", "umpire"]
    texts = ["Hi.", "Ok!", "why? \n", "cut", "", " \t", None, "a.b", "é?", "x  "]
    return [
        (c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts))
        for c in [*range(n), None] for _ in range(rng.randint(0 if c else 1, longest))
    ]


def test_equals_search_over_all_edits(spark):
    turns = conversations(random.Random(8), 60, 7)
    assert run(spark, turns) == plain(turns)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_segments_of_any_length(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    turns = conversations(random.Random(bits), 25, 9)
    assert run(spark, turns) == plain(turns)


def test_walk_equals_search_over_all_edits():
    rng = random.Random(1)
    for _ in range(300):
        kinds = bytes(rng.randrange(4) + rng.choice((0, 0, 4)) + rng.choice((0, 0, 0, 8, 16)) for _ in range(rng.randint(1, 8)))
        rows = tuple((repair.INITIALS[k & 3] or "tool", str(i), bool(k & 24), int(bool(k & 4))) for i, k in enumerate(kinds))
        edits, state = repair.walk(kinds, repair.START, repair.END, True)
        cost, audit, _ = cheapest(rows)
        assert "".join(e for _, e, _ in edits) == audit
        assert repair.backward(kinds, repair.END)[repair.START] == cost
        assert state in (repair.START, repair.ASSISTANT)
        m = repair.transfer(kinds)
        for end in (repair.END, (5, 1, 7, 3)):
            assert repair.backward(kinds, end) == tuple(min(m[4 * s + t] + end[t] for t in range(4)) for s in range(4))


def test_one_conversation_of_a_hundred_thousand_rows(spark):
    rows = spark.range(100_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.expr("id div 2").alias("turn"),
        F.when(F.col("id") % 7 == 0, "tool").when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"),
        F.concat(F.expr("id % 50000").cast("string"), F.lit(".")).alias("text"),
    )
    got = repair.Repair(rows).summary().collect()
    assert len(got) == 1
    given = sorted(((i // 2, "tool" if i % 7 == 0 else "assistant" if i % 2 == 0 else "user", f"{i % 50000}.") for i in range(100_000)),
                   key=lambda r: (r[0], r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, role, text in given:
        kinds.append(repair.INITIALS.index(role[0] if role[0] in "sua" else "") + (repair.REPEAT if (role, text) in seen else 0))
        seen.add((role, text))
    edits, _ = repair.walk(bytes(kinds), repair.START, repair.END, True)
    assert got[0].cost == repair.backward(bytes(kinds), repair.END)[0]
    assert got[0].audit == "".join(e for _, e, _ in edits)
    assert got[0].duplicate == sum(bool(k & repair.REPEAT) for k in kinds)


def test_long_texts_empty_tables_and_clashing_names(spark):
    schema = "conv_id long, turn long, role string, text string, pos string, audit int"
    long = "word " * 400_000 + "."
    df = spark.createDataFrame([(1, 0, "user", long, "x", 1), (1, 1, "assistant", "yes.", "y", 2)], schema)
    made = repair.Repair(df)
    assert [tuple(r) for r in made.summary().collect()] == [(1, 0, 0, 0, 0, 0, 0, "KK")]
    assert made.digests().first().repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:yes.".encode()).hexdigest()
    empty = repair.Repair(df.limit(0))
    assert empty.summary().collect() == [] == empty.digests().collect() == empty.repaired().collect()


def test_steps_and_repaired_rows(spark):
    turns = [(1, 0, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 2, "tool", "Go."), (1, 3, "assistant", "cut")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = repair.Repair(df)
    steps = [(r.edit, r.role, r.text) for r in made.steps().orderBy("pos", "step").collect()]
    cost, audit, kept = cheapest(tuple(zip(*list(zip(*turns, strict=True))[2:], (False, True, False, False), (0, 0, 0, 1), strict=True)))
    assert "".join(e for e, _, _ in steps) == audit == made.summary().first().audit
    assert [(r, x) for e, r, x in steps if e != "D"] == list(kept)
    assert made.repaired().count() == len(kept)


def test_damage_by_checksum(spark):
    turns = [(c, t, "assistant", "One. Two!") for c in range(30) for t in [None, *range(6)]] + [(None, 1, None, None)]
    df = spark.createDataFrame([(*t, 7) for t in turns], "conv_id long, turn long, role string, text string, extra int")
    want = []
    for c, t, role, text in turns:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        case = zlib.crc32(key.encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text, 7)
        want += [row] * (0 if case == 0 else 2 if case == 3 else 1)
    assert sorted(map(str, map(tuple, repair.damage(df).collect()))) == sorted(map(str, want))


def test_query_gives_every_conversation(spark, tmp_path):
    rows = [(i, 0, "user", "x.") for i in range(60)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op11_repair"](spark, str(tmp_path)).collect()
    assert sorted(str(r.conv_id) for r in got) == sorted(str(r[0]) for r in rows)
    gone = [r for r in got if r.conv_id is not None and zlib.crc32(f"{r.conv_id}:0".encode()) % 20 == 0]
    assert gone and all(r[1:8] == (0, 0, 0, 0, 0, 0, "") and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in gone)
