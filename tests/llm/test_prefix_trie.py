import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowlens.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string, depth string"


@pytest.fixture(scope="module")
def table(spark):
    def build(rows, parts=6):
        df = spark.createDataFrame([(*r, "mine", "own") for r in rows], SCHEMA)
        return df.repartition(parts) if rows else df
    return build


def conversations(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            found[conv].append((turn is not None, turn or 0, name, (role, text)))
    return {c: [x[-1] for x in sorted(t)] for c, t in found.items()}


def rebuild(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(b"%d" % c) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        total[node] = (int(not kids[node]) + sum(total[k][0] for k in kids[node]),
                       (len(members[node]) - 1) * words + sum(total[k][1] for k in kids[node]))
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(kids[node]), *total[node],
                   hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
                  for node, m in members.items())


def result(paths, height=T.HEIGHT):
    rows = T.trie(paths, height).select(
        "conv_id", "depth", F.coalesce("parent_conv_id", F.lit(-1)), "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256")
    return sorted(map(tuple, rows.collect()))


def made(rng, convs, longest, words="a bb ccc dd\te"):
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(rng.choices(words.split(" "), k=rng.randint(0, 2)))))
    return rows


def test_rebuilt_against_brute_force(table):
    rng = random.Random(5)
    rows = made(rng, [*range(0, 70), *range(83, 100), *range(-25, 0)], 7)
    rows += [(200, 0, None, None), (200, None, "user", "null turn first"), (201, 3, "", ""), (None, 0, "user", "no id"),
             (203, 1, "user", "x"), (203, 1, "user", "x"), (203, 1, "system", "tie"), (1 << 62, 0, "a", "b c")]
    rng.shuffle(rows)
    assert result(T.rebuilt(T.numbered(table(rows)))) == brute(rebuild(conversations(rows)))


@pytest.mark.parametrize("height", [2, 3, 32])
def test_bands(table, height):
    rng = random.Random(height)
    rows = made(rng, range(30), 4)
    deep = [(t, "user", str(t)) for t in range(70)]
    for c in (100, 101, 102):
        rows += [(c, t, r, x if t < 60 or c != 102 else "other") for t, r, x in deep[:70 - (c == 101) * 9]]
    assert result(T.plain(T.numbered(table(rows))), height) == brute(conversations(rows))


def test_one_conversation_and_copies_hold_a_third_each(table):
    rng = random.Random(9)
    rows = [(7, t, "user", f"turn {t % 50}") for t in range(700)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1240) for t in range(3)] + made(rng, range(20, 200), 5)
    turns = T.numbered(table(rows, 12))
    assert result(T.rebuilt(turns)) == brute(rebuild(conversations(rows)))


def test_many_ids_end_at_one_node(table, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 40)
    rows = [(c, 0, "user", "hello") for c in range(0, 4000, 20)] + [(c, 0, "user", f"own {c}") for c in range(1, 4000, 97)]
    assert result(T.plain(T.numbered(table(rows)))) == brute(conversations(rows))


def test_repeated_rows_and_null_turns_only(table):
    rows = [(3, None, "user", "again")] * 300 + [(4, None, None, None)] * 5
    assert result(T.plain(T.numbered(table(rows)))) == brute(conversations(rows))


def test_carries_over_whole_partitions():
    rows = [dict(part=p, words=a, conv_id=b, pos=n, s1=s, s2=s) for p, a, b, n, s in
            [(0, 1, 5, 2, 10), (2, 5, 5, 3, 7), (3, 5, 5, 1, 1), (4, 5, 6, 4, 9), (5, 7, 7, 1, 2)]]
    got = T._carries(rows)
    assert set(got) == {2, 3, 4} and [got[p][0] for p in (2, 3, 4)] == [2, 5, 6]


def test_empty_table(table):
    assert result(T.rebuilt(T.numbered(table([])))) == []
    assert result(T.plain(T.numbered(table([(None, 1, "a", "b")])))) == []
