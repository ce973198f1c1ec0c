"""The conversation trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from petroloom.llm import queries, shared, trie
from tests.compare import differ

SCHEMA = "conv_id long, turn long, role string, text string, node string, _part int, n_run long"


def plain(rows):
    """{(conv_id, depth): row} of a trie built turn by turn."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
        convs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[x] for x in children[seq]) or 1
        saved[seq] = sum(saved[x] for x in children[seq]) + (len(members[seq]) - 1) * (len(seq[-1][1]) if seq else 0)
    out = {}
    for seq, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if convs[c] == seq)
        out[min(held), len(seq)] = (min(members[seq[:-1]]) if seq else None, len(held), len(children[seq]), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "n", 7, 1) for r in rows], SCHEMA)
    got = trie.prefix_trie(df).collect()
    made = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(made) == len(got)
    return made


def test_odd_conversations(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, negative ids, absent heads, turnless rebuilds,
    characters outside the basic plane, long texts, and columns named as the module's own. Role and text are
    told apart, order counts, and texts that repeat in one conversation are depths of their own."""
    rows = [(None, 1, "user", "x"), (0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "b"), (0, 1, "user", "b"), (0, 2, "", "\U0001f600é"), (0, 9, "user", "z"), (0, 10, "user", "zz")]
    rows += [(c, t, "user", f"t{t % 2}") for c in (1, 2, 3, 4, 5, 77, 250, 251, 299, -1, -105, -100, 10**15) for t in range(c % 4 + 1)]
    rows += [(6, None, "user", "late"), (6, None, None, "late"), (7, 3, "a", "x:y"), (8, 3, "a:", "xy")]
    rows += [(900, 0, "ab", "c"), (901, 0, "a", "bc"), *[(902, t, "u", "x") for t in range(9)], *[(903, t, "u", "x") for t in range(9)], *[(904, t, "u", "xy"[t % 2]) for t in range(9)], *[(905, t, "u", "yx"[t % 2]) for t in range(9)]]
    rows += [(700, 0, "user", "é" * 500_000), (700, 1, "user", "a"), (701, 0, "user", "b"), (701, 9, "user", "c"), (703, 0, "user", "é" * 500_000)]
    assert found(spark, rows) == plain(rows)


def test_one_long_and_many_alike(spark):
    """One conversation holds a third of all rows and another third are copies of one."""
    rng = random.Random(3)
    rows = [(100, t, "user", str(rng.randrange(3))) for t in range(700)]
    rows += [(c, t, "system", f"w{t}") for c in range(200, 300) for t in range(7)]
    rows += [(c, t, "user", str(rng.randrange(2))) for c in range(301, 391) for t in range(rng.randrange(1, 12))]
    assert found(spark, rows) == plain(rows)


def test_empty(spark):
    assert not found(spark, [(None, 1, "user", "x")])


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_by_key(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice([-5, 1, 1, 1, 9]), rng.randrange(40), rng.randrange(-9, 9), rng.getrandbits(62)) for _ in range(900)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = shared.materialize(spark.createDataFrame(rows, "k long, o long, v long, x long"), "t")
        got = shared.running_by_key(df, "k", [df["o"].desc(), df["v"].asc(), df["x"].asc()], ["v"], ["x"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    want, sums = [], {}
    for k, o, v, x in sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3])):
        a, b = sums.get(k, (0, 0))
        sums[k] = a + v, b ^ x
        want.append((k, o, v, x, *sums[k]))
    assert sorted(map(tuple, got)) == sorted(want)


def test_query(spark, sf):
    assert differ(spark, queries.queries()["op11_prefix_trie"], queries.oracle_sql()["op11_prefix_trie"], sf) == ""
