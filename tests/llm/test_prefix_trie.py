"""Prefix trie of conversations against a plain trie, the SQL, and its handling of odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest

from choicefield.functions import groups
from choicefield.llm import prefix_trie as op
from choicefield.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """Nodes by their whole path; ``rows`` are (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children, below = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        kids = children.get(node, [])
        below[node] = (sum(below[k][0] for k in kids) or 1, own_saved + sum(below[k][1] for k in kids))
    return sorted((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, [])), *below[node],
                   hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(node)).encode()).hexdigest())
                  for node, cs in members.items())


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def nodes(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def conversations(seed, n):
    """Few different turns, so that conversations meet, leave and end at many depths; copies, prefixes and long ones."""
    rng, rows, kept = random.Random(seed), [], []
    for i in range(n):
        c = rng.choice([i, 100 * i, -i, 7 + i])
        path = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "cccc"])) for _ in range(rng.randint(1, 7))]
        if kept and rng.random() < 0.6:
            old = rng.choice(kept)
            path = old[:rng.randint(0, len(old))] + path[:rng.randint(0, 3)]
        kept.append(path)
        rows += [(c, rng.choice([t, t, t, None, 3]), role, text) for t, (role, text) in enumerate(path)]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, False), (2, False), (3, True)])
def test_same_as_a_plain_trie(spark, monkeypatch, seed, hot):
    rows = conversations(seed, 120)
    if hot:
        rows += [(5000, t, "user", "x" * (t % 3)) for t in range(150)] + [(5001, t, "user", "x" * (t % 3)) for t in range(140)]
        monkeypatch.setattr(groups, "HOT_ROWS", 30)
        monkeypatch.setattr(groups, "RANGES", 4)
        monkeypatch.setattr(op, "PIECE", 3)
    assert nodes(op.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_every_conversation_extends_the_one_before(spark):
    rows = [(100 * c, t, "user", f"turn {t}") for c in range(1, 16) for t in range(c + 6)]
    assert nodes(op.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    assert op.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert op.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    rows = [(3, 1, "user", "x"), (3, 1, "user", "x"), (3, None, None, None), (4, 0, "user", "y" * 100_000), (None, 1, "user", "x")]
    extra = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", d int, members int")
    assert nodes(op.prefix_trie(extra)) == brute(rows)
    # all turns are cut and no first of the hundred is there to give others: members of the root only
    few = [(c, 0, "user", "x") for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6]
    assert nodes(op.prefix_trie(spark.createDataFrame(few, SCHEMA))) == brute(few)
    assert len(brute(few)) == 1


def test_query_and_sql(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    got = nodes(QUERIES["op11_prefix_trie"](spark, SMALL))
    assert got == brute([tuple(r) for r in table])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SMALL}/conversations.parquet')")
    assert got == sorted(con.sql(ORACLE_SQL["op11_prefix_trie"]).fetchall())
