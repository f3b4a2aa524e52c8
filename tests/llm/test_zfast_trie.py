"""The conversation trie against brute force: random shapes, copies, nested and long conversations, nulls, ties and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seriesloom.llm import zfast_trie
from seriesloom.llm.zfast_trie import prefix_digests, sequences, spliced, trie_nodes, zfast_trie as build

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth string, n long, digest int, total int, rep int"


def turns_of(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda x: (x[0], x[1], zfast_trie._symbol(x[2].encode(), x[3].encode()))
    return {c: [x[2:] for x in sorted(v, key=key)] for c, v in by.items()}


def brute(by):
    """All nodes of conversations {conv_id: turns} by plain dictionaries."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in by.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, own in members.items():
        value = (len(own) - 1) * len(BLANK.findall(n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += value
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(own), len(n), min(members[n[:-1]]) if n else -1, len(own), children[n], leaves[n], saved[n], sha(ends[n])) for n, own in members.items())


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in df.collect())


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(parts)


def test_shapes(spark):
    draw = random.Random(3)
    paths = [tuple(draw.choice("ab") for _ in range(draw.randrange(1, 14))) for _ in range(80)]
    paths += [("a",) * n for n in range(1, 20)] + [("hot", "one", "two")] * 60 + [("hot", *(draw.choice("xyz") for _ in range(3)), str(i)) for i in range(60)]
    rows = [(7 * i - 300, 2 * t, "user" if t % 2 else None, f"{x} {x}\n" * draw.choice([1, 1]), ) for i, p in enumerate(paths) for t, x in enumerate(p)]
    assert found(trie_nodes(*sequences(prefix_digests(frame(spark, rows))))) == brute(turns_of(rows))


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, None, None), (2, 0, "user", "hello there"), (2, 1, "", ""), (2, 1, "", ""), (None, 0, "user", "lost"), (3, None, "user", "first"), (3, None, "a", "b"), (3, 0, "user", "later"),
            (4, 5, "user", "b a"), (4, 5, "a", "x"), (-40, 0, "user", "hello there"), (5, 0, "us", "erhello there"), (6, 1, "user", "w " * 200_000), (7, 1, "user", "w " * 200_000)]
    assert found(trie_nodes(*sequences(prefix_digests(frame(spark, rows))))) == brute(turns_of(rows))
    none = frame(spark, rows).where("false")
    assert found(trie_nodes(*sequences(prefix_digests(none)))) == []
    assert found(trie_nodes(*spliced(prefix_digests(none), F.col("conv_id"), F.lit(1), 2))) == []


def test_long_conversation_over_all_partitions(spark):
    rows = [(9, t, "user", f"turn {t % 50}") for t in range(3000)] + [(10, t, "user", f"turn {t % 50}") for t in range(2500)] + [(8, t, "user", "x") for t in range(3)] + [(11, 0, "user", "turn 0")]
    want = turns_of(rows)
    got = {(r.conv_id, r.position): (r.digest, r.total) for r in prefix_digests(frame(spark, rows, 7)).collect()}
    for c, turns in want.items():
        digest = total = 0
        for k, (role, text) in enumerate(turns, 1):
            digest = (digest * zfast_trie._BASE + zfast_trie._symbol(role.encode(), text.encode())) % zfast_trie._P
            total += len(text.split())
            assert got[c, k] == (digest.to_bytes(16), total)
    assert len(got) == len(rows)


def test_handles(spark):
    """Every node lies under the digest of its two-fattest depth, and edges cover every depth of every sequence."""
    draw = random.Random(5)
    rows = [(i, t, "user", draw.choice("pq")) for i in range(40) for t in range(draw.randrange(1, 12))]
    ends, paths = sequences(prefix_digests(frame(spark, rows)))
    distinct = ends.groupBy("digest").agg(F.min("conv_id").alias("seq"), F.first("length").alias("length"))
    digest = {(r.seq, r.depth): r.digest for r in paths.collect()}
    nodes = build(distinct.select("seq", "length", "digest"), paths).collect()
    fattest = lambda a, b: max(range(a + 1, b + 1), key=lambda f: f & -f)
    covered = collections.Counter()
    for r in nodes:
        assert digest[r.rep, fattest(r.lo, r.hi)] == r.handle and digest[r.rep, r.lo + 1] == r.name and digest[r.rep, r.hi] == r.extent
        assert r.up == (digest[r.rep, r.lo] if r.lo else bytes(16))
        covered.update(digest[r.rep, d] for d in range(r.lo + 1, r.hi + 1))
    assert len({r.handle for r in nodes}) == len(nodes) and covered == collections.Counter(set(digest.values()))


@pytest.mark.parametrize("most", [3])
def test_spliced(spark, most):
    draw = random.Random(4)
    rows = [(c, t, "user", draw.choice("abc") + " word") for c in [*range(0, 90), 145, 146, 150, -5, -40] if c != 40 for t in range(draw.randrange(1, 7))]
    by = turns_of(rows)
    want = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        want[c] = by.get(base, [])[:h] + own[h:]
    assert any(not v for v in want.values())
    conv = F.col("conv_id")
    got = trie_nodes(*spliced(prefix_digests(frame(spark, rows)), conv - conv % 20, F.crc32(conv.cast("string")) % 4, most))
    assert found(got) == brute(want)


def test_hashes_of_large_groups(spark):
    """Groups cut by partitions and by pieces hash like their ids in a row."""
    groups = {b"a" * 16: range(0, 3000, 2), b"b" * 16: [5], b"c" * 16: range(-50, 50)}
    rows = spark.createDataFrame([(bytearray(d), c) for d, ids in groups.items() for c in ids], "digest binary, conv_id long").repartition(6)
    got = {bytes(r.digest): r.sha for r in zfast_trie._id_hashes(rows, chunk=100).collect()}
    assert got == {d: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest() for d, ids in groups.items()}
