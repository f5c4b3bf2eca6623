import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from tidemark.llm.prefix_trie import Item, common_depth, conversation_trie, grow, prefix_trie, turn_tokens

SCHEMA = "conv_id long, turn long, role string, text string, depth long, key string, g int"


def talk(n=90, seed=3):
    """Shared beginnings of many lengths, exact copies, prefixes of others, null turns, roles and texts, repeated turns, a long one."""
    r = random.Random(seed)
    rows, texts = [], ["hello", "Hé", "", None, "go on", "ja ja", "x" * 50]
    for c in range(n):
        if r.random() < 0.1:
            continue
        for turn in range(r.choice([1, 2, 2, 3, 5, 12])):
            rows.append((c, turn if r.random() < 0.9 else None, r.choice(["user", "bot", None]) if turn > 1 else "user", r.choice(texts) if turn > 1 else texts[turn % 2]))
    rows += [(1_000 + i, t, "user", f"copy {t}") for i in range(0, 200, 5) for t in range(12)]
    rows += [(2_000, t, "user", f"long {t % 7}") for t in range(600)] + [(2_001, 3, "user", "own")] + [(-7, 0, "a", "minus"), (-5, 0, "a", "minus"), (-5, 1, "b", "five")]
    rows += [rows[0], rows[0], (None, 1, "user", "nobody's")]
    return rows


def brute(rows, siblings=5):
    def order(row):
        name = f"{len((row[2] or '').encode())}:{row[2] or ''}{row[3] or ''}"
        return (row[1] is not None, row[1] or 0, hashlib.md5(name.encode()).digest())

    own = defaultdict(list)
    for row in sorted((x for x in rows if x[0] is not None), key=order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    rebuilt = {}
    for c, turns in own.items():
        anchor = c - (abs(c) % siblings) * (1 if c >= 0 else -1)
        h = crc32(str(c).encode()) % 9
        rebuilt[c] = turns if anchor == c else own.get(anchor, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_equals_brute_force(spark, partitions):
    rows = talk()
    table = spark.createDataFrame([(*x, 5, "clash", 1) for x in rows], SCHEMA).repartition(5)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(conversation_trie(table)) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_without_siblings_and_one_conversation(spark):
    rows = [x for x in talk(30, 8) if x[0] is None or x[0] < 500]
    table = spark.createDataFrame([(*x, 5, "clash", 1) for x in rows], SCHEMA)
    assert rows_of(conversation_trie(table, siblings=1)) == brute(rows, 1)
    single = [(4, 0, "user", "a"), (4, 1, "bot", "bc")]
    assert [r[:7] for r in rows_of(conversation_trie(spark.createDataFrame([(*x, 5, "", 1) for x in single], SCHEMA), siblings=1))] == [
        (4, 0, None, 1, 1, 1, 0), (4, 1, 4, 1, 1, 1, 0), (4, 2, 4, 1, 0, 1, 0)]


def test_turnless_conversations_only_and_empty_tables(spark):
    lone = next(c for c in range(1, 200) if c % 5 and crc32(str(c).encode()) % 9)
    rows = [(lone, 0, "user", "gone")]
    table = spark.createDataFrame([(*x, 5, "", 1) for x in rows], SCHEMA)
    assert rows_of(conversation_trie(table)) == brute(rows) and conversation_trie(table).count() == 1
    assert conversation_trie(table.where("false")).count() == 0
    assert conversation_trie(table.withColumn("conv_id", table["conv_id"] * None)).count() == 0


def test_a_hot_string_is_spread_and_its_members_are_streamed(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token = turn_tokens(spark.createDataFrame([(1, 0, "user", "same", 1, "", 1)], SCHEMA)).first()["token"]
        strings = spark.range(20_000).selectExpr("id AS conv_id", f"unhex('{token.hex()}') AS seq")
        assert strings.repartitionByRange("seq", "conv_id").selectExpr("spark_partition_id() AS p").groupBy("p").count().agg({"count": "max"}).first()[0] < 4_000
        root, leaf = rows_of(prefix_trie(strings))
        assert root[:7] == (0, 0, None, 20_000, 1, 1, 19_999 * 4) and leaf[:7] == (0, 1, 0, 20_000, 0, 1, 19_999 * 4)
        assert leaf[7] == hashlib.sha256(",".join(map(str, range(20_000))).encode()).hexdigest()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_merges_make_branching_nodes():
    t = [bytes([c]) * 24 for c in b"abcde"]
    strings = sorted([b"", t[0], t[0] + t[1], t[0] + t[1] + t[2], t[0] + t[1] + t[3], t[4] + t[0], t[4] + t[1]])
    nodes, depth, above = grow([Item(s) for s in strings])
    assert len(nodes) == len(strings) + 1 and nodes[-1].seq == t[4] and depth[-1] == 1
    for node, up in zip(nodes, above):
        longest = max((s for s in [n.seq for n in nodes] if node.seq.startswith(s) and s != node.seq), key=len, default=None)
        assert (nodes[up].seq if up >= 0 else None) == longest
    assert common_depth(t[0] + t[1], t[0] + t[1] + t[2]) == 2 and common_depth(t[0] + b"x" * 24, t[0] + b"x" * 23 + b"y") == 1 and common_depth(b"", t[0]) == 0
