import hashlib
import os
import random
import zlib

from pyspark.sql import functions as F

from txnlens.llm import common, trie

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    """By the contract: rebuilt conversations, all their prefixes, walks over subtrees."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, key), (role, text)))
    convs = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = (*convs.get(c - c % 100, [])[:h], *own[h:])
    members = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members.setdefault(x[:d], []).append(c)
    kids, leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}, {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if built[c] == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def nodes(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), 100, 101, 105, 150, 205, 206, 299, 1000, 1007]:
        for t in range(rng.choice([1, 2, 3, 7, 8, 13])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "näh 𝄞", "", None])))
    rows += [(3, 0, "user", "tie"), (3, 0, "user", "other"), (3, None, "user", "null turn"), (3, None, None, None), (None, 1, "user", "lost")]
    rows += [(7, 2, "user", "again")] * 5
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = conversations(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"conv": F.lit("x"), "rep": F.lit(1), "n": F.lit(2), "digest": F.lit("d")})
        assert nodes(trie.prefix_trie(df)) == brute(rows)


def test_one_long_conversation_over_many_ranges(spark, monkeypatch):
    """Blocks of four turns and ranges of a few rows, so that nothing long is ever in one place."""
    monkeypatch.setattr(trie, "BLOCK_BITS", 2)
    rng = random.Random(7)
    long = [(200, t, "user", rng.choice("ab")) for t in range(40)]
    rows = [*long, *[(201, t, r, x) for _, t, r, x in long[:37]], *[(203, t, r, x) for _, t, r, x in long], *[(c, 0, "user", "ab"[c % 2]) for c in range(204, 230)]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        assert nodes(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges_and_tables_left(spark):
    folder = common.shared_folder(spark)
    before = set(os.listdir(folder))
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(-7, 1, "user", "x"), (-7, 2, "user", "long " * 50_000), (5, None, None, None), (2**62, 1, "user", "x")]
    got = nodes(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert [r for r in got if r[1] == 0][0][:4] == (-7, 0, -1, 3)
    assert len(set(os.listdir(folder)) - before) <= 2  # the two results
