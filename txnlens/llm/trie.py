"""Conversation prefix trie by prefix-doubling naming: turn blocks get dense names, prefixes the names of their blocks, nodes their members.

A turn is its SHA-256 digest of role and text. Blocks of 2^k turns that begin at a multiple of 2^k are named in rounds: a
block's name is the dense number of the pair of names of its halves, so blocks are equal where their names are. A prefix
of d turns is put together from blocks by the binary digits of d, the largest first: in the round of 2^k, prefixes whose
length is an odd multiple of 2^k are the pair of a prefix named before and one block. Members that agree in length and pair
are one node, and its smallest member is the prefix's name. So a longest conversation of n turns takes 2 log2 n rounds, and
all rounds together handle about three rows a turn. Nothing is ever gathered by node or by conversation: counts are
aggregates, which are summed in tasks before they are shuffled, a name reaches its rows by a plain join, which adaptive
execution splits where a prefix is very frequent, and each round's tables replace the last one's in the shared folder.

Sums over subtrees need no walk: a node counts at its smallest member, whose other prefixes are the node's ancestors. What a
conversation's nodes weigh from some depth on is a running sum within 4,096 turns, and blocks' totals give what comes later.

Defined cases: a null role or text is empty; null turns come first; equal turns of a conversation go by the digest of role
and text, so the order of rows never matters; repeated rows are turns of their own. Rows without a conv_id belong to no
conversation. Remainders of negative ids are negative, as in SQL. Turns and texts may be of any number and length. An empty
table has no nodes, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, own_query, utf8

#: Turns of a conversation that one task orders, as a power of two, and ids of one message of a node's ends.
BLOCK_BITS = 12
_EMPTY = hashlib.sha256().hexdigest()


def positions(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, i, digest, chars): every turn with its place in its conversation, from 0; a table in the shared folder.

    Equal rows are counted, the rest is dealt by ranges of conversation and turn, so that a conversation with very many
    turns takes many tasks; the turns that lie in earlier ranges are added to a turn's place within its own.
    """
    role, text = utf8(F.col(f"`{role_col}`").cast("string")), utf8(F.col(f"`{text_col}`").cast("string"))
    turn = F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256).alias("digest")
    src = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), turn, F.length(text).cast("long").alias("chars")).filter("conv is not null")
    counted = src.groupBy("conv", "turn", "digest", "chars").agg(F.count(F.lit(1)).alias("n"))
    dealt = materialize(counted.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "digest").withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part", "conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = dealt.groupBy("conv", "part").agg(F.sum("n").alias("n")).select("conv", "part", F.sum("n").over(earlier).alias("before")).filter("before is not null")
    # one conversation at most goes on from a range to the next: as many rows as ranges
    placed = dealt.withColumn("i", F.sum("n").over(within) - F.col("n")).join(F.broadcast(before), ["conv", "part"], "left")
    first = F.col("i") + F.coalesce("before", F.lit(0))
    out = materialize(placed.select("conv", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("i"), "digest", "chars"))
    forget(dealt)
    return out


def named(df: DataFrame, keys: list[str], name: str = "name") -> tuple[DataFrame, DataFrame]:
    """``keys`` of ``df`` with dense numbers from 0, and the table of the shared folder that this reads.

    Distinct keys are numbered within the tasks that write them; the driver sees one count a task.
    """
    table = materialize(df.select(*keys).distinct().withColumn("_id", F.monotonically_increasing_id()))
    task, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    with own_query(df.sparkSession):
        counts = sorted(tuple(r) for r in table.groupBy(task.alias("t")).count().collect())
    offsets, total = [], 0
    for t, n in counts:
        offsets.append((t, total))
        total += n
    at = df.sparkSession.createDataFrame(offsets, "_task long, _from long")
    return table.join(F.broadcast(at), task == F.col("_task")).select(*keys, (F.col("_from") + row).alias(name)), table


def block_names(turns: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: (conv, j, name) of the blocks of 2^k turns at j 2^k, of (conv, i, digest); the last has blocks at 0 only."""
    names, table = named(turns, ["digest"])
    levels = [materialize(turns.join(names, "digest").select("conv", F.col("i").alias("j"), "name"))]
    forget(table)
    while levels[-1].filter("j > 0").head(1):
        half = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("name")))
        pairs = materialize(levels[-1].groupBy("conv", F.shiftright("j", 1).alias("j")).agg(half(0).alias("a"), half(1).alias("b")).filter("b is not null"))
        names, table = named(pairs, ["a", "b"])
        levels.append(materialize(pairs.join(names, ["a", "b"]).select("conv", "j", "name")))
        forget(pairs, table)
    return levels


def prefix_names(levels: list[DataFrame]) -> list[DataFrame]:
    """Tables of (conv, d, rep): the smallest conversation that begins with the first d turns of ``conv``, of all d from 1; ``levels`` are deleted."""
    done: list[DataFrame] = []
    for k in range(len(levels) - 1, -1, -1):
        blocks = levels[k].filter("j % 2 = 0").select("conv", F.shiftleft("j", k).alias("x"), F.col("name").alias("b"))
        pairs = blocks.filter("x = 0").select("conv", "x", F.lit(None).cast("long").alias("p"), "b")
        if done:
            so_far = done[0]
            for t in done[1:]:
                so_far = so_far.unionByName(t)
            longer = blocks.filter("x > 0").join(so_far.select("conv", F.col("d").alias("x"), F.col("rep").alias("p")), ["conv", "x"])
            pairs = pairs.unionByName(longer.select("conv", "x", "p", "b"))
        pairs = materialize(pairs.select("conv", (F.col("x") + (1 << k)).alias("d"), F.coalesce("p", F.lit(0)).alias("p"), "b"))
        groups = pairs.groupBy("d", "p", "b").agg(F.min("conv").alias("rep"))
        done.append(materialize(pairs.join(groups, ["d", "p", "b"]).select("conv", "d", "rep")))
        forget(pairs, levels[k])
    return done


def rebuilt(turns: DataFrame, heads: int = 6, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """The conversations that share heads: (conv, i, digest, chars) of their turns, and (conv, size) of each, turnless ones too.

    Conversation c begins with the first h turns of conversation c - c % ``group``, all if fewer and none if absent, and goes
    on with its own turns after its first h; h is the CRC of c's decimal digits modulo ``heads``.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    base = F.col("conv") - F.col("conv") % group
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    of = own.select("conv", "n", h.alias("h"), base.alias("base")).join(own.filter(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("n").alias("m")), "base", "left")
    of = of.select("conv", "n", "h", "base", F.least("h", F.coalesce("m", F.lit(0))).alias("taken"))
    sizes = of.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    rest = turns.filter(F.col("i") >= h).join(of.select("conv", "h", "taken"), "conv").select("conv", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "digest", "chars")
    first = turns.filter((F.col("conv") % group == 0) & (F.col("i") < heads - 1)).select(F.col("conv").alias("base"), "i", "digest", "chars")
    head = of.filter("taken > 0").select("conv", "base", "taken").join(first, "base").filter("i < taken").select("conv", "i", "digest", "chars")
    return rest.unionByName(head), sizes


def _hash_ends(ends: DataFrame) -> DataFrame:
    """(rep, d, ends_sha256) of (rep, d, conv): the digest of each node's ids in order, comma-joined.

    Ids travel in messages of 4,096 at most; a node's digest takes in one message after another, whatever their number.
    """
    each = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    messages = ends.groupBy("rep", "d", F.shiftright("conv", BLOCK_BITS).alias("part")).agg(each.alias("ids"))

    def run(batches):
        at, digest = None, hashlib.sha256()
        for batch in batches:
            reps, ds, shas = [], [], []
            for rep, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (rep, d) != at:
                    if at:
                        reps.append(at[0])
                        ds.append(at[1])
                        shas.append(digest.hexdigest())
                    at, digest = (rep, d), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield _ends(reps, ds, shas)
        if at:
            yield _ends([at[0]], [at[1]], [digest.hexdigest()])

    ordered = messages.repartition("rep", "d").sortWithinPartitions("rep", "d", "part").select("rep", "d", "ids")
    return ordered.mapInArrow(run, "rep long, d long, ends_sha256 string")


def _ends(reps: list, ds: list, shas: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(ds, pa.int64()), pa.array(shas, pa.string())], names=["rep", "d", "ends_sha256"])


def _later(weights: DataFrame) -> DataFrame:
    """(conv, d, rep, leaf, s) of (conv, d, rep, leaf, w): the sum of w from depth d on."""
    block = F.shiftright("d", BLOCK_BITS)
    down = Window.partitionBy("conv", "block").orderBy(F.col("d").desc())
    after = Window.partitionBy("conv").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    rows = weights.withColumn("block", block)
    later = rows.filter("w > 0").groupBy("conv", "block").agg(F.sum("w").alias("w"))
    blocks = rows.filter(F.col("d") % (1 << BLOCK_BITS) == 0).select("conv", "block", F.lit(0).cast("long").alias("w")).unionByName(later).groupBy("conv", "block").agg(F.sum("w").alias("w"))
    later = blocks.select("conv", "block", F.sum("w").over(after).alias("later")).filter("later > 0")
    return rows.withColumn("s", F.sum("w").over(down)).join(later, ["conv", "block"], "left").select("conv", "d", "rep", "leaf", (F.col("s") + F.coalesce("later", F.lit(0))).alias("s"))


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the conversations' prefixes, of (conv, i, digest, chars) and (conv, size), a row each."""
    turns, sizes = materialize(turns), materialize(sizes)
    with own_query(turns.sparkSession):
        root = sizes.agg(F.min("conv")).first()[0]
    done = prefix_names(block_names(turns))
    members = sizes.select("conv", F.lit(0).cast("long").alias("d"), F.lit(root).cast("long").alias("rep"))
    for t in done:
        members = members.unionByName(t)
    nodes = members.groupBy("rep", "d").agg(F.count(F.lit(1)).alias("n"))
    last = turns.select(F.col("conv").alias("rep"), (F.col("i") + 1).alias("d"), "chars")
    above = members.select(F.col("conv").alias("rep"), (F.col("d") + 1).alias("d"), F.col("rep").alias("parent"))
    nodes = nodes.join(last, ["rep", "d"], "left").join(above, ["rep", "d"], "left")
    nodes = materialize(nodes.select("rep", "d", "n", "parent", ((F.col("n") - 1) * F.coalesce("chars", F.lit(0))).alias("w")))
    children = nodes.filter("d > 0").groupBy(F.col("parent").alias("rep"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("children"))
    nodes_c = materialize(nodes.join(children, ["rep", "d"], "left").select("rep", "d", "n", "parent", "w", F.coalesce("children", F.lit(0)).alias("children")))
    leaves = nodes_c.filter("children = 0").select(F.col("rep").alias("conv"), F.lit(1).cast("long").alias("leaf"))
    weights = nodes_c.filter("w > 0").select(F.col("rep").alias("conv"), "d", "w")
    rows = members.join(weights, ["conv", "d"], "left").join(leaves, "conv", "left")
    rows = rows.select("conv", "d", "rep", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("w", F.lit(0)).alias("w"))
    sums = _later(rows).groupBy("rep", "d").agg(F.sum("leaf").alias("leaves"), F.sum("s").alias("saved"))
    ends = _hash_ends(members.join(sizes.select("conv", F.col("size").alias("d")), ["conv", "d"]).select("rep", "d", "conv"))
    out = nodes_c.join(sums, ["rep", "d"]).join(ends, ["rep", "d"], "left").select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
    out = materialize(out)
    forget(turns, sizes, nodes, nodes_c, *done)
    return out


def prefix_trie(df: DataFrame, heads: int = 6, group: int = 100, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the rebuilt conversations' trie."""
    turns = positions(df, conv_col, turn_col, role_col, text_col)
    out = trie(*rebuilt(turns, heads, group))
    forget(turns)
    return out


#: The same in plain SQL: every prefix as a list of digests. The CRC is spelled out, bit by bit.
ORACLE_SQL = r"""
WITH t AS (SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS n, turn FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, list(x ORDER BY turn NULLS FIRST, x) AS x, list(n ORDER BY turn NULLS FIRST, x) AS n FROM t GROUP BY c),
crc AS (SELECT c, x, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda u, v: xor(u >> 1, 3988292384 * (u & 1))))) % 6 AS h FROM conv),
built AS (SELECT a.c, coalesce(b.x[1:a.h], []) || a.x[a.h + 1 :] AS x, coalesce(b.n[1:a.h], []) || a.n[a.h + 1 :] AS n FROM crc a LEFT JOIN conv b ON b.c = a.c - a.c % 100),
pre AS (SELECT c, x[1:d] AS p, d, len(x) AS size, CASE WHEN d = 0 THEN 0 ELSE n[d] END AS chars FROM (SELECT c, x, n, unnest(range(0, len(x) + 1)) AS d FROM built)),
node AS (SELECT d, p, min(c) AS c, count(*) AS n, max(chars) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = d), '') AS ends FROM pre GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1 : d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids ON kids.d = node.d AND kids.p = node.p),
up AS (SELECT unnest(range(0, d + 1)) AS e, p, k, (n - 1) * chars AS w FROM full_node),
sums AS (SELECT e AS d, p[1:e] AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum(w) AS saved FROM up GROUP BY ALL)
SELECT a.c::BIGINT AS conv_id, a.d::BIGINT AS depth, b.c::BIGINT AS parent_conv_id, a.n::BIGINT AS n_convs, a.k::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM full_node a JOIN sums ON sums.d = a.d AND sums.p = a.p LEFT JOIN node b ON b.d = a.d - 1 AND b.p = a.p[1 : a.d - 1]
"""
