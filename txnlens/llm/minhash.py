"""MinHash near-duplicates with bottom-k sketches from one hash function.

A document's set is its distinct shingles of ``words`` words; the sketch is the ``K`` smallest of their hashes (the whole
set where it has no more). Documents with equal sets form one class, known by a 128-bit digest of the set; everything after
runs on one representative a class.

Inverted lists: of each sketch the rarest values are retained, enough that two sets over the threshold share one. For
sets that the sketch holds whole this is the exact prefix rule (n - ceil(t n) + 1 values); beyond, two sketches share at
least K t - 6 sd of their values but for a chance of about 1e-8 a pair at the threshold, and less above it. Rarity comes
from counts in ``COUNTERS`` hash buckets, a fixed size, over all sketches, on a log scale; any order is correct, rare
first is fast.

Overlaps come from the lists without a list's pairs: every member is paired with the list's first member, then, where
components still differ, with its last; only lists that are then still split are joined with themselves, across components,
in blocks of about ``BLOCK`` members, block against block, so that no group of the join grows with a list.
Candidate pairs pass a size filter and a bound on the sets' difference: each set has ``PARITIES`` parities, of its shingles
in as many classes, and two sets differ in at least as many shingles as parities, so that no pair is lost by it. Then come
the estimate from the union sketch and exact Jaccard on the full word shingles.

Defined cases: a text with fewer words than a shingle has its whole word sequence as one shingle; a null or empty text has
none, is linked with nothing and is its own component. Repeated rows and equal texts are one component. A null id is
ignored as a component's smallest id, unless all are null. An empty table gives no rows. Extra columns are ignored by
``near_duplicates``, kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_counts, forget, materialize, parts, scratch
from .components import components
from .quality import Words

#: Hashes that a sketch keeps.
K = 64
#: Hash buckets of the rarity counts.
COUNTERS = 1 << 22
#: Bits that bound how far two sets differ.
PARITIES = 1024
#: Members of a list's block.
BLOCK = 2048
#: Ids that are broadcast at most (4 MB).
BROADCAST_IDS = 500_000
_BITS = [f"p{k}" for k in range(PARITIES // 64)]
_SIGN = np.uint64(1 << 63)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingle_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text with these word hashes."""
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out * _M2 + h[k : k + n])
    return np.unique(out)


def share_at_least(threshold: int, k: int = K) -> int:
    """Values that two full sketches over the threshold share, but for six standard deviations."""
    t = threshold / 100
    return max(1, math.floor(k * t - 6 * math.sqrt(k * t * (1 - t))))


def prefix_length(n: np.ndarray, threshold: int, k: int = K) -> np.ndarray:
    """Retained values for sets of n shingles."""
    exact = n - (threshold * n + 99) // 100 + 1
    return np.where(100 * n < threshold * (k + 1), exact, np.minimum(n, k) - share_at_least(threshold, k) + 1)


def parities(s: np.ndarray) -> np.ndarray:
    """For each class of hashes by their low bits, whether their number is odd, as PARITIES / 64 numbers."""
    odd = np.bincount((s & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _alike(a: str, b: str, threshold: int) -> Column:
    """Sizes and parities of two rows allow a Jaccard similarity of ``threshold``; columns carry the suffixes ``a`` and ``b``."""
    n, m = F.col("n" + a), F.col("n" + b)
    apart = functools.reduce(operator.add, [F.bit_count(F.col(p + a).bitwiseXOR(F.col(p + b))) for p in _BITS])
    return (100 * F.least(n, m) >= threshold * F.greatest(n, m)) & ((100 + threshold) * apart <= (100 - threshold) * (n + m))


def _sketched(words: int, text_at: int):
    def run(batches):
        known = Words()
        for batch in parts(batches, text_at):
            known.trim()
            rows, bits = [], np.zeros((batch.num_rows, len(_BITS)), np.int64)
            for k, text in enumerate(batch.column(text_at).to_pylist()):
                ws = (text or "").encode().lower().split()
                h = np.array([known.hashes[known[w]] for w in ws], np.uint64)
                s = shingle_hashes(h, words)
                bits[k] = parities(s)
                if len(s):
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    rows.append((len(s), int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), (s[:K] ^ _SIGN).view(np.int64)))
                else:
                    rows.append((0, None, None, None))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], *[pa.array(c) for c in bits.T], *batch.columns[2:]], names=["uid", "id", "n", "h1", "h2", "sketch", *_BITS, *batch.schema.names[2:]])

    return run


def _retained(levels: np.ndarray, threshold: int):
    def run(batches):
        for batch in batches:
            out = []
            n = batch.column("n").to_numpy()
            for values, size in zip(batch.column("sketch").to_pylist(), prefix_length(n, threshold).tolist(), strict=True):
                v = np.array(values, np.int64)
                out.append(v[np.lexsort((v, levels[v & (COUNTERS - 1)]))[:size]])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("n"), pa.array(out, pa.list_(pa.int64()))], names=["uid", "n", "keys"])

    return run


def _shingles(text: str, words: int) -> set:
    ws = text.encode().lower().split()
    return set(zip(*[ws[k:] for k in range(words)], strict=False)) if len(ws) >= words else {tuple(ws)}


def _exact(words: int, threshold: int):
    def run(batches):
        last: tuple = (None, set())
        for batch in parts(batches, (2, 3)):
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last[0] != ta:
                    last = (ta, _shingles(ta, words))
                b = _shingles(tb, words)
                both = len(last[1] & b)
                keep.append(100 * both >= threshold * (len(last[1]) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """The (a, b) pairs of representatives over the threshold: sizes and parities, then the union sketch, then the full sets."""
    side = lambda x, *cols: reps.select(F.col("uid").alias(x), *[F.col(c).alias(c + x) for c in cols])
    alike = materialize(pairs.join(side("a", "n", *_BITS), "a").join(side("b", "n", *_BITS), "b").filter(_alike("a", "b", threshold)).select("a", "b", "na", "nb"))
    sketches = alike.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b")
    union = F.slice(F.array_sort(F.array_union("sketcha", "sketchb")), 1, K)
    whole = F.greatest("na", "nb") <= K
    shared = F.size(F.array_intersect("sketcha", "sketchb"))
    passes = F.when(whole, 100 * shared >= threshold * (F.col("na") + F.col("nb") - shared)).otherwise(F.size(F.array_intersect(union, F.array_intersect("sketcha", "sketchb"))) >= share_at_least(threshold))
    likely = materialize(sketches.filter(passes).select("a", "b"))
    wanted = materialize(likely.select(F.col("a").alias("uid")).union(likely.select("b")).distinct())
    # up to a stated number, ids are sent to the texts; beyond, both are shuffled
    found = materialize(texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "uid"))
    with_a = likely.join(found.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(found.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    out = materialize(with_b.mapInArrow(_exact(words, threshold), "a long, b long"))
    forget(alike, likely, wanted, found)
    return out


def _block_against_block(members: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of a join of lists with themselves, on (key, low, high): each two members of a list meet once, those of one block twice.

    The left side holds the block ``low`` of a pair of blocks, the right one ``high``; of a list of one block, the block itself.
    """
    count = F.ceil(F.col("size") / block)
    numbered = members.withColumn("own", F.pmod(F.xxhash64("uid"), count)).withColumn("count", count)
    left = numbered.withColumns({"low": F.col("own"), "high": F.explode(F.sequence("own", F.col("count") - 1))})
    right = numbered.withColumns({"low": F.explode(F.sequence(F.lit(0).cast("long"), "own")), "high": F.col("own")})
    return left.drop("own", "count"), right.drop("own", "count")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, id, n, h1, h2, row: all columns) and classes (h1, h2, component, root: the component's number)."""
    with scratch() as keep:
        rows, out = _classes(df, id_col, text_col, words, threshold)
        keep(rows)
        keep(out)
    return rows.drop("sketch", *_BITS), out


def _classes(df: DataFrame, id_col: str, text_col: str, words: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    src = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), row.alias("row"))
    kind = df.schema[id_col].dataType.simpleString()
    fields = src.schema["row"].dataType.simpleString()
    bits = ", ".join(f"{p} long" for p in _BITS)
    rows = materialize(src.mapInArrow(_sketched(words, 2), f"uid long, id {kind}, n long, h1 long, h2 long, sketch array<long>, {bits}, text string, row {fields}").drop("text"))
    texts = rows.select("uid", F.col("row").getField(text_col).alias("text"))

    groups = materialize(rows.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.min("uid").alias("uid")))
    reps = materialize(rows.select("uid", "n", "sketch", *_BITS).join(groups.select("uid"), "uid"))

    counts = bucket_counts(reps.select("sketch"), lambda batch: batch.column(0).flatten().to_numpy(), COUNTERS)
    levels = np.ceil(8 * np.log2(counts + 1)).astype(np.uint8)
    keys = materialize(reps.select("uid", "n", "sketch").mapInArrow(_retained(levels, threshold), "uid long, n long, keys array<long>").select(F.explode("keys").alias("key"), "uid", "n"))
    lists = materialize(keys.groupBy("key").agg(F.min("uid").alias("lead"), F.max("uid").alias("last"), F.min_by("n", "uid").alias("lead_n"), F.max_by("n", "uid").alias("last_n"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = materialize(keys.join(lists, "key"))
    forget(keys, lists)

    def fits(other: str) -> Column:
        return 100 * F.least("n", other) >= threshold * F.greatest("n", other)

    links = _confirmed(members.filter((F.col("uid") != F.col("lead")) & fits("lead_n")).select(F.col("lead").alias("a"), F.col("uid").alias("b")).distinct(), reps, texts, words, threshold)
    found = components(links)
    # lists of two are done; of the others, those whose members are not of one component go on
    for last_round in (False, True):
        nodes = found.withColumnRenamed("node", "uid")
        of = materialize(members.filter(f"size > {3 if last_round else 2}").join(nodes, "uid", "left").withColumn("root", F.coalesce("root", "uid")))
        split = materialize(of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key"))
        if split.isEmpty():
            forget(of, split)
            break
        still = of.join(split, "key")
        if last_round:
            still = still.select("key", "uid", "root", "size").join(reps.select("uid", "n", *_BITS), "uid")
            sides = zip(_block_against_block(still, BLOCK), "ab", strict=True)
            x, y = (side.select("key", "low", "high", *[F.col(c).alias(c + k) for c in ("uid", "root", "n", *_BITS)]) for side, k in sides)
            across = ((F.col("low") < F.col("high")) | (F.col("uida") < F.col("uidb"))) & (F.col("roota") != F.col("rootb"))
            met = x.join(y, ["key", "low", "high"]).filter(across & _alike("a", "b", threshold))
            pairs = met.select(F.least("uida", "uidb").alias("a"), F.greatest("uida", "uidb").alias("b"))
        else:
            lasts = still.filter("uid = last").select("key", F.col("root").alias("last_root"))
            pairs = still.join(lasts, "key").filter((F.col("root") != F.col("last_root")) & fits("last_n")).select(F.col("last").alias("a"), F.col("uid").alias("b"))
        more = _confirmed(pairs.distinct(), reps, texts, words, threshold)
        forget(of, split)
        if not more.isEmpty():
            links = links.union(more)
            found = components(links)
    rooted = groups.join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    rooted = materialize(rooted.select("h1", "h2", "first_id", "root"))
    smallest = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component")))
    out = materialize(rooted.join(smallest, "root").select("h1", "h2", "component", "root"))
    forget(groups, reps, members, rooted, smallest)
    return rows, out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; documents are linked at a Jaccard similarity of ``threshold`` percent."""
    rows, own = classes(df.select(id_col, text_col), id_col, text_col, words, threshold)
    joined = rows.select("id", "n", "h1", "h2").join(own.select("h1", "h2", "component"), ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80) -> DataFrame:
    """The rows, all columns, with one row of each component: that of the smallest id. Rows without a shingle stay."""
    rows, own = classes(df, id_col, text_col, words, threshold)
    joined = rows.filter("n > 0").select("uid", "id", "h1", "h2").join(own.select("h1", "h2", "root"), ["h1", "h2"])
    first = joined.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("x")).select("root", F.col("x.uid").alias("first"))
    gone = materialize(joined.join(first, "root").filter("uid != first").select("uid"))
    # up to a stated number, ids are sent to the rows; beyond, both are shuffled
    return rows.select("uid", "row").join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "uid", "left_anti").select("row.*")
