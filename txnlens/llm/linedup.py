"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line's set is its distinct words, A-Z lower-cased. Lines with equal sets form one class, which its first line stands
for. A class's words are ordered by rarity, the count of a word's hash bucket over all words of all documents on a log
scale; the rarest n - ceil(t n) + k are its prefix, and two sets over the threshold share k = ``SHARED`` words of their
prefixes, which for the smaller set are among its first n - ceil(2t / (1 + t) n) + k. A word whose bucket was counted once
stands in no other line and is no key. Keys meet under the length and positional filters and a bound on the sets'
difference: each set has 64 parities, of its words in 64 classes, and two sets differ in at least as many words as
parities. Pairs that meet k times are verified by exact Jaccard on the lines' word hashes (64 bits). A line goes if any earlier line is similar enough, kept or not; the order is that of the
documents' ids, then of the lines.

Bucket counts bound the lists of keys. Before lists are joined with themselves, the keys whose lists can be longer than
``SHORT_LIST`` classes meet the list's first line only, which finds the bulk of any large group of copies in linear work;
lines found so need no other earlier one and meet only later lines in the full join.

Defined cases: lines without a word stay, as do null and empty texts. Repeated rows: the later row loses the lines that
the earlier has. Rows with a null id come last. Where ids are no integers, repeated, null, negative or too large to be
followed by a line's number in 62 bits, the rows are numbered by a global sort first; rows of one id are ordered by a hash
of all their columns. An empty table gives no rows. Extra columns are kept; ``n_lines`` and ``n_removed`` replace columns
of those names. A text and a line may be of any length.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, own_query

#: Hash buckets of the word counts (as a power of two).
BUCKET_BITS = 22
#: Words that a pair must share in its prefixes.
SHARED = 2
#: Classes beyond which a list's first line is tried before the list is joined with itself.
SHORT_LIST = 128
#: Numbers that are broadcast at most (4 MB); beyond, both sides of a join are shuffled.
BROADCAST_ROWS = 500_000
_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
_HASH_BITS = 59


def split_words(line: Column, lines: bool = False) -> Column:
    """The words of a line, or of a text of ``lines``, A-Z lower-cased, with empty ones where white space is doubled or at the ends.

    Words stand for themselves only up to a one-to-one code: the bytes of lines beyond ASCII are read as Latin-1, as which
    lower-casing is fast. It adds 32 to some first bytes of UTF-8 letters, which stay apart by how many others follow.
    """
    bytewise = F.decode(line.cast("binary"), "ISO-8859-1")
    folded = F.lower(F.when(F.octet_length(line) == F.length(line), line).otherwise(bytewise))
    other_space = functools.reduce(operator.or_, [line.contains(c) for c in _SPACE[1:] if c != "\n"])  # a line has no line feed
    folded = F.replace(folded, F.lit("\n"), F.lit(" ")) if lines else folded
    return F.when(other_space, F.split(folded, _SPACES)).otherwise(F.split(folded, " "))  # one character is split without a pattern


def word_hashes(line: Column) -> Column:
    """Hashes of the distinct words of a line."""
    return F.array_remove(F.array_distinct(F.transform(split_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _numbered(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``df`` as (doc: a number that follows the order of ids, row: all columns), and how many bits a line's number takes."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    key = F.col(f"`{id_col}`")
    whole = isinstance(df.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    size = F.max(F.octet_length(f"`{text_col}`"))
    with own_query(df.sparkSession):
        longest, low, high, none = df.agg(size, *([F.min(key), F.max(key)] if whole else [F.lit(-1), F.lit(0)]), F.count_if(key.isNull())).first()
        bits = (longest or 0).bit_length() + 1  # a text has no more line feeds than bytes
        if whole and not none and (low is None or low >= 0 and high < 1 << (62 - bits)) and df.groupBy(key).count().filter("count > 1").isEmpty():
            return df.select(key.cast("long").alias("doc"), row), bits
    n = F.monotonically_increasing_id()  # the partition's number, then 33 bits that count its rows
    ordered = materialize(df.select(key.alias("k"), row).orderBy(F.col("k").asc_nulls_last(), F.xxhash64("row")).select(n.alias("n"), "row"))
    part = F.shiftright("n", 33)
    before, offsets = 0, []
    for p, rows in sorted(ordered.groupBy(part.alias("part")).count().collect()):  # a number a partition
        offsets.append((p, before))
        before += rows
    starts = df.sparkSession.createDataFrame(offsets, "part long, start long")
    joined = ordered.withColumn("part", part).join(F.broadcast(starts), "part")
    return joined.select((F.col("start") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))).alias("doc"), "row"), bits


def _levels(docs: DataFrame) -> DataFrame:
    """One row, ``levels``: the buckets' counts on a log scale of 16 steps, 0 for a count of one, 16 in each number of the array."""
    count = F.col("count")
    fine = F.ceil(F.log2(count))
    level = F.least(F.lit(15), F.when(fine <= 7, fine).otherwise(7 + F.ceil((F.log2(count) - 7) / 2.5))).cast("long")
    words = docs.select(F.explode(split_words(F.col("text"), lines=True)).alias("w")).filter("w != ''")
    counts = words.groupBy(F.shiftrightunsigned(F.xxhash64("w"), 64 - BUCKET_BITS).alias("b")).count()
    slot = F.call_function("shiftleft", level, (F.col("b").bitwiseAND(F.lit(15)) * 4).cast("int"))
    found = counts.select(F.shiftright("b", 4).alias("b"), slot.alias("v")).groupBy("b").agg(F.bit_or("v").alias("v"))
    every = docs.sparkSession.range(1 << (BUCKET_BITS - 4)).withColumnRenamed("id", "b").join(found, "b", "left").select("b", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    # in two steps, so that the last task has a row for 512 numbers
    ordered = lambda by: F.array_sort(F.collect_list(F.struct(by, "v")))
    some = every.groupBy(F.shiftright("b", 9).alias("c")).agg(F.transform(ordered("b"), lambda x: x["v"]).alias("v"))
    return materialize(some.agg(F.flatten(F.transform(ordered("c"), lambda x: x["v"])).alias("levels")))


def _fits(a: str, b: str, threshold: int) -> Column:
    """Sizes are alike, enough words are left at these places if fewer than ``SHARED`` earlier ones are shared, and the parities allow it."""
    n, i = ([F.col(f"{x}.{c}") for x in (a, b)] for c in ("n", "i"))
    apart = F.bit_count(F.col(f"{a}.parity").bitwiseXOR(F.col(f"{b}.parity")))
    sizes = 100 * F.least(*n) >= threshold * F.greatest(*n)
    return sizes & ((100 + threshold) * (F.least(n[0] - i[0], n[1] - i[1]) + SHARED - 1) >= threshold * (n[0] + n[1])) & ((100 + threshold) * apart <= (100 - threshold) * (n[0] + n[1]))


def removed_lines(docs: DataFrame, bits: int, threshold: int = 80) -> DataFrame:
    """(doc, line_no) of every line of the (doc, text) rows that has a similar earlier one."""
    pos = F.shiftleft("doc", bits) + F.col("line_no")
    texts = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(pos.alias("pos"), "line")
    levels = _levels(docs)
    mask = F.lit((1 << _HASH_BITS) - 1)

    def packed(h: Column) -> Column:
        """Level, then hash; a bucket's number is the upper bits of the hash. Never null, so that arrays are sorted as plain numbers."""
        some = F.get(F.col("levels"), F.shiftrightunsigned(h, 68 - BUCKET_BITS).cast("int"))
        at = F.shiftrightunsigned(h, 62 - BUCKET_BITS).bitwiseAND(F.lit(60)).cast("int")
        return F.coalesce(F.shiftleft(F.call_function("shiftrightunsigned", some, at).bitwiseAND(F.lit(15)), _HASH_BITS).bitwiseOR(h.bitwiseAND(mask)), h)

    n, i = F.col("n"), F.col("i")
    ceil = lambda a, b: F.floor((a + (b - 1)) / b).cast("int")
    # a scalar subquery, so that the numbers stand in no plan and reach the driver once, not as text with each of its events
    known = texts.withColumn("levels", levels.scalar())
    lines = known.select("pos", F.sort_array(F.transform(word_hashes(F.col("line")), packed)).alias("t")).select("pos", F.size("t").alias("n"), "t")
    keys = F.when(100 * n >= threshold * (n + 1), F.slice("t", 1, F.least(n, n - ceil(threshold * n, 100) + SHARED)))  # fewer words match equal sets only
    parity = F.aggregate("t", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))
    table = materialize(lines.select("pos", "n", F.xxhash64("t").alias("s1"), F.hash("t", F.lit(7)).alias("s2"), parity.alias("parity"), keys.alias("keys")))
    lines = table.filter("n > 0")

    same = ["s1", "s2", "n"]
    firsts = materialize(lines.groupBy(*same).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    copies = materialize(lines.select("pos", *same).join(firsts, same).filter("pos != first").select("pos"))
    classes = lines.join(firsts, same, "left").filter("(first is null or pos = first) and keys is not null")
    level = F.shiftright("key", _HASH_BITS)
    at = F.shiftleft(n.cast("long"), 32).bitwiseOR(i.cast("long"))
    posts = materialize(classes.select("pos", "n", "parity", F.posexplode("keys").alias("i", "key")).filter(level > 0).select("key", "pos", "parity", at.alias("at")))
    forget(levels, table, firsts)

    def verified(pairs: DataFrame) -> DataFrame:
        """(pos): the later lines of the (a, b) pairs that are similar."""
        pairs = materialize(pairs)
        wanted = materialize(pairs.select(F.col("a").alias("pos")).union(pairs.select("b")).distinct())
        found = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "pos")
        words = materialize(found.select("pos", word_hashes(F.col("line")).alias("w")))
        side = lambda x: words.select(F.col("pos").alias(x), F.col("w").alias("w" + x))
        both = F.size(F.array_intersect("wa", "wb"))  # named once: a filter computes twice what it names twice
        similar = (100 + threshold) * both >= threshold * (F.size("wa") + F.size("wb"))
        out = materialize(pairs.join(side("a"), "a").join(side("b"), "b").filter(similar).select(F.col("b").alias("pos")).distinct())
        forget(pairs, wanted, words)
        return out

    def unpacked(table: DataFrame, *more: str) -> DataFrame:
        return table.select("key", "pos", "parity", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("i"), *more)

    long_lists = posts.filter(level > SHORT_LIST.bit_length() - 1)
    leads = long_lists.groupBy("key").agg(F.min("pos").alias("pos"), F.min_by("parity", "pos").alias("parity"), F.min_by("at", "pos").alias("at"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    first = unpacked(long_lists).alias("b").join(unpacked(leads).alias("a"), (F.col("a.key") == F.col("b.key")) & (F.col("a.pos") < F.col("b.pos")) & _fits("a", "b", threshold))
    gone = verified(first.select(F.col("a.pos").alias("a"), F.col("b.pos").alias("b")).distinct())

    closed = gone.withColumn("closed", F.lit(True))
    marked = posts.join(F.broadcast(closed) if gone.count() <= BROADCAST_ROWS else closed, "pos", "left")
    marked = unpacked(marked, F.col("closed").isNull().alias("open"))
    x, y = marked.alias("x"), marked.alias("y")  # the smaller set of a pair (of equal ones the earlier), the larger
    prefix = F.col("x.i") < F.col("x.n") - ceil(2 * threshold * F.col("x.n"), 100 + threshold) + SHARED
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.pos") < F.col("y.pos")))
    later = F.when(F.col("x.pos") < F.col("y.pos"), F.col("y.open")).otherwise(F.col("x.open"))
    # one CASE, so that both sides stay the same and are shuffled once
    every = x.join(y, (F.col("x.key") == F.col("y.key")) & F.when(~(smaller & prefix), False).when(~later, False).otherwise(_fits("x", "y", threshold)))
    met = every.groupBy(F.least("x.pos", "y.pos").alias("a"), F.greatest("x.pos", "y.pos").alias("b")).count()
    more = verified(met.filter(F.col("count") >= SHARED).select("a", "b"))
    out = materialize(copies.union(gone).union(more).select(F.shiftright("pos", bits).alias("doc"), F.col("pos").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("line_no")))
    forget(posts, copies, gone, more)
    return out


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80) -> DataFrame:
    """``df`` with each text less its repeated lines, and ``n_lines`` and ``n_removed`` of it."""
    numbered, bits = _numbered(df, id_col, text_col)
    text = F.col("row").getField(text_col)
    removed = removed_lines(numbered.select("doc", text.alias("text")).filter("text is not null"), bits, threshold)
    gone = removed.groupBy("doc").agg(F.collect_list("line_no").alias("gone"))
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.get(F.transform(F.array(lines), lambda every: F.array_join(F.transform(stay, lambda k: F.get(every, k)), "\n")), 0)  # the text is split once
    joined = numbered.join(gone, "doc", "left")
    own = {text_col: F.when(F.col("gone").isNull(), text).otherwise(left).alias(text_col), "n_lines": None, "n_removed": None}
    cols = [own[c] if c in own else F.col("row").getField(c).alias(c) for c in df.columns if own.get(c, 1) is not None]
    return joined.select(*cols, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM docs WHERE ls IS NOT NULL),
sets AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS pos, doc_id, line_no,
  list_sort(list_distinct(list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS w FROM lines),
words AS (SELECT pos, len(w) AS n, unnest(w) AS word FROM sets WHERE len(w) > 0),
freq AS (SELECT word, count(*) AS f FROM words GROUP BY word),
ranked AS (SELECT pos, n, words.word, row_number() OVER (PARTITION BY pos ORDER BY f, words.word) AS i FROM words JOIN freq ON words.word = freq.word),
keys AS (SELECT * FROM ranked WHERE i <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.pos AS p, b.pos AS q FROM keys a JOIN keys b ON a.word = b.word AND a.pos < b.pos AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
gone AS (SELECT DISTINCT b.doc_id, b.line_no FROM pairs JOIN sets a ON a.pos = p JOIN sets b ON b.pos = q
  WHERE 180 * len(list_intersect(a.w, b.w)) >= 80 * (len(a.w) + len(b.w))),
kept AS (SELECT lines.doc_id, string_agg(CASE WHEN gone.doc_id IS NULL THEN line END, chr(10) ORDER BY lines.line_no) AS text, count(*) AS n_lines, count(gone.doc_id) AS n_removed
  FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.line_no = gone.line_no GROUP BY lines.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
