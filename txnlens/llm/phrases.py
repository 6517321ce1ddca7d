"""Phrase collocations: merged count-min sketches leave few n-grams to count exactly, then phrases are scored and subsumed.

First pass: every task counts the hashed n-grams (one to four words of one piece of a text, by language) in two rows of a
sketch, in counters that stop at 255. The tasks' sketches meet by chunks of counters and are added. A counter is never
smaller than the count of any n-gram that falls in it, so an n-gram with a counter under the minimum is surely rare; what
the second pass needs is one bit a counter, which is what reaches the driver and is broadcast. Second pass: n-grams whose
counters, and those of all shorter n-grams in them, reach the minimum are counted exactly, as text, with partial sums in each
batch and each task. Whatever the sketch lets through beyond that is dropped by its exact count, so the sketch decides how
much is shuffled and never what is found.

The number of counters follows the size of the input, up to ``MAX_BITS``: 64 MB a row in a task, a bitmap of 8 MB a row to
broadcast. Beyond about 2 GB of text a counter holds ever more rare n-grams and the second pass shuffles more; results stay
the same. Within a batch, n-grams are told apart by 128 bits of hash.

Defined cases: a null text has no words; a null language is ``und``, together with the language of that name. Repeated rows
count as often as they occur. Words of any length and texts of any length are counted whole: a text is cut into segments
that look ahead as many words as a phrase can go on. Ties are settled by the phrase's bytes. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, own_query, parts

MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2000
#: A longer candidate with this share of a candidate's count, in percent, replaces it.
SUBSUMED = 80
#: Counters of a row of the sketch, as powers of two, and bytes of text a counter.
MIN_BITS, MAX_BITS, TEXT_PER_COUNTER = 16, 26, 32
#: Counters that are merged at once.
CHUNK = 1 << 16
#: Bytes of text that are turned into arrays at once.
SEGMENT = 4 << 20
#: Parts that each language's candidates are dealt into before the best of all are found.
SALTS = 64

# What separates words (1) and what ends a piece (2).
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """The words of some bytes of text, lower-cased: a number into ``distinct`` each, their pieces and hashes."""

    def __init__(self, data: np.ndarray, first: np.ndarray, langs: np.ndarray):
        """``first``: where texts begin, ascending; ``langs``: a number of the language of each."""
        kind = _CLASS[data]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = kind == 0
        begins = np.zeros(len(data) + 1, bool)
        begins[first] = True
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | begins))
        ends = np.flatnonzero(before & (~inside | begins))
        sizes = np.zeros(len(ends) + 1, np.int64)
        np.cumsum(ends - self.start, out=sizes[1:])
        text = _LOWER[data[inside[:-1]]]
        words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(sizes), pa.py_buffer(text)]).dictionary_encode()
        self.number, self.distinct = words.indices.to_numpy(), words.dictionary
        breaks = np.flatnonzero((kind == 2) | begins[:-1])
        self.piece = np.searchsorted(breaks, self.start, "right")
        self.lang = langs[np.searchsorted(first, self.start, "right") - 1]
        digests = b"".join([xxhash.xxh3_128_digest(w) for w in self.distinct.to_pylist()])
        self.hashes = np.frombuffer(digests, np.uint64).reshape(-1, 2)

    def grams(self, seeds: np.ndarray, most: int, owned: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """(words, where each begins, its two hashes) of the n-grams of one to ``most`` words that begin before byte ``owned``.

        ``seeds``: a hash of each language.
        """
        of = self.hashes[self.number]
        at = np.flatnonzero(self.start < owned)
        own = tuple(of[:, k] for k in (0, 1))
        h = tuple((own[k][at] ^ seeds[self.lang[at]]) * _MUL[k] for k in (0, 1))
        for n in range(1, most + 1):
            if n > 1:
                go = at + n - 1 < len(self.start)
                go[go] = self.piece[at[go]] == self.piece[at[go] + n - 1]
                at = at[go]
                h = tuple((h[k][go] ^ own[k][at + n - 1]) * _MUL[k] for k in (0, 1))
                h = tuple(x ^ (x >> np.uint64(31)) for x in h)
            yield n, at, h

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        each = [self.distinct.take(pa.array(self.number[at + k])) for k in range(n)]
        return pc.binary_join_element_wise(*each, pa.scalar(b" ", pa.large_binary())) if n > 1 else each[0]


def segments(batch: pa.RecordBatch, most: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, where texts begin in them, the texts' rows, bytes owned) of the texts in the batch's first column.

    A text of more than ``size`` bytes comes in several segments. Each ends behind the ``most`` - 1 words that follow the
    bytes it owns, and begins where a word does.
    """
    texts = pc.fill_null(batch.column(0).cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    long = np.flatnonzero(np.diff(bounds) > size)
    at = 0
    for row in [*long.tolist(), len(texts)]:
        if row > at and bounds[row] > bounds[at]:
            yield data[bounds[at] : bounds[row]], bounds[at:row] - bounds[at], np.arange(at, row), int(bounds[row] - bounds[at])
        at = row + 1
        if row == len(texts):
            break
        begin, end = int(bounds[row]), int(bounds[row + 1])
        while begin < end:
            own = stop = _seek(data, min(begin + size, end), end, False)
            for _ in range(most - 1):
                stop = _seek(data, _seek(data, stop, end, True), end, False)
            yield data[begin:stop], np.zeros(1, np.int64), np.array([row]), own - begin
            begin = own


def _seek(data: np.ndarray, at: int, end: int, inside: bool) -> int:
    """The first byte from ``at`` on that is inside a word, or outside words; ``end`` if there is none."""
    step = 256
    while at < end:
        found = np.flatnonzero((_CLASS[data[at : min(at + step, end)]] == 0) == inside)
        if len(found):
            return at + int(found[0])
        at, step = min(at + step, end), min(4 * step, 1 << 20)
    return end


def _seeds(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in langs], np.uint64)


def _read(batches, most: int, size: int):
    """(words, hashes of languages, languages, bytes owned) of the segments of all batches of (text, lang)."""
    for batch in parts(batches, 0, size):
        langs = pc.fill_null(batch.column(1), "und").dictionary_encode()
        number, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        for data, first, rows, owned in segments(batch, most, size):
            yield Words(data, first, number[rows]), _seeds(names), names, owned


def _tokens(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))


def sketch(src: DataFrame, bits: int, min_count: int, most: int = MAX_WORDS, size: int = SEGMENT) -> np.ndarray:
    """Two rows of bits: which of the 2^``bits`` merged counters of each reach ``min_count``, over (text, lang)."""
    cells, chunk = 1 << bits, min(CHUNK, 1 << bits)
    shift = np.uint64(64 - bits)

    def count(batches):
        sums = np.zeros((2, cells), np.uint8)
        for words, seeds, _, owned in _read(batches, most, size):
            for row in (0, 1):
                at = np.sort(np.concatenate([(h[row] >> shift).astype(np.uint32) for _, _, h in words.grams(seeds, most, owned)]))
                new = np.flatnonzero(np.diff(at, prepend=np.uint32(~at[:1][0])) != 0) if len(at) else at
                times = np.diff(new, append=len(at))
                at = at[new]
                sums[row, at] = np.minimum(sums[row, at] + times, 255)
        some = sums.reshape(-1, chunk)
        used = np.flatnonzero(some.any(1))
        for k in range(0, len(used), 256):
            part = used[k : k + 256]
            packed = [pa.compress(some[i].tobytes(), codec="zstd", asbytes=True) for i in part]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "n"])

    def add(batches):
        at, total = None, np.zeros(chunk, np.uint32)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= min_count, bitorder="little").tobytes()], pa.binary())], names=["chunk", "n"])
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != at:
                    if at is not None:
                        yield done()
                    at = k
                    total[:] = 0
                total += np.frombuffer(pa.decompress(n, chunk, codec="zstd", asbytes=True), np.uint8)
        if at is not None:
            yield done()

    out = np.zeros((2 * cells // chunk, chunk // 8), np.uint8)
    with own_query(src.sparkSession):
        merged = src.mapInArrow(count, "chunk int, n binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, n binary").collect()
    for k, n in merged:
        out[k] = np.frombuffer(n, np.uint8)
    return out.reshape(2, -1)


def frequent(df: DataFrame, min_count: int = MIN_COUNT, most: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang", bits: int | None = None, size: int = SEGMENT) -> DataFrame:
    """(lang, phrase, words, f): the n-grams with ``min_count`` occurrences or more, and a row without a phrase with each language's words.

    A table in the shared folder; ``forget`` it after use.
    """
    src = _tokens(df, text_col, lang_col)
    spark = df.sparkSession
    if bits is None:
        with own_query(spark):
            total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MAX_BITS, max(MIN_BITS, int(total // TEXT_PER_COUNTER).bit_length()))
    many = spark.sparkContext.broadcast(sketch(src, bits, min_count, most, size))
    shift = np.uint64(64 - bits)

    def survivors(batches):
        bitmap = many.value
        for words, seeds, names, owned in _read(batches, most, size):
            names_ = pa.array(names, pa.string())
            per = np.bincount(words.lang[words.start < owned], minlength=len(names))
            used = np.flatnonzero(per)
            yield _message(names_.take(pa.array(used)), pa.nulls(len(used), pa.string()), 0, per[used])
            well = np.ones(len(words.start) + 1, bool)  # whether the n-gram before, one word shorter, at each place survived
            for n, at, h in words.grams(seeds, most, owned):
                ok = well[at] if n == 1 else well[at] & (well[at + 1] | (words.start[at + 1] >= owned))
                for row in (0, 1):
                    cell = h[row] >> shift
                    ok &= (bitmap[row, cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
                well = np.zeros(len(words.start) + 1, bool)
                well[at[ok]] = True
                at, a, b = at[ok], h[0][ok], h[1][ok]
                if not len(at):
                    continue
                order = np.argsort(a, kind="stable")
                a, b, at = a[order], b[order], at[order]
                if (b[1:] != b[:-1])[a[1:] == a[:-1]].any():  # 64 bits of two n-grams agree
                    order = np.lexsort((b, a))
                    a, b, at = a[order], b[order], at[order]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                yield _message(names_.take(pa.array(words.lang[at[new]])), words.phrases(at[new], n).cast(pa.large_string()).cast(pa.string()), n, np.diff(new, append=len(at)))

    try:
        counted = src.mapInArrow(survivors, "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
        return materialize(counted.filter((F.col("words") == 0) | (F.col("f") >= min_count)))
    finally:
        many.destroy()


def _message(lang: pa.Array, phrase: pa.Array, n: int, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(f), n), pa.int32()), pa.array(f, pa.int64())], names=["lang", "phrase", "words", "f"])


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two words or more among ``found``, by their lowest-scoring cut.

    A cut's halves are as frequent as the phrase or more, so ``found`` holds them. Products are decimals of 38 digits.
    """
    each = F.split("phrase", " ")
    half = lambda first, n: F.array_join(F.slice(each, first, n), " ")
    cuts = found.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", half(F.lit(1), F.col("k")).alias("head"), half(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    part = lambda name, n: found.filter("phrase is not null").select(F.col("lang"), F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return lowest.select("lang", "phrase", "words", "a", "x.l", "x.r", "x.score")


def subsumed(candidates: DataFrame, share: int = SUBSUMED) -> DataFrame:
    """``candidates`` without those that stand inside a longer one with ``share`` percent of their count or more."""
    each = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(each, i, n), " "))))
    inside = candidates.filter("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    beaten = F.expr(f"100 * cast(longer as decimal(20, 0)) >= {int(share)} * cast(a as decimal(20, 0))")
    return candidates.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(beaten, F.lit(False))).drop("longer")


def collocations(df: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, most: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang", bits: int | None = None, size: int = SEGMENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``most`` words.

    ``a``, ``l`` and ``r`` are the counts of the phrase and of the halves of its lowest-scoring cut, ``n`` the language's words.
    The best of each part of a language's candidates are found first, then the best of all.
    """
    found = frequent(df, min_count, most, text_col, lang_col, bits, size)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rest = subsumed(scored(found)).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = rest.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = found.filter("words = 0").select("lang", F.col("f").alias("n"))
    out = materialize(best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    forget(found)
    return out


#: The same in plain SQL: every n-gram counted as text.
ORACLE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
cand AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k >= 2),
cuts AS (SELECT lang, k, g, a, w, unnest(range(1, k)) AS c FROM cand),
sc AS (SELECT cuts.lang, cuts.k, cuts.g, a, c, x.f AS l, y.f AS r, 2000000::HUGEINT * a // (x.f::HUGEINT + y.f) AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.g = array_to_string(w[1:c], ' ') JOIN f y ON y.lang = cuts.lang AND y.g = array_to_string(w[c + 1 :], ' ')),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, c) AS o FROM sc) WHERE o = 1),
subs AS (SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS m) WHERE k > m)),
longer AS (SELECT lang, g, max(a) AS b FROM subs GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.g = low.g WHERE b IS NULL OR 100::HUGEINT * b < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT ranked.lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
