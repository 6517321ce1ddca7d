"""Quotation linking: reply-ordered conversations without quotes, in DataFrame operations only.

A message's lines are parsed into quote levels (the number of ``>`` before the text). Adjacent lines of one level form a
passage. Quoted passages are normalised (markers off, A-Z lower-cased, white space to single spaces, trimmed) and hashed;
the unquoted text of every message gives the hashes of its whole, its paragraphs and its lines. A quoted passage joins the
first message of its conversation that says it, if that is an earlier turn. Passages that no such unit matches are looked
for as runs of whole lines, of any number, over paragraph borders and however the quote wraps them: the first words of a
passage meet those of each line, and only runs that begin there and have the passage's length are hashed. A message
replies to what its outermost level quotes, of several to the latest turn. Reply chains are resolved by doubling, so a chain of d replies takes log2 d rounds.

The result has one row a message, as a conversation may hold a third of all rows: ``path`` sorts a conversation in reply
order (each reply after what it answers), ``depth`` is the number of messages above, ``body`` has no quoted lines and
``formatted`` adds the role.

Defined cases: a null text is empty. A message that quotes nothing known replies to nothing and starts a thread. Repeated
(conversation, turn) rows share a place and stay one row each; a null conversation id or turn is never linked, and a turn that
is no whole number is null. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, scratch

_QUOTE = r"^[ \t]*(?:>[ \t]*)+"
#: Words at most by which passages and lines meet.
_FIRST = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+", " "))


def _hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _body(text: Column) -> Column:
    """The text without quoted lines, trimmed."""
    return F.regexp_replace(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(_QUOTE)), "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _first(words: Column, n: Column) -> Column:
    return F.xxhash64(n, F.array_join(F.slice(words, 1, n), " "))


def _runs(msgs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv, h, origin): the first turn that says a passage of ``wanted`` as a run of whole lines."""
    n = F.least(F.size("words"), F.lit(_FIRST))
    passages = wanted.select("conv", "h", F.length("said").alias("len"), F.split("said", " ").alias("words"))
    passages = materialize(passages.select("conv", "h", "len", F.size("words").alias("k"), _first(F.col("words"), n).alias("first")).distinct())
    lines = F.filter(F.transform(F.split(_body(F.col("text")), "\n"), normalised), lambda x: x != "")
    said = msgs.filter("turn is not null").join(passages.select("conv").distinct(), "conv", "left_semi").select(F.monotonically_increasing_id().alias("row"), "conv", "turn", lines.alias("lines"))
    said = materialize(said.filter(F.size("lines") > 0))
    starts = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.struct(i.alias("i"), F.slice(F.split(F.array_join(F.slice("lines", i, F.lit(_FIRST)), " "), " "), 1, _FIRST).alias("words")))
    begins = said.select("row", "conv", F.explode(starts).alias("x")).select("row", "conv", "x.i", "x.words")
    begins = begins.select("row", "conv", "i", F.explode(F.transform(F.sequence(F.lit(1), F.size("words")), lambda n: _first(F.col("words"), n))).alias("first"))
    asked = begins.join(passages.select("conv", "first", "len", "k").distinct(), ["conv", "first"]).groupBy("row").agg(F.collect_list(F.struct("i", "len", "k")).alias("asked"))

    def run(x: Column) -> Column:
        text = F.array_join(F.slice("lines", x["i"], x["k"]), "\n")
        ends = F.substring(text, x["len"] + 1, F.lit(1)).isin("", "\n") & (F.length(text) >= x["len"])
        return F.when(ends, _hash(F.substring(text, F.lit(1), x["len"])))

    met = said.join(asked, "row").select("conv", "turn", F.explode(F.array_distinct(F.transform("asked", run))).alias("h")).filter("h is not null")
    return met.groupBy("conv", "h").agg(F.min("turn").alias("origin"))


def link_quotes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, turn, role, reply_to, depth, path, body, formatted) of every message."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    msgs = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).try_cast("long").alias("turn"), F.col(role_col).alias("role"), text.alias("text"))
    quoting = msgs.filter(F.col("text").contains(">") & F.col("conv").isNotNull() & F.col("turn").isNotNull())
    level = lambda x: F.length(F.regexp_extract(x, _QUOTE, 0)) - F.length(F.translate(F.regexp_extract(x, _QUOTE, 0), ">", ""))
    # runs of lines of one level, as an array of (level, text), by one fold over a message's own lines
    entry = F.transform(F.split("text", "\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, _QUOTE, "").alias("text")))
    empty = F.array().cast("array<struct<level:int,text:string>>")

    def fold(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["level"].alias("level"), F.concat_ws("\n", last["text"], x["text"]).alias("text"))))
        return F.when((F.size(acc) > 0) & (last["level"] == x["level"]), grown).otherwise(F.concat(acc, F.array(x)))

    passages = quoting.select("conv", "turn", F.explode(F.aggregate(entry, empty, fold)).alias("x")).filter("x.level > 0")
    passages = passages.select("conv", "turn", F.col("x.level").alias("level"), normalised(F.col("x.text")).alias("said"), _hash(F.col("x.text")).alias("h")).filter("said != ''").dropDuplicates(["conv", "turn", "level", "h"])
    with scratch() as keep:
        replies = _replies(msgs, materialize(passages))
        if replies is not None:
            keep(replies)
    return _ordered(msgs, replies, conv_col, turn_col, role_col)


def _replies(msgs: DataFrame, wanted: DataFrame) -> DataFrame | None:
    """(conv, turn, parent) of the messages that quote an earlier one; None if nothing is quoted."""
    if not wanted.isEmpty():
        said = msgs.filter("conv is not null and turn is not null").join(wanted.select("conv").distinct(), "conv", "left_semi").select("conv", "turn", _body(F.col("text")).alias("body"))
        units = F.array_distinct(F.concat(F.array("body"), F.split("body", r"\n[\x20\x09-\x0D]*\n"), F.split("body", "\n")))
        first = said.select("conv", "turn", F.explode(units).alias("u")).select("conv", "turn", _hash(F.col("u")).alias("h")).groupBy("conv", "h").agg(F.min("turn").alias("origin"))
        linked = materialize(wanted.join(first, ["conv", "h"]).filter("origin < turn").drop("said"))
        rest = wanted.join(linked, ["conv", "turn", "level", "h"], "left_anti")
        if not rest.isEmpty():
            linked = linked.unionByName(rest.join(_runs(msgs, rest), ["conv", "h"]).filter("origin < turn").drop("said"))
        return materialize(linked.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), "origin"))["origin"].alias("parent")))
    return None


def _ordered(msgs: DataFrame, replies: DataFrame | None, conv_col: str, turn_col: str, role_col: str) -> DataFrame:
    def pad(c: str) -> Column:
        """The number as text that sorts alike: negative ones begin with a minus, which sorts before digits, and count up from the least."""
        t = F.col(c)
        return F.when(t < 0, F.concat(F.lit("-"), F.lpad((t + F.lit((1 << 63) - 1)).cast("string"), 19, "0"))).otherwise(F.lpad(t.cast("string"), 19, "0"))

    if replies is None:
        placed = msgs.withColumn("reply_to", F.lit(None).cast("long")).withColumn("depth", F.lit(0).cast("long")).withColumn("path", pad("turn"))
    else:
        # (conv, turn, jump: an ancestor not yet in path, up: its distance, path: from below it to the message)
        nodes = replies.select("conv", "turn", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("up"), pad("turn").alias("path"))
        last = None
        while True:
            above = nodes.select("conv", F.col("turn").alias("jump"), F.col("jump").alias("jump2"), F.col("up").alias("up2"), F.col("path").alias("path2"))
            met = nodes.join(above, ["conv", "jump"], "left")
            doubled = met.select("conv", "turn", F.coalesce("jump2", "jump").alias("jump"), (F.col("up") + F.coalesce("up2", F.lit(0))).alias("up"), F.concat_ws("/", "path2", "path").alias("path"), F.col("jump2").isNotNull().alias("more"))
            doubled = materialize(doubled)
            if last is not None:
                forget(last)
            last, nodes = doubled, doubled.drop("more")
            if doubled.filter("more").isEmpty():
                break
        nodes = materialize(nodes.select("conv", "turn", F.col("up").alias("depth"), F.concat_ws("/", pad("jump"), "path").alias("path")).join(replies.withColumnRenamed("parent", "reply_to"), ["conv", "turn"]))
        forget(last, replies)
        met = msgs.join(nodes, ["conv", "turn"], "left")
        placed = met.withColumn("depth", F.coalesce("depth", F.lit(0)).cast("long")).withColumn("path", F.coalesce("path", pad("turn")))
    body = _body(F.col("text"))
    return placed.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "reply_to", "depth", "path", body.alias("body"), F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), body).alias("formatted"))


ORACLE_SQL = r"""
WITH RECURSIVE msgs AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
lines AS (SELECT r, conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM msgs),
levels AS (SELECT *, len(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+')) - len(replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '>', '')) AS level FROM lines),
bodies AS (SELECT r, regexp_replace(coalesce(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY i), ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body FROM levels GROUP BY r),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY r, level ORDER BY i) AS run FROM levels),
passages AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(translate(string_agg(regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', ''), chr(10) ORDER BY i), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS p
  FROM runs WHERE level > 0 GROUP BY conv_id, turn, r, level, run),
units AS (SELECT conv_id, turn, unnest(list_concat([body], string_split_regex(body, '\n[\x20\x09-\x0D]*\n'), string_split(body, chr(10)))) AS u FROM msgs JOIN bodies USING (r)),
first AS (SELECT conv_id, trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS p, min(turn) AS origin FROM units GROUP BY 1, 2),
spoken AS (SELECT conv_id, turn, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS ls
  FROM msgs JOIN bodies USING (r) WHERE conv_id IN (SELECT conv_id FROM passages) AND turn IS NOT NULL),
starts AS (SELECT *, unnest(range(1, len(ls) + 1)) AS a FROM spoken),
spans AS (SELECT conv_id, turn, ls, a, unnest(range(a, len(ls) + 1)) AS b FROM starts),
joined AS (SELECT conv_id, array_to_string(ls[a:b], ' ') AS p, min(turn) AS origin FROM spans GROUP BY 1, 2),
hits AS (SELECT q.conv_id, q.turn, q.level, q.p, coalesce(CASE WHEN f.origin < q.turn THEN f.origin END, CASE WHEN j.origin < q.turn THEN j.origin END) AS origin
  FROM passages q LEFT JOIN first f ON f.conv_id = q.conv_id AND f.p = q.p LEFT JOIN joined j ON j.conv_id = q.conv_id AND j.p = q.p),
best AS (SELECT conv_id, turn, origin, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, origin DESC) AS k FROM hits WHERE p <> '' AND origin IS NOT NULL),
links AS (SELECT conv_id, turn, origin FROM best WHERE k = 1),
tree AS (SELECT DISTINCT m.conv_id, m.turn, CAST(NULL AS BIGINT) AS reply_to, 0::BIGINT AS depth, lpad(m.turn::VARCHAR, 19, '0') AS path FROM msgs m WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.conv_id = m.conv_id AND l.turn = m.turn)
  UNION ALL SELECT l.conv_id, l.turn, l.origin, t.depth + 1, t.path || '/' || lpad(l.turn::VARCHAR, 19, '0') FROM tree t JOIN links l ON l.conv_id = t.conv_id AND l.origin = t.turn)
SELECT m.conv_id, m.turn, m.role, t.reply_to, t.depth, t.path, b.body, '<|' || coalesce(m.role, '') || '|>' || chr(10) || b.body AS formatted
FROM msgs m JOIN bodies b USING (r) JOIN tree t ON t.conv_id IS NOT DISTINCT FROM m.conv_id AND t.turn IS NOT DISTINCT FROM m.turn
"""
