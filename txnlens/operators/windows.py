"""Point-in-time account features: what an account did strictly before a transaction's whole second."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import same

HOUR, DAY, MONTH = 3600, 86400, 2592000
#: Rows of an account that one task still orders, and walks its frames for, well.
HOT_ROWS = 10_000
#: Accounts above that are broadcast at most; more are joined by a shuffle.
BROADCAST_ACCOUNTS = 100_000


def _recent(seconds: DataFrame) -> DataFrame:
    """(a, t, h, d, v) of (a, t, n, v): counts over an hour and a day and the day's sum, of the seconds before each t.

    A second also goes to the account's next day, where it counts as the day before. So one task holds two days of an
    account, at most 172,800 seconds. Sums add what the frame holds and never subtract.
    """
    day = F.floor(F.col("t") / DAY)
    copies = F.explode(F.array(F.struct(day.alias("day"), F.lit(True).alias("own")), F.struct((day + 1).alias("day"), F.lit(False).alias("own"))))
    rows = seconds.select("a", "t", "n", "v", copies.alias("x")).select("a", "t", "n", "v", "x.*")
    up, down = Window.partitionBy("a", "day").orderBy("t"), Window.partitionBy("a", "day").orderBy(F.col("t").desc())
    until = lambda c, end: F.coalesce(F.sum(c).over(up.rangeBetween(Window.unboundedPreceding, -end)), F.lit(0))
    own, before = F.when(F.col("own"), F.col("v")), F.when(~F.col("own"), F.col("v"))
    since = F.coalesce(F.sum(before).over(down.rangeBetween(Window.unboundedPreceding, DAY)), F.lit(0.0))
    past = until("n", 1)
    out = rows.select("a", "t", "own", (past - until("n", HOUR + 1)).alias("h"), (past - until("n", DAY + 1)).alias("d"), (since + until(own, 1)).alias("v"))
    return out.filter("own").drop("own")


def _partners(seconds: DataFrame, times: DataFrame) -> DataFrame:
    """(a, t, u) of the times (a, t): distinct partners p of the (a, p, t) rows within 30 days before t.

    A partner is present from the second after a contact until 30 days after it. Contacts of one day are one presence, so
    a partner's days are put in order, not its contacts. The beginnings and ends of presence are summed within a day, and
    days' totals give what holds at its start: one task holds one day of an account.
    """
    day = F.floor(F.col("t") / DAY)
    days = seconds.groupBy("a", "p", day.alias("day")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    by = Window.partitionBy("a", "p").orderBy("day")
    days = days.select("a", "first", "last", F.lag("last").over(by).alias("earlier"), F.lead("first").over(by).alias("later"))
    begins = F.when(F.col("earlier").isNull() | (F.col("first") > F.col("earlier") + MONTH), F.struct((F.col("first") + 1).alias("t"), F.lit(1).alias("c")))
    ends = F.when(F.col("later").isNull() | (F.col("later") > F.col("last") + MONTH), F.struct((F.col("last") + MONTH + 1).alias("t"), F.lit(-1).alias("c")))
    changes = days.select("a", F.explode(F.array_compact(F.array(begins, ends))).alias("x")).select("a", "x.t", "x.c")
    at = changes.unionByName(times.select("a", "t", F.lit(0).alias("c"))).groupBy("a", "t").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 0).alias("asked")).withColumn("day", day)
    earlier = Window.partitionBy("a").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    start = at.groupBy("a", "day").agg(F.sum("c").alias("c")).select("a", "day", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("start"))
    within = at.withColumn("c", F.sum("c").over(Window.partitionBy("a", "day").orderBy("t"))).filter("asked > 0")
    return within.alias("w").join(start.alias("s"), same("w", "s", ["a", "day"])).select("w.a", "w.t", (F.col("w.c") + F.col("s.start")).alias("u"))


def _split_accounts(df: DataFrame, origin: str = "origin_account_id", time: str = "timestamp", amount: str = "amount", destination: str = "destination_account_id") -> DataFrame:
    """The features of accounts of any number of rows, by seconds and days.

    Rows are first summed by account and second; an account with very many rows is spread over its days, and the rows meet
    their features by account and second.
    """
    rows = df.select(F.col(f"`{origin}`").alias("a"), F.unix_timestamp(f"`{time}`").alias("t"), F.col(f"`{amount}`").alias("v"), F.col(f"`{destination}`").alias("p")).filter("t is not null")
    seconds = rows.groupBy("a", "t").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).cast("double").alias("v"))
    partners = _partners(rows.filter("p is not null"), seconds)
    found = _recent(seconds).alias("r").join(partners.alias("u"), same("r", "u", ["a", "t"])).select(F.struct("r.a", "r.t", "r.h", "r.d", "r.v", "u.u").alias("_found"))
    on = F.col(f"_row.`{origin}`").eqNullSafe(F.col("_found.a")) & (F.unix_timestamp(f"_row.`{time}`") == F.col("_found.t"))
    joined = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")).join(found, on, "left")
    got = lambda c, kind, name: F.coalesce(F.col(f"_found.{c}"), F.lit(0)).cast(kind).alias(name)
    features = {"transactions_last_1h": ("h", "int"), "transactions_last_24h": ("d", "int"), "amount_sum_last_24h": ("v", "double"), "unique_destinations_last_30d": ("u", "int")}
    return joined.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c not in features], *[got(c, kind, name) for name, (c, kind) in features.items()])


def add_behavior_features(df: DataFrame, origin: str = "origin_account_id", time: str = "timestamp", amount: str = "amount", destination: str = "destination_account_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Counts over an hour and a day, the day's sum and 30 days' distinct destinations, per origin.

    Frames end one second before the row, which leaves out the row itself and every row of its second. Null origins are one
    account, null amounts and destinations add nothing, and a row without a time counts nowhere and has zeros.

    One aggregate finds the accounts of more than ``hot_rows`` rows, of which there are at most the table's rows divided by
    that number. They take several tasks each, by seconds and days; the others one window. Both give the same features, up
    to the rounding of sums, so where the border lies decides only the plan.
    """
    hot = df.groupBy(F.col(f"`{origin}`").alias("_a")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select("_a", F.lit(True).alias("_hot"))
    hot = hot.persist()
    n = hot.count()
    names = (origin, time, amount, destination)
    if not n:
        hot.unpersist()
        return add_behavior_features_by_window(df, *names)
    small = F.broadcast(hot) if n <= BROADCAST_ACCOUNTS else hot
    marked = df.join(small, F.col(f"`{origin}`").eqNullSafe(F.col("_a")), "left").drop("_a")
    few, many = marked.filter("_hot is null").drop("_hot"), marked.filter("_hot").drop("_hot")
    return add_behavior_features_by_window(few, *names).unionByName(_split_accounts(many, *names))


def add_behavior_features_by_window(df: DataFrame, origin: str = "origin_account_id", time: str = "timestamp", amount: str = "amount", destination: str = "destination_account_id") -> DataFrame:
    """The same by four frames of one window: one exchange, but an account is one task and each row walks its frames."""
    by = Window.partitionBy(F.col(f"`{origin}`")).orderBy(F.unix_timestamp(F.col(f"`{time}`")))
    last = lambda seconds: by.rangeBetween(-seconds, -1)
    timed = lambda c, zero: F.when(F.col(f"`{time}`").isNotNull(), c).otherwise(zero)
    total = F.coalesce(F.sum(F.col(f"`{amount}`")).over(last(DAY)), F.lit(0)).cast("double")
    features = {
        "transactions_last_1h": timed(F.count(F.lit(1)).over(last(HOUR)), F.lit(0)).cast("int"), "transactions_last_24h": timed(F.count(F.lit(1)).over(last(DAY)), F.lit(0)).cast("int"),
        "amount_sum_last_24h": timed(total, F.lit(0.0)), "unique_destinations_last_30d": timed(F.size(F.collect_set(F.col(f"`{destination}`")).over(last(MONTH))), F.lit(0)).cast("int"),
    }
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in features], *[c.alias(n) for n, c in features.items()])
