from pyspark.sql import functions as F

from txnlens.llm import chat

MESSAGES = [
    (1, 0, "user", "Hello there\nHow are  you?"), (1, 1, "assistant", "> hello THERE\n> how are you?\nFine."), (1, 2, "user", "no quotes"), (1, 3, "assistant", ">> Hello there\n>> How are you?\n> Fine.\n\nGood."), (1, 4, "user", " > > fine.\nodd"),
    (1, 5, "user", "> Fine.\n\nsecond"), (1, 6, "user", ">unknown words\nx"), (1, 7, "user", "> Good.\nok"), (2, 0, "user", "> Fine.\nother conversation"), (2, 1, None, None), (2, 2, "user", "> other conversation\nA\n> later\nB"), (2, 3, "user", "later"), (2, 4, "user", ">\n> \nempty quote"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, data, f=lambda df: df):
    return {(r["conv_id"], r["turn"]): r for r in chat.link_quotes(f(spark.createDataFrame(data, SCHEMA))).collect()}


def test_links_depths_and_bodies(spark):
    got = run(spark, MESSAGES)
    assert {k[1]: (r["reply_to"], r["depth"]) for k, r in got.items() if k[0] == 1} == {0: (None, 0), 1: (0, 1), 2: (None, 0), 3: (1, 2), 4: (1, 2), 5: (1, 2), 6: (None, 0), 7: (3, 3)}
    assert {k[1]: r["reply_to"] for k, r in got.items() if k[0] == 2} == {0: None, 1: None, 2: 0, 3: None, 4: None}
    assert (got[1, 3]["body"], got[2, 2]["body"], got[2, 1]["formatted"]) == ("Good.", "A\nB", "<||>\n") and got[1, 1]["formatted"] == "<|assistant|>\nFine."
    order = [k[1] for k, r in sorted(got.items(), key=lambda x: x[1]["path"]) if k[0] == 1]
    assert order == [0, 1, 3, 7, 4, 5, 2, 6]


def test_equals_the_sql(spark):
    import duckdb
    import pyarrow as pa

    table = pa.table(list(map(list, zip(*MESSAGES))), names=["conv_id", "turn", "role", "text"])
    con = duckdb.connect()
    con.register("conversations", table)
    want = sorted(map(repr, con.execute(chat.ORACLE_SQL).fetchall()))
    names = ["conv_id", "turn", "role", "reply_to", "depth", "path", "body", "formatted"]
    assert sorted(repr(tuple(r[n] for n in names)) for r in run(spark, MESSAGES).values()) == want


def same_as_sql(spark, data):
    import duckdb
    import pyarrow as pa

    table = pa.table(list(map(list, zip(*data))), schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    con = duckdb.connect()
    con.register("conversations", table)
    names = ["conv_id", "turn", "role", "reply_to", "depth", "path", "body", "formatted"]
    want = sorted(map(repr, con.execute(chat.ORACLE_SQL).fetchall()))
    got = chat.link_quotes(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(repr(tuple(r[n] for n in names)) for r in got) == want
    return got


def test_equals_the_sql_where_much_is_quoted(spark):
    import random

    rng = random.Random(5)
    data = []
    for conv in range(12):
        texts: list[list[str]] = []
        for turn in range(25 if conv else 120):
            own = [" ".join(rng.choices(["Alpha", "beta", "gamma", "delta"], k=rng.randint(1, 3))) if rng.random() > 0.15 else "" for _ in range(rng.randint(1, 6))]
            quotes = []
            for _ in range(rng.randint(0, 2) if texts else 0):
                said = rng.choice(texts)
                a = rng.randrange(len(said))
                marks = ">" * rng.randint(1, 2) + " "
                quotes += [marks + x.upper() for x in said[a : a + rng.randint(1, 4)]] + [""]
            texts.append(own)
            data.append((conv, turn, "user", "\n".join(quotes + own)))
    got = same_as_sql(spark, data)
    assert sum(r["reply_to"] is not None for r in got) > 100 and max(r["depth"] for r in got) > 3


def test_tables_go(spark):
    from pathlib import Path

    from txnlens.llm import common

    at = Path(common.shared_folder(spark))
    before = len(list(at.iterdir()))
    with common.scratch():
        chat.link_quotes(spark.createDataFrame(MESSAGES, SCHEMA)).count()
        assert len(list(at.iterdir())) == before + 1  # the places, which the result reads
    assert len(list(at.iterdir())) == before


def test_quotes_of_a_run_of_lines(spark):
    one = "Alpha one two three four\nbeta\ngamma delta\n\nSecond paragraph\n\nThird  one\nends"
    quotes = {
        1: "> Alpha one two three four\n> beta", 2: "> beta\n> gamma delta", 3: "> Second paragraph\n>\n> third one\n> ends", 4: "> gamma delta\n>\n> Second paragraph\n> ", 5: "> beta gamma\n> delta Second\n> paragraph Third one",
        6: "> Alpha one two three", 7: "> beta\n> Second paragraph", 8: "> ends\n> more", 9: "> two three four\n> beta",
    }
    got = run(spark, [(1, 0, "user", one), *[(1, t, "user", f"{q}\n\nown {t}") for t, q in quotes.items()], (2, 1, "user", quotes[2]), (1, 10, "user", "x\nbeta\ngamma delta")])
    assert {k[1]: r["reply_to"] for k, r in got.items() if k[0] == 1} == {**dict.fromkeys([0, 6, 7, 8, 9, 10]), **dict.fromkeys([1, 2, 3, 4, 5], 0)}
    assert got[2, 1]["reply_to"] is None and len(got) == 12
    same_as_sql(spark, [(1, 0, "user", one), *[(1, t, "user", f"{q}\n\nown {t}") for t, q in quotes.items()], (2, 1, "user", quotes[2])])


def test_long_chain(spark):
    data = [(1, 0, "u", "m0")] + [(1, i, "u", f"> m{i - 1}\nm{i}") for i in range(1, 40)]
    assert [run(spark, data)[1, i]["depth"] for i in (0, 1, 39)] == [0, 1, 39]


def test_edges(spark):
    f = lambda df: df.withColumn("depth", F.lit("x")).withColumn("body", F.lit(1)).withColumn("conv", F.lit(2))
    assert run(spark, [], f) == {}
    twice = [*MESSAGES[:2], MESSAGES[1], (None, 1, "u", "> hello there"), (1, None, "u", "> Hello there\nx")]
    out = chat.link_quotes(spark.createDataFrame(twice, SCHEMA)).collect()
    assert len(out) == 5 and sum(r["reply_to"] == 0 for r in out) == 2


def test_native_plan(spark):
    plan = chat.link_quotes(spark.createDataFrame(MESSAGES, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_turns_below_zero_and_turns_that_are_no_numbers(spark):
    df = spark.createDataFrame([("c", t, "user", f"text {t}") for t in ("-10", "-1", "0", "2", "11", "x", None)], "conv_id string, turn string, role string, text string")
    out = chat.link_quotes(df).orderBy("path").collect()
    assert [r["turn"] for r in out if r["turn"] is not None] == [-10, -1, 0, 2, 11] and sum(r["turn"] is None for r in out) == 2
