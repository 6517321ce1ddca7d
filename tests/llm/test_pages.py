import os
import random
import re

import pytest
from pyspark.sql import functions as F

from txnlens.llm import pages as p

from .helpers import rows


def test_article_only():
    html = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad --><div class="ad">buy</div><article><h1>A &amp; B &am</h1><p><b>One.<br>two<br><p>Three\n  <i>four</i>five<ul><li>a<li>b</ul><aside>out</aside><form>f<p>g</p></form><section class="comments"><p>c</p></section><p>&lt;end&gt;&nbsp;x</article><footer>&copy; f</footer></body></html>'
    assert p.main_texts([html]) == ["A & B &am\n\nOne. two\n\nThree fourfive\n\na\n\nb\n\n<end> x"]


def test_shared_text_goes_without_an_article():
    page = lambda i: f"<body><div>{'welcome to our site today friend'}</div><p>own words number {i} are here only {i}</p><div>all rights are reserved by us</div></body>"
    assert p.main_texts([page(i) for i in range(5)]) == [f"own words number {i} are here only {i}" for i in range(5)]
    assert "welcome" in p.main_texts([page(0)])[0]


def test_articles_stay_however_often_they_repeat():
    same = "<article><p>the very same words in every page</p></article>"
    assert p.main_texts([same] * 9) == ["the very same words in every page"] * 9


def test_articles_are_whole_whatever_their_blocks_share():
    notice = "please read our terms of use"
    own = [f"own words number {i} are here only {i} and there are many more of them {i}" for i in range(5)]
    assert p.main_texts([f"<article><p>{o}</p><p>{notice}</p></article>" for o in own]) == [f"{o}\n\n{notice}" for o in own]


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_article_of_the_pages_comes_back_whole(spark):
    """An article's blocks behind its title are, white space aside, one text of documents."""
    texts = {" ".join((r["text"] or "").split()) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = p.extract_text(spark.read.parquet(f"{DATA}/pages.parquet")).collect()
    assert len(got) == 250 and all(" ".join(r["text"].partition("\n\n")[2].split()) in texts and r["n_chars"] == len(r["text"]) for r in got)


def test_pages_without_articles_match_brute_force(spark):
    """Also with rows repeated, and dealt into one, eight and 64 partitions."""
    rng = random.Random(11)
    lines = [" ".join(rng.choices("abcdef", k=rng.randrange(3, 12))) for _ in range(14)]
    data = [(i, f"https://{'xyz'[i % 3]}.c/{i}", "".join(f"<p>{rng.choice(lines)}</p>" for _ in range(6))) for i in range(40)] + [(1, None, f"<p>{lines[0]}</p>")] * 2 + [(99, "https://x.c/9", f"<article><p>{lines[0]}</p></article>")]
    blocks = lambda html: [b.strip() for b in re.findall("<p>(.*?)</p>", html)]
    windows = {}
    for k, (_, url, html) in enumerate(data[:-1]):
        for b in blocks(html):
            for w in range(len(b.split()) - 4):
                windows.setdefault((url and url[8], *b.split()[w : w + 5]), set()).add(k)
    want = []
    for i, url, html in data[:-1]:
        kept = []
        for b in blocks(html):
            hit = {j for w in range(len(b.split()) - 4) if len(windows[(url and url[8], *b.split()[w : w + 5])]) >= 3 for j in range(w, w + 5)}
            if 2 * len(hit) <= len(b.split()):
                kept.append(b)
        want.append((i, "\n\n".join(kept)))
    want = sorted([*want, (99, lines[0])])
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    for n in (1, 8, 64):
        assert sorted((r["page_id"], r["text"]) for r in p.extract_text(df.repartition(n)).collect()) == want


def test_shares_match_brute_force():
    rng = random.Random(4)
    streams = [[rng.choices("abcd", k=rng.randrange(12)) for _ in range(rng.randrange(4))] for _ in range(12)]
    windows = {}
    for i, blocks in enumerate(streams):
        for b in blocks:
            for k in range(len(b) - 2):
                windows.setdefault(tuple(b[k : k + 3]), set()).add(i)
    want = []
    for blocks in streams:
        shares = []
        for b in blocks:
            hit = {j for k in range(len(b) - 2) if len(windows[tuple(b[k : k + 3])]) >= 3 for j in range(k, k + 3)}
            shares.append(len(hit) / len(b) if b else 0.0)
        want.append(shares)
    assert p.shared_words(streams, 3, 3) == want


def test_table_and_edges(spark):
    data = [(1, "https://a.b/c", "<article><p>x</p></article>"), (2, None, None), (3, "https://a.b/d", ""), (3, "https://a.b/d", ""), (4, "nonsense", "<p>unclosed &lt"), (None, "https://a.b/e", "plain  text")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("n_chars", F.lit("n"))
    got = p.extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 6
    got = rows(got, "page_id")
    assert [got[k]["text"] for k in (1, 2, 3, 4, None)] == ["x", "", "", "unclosed <", "plain text"] and got[4]["n_chars"] == 10
    assert p.extract_text(df.limit(0)).count() == 0


def test_pages_are_counted_over_the_whole_host(spark):
    notice = "please read our terms of use"
    own = [f"own words number {i} are here only {i}" for i in range(8)]
    data = [(i, f"https://{'ab'[i % 2]}.c/{i}", f"<p>{o}</p><p>{notice}</p>") for i, o in enumerate(own)]  # four pages a host
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(8)
    for size in (1, 3, 100):  # rows of an Arrow batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert {r["page_id"]: r["text"] for r in p.extract_text(df, min_pages=4).collect()} == dict(enumerate(own))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(notice in r["text"] for r in p.extract_text(df, min_pages=5).collect())


def test_very_long_page():
    html = "<article>" + "<p>some words " * 50_000 + "</article>"
    assert len(p.main_texts([html])[0].split("\n\n")) == 50_000


def test_more_words_than_a_suffix_array_covers():
    words = [str(i) for i in range(2_200_000)]
    cut = 1 << 20  # where the second suffix array begins
    streams = [[words], [words[cut - 3 : cut + 4], ["a"] * 6], [["b"], words[cut - 3 : cut + 4]]]
    first, *others = p.shared_words(streams)
    assert first == [7 / len(words)] and others == [[1.0, 0.0], [0.0, 1.0]]


def test_articles_are_judged_by_the_suffix_array_too(spark):
    """Against brute force; their text is whole all the same. Pages of another kind or host do not count."""
    rng = random.Random(12)
    lines = [" ".join(rng.choices("abcdef", k=rng.randrange(3, 12))) for _ in range(14)]
    data = [(i, f"https://{'xyz'[i % 3]}.c/{i}", [rng.choice(lines) for _ in range(6)], i % 4 > 0) for i in range(40)]
    windows = {}
    for i, url, blocks, article in data:
        for b in blocks:
            for w in range(len(b.split()) - 4):
                windows.setdefault((article, url[8], *b.split()[w : w + 5]), set()).add(i)
    want = []
    for i, url, blocks, article in data:
        gone = []
        for b in blocks:
            hit = {j for w in range(len(b.split()) - 4) if len(windows[(article, url[8], *b.split()[w : w + 5])]) >= 3 for j in range(w, w + 5)}
            gone.append(2 * len(hit) > len(b.split()))
        want.append((i, "\n\n".join(b for b, x in zip(blocks, gone, strict=True) if article or not x), 6, sum(gone)))
    assert sum(w[3] for w, d in zip(want, data, strict=True) if d[3]) > 9
    page = lambda blocks, article: ("<article>%s</article>" if article else "%s") % "".join(f"<p>{b}</p>" for b in blocks)
    df = spark.createDataFrame([(i, url, page(b, a)) for i, url, b, a in data], "page_id long, url string, html string")
    for n in (1, 8):
        assert sorted((r["page_id"], r["text"], r["n_blocks"], r["n_shared"]) for r in p.judge_pages(df.repartition(n)).collect()) == want


def test_equal_windows_are_told_by_the_suffix_array(monkeypatch):
    """A group of neighbours takes one code, however often its words stand there."""
    coded = []

    def noted(self, at, min_words, codes=p.Stream.codes):
        coded.append(len(at))
        return codes(self, at, min_words)

    monkeypatch.setattr(p.Stream, "codes", noted)
    streams = [["a b c d e".split(), f"{i} a b c d e".split()] for i in range(7)]
    assert p.shared_words(streams) == [[1.0, 5 / 6]] * 7
    assert coded == [8, 8]  # a b c d e, and a window for each number
