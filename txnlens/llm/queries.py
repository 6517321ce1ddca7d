"""The registered queries of the training-data operators, bound to the test tables by their contracts, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, langid, linedup, minhash, pages, phrases, quality, secrets, trie, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules that the contract of op7 fixes.
URL_RULES: list[urls.Rule] = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return quality.judge_quality(_table(spark, sf_dir, "documents"), labels)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2, threshold=80)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = decontam.find_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontam.judged(spans).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer() -> tuple[str, str]:
    """Ranks file and pattern that the contract of op5 names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), *tokenizer())


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.judge_pages(_table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs.filter(~langid.held_out("doc_id"))))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotes(_table(spark, sf_dir, "conversations"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_minhash": op2_minhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_html_extract": op6_html_extract,
    "op7_url_filter": op7_url_filter,
    "op8_secret_scan": op8_secret_scan,
    "op9_language": op9_language,
    "op10_chat": op10_chat,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_graph_neighbours": op12_graph_neighbours,
    "op13_collocations": op13_collocations,
}

#: The contract of op2 over the whole table: shingles, pairs by shared shingles, closure.
_OP2 = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
one AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
each AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM one),
freq AS (SELECT g, count(*) AS f FROM each GROUP BY g),
ranked AS (SELECT rep, n, each.g, row_number() OVER (PARTITION BY rep ORDER BY f, each.g) AS i FROM each JOIN freq ON each.g = freq.g),
keys AS (SELECT * FROM ranked WHERE i <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.rep AS p, b.rep AS q FROM keys a JOIN keys b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (SELECT p, q FROM pairs JOIN one a ON a.rep = p JOIN one b ON b.rep = q WHERE 180 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s))),
bothways AS (SELECT p, q FROM links UNION SELECT q, p FROM links),
reach AS (SELECT rep AS a, rep AS b FROM one UNION SELECT reach.a, bothways.q FROM reach JOIN bothways ON bothways.p = reach.b),
low AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a),
own AS (SELECT sets.doc_id, len(sets.s) AS n, coalesce(low.c, sets.doc_id) AS c FROM sets LEFT JOIN one ON one.s = list_sort(sets.s) AND len(sets.s) > 0 LEFT JOIN low ON low.rep = one.rep)
SELECT doc_id, n::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM own
"""

#: The contract of op3 over the whole tables: every window of words on either side, joined as text.
_OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.t = win.t AND dw.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op2_minhash": _OP2, "op3_decontaminate": _OP3, "op4_line_dedup": linedup.ORACLE_SQL, "op10_chat": chat.ORACLE_SQL, "op11_prefix_trie": trie.ORACLE_SQL, "op12_graph_neighbours": ann.ORACLE_SQL, "op13_collocations": phrases.ORACLE_SQL}
