"""Small tables, and plain versions of the contracts."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0, **more):
    rows = [(start + i, t, more.get("lang", "en"), more.get("source", f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
