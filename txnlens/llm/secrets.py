"""Secret scan: fixed patterns, and ownership frequency over the whole corpus for what looks like a live credential.

One narrow scan finds, in every whole text, the base spans and further candidates (long mixed tokens outside base spans)
and hashes each candidate's value. The hashes are aggregated by distinct repository and owner: a value that few owners
have in few repositories is theirs (live-looking), one that many owners or many repositories have is a copied example. Further candidates become spans only when
they are live-looking; base spans always stay. The scan's result, which has no texts, is written once to the shared
folder under row numbers; distinct rows and counts are summed within tasks before they are shuffled, so that a value
found in a third of all rows costs one row a task.

Defined cases: a null text is empty and has no spans. Repeated rows get equal results; a repeated id is one repository.
A null owner counts as one owner. Extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts

KINDS = ("assign", "access", "hex", "owned")
#: A value that at most so many owners have is owner-specific.
MAX_OWNERS = 2
#: A value in more repositories is an example that was copied, under one owner too.
MAX_REPOSITORIES = 20
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{16,}")  # whole runs: a run's first match is all of it
_mixed = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), m[0]) for m in _access.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in _hex.finditer(text)]
    return sorted(found)


def further(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens of 20 characters or more with lower case, upper case and digits that no base span touches."""
    out = []
    for m in _mixed.finditer(text):
        v = m[0]
        if v.islower() or v.isupper() or not any(c.isdigit() for c in v) or not any(c.islower() for c in v) or not any(c.isupper() for c in v):
            continue
        if not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), 3, m.end(), v))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())])


def _scan(batches):
    for batch in parts(batches, 3):
        rows = []
        for text in batch.column(3).to_pylist():
            text = text or ""
            base = base_spans(text)
            rows.append([{"start": s, "kind": k, "end": e, "value": xxhash.xxh64_intdigest(v.encode()) - (1 << 63)} for s, k, e, v in [*base, *further(text, base)]])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(_SPAN))], names=["row", "id", "owner", "found"])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied); spans are ``kind:start:end``."""
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.col(text_col).alias("text"))
    scanned = materialize(src.mapInArrow(_scan, f"row long, id {kind}, owner string, found array<struct<start: long, kind: int, end: long, value: long>>"))
    each = scanned.filter(F.size("found") > 0).select("row", "id", "owner", F.explode("found").alias("x")).select("row", "id", "owner", "x.*")
    by_owner = each.select("value", "owner", "id").distinct().groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    # written, so that the join below shuffles both sides and a value of very many rows can be split
    owners = materialize(by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories")))
    judged = each.join(owners, "value").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("live") & (F.col("kind") == 3), F.struct("start", "kind", "end"))).alias("owned"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"),
    )
    base = F.transform(F.filter("found", lambda x: x["kind"] < 3), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda a: F.array_join(F.transform(F.sort_array(a), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return scanned.join(per_row, "row", "left").select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.when(F.col("owned").isNull(), base).otherwise(F.concat(base, "owned"))).alias("spans"), zero("n_live"), zero("n_copied"),
    )
