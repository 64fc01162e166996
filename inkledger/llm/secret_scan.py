"""Secret scan with corpus-wide ownership frequency.

Three base kinds (assign, access, hex) are always reported. Further kinds (key files, signed tokens, credentials in
addresses, provider tokens, dense blobs) are candidates: each candidate value is hashed, and for every hash the corpus
tells how many repositories and how many owners hold it. A value of many owners is a widely copied example; a value
of few owners that looks live (by its kind's rule; mostly long, dense, no placeholder) is a credential, and its span is
added. Owners alone decide: however often one owner repeats a value, it stays a credential.

A document is a repository; its owner is the owner column, by default the source. Counts are exact: distinct (hash, owner,
repository) first, then per (hash, owner), then per hash, each with map-side combining, so no copied example is a hot group.

Defined results: a null text is empty; a null owner is an owner of its own; rows that repeat an id are scanned each and
are one repository; a null id is one repository; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import Scratch

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidate kinds: name, pattern, the group that is the value.
ADDED = [
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----\s*([A-Za-z0-9+/=]{16,})"), 1),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), 0),
    ("url", re.compile(r"://[A-Za-z0-9._-]{1,64}:([^\s:/@]{6,128})@"), 1),
    ("provider", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{16,})"), 0),
    ("blob", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}"), 0),
]
KINDS = ["assign", "access", "hex", *(k for k, _, _ in ADDED)]
PLACEHOLDERS = re.compile(r"example|sample|changeme|placeholder|your[_-]?|dummy|test|xxxx|0000|1234|abcdef", re.I)
SALTS = 16
SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("dense", pa.bool_())])


def dense(value: str) -> bool:
    """Looks like a live credential: long, of high entropy, mixed, without placeholder words."""
    if len(value) < 16 or PLACEHOLDERS.search(value):
        return False
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return entropy >= 3.0 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def looks_live(kind: int, value: str) -> bool:
    """Each kind by its own rule: what stands as a password in an address or as a key file needs no length or mixture."""
    if KINDS[kind] == "pem":
        return len(set(value)) >= 4
    if KINDS[kind] == "url":
        return len(set(value)) >= 4 and not PLACEHOLDERS.search(value)
    return dense(value)


def disjoint(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def scan(text: str) -> tuple[list[tuple], list[tuple]]:
    """(base spans, candidate spans), each (kind, start, end, value)."""
    base, low = [], text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        base += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    more = []
    if max(map(len, text.split()), default=0) >= 20:  # every other kind needs a long word
        if "AKIA" in text:
            base += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        base += [(2, m.start(), m.end(), m[0]) for m in LONG_HEX.finditer(text)]
    taken = [(s, e) for _, s, e, _ in base]
    if "://" in text or "-----BEGIN" in text or max(map(len, text.split()), default=0) >= 20:
        for kind, (_, pattern, group) in enumerate(ADDED, 3):
            # a kind's own matches never overlap, so each is looked up among the spans of the kinds before it
            starts, ends = disjoint(taken)
            for m in pattern.finditer(text):
                at = bisect_right(ends, m.start())
                if at == len(starts) or starts[at] >= m.end():
                    more.append((kind, m.start(), m.end(), m[group]))
                    taken.append((m.start(), m.end()))
    return sorted(base, key=lambda x: (x[1], x[0])), sorted(more, key=lambda x: (x[1], x[0]))


def written(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in spans)


def find(docs: DataFrame, owner: Column) -> DataFrame:
    """One row per document: row (a number of its own), doc_id, owner, the base columns and the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in b.column(2).to_pylist():
                base, more = scan(text or "")
                joined = written(base)
                found = [(k, s, e, hashlib.sha256(v.encode("utf-8", "replace")).hexdigest()[:32], looks_live(k, v)) for k, s, e, v in base + more]
                values = [row, *(sum(x[0] == k for x in base) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined, [dict(zip(("kind", "start", "end", "hash", "dense"), x, strict=True)) for x in found]]
                for column, v in zip(out, values, strict=True):
                    column.append(v)
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(SPAN)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "owner", "row", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), "text")
    return rows.mapInArrow(run, "doc_id long, owner string, row long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, found array<struct<kind:int,start:int,end:int,hash:string,dense:boolean>>")


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, repositories, owners. candidates: hash, owner, doc_id."""
    each = candidates.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
    return each.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan_secrets(docs: DataFrame, owner_col: str = "source", many_owners: int = 3) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.write(find(docs, F.col(owner_col)), "found")
    spans = found.filter(F.size("found") > 0).select("row", "doc_id", "owner", F.explode("found").alias("x")).select("row", "doc_id", "owner", "x.*")
    # every salt meets its own copy of a hash's counts, so the rows of a widely copied value are many tasks
    owned = ownership(spans.select("hash", "owner", "doc_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = spans.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(owned, ["hash", "salt"]).withColumn("live", F.col("dense") & (F.col("owners") < many_owners))
    names = F.array(*(F.lit(k) for k in KINDS))
    shown = held.filter((F.col("kind") < 3) | F.col("live"))
    text = F.concat_ws(":", F.element_at(names, F.col("kind") + 1), F.col("start"), F.col("end"))
    by_row = held.groupBy("row").agg(F.count_if("live").alias("n_live"), F.count_if(F.col("owners") >= many_owners).alias("n_copied"))
    listed = shown.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", text.alias("t")))), lambda s: s["t"]).alias("s"))
    out = found.drop("found").join(by_row, "row", "left").join(listed, "row", "left")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(F.array_join("s", ","), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
