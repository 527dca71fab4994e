"""URL filters: a sorted array of 64-bit xxhash digests, memory-mapped, probed by binary search.

An index is three files: ``keys`` (uint64, sorted), ``ends`` (where each entry's text ends) and ``texts`` (UTF-8, in
the order of the keys). A probe is one vectorised search over all urls of a batch; a hit counts only if the stored
text is the probed one, so digest collisions decide nothing. The files go to the executors by SparkContext.addFile.
A blocklist may be a DataFrame of any size: beyond what each executor may hold, distinct hosts are joined with it instead.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

#: Rules: verdict, host and path prefix. Fixed values.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Blocked domains, in each of the zones. Fixed values.
BLOCKED = tuple(f"{name}.example.{zone}" for name in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x") for zone in ("com", "net", "org"))
#: Entries up to which there is an index: it's built on the driver and copied to each executor. Longer lists are joined.
MAX_ENTRIES = 5_000_000


class Index:
    """A sorted digest array over memory-mapped files."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, texts: np.ndarray):
        self.keys, self.ends, self.texts = keys, ends, texts

    @staticmethod
    def files(entries: Iterable[str]) -> dict[str, bytes]:
        import xxhash

        found = sorted((xxhash.xxh64_intdigest(b), b) for b in {e.encode() for e in entries})

        def npy(x: np.ndarray) -> bytes:
            np.save(out := io.BytesIO(), x)
            return out.getvalue()

        ends = np.cumsum([len(b) for _, b in found], dtype=np.int64) if found else np.empty(0, np.int64)
        return {"keys": npy(np.array([h for h, _ in found], np.uint64)), "ends": npy(ends), "texts": b"".join(b for _, b in found) or b"\0"}

    @classmethod
    def open(cls, stem: str) -> Index:
        return cls(np.load(f"{stem}.keys", mmap_mode="r"), np.load(f"{stem}.ends", mmap_mode="r"), np.memmap(f"{stem}.texts", np.uint8, "r"))

    def has(self, probes: list[str]) -> np.ndarray:
        """Which probes are entries."""
        import xxhash

        raw = [p.encode("utf-8", "surrogatepass") for p in probes]
        h = np.array([xxhash.xxh64_intdigest(b) for b in raw], np.uint64)
        at = np.searchsorted(self.keys, h)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == h[hit]
        for i in np.flatnonzero(hit):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == h[i]:  # entries of one digest stand side by side
                if self.texts[self.ends[k - 1] if k else 0 : self.ends[k]].tobytes() == raw[i]:
                    break
                k += 1
            else:
                hit[i] = False
        return hit


def publish(spark: SparkSession, entries: Iterable[str]) -> str:
    """Writes an index to the shared folder and has every executor fetch it; its name for ``Index.open``."""
    name = f"urls-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for kind, data in Index.files(entries).items():
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}.{kind}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(data)
        out.close()
        spark.sparkContext.addFile(path.toString())
    return name


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def suffixes(name: str) -> list[str]:
    """The host and its parent domains."""
    parts = name.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))]


def judge(hosts: list[str], paths: list[str], rules: Index, verdicts: dict[str, str], lengths: list[int], blocked: Index) -> list[tuple]:
    """(rule, verdict) for each url; of the rules that fit, the longest wins, of equally long ones that of the longer host."""
    probes, of = [], []
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        for s in suffixes(h):
            for n in lengths:
                if len(p) >= n:
                    probes.append(s + p[:n])
                    of.append((i, len(s) + n, len(s)))
    best: dict[int, tuple] = {}
    for k in np.flatnonzero(rules.has(probes)) if probes else []:
        i, *rank = of[k]
        best[i] = max(best.get(i, ([-1, -1], "")), (rank, probes[k]))
    probes, of = [], []
    for i, h in enumerate(hosts):
        if i not in best:
            found = suffixes(h)
            probes += found
            of += [i] * len(found)
    bad = {of[k] for k in np.flatnonzero(blocked.has(probes))} if probes else set()
    return [(best[i][1], verdicts[best[i][1]]) if i in best else (None, "block" if i in bad else "allow") for i in range(len(hosts))]


def blocked_hosts(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """The different hosts (column _host) of which the host itself or a parent domain is listed (column entry)."""
    parts = F.split("_host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = hosts.select("_host").distinct().select("_host", F.explode(parents).alias("entry"))
    return each.join(listed.select("entry").distinct(), "entry", "left_semi").select("_host").distinct()


def judged(pages: DataFrame, url: str = "url", rules=RULES, blocked: Iterable[str] | DataFrame = BLOCKED, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``pages`` plus host, path, rule and verdict. No rule: blocked if the host or a parent domain is in ``blocked``, names or a
    DataFrame whose first column has them; the same whether it's over ``max_entries`` or not.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Of rules that fit the
    longest wins, of equally long ones that of the longer host. Rows are judged one by one, repeated ones alike, urls of any
    length whole; an empty table gives no rows; clashing columns are replaced.
    """
    spark = pages.sparkSession
    texts = {h + p: v for v, h, p in rules}
    lengths = sorted({len(p) for _, _, p in rules})
    joined = None
    if isinstance(blocked, DataFrame):
        names = blocked.select(F.col(blocked.columns[0]).alias("entry")).where("entry is not null")
        if names.count() > max_entries:
            blocked, joined = (), names
        else:
            blocked = [r["entry"] for r in names.collect()]  # at most max_entries
    listed, domains = publish(spark, texts), publish(spark, blocked)

    @F.pandas_udf("rule string, verdict string")
    def verdict(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        opened = Index.open(SparkFiles.get(listed)), Index.open(SparkFiles.get(domains))
        return pd.DataFrame(judge(list(hosts), list(paths), opened[0], texts, lengths, opened[1]), columns=["rule", "verdict"])

    out = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    out = out.withColumn("_v", verdict("host", "path"))
    out = out.withColumns({"rule": F.col("_v.rule"), "verdict": F.col("_v.verdict")}).drop("_v")
    if joined is None:
        return out
    packed = out.select(F.struct("*").alias("_row"))  # no column of theirs can clash
    bad = blocked_hosts(packed.select(F.col("_row.host").alias("_host")), joined)
    packed = packed.join(bad, F.col("_row.host") == F.col("_host"), "left")
    worse = F.when(F.col("_row.rule").isNull() & F.col("_host").isNotNull(), "block").otherwise(F.col("_row.verdict"))
    return packed.select(*[worse.alias(c) if c == "verdict" else F.col("_row").getField(c).alias(c) for c in out.columns])


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1])))
    cases = "\n".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{json.dumps([h + p, v])}'" for v, h, p in order)
    bad = " or ".join(f"host = '{d}' or ends_with(host, '.{d}')" for d in BLOCKED)
    return f"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
r as (select *, case {cases} end as r from u)
select page_id, host, path, json_extract_string(r, '$[0]') as rule,
  coalesce(json_extract_string(r, '$[1]'), case when {bad} then 'block' else 'allow' end) as verdict from r
"""


ORACLE = _sql()
