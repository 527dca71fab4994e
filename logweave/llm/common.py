"""What the operators share: reading tables, cutting lineage, binding a value inside one expression."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, written  # noqa: F401

#: ASCII white space, as the contracts have it: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Keys of a broadcast sieve.
SIEVE = 1 << 20
#: Members of a large group that are tried as the centre of its largest star.
CENTRES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds what Spark hands to a Python worker at once, in bytes: rows with long texts come in smaller batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    size = int(re.match(r"-?\d+", now)[0]) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:].lower(), 1) if now else 0
    if not 0 < size <= most:
        spark.conf.set(key, str(most))


def sieved(rows: DataFrame, key: str, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose key may be among the wanted ones (a column ``key``); with ``left_anti`` those whose key surely isn't.
    The sieve holds residues of keys, at most SIEVE of them however many keys there are."""
    residues = wanted.select(F.pmod(key, F.lit(SIEVE)).alias("_residue")).distinct()
    return rows.withColumn("_residue", F.pmod(key, F.lit(SIEVE))).join(F.broadcast(residues), "_residue", how).drop("_residue")


def meetings(key: str, star: str, others: str, stars: str) -> Column:
    """Shards (hashes) that a row (``key`` of its group, ``id``) goes to, so that it meets all rows of its group, but rows of the
    ``star`` (boolean) no others of it: these lie in ``stars`` parts, the other rows in ``others``. No parts, no shards."""
    mine = F.pmod(F.xxhash64("id"), F.when(F.col(star), F.col(stars)).otherwise(F.col(others)))

    def each(n: str, use) -> Column:
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), use)).otherwise(F.array().cast("array<bigint>"))

    with_star = each(others, lambda o: F.xxhash64(F.col(key), F.lit(1), o, mine))
    alone = each(others, lambda o: F.xxhash64(F.col(key), F.lit(0), F.least(mine, o), F.greatest(mine, o)))
    return F.when(F.col(star), with_star).otherwise(F.concat(alone, each(stars, lambda o: F.xxhash64(F.col(key), F.lit(1), mine, o))))


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing will read it again."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a and b; labels are the smallest member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]
