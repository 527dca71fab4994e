"""Exact Jaccard similarity of word shingles, for texts that SimHash found near each other.

Each different shingle set's text goes once to the task of its cluster, where shared shingles are counted: no pair becomes
a row, and only links of the wanted similarity stay. Of a cluster beyond ``most`` texts or BYTES of text the largest of a few
stars is found first; the texts in no star are cut into parts that meet each other and all parts of the star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CENTRES, meetings, sieved, union, written

#: Similarity of near copies, as a fraction; words in a shingle.
SIMILAR, WORDS = (4, 5), 5
#: Texts and characters of a cluster that a task compares at once.
MOST, BYTES = 2048, 4 << 20


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's different word shingles, sorted; of a shorter text, of all its words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + words]), 42) for i in range(max(1, len(found) - words + 1))), np.uint64))


def digest(found: np.ndarray) -> int:
    """The set's hash as a signed long, zero if it is empty."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64)) if len(found) else 0


def similar(sets: list[np.ndarray], least: tuple[int, int] = SIMILAR, tries: int = 8) -> np.ndarray:
    """Each set's smallest index that links lead to, empty sets being like none.

    A few sets are compared with all first; what the largest star of them holds is linked by its centre, so only the
    other sets are compared with all.
    """
    label, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    if len(sets) < 2 or not sizes.any():
        return label
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]

    def near(q: int) -> np.ndarray:
        low, n = np.searchsorted(hashes, sets[q]), np.searchsorted(hashes, sets[q], side="right")
        n = n - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(owner[at], minlength=len(sets))
        return np.flatnonzero((both * least[1] >= (sizes + sizes[q] - both) * least[0]) & (both > 0))

    free, star, asked = np.ones(len(sets), bool), np.empty(0, np.int64), []
    for _ in range(tries):
        left = np.flatnonzero(free)
        if not len(left):
            break
        asked.append(int(left[0]))
        found = near(asked[-1])
        union(label, np.full(len(found), asked[-1]), found)
        free[asked[-1]] = False
        free[found] = False
        star = found if len(found) > len(star) else star
    ask = np.ones(len(sets), bool)
    ask[star] = False
    ask[asked] = False
    for q in np.flatnonzero(ask).tolist():
        found = near(q)
        union(label, np.full(len(found), q), found)
    return label


def _confirm(batches: Iterator[pa.RecordBatch], words: int, least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, id, text) sorted by shard: yields (a, b), b the root of a in the shard. Whole shards at a time."""
    shard, ids, sets = None, [], []

    def out() -> pa.RecordBatch:
        label = similar(sets, least)
        moved = np.flatnonzero(label != np.arange(len(label)))
        mine = np.array(ids, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(mine[moved]), pa.array(mine[label[moved]])], ["a", "b"])

    for batch in batches:
        for key, id_, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key != shard:
                if ids:
                    yield out()
                shard, ids, sets = key, [], []
            ids.append(id_)
            sets.append(shingles(text, words))
    if ids:
        yield out()


def confirmed(texts: DataFrame, near: DataFrame, words: int = WORDS, least: tuple[int, int] = SIMILAR, most: int = MOST) -> DataFrame:
    """(a, b): ids that links of the wanted similarity connect. texts (id, text): equal ids have equal sets; near (id, root): clusters."""
    cluster = near.unionByName(near.select(F.col("root").alias("id"), "root")).distinct().select("id", F.col("root").alias("cluster"))
    cluster = written(cluster, "near")
    texts = written(sieved(texts, "id", cluster).join(cluster, "id").dropDuplicates(["id"]), "clusters")
    sizes = texts.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))
    cut = written(sizes.where((F.col("n") > most) | (F.col("size") > BYTES)), "cut")
    star = None
    if cut.isEmpty():
        rows = texts.select(F.col("cluster").alias("shard"), "id", "text")
    else:
        rows, star = divided(texts, cut, words, least, most)
    rows = rows.repartition("shard").sortWithinPartitions("shard")
    found = rows.mapInArrow(lambda it: _confirm(it, words, least), "a long, b long")
    return found if star is None else found.unionByName(star)


def _stars(batches: Iterator[pa.RecordBatch], words: int, least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, own, cluster, id, text) sorted by shard and own, centres first: yields (cluster, id, centre, size) where the
    text is like the centre."""
    shard, centres = None, []
    for batch in batches:
        found = []
        for key, own, cluster, id_, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if key != shard:
                shard, centres = key, []
            mine = shingles(text, words)
            if not own:
                centres.append((id_, mine))
                continue
            for centre, its in centres:
                both = len(np.intersect1d(mine, its, assume_unique=True))
                if both and both * least[1] >= (len(mine) + len(its) - both) * least[0]:
                    found.append((cluster, id_, centre, len(text)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else [()] * 4)], ["cluster", "id", "centre", "size"])


def divided(texts: DataFrame, cut: DataFrame, words: int, least: tuple[int, int], most: int) -> tuple[DataFrame, DataFrame]:
    """``texts`` (cluster, id, text) as rows (shard, id, text), those of the large clusters (``cut``: cluster, n, size) once for each
    shard that they meet others in; and the links (a, b) of the stars, which hang on their smallest id.

    A few texts of each large cluster are tried as centres of a star: they go to all parts of it, the others to one. Texts of the
    largest star are linked, so only the others need to meet every text.
    """

    def parts(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / most, size / BYTES) * 2)  # two parts meet in a task

    large = texts.join(cut.withColumn("parts", parts(F.col("n"), F.col("size"))).select("cluster", "parts"), "cluster")
    tried = F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(i))) for i in range(CENTRES)]))
    tried = written(large.groupBy("cluster").agg(tried.alias("ids")).select(F.explode("ids").alias("id")), "centres")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    centres = large.join(tried, "id").withColumn("part", part).withColumn("own", F.lit(0))
    rows = large.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("own", F.lit(1)).unionByName(centres)
    rows = rows.select(F.xxhash64("cluster", "part").alias("shard"), "own", "cluster", "id", "text").repartition("shard").sortWithinPartitions("shard", "own")
    near = written(rows.mapInArrow(lambda it: _stars(it, words, least), "cluster long, id long, centre long, size long"), "stars")
    best = near.groupBy("cluster", "centre").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("id").alias("least"))
    best = best.groupBy("cluster").agg(F.max(F.struct("n", "centre", "size", "least")).alias("best"))
    others = parts(F.col("n") - F.col("best.n"), F.col("size") - F.col("best.size"))
    best = written(cut.join(best, "cluster").select("cluster", "best.centre", "best.least", others.alias("others"), parts(F.col("best.n"), F.col("best.size")).alias("stars")), "best")
    star = written(near.join(best, ["cluster", "centre"]).select("id", "least"), "star")
    rows = texts.join(best.select("cluster", "others", "stars"), "cluster").join(star.select("id", F.lit(True).alias("star")), "id", "left")
    rows = rows.withColumn("star", F.coalesce("star", F.lit(False))).select(F.explode(meetings("cluster", "star", "others", "stars")).alias("shard"), "id", "text")
    whole = texts.join(cut.select("cluster"), "cluster", "left_anti").select(F.col("cluster").alias("shard"), "id", "text")
    return whole.unionByName(rows), star.where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b"))
