"""SimHash near-dedup with BK-trees.

Fingerprints within ``radius`` bits agree on all but ``radius`` of any blocks they are cut into, so each goes, with what it
agrees with, into a shard for each choice of blocks: four of one block, or, beyond a million fingerprints, twenty of three
blocks in six, so that shards stay small as the corpus grows. A shard is one BK-tree: children hang on integer Hamming distances, a query follows
only the edges within the radius. Trees of a task's shards are built and walked level by level in numpy arrays.
The trees go to the tasks that hold their queries (one shuffle): together they grow with the corpus, so they are
not broadcast. Of a shard of over ``max_shard`` fingerprints the largest of a few stars hangs on its centre; the others
are cut into parts that meet each other and all parts of the star: memory stays bounded, no link is lost, and rows grow
with the shard times the parts of what is in no star. A shard gives each fingerprint's local root, not pairs.

``one_of_each`` takes near copies by similarity instead: each text has SEEDS fingerprints of its set of shingles, shards
are blocks of 16 bits of any of them, trees find what lies within WIDE_RADIUS of 128 bits, and each link found is
confirmed by counting shared shingles (``jaccard``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jaccard
from .common import CENTRES, drop_written, meetings, sieved, small_batches, table, union, written

WORDS, RADIUS, MAX_SHARD = 3, 3, 16384
#: Fingerprints of a text's shingle set when near copies are sought by similarity; distance of two words (128 bits) up to which
#: texts are compared. At a similarity of 0.8 a bit differs with a chance of 0.15: two texts share a shard and lie within the
#: radius with a chance of 0.99; at 0.85 all but 1 in 1,600 pairs do. Texts of nothing in common lie so near once in 10 million.
SEEDS, WIDE_RADIUS = 16, 28
_CHUNK = 1 << 16
_R = np.random.default_rng(64)
_SEED, _ODD = _R.integers(0, 1 << 63, SEEDS, np.uint64), _R.integers(0, 1 << 63, SEEDS, np.uint64) * np.uint64(2) + np.uint64(1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the n rows have each bit; sums of up to 255 rows fit a byte, so they are added as bytes."""
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for k in range(0, len(hashes), 255):
        counts += np.add.reduce(np.unpackbits(hashes[k : k + 255].view(np.uint8), axis=1, bitorder="little"), 0, np.uint8)
    return counts


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of a text's word shingles, repeats included, as a signed long."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, counts, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + _CHUNK].tolist(), ends[k : k + _CHUNK].tolist(), strict=True)], np.uint64)
        counts += bit_counts(h[:, None])
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = WORDS, name: str = "fp") -> DataFrame:
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(name, fp(F.col(text)))


def distance(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows a and b of fps (n, words of 64 bits)."""
    return np.bitwise_count(fps[a] ^ fps[b]).sum(1, dtype=np.int64)


def forest(shard: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of runs of equal shard: each node's root; and the edges, keys (wide * parent + distance) sorted, with their child."""
    wide = 64 * fps.shape[1] + 1
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    root = np.repeat(first, np.diff(np.r_[first, len(shard)]))
    at, left = root.copy(), np.setdiff1d(np.arange(len(shard)), first)
    keys, kids = [], []
    while len(left):
        key = at[left] * wide + distance(fps, left, at[left])
        found, where, back = np.unique(key, return_index=True, return_inverse=True)
        keys.append(found)
        kids.append(left[where])
        at[left] = left[where][back]
        left = np.delete(left, where)
    if not keys:
        return root, np.empty(0, np.int64), np.empty(0, np.int64)
    key, kid = np.concatenate(keys), np.concatenate(kids)
    order = np.argsort(key, kind="stable")
    return root, key[order], kid[order]


def search(fps: np.ndarray, keys: np.ndarray, kids: np.ndarray, query: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) within the radius; only edges of distance d - radius to d + radius are followed."""
    wide = 64 * fps.shape[1] + 1
    q, node, found = query, root, []
    while len(q):
        d = distance(fps, q, node)
        near = (d <= radius) & (q != node)
        found.append((q[near], node[near]))
        low = np.searchsorted(keys, node * wide + np.maximum(d - radius, 0))
        n = np.searchsorted(keys, node * wide + np.minimum(d + radius, wide - 1), side="right") - low
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q, node = np.repeat(q, n), kids[np.repeat(low, n) + step]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def stars(shard: np.ndarray, fps: np.ndarray, radius: int, tries: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Of each shard (rows sorted by it) the largest of a few stars: (rows, centres), all within the radius of their centre."""
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    sizes = np.diff(np.r_[first, len(shard)])
    most, best = np.zeros(len(first), np.int64), first
    for k in range(tries):
        centre = first + sizes * k // tries
        n = np.add.reduceat((distance(fps, np.arange(len(fps)), np.repeat(centre, sizes)) <= radius).astype(np.int64), first)
        best, most = np.where(n > most, centre, best), np.maximum(most, n)
    centre = np.repeat(best, sizes)
    rows = np.flatnonzero(distance(fps, np.arange(len(fps)), centre) <= radius)
    return rows, centre[rows]


def local_roots(shard: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by shard, fps (n, words): each one's smallest index in its shard that links lead to.

    Members of a shard's largest star are linked by their centre, so the trees hold the other rows only, and all rows
    query them: a shard of near copies costs no pairs.
    """
    label = np.arange(len(fps))
    if not len(fps):
        return label
    wide = 64 * fps.shape[1] + 1
    rows, centre = stars(shard, fps, radius)
    union(label, rows, centre)
    tree = np.ones(len(fps), bool)
    tree[rows] = False
    nodes = np.flatnonzero(tree)
    if not len(nodes):
        return label
    _, keys, kids = forest(shard[nodes], fps[nodes])
    keys, kids = nodes[keys // wide] * wide + keys % wide, nodes[kids] if len(kids) else kids
    begin = np.searchsorted(shard[nodes], shard)
    there = begin < len(nodes)
    there[there] = shard[nodes[begin[there]]] == shard[there]
    query, root = np.flatnonzero(there), nodes[begin[there]]
    most = int(np.unique(shard[nodes], return_counts=True)[1].max())
    step = max(1, min(_CHUNK, (1 << 19) // most))
    for k in range(0, len(query), step):
        union(label, *search(fps, keys, kids, query[k : k + step], root[k : k + step], radius))
    return label


def _link(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, id, fingerprint's words) sorted by shard and id: yields (a, b), b the smallest id that links of these shards
    lead a to. Whole shards, and many of them, at a time: an id that they link has one row."""

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, ids = columns[:2]
        shard = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        root = local_roots(shard, np.stack(columns[2:], 1).view(np.uint64), radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        each, at = np.unique(np.concatenate((ids[moved], ids[root[moved]])), return_inverse=True)
        label = np.arange(len(each))
        union(label, at[: len(moved)], at[len(moved) :])
        moved = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(each[moved]), pa.array(each[label[moved]])], ["a", "b"])

    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(i).to_numpy() for i in range(batch.num_columns)])
        size += batch.num_rows
        if size < _CHUNK or held[-1][0][-1] == held[0][0][0]:
            continue
        held = [[np.concatenate(x) for x in zip(*held, strict=True)]]
        cut = int(np.searchsorted(held[0][0], held[0][0][-1]))
        yield out([x[:cut] for x in held[0]])
        held = [[x[cut:] for x in held[0]]]
        size -= cut
    if held:
        yield out([np.concatenate(x) for x in zip(*held, strict=True)])


def met(rows: DataFrame, radius: int, max_shard: int) -> DataFrame:
    """(a, b): ids that links within shards connect. rows: key (of a shard), id, and the fingerprint's words in further columns.

    A shard of over ``max_shard`` rows is cut: see ``divided``.
    """
    names = rows.columns[2:]
    sizes = written(rows.groupBy("key").count().where(F.col("count") > max_shard), "shards")
    star = None
    if sizes.isEmpty():
        rows = rows.withColumn("shard", F.col("key"))
    else:
        rows, star = divided(rows, sizes, radius, max_shard)
    rows = rows.select("shard", "id", *names).repartition("shard").sortWithinPartitions("shard", "id")
    found = rows.mapInArrow(lambda it: _link(it, radius), "a long, b long")
    return found if star is None else found.unionByName(star)


def divided(rows: DataFrame, sizes: DataFrame, radius: int, max_shard: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their shard, those of the large shards (``sizes``: key, count) once for each shard that they meet others in;
    and the links (a, b) of the stars, which hang on their smallest id.

    A few rows of each large shard are tried as centres of a star. Rows of the largest star are linked, so only the others need
    to meet every row.
    """
    names = rows.columns[2:]
    cut = written(rows.join(sizes.select("key"), "key"), "cut")
    tried = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("h"), "id", *names)) for i in range(CENTRES)]
    centres = written(cut.groupBy("key").agg(F.array(*tried).alias("centres")), "centres")

    def within(i: int):
        return sum((F.bit_count(F.col(w).bitwiseXOR(F.col("centres")[i][w])) for w in names), F.lit(0)) <= radius

    held, cut = cut, written(cut.join(centres, "key").select("key", "id", *names, F.array(*map(within, range(CENTRES))).alias("near")), "near")
    drop_written(rows.sparkSession, held)
    each = [F.struct(F.count_if(F.col("near")[i]).alias("n"), F.lit(i).alias("i"), F.min(F.when(F.col("near")[i], F.col("id"))).alias("least")) for i in range(CENTRES)]
    best = cut.groupBy("key").agg(F.array_max(F.array(*each)).alias("best"), F.count("*").alias("all"))
    parts = [F.ceil(n * 2 / max_shard).alias(name) for n, name in ((F.col("all") - F.col("best.n"), "others"), (F.col("best.n"), "stars"))]
    cut = cut.join(written(best.select("key", "best", *parts), "stars"), "key").withColumn("star", F.col("near")[F.col("best.i")])
    some = cut.select("id", *names, F.explode(meetings("key", "star", "others", "stars")).alias("shard"))
    whole = rows.join(sizes.select("key"), "key", "left_anti").withColumn("shard", F.col("key"))
    star = cut.where("star").select(F.col("id").alias("a"), F.col("best.least").alias("b"))
    return whole.select("id", *names, "shard").unionByName(some), star.where("a != b")


def links(fps: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD, blocks: int | None = None) -> DataFrame:
    """(a, b): fingerprints that radius-links connect; at most a row for each a and choice of blocks, unless its shard is cut.
    fps: one row for each fingerprint, column fp. Exact whatever the number of ``blocks`` (over the radius): fingerprints
    within the radius agree on all but ``radius`` of them; more of them make more and smaller shards."""
    if blocks is None:
        blocks = radius + (1 if fps.count() <= 16 << 16 else 3)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for i, agreed in enumerate(combinations(masks, blocks - radius)):
        mask = sum(agreed)
        keys.append(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return met(fps.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("id"), "fp"), radius, max_shard)


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each vertex of ``edges`` (a, b) reaches, by large and small stars, in rounds.

    An id may come with many roots, one of each task that linked it: a small star hangs them on the least before any join, so
    that the rounds start from about a row an id. Roots are smaller ids, and few of an id; a hub's rows lie with its members.
    Every round is written to the shared folder and reread; rounds grow with the logarithm of the longest chain.
    """

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return r[0], r[1]

    raw = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "raw")
    hung = raw.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    e = written(hung.select("a", F.col("m").alias("b")).unionByName(hung.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
    drop_written(e.sparkSession, raw)
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join deals out both sides, and can split a hub's rows
        near = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        new = written(small.where("a != b").distinct(), "edges")
        now = mark(new)
        drop_written(e.sparkSession, e)
        drop_written(e.sparkSession, near)
        e = new
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("root"))


def components(rows: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD, doc: str = "doc_id") -> DataFrame:
    """(fp, component_id) for each fingerprint of ``rows`` (fp and a document id): the smallest id in its component, null if all are null."""
    each = rows.groupBy("fp").agg(F.min(doc).alias("least"))
    found = connected(links(each.select("fp"), radius, max_shard))
    each = each.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.select("fp", "root").join(least, "root")


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id", words: int = WORDS, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """``docs`` plus ``fp`` (signed long) and ``component_id``; a row for each row of ``docs``.

    A null or wordless text has fingerprint zero, which links like any other; repeated rows and equal texts share
    theirs. Texts of any length are read whole; an empty table gives no rows. A null id never names a component unless all its ids are null. Clashing columns are replaced.
    """
    rows = written(with_fingerprint(docs.drop("fp", "root", "component_id"), text, words), "fingerprints")
    return rows.join(components(rows, radius, max_shard, doc), "fp").drop("root")


def wide(found: np.ndarray) -> list[int]:
    """SEEDS SimHashes of a set of shingle hashes, as signed longs; of an empty set none."""
    if not len(found):
        return []
    counts = np.zeros(64 * SEEDS, np.int64)
    for k in range(0, len(found), 4096):
        h = (found[k : k + 4096, None] ^ _SEED) * _ODD
        h ^= h >> np.uint64(31)
        h *= _ODD[::-1]
        h ^= h >> np.uint64(29)
        counts += bit_counts(h)
    return np.packbits(2 * counts > len(found), bitorder="little").view(np.int64).tolist()


def with_sets(docs: DataFrame, text: str, words: int) -> DataFrame:
    """``docs`` plus ``_set`` (hash of the text's shingle set, 0 if empty) and ``_words`` (its fingerprints)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<set:bigint,words:array<bigint>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = ((jaccard.digest(s), wide(s)) for s in (jaccard.shingles(t, words) for t in texts))
        return pd.DataFrame(rows, columns=["set", "words"])

    return docs.withColumn("_s", of(F.col(text))).withColumns({"_set": F.col("_s.set"), "_words": F.col("_s.words")}).drop("_s")


def candidates(sets: DataFrame, radius: int = WIDE_RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """(a, b): ids of shingle sets that trees link. sets: a row for each set, columns id and words."""

    def one(i: int):
        word, low = F.col("words")[i // 4], 16 * (i % 4)
        key = F.xxhash64(F.lit(i), F.shiftrightunsigned(word, low).bitwiseAND(F.lit(0xFFFF)))
        return F.struct(key.alias("key"), word.alias("w0"), F.col("words")[(i // 4 + 1) % SEEDS].alias("w1"))

    rows = sets.where(F.size("words") > 0).select("id", F.explode(F.array(*map(one, range(4 * SEEDS)))).alias("r"))
    return met(rows.select("r.key", "id", "r.w0", "r.w1"), radius, max_shard)


def one_of_each(docs: DataFrame, text: str = "text", doc: str = "doc_id", words: int = jaccard.WORDS, least: tuple[int, int] = jaccard.SIMILAR, most: int = jaccard.MOST) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies, chains included, the document with the smallest id, once.

    Near copies are texts whose sets of word shingles have a Jaccard similarity of ``least`` or more. Null and wordless
    texts are copies of each other, as are equal ones, ties going to one row. A null id stays only where all of its group
    are null. Texts of any length are compared whole; other columns pass through; an empty table stays empty.
    """
    rows = written(with_sets(docs.withColumnRenamed(doc, "_doc"), text, words), "sketches")
    sets = rows.select(F.col("_set").alias("id"), F.col("_words").alias("words")).dropDuplicates(["id"])
    near = connected(candidates(sets))
    links = jaccard.confirmed(rows.select(F.col("_set").alias("id"), F.col(text).alias("text")), near, words, least, most)
    found = connected(links).select(F.col("id").alias("_set"), F.col("root").alias("_root"))
    each = rows.groupBy("_set").agg(F.min("_doc").alias("_least"), F.count("*").alias("_n")).join(found, "_set", "left")
    each = each.withColumn("_root", F.coalesce("_root", "_set"))
    groups = each.groupBy("_root").agg(F.min("_least").alias("_first"), F.sum("_n").alias("_all")).where("_all > 1")
    each = written(each.join(groups, "_root").select("_set", "_root", "_least", "_first"), "groups")  # sets of groups of two rows or more
    # of each group one set has the least id, and of ties the smallest: only it can hold the row that stays
    kept = each.where(F.col("_least").eqNullSafe(F.col("_first"))).groupBy("_root").agg(F.min(F.struct("_set", "_first")).alias("k"))
    kept = kept.select(F.col("k._set").alias("_kept"), F.col("k._first").alias("_first"))
    some = sieved(rows, "_set", each).withColumnRenamed("_set", "_own")
    alone = some.join(each.select("_set"), F.col("_own") == F.col("_set"), "left_anti")
    first = some.join(kept, F.col("_own") == F.col("_kept")).where(F.col("_doc").eqNullSafe(F.col("_first"))).dropDuplicates(["_own"])
    names = [F.col("_doc").alias(c) if c == doc else F.col(c) for c in docs.columns]
    return alone.select(*names).unionByName(first.select(*names)).unionByName(sieved(rows, "_set", each, "left_anti").select(*names))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
