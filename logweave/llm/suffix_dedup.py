"""Suffix-array dedup: removes bytes covered by a string of ``length`` bytes that also starts anywhere else.

Suffixes that share their first ``length`` bytes share the least hash among the k-grams of those bytes, and its place in
them: their anchor. So the suffixes of the corpus fall into buckets by anchor, and no equal two are parted. What lies
around an anchor, a segment, stands for all suffixes that have it.

1. Each document gives its segments: anchor hash, extent, hash of the segment's bytes. No text moves.
2. Anchors that occur once are done. A segment that occurs twice, byte for byte, is repeated throughout.
3. Of anchors with different segments, one copy of each segment is fetched, and its bucket's suffixes are sorted
   by their first ``length`` bytes, a bounded block of buckets at a time. Ranks of the suffixes at the places of a
   difference cover are worked out beforehand; a long tie is settled by the ranks at the next covered places, and at
   most one period's bytes are compared before and after. Neighbours that agree are repeated.
4. The stretches found go to their documents, whose bytes are cut.

An anchor with more different segments than a block holds gives no bucket: each of its suffixes is named by a hash of its
``length`` bytes and counted with others at its place, so no task holds a hot anchor. Texts move only where a segment of
theirs is wanted: a sieve of a fixed number of residues, which is broadcast, tells most of the others at the scan.

Passages, runs of over 50 words that another document has too, can be shorter than ``length``. So a first pass is made with
strings of PASSAGE bytes; strings of ``length`` bytes that repeat lie within its runs, and the second pass reads those only.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sieved, small_batches, table, written

LENGTH, GRAM, PERIOD = 400, 32, 32
#: Bytes of a string that makes a passage if it repeats, and words that a passage has more than.
PASSAGE, PASSAGE_WORDS = 256, 50
#: Bytes that a worker handles at once: of documents, and of segments in buckets.
PIECE, BLOCK = 1 << 20, 1 << 20
_M = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BYTE = np.random.default_rng(400).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


def difference_cover(period: int) -> np.ndarray:
    """Residues that have any two places, shifted alike by less than the period, both among them: greedily, least first."""
    cover, seen = [0, 1], {0, 1, period - 1}
    while len(seen) < period:
        gain = lambda c: len({(c - x) % period for x in cover} | {(x - c) % period for x in cover} | seen)
        best = max((c for c in range(period) if c not in cover), key=gain)
        seen |= {(best - x) % period for x in cover} | {(x - best) % period for x in cover}
        cover.append(best)
    return np.array(sorted(cover))


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: first and last start, anchor's place, its hash. ``ends``: where each text ends."""
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    if len(data) < length:
        return none
    h, size, k = _BYTE[data], 1, 0
    while size < gram:
        h = h[:-size] * _M[k % len(_M)] + h[size:]
        size, k = 2 * size, k + 1
    h = (h ^ (h >> np.uint64(29))) * _M[-1]
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, size = length - gram + 1, 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    starts = np.concatenate(([0], ends[:-1]))
    ok = np.zeros(len(low) + 1, np.int32)
    full = ends - starts >= length
    np.add.at(ok, starts[full], 1)
    np.add.at(ok, ends[full] - length + 1, -1)
    place = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    if not len(place):
        return none
    at = (low[place] & _PLACE).astype(np.int64)
    new = np.flatnonzero((np.diff(at) != 0) | (np.diff(place) != 1)) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new, [len(place)])) - 1
    return place[first], place[last], at[first], h[at[first]]


def _pieces(raw: list[bytes], length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """Texts in pieces of bounded size, those of a long text overlapping by length - 1: bytes, ends, and each part's text and offset."""
    parts, ends, size, owner, offset = [], [], 0, [], []
    for i, b in enumerate(raw):
        if len(b) < length:
            continue
        for at in range(0, len(b) - length + 1, most):
            part = b[at : at + most + length - 1]
            if size and size + len(part) > most + length:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends), owner, offset
                parts, ends, size, owner, offset = [], [], 0, [], []
            parts.append(part)
            size += len(part)
            ends.append(size)
            owner.append(i)
            offset.append(at)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends), owner, offset


def whole(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text) and parts: of each text one, from place 0. A null text has none."""
    parts = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes")))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), parts.alias("parts"))


def segments(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Of docs (doc_id, th, parts): doc_id, th, s (first start), n (starts), a (anchor less s), h (anchor's hash), g (segment's hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names, digest = ["doc_id", "th", "s", "n", "a", "h", "g"], xxhash.xxh3_64_intdigest
        for batch in batches:
            ids, th = batch.column(0), batch.column(1)
            for k in range(0, batch.num_rows, 512):
                parts = [(k + i, p["at"], p["bytes"]) for i, ps in enumerate(batch.column(2).slice(k, 512).to_pylist()) for p in ps or ()]
                row, base = np.array([r for r, _, _ in parts], np.int64), np.array([at for _, at, _ in parts], np.int64)
                for data, ends, owner, offset in _pieces([b for _, _, b in parts], length, PIECE):
                    first, last, at, h = anchors(data, ends, length, gram)
                    part = np.searchsorted(ends, first, side="right")
                    joined = data.tobytes()
                    g = np.array([digest(joined[s : e + length], a - s) for s, e, a in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)], np.uint64)
                    owned = np.array(owner)[part]
                    begin = np.concatenate(([0], ends[:-1]))[part] - np.array(offset)[part] - base[owned]
                    rows = pa.array(row[owned])
                    yield pa.RecordBatch.from_arrays([ids.take(rows), th.take(rows), pa.array(first - begin), pa.array((last - first + 1).astype(np.int32)), pa.array((at - first).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], names)

    return docs.select("doc_id", "th", "parts").mapInArrow(run, "doc_id long, th long, s long, n int, a int, h long, g long")


def suffix_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the ``length`` bytes from each place."""
    h, size, k = _BYTE[data], 1, 0
    out, at = None, 0
    while size <= length:
        if length & size:
            piece = h[at : at + len(data) - length + 1]
            out = piece * _M[(k + 3) % len(_M)] if out is None else (out ^ (out >> np.uint64(31))) * _M[(k + 1) % len(_M)] + piece
            at += size
        if 2 * size > length:
            break
        h = (h[:-size] ^ (h[:-size] >> np.uint64(32))) * _M[k % len(_M)] + h[size:]
        size, k = 2 * size, k + 1
    return out ^ (out >> np.uint64(29))


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows, by the first column first."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated(bucket: np.ndarray, begins: np.ndarray, counts: np.ndarray, texts: list[bytes], docs: np.ndarray, length: int = LENGTH, period: int = PERIOD) -> tuple[tuple, tuple]:
    """Sorts the suffixes of a block of buckets; those equal to another of their bucket in ``length`` bytes.

    Segment i is of ``bucket[i]`` and ``docs[i]``, holds ``counts[i]`` suffixes, the first at ``begins[i]`` from the anchor, and
    has the bytes of all. Gives (segment, first, last): stretches of repeated suffixes, as places from the anchor; and the
    same of those that are equal to one of another document.
    """
    cover = difference_cover(period)
    gap = np.array([min((c - r) % period for c in cover) for r in range(period)])  # to the next covered place
    widest = int(gap.max())
    # a segment lies so that a place's residue is that of its distance from the anchor: suffixes that tie share it
    sizes = np.array([len(t) for t in texts])
    lead = begins % period
    room = lead + sizes + 2 * period
    room += -room % period
    at = np.concatenate(([0], np.cumsum(room)[:-1])) + lead
    data = np.zeros(int(room.sum()) + period, np.uint8)
    for a, t in zip(at.tolist(), texts, strict=True):
        data[a : a + len(t)] = np.frombuffer(t, np.uint8)

    def words(p: np.ndarray, n: int) -> np.ndarray:
        """The n bytes (a multiple of 8) from each place, as big-endian numbers, which sort as the bytes do."""
        return data[p[:, None] + np.arange(n)].view(">u8").astype(np.uint64)

    # ranks at covered places, by 'period' bytes, then by doubling; the depth is what every suffix has behind its first covered place
    depth = (length - widest) // period * period
    covered = np.zeros(len(data) // period * period, bool)
    covered.reshape(-1, period)[:, cover] = True
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + sizes, -1)
    sample = np.flatnonzero(covered & (np.cumsum(inside)[: len(covered)] > 0))
    index = np.full(len(data) + length, len(sample), np.int64)
    index[sample] = np.arange(len(sample))
    rank = np.append(_ranks(list(words(sample, period).T)), -1)
    reach = period
    while reach < depth:
        step = min(reach, depth - reach)
        rank = np.append(_ranks([rank[:-1], rank[index[sample + step]]]), -1)
        reach += step

    segment = np.repeat(np.arange(len(texts)), counts)
    d = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[segment]
    place = at[segment] + d - begins[segment]
    residue = d % period
    first = place + gap[residue]
    end = place + length
    back = np.array([min((r - c) % period for c in cover) for r in range(period)])  # from the last covered place
    second = end - depth
    second = second - back[(residue + length - depth) % period]
    second = np.maximum(second, first)

    def some(p: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """n < period bytes from p, other bytes zero."""
        size = -(-int(n.max(initial=1)) // 8) * 8 or 8
        found = data[p[:, None] + np.arange(size)]
        found[np.arange(size) >= n[:, None]] = 0
        return list(found.view(">u8").astype(np.uint64).T)

    order = np.lexsort((d, bucket[segment]))
    group = np.zeros(len(order), bool)
    group[1:] = (bucket[segment][order][1:] != bucket[segment][order][:-1]) | (d[order][1:] != d[order][:-1])
    alone = np.bincount(np.cumsum(group))
    many = order[(alone[np.cumsum(group)] > 1)]  # suffixes that have others at their place from the anchor
    flagged, crossed = np.zeros(len(segment), bool), np.zeros(len(segment), bool)
    if len(many):
        s, p = segment[many], place[many]
        tail = second[many] + depth
        keys = [bucket[s], d[many], *some(p, first[many] - p), rank[index[first[many]]], rank[index[second[many]]], *some(tail, end[many] - tail)]
        sort = np.lexsort(keys[::-1])
        new = np.zeros(len(sort), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[sort][1:] != k[sort][:-1]
        begin, which = np.flatnonzero(new), np.cumsum(new) - 1
        of = docs[s[sort]]
        flagged[many[sort]] = np.bincount(which)[which] > 1
        crossed[many[sort]] = (np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin))[which]

    def runs(flags: np.ndarray) -> tuple:
        hit = np.flatnonzero(flags)
        if not len(hit):
            return (np.empty(0, np.int64),) * 3
        new = np.flatnonzero((np.diff(hit) != 1) | (np.diff(segment[hit]) != 0)) + 1
        a, b = hit[np.concatenate(([0], new))], hit[np.concatenate((new, [len(hit)])) - 1]
        return segment[a], d[a], d[b]

    return runs(flagged), runs(crossed)


def _sorted_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, doc_id, th, anchor, ng, across, begin, bytes) sorted by bucket; yields stretches (doc_id, th, begin, end, across)
    of segments that occur once."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        texts = rows["bytes"].to_pylist()
        begins = rows["begin"].to_numpy().astype(np.int64)
        counts = np.array([len(t) for t in texts]) - length + 1
        # a document's number; a segment that several documents have is another's, whoever's it is
        docs = rows["doc_id"].fill_null(-1).to_numpy() * np.int64(0x5851F42D4C957F2D) + rows["th"].to_numpy()
        docs = np.unique(docs, return_inverse=True)[1]
        docs = np.where(rows["across"].to_numpy(), -1 - np.arange(len(docs)), docs)
        found = repeated(rows["bucket"].to_numpy(), begins, counts, texts, docs, length)
        segment, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        across = np.arange(len(segment)) >= len(found[0][0])
        once = rows["ng"].to_numpy()[segment] == 1
        segment, a, b, across = segment[once], a[once], b[once], across[once]
        anchor = rows["anchor"].to_numpy()[segment]
        ids = [rows[c].combine_chunks().take(pa.array(segment)) for c in ("doc_id", "th")]
        return pa.RecordBatch.from_arrays([*ids, pa.array(anchor + a), pa.array(anchor + b + length), pa.array(across)], ["doc_id", "th", "begin", "end", "across"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            held.append(batch.slice(k, 1024))
            size += held[-1].nbytes
            if size < BLOCK:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows["bucket"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield out(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield out(pa.Table.from_batches(held))


def _fetched(docs: DataFrame, want: DataFrame, emit, schema: str) -> DataFrame:
    """docs' bytes at the wanted segments: of each, ``emit(segment, first start from the anchor, a part's bytes, first start in them)``
    gives rows, to which doc_id and th are put."""
    want = written(want.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "ng", "across", "s", "n", "a")).alias("want")), "want")
    rows = sieved(docs, "th", want)
    rows = rows.join(want, rows["doc_id"].eqNullSafe(want["doc_id"]) & (rows["th"] == want["th"])).select(rows["doc_id"], rows["th"], "parts", "want")
    names = [field.split()[0] for field in schema.split(", ")]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, th, parts, segs in zip(*(batch.column(i) for i in range(4)), strict=True):
                doc, th, parts = doc.as_py(), th.as_py(), parts.as_py()
                at = [p["at"] for p in parts]
                for x in segs.as_py():
                    k = bisect_right(at, x["s"]) - 1
                    s = x["s"] - at[k]
                    for row in emit(x, -x["a"], parts[k]["bytes"], s):
                        out.append((doc, th, *row))
                        size += 64 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
                if size > PIECE:
                    yield _batch(out, names)
                    out, size = [], 0
            if out:
                yield _batch(out, names)

    return rows.mapInArrow(fetch, schema)


_TYPES = {"across": pa.bool_(), "doc_id": pa.int64(), "th": pa.int64(), "h": pa.int64(), "ng": pa.int64(), "anchor": pa.int64(), "begin": pa.int32(), "bytes": pa.binary(), "sh": pa.int64()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names)


def stretches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Repeated bytes of docs (doc_id, th, parts): (doc_id, th, begin, end, across), which may overlap and touch. Those that another
    document has come with ``across`` as well; a stretch is repeated whether it has that or not."""
    small_batches(docs.sparkSession)
    all_ = written(segments(docs, length, gram), "segments")
    doc = F.xxhash64("doc_id", "th")
    across = (F.min(doc) != F.max(doc)).alias("across")
    shared = all_.groupBy("h").agg(F.count("*").alias("nh"), (F.min("g") != F.max("g")).alias("mixed"), across).where("nh > 1")
    shared = written(shared.select("h", "mixed", "across"), "anchors")  # so that the join deals out both sides, and can split a hot anchor's rows
    seg = written(all_.join(shared, "h"), "shared")
    extent = F.col("s").alias("begin"), (F.col("s") + F.col("n") - 1 + length).alias("end")
    full = seg.where("not mixed").select("doc_id", "th", *extent, "across")
    mixed = seg.where("mixed").drop("mixed", "across")
    one = written(mixed.groupBy("h", "g").agg(F.count("*").alias("ng"), across, F.min(F.struct("doc_id", "th", "s", "n", "a")).alias("rep")), "distinct")
    # what occurs twice is all but what occurs once: told by the segment's own place, so that no copied segment's rows meet in one task
    once = one.where("ng = 1").select(F.col("rep.doc_id").alias("_doc"), F.col("rep.th").alias("_th"), F.col("rep.s").alias("_s"))
    its = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))
    place = its & (F.col("s") == F.col("_s"))
    # and so is what one document alone has twice
    own = one.where("ng > 1 and not across").select(F.col("rep.doc_id").alias("_doc"), F.col("rep.th").alias("_th"), F.col("h").alias("_h"), F.col("g").alias("_g"))
    copies = mixed.join(once, place, "left_anti").join(own, its & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")), "left")
    copies = copies.select("doc_id", "th", *extent, F.col("_h").isNull().alias("across"))
    hot = written(one.groupBy("h").agg(F.count("*").alias("segments")).where(F.col("segments") * (1.5 * length) > block).select("h"), "hot")

    def bucket(x: dict, low: int, raw: bytes, s: int) -> Iterator[tuple]:
        yield x["h"], x["ng"], x["across"], x["s"] + x["a"], low, raw[s : s + x["n"] + length - 1]

    cold = one.join(hot, "h", "left_anti").select("h", "ng", "across", "rep.*")
    rows = _fetched(docs, cold, bucket, "doc_id long, th long, h long, ng long, across boolean, anchor long, begin int, bytes binary")
    rows = rows.select(F.col("h").alias("bucket"), "doc_id", "th", "anchor", "ng", "across", "begin", "bytes").repartition("bucket").sortWithinPartitions("bucket")
    found = full.unionByName(copies).unionByName(rows.mapInArrow(lambda it: _sorted_buckets(it, length), "doc_id long, th long, begin long, end long, across boolean"))
    if hot.isEmpty():
        return found

    def names(x: dict, low: int, raw: bytes, s: int) -> Iterator[tuple]:
        hashes = suffix_hashes(np.frombuffer(raw[s : s + x["n"] + length - 1], np.uint8), length).view(np.int64)
        for d, sh in enumerate(hashes.tolist()):
            yield x["h"], x["ng"], x["across"], x["s"] + x["a"], low + d, sh

    each = _fetched(docs, one.join(hot, "h").select("h", "ng", "across", "rep.*"), names, "doc_id long, th long, h long, ng long, across boolean, anchor long, begin int, sh long")
    each = written(each, "suffixes")
    named = each.groupBy("h", "begin", "sh").agg(F.count("*").alias("c"), (F.max("across") | (F.min(doc) != F.max(doc))).alias("across"), F.min(F.struct("doc_id", "th", "anchor")).alias("rep"))
    named = written(named.where("c = 1 or not across"), "named")
    lone = named.where("c = 1").select(F.col("rep.doc_id").alias("_doc"), F.col("rep.th").alias("_th"), (F.col("rep.anchor") + F.col("begin")).alias("_s"))
    own = named.where("c > 1").select(F.col("rep.doc_id").alias("_doc"), F.col("rep.th").alias("_th"), F.col("h").alias("_h"), F.col("begin").alias("_b"), F.col("sh").alias("_sh"))
    each = each.where("ng = 1").drop("across").withColumn("s", F.col("anchor") + F.col("begin"))
    same = each.join(lone, place, "left_anti").join(own, its & (F.col("h") == F.col("_h")) & (F.col("begin") == F.col("_b")) & (F.col("sh") == F.col("_sh")), "left")
    same = same.select("doc_id", "th", F.col("s").alias("begin"), (F.col("s") + length).alias("end"), F.col("_h").isNull().alias("across"))
    return found.unionByName(same)


def merged(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The stretches' union, as maximal runs in order."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(begins[1:] > ends[:-1]) + 1
    return list(zip(begins[np.concatenate(([0], new))].tolist(), ends[np.concatenate((new, [len(ends)])) - 1].tolist(), strict=True))


_SPANS = "array<struct<begin:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _spans(found: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """docs (doc_id, th and others) that have stretches, with arrays of where these begin and end and whether another document has them."""
    by = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("begin", "end", "across")).alias("_s"))
    by = written(by.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.col("_s.begin").alias("_a"), F.col("_s.end").alias("_b"), F.col("_s.across").alias("_x")), name)
    return sieved(docs, "th", by.withColumnRenamed("_th", "th")).join(by, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))).drop("_doc", "_th")


def _runs(docs: DataFrame, found: DataFrame, length: int, words: int) -> DataFrame:
    """Of the documents with stretches: doc_id, th, passages (runs of over ``words`` words), parts (runs of ``length`` bytes or more)."""

    @F.arrow_udf(f"struct<passages:{_SPANS},parts:array<struct<at:bigint,bytes:binary>>>")
    def cut(parts: pa.Array, begins: pa.Array, ends: pa.Array, across: pa.Array) -> pa.Array:
        passages, long = [], []
        for ps, a, b, x in zip(parts, begins, ends, across, strict=True):
            raw, a, b, x = ps.as_py()[0]["bytes"], a.values.to_numpy(), b.values.to_numpy(), x.values.to_numpy(zero_copy_only=False)
            shared = merged(a[x], b[x]) if x.any() else []
            passages.append([{"begin": i, "end": j} for i, j in shared if len(raw[i:j].split()) > words])
            long.append([{"at": i, "bytes": raw[i:j]} for i, j in merged(a, b) if j - i >= length])
        kind = pa.list_(pa.struct([("at", pa.int64()), ("bytes", pa.binary())]))
        return pa.StructArray.from_arrays([pa.array(passages, _SPAN), pa.array(long, kind)], ["passages", "parts"])

    rows = _spans(found, docs, "spans").withColumn("_c", cut("parts", "_a", "_b", "_x"))
    return rows.select("doc_id", "th", "_c.passages", "_c.parts")


def deduplicated(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` plus n_bytes, ``removed`` (array of begin and end, in bytes: maximal runs, in order), ``kept`` (the bytes left) and
    ``passages`` (array of begin and end: runs of over ``words`` words made of strings of ``passage`` bytes that another
    document has too, which need not be removed).

    A null text counts as empty; texts of under ``length`` bytes lose nothing. Texts of any length are judged whole and as
    they came in. Repeated rows are each other's copies. Columns of those names, or th, are replaced.
    """

    @F.arrow_udf(f"struct<removed:{_SPANS},kept:binary>")
    def cut(texts: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
        removed, kept = [], []
        for t, a, b in zip(texts, begins, ends, strict=True):
            raw, at, left = t.as_py(), 0, []
            runs = merged(a.values.to_numpy(), b.values.to_numpy()) if a.is_valid else []
            for x, y in runs:
                left.append(raw[at:x])
                at = y
            removed.append([{"begin": x, "end": y} for x, y in runs])
            kept.append(b"".join([*left, raw[at:]]))
        return pa.StructArray.from_arrays([pa.array(removed, _SPAN), pa.array(kept, pa.binary())], ["removed", "kept"])

    rows = docs.drop("th", "n_bytes", "removed", "kept", "passages").withColumn("th", F.xxhash64(text))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = whole(rows, text)
    runs = written(_runs(base, stretches(base, min(passage, length), gram), length, words), "runs")
    found = stretches(runs.where(F.size("parts") > 0).select("doc_id", "th", "parts"), length, gram)
    by = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("begin", "end")).alias("_s"))
    by = by.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.col("_s.begin").alias("_a"), F.col("_s.end").alias("_b"))
    once = runs.select("doc_id", "th", "passages").dropDuplicates(["doc_id", "th"])
    by = once.join(by, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left").drop("_doc", "_th")
    by = written(by.withColumnsRenamed({"doc_id": "_doc", "th": "_th"}), "cuts")
    key = by.select(F.col("_th").alias("th"))
    none = F.array().cast(_SPANS)
    some = sieved(rows, "th", key).join(by, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left")
    some = some.withColumn("_c", cut(raw, F.col("_a"), F.col("_b"))).withColumns({"n_bytes": F.octet_length(raw).cast("long"), "removed": F.col("_c.removed"), "kept": F.col("_c.kept"), "passages": F.coalesce("passages", none)})
    rest = sieved(rows, "th", key, "left_anti").withColumns({"n_bytes": F.octet_length(raw).cast("long"), "removed": none, "kept": raw, "passages": none})
    return some.drop("_doc", "_th", "_a", "_b", "_c", "th").unionByName(rest.drop("th"))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["begin"])
    count = lambda spans: F.size(spans).cast("long")
    return found.select(
        "doc_id",
        "n_bytes",
        total("removed").alias("n_removed"),
        count("removed").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        count("passages").alias("n_passages"),
        total("passages").alias("passage_bytes"),
    )
