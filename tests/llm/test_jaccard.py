"""Near copies by shingle similarity: against brute force over all pairs."""

import random

import pytest

from logweave.llm import jaccard as J
from logweave.llm import simhash as S

from .conftest import frame


def slow_kept(rows, words=5):
    """Of (id, text): the least id of each component of pairs whose shingle sets share 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i, (id_, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(id_)
    return sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("most", [5, J.MOST])
def test_against_all_pairs(spark, most):
    r = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", "one two", "ONE  two", "one two three"]
    for _ in range(25):
        t = [r.choice(words) for _ in range(r.randint(40, 300))]
        texts.append(" ".join(t))
        for _ in range(r.randint(1, 12)):  # from copies to what is well below 0.8, and chains
            t = list(t) if r.random() < 0.5 else texts[-1].split()
            for _ in range(r.randint(0, max(1, len(t) // 25))):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t).title() if r.random() < 0.3 else " ".join(t))
    r.shuffle(texts)
    docs = frame(spark, texts)
    got = sorted(x["doc_id"] for x in S.one_of_each(docs, most=most).collect())
    want = slow_kept(list(enumerate(texts)))
    assert got == want and len(want) < len(texts)


def test_pipeline_stage_finds_near_copies(spark):
    """Similarity of 0.8 or more of five-word shingles, as of two texts of sf0.001 that SimHashes of 11 and 17 bits tell apart."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = corpus_pipeline.quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d).cache()
    rows = sorted((x["doc_id"], x["text"]) for x in docs.collect())
    got = sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, d).collect())
    assert got == slow_kept(rows)


def test_odd_rows(spark, odd):
    kept = S.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(x["doc_id"] for x in kept.collect()) == [1, 4, 5, 6]
    assert S.one_of_each(odd.limit(0)).isEmpty()


@pytest.fixture
def taken(monkeypatch, spark):
    """Rows that each mapInArrow takes, and rows on the left of each join by ``a``."""
    rows, kind = {"mapInArrow": [], "join": []}, type(spark.range(1))
    for name in rows:

        def counted(self, *args, name=name, real=getattr(kind, name), **more):
            if name != "join" or args[1:2] == ("a",):
                rows[name].append(self.count())
            return real(self, *args, **more)

        monkeypatch.setattr(kind, name, counted)
    return rows


def test_large_shards_in_proportion(spark, taken):
    """Rows grow with a group of near copies, not with its square; what is in no star still meets every row."""
    r = random.Random(3)
    centre, far = r.getrandbits(63) | 255, r.getrandbits(63) | 255
    for n in (200, 800):
        fps = [centre ^ (1 << b) ^ (1 << c) for b, c in r.sample([(b, c) for b in range(8, 63) for c in range(b)], n)] + [centre, far, far ^ 256, centre ^ (7 << 20) ^ (7 << 30)]
        rows = spark.createDataFrame([(1, i, f) for i, f in enumerate(fps)], "key long, id long, fp long")
        taken["mapInArrow"].clear()
        got = S.connected(S.met(rows, 4, 20)).collect()
        assert taken["mapInArrow"][0] <= (n + 4) * 3 + 500
        label = list(range(len(fps)))
        for _ in range(20):
            label = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(fps))] if n == 200 else label
        assert n > 200 or {(x["id"], x["root"]) for x in got} == {(i, x) for i, x in enumerate(label) if i != x}


def test_large_clusters_in_proportion(spark, taken):
    r = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    alone = [" ".join(r.choice("abcdefgh") * 3 + str(r.randrange(99)) for _ in range(60)) for _ in range(3)]
    for n in (100, 400):
        texts = alone + [" ".join([*base, f"x{i}"]) for i in range(n)]
        frame_ = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        near = spark.createDataFrame([(i, 0) for i in range(1, len(texts))], "id long, root long")
        taken["mapInArrow"].clear()
        links = J.confirmed(frame_, near, most=20)
        got = {(x["id"], x["root"]) for x in S.connected(links).collect()}
        assert got == {(i, 3) for i in range(4, len(texts))}
        assert sum(taken["mapInArrow"]) <= 4 * len(texts) + 200


def test_many_roots_of_an_id(spark, taken):
    """Links of many tasks go into the rounds as about a row an id."""
    links = spark.createDataFrame([(1000 + i, (i + 7 * j) % 40) for i in range(500) for j in range(20)], "a long, b long")
    got = {(x["id"], x["root"]) for x in S.connected(links).collect()}
    assert got == {(i, 0) for i in [*range(1, 40), *range(1000, 1500)]}
    assert max(taken["join"]) <= 4 * 540
