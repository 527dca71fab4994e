"""SimHash, suffix dedup, URL filters: against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from logweave.llm import simhash as S
from logweave.llm import suffix_dedup as X
from logweave.llm import url_filters as U

from .conftest import frame


def slow_fingerprint(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius=3):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(spark):
    texts = [None, "", "One", "One two", "A b c D e", "ÉÀ é x y\x0bz   q", "w " * 50]
    got = [S.fingerprint(t) & (1 << 64) - 1 for t in texts]
    assert got == [slow_fingerprint(t) for t in texts]


@pytest.mark.parametrize("max_shard", [4, 100000])
def test_components(spark, max_shard):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in fps[:12]:  # chains and a tight group
        for _ in range(r.randint(1, 12)):
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(0, 3)))
            fps.append(f)
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    comp = {row["fp"]: row["component_id"] for row in S.components(rows, max_shard=max_shard).collect()}
    assert [comp[r["fp"]] for r in rows.orderBy("doc_id").collect()] == slow_components(fps)
    if max_shard > 4:  # as beyond a million fingerprints: any number of blocks gives the same components
        each = rows.select("fp").distinct()
        four, six = ({(r["id"], r["root"]) for r in S.connected(S.links(each, blocks=n)).collect()} for n in (4, 6))
        assert four == six and four


def test_near_duplicates_odd_rows(spark, odd):
    out = S.near_duplicates(odd)
    assert out.count() == odd.count()
    assert {r["component_id"] for r in out.where("doc_id in (1, 2, 3)").collect()} == {1}
    kept = S.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
    assert S.near_duplicates(odd.limit(0)).isEmpty()


def slow_dedup(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] = count.get(b[p : p + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("block", [3000, X.BLOCK])
def test_dedup(spark, block):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(6))
    passages = ["".join(word() for _ in range(n)) for n in (66, 67, 80, 120, 200)]
    texts = [None, "", "a" * 399, "ab" * 700, "x" * 401]
    for i in range(60):
        parts = ["".join(word() for _ in range(r.randint(1, 60))) for _ in range(3)]
        texts.append(parts[0] + r.choice(passages) + parts[1] + (r.choice(passages)[r.randint(0, 30) :] if i % 3 else "") + parts[2])
    texts += texts[10:14]
    docs = frame(spark, texts)
    assert X.deduplicated(docs).count() == len(texts)
    got = {row["doc_id"]: row["kept"] for row in X.deduplicated(docs).collect()}
    assert [hashlib.sha256(got[i]).hexdigest() for i in range(len(texts))] == [hashlib.sha256(b).hexdigest() for b in slow_dedup(texts, 400)]
    found = {}
    for s in X.stretches(X.whole(docs), block=block).collect():
        found.setdefault(s["doc_id"], []).append((s["begin"], s["end"]))
    for i, t in enumerate(texts):
        left = bytearray()
        raw, at = (t or "").encode(), 0
        spans = np.array(found.get(i, []), np.int64).reshape(-1, 2)
        for a, b in X.merged(spans[:, 0], spans[:, 1]) if len(spans) else []:
            left += raw[at:a]
            at = b
        assert bytes(left + raw[at:]) == got[i]


def test_dedup_odd_rows(spark, odd):
    out = X.deduplicated(odd)
    assert out.count() == odd.count() and X.deduplicated(odd.limit(0)).isEmpty()
    assert out.where("doc_id = 5").first()["kept"] == b""


def test_cover():
    c = X.difference_cover(32)
    assert {(a - b) % 32 for a in c for b in c} == set(range(32))


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(X, "PIECE", 1000)
    t = b"".join(bytes([65 + i * i * 7 % 26]) for i in range(5000))
    parts = list(X._pieces([t, b"x" * 10, t[:700]], 400, 1000))
    starts = {(o, off + k) for data, ends, owner, offset in parts for o, off, n in zip(owner, offset, np.diff(np.r_[0, ends]), strict=True) for k in range(n - 399)}
    assert starts == {(0, k) for k in range(4601)} | {(2, k) for k in range(301)}


@pytest.mark.parametrize(
    "url,rule,verdict",
    [
        ("http://a.example.org/es/x", "example.org/es/", "block"),
        ("http://EXAMPLE.org/en/12?q", "example.org/en/1", "block"),
        ("http://x.org/", "org/", "allow"),
        ("http://x.org", None, "allow"),
        ("http://notexample.com/fr/", "com/fr/", "allow"),
        ("http://www.casino-win.example.com/en/", None, "block"),
        ("http://mycasino-win.example.com/en/", None, "allow"),
        ("no scheme", None, "allow"),
        (None, None, "allow"),
    ],
)
def test_urls(spark, url, rule, verdict):
    r = U.judged(spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")).first()
    assert (r["rule"], r["verdict"]) == (rule, verdict)


def test_blocklists_of_any_length(spark):
    """A list as a DataFrame, in an index or joined: the same verdicts."""
    urls = ["http://a.bad.org/x", "http://bad.org", "http://notbad.org/", "http://x.com/fr/", "http://x.com/", None, "http://worse.net/", "nothing"] * 2
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, _bad string")
    listed = spark.createDataFrame([("bad.org",), ("x.com",), ("worse.net",), (None,), ("bad.org",)], "name string")
    got = [[tuple(r) for r in U.judged(pages, blocked=listed, max_entries=n).select("page_id", "rule", "verdict").orderBy("page_id").collect()] for n in (2, 100)]
    assert got[0] == got[1] and [v for _, _, v in got[0]][:8] == ["allow", "block", "allow", "allow", "block", "allow", "block", "allow"]
    assert U.judged(pages, blocked=listed.limit(0), max_entries=0).count() == len(urls)


def test_digest_collisions(monkeypatch):
    import io

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: 5)
    f = U.Index.files(["aa", "b", "ccc"])
    index = U.Index(np.load(io.BytesIO(f["keys"])), np.load(io.BytesIO(f["ends"])), np.frombuffer(f["texts"], np.uint8))
    assert index.has(["b", "x", "ccc", "aa", "bc"]).tolist() == [True, False, True, True, False]
    assert U.Index(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)).has(["a"]).tolist() == [False]


def test_passages(spark):
    """Passages of over 50 words are found where they are too short to be removed; repeated rows are copies."""
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(4, 5))) for _ in range(n))
    passage, shorter, long = prose(55), prose(40), prose(150)
    texts = [prose(30) + "\n" + passage + "\n" + prose(20), passage + " " + prose(90), shorter + "\n" + prose(60), prose(5) + "\n" + shorter, prose(300)]
    texts[4] += "\n" + "\n".join([prose(90)] * 3)  # its own alone: removed, but no passage
    rows = [*enumerate(texts), (9, long), (9, long), (None, long + " " + prose(3))]
    got = sorted((x["doc_id"] or 0, len(x["passages"]), sum(e - b for b, e in x["removed"])) for x in X.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(long)
    assert 256 <= len(passage) < 400
    assert {x[0]: x[1:] for x in got if x[0] in (1, 2, 3)} == {1: (1, 0), 2: (0, 0), 3: (0, 0)}
    assert [(n_, gone > 900) for i, n_, gone in got if i == 4] == [(0, True)]
    assert [x for x in got if x[0] == 9] == [(9, 1, n), (9, 1, n)] and sorted(x[1:] for x in got if x[0] == 0) == [(1, 0), (1, n)]


def test_suffix_hashes():
    data = np.frombuffer(bytes(random.Random(4).choices(b"ab", k=3000)) * 2, np.uint8)
    for length in (12, 256, 400):
        h = X.suffix_hashes(data, length)
        assert len(h) == len(data) - length + 1 and (h[: 3000 - length] == h[3000 : 6000 - length]).all()
        strings = {data[i : i + length].tobytes() for i in range(len(h))}
        assert len(set(h.tolist())) == len(strings)
