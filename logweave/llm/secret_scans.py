"""Secret scans: three patterns, and a character convolutional network over every other candidate in its context.

The network is plain numpy: character embeddings, one convolution, the greatest and the mean activation of each
filter over the candidate, a logistic output. It's trained here on labelled findings, calibrated on a second part of
them (Platt), and its threshold is the highest that keeps ``recall`` of the secrets of that part.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("assign", "access", "hex", "model")
#: The patterns of the contract and the least length of the group that counts. Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as with the plain pattern and a length test
#: Candidates: runs of key characters that hold a letter and a digit, or capitals after small letters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
MIXED = re.compile(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z].*[A-Z].*[a-z].*[A-Z]", re.S)
WIDTH, LEFT, RIGHT = 48, 24, 8  # characters of the candidate, of what stands before it and after it
FINDINGS, RECALL = 4000, 0.95
_ASK = 4096  # spans, and windows, that are scored at once
_ALPHABET = string.ascii_letters + string.digits + "+/_-=.:,;\"'()[]{}<>@#&%$!?\\| \n\t"
_CODE = np.zeros(65536, np.int16)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i + 2  # 0: nothing there, 1: any other
_CODE[_CODE == 0] = 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and not overlapping for each kind, sorted."""
    found = []
    low = text.lower()
    if any(x in low for x in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that the network judges: all candidates that no base span overlaps."""
    found = [m.span() for m in CANDIDATE.finditer(text) if MIXED.search(m[0])]
    starts, reach = [s for s, _, _ in base], [-1, *accumulate((e for _, _, e in base), max)]  # base spans come by start
    return [(a, b) for a, b in found if reach[bisect_left(starts, b)] <= a]


def windows(text: str, a: int, b: int) -> list[str]:
    """Context and candidate at fixed places; of a longer candidate, windows of WIDTH that overlap by half and cover it."""
    places = [*range(a, b - WIDTH, WIDTH // 2), b - WIDTH] if b - a > WIDTH else [a]
    ends = [min(p + WIDTH, b) for p in places]
    return [text[max(0, p - LEFT) : p].rjust(LEFT, "\0") + text[p:e].ljust(WIDTH, "\0") + text[e : e + RIGHT].ljust(RIGHT, "\0") for p, e in zip(places, ends, strict=True)]


def encode(windows: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(windows), -1)
    return np.where(raw == 0, 0, _CODE[np.minimum(raw, 65535)])


class Network:
    """Embedding, convolution of width 5, greatest and mean activations, logistic output."""

    K, E, N = 5, 12, 24

    def __init__(self, rng: np.random.Generator):
        k, e, n = self.K, self.E, self.N
        self.p = {"emb": rng.normal(0, 0.3, (len(_ALPHABET) + 2, e)), "w": rng.normal(0, (k * e) ** -0.5, (k * e, n)), "b": np.zeros(n), "o": rng.normal(0, n**-0.5, 2 * n), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        emb = self.p["emb"][x]
        cols = np.lib.stride_tricks.sliding_window_view(emb, self.K, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, self.K * self.E)
        act = np.maximum(cols @ self.p["w"] + self.p["b"], 0)
        top = act.argmax(1)
        feats = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(1)], 1)
        return cols, act, top, feats, feats @ self.p["o"] + self.p["c"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-(self.scale * self.logits(x) + self.shift)))

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 6, rate: float = 4e-3, size: int = 128) -> None:
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), size):
                xb, yb = x[order[i : i + size]], y[order[i : i + size]]
                cols, act, top, feats, z = self._forward(xb)
                dz = (1 / (1 + np.exp(-z)) - yb) / len(xb)
                df = dz[:, None] * self.p["o"]
                da = np.repeat(df[:, None, self.N :] / act.shape[1], act.shape[1], 1)
                np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + df[:, None, : self.N], 1)
                da = da * (act > 0)
                dc = (da @ self.p["w"].T).reshape(len(xb), -1, self.K, self.E)
                demb, dx = np.zeros_like(self.p["emb"]), np.zeros((len(xb), xb.shape[1], self.E))
                for k in range(self.K):
                    dx[:, k : k + dc.shape[1]] += dc[:, :, k]
                np.add.at(demb, xb, dx)
                grads = {"emb": demb, "w": np.tensordot(cols, da, ([0, 1], [0, 1])), "b": da.sum((0, 1)), "o": feats.T @ dz, "c": dz.sum(keepdims=True)}
                step += 1
                for name, g in grads.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt's scale and shift by Newton steps, then the highest threshold with that recall."""
        z = self.logits(x)
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a = np.array([1.0, 0.0])
        f = np.stack([z, np.ones_like(z)], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ a, -30, 30)))
            h = (f * (p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
            a = a - np.clip(np.linalg.solve(h, f.T @ (p - t)), -1, 1)
        self.scale, self.shift = a
        s = np.sort(self.scores(x)[y > 0])
        self.threshold = float(s[int((1 - recall) * len(s))])


_SOUNDS = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve eau que ment ción aux".split()
_WORDS = "build default release version config handler request response session window database connection manager service controller index template module feature client server parser reader writer".split()


def labelled_findings(n: int = FINDINGS, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """n labelled findings (text, start, end, secret or not), half of each: credentials in the forms services give them,
    and what looks like them: long words, paths, identifiers, dates, e-mail and page addresses, telephone and card numbers."""
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, b62 = string.ascii_lowercase + string.digits, string.ascii_letters + string.digits
    word = lambda: "".join(r.choice(_SOUNDS) for _ in range(r.randint(1, 5)))
    prose = lambda k: " ".join(word() for _ in range(k))
    secrets = (
        lambda: some(b62, r.randint(20, 64)),
        lambda: some(b62 + "+/", r.choice((24, 32, 40, 44))) + r.choice(("", "=", "==")),
        lambda: r.choice(("ghp_", "gho_", "sk_live_", "pk_live_", "glpat-", "npm_")) + some(b62, r.randint(20, 36)),
        lambda: f"{r.choice(('xoxb', 'xoxp'))}-{some(string.digits, 11)}-{some(b62, 24)}",
        lambda: "eyJ" + some(b62 + "_-", r.randint(30, 80)),
        lambda: "AIza" + some(b62 + "_-", 35),
        lambda: some("0123456789ABCDEF", r.choice((32, 40, 64))),
        lambda: some(low, r.randint(24, 40)),
    )
    others = (
        lambda: "".join(r.choice(_SOUNDS) for _ in range(r.randint(6, 14))) + r.choice(("", "", str(r.randint(1, 99)))),
        lambda: "/".join(r.choice(_WORDS) for _ in range(r.randint(3, 6))) + str(r.randint(1, 20)),
        lambda: "_".join(r.choice(_WORDS) for _ in range(r.randint(2, 5))) + f"_{r.randint(1, 3000)}",
        lambda: "".join(r.choice(_WORDS).title() for _ in range(r.randint(2, 5))) + r.choice(("", "V2", "3", "Test1")),
        lambda: f"{r.randint(1980, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}-{r.randint(0, 59):02}Z",
        lambda: f"mail{some(string.digits, 4)}-{r.choice(_WORDS)}-{r.choice(_WORDS)}",
        lambda: f"www-{word()}-{r.choice(_WORDS)}-{r.randint(1, 999)}-html",
        lambda: f"{r.randint(1, 9)}-{some(string.digits, 3)}-{some(string.digits, 3)}-{some(string.digits, 4)}-ext{r.randint(1, 99)}",
        lambda: "-".join(word() for _ in range(r.randint(4, 8))) + f"-{r.randint(1, 99)}",
        lambda: f"{some(string.digits, r.randint(12, 19))}{r.choice(('px', 'ms', 'EUR', 'th', 'x'))}",
    )
    leads = ("key: ", "Authorization: Bearer ", "credential ", "export KEY=", 'auth="', "pwd ", "private ", "signature=", "", "", "")
    lines = ("see ", "file ", "page ", "https://", "id ", "call ", "from ", "(", "", "", "", "")
    out = []
    for i in range(n):
        yes = i % 2
        body = (r.choice(secrets) if yes else r.choice(others))()
        body = (CANDIDATE.search(body) or re.search(r"\S+", body))[0]
        before = prose(r.randint(1, 6)) + " " + r.choice(leads if yes else lines)
        out.append((before + body + r.choice(('"', ".", " ", ", ", "\n")) + prose(3), len(before), len(before) + len(body), yes))
    return out


@lru_cache(4)
def trained(n: int = FINDINGS, seed: int = 7, recall: float = RECALL) -> Network:
    """The network, fitted on three quarters of ``labelled_findings(n, seed)`` and calibrated on the rest."""
    found = labelled_findings(n, seed)
    rng, cut = np.random.default_rng(seed), 3 * n // 4
    net = Network(rng)
    net.fit(*_labelled(found[:cut]), rng)
    net.calibrate(*_labelled(found[cut:]), recall)
    return net


def _labelled(found: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of all windows of the findings."""
    each = [(w, yes) for t, a, b, yes in found for w in windows(t, a, b)]
    return encode([w for w, _ in each]), np.array([yes for _, yes in each], float)


def _best(asked: list[tuple[str, int, int]], net: Network) -> list[float]:
    """Each span's score: the greatest of its windows'. Some thousand windows are coded at once."""
    out: list[float] = []
    for k in range(0, len(asked), _ASK):
        each = [windows(*x) for x in asked[k : k + _ASK]]
        scores, ends = [], np.cumsum([len(w) for w in each])
        flat = [w for ws in each for w in ws]
        for i in range(0, len(flat), _ASK):
            scores.append(net.scores(encode(flat[i : i + _ASK])))
        out += np.maximum.reduceat(np.concatenate(scores), np.concatenate(([0], ends[:-1]))).tolist()
    return out


def scan(texts: list[str], net: Network) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, score) of each text, sorted: the network scores all candidates; base spans stay whatever their score."""
    asked, of = [], []
    for i, t in enumerate(texts):
        base = base_spans(t)
        for a, k, b in [*base, *((a, 3, b) for a, b in candidates(t, base))]:
            asked.append((t, a, b))
            of.append((i, a, k, b))
    found: list[list] = [[] for _ in texts]
    for (i, a, k, b), s in zip(of, _best(asked, net), strict=True):
        if k < 3 or s >= net.threshold:
            found[i].append((a, k, b, float(s)))
    return [sorted(f) for f in found]


def secrets(docs: DataFrame, text: str = "text", findings: int = FINDINGS, recall: float = RECALL) -> DataFrame:
    """``docs`` plus ``secrets``, an array of (kind, start, end, score) in text order; places are code points, end exclusive.

    A null or empty text has none. Whole texts are scanned, of any length, each row by itself, repeated rows alike; of equal
    spans the kinds come in the order of KINDS. An empty table gives no rows. A column named secrets is replaced.
    """
    small_batches(docs.sparkSession)
    net = trained(findings, recall=recall)

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    def find(texts: pd.Series) -> pd.Series:
        rows = scan([t or "" for t in texts], net)
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in row] for row in rows], dtype=object)

    return docs.withColumn("secrets", find(F.col(text)))


def masked(docs: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with each stretch of secrets in the text replaced by ``mark``; a null text stays null."""
    small_batches(docs.sparkSession)
    net = trained()

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        out = []
        for t, row in zip(texts, scan([t or "" for t in texts], net), strict=True):
            if row:
                parts, at = [], 0
                for a, _, b, _ in row:
                    if a >= at:
                        parts += [t[at:a], mark]
                    at = max(at, b)
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, mask(F.col(text)))


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "model")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))
