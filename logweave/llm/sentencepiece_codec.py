"""SentencePiece encoding and decoding by batched numpy Viterbi.

Words of equal length advance together, one character a step: hashes of the substrings that end there are looked up in
the sorted keys of the pieces, and a vectorised maximum over the pieces that may follow what stands before stores each
word's backpointer. The model at hand is a BPE one, whose encoding no sum of scores gives; what does is a rule on
neighbours: a sequence of pieces is the encoding if and only if each two neighbours, by themselves, encode to just these
two. So a step admits a piece only after a piece that it may follow, one piece remains, and the ids are the library's.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Texts that are encoded together.
STEP = 1024
#: Words whose encodings a worker keeps at least (and twice as many at most), and words that advance together.
CACHE, CHUNK = 120_000, 8192
#: Characters of kept words beyond which they count as too many; length of a word from which on it's cut at its seams.
KEPT, LONG = 1 << 24, 64
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)  # odd: a product with it is one to one
_MARKS = ".,;:!?#*$%&|<>\"'()[]{}"
_NONE, _PAD = 1 << 30, 0x110000


class Sorted:
    """Sorted 64-bit keys that are spread evenly; their top 16 bits say where to look."""

    def __init__(self, keys: np.ndarray):
        if len(np.unique(keys)) < len(keys):
            raise ValueError("keys collide")
        self.keys = np.append(keys, np.uint64(0))
        self.first = np.searchsorted(keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int32)
        self.most = int(np.diff(np.append(self.first, len(keys))).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each one's place, or the number of keys."""
        out = np.full(len(h), len(self.keys) - 1, np.int32)
        left, at = None, self.first[h >> np.uint64(48)]
        for _ in range(self.most):
            there = self.keys[at]
            same = there == h
            hit = np.flatnonzero(same)
            out[hit if left is None else left[hit]] = at[hit]
            go = np.flatnonzero((there < h) & (at < len(self.keys) - 1))
            if not len(go):
                break
            left, h, at = go if left is None else left[go], h[go], at[go] + 1
        return out


class Codec:
    """A SentencePiece BPE model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.unknown = sp.unk_id()
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.control = {i for i in range(n) if sp.is_control(i)}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that go on past a space or a line end")
        self._tables(plain)
        # marks that no piece has after a letter: words part there, as nothing merges across
        after = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        self.marks = "".join(c for c in _MARKS if c not in after)
        self.within = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}  # neighbours in any piece
        self.kept = [0, 0]
        self.cache: list[dict[str, bytes]] = [{}, {}]  # by word: at a line's start, and after a space
        self.older: list[dict[str, bytes]] = [{}, {}]
        self.runs: dict[int, list[int]] = {}
        high = [i for i, b in self.id_byte.items() if b >= 128]
        self.special = np.zeros(n, bool)  # ids that decode with others or otherwise
        self.special[[*high, self.unknown, *self.control]] = True
        self.shown = [chr(self.id_byte[i]) if i in self.id_byte else p for i, p in enumerate(self.pieces)]

    def merged(self, symbols: list[str], last: list | None = None) -> list[str]:
        """BPE one merge at a time: the best scored neighbours, of equal ones the leftmost. The definition, for tables and runs."""
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        sym: list = list(symbols)
        heap: list = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (-s, a, b, sym[a], sym[b]))

        for i in range(len(sym) - 1):
            push(i, i + 1)
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if sym[a] != x or sym[b] != y or right[a] != b:
                continue
            if last is not None:
                last[:] = [x, y]
            sym[a], sym[b] = x + y, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            push(left[a], a)
            push(a, right[a])
        return [s for s in sym if s is not None]

    def _tables(self, plain: list[int]) -> None:
        n = len(self.pieces)
        self.order = np.full(n, -1, np.int32)  # of merging; single characters come before all
        self.lefts, self.rights = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        whole = [i for i in plain if len(self.pieces[i]) > 1 and self.pieces[i].strip(SPACE)]
        ranked = sorted(whole, key=lambda i: (-self.score[self.pieces[i]], i))
        usable = {p for p in self.ids if len(p) == 1}
        for rank, i in enumerate(ranked):
            p, split = self.pieces[i], ["", ""]
            if self.merged(list(p), split) == [p] and split[0] in self.ids and split[1] in self.ids:
                self.order[i] = rank
                self.lefts[i], self.rights[i] = self.ids[split[0]], self.ids[split[1]]
                usable.add(p)
        pair = {}
        for i in ranked:
            p = self.pieces[i]
            for k in range(1, len(p)):
                if p[:k] in usable and p[k:] in usable:
                    pair[self.ids[p[:k]] << 20 | self.ids[p[k:]]] = ranked_at = int(self.order[i])
                    if ranked_at < 0:  # a piece that no text ends up with still takes part in merging
                        raise ValueError(f"piece {p!r} isn't its own encoding")
        mixed = sorted((int(self._mix(np.int64(k))), v) for k, v in pair.items())
        self.pairs = Sorted(np.array([k for k, _ in mixed], np.uint64))
        self.pair_order = np.array([v for _, v in mixed] + [_NONE], np.int32)
        self.longest = max(map(len, usable))
        keyed = sorted((int(self._hash(np.array([[*map(ord, p)]], np.uint64))[0]), self.ids[p]) for p in usable)
        self.keys = Sorted(np.array([k for k, _ in keyed], np.uint64))
        self.key_ids = np.array([i for _, i in keyed] + [-1], np.int32)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(codes.shape[:-1], np.uint64)
        for k in range(codes.shape[-1]):
            h = h * _BASE + codes[..., k] + np.uint64(1)
        return h * _SPREAD

    @staticmethod
    def _mix(pair: np.ndarray) -> np.ndarray:
        """A pair's key, one to one, spread over 64 bits."""
        with np.errstate(over="ignore"):
            return pair.astype(np.uint64) * _SPREAD

    def _follows(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether q, p are the encoding of their own text: undoing merges from the seam outwards, no merge across it comes first."""
        ok = np.zeros(len(q), bool)
        at, limit = np.arange(len(q)), np.full(len(q), _NONE, np.int32)
        while len(at):
            across = self.pair_order[self.pairs.find(self._mix(q.astype(np.int64) << 20 | p))]
            oq, op = self.order[q], self.order[p]
            left, stay = oq > op, across >= limit
            done = stay & ~left & (op < 0)
            ok[at[done]] = True
            go = stay & ~done
            q, p, left, oq, op, at = q[go], p[go], left[go], oq[go], op[go], at[go]
            limit = np.where(left, oq, op + 1)
            q, p = np.where(left, self.rights[q], q), np.where(left, p, self.lefts[p])
        return ok

    def _viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one word's after the other, and where each word's end; -1 for a character that is no piece.
        Shorter words are padded with what is in no piece."""
        sizes = np.array([len(w) for w in words])
        n, size = len(words), int(sizes.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) == n * size:
            codes = codes.reshape(n, size)
        else:
            padded = np.full((n, size), _PAD, np.uint32)
            padded[np.arange(size) < sizes[:, None]] = codes
            codes = padded
        codes = codes.T.astype(np.uint64, order="C") + np.uint64(1)
        found: list = []  # by length - 1: ids of the substrings, a row for each start
        h = np.zeros((size, n), np.uint64)
        for k in range(min(size, self.longest)):
            h = h[: size - k] * _BASE + codes[k:]
            found.append(self.key_ids[self.keys.find((h * _SPREAD).ravel())].reshape(h.shape))
        last, back = np.full((size + 1, n), -1, np.int32), np.zeros((size + 1, n), np.int32)
        for end in range(1, size + 1):
            row, length, piece = [], [], []
            for k in range(1, min(end, self.longest) + 1):
                ids = found[k - 1][end - k]
                hit = np.flatnonzero(ids >= 0)
                row.append(hit)
                length.append(np.full(len(hit), k, np.int32))
                piece.append(ids[hit])
            row, length, piece = np.concatenate(row), np.concatenate(length), np.concatenate(piece)
            before = last[end - length, row]
            fits = before < 0  # a word's start, or a character that is no piece: nothing merges across
            ask = np.flatnonzero(~fits)
            fits[ask] = self._follows(before[ask], piece[ask])
            row, length, piece = row[fits], length[fits], piece[fits]
            np.maximum.at(back[end], row, length)
            best = length == back[end][row]
            last[end][row[best]] = piece[best]
            back[end][back[end] == 0] = 1  # a character that is no piece stands alone
        at, live = sizes.copy(), np.arange(n)
        out, k = np.full((n, size), -2, np.int32), size
        while len(live):
            k -= 1
            where = at[live]
            out[live, k] = last[where, live]
            at[live] = where - back[where, live]
            live = live[at[live] > 0]
        there = out > -2
        return out[there], np.cumsum(there.sum(1))

    def _run(self, n: int) -> list[int]:
        """n spaces."""
        if n not in self.runs:
            self.runs[n] = [self.ids[p] for p in self.merged([SPACE] * n)] if n else []
        return self.runs[n]

    def learn(self, words: set[str], space: int) -> None:
        """Encodes words without spaces and line ends, at a line's start or (space = 1) after a space, and keeps them."""
        long = {w: cut for w in words if len(w) >= LONG and len(cut := self._cut(w)) > 1}
        if long:
            self.learn({p for cut in long.values() for p in cut[1:]} - self.cache[0].keys(), 0)
            words = (words - long.keys()) | ({cut[0] for cut in long.values()} - self.cache[space].keys())
        self.kept[space] += sum(map(len, words)) + sum(map(len, long))
        self._learn(words, space)
        cache, first = self.cache[space], self.cache[0]
        for w, cut in long.items():
            cache[w] = b"".join([cache[cut[0]], *map(first.__getitem__, cut[1:])])

    def _cut(self, word: str) -> list[str]:
        """The word's parts between neighbours that no piece has: nothing merges across these seams."""
        within = self.within
        seams = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in within]
        return [word[a:b] for a, b in zip([0, *seams], [*seams, len(word)], strict=True)]

    def _learn(self, words: set[str], space: int) -> None:
        marked, whole, marks = [], set(), self.marks
        for w in words:
            if w[-1] in marks and (core := w.rstrip(marks))[-1:].isalpha():
                marked.append((w, core))
            else:
                whole.add(w)
        if marked:
            tails = self._known({w[len(core) :] for w, core in marked}, 0)
            cache, older = self.cache[space], self.older[space]
            cores = {core for _, core in marked} - cache.keys()
            for w in cores & older.keys():
                cache[w] = older[w]
            self._advance(whole | cores - older.keys(), space)
            for w, core in marked:
                cache[w] = cache[core] + tails[w[len(core) :]]
        else:
            self._advance(whole, space)

    def _advance(self, words: set[str], space: int) -> None:
        cache, by = self.cache[space], {}
        for w in words:  # long ones, of which few have one length, go with those of up to twice theirs
            by.setdefault(len(w) if len(w) < LONG else 1 << len(w).bit_length(), []).append(w)
        for size, group in by.items():
            step = max(1, CHUNK * 16 // max(16, size))
            for k in range(0, len(group), step):
                part = group[k : k + step]
                ids, ends = self._viterbi([SPACE + w for w in part] if space else part)
                raw, odd = ids.tobytes(), np.flatnonzero(ids < 0)
                ends = (4 * ends).tolist()
                cache.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))
                if len(odd):
                    for i in np.unique(np.searchsorted(ends, 4 * odd, side="right")).tolist():
                        cache[part[i]] = self._with_bytes(SPACE * space + part[i], np.frombuffer(cache[part[i]], np.int32).tolist())

    def _with_bytes(self, core: str, ids: list[int]) -> bytes:
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.pieces[i])
            else:
                out += [self.byte_id.get(b, self.unknown) for b in core[at].encode("utf-8", "surrogatepass")]
                at += 1
        return np.array(out, np.int32).tobytes()

    def _known(self, words: set[str], space: int) -> dict[str, bytes]:
        """The cache, with all these words in it. Of two generations the older goes when the newer is full."""
        if len(self.cache[space]) > CACHE or self.kept[space] > KEPT:
            self.older[space], self.cache[space], self.kept[space] = self.cache[space], {}, 0
        cache, older = self.cache[space], self.older[space]
        new = words - cache.keys()
        for w in new & older.keys():
            cache[w] = older[w]
        self.learn(new - older.keys(), space)
        return cache

    _spaced = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _odd_line(self, line: str) -> list[tuple[str, int]]:
        """Words of a line with runs of spaces: (word, spaces before it); a run at the end has an empty word."""
        found = self._spaced.findall(line)
        return [(body := w.lstrip(SPACE), len(w) - len(body)) for w in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as int32 bytes."""
        out = []
        for k in range(0, len(texts), STEP):
            out += self._some(texts[k : k + STEP])
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        starts, spaced, plan = set(), set(), []
        for t in texts:
            lines: list = []
            plan.append(lines)
            if not t:
                continue
            t = " " + t.replace(SPACE, " ")
            plain = not ("  " in t or " \n" in t or t[-1] == " ")
            for line in t.split("\n"):
                if plain or not ("  " in line or line[-1:] == " "):
                    parts = line.split(" ")
                    lines.append((True, parts))
                    words = iter(parts)
                    starts.add(next(words))
                    spaced.update(words)
                else:
                    odd = self._odd_line(line.replace(" ", SPACE))
                    spaced.update(w for w, m in odd if m and w)
                    starts.update(w for w, m in odd if not m)
                    lines.append((False, odd))
        starts.discard("")
        first, after = self._known(starts, 0), self._known(spaced, 1)
        newline = np.array([self.byte_id.get(10, self.unknown)], np.int32).tobytes()
        alone, get = np.array([self.ids[SPACE]], np.int32).tobytes(), after.__getitem__
        out = []
        for lines in plan:
            raw = []
            for n, (plain, words) in enumerate(lines):
                if n:
                    raw.append(newline)
                if plain:
                    rest = iter(words)
                    if head := next(rest):
                        raw.append(first[head])
                    raw += map(get, rest)
                    continue
                for w, m in words:
                    if not m:
                        raw.append(first[w])
                    elif not w:
                        raw.append(np.array(self._run(m), np.int32).tobytes())
                    elif (ids := after[w])[:4] == alone:  # no piece starts with that space: it stays with the others
                        raw += [np.array(self._run(m), np.int32).tobytes(), ids[4:]]
                    else:
                        raw += [np.array(self._run(m - 1), np.int32).tobytes(), ids]
            out.append(b"".join(raw))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids: pieces joined, bytes read as UTF-8, the dummy prefix gone."""
        if not self.special[ids].any():
            text = "".join(map(self.shown.__getitem__, ids.tolist())).replace(SPACE, " ")
            return text[1:] if text[:1] == " " else text
        parts, held = [], bytearray()
        pieces, id_byte = self.pieces, self.id_byte
        for i in ids.tolist():
            if i in id_byte:
                held.append(id_byte[i])
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            if i == self.unknown:
                parts.append(" ⁇ ")
            elif i not in self.control:
                parts.append(pieces[i])
        if held:
            parts.append(held.decode("utf-8", "replace"))
        text = "".join(parts).replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(2)
def codec(model: bytes) -> Codec:
    """Once for each worker process and model."""
    return Codec(model)


def _bytes(model: str) -> bytes:
    with open(model, "rb") as f:  # on the driver; workers get the content
        return f.read()


def _ids(c: Codec, texts: pa.Array) -> pa.ListArray:
    raw = c.encode([t or "" for t in texts.to_pylist()])
    ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)))
    values = pa.array(np.frombuffer(b"".join(raw), np.int32))
    mask = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=mask)


def _texts(c: Codec, rows: pa.ListArray) -> pa.Array:
    values, ends = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
    nulls = rows.is_null().to_pylist()
    return pa.array([None if null else c.decode(values[a:b]) for a, b, null in zip(ends, ends[1:], nulls, strict=False)], pa.string())


def encoded(docs: DataFrame, model: str = MODEL, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` plus ``ids`` (array of int): the model's encoding of the whole text.

    A null text has null ids, an empty one none. Characters that are no piece become bytes. A long word is cut where no
    piece goes on; a part takes memory in proportion to its length, however long. Each row by itself, repeated rows alike,
    an empty table gives no rows; a column of that name is replaced.
    """
    small_batches(docs.sparkSession)
    content = _bytes(model)
    # not deterministic: else each use of the column would encode again
    return docs.withColumn(name, F.arrow_udf(lambda texts: _ids(codec(content), texts), "array<int>").asNondeterministic()(F.col(text)))


def decoded(docs: DataFrame, model: str = MODEL, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` plus ``decoded``, the text of the ids; null for null ids. Gives back any encoded text but for U+2581, which
    the model itself takes for a space."""
    small_batches(docs.sparkSession)
    content = _bytes(model)
    return docs.withColumn(name, F.arrow_udf(lambda rows: _texts(codec(content), rows), "string").asNondeterministic()(F.col(ids)))


def round_trip(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """``docs`` plus ``ids``, ``decoded`` and ``round_trip`` (whether that is the text), encoded and decoded in one worker."""
    small_batches(docs.sparkSession)
    content = _bytes(model)

    def both(texts: pa.Array) -> pa.Array:
        parts = []
        for k in range(0, max(1, len(texts)), STEP):
            ids = _ids(codec(content), texts.slice(k, STEP))
            parts.append(pa.StructArray.from_arrays([ids, _texts(codec(content), ids)], ["ids", "decoded"]))
        return pa.concat_arrays(parts)

    out = docs.withColumn("_b", F.arrow_udf(both, "struct<ids:array<int>,decoded:string>").asNondeterministic()(F.col(text)))
    out = out.withColumns({"ids": F.col("_b.ids"), "decoded": F.col("_b.decoded")}).drop("_b")
    return out.withColumn("round_trip", F.col("decoded") == F.replace(text, F.lit(SPACE), F.lit(" ")))


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_sha256 (of the ids joined by spaces), decoded_sha256, round_trip; a null text counts as empty."""
    rows = round_trip(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model)
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "round_trip",
    )


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
