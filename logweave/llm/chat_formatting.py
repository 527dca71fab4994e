"""Chat formatting in budgeted windows.

Turns stream by in order, one conversation after another; prefix sums of their tokens choose spans of whole turns
that fit the budget. Each window starts with the system turn, if there is one, and repeats the last turns before it
up to a limit; repeated targets are outside the loss mask, so each assistant text is learnt from once. Only the turns
of one window and its history are held at a time: a conversation of any length costs no memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

BUDGET, HISTORY = 1024, 256
#: The vocabulary whose tokens the budget counts. Without one, words and marks count.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Template. Fixed values.
START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM, TARGET = "system", "assistant"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
WINDOWS = "conv_id long, window long, text string, n_repeated int, n_tokens long, loss_start array<int>, loss_end array<int>"


def escape(text: str) -> str:
    r"""No ``<|`` stays: any run of ``\`` between ``<`` and ``|``, none included, grows by one. ``unescape`` takes it off again."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    r"""Roles stand in a line of their own: ``\`` doubles, a line end becomes ``\n``."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def n_tokens(text: str) -> int:
    """Words and marks."""
    return len(_TOKEN.findall(text))


@lru_cache(2)
def _counter(model: bytes | None) -> Callable[[list[str]], list[int]]:
    """Tokens of each text, by the vocabulary if there is one; once for each worker process."""
    if model is None:
        return lambda texts: list(map(n_tokens, texts))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return lambda texts: [len(ids) for k in range(0, len(texts), 256) for ids in sp.encode(texts[k : k + 256], num_threads=1)]


class _Windows:
    """Makes the windows of one conversation as its turns come."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system, self.turns, self.before, self.n, self.count = None, [], [], 0, 0
        self.prefix = [0]  # tokens of self.turns before each place

    def add(self, role: str, text: str, size: int) -> Iterator[tuple]:
        """size: the turn's tokens."""
        turn = (role, text, size)
        if self.count == 0 and role == SYSTEM:
            self.system = turn
        self.count += 1
        if self.turns and self._fixed() + self.prefix[-1] + size > self.budget:
            yield self._cut()
        while not self.turns and self.before and self._fixed() + size > self.budget:  # the turn itself comes before what repeats
            self.before.pop(0)
        self.turns.append(turn)
        self.prefix.append(self.prefix[-1] + size)

    def _fixed(self) -> int:
        """Tokens that the window has besides its own turns."""
        return (self.system[2] if self.system and self.n else 0) + sum(t[2] for t in self.before)

    def _cut(self) -> tuple:
        row = self._row()
        own = self.turns[1:] if self.n == 0 and self.system else self.turns
        kept, size = [], 0
        for t in reversed(own):
            size += t[2]
            if size > self.history:
                break
            kept.append(t)
        self.before, self.turns, self.prefix, self.n = kept[::-1], [], [0], self.n + 1
        return row

    def _row(self) -> tuple:
        repeated = ([self.system] if self.system and self.n else []) + self.before
        parts, at, begins, ends = [], 0, [], []
        for i, (role, text, _) in enumerate(repeated + self.turns):
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            if i >= len(repeated) and role == TARGET:
                begins.append(at + len(head))
                ends.append(at + len(head) + len(body))
            parts += [head, body, END]
            at += len(head) + len(body) + len(END)
        return self.conv, self.n, "".join(parts), len(repeated), self._fixed() + self.prefix[-1], begins, ends

    def last(self) -> Iterator[tuple]:
        if self.turns:
            yield self._row()


def formatted(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, model: str | None = MODEL) -> DataFrame:
    """Windows of the conversations in ``rows`` (conv_id, turn, role, text): conv_id, window (from 0), text, n_repeated
    (turns at its start that earlier windows had), n_tokens, and the loss mask's stretches as places in ``text``.

    Turns come by turn number, nulls first, ties by role and text; a null text or role is empty. Of the history as much is
    repeated as leaves room for the next turn; a turn that is over the budget with the system turn is a window of its own,
    whole, after that turn alone. Turns of any length stay whole, repeated rows are turns of their own. Other columns are left out; rows of a null conv_id are one
    conversation. An empty table gives no window. Tokens are those of the roles and texts in the vocabulary ``model``.
    """
    small_batches(rows.sparkSession)
    content = None
    if model:
        with open(model, "rb") as f:  # on the driver; workers get the content
            content = f.read()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = None
        for frame in frames:
            out = []
            count, roles, texts = _counter(content), frame["role"].tolist(), frame["text"].tolist()
            of_role = dict(zip(found := list(set(roles)), count(found), strict=True))
            sizes = [of_role[role] + n for role, n in zip(roles, count(texts), strict=True)]
            for conv, role, text, size in zip(frame["conv_id"], roles, texts, sizes, strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if current is None or current.conv != conv:
                    out += current.last() if current else ()
                    current = _Windows(conv, budget, history)
                out += current.add(role, text, size)
            yield _frame(out)
        if current:
            yield _frame(list(current.last()))

    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInPandas(run, WINDOWS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "window", "text", "n_repeated", "n_tokens", "loss_start", "loss_end"])
    return out.astype({"conv_id": "Int64", "window": "int64", "n_repeated": "int32", "n_tokens": "int64"})


def turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns that a window holds."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(text)]


def read_back(windows: DataFrame) -> DataFrame:
    """A row for each conversation: what its windows say, read from their text and masks alone.

    Rows must come as ``formatted`` makes them: windows of a conversation together and in order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, none = None, object()
        conv = none
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

        def done() -> tuple:
            n, digest, chars, loss, size, windows = current
            return conv, n, digest.hexdigest(), chars, loss.hexdigest(), size, windows

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"} | dict.fromkeys(("n_turns", "loss_chars", "formatted_chars", "n_windows"), "int64"))

        for batch in frames:
            out = []
            for c, text, skip, begins, ends in zip(batch["conv_id"], batch["text"], batch["n_repeated"], batch["loss_start"], batch["loss_end"], strict=True):
                c = None if pd.isna(c) else int(c)
                if conv is none or c != conv:
                    if conv is not none:
                        out.append(done())
                    conv, current = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in turns(text)[skip:]:
                    current[0] += 1
                    current[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(begins, ends, strict=True):
                    said = unescape(text[a:b])
                    current[2] += len(said)
                    current[3].update(said.encode("utf-8", "surrogatepass"))
                current[4] += len(text)
                current[5] += 1
            yield frame(out)
        if conv is not none:
            yield frame([done()])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return windows.mapInPandas(run, schema)


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(formatted(rows))
