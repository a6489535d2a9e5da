"""Chat formatting by assembly of tokens.

Each turn is four segments: a reserved id that opens it, its role, a reserved id, its text, and a reserved id that
closes it. Role and text are escaped, encoded separately as ordinary text and spliced between the reserved ids, so
no content can yield a reserved id. The loss mask is a prefix sum over marks of +1 and -1 at the ends of each
assistant text. As text, the reserved ids show as control strings; those strings, and others that chat templates
use, are escaped where content holds them: a backslash goes in after the first character, and one more is added
where some stand there already, so that taking one out restores the content.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.bpe import load_ranks

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Control strings of this template and of others; none may stand in content unescaped.
CONTROL = (TURN, BODY, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_RAW = re.compile("|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    """Content with no control string left in it; ``unescape`` restores it."""
    return _RAW.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


class ChatCodec:
    """Ids of ordinary text come from a rank file; the three reserved ids follow them."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = load_ranks(path)
        first = max(ranks.values()) + 2  # one id stays free for the vocabulary's own end of text
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={TURN: first, BODY: first + 1, END: first + 2})
        self.turn, self.body, self.end = first, first + 1, first + 2

    def ordinary(self, text: str) -> np.ndarray:
        """The ids of a text by ordinary tokens alone, in pieces of bounded length that are cut at newlines."""
        if len(text) <= 1 << 20:
            return np.array(self.encoding.encode_ordinary(text), np.int32)
        cuts = [m.start() for m in re.finditer(r"(?<=\S)\n(?=\S)", text)]
        parts, at = [], 0
        for cut in [*(c for c, d in zip(cuts, [*cuts[1:], len(text)]) if c >> 19 != d >> 19), len(text)]:
            parts.append(np.array(self.encoding.encode_ordinary(text[at:cut]), np.int32))
            at = cut
        return np.concatenate(parts)

    def assemble(self, role: str, text: str, loss: bool) -> tuple[np.ndarray, np.ndarray]:
        """A turn's ids and its mask (1: under the loss)."""
        segments = [np.array([self.turn], np.int32), self.ordinary(escape(role)), np.array([self.body], np.int32), self.ordinary(escape(text)), np.array([self.end], np.int32)]
        ends = np.cumsum([len(s) for s in segments])
        marks = np.zeros(ends[-1] + 1, np.int8)
        if loss:
            marks[ends[2]] += 1
            marks[ends[3]] -= 1
        return np.concatenate(segments), np.cumsum(marks[:-1], dtype=np.int8)

    def render(self, ids: np.ndarray) -> str:
        """The formatted text: reserved ids show as control strings."""
        return self.encoding.decode(ids.tolist())

    def turns(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """Role and text of each turn, read back from ids."""
        opened, bodies, closed = (np.flatnonzero(ids == x) for x in (self.turn, self.body, self.end))
        for a, b, c in zip(opened.tolist(), bodies.tolist(), closed.tolist()):
            yield tuple(unescape(self.encoding.decode(ids[x + 1 : y].tolist())) for x, y in ((a, b), (b, c)))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ChatCodec:
    return ChatCodec(path, pattern)


def format_turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """The formatted turns of every conversation, a row for each turn: conv_id, seq (from 0), ids, mask (both arrays of int).

    A conversation's output is its rows joined in the order of seq; so a conversation of any length is never held at once.
    Turns are ordered by ``turn`` (nulls first), ties by role and text. Null roles and texts count as empty; a null
    conv_id is a conversation of its own. Other columns are ignored. Rows are dealt by conv_id and sorted, then streamed.
    """
    conv = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        chat = codec(path, pattern)
        last, seq = object(), -1
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                seqs, ids, masks = [], [], []
                for c, role, text in zip(*(part.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                    last, seq = c, seq + 1 if c == last else 0
                    i, m = chat.assemble(role or "", text or "", role == "assistant")
                    seqs.append(seq)
                    ids.append(i)
                    masks.append(m.astype(np.int32))
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array(seqs, pa.int64()), pa.array(ids, ints), pa.array(masks, ints)], ["conv_id", "seq", "ids", "mask"])

    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {conv}, seq bigint, ids array<int>, mask array<int>")


def digest_conversations(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """What the formatted output of each conversation holds, read back from ids and masks alone.

    The rows of ``format_turns`` come out in order and a conversation's rows lie in one partition, so they are read as a stream; its state is two running digests.
    """
    conv = turns.schema["conv_id"].dataType.simpleString()
    formatted = format_turns(turns, path, pattern)
    schema = f"conv_id {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def read(batches):
        chat = codec(path, pattern)
        open_: list | None = None

        def close(s):
            return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

        for batch in batches:
            done = []
            columns = [batch.column(n) for n in ("conv_id", "seq", "ids", "mask")]
            for c, seq, ids, mask in zip(*columns):
                c = c.as_py()
                if seq.as_py() == 0:
                    if open_:
                        done.append(close(open_))
                    open_ = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                for role, text in chat.turns(ids):
                    open_[1] += 1
                    open_[2].update(f"{role}\n{text}\n".encode())
                loss = unescape(chat.encoding.decode(ids[mask == 1].tolist()))
                open_[3] += len(loss)
                open_[4].update(loss.encode())
                open_[5] += len(chat.render(ids))
            yield _rows(done, batch.schema.field("conv_id").type)
        if open_:
            yield _rows([close(open_)], pa.int64() if conv == "bigint" else None)

    def _rows(done, kind):
        columns = list(zip(*done)) if done else [[]] * 6
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(read, schema)


#: A conversation that speaks in control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_probe(turns: DataFrame) -> DataFrame:
    """All conversations and conversation -1."""
    probe = turns.sparkSession.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    return turns.select(*(F.col(n).cast(k).alias(n) for n, k in (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")))).union(probe)
