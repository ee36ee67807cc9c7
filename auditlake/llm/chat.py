"""Chat formatting at the level of tokens (operator 13).

A turn is `<turn>` role `<say>` text `</turn>`. The three marks are reserved ids above
the vocabulary; role and text are encoded each for itself and spliced between them,
so no merge reaches over a mark. Places of turns and the loss mask follow from prefix
sums over the lengths of the segments. Texts can't forge a turn: the ids of marks
never come from a text, and in the text form a backslash stands before each control
string and each backslash of a text.

A conversation's turns are pieces of one token sequence, laid end to end by `start`.

Defined results: null text and null role are empty; turns of a conversation are in
order of turn (null first), then role, then text, so ties and repeated rows are kept
in a fixed order; a null conversation id is a conversation of its own; texts may have
any length; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import ship, slices, written

TOKENIZER = "byte_bpe_50k.tiktoken"
#: The template's marks, and what other templates use to mark turns.
MARKS = ["<turn>", "<say>", "</turn>"]
CONTROLS = [*MARKS, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "### System:", "### User:", "### Assistant:"]
LEARNT = "assistant"

_TURN = "conv_id bigint, turn bigint, ids array<int>, mask array<boolean>, chars bigint"
_TURN_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_())), ("chars", pa.int64())])
_READ = "conv_id bigint, turn bigint, role string, text string, loss string, chars bigint"
_READ_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.string()), ("chars", pa.int64())])
_CONV = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _special(controls: list[str]) -> str:
    """A pattern for a backslash or a control string. No control string may begin inside another one, or the inner one would stay bare."""
    for a in controls:
        for b in controls:
            if any(a[i:].startswith(b) or b.startswith(a[i:]) for i in range(1, len(a))):
                raise ValueError(f"control strings overlap: {a} and {b}")
    escaped = ["".join("\\" + c if not c.isalnum() else c for c in x) for x in controls]
    return "(\\\\|" + "|".join(escaped) + ")"


def escape(texts: pa.Array, controls: list[str] = CONTROLS) -> pa.Array:
    return pc.replace_substring_regex(texts, _special(controls), r"\\\1")


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"(?s)\\(.)", r"\1")


class _Vocabulary:
    """A byte-level vocabulary and the reserved ids after it."""

    known: dict[str, _Vocabulary] = {}

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(name if "/" in name else public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        self.marks = range(top, top + len(MARKS))
        pieces = [b""] * (top + len(MARKS))
        for raw, i in ranks.items():
            pieces[i] = raw
        for i, mark in zip(self.marks, MARKS, strict=True):
            pieces[i] = mark.encode()
        self.size = np.array([len(x) for x in pieces])
        self.first = np.append(0, np.cumsum(self.size))
        self.raw = np.frombuffer(b"".join(pieces), np.uint8)

    @classmethod
    def of(cls, name: str) -> _Vocabulary:
        if name not in cls.known:
            cls.known[name] = cls(name)
        return cls.known[name]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.encoding.encode_ordinary_batch(texts, num_threads=1)

    def bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id's begin."""
        size = self.size[ids]
        at = np.append(0, np.cumsum(size))
        return self.raw[np.repeat(self.first[ids] - at[:-1], size) + np.arange(at[-1])], at


def _strings(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings raw[begin:end], which follow on each other with gaps."""
    size = end - begin
    at = np.append(0, np.cumsum(size))
    data = raw[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data.tobytes())])


def _assemble(tokenizer: str, learnt: str, controls: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary.of(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                role, text = part.column("role"), part.column("text")
                roles, texts = escape(role, controls), escape(text, controls)
                said, names = vocabulary.encode(texts.to_pylist()), vocabulary.encode(roles.to_pylist())
                n = part.num_rows
                # Lengths of the segments <turn>, role, <say>, text, </turn> of every turn; their prefix sums are their places.
                length = np.ones((n, 5), np.int64)
                length[:, 1], length[:, 3] = [len(x) for x in names], [len(x) for x in said]
                at = np.append(0, np.cumsum(length.ravel()))
                begin = at[:-1].reshape(n, 5)
                ids = np.empty(at[-1], np.int32)
                for k, mark in zip((0, 2, 4), vocabulary.marks, strict=True):
                    ids[begin[:, k]] = mark
                for k, parts in ((1, names), (3, said)):
                    flat = np.array([x for p in parts for x in p], np.int32)
                    own = np.append(0, np.cumsum(length[:, k]))
                    ids[np.repeat(begin[:, k] - own[:-1], length[:, k]) + np.arange(own[-1])] = flat
                # The mask rises where a learnt text begins and falls where it ends.
                step = np.zeros(at[-1] + 1, np.int64)
                learns = np.array([x == learnt for x in role.to_pylist()], bool)
                np.add.at(step, begin[learns, 3], 1)
                np.add.at(step, begin[learns, 4], -1)
                mask = np.cumsum(step[:-1]) > 0
                edges = pa.array(np.append(begin[:, 0], at[-1]).astype(np.int32))
                chars = pc.add(pc.add(pc.utf8_length(roles), pc.utf8_length(texts)), sum(map(len, MARKS))).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), pa.ListArray.from_arrays(edges, pa.array(ids)), pa.ListArray.from_arrays(edges, pa.array(mask)), chars], schema=_TURN_ARROW)

    return run


def format_turns(conversations: DataFrame, tokenizer: str = TOKENIZER, learnt: str = LEARNT, controls: list[str] = CONTROLS) -> DataFrame:
    """One row per turn: conv_id, turn, ids, mask (true where a loss counts), chars (code points of the text form)."""
    ship(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    _special(controls)
    return rows.mapInArrow(_assemble(tokenizer, learnt, controls), _TURN)


def placed(turns: DataFrame) -> DataFrame:
    """The turns with `start`, their place in their conversation's sequence: a prefix sum over the turns before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("start", F.coalesce(F.sum(F.size("ids")).over(order), F.lit(0)).cast("long"))


def _read(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary.of(tokenizer)
        for batch in batches:
            ids, mask = batch.column("ids"), batch.column("mask")
            flat, under = ids.flatten().to_numpy(), mask.flatten().to_numpy(zero_copy_only=False)
            raw, at = vocabulary.bytes(flat)
            # A turn has each mark once: the place of each is found by its id.
            marks = [np.flatnonzero(flat == m) for m in vocabulary.marks]
            role, text = _strings(raw, at[marks[0] + 1], at[marks[1]]), _strings(raw, at[marks[1] + 1], at[marks[2]])
            # What the mask covers, turn by turn, with the marks if it covered any.
            rows = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy()))
            size = np.append(0, np.cumsum(np.where(under, vocabulary.size[flat], 0)))
            covered = raw[np.repeat(under, vocabulary.size[flat])]
            loss = _strings(covered, size[rows[:-1]], size[rows[1:]])
            chars = _strings(raw, at[rows[:-1]], at[rows[1:]])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), unescape(role).cast(pa.string()), unescape(text).cast(pa.string()), unescape(loss).cast(pa.string()), pc.utf8_length(chars).cast(pa.int64())], schema=_READ_ARROW)

    return run


def read_back(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The turns read from the token ids alone: conv_id, turn, role, text, loss (text under the mask), chars."""
    ship(turns.sparkSession)
    return turns.select("conv_id", "turn", "ids", "mask").mapInArrow(_read(tokenizer), _READ)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose turns come in order; one at a time is held, and of that one no text."""
    state = None

    def done():
        conv, turns, every, n, loss, chars = state
        return {"conv_id": conv, "n_turns": turns, "turns_sha256": every.hexdigest(), "loss_chars": n, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        ended = []
        for conv, role, text, loss, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "chars")), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    ended.append(done())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(loss)
            state[4].update(loss.encode())
            state[5] += chars
        if ended:
            yield pa.RecordBatch.from_pylist(ended, schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([done()], schema=schema)


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of what read_back() returns.

    A digest takes a conversation's turns one after the other, so one task reads them, in order and without holding them.
    """
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_digest, _CONV)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").union(own)
    return digests(read_back(written(placed(format_turns(rows)), "chat")))


ORACLE_OP13 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(i)
), e AS (
  SELECT *, 18 + length(regexp_replace(role, '(\\|<turn>|<say>|</turn>|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|\[INST\]|\[/INST\]|### System:|### User:|### Assistant:)', '_\1', 'g'))
    + length(regexp_replace(text, '(\\|<turn>|<say>|</turn>|<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|\[INST\]|\[/INST\]|### System:|### User:|### Assistant:)', '_\1', 'g')) AS chars FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
