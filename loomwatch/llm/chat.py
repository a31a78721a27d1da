"""Chat formatting at the level of tokens, with a loss mask.

Template of a turn: ``<|im_start|>`` role line-feed text ``<|im_end|>`` line-feed. The two control strings are
never encoded as text: the role with its line feed, the text, and the closing line feed are encoded separately and the reserved ids
(above the tokenizer's own) are spliced in between. Control strings that occur inside a role or text are escaped, one backslash
more after ``<|`` for each that is there already, which the reader takes away again; so the formatted string, too, has one reading.
A line feed or backslash of a role is escaped likewise, so that the first line feed always ends the role. Segment lengths, summed up,
give each segment's place; the loss mask is what lies in an assistant's text segment.

The output is a table of turns in token form: conv_id, turn, seq (place in the conversation), token_start (tokens of the conversation
before it), ids (little-endian, two bytes each if the vocabulary allows, else four), loss_from and loss_to (the tokens of the turn
that count). ``read_back`` rebuilds roles and texts from ids and range alone.

A conversation is never gathered: places are prefix sums over blocks of a conversation's turns, and the digest that a conversation's
contract asks for is fed turn by turn from rows sorted within partitions, in constant memory.

Defined results: null text or role counts as empty; turns go by turn, null turns first, ties by their token bytes;
rows with a null conv_id form one conversation of their own; repeated rows are turns of their own; a very long text is one turn; an
empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from loomwatch.llm.common import byte_level_encoder, load_tokenizer, materialise, text_slices

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<|\\\1\2|>", text) if "<|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<|\1\2|>", text) if "<|" in text else text


@functools.lru_cache(maxsize=2)
def reserved(vocab: str) -> tuple[int, int]:
    """Ids of the two control tokens: the first two above the vocabulary."""
    n = load_tokenizer(vocab).get_vocab_size()
    return n, n + 1


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role))


def id_type(vocab: str) -> str:
    return "<u2" if reserved(vocab)[1] < 1 << 16 else "<u4"


def encode_turns(turns: DataFrame, vocab: str) -> DataFrame:
    """conv_id, turn, ids (bytes), n (tokens), loss_from, loss_to of (conv_id, turn, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(vocab)
        width = np.dtype(kind).itemsize
        encode = byte_level_encoder(vocab, kind)
        start, end = (np.array([i], kind).tobytes() for i in reserved(vocab))
        tail = end + encode(["\n"])[0]
        for b in text_slices(batches):
            roles, texts = (b.column(c).to_pylist() for c in ("role", "text"))
            heads = encode([escape_role(r) + "\n" for r in roles])
            bodies = encode([escape(t) for t in texts])
            ids = [b"".join((start, h, x, tail)) for h, x in zip(heads, bodies)]
            sizes = np.array([[len(start) + len(h), len(x), len(tail)] for h, x in zip(heads, bodies)], np.int64).reshape(-1, 3) // width
            ends = sizes.cumsum(axis=1)
            talks = np.array([r == "assistant" for r in roles], bool)
            columns = (ends[:, 2], np.where(talks, ends[:, 0], 0), np.where(talks, ends[:, 1], 0))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), pa.array(ids, pa.binary()), *(pa.array(c.astype(np.int32)) for c in columns)],
                ["conv_id", "turn", "ids", "n", "loss_from", "loss_to"],
            )

    src = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids binary, n int, loss_from int, loss_to int")


def format_chat(conversations: DataFrame, vocab: str, block_turns: int = 1024) -> DataFrame:
    """conv_id, turn, seq, token_start, ids, loss_from, loss_to.

    A long conversation is numbered in blocks of ``block_turns`` turn numbers, each with the sums of those before it: no window takes a
    whole conversation, but one of block totals."""
    e = materialise(encode_turns(conversations, vocab).withColumn("_block", F.floor(F.coalesce("turn", F.lit(-1)) / block_turns)))
    before = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = e.groupBy("conv_id", "_block").agg(F.count("*").alias("_turns"), F.sum("n").alias("_tokens"))
    base = totals.select(
        F.col("conv_id").alias("_conv"), F.col("_block").alias("_of"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_turns", "_tokens"))
    )
    w = W.partitionBy("conv_id", "_block").orderBy("turn", "ids")
    inside = F.coalesce(F.sum(F.col("n").cast("long")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = e.withColumn("_seq", F.row_number().over(w) - 1).withColumn("_start", inside)
    return ranked.join(base, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_of"))).select(
        "conv_id", "turn", (F.col("_turns_before") + F.col("_seq")).alias("seq"), (F.col("_tokens_before") + F.col("_start")).alias("token_start"), "ids", "loss_from", "loss_to"
    )


def decoded(b: pa.RecordBatch, vocab: str) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the loss range, code points of the turn, escapes included) of formatted turns."""
    tk, kind = load_tokenizer(vocab), id_type(vocab)
    start, end = reserved(vocab)
    fixed = len(START) + len(END) + 1
    ids = [np.frombuffer(x.as_buffer(), kind) for x in b.column("ids")]
    stops = [int(np.flatnonzero(i == end)[0]) for i in ids]
    if any(i[0] != start or (i == start).sum() != 1 or (i == end).sum() != 1 for i in ids):
        raise ValueError("control ids out of place")
    inner = tk.decode_batch([i[1:z].tolist() for i, z in zip(ids, stops)], skip_special_tokens=False)
    ranges = zip(b.column("loss_from").to_pylist(), b.column("loss_to").to_pylist())
    under = tk.decode_batch([i[s:e].tolist() for i, (s, e) in zip(ids, ranges)], skip_special_tokens=False)
    for x, u in zip(inner, under):
        role, _, text = x.partition("\n")
        yield unescape_role(role), unescape(text), unescape(u), len(x) + fixed


def read_back(formatted: DataFrame, vocab: str) -> DataFrame:
    """conv_id, seq, role, text, loss_text, formatted_chars (of the turn, escapes included), all from ids and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = zip(*decoded(b, vocab))
                yield pa.RecordBatch.from_arrays(
                    [b.column("conv_id"), b.column("seq"), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64())))],
                    ["conv_id", "seq", "role", "text", "loss_text", "formatted_chars"],
                )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", F.col("seq").cast("int").alias("seq"), "ids", "loss_from", "loss_to").mapInArrow(
        run, f"conv_id {kind}, seq int, role string, text string, loss_text string, formatted_chars long"
    )


def digest(formatted: DataFrame, vocab: str) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; token rows travel, texts are read back
    where they are fed to the digests, turn by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def close(conv, s) -> list:
            return [conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]]

        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for whole in batches:
            kinds[0] = whole.schema.field("conv_id").type
            out = []
            for b in (whole.slice(k, 2000) for k in range(0, whole.num_rows, 2000)):
                for conv, (role, text, loss, chars) in zip(b.column("conv_id").to_pylist(), decoded(b, vocab)):
                    if state is None or conv != now:
                        if state is not None:
                            out.append(close(now, state))
                        now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                    state[4] += chars
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(close(now, state), kinds)], names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "seq", "ids", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
