"""Shared folder, materialised cuts, tokenizer access and per-task helpers."""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwatch.session import shared_dir

WS = "[\\x20\\x09-\\x0D]+"


def new_path(spark: SparkSession) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/loomwatch-{uuid.uuid4().hex}"


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes the rows as Parquet to the shared folder and reads them back: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def squeeze(a: np.ndarray) -> bytes:
    """The array's bytes, compressed, behind their length."""
    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def restore(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), dtype)


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, each with a number of its own, and the name of its column. They are written once: every later read meets the
    same numbers, also where ids repeat or are null."""
    name = free_name(docs, "_row")
    return materialise(docs.withColumn(name, F.monotonically_increasing_id())), name


def text_or_empty(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row; a null text counts as empty. Other columns are left behind."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def one_key_each(spark: SparkSession, n: int) -> list[int]:
    """n whole numbers of which ``repartition(n, key)`` sends each to a task of its own."""
    tried = spark.range(24 * n).select(F.col("id").cast("int").alias("k"))
    found = {r["p"]: r["k"] for r in tried.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()}
    spare = iter(range(24 * n, 25 * n))
    return [found[p] if p in found else next(spare) for p in range(n)]


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """One tokenizer per Python worker; strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    return tk


@functools.lru_cache(maxsize=2)
def load_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_slices(batches: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches with a ``text`` column so that one slice holds about ``max_bytes`` of text."""
    for b in batches:
        if b.num_rows == 0:
            continue
        per_row = max(1, b.nbytes // b.num_rows)
        step = max(1, max_bytes // per_row)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


class Memo(dict):
    """Two generations: what was used since the last turn survives the next one. Holds 2 * ``size`` keys at most,
    plus those of the slice in work."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value

    def turn(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()

    def unknown(self, keys: set) -> list:
        return [k for k in keys.difference(self) if k not in self.old]


class ChunkEncoder:
    """Token ids of a text (as little-endian bytes) from independent chunks, each distinct chunk encoded once.

    ``fast`` marks the cuts of a text without double white space by ``mark``, ``slow`` those of any other; both cut only where the tokenizer's own
    pre-tokenizer cuts whatever stands on either side. Texts with separators on which Python and the tokenizer
    disagree are encoded whole. ``plain`` gives the letters of the one pre-token that an all-letter chunk becomes, or None;
    Unknown chunks of this kind go to the tokenizer many at a time;
    the letters of the tokens that come back say which chunk they belong to. ``parts`` gives the pre-tokens of any other chunk where it can tell
    them, else None; those are chunks of their own. What is left goes one by one.
    """

    def __init__(self, tokenizer, fast, slow, mark: str, plain, lead: str, glue: tuple[str, int], dtype: str, memo: int = 300_000, together: int = 256, parts=lambda chunk: None):
        """``glue``: white space that parts two chunks, and the letters that it becomes; ``lead``: what a chunk that needs none begins with."""
        self.parts, self.tk, self.fast, self.slow, self.mark, self.plain, self.lead, self.glue, self.dtype = parts, tokenizer, fast, slow, mark, plain, lead, glue, dtype
        self.width, self.together = np.dtype(dtype).itemsize, together
        self.known = Memo(memo)
        size = tokenizer.get_vocab_size(with_added_tokens=False)
        end = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
        self.letters = np.array([len((tokenizer.id_to_token(k) or "").removesuffix(end)) for k in range(size)], np.int64)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn_letters(self, chunks: list[str]) -> list[str]:
        """Encodes chunks of ASCII letters behind at most one ``lead`` many at a time, and with them those that end in a mark; what is left."""
        known = self.known
        all_ = pa.array(chunks, pa.large_string())
        kind = pc.match_substring_regex(all_, "^ ?[A-Za-z]+$").to_numpy(zero_copy_only=False)
        ended = pc.match_substring_regex(all_, "^ ?[A-Za-z]{2,}[.,;:!?]$").to_numpy(zero_copy_only=False)
        ends_in = list(compress(chunks, ended))
        words = list(compress(chunks, kind))
        bases = {c[:-1] for c in ends_in}.difference(words)
        words += [c for c in bases if c not in known and c not in known.old]
        glue, more = self.glue
        lost = []
        for led in (True, False):
            group = [c for c in words if (c[0] == self.lead) == led]
            between, extra = ("", 0) if led else (glue, more)
            lots = [group[k : k + self.together] for k in range(0, len(group), self.together)]
            for lot, e in zip(lots, self.tk.encode_batch_fast([between.join((*x, "")) for x in lots], add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                ends = np.cumsum(self.letters[ids])
                n = np.fromiter(map(len, lot), np.int64, len(lot))
                upto = np.cumsum(n + extra) - extra
                last, first = np.searchsorted(ends, upto), np.searchsorted(ends, upto - n, "right")
                if not len(ends) or ends[-1] != upto[-1] + extra or (ends[last] != upto).any() or (np.where(first > 0, ends[first - 1], 0) != upto - n).any():
                    lost += lot  # not cut where expected
                    continue
                raw = ids.tobytes()
                known.update(zip(lot, [raw[a:b] for a, b in zip((first * self.width).tolist(), ((last + 1) * self.width).tolist())]))
        for c in lost:
            known[c] = self._whole(c)
        if ends_in:
            mark = {c: self._whole(c) for c in MARKS}
            known.update([(c, known[c[:-1]] + mark[c[-1]]) for c in ends_in])
        return list(compress(chunks, ~(kind | ended)))

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks that the memo does not hold."""
        plain, known, bases, rest = self.plain, self.known, {}, []
        chunks = self._learn_letters(chunks)
        led, bare, marked, parted = [], [], [], []
        single: set[str] = set()
        for c in chunks:
            if (n := plain(c)) is not None:
                bases[c] = n
            elif len(c) > 2 and c[-1] in MARKS and (n := plain(c[:-1])) is not None:
                marked.append(c)
                if c[:-1] not in known and c[:-1] not in known.old:
                    bases[c[:-1]] = n
            elif (parts := self.parts(c)) is not None:
                parted.append((c, parts))
                single.update(parts)
            else:
                rest.append(c)
        for c in known.unknown(single):
            if (n := plain(c)) is not None:
                bases[c] = n
            else:
                rest.append(c)
        for c, n in bases.items():
            if c[0] == self.lead:
                led.append((c, n))
            else:
                bare += ((c, n), self.glue)
        todo = led + bare
        lots = [todo[k : k + self.together] for k in range(0, len(todo), self.together)]
        for lot, e in zip(lots, self.tk.encode_batch_fast(["".join(c for c, _ in x) for x in lots], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            ends = np.cumsum(self.letters[ids])
            lot = [x for x in lot if x[1]]
            want = np.cumsum([n for _, n in lot])
            at = np.searchsorted(ends, want)
            if not len(ends) or ends[-1] != want[-1] or (ends[np.minimum(at, len(ends) - 1)] != want).any():
                rest += [c for c, _ in lot]  # not cut where expected
                continue
            raw, before = ids.tobytes(), 0
            for (c, _), x in zip(lot, ((at + 1) * self.width).tolist()):
                known[c] = raw[before:x]
                before = x
        for k in range(0, len(rest), self.together):
            lot = rest[k : k + self.together]
            for c, e in zip(lot, self.tk.encode_batch_fast(lot, add_special_tokens=False)):
                known[c] = np.array(e.ids, self.dtype).tobytes()
        for c in MARKS if marked else ():
            if c not in known:
                known[c] = self._whole(c)
        for c in marked:
            known[c] = known[c[:-1]] + known[c[-1]]
        for c, parts in parted:
            known[c] = b"".join([known[x] for x in parts])

    def __call__(self, texts: list[str], lot_chars: int = 4 << 20) -> list[bytes]:
        """Texts are taken in lots of about ``lot_chars``: the chunks of one lot are held at a time."""
        out: list[bytes] = []
        first = size = 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= lot_chars or k + 1 == len(texts):
                out += self._lot(texts[first : k + 1])
                first, size = k + 1, 0
        return out

    def _lot(self, texts: list[str]) -> list[bytes]:
        """Arrow cuts the texts, numbers the distinct chunks and strings their ids together; only distinct chunks are Python objects."""
        self.known.turn()
        unsafe = {k for k, t in enumerate(texts) if _UNSAFE(t)}
        marked = ["" if k in unsafe else self.slow(t) if "  " in t or " \n" in t or _RUN(t) else self.fast(t) for k, t in enumerate(texts)]
        cut = pc.split_pattern(pa.array(marked, pa.large_string()), self.mark)
        del marked
        ends = cut.offsets.to_numpy()
        each = cut.flatten().dictionary_encode()
        del cut
        distinct = each.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(self.known.unknown(set(distinct) - {""}))
        get = self.known.__getitem__
        ids = pa.array([get(c) if c else b"" for c in distinct], pa.large_binary()).take(each.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[ends].tolist() if len(ids) else [0] * len(ends)
        raw = memoryview(ids.buffers()[2]) if at[-1] else b""
        return [self._whole(t) if k in unsafe else bytes(raw[at[k] : at[k + 1]]) for k, t in enumerate(texts)]


#: Separators that Python takes for white space and the tokenizers do not.
_UNSAFE = re.compile("[\x1c-\x1f]").search
MARKS = ".,;:!?"
_RUN = re.compile(r"\n\s").search
_BYTE_LEVEL = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
_ASCII_WS = re.compile(r"[\x20\t-\r]+")


def _cut_before_space(t: str) -> str:
    return t.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f")


def _plain_cased(chunk: str) -> int | None:
    return len(chunk.encode()) if (chunk[1:] if chunk[:1] == " " else chunk).isalpha() else None


#: The pre-tokens of ASCII text in lower case, as the word-level vocabularies cut it.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall


def _ascii_parts(chunk: str) -> list[str] | None:
    """None where a special string may stand in the chunk."""
    return None if "<|" in chunk or not chunk.isascii() else _ASCII_WORDS(chunk.lower())


#: The pre-tokens of ASCII text, as the byte-level vocabularies cut it.
_ASCII_CASED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+").findall


def _ascii_cased_parts(chunk: str) -> list[str] | None:
    """None where a special string or white space that stands for itself may be in the chunk."""
    if "<|" in chunk or not chunk.isascii():
        return None
    parts = _ASCII_CASED(chunk)
    return parts if len("".join(parts)) == len(chunk) else None


def _plain_lower(chunk: str) -> int | None:
    if not chunk.isalpha():
        return None
    if chunk.isascii():
        return len(chunk)
    if "\u03a3" in chunk or "\u0130" in chunk or not unicodedata.is_normalized("NFC", chunk):
        return None
    low = chunk.lower()
    return len(low.encode()) if low.isalpha() else None


@functools.lru_cache(maxsize=4)
def byte_level_encoder(path: str, dtype: str = "<u4") -> ChunkEncoder:
    """For byte-level BPE whose pre-tokenizer keeps one leading space with a word."""
    slow = lambda t: "\x1f".join(_BYTE_LEVEL.findall(t))
    return ChunkEncoder(load_tokenizer(path), _cut_before_space, slow, "\x1f", _plain_cased, " ", ("\n", 1), dtype, parts=_ascii_cased_parts)


@functools.lru_cache(maxsize=4)
def word_encoder(path: str, dtype: str = "<u4") -> ChunkEncoder:
    """For BPE that lower-cases and drops white space: runs of ASCII white space are safe cuts."""
    return ChunkEncoder(load_tokenizer(path), lambda t: t.replace("\n", " "), lambda t: _ASCII_WS.sub(" ", t), " ", _plain_lower, "", (" ", 0), dtype, parts=_ascii_parts)
