"""Document scores by prediction by partial matching over byte contexts, with a word-count base line.

A text is its words (``[^\\x20\\x09-\\x0D]+``, A-Z lowered) and one end. The longest context of a word reaches back over the two
words before it (or the document's start): where it was met in training it predicts all bytes of the word with its closing symbol
at once, or escapes. Below it each word is coded byte by byte with a closing symbol, the end by a symbol of its own, each
under the preceding bytes of the word (padded at its start): contexts of order ``order`` down to 0, then all unseen symbols
alike. Escapes are estimated by method C (distinct / (total + distinct)), and symbols of a longer byte context are excluded
below it. Because a longer context's symbols are among a shorter one's, what is excluded is a sum per trie node, so a whole group
of nodes is scored by vector operations. The trie is pretrained on the training documents.

No table of the corpus is broadcast but the counts of order 0 and 1 (256 x 256 numbers). A block of texts sends each distinct
word, each distinct (byte context, symbol) and each distinct (two words, word) once, packed by destination: words and word
contexts by their hash, the trie by the two nearest context bytes. A destination counts its share over all blocks and
answers each block in the order in which it was asked. The block is then built
from the input again, asks itself the same questions, and sums the answers by document. A key reaches its destination at most once from
each block, so a frequent word is no hot key. Destinations follow the session's shuffle partitions.

Defined results: null text counts as empty: the end alone; rows with a null doc_id are learnt from and scored; repeated
rows count again; without training documents counts are zero and every symbol has the same probability; a very long text makes a
block of its own; an empty table gives no rows; extra columns are ignored. Words are told apart by a 64-bit hash, word contexts by
44 bits of one and the words after a context by 20, at every size and under every setting: an accidental match costs precision of the
estimate, nothing else. The input is read twice and has to give the same rows in the same partitions both times, as a scan of
files does; where it does not, the job stops rather than score with another block's answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loomwatch.llm.common import materialise, partitions_for, restore, squeeze, text_slices
from loomwatch.llm.groups import by_group
from loomwatch.llm.words import _LOWER, Words, mix, text_bytes

PAD, CLOSE, END = 0x20, 0x20, 0x0D  # bytes that no word holds
END_KEY = np.uint64(0x1F3D5B79)
ALPHABET = 256

ASKED = "kind int, dest int, block long, keys binary, n binary"
TEXTS_OF = "block long, doc_ids array<long>, held array<boolean>, sizes binary, tokens binary, words binary, lengths binary"
WORD, CONTEXT, PAIR, TOTALS = 0, 1, 2, 3  # kinds of rows
ESCAPED = 1000.0  # added to the log probability of an escape, to tell it from that of a word
CONTEXT_BITS, NEXT_BITS = 44, 20  # of a word context and of the word after it: 64 in all, whatever the session or the input


def planes(a: np.ndarray) -> bytes:
    """An array's bytes, all lowest ones first and so on, compressed: numbers whose high bytes are alike become small."""
    return squeeze(np.ascontiguousarray(a.view("u1").reshape(-1, a.itemsize).T))


def whole(b: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(restore(b, "u1").reshape(size, -1).T).reshape(-1).view(dtype)


def steps(a: np.ndarray, dtype: str) -> bytes:
    """An array as differences (they wrap), which ascending numbers make small."""
    a = a.astype(dtype)
    return planes(np.diff(a, prepend=a.dtype.type(0)))


def sums(b: bytes, dtype: str) -> np.ndarray:
    return np.cumsum(whole(b, dtype), dtype=dtype)


def numbers_out(a: np.ndarray) -> bytes:
    """An array by its distinct values and their numbers."""
    table, code = np.unique(a, return_inverse=True)
    width = 1 if len(table) <= 1 << 8 else 2 if len(table) <= 1 << 16 else 4
    head = squeeze(table)
    return bytes([width]) + len(head).to_bytes(8, "little") + head + planes(code.astype(f"<u{width}"))


def numbers_in(b: bytes, dtype: str) -> np.ndarray:
    at = 9 + int.from_bytes(b[1:9], "little")
    return restore(b[9:at], dtype)[whole(b[at:], f"<u{b[0]}")]


def destination(kind: int, keys: np.ndarray, dests: int) -> np.ndarray:
    if kind == CONTEXT:
        keys = mix((keys >> np.uint64(8)) & np.uint64(0xFFFF))
    elif kind == PAIR:
        keys = keys >> np.uint64(NEXT_BITS)
        return ((keys * np.uint64(dests)) >> np.uint64(CONTEXT_BITS)).astype(np.int64)
    return (keys % np.uint64(dests)).astype(np.int64)


def word_contexts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A key (two words before, the word) for every word and the end of every document; documents lie end to end."""
    total = counts + 1
    ends = total.cumsum()
    h = np.full(int(ends[-1]) if len(ends) else 0, END_KEY)
    body = np.ones(len(h), bool)
    body[ends - 1] = False
    h[body] = hashes
    place = np.arange(len(h)) - np.repeat(ends - total, total)
    context = np.zeros(len(h), np.uint64)
    for back, mul in ((1, np.uint64(0x9E3779B97F4A7C15)), (2, np.uint64(0xC2B2AE3D27D4EB4F))):
        before = np.zeros(len(h), np.uint64)
        before[back:] = h[:-back]
        before[place < back] = np.uint64(back)  # before the start
        context = (context + before) * mul
    return ((mix(context) >> np.uint64(64 - CONTEXT_BITS)) << np.uint64(NEXT_BITS)) | (mix(h) >> np.uint64(64 - NEXT_BITS))


def hashes_of(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each word, which are given end to end."""
    out = np.full(len(words) + len(lengths), CLOSE, np.uint8)
    body = np.ones(len(out), bool)
    body[(lengths + 1).cumsum() - 1] = False
    out[body] = words
    return Words(out, np.array([0, len(out)])).hashes()


def contexts_of(words: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context bytes, nearest lowest, then the symbol in the lowest byte) of every symbol of the words, which
    are given end to end, and the number of symbols of each word; the end follows as a last word."""
    size = lengths + 1
    total = size.cumsum()
    key = np.empty(int(total[-1]) + 1 if len(total) else 1, np.uint64)
    read = np.concatenate(([0], lengths.cumsum()))
    for lo in range(0, len(lengths), 50_000):  # a bounded part of the words at a time
        hi = min(len(lengths), lo + 50_000)
        part, first = size[lo:hi], int(total[lo] - size[lo])
        at = total[lo:hi] - part - first
        out = np.full(int(part.sum()), CLOSE, np.uint8)
        body = np.ones(len(out), bool)
        body[at + part - 1] = False
        out[body] = words[read[lo] : read[hi]]
        place = np.arange(len(out)) - np.repeat(at, part)
        mine = out.astype(np.uint64)
        for k in range(1, order + 1):
            back = np.full(len(out), PAD, np.uint8)
            back[k:] = out[:-k]
            back[place < k] = PAD
            mine |= back.astype(np.uint64) << np.uint64(8 * k)
        key[first : first + len(out)] = mine
    key[-1] = sum(PAD << 8 * k for k in range(1, order + 1)) | END
    return key, np.append(size, 1)


class Block:
    """The distinct words of some texts, in order of frequency, and what a block asks of the destinations."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, local: np.ndarray, order: int, dests: int):
        """Words end to end, their lengths, the words of each document, and the number of each word."""
        self.sizes, self.local, self.dests = sizes, local, dests
        h = hashes_of(words, lengths)
        self.contexts, self.symbols = contexts_of(words, lengths, order)
        self.of = {WORD: np.append(h, END_KEY), CONTEXT: self.contexts, PAIR: word_contexts(h[local], sizes)}

    def asks(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys by destination, where each destination's begin, the place of every key among them)."""
        keys, inverse = np.unique(self.of[kind], return_inverse=True)
        to = destination(kind, keys, self.dests)
        by = np.argsort(to, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        return keys[by], np.searchsorted(to[by], np.arange(self.dests + 1)), place[inverse]


def in_blocks_of(block_bytes: int):
    """Texts to blocks: distinct words in order of frequency, and the documents as word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal number, held, size
            block = (part << 24) | number
            number += 1
            tokens = np.concatenate([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            seen, first, inverse, n = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
            by = np.argsort(-n, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            first, local = first[by], rank[inverse]
            # bytes of each distinct word, from where it is met first
            edges = np.cumsum([0, *(len(h[0]) for h in held)])
            lengths = np.concatenate([h[5] for h in held])[first] if len(first) else np.zeros(0, np.int64)
            spelled = np.zeros(int(lengths.sum()), np.uint8)
            to = lengths.cumsum() - lengths
            which = np.searchsorted(edges, first, "right") - 1
            for k, h in enumerate(held):
                mine = np.flatnonzero(which == k)
                if len(mine):
                    ln = lengths[mine]
                    step = np.arange(int(ln.sum())) - np.repeat(ln.cumsum() - ln, ln)
                    spelled[np.repeat(to[mine], ln) + step] = h[6][np.repeat(h[4][first[mine] - edges[k]], ln) + step]
            row = [
                block, [d for h in held for d in h[2]], np.concatenate([h[3] for h in held]).tolist(), squeeze(counts.astype("<u4")), planes(local.astype("<u4")),
                squeeze(_LOWER[spelled]), squeeze(lengths.astype("<u4")),
            ]
            held, size = [], 0
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [x.split()[0] for x in TEXTS_OF.split(", ")])

        for b in text_slices(batches, 1 << 19):
            data, offsets = text_bytes(b.column("text"))
            w = Words(data, offsets)
            held.append(
                (w.hashes(), np.diff(w.bounds), b.column("doc_id").to_pylist(), b.column("held").to_numpy(zero_copy_only=False),
                 w.starts, w.ends - w.starts, data.copy())
            )
            size += len(data)
            if size >= block_bytes:
                yield out()
        if held:
            yield out()
        pa.default_memory_pool().release_unused()

    return run


def block_of(row: dict, order: int, dests: int) -> Block:
    sizes, local = restore(row["sizes"], "<u4").astype(np.int64), whole(row["tokens"], "<u4").astype(np.int64)
    return Block(restore(row["words"], "u1"), restore(row["lengths"], "<u4").astype(np.int64), sizes, local, order, dests)


def questions(docs: DataFrame, block_bytes: int, order: int, dests: int) -> DataFrame:
    """(kind, dest, block, keys, n): distinct keys of a block and how often training documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks_of(block_bytes)(batches):
            for row in batch.to_pylist():
                b = block_of(row, order, dests)
                learns = ~np.array(row["held"], bool)
                train = np.repeat(learns, b.sizes)
                learnt = np.append(np.bincount(b.local[train], minlength=len(b.symbols) - 1), learns.sum())
                weights = {WORD: learnt, CONTEXT: np.repeat(learnt, b.symbols), PAIR: np.repeat(learns, b.sizes + 1)}
                for kind in (WORD, CONTEXT, PAIR):
                    keys, cuts, place = b.asks(kind)
                    n = np.bincount(place, weights[kind], len(keys)).astype("<u4")
                    some = np.flatnonzero(np.diff(cuts)).tolist()
                    rows = [(kind, d, row["block"], steps(keys[cuts[d] : cuts[d + 1]], "<u8"), squeeze(n[cuts[d] : cuts[d + 1]])) for d in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                        [x.split()[0] for x in ASKED.split(", ")],
                    )

    return docs.mapInArrow(run, ASKED)


def low_orders(docs: DataFrame) -> np.ndarray:
    """Counts of (nearest byte, symbol) in training documents: 256 x 256, all that order 0 and 1 need."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in text_slices(batches, 1 << 18):
            data, offsets = text_bytes(b.column("text"))
            w = Words(data, offsets)
            low = _LOWER[data].astype(np.int64)
            before = np.full(len(low), PAD)
            before[1:] = low[:-1]
            before[w.starts] = PAD
            inside = np.zeros(len(low) + 1, np.int64)
            inside[w.starts] += 1
            inside[w.ends] -= 1
            body = inside[:-1].cumsum() > 0
            total += np.bincount(before[body] << 8 | low[body], minlength=1 << 16)
            total += np.bincount(low[w.ends - 1] << 8 | CLOSE, minlength=1 << 16)
            total[PAD << 8 | END] += b.num_rows
        some = np.flatnonzero(total)
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    low = np.zeros(1 << 16, np.int64)
    for r in docs.filter("not held").select("text").mapInArrow(add, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        low[r["k"]] = r["n"]
    return low.reshape(256, 256)


def answers_of(asked: DataFrame, low: np.ndarray, order: int) -> DataFrame:
    """(block, kind, dest, values): for each word its training count, for each (byte context, symbol) its log10 probability, for
    each (word context, word) the same, or that of its escape with ESCAPED added (0 where the context was not met). A row of kind TOTALS per destination
    holds (training tokens, distinct ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["kind", "dest"]):
            kind, dest = t["kind"][0].as_py(), t["dest"][0].as_py()
            keys = [sums(x, "<u8") for x in t["keys"].to_pylist()]
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([restore(x, "<u4") for x in t["n"].to_pylist()]), len(distinct))
            if kind == PAIR:
                node, at = np.unique(distinct >> np.uint64(NEXT_BITS), return_inverse=True)
                total, kinds = np.bincount(at, n)[at], np.bincount(at, n > 0)[at]
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = np.where(n > 0, np.log10(n / (total + kinds)), np.where(total > 0, np.log10(kinds / (total + kinds)) + ESCAPED, ESCAPED))
            else:
                value = n.astype("<i8") if kind == WORD else chain(distinct, n, low, order)
            cuts = np.cumsum([0, *map(len, keys)])
            rows = [(b, kind, dest, numbers_out(value[inverse[i:j]])) for b, i, j in zip(t["block"].to_pylist(), cuts[:-1], cuts[1:])]
            if kind == WORD:
                rows.append((None, TOTALS, dest, np.array([n.sum(), (n > 0).sum()], float).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["block", "kind", "dest", "values"]
            )
            del t, keys, distinct, inverse, n, value, rows
            pa.default_memory_pool().release_unused()

    return asked.repartition("kind", "dest").sortWithinPartitions("kind", "dest").mapInArrow(run, "block long, kind int, dest int, values binary")


def chain(keys: np.ndarray, n: np.ndarray, low: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of each (context, symbol); ``keys`` holds whole nodes of order 2 and above."""
    sym, near = (keys & np.uint64(255)).astype(np.int64), ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    zero = low.sum(axis=0)
    counts = [zero[sym], low[near, sym]]
    totals = [np.full(len(keys), zero.sum()), low.sum(axis=1)[near]]
    kinds = [np.full(len(keys), (zero > 0).sum()), (low > 0).sum(axis=1)[near]]
    inside = [None, ((low > 0) * zero).sum(axis=1)[near]]  # what the node's symbols count for one order below
    for k in range(2, order + 1):
        entry, first, inv = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_index=True, return_inverse=True)
        c = np.bincount(inv, n, len(entry))
        node, at = np.unique(entry >> np.uint64(8), return_inverse=True)
        below = counts[k - 1][first]
        t, d = np.bincount(at, c), np.bincount(at, c > 0)
        x = np.bincount(at, np.where(c > 0, below, 0))
        counts.append(c[inv])
        totals.append(t[at][inv])
        kinds.append(d[at][inv])
        inside.append(x[at][inv])
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    no_total, no_kinds = np.zeros(len(keys)), np.zeros(len(keys))
    for k in range(order, -1, -1):
        seen = totals[k] > 0
        total, kind = totals[k] - no_total, kinds[k] - no_kinds
        hit = open_ & (counts[k] > 0)
        out[hit] += np.log10(counts[k][hit] / (total[hit] + kind[hit]))
        open_ &= ~hit
        escape = open_ & seen & (kind > 0)
        out[escape] += np.log10(kind[escape] / (total[escape] + kind[escape]))
        if k:
            no_total, no_kinds = np.where(seen, inside[k], 0), np.where(seen, kinds[k], 0)
    out[open_] -= np.log10(ALPHABET - (zero > 0).sum())
    return out


def score_documents(docs: DataFrame, order: int = 5, folds: int = 7, held: int = 2, block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(fold == held, F.lit(False)).alias("held"))
    dests = partitions_for(docs.sparkSession, 16)
    answers = materialise(answers_of(questions(d, block_bytes, order, dests), low_orders(d), order), "uncompressed")
    texts = d.mapInArrow(in_blocks_of(block_bytes), TEXTS_OF)  # the blocks follow from the input's partitions and come out as before
    tokens = kinds = 0
    for r in answers.filter(F.col("kind") == TOTALS).select("values").collect():  # one row for each destination
        a, b = np.frombuffer(r["values"], float).astype(np.int64).tolist()
        tokens, kinds = tokens + a, kinds + b

    def settle(key, rows: pa.Table, values: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], [], []]
        for r in rows.to_pylist():
            b = block_of(r, order, dests)

            def answered(kind: int, dtype: str) -> np.ndarray:
                _, cuts, place = b.asks(kind)
                got = np.zeros(int(cuts[-1]))
                part = values.filter(pc.equal(values["kind"], kind))
                for dest, x in zip(part["dest"].to_pylist(), part["values"].to_pylist()):
                    got[cuts[dest] : cuts[dest + 1]] = numbers_in(x, dtype)  # fails where the block were another one
                return got[place]

            c = answered(WORD, "<i8")
            base = np.log10((c + 1) / (tokens + kinds + 1))
            of_word = np.bincount(np.repeat(np.arange(len(b.symbols)), b.symbols), answered(CONTEXT, "<f8"), len(b.symbols))
            with_end = b.sizes + 1
            word = np.full(int(with_end.sum()), len(b.symbols) - 1, np.int64)  # the end is the last
            body = np.ones(len(word), bool)
            body[with_end.cumsum() - 1] = False
            word[body] = b.local
            at_once = answered(PAIR, "<f8")
            cost = np.where(at_once > ESCAPED / 2, at_once - ESCAPED + of_word[word], at_once)
            doc = np.repeat(np.arange(len(b.sizes)), with_end)

            def by_doc(x: np.ndarray) -> np.ndarray:
                return np.bincount(doc, x, len(b.sizes))

            for col, v in zip(out, (r["doc_ids"], r["held"], with_end, by_doc(c[word] > 0).astype(np.int64), np.full(len(b.sizes), tokens), by_doc(base[word]), by_doc(cost))):
                col.extend(v)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, k) for x, k in zip(out, types)], names)

    back = answers.filter(F.col("kind") < TOTALS).withColumnRenamed("block", "at")
    return texts.groupBy("block").cogroup(back.groupBy("at")).applyInArrow(
        settle, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
