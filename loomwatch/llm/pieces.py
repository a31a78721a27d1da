"""Offset-preserving SentencePiece encoding and decoding.

Normalisation walks the model's compiled character map (a double-array trie) by longest prefix and records, for
every normalised byte, the source byte that it came from. The escaped text is then cut at the start of every
white-space run and at line feeds: no piece of the vocabulary holds white space after another character, nor a
line feed (checked when the model loads), so pieces never cross such a cut and each distinct chunk is encoded once per worker. Every piece is
projected through the alignment to its span of original bytes.

Defined results: null counts as empty; an empty text has no ids and decodes to the empty text; repeated rows give
repeated results; an empty table gives no rows; extra columns are ignored; a very long text is encoded by parts cut where a chunk begins,
and where the character map is empty its alignment is an array, whatever its runs of spaces.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwatch.llm.common import Memo, text_or_empty, text_slices

MARK = "▁"
PART = 1 << 18  # characters of a long text that are encoded at a time
_OPENS = re.compile(f"(?<!{MARK}){MARK}|\n")
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")


class CharMap:
    """Longest-prefix normalisation through a compiled character map; an empty map changes nothing."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :] if size else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest entry that begins at ``at``."""
        if not self.units:
            return None
        units, node, best = self.units, 0, None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = k + 1 - at, units[node] & 0x7FFFFFFF
        if best is None:
            return None
        end = self.strings.index(b"\0", best[1])
        return best[0], self.strings[best[1] : end]


def _char_bytes(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Normaliser:
    """Text to escaped normalised text, with the source byte offset of each normalised byte."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool = True, trim: bool = False):
        self.map, self.dummy, self.trim = CharMap(charsmap), dummy_prefix, trim
        self.identity = not self.map.units and not trim

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised, align): ``align`` has one entry per normalised byte and the source length at the end."""
        if self.identity:
            raw = np.frombuffer(text.encode(), np.uint8)
            source = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(MARK.encode()), 1))
            return self.escaped(text), np.concatenate((np.zeros(3 * (self.dummy and len(raw) > 0), np.int64), source, [len(raw)]))
        data, out, align, at = text.encode(), bytearray(), [], 0
        mark = MARK.encode()
        units: list[tuple[bytes, int, int]] = []
        while at < len(data):
            hit = self.map.longest(data, at)
            n, rep = hit if hit else (_char_bytes(data[at]), data[at : at + _char_bytes(data[at])])
            units.append((rep, at, at + n))
            at += n
        end = len(data)
        if self.trim:
            while units and units[0][0] == b" ":
                units.pop(0)
            while units and units[-1][0].endswith(b" ") or units and units[-1][0] == b"":
                rep, a, b = units.pop()
                if rep.rstrip(b" "):
                    units.append((rep.rstrip(b" "), a, b))
                    break
            end = units[-1][2] if units else 0
        if units and self.dummy:
            out += mark
            align += [units[0][1]] * 3
        last_space = bool(self.trim)
        for rep, a, _ in units:
            if self.trim and last_space:
                rep = rep.lstrip(b" ")
            for c in rep:
                if c == 32:
                    if self.trim and last_space:
                        continue
                    out += mark
                    align += [a] * 3
                    last_space = True
                else:
                    out.append(c)
                    align.append(a)
                    last_space = False
        while self.trim and out.endswith(mark):
            del out[-3:]
            end = align[-3]
            del align[-3:]
        align.append(end)
        return out.decode(), np.array(align, np.int64)


    def escaped(self, text: str) -> str:
        """The normalised text alone."""
        if not self.identity:
            return self(text)[0]
        return (MARK * self.dummy if text else "") + text.replace(" ", MARK)


class PieceCodec:
    """A loaded model: exact ids, spans of original bytes, and decoding."""

    def __init__(self, path: str, memo: int = 200_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        spec = model.normalizer_spec
        if any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in model.pieces) or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("pieces of this model can cross a white-space cut")
        self.normalise = Normaliser(spec.precompiled_charsmap, True, spec.remove_extra_whitespaces)
        spec.precompiled_charsmap, spec.remove_extra_whitespaces = b"", False
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.known = Memo(memo)
        # the escaped bytes that a piece stands for (a byte piece stands for one), and the bytes before escaping
        marks = [0 if p.type == p.BYTE else p.piece.count(MARK) for p in model.pieces]
        self.size = np.array([1 if p.type == p.BYTE else min(255, len(p.piece.encode())) for p in model.pieces], np.uint8)
        self.own = self.size - 2 * np.array(marks, np.uint8)
        self.is_byte = np.array([p.type == p.BYTE for p in model.pieces])
        self.lone = self.sp.piece_to_id(MARK)
        self.newline = self.sp.piece_to_id("<0x0A>")
        self.opens = np.array([m > 0 for m in marks])
        self.opens[self.newline] = True

    def _learn(self, chunks: list[str]) -> None:
        simple = [c for c in chunks if c[0] == "\n" and len(c) > 1 or c[0] == MARK and c[1:2] not in ("", MARK)]
        rest = set(chunks).difference(simple)
        for i in range(0, len(simple), 1000):
            group = simple[i : i + 1000]
            lead = group[0][0] == "\n"  # else the library's own prefix is the first chunk's mark
            joined = "".join(group)
            ids = np.array(self.sp.encode((joined if lead else joined[1:]).replace(MARK, " ")), np.int64)[lead:]
            at = np.flatnonzero(self.opens[ids]).tolist()
            if len(at) != len(group):  # not one opening piece a chunk: each by itself
                rest.update(group)
                continue
            self._keep(group, ids, at)
        for c in rest:
            body = c[1:].replace(MARK, " ") if c[0] == MARK else c
            ids = self.sp.encode(body)[c[0] != MARK :] or [self.lone]  # a single mark has an empty body
            self._keep([c], np.array(ids, np.int64), [0])

    def _keep(self, group: list[str], ids: np.ndarray, at: list[int]) -> None:
        raw, size, own = ids.astype("<u4").tobytes(), self.size[ids].tobytes(), self.own[ids].tobytes()
        listed, is_byte = ids.tolist(), self.is_byte[ids]
        odd = np.logical_or.reduceat(is_byte & (ids != self.newline), at).tolist()
        for c, s, e, by in zip(group, at, [*at[1:], len(listed)], odd):
            shown = c.replace(MARK, " ")
            if by:
                shown = " " * (c[0] == MARK) + self.sp.decode(listed[s:e])
            self.known[c] = raw[4 * s : 4 * e], ",".join(map(str, listed[s:e])), shown, size[s:e], own[s:e]

    def cut(self, text: str) -> list[str]:
        """Chunks of the escaped, normalised text; each begins with a mark or a line feed, the first with a mark."""
        if not text:
            return []
        if self.normalise.identity and text[0] != " " and not any(c in text for c in ("  ", MARK, "\x1f")):
            return ("\x1f" + MARK + text.replace(" ", "\x1f" + MARK).replace("\n", "\x1f\n")).split("\x1f")[1:]
        return _CHUNK.findall(self.normalise.escaped(text))

    def parts_of(self, texts: list[str]) -> Iterator[tuple[int, list[tuple]]]:
        """(number of the text, what is known of a row of its chunks): a text above ``PART`` characters comes in several such rows."""
        short = [k for k, t in enumerate(texts) if len(t) <= PART]
        for k, chunks in zip(short, self.chunks_of([texts[k] for k in short])):
            yield k, [self.known[x] for x in chunks]
        for k in sorted(set(range(len(texts))).difference(short)):
            whole, at = self.normalise.escaped(texts[k]), 0
            while at < len(whole):
                cut = _OPENS.search(whole, at + PART)
                end = cut.start() if cut else len(whole)
                chunks = _CHUNK.findall(whole[at:end])
                self.known.turn()
                new = self.known.unknown(set(chunks))
                if new:
                    self._learn(new)
                yield k, [self.known[x] for x in chunks]
                at = end

    def chunks_of(self, texts: list[str]) -> list[list[str]]:
        self.known.turn()
        cut = [self.cut(t) for t in texts]
        new = self.known.unknown(set().union(*cut))
        if new:
            self._learn(new)
        return cut

    def spans(self, text: str, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte in the original text of every piece."""
        return self.spans_of(text, b"".join([p[3] for p in parts]), b"".join([p[4] for p in parts]))

    def spans_of(self, text: str, size: bytes, own: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The same from each piece's number of escaped bytes and of bytes before escaping."""
        if not size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        plain = self.normalise.identity and MARK not in text
        ends = np.frombuffer(own if plain else size, np.uint8).cumsum(dtype=np.int64) - plain
        starts = np.concatenate(([0], ends[:-1]))
        if plain:
            return np.maximum(starts, 0), np.maximum(ends, 0)
        align = self.normalise(text)[1]
        return align[starts], align[ends]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


class Digest:
    """A text's result from the rows of its chunks, in order."""

    def __init__(self):
        self.n, self.ids, self.shown, self.size, self.own, self.first = 0, hashlib.sha256(), hashlib.sha256(), [], [], True

    def add(self, parts: list[tuple]) -> None:
        if parts:
            self.ids.update(("" if self.first else ",").encode() + ",".join([p[1] for p in parts]).encode())
            self.shown.update("".join([p[2] for p in parts])[self.first :].encode())
            self.size.append(b"".join([p[3] for p in parts]))
            self.own.append(b"".join([p[4] for p in parts]))
            self.n, self.first = self.n + len(self.own[-1]), False

    def result(self, c: PieceCodec, text: str) -> tuple:
        s, e = c.spans_of(text, b"".join(self.size), b"".join(self.own))
        aligned = bool((s[1:] == e[:-1]).all()) if self.n else True
        return self.n, self.ids.hexdigest(), self.shown.hexdigest(), int(e[-1]) if self.n else 0, aligned


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long, aligned boolean"


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids array<int>, starts array<long>, ends array<long>, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in text_slices(batches):
            texts = b.column("text").to_pylist()
            cols: list[list] = [[], [], [], []]
            for t, chunks in zip(texts, c.chunks_of(texts)):
                parts = [c.known[x] for x in chunks]
                s, e = c.spans(t, parts)
                cols[0].append(np.frombuffer(b"".join(p[0] for p in parts), "<u4").astype("i4"))
                cols[1].append(s)
                cols[2].append(e)
                cols[3].append("".join(p[2] for p in parts)[1:])
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, k) for x, k in zip(cols, kinds))], ["doc_id", "ids", "starts", "ends", "decoded"]
            )

    return text_or_empty(docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """The same encoding, reduced in the task to digests: ids, decoded text, and what the spans cover.

    ``aligned`` tells that the spans are in order, without gaps, and end where the text ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in text_slices(batches):
            texts = b.column("text").to_pylist()
            rows = [Digest() for _ in texts]
            for k, parts in c.parts_of(texts):
                rows[k].add(parts)
            cols = list(zip(*(r.result(c, t) for r, t in zip(rows, texts))))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, k) for x, k in zip(cols, kinds))], [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
            )

    return text_or_empty(docs).mapInArrow(run, DIGEST_SCHEMA)
