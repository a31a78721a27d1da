"""Exact token counts at every prefix of a text, by prefix dynamic programming over byte-pair merges.

An encoding is right exactly when each two neighbouring tokens are what their own bytes are merged to. So the encoding of a prefix is that of a shorter
prefix and one more token: ``last[i]`` is the only token that ends at i, is whole by itself and gets on with ``last[i - its length]``, and
``count[i]`` is one more than the count there. A word's tokens carry a mark at its end; the count of a prefix that ends inside a word is that of the word
cut there, whose last token is looked up with the mark. Every prefix costs a few look-ups, no merging; which pairs get on is merged once and
remembered.

A text is a run of chunks between ASCII white space, which gives no tokens; each distinct chunk is worked out once in a worker and held as the changes of
the count from one code point to the next. The table of a text is the concatenation of its chunks' changes, so that ``count_at`` and
``longest_within`` answer for any prefix without encoding. The last count of a chunk that is not plain ASCII is held against the tokenizer's own when it is
learnt; a chunk on which they differ (a letter of another Unicode version) is counted prefix by prefix with the tokenizer.

A prefix counts as the tokenizer counts that prefix as a text: special strings are one token once they are complete, letters with combining marks
are composed as far as the prefix goes, contractions end where they end in the prefix.

Defined results: null counts as empty; an empty text has no tokens; counts may fall from a prefix to the next (two tokens merge), then the longest prefix
within a budget is meant; repeated rows give repeated results; long texts are taken whole; an empty table gives no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from loomwatch.llm.common import MARKS, Memo, restore, squeeze, text_or_empty, text_slices

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed: the words that the vocabulary's own pre-tokenizer cuts.
WORD = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[\\p{{L}}]+|[\\p{{N}}]|[^{_SPACE}\\p{{L}}\\p{{N}}]+")
_LETTER = regex.compile("\\p{L}")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Counts of every prefix of one word."""

    def __init__(self, vocab: dict[str, int], merges: list, mark: str):
        self.vocab, self.mark = vocab, mark
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {p: k for k, p in enumerate(pairs)}
        made = {a + b for a, b in pairs}
        whole = [t for t in vocab if t in made or len(t.removesuffix(mark)) == 1]
        self.inner = {t for t in whole if not t.endswith(mark)}
        self.final = {t.removesuffix(mark) for t in whole if t.endswith(mark)}
        self.longest = max((len(t.removesuffix(mark)) for t in whole), default=1)
        self.letters = byte_letters()

        self._tables()

    def _tables(self) -> None:
        """The tokens as a trie over bytes (node 0 is the root, node 1 leads nowhere), and an empty table of pairs."""
        byte = {c: b for b, c in enumerate(self.letters)}
        names = sorted(self.inner | self.final)
        number = {t: k for k, t in enumerate(names)}
        steps: list[dict[int, int]] = [{}, {}]
        ends = {}
        for t in names:
            node = 0
            for c in t:
                node = steps[node].setdefault(byte[c], len(steps))
                if node == len(steps):
                    steps.append({})
            ends[t] = node
        self.next = np.ones((len(steps), 256), np.int32)
        for k, to in enumerate(steps):
            self.next[k, list(to)] = list(to.values())
        self.ends = np.full((2, len(steps)), -1, np.int32)  # of inner and of final tokens
        for kind, some in enumerate((self.inner, self.final)):
            for t in some:
                self.ends[kind, ends[t]] = number[t]
        self.names, self.pairs = names, {}
        self.pair_keys, self.pair_ok, self.pair_count = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool), 0

    def all_get_on(self, a: np.ndarray, b: np.ndarray, final: int) -> np.ndarray:
        """``get_on`` for arrays of token numbers: pairs not met before are merged one by one and kept in a hash table."""
        keys = (a.astype(np.int64) * len(self.names) + b) * 2 + final
        mask = len(self.pair_keys) - 1
        at = ((keys * -7046029254386353131) >> 40) & mask
        left = np.arange(len(keys))
        new: list[int] = []
        while len(left):  # a key stands in the first slots from its own, up to a free one
            held = self.pair_keys[at[left]]
            new += left[held == -1].tolist()
            left = left[(held != -1) & (held != keys[left])]
            at[left] = (at[left] + 1) & mask
        if new:
            if self.pair_count > len(self.pair_keys) // 4:
                self.pair_keys[:], self.pair_count = -1, 0
                return self.all_get_on(a, b, final)
            for k in new:
                key, slot = int(keys[k]), int(at[k])
                while self.pair_keys[slot] not in (-1, key):
                    slot = (slot + 1) & mask
                if self.pair_keys[slot] == -1:
                    self.pair_keys[slot] = key
                    self.pair_ok[slot] = self.get_on(self.names[a[k]], self.names[b[k]], bool(final))
                    self.pair_count += 1
                at[k] = slot
        return self.pair_ok[at]

    def together(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of every prefix of words of one length (rows of bytes), all words at a time; and which rows came out."""
        n, size = words.shape
        found: list[dict[tuple[int, int], np.ndarray]] = [{}, {}]
        for j in range(size):
            node = np.zeros(n, np.int32)
            for i in range(j + 1, min(size, j + self.longest) + 1):
                node = self.next[node, words[:, i - 1]]
                if (node == 1).all():
                    break
                for kind in (0, 1):
                    t = self.ends[kind][node]
                    if (t >= 0).any():
                        found[kind][j, i] = t
        last, count = np.zeros((n, size + 1), np.int32), np.zeros((n, size + 1), np.int16)
        closed, good = np.zeros((n, size), np.int16), np.ones(n, bool)
        for i in range(1, size + 1):
            for kind in (0, 1) if i < size else (1,):
                todo = np.ones(n, bool)
                for j in range(max(0, i - self.longest), i):
                    t = found[kind].get((j, i))
                    if t is None:
                        continue
                    here = np.flatnonzero(todo & (t >= 0))
                    if not len(here):
                        continue
                    if j:
                        here = here[self.all_get_on(last[here, j], t[here], kind)]
                    todo[here] = False
                    if kind:
                        closed[here, i - 1] = count[here, j] + 1
                    else:
                        last[here, i], count[here, i] = t[here], count[here, j] + 1
                good &= ~todo
        return closed, good

    def many(self, words: list[str], most: int = 48) -> dict[str, list[int] | bytes]:
        """For each word the changes of its count from letter to letter, as bytes; words that are longer than ``most`` bytes, or hold a letter that the
        vocabulary does not have, are left out."""
        out = {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            if 0 < len(raw) <= most:
                by_size.setdefault(len(raw), []).append((w, raw))
        for size, some in by_size.items():
            rows = np.frombuffer(b"".join([r for _, r in some]), np.uint8).reshape(len(some), size)
            closed, good = self.together(rows)
            ends = np.ones(rows.shape, bool)
            ends[:, :-1] = (rows[:, 1:] & 0xC0) != 0x80  # a letter's last byte
            flat = closed[ends]
            width = ends.sum(axis=1)
            first = width.cumsum() - width
            steps = np.diff(flat, prepend=flat.dtype.type(0))
            steps[first] = flat[first]
            raw, cuts = steps.astype(np.int8).tobytes(), first.tolist()
            for (w, _), a, b, ok in zip(some, cuts, [*cuts[1:], len(raw)], good.tolist()):
                if ok:
                    out[w] = raw[a:b]
        return out

    def merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda k: (self.rank.get((symbols[k], symbols[k + 1]), 1 << 60), k))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def get_on(self, a: str, b: str, final: bool) -> bool:
        """Whether a and then b (the word's last token if ``final``) stay two tokens."""
        parts = list(a + b)
        if final:
            parts[-1] += self.mark
        return self.merged(parts) == [a, b + self.mark if final else b]

    def gets_on(self, a: str, b: str, final: bool) -> bool:
        """The same through a memo, for words that go one by one."""
        key = a, b, final
        if key not in self.pairs:
            if len(self.pairs) >= 200_000:
                self.pairs.clear()
            self.pairs[key] = self.get_on(a, b, final)
        return self.pairs[key]

    def open(self, word: str, last: list[str], count: list[int]) -> None:
        """Carries last and count, which cover a beginning of ``word``, on to its end; index 0 stands for nothing."""
        inner, longest, get_on = self.inner, self.longest, self.gets_on
        for i in range(len(last), len(word) + 1):
            for j in range(max(0, i - longest), i):
                t = word[j:i]
                if t in inner and (j == 0 or get_on(last[j], t, False)):
                    last.append(t)
                    count.append(count[j] + 1)
                    break
            else:
                raise KeyError(word)

    def closed(self, word: str, at: int, last: list[str], count: list[int]) -> int:
        """Tokens of word[:at] as a word of its own."""
        final = self.final
        for j in range(max(0, at - self.longest), at):
            t = word[j:at]
            if t in final and (j == 0 or self.gets_on(last[j], t, True)):
                return count[j] + 1
        raise KeyError(word)

    def spell(self, text: str) -> str:
        return text if text.isascii() and text.isprintable() else "".join([self.letters[b] for b in text.encode()])

    def counts(self, text: str) -> list[int]:
        """Tokens of text[:1], text[:2], ... each as a word."""
        word = self.spell(text)
        last, count = [""], [0]
        self.open(word[:-1], last, count)
        if len(word) == len(text):
            return [self.closed(word, k, last, count) for k in range(1, len(word) + 1)]
        out, at = [], 0
        for c in text:
            at += len(c.encode())
            out.append(self.closed(word, at, last, count))
        return out


class PrefixCounter:
    """Changes of the token count from code point to code point, for texts under one vocabulary of lower-case words."""

    def __init__(self, path: str, memo: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or not spec["model"].get("end_of_word_suffix") or spec["model"].get("dropout"):
            raise ValueError("prefix counts need a vocabulary of composed, lower-case words with an end mark")
        self.tk = Tokenizer.from_file(path)
        self.tk.no_truncation()
        self.tk.no_padding()
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        if any(a != b and a in b for a in special for b in special) or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special strings that lie in one another, or stretch, are not supported")
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known, self.met = Memo(memo), Memo(2 * memo)  # chunks as they stand; lower-case words

    def own(self, text: str) -> int:
        return len(self.tk.encode(text, add_special_tokens=False).ids)

    def word(self, w: str) -> list[int]:
        """Tokens of w[:1], w[:2], ... of one word."""
        try:
            steps = self.met[w]
        except KeyError:
            return self.merges.counts(w)
        return np.frombuffer(steps, np.int8).cumsum(dtype=np.int64).tolist()

    def words(self, low: str) -> list[int]:
        """Tokens of low[:0], low[:1], ... for composed lower-case text; the regex is applied once, cut words are counted as they stand."""
        out, done, at = [0], 0, 0
        for m in WORD.finditer(low):
            out += [done] * (m.start() - at)
            w = m.group()
            n = self.word(w)
            if w[0] == "'" and len(w) > 1 and _LETTER.match(w[1]):  # a contraction: before its end, an apostrophe and a letter
                n[1:-1] = [n[0] + x for x in self.word(w[1:-1])] if len(w) > 2 else []
            out += [done + x for x in n]
            done += n[-1]
            at = m.end()
        return out + [done] * (len(low) - at)

    def composed(self, text: str) -> list[int]:
        """The same for text[:0], text[:1], ... of any text without special strings."""
        low = [c.lower() for c in text]
        if unicodedata.is_normalized("NFC", text):
            n = self.words("".join(low))
            if all(len(c) == 1 for c in low):
                return n
            return [n[k] for k in np.cumsum([0, *map(len, low)]).tolist()]
        # clusters: what follows one leaves it as it is
        starts = [k for k, c in enumerate(text) if not k or not unicodedata.combining(c) and unicodedata.is_normalized("NFC", "a" + c) and not _joins(c)]
        norm = ["".join(c.lower() for c in unicodedata.normalize("NFC", text[a:b])) for a, b in zip(starts, [*starts[1:], len(text)])]
        all_low = "".join(norm)
        n, at, out = self.words(all_low), 0, [0]
        spans = [m.span() for m in WORD.finditer(all_low)]
        held: tuple[int, str, list[int], list[str], list[int]] | None = None
        word = -1
        for a, b, low_ in zip(starts, [*starts[1:], len(text)], norm):
            while word + 1 < len(spans) and spans[word + 1][0] < at:
                word += 1
            begin, end = spans[word] if word >= 0 else (0, at)
            for k in range(a + 1, b):
                part = "".join(c.lower() for c in unicodedata.normalize("NFC", text[a:k]))
                if at - begin < 64 or at > end:
                    since = begin if at - begin < 64 else at
                    if since and word and spans[word - 1] == (since - 1, since) and all_low[since - 1] == "'":
                        since -= 1  # an apostrophe of its own may yet begin a contraction
                    out.append(n[since] + self.words(all_low[since:at] + part)[-1])
                    continue
                if held is None or held[0] != begin:  # the columns of a long word are made once
                    long = all_low[begin:end]
                    held = begin, self.merges.spell(long), np.cumsum([0, *(len(c.encode()) for c in long)]).tolist(), [""], [0]
                    self.merges.open(held[1], held[3], held[4])
                out.append(n[begin] + self._after(long[at - begin - 1], held[1], held[2][at - begin], part, held[3], held[4]))
            at += len(low_)
            out.append(n[at])
        return out

    def _after(self, before: str, spelt: str, at: int, part: str, last: list[str], count: list[int]) -> int:
        """Tokens of spelt[:at], the letter ``before`` at its end, and then ``part``: as much of it as goes on with the word is joined to the word's last letters,
        whose columns are enough."""
        kind = bool(_LETTER.match(before))
        size = next((k for k, c in enumerate(part) if bool(_LETTER.match(c)) != kind or not WORD.match(c)), len(part))
        since = max(0, at - self.merges.longest)
        cols = last[since : at + 1], [x - count[since] for x in count[since : at + 1]]
        whole = spelt[since:at] + "".join(self.merges.letters[x] for x in part[:size].encode())
        self.merges.open(whole, *cols)
        return count[since] + self.merges.closed(whole, len(whole), *cols) + self.words(part[size:])[-1]

    def chunk(self, chunk: str) -> list[int]:
        """Tokens of chunk[:0], chunk[:1], ...; a special string is one token from its end on."""
        hits = [m.span() for m in self.special.finditer(chunk)] if self.special and "<" in chunk else []
        if not hits:
            return self.composed(chunk)
        out, begin = [0], 0
        for a, b in hits:
            n = self.composed(chunk[begin : b - 1])
            out += [out[begin] + x for x in n[1:]]
            out.append(out[a] + 1)
            begin = b
        return out + [out[begin] + x for x in self.composed(chunk[begin:])[1:]]

    def learn(self, chunks: list[str], lot: int = 256) -> None:
        """Chunks of a word, or of a word and one mark, are those of their lower-case words, which are counted together; others go one by one."""
        plain: dict[str, tuple[str, str]] = {}
        rest, fresh = [], set()
        for c in chunks:
            body, mark = (c, "") if c.isalpha() else (c[:-1], c[-1:])
            if mark and (mark not in MARKS or not body.isalpha()) or not c.isascii() and ("Σ" in c or "İ" in c or not unicodedata.is_normalized("NFC", c)):
                rest.append(c)
                if c.isascii():
                    fresh.update(w for w in WORD.findall(c.lower()) if w not in self.met and w not in self.met.old)
                continue
            low = body.lower()
            plain[c] = low, mark
            fresh.update(w for w in (low, mark) if w and w not in self.met and w not in self.met.old)
        self.met.turn()
        self.met.update(self.merges.many(list(fresh)))
        met, known = self.met, self.known
        for c, (low, mark) in plain.items():
            try:
                known[c] = met[low] + met[mark] if mark else met[low]
            except KeyError:
                rest.append(c)
        slow = []
        for c in rest:
            if c.isascii() and "'" not in c and "<" not in c:  # its words lie side by side, and none depends on where it is cut
                try:
                    known[c] = b"".join([met[w] for w in WORD.findall(c.lower())])
                    continue
                except KeyError:
                    pass
            slow.append(c)
        for c in slow:
            try:
                steps = np.diff(self.chunk(c))
            except KeyError:  # a letter that the vocabulary does not have
                steps = np.full(len(c), -1)
            fits = not len(steps) or -128 <= steps.min() and steps.max() <= 127
            known[c] = steps.astype(np.int8).tobytes() if fits else tuple(steps.tolist())
        # what is not plain ASCII is held against the tokenizer, many chunks at a time; white space parts them
        doubtful = [c for c in chunks if not c.isascii()] + [c for c in slow if c.isascii()]
        lots = [doubtful[s : s + lot] for s in range(0, len(doubtful), lot)]
        total = lambda c: int(np.frombuffer(known[c], np.int8).sum(dtype=np.int64)) if isinstance(known[c], bytes) else sum(known[c])
        for some, e in zip(lots, self.tk.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False)):
            if sum(map(total, some)) != len(e.ids):
                for c in some:
                    if total(c) != self.own(c):
                        known[c] = tuple(np.diff([self.own(c[:k]) for k in range(len(c) + 1)]).tolist())

    def steps(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text the change of the count at each code point."""
        for blank in "\n\t\x0b\x0c\r":
            texts = [t.replace(blank, " ") for t in texts]
        cut = [t.split(" ") for t in texts]
        self.known.turn()
        new = self.known.unknown(set().union(*cut))
        if new:
            self.learn(new)
        get = self.known.__getitem__
        for chunks in cut:
            parts = list(map(get, chunks))
            try:
                yield np.frombuffer(b"\0".join(parts), np.int8)
            except TypeError:  # a change beyond a byte
                wide = [np.frombuffer(p, np.int8).astype(np.int32) if isinstance(p, bytes) else np.array(p, np.int32) for p in parts]
                yield np.concatenate([x for p in wide for x in (np.zeros(1, np.int32), p)][1:])


def _joins(c: str) -> bool:
    """Whether a letter may be composed with the one before it."""
    return unicodedata.normalize("NFC", "ᄀ" + c) != "ᄀ" + c or unicodedata.normalize("NFC", "가" + c) != "가" + c or c in "ೕೖೂ"


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def table_of(steps: np.ndarray) -> bytes:
    return (b"\1" if steps.dtype == np.int8 else b"\4") + squeeze(steps)


def counts_of(table: bytes) -> np.ndarray:
    """Tokens of the first 0, 1, 2, ... code points."""
    steps = restore(table[1:], "i1" if table[0] == 1 else "<i4")
    return np.concatenate(([0], steps.cumsum(dtype=np.int64)))


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else -1


def _per_slice(docs: DataFrame, vocab: str, schema: str, row) -> DataFrame:
    src = text_or_empty(docs)
    id_type = src.schema["doc_id"].dataType
    full = f"doc_id {id_type.simpleString()}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocab)
        for b in text_slices(batches, 2 << 20):
            texts = b.column("text").to_pylist()
            rows = [row(t, s) for t, s in zip(texts, count.steps(texts))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    names = [x.split()[0] for x in full.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    assert to_arrow_type(id_type)
    return src.mapInArrow(run, full)


def prefix_tables(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id, n_bytes, n_points, n_tokens, counts: the table of every text, compressed (about a tenth of a byte a code point)."""
    return _per_slice(docs, vocab, "n_bytes long, n_points long, n_tokens long, counts binary",
                      lambda t, s: (len(t.encode()), len(t), int(s.sum(dtype=np.int64)), table_of(s)))


def token_counts(docs: DataFrame, vocab: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and the code points and tokens of the longest prefix within the limit: tables are read in the task that made
    them and go."""

    def row(t: str, s: np.ndarray) -> tuple:
        counts = s.cumsum(dtype=np.int64)
        n = int(counts[-1]) if len(counts) else 0
        points = len(t) if n <= limit else int(np.flatnonzero(counts <= limit)[-1]) + 1 if (counts <= limit).any() else 0
        return len(t.encode()), n, n > limit, points, int(counts[points - 1]) if points else 0

    return _per_slice(docs, vocab, "n_bytes long, n_tokens long, over_limit boolean, fit_points long, fit_tokens long", row)


def within_budget(tables: DataFrame, budget: int) -> DataFrame:
    """doc_id, points, tokens: where each text has to be cut to keep within ``budget`` tokens, from tables alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("counts").to_pylist():
                counts = counts_of(t)
                k = longest_within(counts, budget)
                rows.append((k, int(counts[k]) if k >= 0 else None))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [(), ()]))], ["doc_id", "points", "tokens"])

    return tables.select("doc_id", "counts").mapInArrow(run, f"doc_id {tables.schema['doc_id'].dataType.simpleString()}, points long, tokens long")


def count_at(tables: DataFrame, points: str) -> DataFrame:
    """doc_id, points, tokens: tokens of each text's first ``points`` code points (a column of the tables; beyond the text, all of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = b.column("points").to_pylist(), []
            for p, t in zip(at, b.column("counts").to_pylist()):
                counts = counts_of(t)
                rows.append(None if p is None else int(counts[min(max(p, 0), len(counts) - 1)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(at, pa.int64()), pa.array(rows, pa.int64())], ["doc_id", "points", "tokens"])

    return tables.selectExpr("doc_id", f"cast({points} as long) as points", "counts").mapInArrow(
        run, f"doc_id {tables.schema['doc_id'].dataType.simpleString()}, points long, tokens long"
    )
