"""Odd tables for every operator: clashing column names, nulls, repeated rows, a very long text, no rows."""

import hashlib
import zlib

import numpy as np
import pytest

from loomwatch.llm import chat, common, exact_dedup, near_dup, packing, pieces, ppm, quality, substring_dedup, token_files

BYTE, WORD, PIECE = (common.vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LONG = " ".join(f"w{(k * 7919) % 100_003}" for k in range(200_000))  # 1.3 MB
EXTRA = ["row", "_row", "_r", "kh", "key", "_gone", "_dk", "_n", "x", "quality", "n", "a"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(0, LONG), (0, LONG), (1, None), (None, "a b c d e f"), (None, "a b c d e f"), (2, ""), (3, "x" * 500), (3, "y")]
    return spark.createDataFrame([(d, t, *range(len(EXTRA))) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in EXTRA)).repartition(3)


def test_filters_pass_every_column(spark, odd):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(4)], "doc_id long, quality int, row int")
    for out, rows in (
        (exact_dedup.keep_distinct(odd), 5), (near_dup.keep_one(odd), 6), (substring_dedup.cut_repeats(odd), 8), (quality.keep_good(odd, labels), None),
    ):
        assert out.columns == odd.columns
        got = out.collect()
        assert rows is None or len(got) == rows
        assert all(r[c] == k for r in got for k, c in enumerate(EXTRA))
    empty = odd.filter("false")
    for out in (exact_dedup.keep_distinct(empty), near_dup.keep_one(empty), substring_dedup.cut_repeats(empty), quality.keep_good(empty, labels)):
        assert out.columns == odd.columns and out.collect() == []


def test_long_and_repeated_texts(spark, odd):
    got = {(r.doc_id, r.n_bytes): r for r in substring_dedup.substring_dedup(odd).collect()}
    assert got[0, len(LONG)].n_removed == len(LONG) and got[3, 500].n_removed == 500 and got[3, 1].n_removed == 0
    assert got[1, 0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    near = sorted((-1 if r.doc_id is None else r.doc_id, r.n_links, r.n_copies) for r in near_dup.near_duplicates(odd).collect())
    assert near == [(-1, 1, 2), (-1, 1, 2), (0, 1, 2), (0, 1, 2), (1, 0, 1), (2, 0, 1), (3, 0, 1), (3, 0, 1)]
    s = [r for r in ppm.score_documents(odd).collect() if r.doc_id == 0]
    assert len(s) == 2 and s[0].n_tokens == 200_001 and s[0].score == pytest.approx(s[1].score)
    ids = common.load_tokenizer(BYTE).encode(LONG, add_special_tokens=False).ids
    crc = zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
    files = token_files.read_token_files(spark, token_files.write_token_files(odd, BYTE, 2)).collect()
    assert [r.ids_crc32 for r in files if r.doc_id == 0] == [crc, crc] and len(files) == 8
    packed = packing.pack_documents(odd, WORD, 1, 4096).collect()
    assert sum(r.length for r in packed if r.doc_id == 0) == 2 * (len(common.load_tokenizer(WORD).encode(LONG, add_special_tokens=False).ids) + 1)
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert [r.n_tokens for r in pieces.encode_digests(odd, PIECE).collect() if r.doc_id == 0] == [len(common.load_pieces(PIECE).encode(LONG))] * 2


def test_long_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", LONG, 7), (1, 1, "assistant", LONG, 7), (1, 1, "assistant", LONG, 7), (2, None, None, None, 7)], "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.digest(chat.format_chat(turns, BYTE), BYTE).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 * len(LONG) and got[2].n_turns == 1
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{LONG}\nassistant\n{LONG}\nassistant\n{LONG}\n".encode()).hexdigest()
