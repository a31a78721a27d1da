"""The Merkle manifest against a plain tree: rounds, lone leaves, nulls, repeats, proofs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loomwatch.llm import merkle

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, idx int, gid int, grp int, _at int"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return H("".join(map(field, (row[0], row[2], row[3], row[4], text))))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        start = i - i % 3
        out.append((nodes[start:i], nodes[i + 1 : start + 3]))
        i //= 3
    return out


def plain(rows):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    for g, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(top, g)
            now = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = leaf(r, None if r[1] is None else r[1].replace("\n", ""))
            for a, b in steps:
                now = H("".join(a) + now + "".join(b))
            proof = H("".join("".join(a) + "".join(b) for a, b in steps))
            out.append((r[0], own, trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


def compare(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = [tuple(r) for r in merkle.manifest(docs, tampered, F.translate("text", "\n", "")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))


def test_groups_of_every_size(spark):
    rows = [(k, f"text {k}\nä", f"s{k % 400}" if k % 3 else "hot", "en", k) for k in range(1500)]  # 'hot' climbs two rounds, as do the groups' roots
    rows += [(None, None, None, None, None), (None, "x\n", None, None, 1), (None, "x\n", None, None, 1), (7, "", "", "de", 0), (7, "", "", "de", 0), (8, "z" * 300_000 + "\n", "é", None, 5)]
    compare(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 243, 244])
def test_sizes_about_a_block(spark, n):
    compare(spark, [(k, "a\nb", "one", "en", 3) for k in range(n)])


def test_empty_table(spark):
    compare(spark, [])


def test_proofs_fold_to_the_root(spark):
    docs = spark.createDataFrame([(k, f"t{k}", f"s{k % 7}", "en", 2, 0, 0, 0, 0) for k in range(300)], SCHEMA)
    got = merkle.manifest(docs, with_proof=True).collect()
    assert len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 7
    for r in got:
        assert r.verified and merkle.fold(r.leaf, bytes(r.shape), r.siblings) == r.root
        if r.siblings:
            assert merkle.fold(r.leaf, bytes(r.shape), "0" * 64 + r.siblings[64:]) != r.root


def test_sweeps_in_one_block():
    digests = [H(str(k)) for k in range(11)]
    top, runs = merkle.forward(0, digests, merkle.climbs(11))
    assert top == tree(digests)[-1][0]
    suffixes = merkle.backward(runs, merkle.climbs(11), 0, (b"", ""))
    assert [merkle.fold(d, *s) for d, s in zip(digests, suffixes)] == [top] * 11
