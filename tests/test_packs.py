import json
import random

from pyspark.sql import functions as F

from loomwatch.operators import packs, sigma


def _rows(d):
    return sorted((r.n, r.rule_id, r.rule_level) for r in d.collect())


def test_pack_equals_rule_by_rule(spark):
    rng = random.Random(5)
    words = ["sudo", "Root", "fail", "42", "7", "ssh", "ssh.exe", "é", ""]
    rows = [(n, None if n % 9 == 0 else " ".join(rng.choices(words + ["142", "x7y", "42."], k=rng.randint(0, 5))), rng.choice(["Linux", "win", None, ""])) for n in range(300)]
    d = spark.createDataFrame(rows, "n int, raw string, os string")
    mods = ["", "contains", "startswith", "endswith", "re", "exact"]
    rules = []
    for k in range(60):
        block = lambda: {f"{rng.choice(['Text', 'os', 'none'])}|{rng.choice(mods)}".rstrip("|"): rng.sample(words, rng.randint(0, 3)) for _ in range(rng.randint(0, 2))}
        cond = rng.choice(["sel1", "sel1 and not f", "sel*", "not f", "sel1 or sel2 and f", "not sel* and f", "zz* or f"])
        rules.append({"id": f"r{k}", "level": rng.choice(["low", "high"]), "detection": {"sel1": block(), "sel2": block(), "f": block(), "condition": cond}})
    cols = {"text": F.col("raw"), "os": F.col("os")}
    assert _rows(packs.hits(d, rules, cols)) == _rows(sigma.hits(d, rules, cols))
    assert packs.hits(d.limit(0), rules, cols).count() == 0 and packs.hits(d, [], cols).count() == 0


def test_gates_leave_most_rules_unopened():
    rules = [{"id": f"r{k}", "level": "low", "detection": {"a": {"text": [f"word{k}"]}, "b": {"os": ["linux"]}, "condition": "a and not b"}} for k in range(500)]
    opens, always = packs.gates(packs.compile_pack(rules))
    assert not always and all(len(c) == 1 for c in opens.values())


def test_loader_names_what_it_rejects(spark, tmp_path):
    good = {"id": "a", "level": "low", "detection": {"s": {"text": "x"}, "condition": "s"}}
    (tmp_path / "1.json").write_text(json.dumps(good))
    (tmp_path / "2.json").write_text(json.dumps({"rules": [good | {"id": "b"}, {"id": "c"}, {"id": "d", "detection": {"s": {}, "condition": "s or t"}}]}))
    (tmp_path / "3.json").write_text("{")
    (tmp_path / "4.json").write_text(json.dumps([good | {"id": ""}]))
    rules, rejected = packs.load(spark, str(tmp_path))
    assert [r["id"] for r in rules] == ["a", "b"]
    assert [why.split(":")[0] for _, why in rejected] == ["c", "d", "not JSON", "no id"]
