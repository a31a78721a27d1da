"""Packs of many Sigma-style rules in one scan: all literals of a field form one automaton, regular expressions stay columns, and a record evaluates only
the rules whose gate it hit. Results are those of ``sigma.hits`` over the same rules."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomwatch.operators.containment import automaton
from loomwatch.operators.sigma import _test

Key = frozenset[int]  # atoms, one of which must hit
Block = tuple[Key, ...]  # keys that must all be met
Term = tuple[bool, tuple[Block, ...]]  # negated?, blocks of which one must be met


@dataclass(frozen=True)
class Pack:
    """Atoms are numbered: first the literals (field, kind, lower-case text), then the column tests (field, modifier, value)."""

    rules: tuple[tuple[str, str], ...]
    literals: tuple[tuple[str, str, str], ...]
    tests: tuple[tuple[str, str, str], ...]
    clauses: tuple[tuple[int, tuple[Term, ...]], ...]


def parse_rules(texts: list[tuple[str, str]]) -> tuple[list[dict], list[tuple[str, str]]]:
    """Rules of (name, JSON) in the order of names, and (name, reason) of what is none. A file holds one rule, a list of them, or ``{"rules": [...]}``."""
    rules: list[dict] = []
    rejected: list[tuple[str, str]] = []
    for name, text in sorted(texts):
        try:
            got = json.loads(text)
        except json.JSONDecodeError as error:
            rejected.append((name, f"not JSON: {error}"))
            continue
        each = got["rules"] if isinstance(got, dict) and isinstance(got.get("rules"), list) else got if isinstance(got, list) else [got]
        for rule in each:
            reason = _reason(rule)
            if reason:
                rejected.append((name, reason))
            else:
                rules.append(rule)
    return rules, rejected


def _reason(rule: object) -> str | None:
    if not isinstance(rule, dict) or not rule.get("id"):
        return "no id"
    detection = rule.get("detection")
    if not isinstance(detection, dict) or not isinstance(detection.get("condition"), str):
        return f"{rule['id']}: no detection with a condition"
    blocks = {n for n in detection if n != "condition"}
    if not all(isinstance(detection[n], dict) for n in blocks):
        return f"{rule['id']}: a block that is not an object"
    for _, word in _words(detection["condition"]):
        if not word.endswith("*") and word not in blocks:
            return f"{rule['id']}: no block {word}"
    return None


def _words(condition: str) -> Iterator[tuple[int, str]]:
    for k, either in enumerate(re.split(r"\s+or\s+", condition.strip())):
        for word in re.split(r"\s+and\s+", either):
            yield k, word.strip().removeprefix("not ").strip()


def load(spark: SparkSession, path: str) -> tuple[list[dict], list[tuple[str, str]]]:
    """Rules of the JSON files of a folder (settings, which the driver reads) and what was rejected, with reasons."""
    found = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path"), "value").collect()
    return parse_rules([(r[0], r[1]) for r in found])


def compile_pack(rules: list[dict]) -> Pack:
    literals: dict[tuple[str, str, str], int] = {}
    tests: dict[tuple[str, str, str], int] = {}
    shape: list[tuple[int, list[tuple[bool, list[list[list[tuple[bool, int]]]]]]]] = []

    def atom(field: str, modifier: str, value: str) -> tuple[bool, int]:
        if modifier == "re" or not value:
            return False, tests.setdefault((field, modifier, value), len(tests))
        kind = modifier if modifier in ("startswith", "endswith") else ("digits" if value.isdigit() else "contains") if modifier in ("", "contains") else "equals"
        return True, literals.setdefault((field, kind, value.lower()), len(literals))

    for index, rule in enumerate(rules):
        blocks: dict[str, list[list[tuple[bool, int]]]] = {}
        for name, block in rule["detection"].items():
            if name != "condition":
                blocks[name] = []
                for key, values in block.items():
                    field, _, modifier = key.partition("|")
                    blocks[name].append([atom(field.lower(), modifier, str(v)) for v in (values if isinstance(values, list) else [values])])
        for either in re.split(r"\s+or\s+", rule["detection"]["condition"].strip()):
            terms = []
            for word in re.split(r"\s+and\s+", either):
                word = word.strip()
                bare = word.removeprefix("not ").strip()
                names = [n for n in blocks if n.startswith(bare[:-1])] if bare.endswith("*") else [bare]
                terms.append((word.startswith("not "), [blocks[n] for n in names]))
            shape.append((index, terms))

    def number(a: tuple[bool, int]) -> int:
        return a[1] if a[0] else len(literals) + a[1]

    clauses = tuple((i, tuple((neg, tuple(tuple(frozenset(map(number, key)) for key in b) for b in bs)) for neg, bs in terms)) for i, terms in shape)
    return Pack(tuple((r["id"], str(r.get("level", ""))) for r in rules), tuple(literals), tuple(tests), clauses)


def gates(pack: Pack) -> tuple[dict[int, list[int]], list[int]]:
    """Atom -> clauses that it may open, and the clauses that are always evaluated. A clause's gate is its positive term with the fewest atoms, taking the
    smallest key of each block."""
    opens: dict[int, list[int]] = {}
    always: list[int] = []
    for c, (_, terms) in enumerate(pack.clauses):
        options = [frozenset().union(*(min(b, key=len) for b in bs)) for neg, bs in terms if not neg and all(bs)]
        if not options:
            always.append(c)
            continue
        for a in min(options, key=len):
            opens.setdefault(a, []).append(c)
    return opens, always


def _met(terms: tuple[Term, ...], atoms: set[int]) -> bool:
    return all(neg != any(all(not key.isdisjoint(atoms) for key in block) for block in blocks) for neg, blocks in terms)


@functools.lru_cache(maxsize=4)
def _by_field(pack: Pack) -> dict[str, dict[str, list[tuple[str, int]]]]:
    """field -> literal -> [(kind, atom)]"""
    out: dict[str, dict[str, list[tuple[str, int]]]] = {}
    for k, (field, kind, text) in enumerate(pack.literals):
        out.setdefault(field, {}).setdefault(text, []).append((kind, k))
    return out


def _literal_atoms(text: str, words: tuple[str, ...], kinds: dict[str, list[tuple[str, int]]]) -> Iterator[int]:
    for last, w in automaton(words).iter(text):
        first = last + 1 - len(words[w])
        for kind, k in kinds[words[w]]:
            if kind == "digits":
                alone = not (first and "0" <= text[first - 1] <= "9") and not (last + 1 < len(text) and "0" <= text[last + 1] <= "9")
            else:
                alone = (kind not in ("startswith", "equals") or first == 0) and (kind not in ("endswith", "equals") or last + 1 == len(text))
            if alone:
                yield k


def hits(records: DataFrame, rules: list[dict], columns: dict[str, Column]) -> DataFrame:
    """Every record once for each rule that it meets: adds rule_id and rule_level. ``columns`` maps lower-case field names to text columns; other fields are
    null and match nothing. What grows is the records: literals, clauses and tests are settings and travel with the task."""
    pack = compile_pack(rules)
    fields = [f for f in _by_field(pack) if f in columns]
    opens, always = gates(pack)
    base = len(pack.literals)

    def run(tested: pd.Series, *texts: pd.Series) -> pd.Series:
        kinds = _by_field(pack)
        words = [tuple(kinds[f]) for f in fields]
        out = []
        for k, residual in enumerate(tested):
            atoms = {base + int(t) for t in residual}
            for f, w, series in zip(fields, words, texts):
                if series.iat[k]:
                    atoms.update(_literal_atoms(series.iat[k], w, kinds[f]))
            open_ = {c for a in atoms for c in opens.get(a, ())}.union(always)
            out.append(sorted({pack.clauses[c][0] for c in open_ if _met(pack.clauses[c][1], atoms)}))
        return pd.Series(out)

    residual = [F.when(_test(columns[f].cast("string"), m, v), F.lit(k)) for k, (f, m, v) in enumerate(pack.tests) if f in columns]
    tested = F.array_compact(F.array(*residual)) if residual else F.array().cast("array<int>")
    found = F.pandas_udf(run, "array<int>")(tested, *(F.lower(columns[f].cast("string")) for f in fields))
    names = records.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(pack.rules)], "_rule int, rule_id string, rule_level string")
    each = records.withColumn("_rule", F.explode(found))
    return each.join(F.broadcast(names), "_rule").select(*records.columns, "rule_id", "rule_level")  # as many rows as the pack has rules
