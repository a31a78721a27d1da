"""Sigma-style rules compiled to boolean columns: fields with modifiers, lists as alternatives, keys together,
``and`` / ``or`` / ``not`` and ``name*`` in conditions (``not`` binds closest, then ``and``, then ``or``)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _needle(text: Column, value: str) -> Column:
    """Case-free substring; a needle of digits does not match inside a longer number."""
    if value.isdigit():
        return text.rlike(rf"(?<!\d){value}(?!\d)")
    return F.lower(text).contains(value.lower())


def _test(text: Column, modifier: str, value: str) -> Column:
    if modifier == "re":
        return text.rlike("(?i)" + value)
    if modifier == "startswith":
        return F.lower(text).startswith(value.lower())
    if modifier == "endswith":
        return F.lower(text).endswith(value.lower())
    if modifier in ("", "contains"):
        return _needle(text, value)
    return F.lower(text) == value.lower()


def compile_rule(rule: dict, columns: dict[str, Column]) -> Column:
    """The rule's condition over ``columns`` (field name -> column); unknown fields are null and match nothing."""
    blocks: dict[str, Column] = {}
    for name, block in rule["detection"].items():
        if name == "condition":
            continue
        both = F.lit(True)
        for key, values in block.items():
            field, _, modifier = key.partition("|")
            text = columns.get(field.lower(), F.lit(None).cast("string"))
            any_ = F.lit(False)
            for v in values if isinstance(values, list) else [values]:
                any_ = any_ | _test(text, modifier, str(v))
            both = both & any_
        blocks[name] = F.coalesce(both, F.lit(False))

    def atom(word: str) -> Column:
        if word.endswith("*"):
            hits = [c for n, c in blocks.items() if n.startswith(word[:-1])]
            out = F.lit(False)
            for c in hits:
                out = out | c
            return out
        return blocks[word]

    result = F.lit(False)
    for either in re.split(r"\s+or\s+", rule["detection"]["condition"].strip()):
        both = F.lit(True)
        for word in re.split(r"\s+and\s+", either):
            both = both & (~atom(word[4:].strip()) if word.startswith("not ") else atom(word.strip()))
        result = result | both
    return result


def hits(records: DataFrame, rules: list[dict], columns: dict[str, Column]) -> DataFrame:
    """Every record once for each rule that it meets: adds rule_id and rule_level."""
    each = [F.when(compile_rule(r, columns), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["level"]).alias("rule_level"))) for r in rules]
    return records.withColumn("_h", F.explode(F.array_compact(F.array(*each)))).select(*records.columns, "_h.*")


def findings(hit_rows: DataFrame, samples: int = 12) -> DataFrame:
    """Per run and rule: hits, first line and its text, hosts, the first lines."""
    k = F.row_number().over(W.partitionBy("run_id", "rule_id").orderBy("n"))
    some = hit_rows.withColumn("_k", k).filter(F.col("_k") <= samples).groupBy("run_id", "rule_id").agg(F.array_sort(F.collect_list("n")).alias("lines"))
    per = hit_rows.groupBy("run_id", "rule_id", "rule_level").agg(
        F.count("*").alias("hits"), F.min("n").alias("first_n"), F.min_by("raw", "n").alias("evidence"), F.array_sort(F.collect_set("host")).alias("hosts")
    )
    return per.join(some, ["run_id", "rule_id"])
