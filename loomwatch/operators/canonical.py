"""One authentication vocabulary for many vendors, and removal of companion lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwatch.functions import patterns as P
from loomwatch.sources.envelopes import part


def field(names: list[str], fields: str = "fields") -> Column:
    """The first non-null of several aliases in a map with lower-cased keys."""
    return F.coalesce(*(F.try_element_at(fields, F.lit(n)) for n in names))


def lower_keys(m: Column) -> Column:
    """A map with lower-cased keys; of keys that then clash the first stays."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def canonicalise(records: DataFrame) -> DataFrame:
    """Adds kind, auth_source, auth_ip, auth_user, original_msg and rewrites msg; ``raw`` never changes. A ``fields`` map
    (lower-cased keys) is used if the records have one."""
    msg = F.coalesce("msg", "raw", F.lit(""))
    none = F.lit(None).cast("string")
    shape = lambda kind, source, user, ip: F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("source"), user.alias("user"), ip.alias("ip"))
    cases = [
        (msg.rlike(P.FAILED_PASSWORD), shape("auth_fail", "failed_password", part(P.FAILED_PASSWORD, 1, msg), part(P.FAILED_PASSWORD, 2, msg))),
        (msg.rlike(P.INVALID_USER), shape("auth_fail", "invalid_user", part(P.INVALID_USER, 1, msg), part(P.INVALID_USER, 2, msg))),
        (msg.rlike(P.PAM_FAILURE), shape("auth_fail", "pam_failure", F.coalesce(part(P.PAM_FAILURE, 2, msg), F.lit("unknown")), part(P.PAM_FAILURE, 1, msg))),
        (msg.rlike(P.ACCEPTED), shape("auth_ok", "accepted_password", part(P.ACCEPTED, 1, msg), part(P.ACCEPTED, 2, msg))),
    ]
    if "fields" in records.columns:
        event = F.regexp_extract(field(P.EVENT_ID_FIELDS), r"\d+", 0)
        ip, user = F.trim(field(P.IP_FIELDS)), F.coalesce(field(P.USER_FIELDS), F.lit("unknown"))
        usable = ip.isNotNull() & (ip != "") & ~ip.isin(P.USELESS_IPS)
        status, v4 = F.lower(F.trim(field(P.STATUS_FIELDS))), ip.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$")
        cases += [
            ((event == "4625") & usable, shape("auth_fail", "windows_4625", user, ip)),
            ((event == "4624") & usable, shape("auth_ok", "windows_4624", user, ip)),
            (status.isin(P.STATUS_FAIL) & usable & v4, shape("auth_fail", "auth_csv", user, ip)),
            (status.isin(P.STATUS_OK) & usable & v4, shape("auth_ok", "auth_csv", user, ip)),
        ]
    hit: Column | None = None
    for when, value in cases:
        hit = F.when(when, value) if hit is None else hit.when(when, value)
    word = F.when(F.col("_a.kind") == "auth_fail", "failed").otherwise("success")
    text = F.concat(F.lit("auth "), word, F.lit(" for user '"), F.col("_a.user"), F.lit("' from "), F.col("_a.ip"))
    d = records.withColumn("_a", hit)
    return d.select(
        *(c for c in records.columns if c != "msg"),
        F.when(F.col("_a").isNotNull(), text).otherwise(msg).alias("msg"),
        F.when(F.col("_a").isNotNull(), msg).otherwise(none).alias("original_msg"),
        F.col("_a.kind").alias("kind"), F.col("_a.source").alias("auth_source"), F.col("_a.ip").alias("auth_ip"), F.col("_a.user").alias("auth_user"),
    )


def kind_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("run_id", F.coalesce("kind", F.lit("untouched")).alias("kind")).agg(F.count("*").alias("n"))


def drop_companions(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Without companion lines for which the same run has an anchor of equal keys; null keys match null keys."""
    keys = keys or ["auth_ip", "pid"]
    anchors = records.filter(F.col("auth_source") == "failed_password").select("run_id", *keys).distinct().alias("a")
    r = records.alias("r")
    cond = F.col("r.auth_source").isin(P.COMPANIONS) & (F.col("r.run_id") == F.col("a.run_id"))
    for k in keys:
        cond &= F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}"))
    return r.join(anchors, cond, "left_anti")
