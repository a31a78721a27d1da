"""Structured sources: JSON and CSV files, Windows event text and XML, HTML, scan reports, collector payloads, saved runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from loomwatch.functions import patterns as P
from loomwatch.functions.prefix import running_sum
from loomwatch.sources.envelopes import iso_time, level_from_text, lookup

WRAPPERS = ["events", "results", "records", "logs", "items", "data"]


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, n, raw) of the elements of a JSON array, bare or under one of the known wrapper keys."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run_id"), F.col("value").alias("doc"))
    arrays = [F.when(F.trim("doc").startswith("["), F.from_json("doc", "array<string>"))]
    arrays += [F.from_json(F.get_json_object("doc", f"$.{w}"), "array<string>") for w in WRAPPERS]
    return d.select("run_id", F.posexplode(F.coalesce(*arrays)).alias("_p", "raw")).select("run_id", (F.col("_p") + 1).cast("long").alias("n"), "raw")


def json_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run_id, n, raw, fields) of lines that hold an object, and the bad lines."""
    d = lines.filter(F.trim("raw") != "").withColumn("fields", F.when(F.col("raw").rlike(r"^\s*\{.*\}\s*$"), F.from_json("raw", "map<string,string>")))
    return d.filter("fields is not null"), d.filter("fields is null").drop("fields")


def sniff_delimiter(lines: DataFrame) -> DataFrame:
    """(run_id, sep): of comma, semicolon, tab and pipe the one that splits the first ten lines into most columns."""
    w = W.partitionBy("run_id").orderBy("n")
    head = lines.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= 10)
    score = [F.struct(F.sum(F.size(F.split("raw", "[" + s + "]"))).alias("n"), F.lit(-k).alias("k"), F.lit(c).alias("sep")) for k, (s, c) in enumerate(((",", ","), (";", ";"), ("\t", "\t"), ("|", "|")))]
    return head.groupBy("run_id").agg(*(x.alias(f"_{k}") for k, x in enumerate(score))).select("run_id", F.greatest(*(F.col(f"_{k}") for k in range(4)))["sep"].alias("sep"))


def csv_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(run_id, n, raw, fields) with lower-cased header names as keys."""
    d = spark.read.csv(path, header=True, sep=sep, multiLine=True, mode="PERMISSIVE")
    cols = [c for c in d.columns]
    fields = F.map_from_arrays(F.array(*(F.lit(c.strip().lower()) for c in cols)), F.array(*(F.col(f"`{c}`").cast("string") for c in cols)))
    d = d.select(F.col("_metadata.file_path").alias("run_id"), F.monotonically_increasing_id().alias("_m"), F.to_csv(F.struct(*(F.col(f"`{c}`") for c in cols))).alias("raw"), fields.alias("fields"))
    first = d.groupBy("run_id").agg(F.min("_m").alias("_first"))  # a file of multi-line rows is read in one piece
    return d.join(first, "run_id").select("run_id", (F.col("_m") - F.col("_first") + 2).alias("n"), "raw", "fields")


def pick(names: list[str], fields: str = "fields") -> Column:
    return F.coalesce(*(F.try_element_at(fields, F.lit(n)) for n in names))


def auth_csv(rows: DataFrame) -> DataFrame:
    """Records of an authentication export: level unknown, the fields kept for the vocabulary."""
    ts = iso_time(pick(["timestamp", "time", "datetime", "date"]))
    user, ip, status = pick(["username", "user", "account"]), pick(["ip_address", "src_ip", "source_ip", "client_ip", "ip"]), pick(["status", "result", "outcome"])
    d = rows.filter(ip.isNotNull() & status.isNotNull())
    return d.select("run_id", "n", ts.alias("ts"), F.lit("UNKNOWN").alias("level"), pick(["source", "host"]).alias("host"), F.concat_ws(" ", status, user, ip).alias("msg"), "raw", "fields")


LOG360_LEVELS = {"emergency": "CRIT", "alert": "CRIT", "critical": "CRIT", "error": "ERROR", "failure": "ERROR", "warning": "WARN", "notice": "INFO", "information": "INFO", "success": "INFO", "debug": "DEBUG"}


def log360_csv(rows: DataFrame) -> DataFrame:
    text = pick(["time"])
    ts = F.coalesce(iso_time(text), F.try_to_timestamp(text, F.lit("MMM dd, yyyy h:mm:ss a")), F.try_to_timestamp(text, F.lit("dd MMM yyyy HH:mm:ss")), F.try_to_timestamp(text, F.lit("MM/dd/yyyy HH:mm:ss")))
    sev = F.lower(F.trim(F.coalesce(pick(["severity"]), pick(["common severity"]))))
    msg = pick(["message"])
    d = rows.filter(msg.isNotNull() & ts.isNotNull())
    return d.select("run_id", "n", ts.alias("ts"), F.coalesce(lookup(LOG360_LEVELS, sev), F.lit("INFO")).alias("level"), F.coalesce(pick(["device"]), pick(["source"])).alias("host"), msg.alias("msg"), "raw", "fields")


WINDOWS_START = r"^\s*(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2}\s*(?:AM|PM))\s*$"


def windows_text(lines: DataFrame) -> DataFrame:
    """A line with a time opens a record, ``key=value`` lines fill it, other lines belong to the last value."""
    d = lines.withColumn("_s", F.col("raw").rlike(WINDOWS_START).cast("int"))
    d = running_sum(d, F.col("_s"), "_r").filter("_r > 0")
    key = F.nullif(F.regexp_extract("raw", r"^\s*([A-Za-z][\w ]*?)=(.*)$", 1), F.lit(""))
    d = d.withColumn("_k", F.when(F.col("_s") == 0, key)).withColumn("_key", F.last("_k", ignorenulls=True).over(W.partitionBy("run_id", "_r").orderBy("n")))
    value = F.when(F.col("_k").isNotNull(), F.regexp_extract("raw", r"^\s*[A-Za-z][\w ]*?=(.*)$", 1)).otherwise(F.col("raw"))
    parts = d.withColumn("_v", value).groupBy("run_id", "_r", "_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "_v"))), lambda x: x["_v"]), "\n").alias("_v"), F.min("n").alias("_n"))
    head = d.filter("_s = 1").select("run_id", "_r", "n", F.regexp_extract("raw", WINDOWS_START, 1).alias("_t"))
    fields = parts.filter("_key is not null").groupBy("run_id", "_r").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("_key"), "_v"))).alias("fields"))
    raw = d.groupBy("run_id", "_r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw"))), lambda x: x["raw"]), "\n").alias("raw"))
    out = head.join(raw, ["run_id", "_r"]).join(fields, ["run_id", "_r"], "left")
    ts = F.try_to_timestamp(F.regexp_replace("_t", r"\s+", " "), F.lit("M/d/yyyy h:mm:ss a"))
    return out.select("run_id", "n", ts.alias("ts"), pick(["computername"]).alias("host"), F.coalesce(pick(["message"]), F.col("raw")).alias("msg"), "raw", "fields")


EVENT_XML = (
    "System struct<Provider:struct<_Name:string>,EventID:string,Level:string,Computer:string,Channel:string,TimeCreated:struct<_SystemTime:string>>,"
    "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"
)
XML_LEVELS = {"1": "critical", "2": "high", "3": "medium", "4": "low", "5": "info"}


def event_xml(rows: DataFrame, column: str = "xml") -> DataFrame:
    """Store events from one event's XML per row; rows that do not parse give nulls and are counted by the caller."""
    d = rows.withColumn("_e", F.from_xml(F.col(column), EVENT_XML, {"rowTag": "Event", "mode": "PERMISSIVE"}))
    data = F.slice(F.col("_e.EventData.Data"), 1, 6)
    keep = [c for c in rows.columns if c != column]
    return d.select(
        *keep, F.col("_e.System.EventID").alias("event_id"), lookup(XML_LEVELS, F.col("_e.System.Level"), F.lit("info")).alias("severity"),
        F.col("_e.System.Computer").alias("host"), iso_time(F.col("_e.System.TimeCreated._SystemTime")).alias("ts"),
        F.array_join(F.transform(data, lambda x: F.concat(x["_Name"], F.lit("="), F.coalesce(x["_VALUE"], F.lit("")))), " ").alias("message"),
    )


def xml_events(spark: SparkSession, path: str, tags: tuple[str, ...] = ("event", "Event", "entry", "record", "log")) -> DataFrame:
    """(run_id, tag, json): one row per event-like element, whatever its tag."""
    out = None
    for tag in tags:
        try:
            d = spark.read.format("xml").option("rowTag", tag).load(path)
        except Exception as e:  # no element of this tag: nothing to infer a schema from
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            continue
        if not d.columns:
            continue
        one = d.select(F.col("_metadata.file_path").alias("run_id"), F.lit(tag).alias("tag"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in d.columns))).alias("json"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "run_id string, tag string, json string")


def html_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, k, row): text rows closed by table rows, paragraphs, divisions and items; tags stripped, white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?i)</(tr|p|div|li)\s*>", "\n"), r"<[^>]*>", " ")
    rows = pages.select(key, F.posexplode(F.split(text, "\n")).alias("k", "row"))
    return rows.withColumn("row", F.trim(F.regexp_replace("row", r"[ \t\r\n\f]+", " "))).filter("row <> ''")


COLLECTOR_KINDS = {
    "edr": ["process", "process_name", "parent_process", "file_hash", "sha256"],
    "firewall": ["src_ip", "dst_ip", "dst_port", "rule", "action"],
    "cloud": ["eventname", "eventsource", "awsregion", "useridentity"],
}


def collector_events(rows: DataFrame, column: str = "json") -> DataFrame:
    """One JSON event per row: dotted paths resolved, severity words and numbers brought to one scale, kind by known keys."""
    v = F.try_parse_json(column)
    get = lambda *paths: F.coalesce(*(F.try_variant_get(v, f"$.{p}", "string") for p in paths))
    keys = F.transform(F.json_object_keys(column), F.lower)
    kind = None
    for name, known in COLLECTOR_KINDS.items():
        hit = F.arrays_overlap(keys, F.array(*map(F.lit, known)))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    sev = F.lower(get("severity", "level", "priority", "event.severity"))
    number = F.try_to_number(F.when(sev.rlike(r"^\d{1,3}$"), sev), F.lit("999"))
    scale = F.when(number >= 80, "critical").when(number >= 60, "high").when(number >= 40, "medium").when(number >= 20, "low").when(number.isNotNull(), "info")
    words = lookup({"critical": "critical", "crit": "critical", "fatal": "critical", "high": "high", "error": "high", "medium": "medium", "warning": "medium", "warn": "medium", "low": "low", "info": "info", "informational": "info"}, sev)
    keep = [c for c in rows.columns if c != column]
    return rows.select(
        *keep, kind.otherwise("webhook").alias("kind"), F.coalesce(scale, words, F.lit("info")).alias("severity"), get("host", "hostname", "device.hostname", "agent.hostname").alias("host"),
        get("src_ip", "source.ip", "sourceIPAddress").alias("src_ip"), get("user", "username", "user.name", "userIdentity.userName").alias("user"), get("message", "msg", "description", "eventName").alias("message"),
        v.isNull().alias("unparsed"),
    )


def unwrap_batches(rows: DataFrame, column: str = "json") -> DataFrame:
    """A row per event of webhook payloads: a list, an object or a bare event under ``events`` or ``event``, or the payload itself."""
    many = F.from_json(F.get_json_object(column, "$.events"), "array<string>")
    one = F.coalesce(F.get_json_object(column, "$.event"), F.get_json_object(column, "$.events"), F.col(column))
    keep = [c for c in rows.columns if c != column]
    return rows.select(*keep, F.explode(F.coalesce(many, F.array(one))).alias(column))


def scan_hosts(spark: SparkSession, path: str) -> DataFrame:
    """(ip, host, ports, services) of hosts that are up in port-scan reports."""
    schema = (
        "status struct<_state:string>, address array<struct<_addr:string,_addrtype:string>>, hostnames struct<hostname:array<struct<_name:string>>>,"
        "ports struct<port:array<struct<_portid:int,_protocol:string,state:struct<_state:string>,service:struct<_name:string,_product:string>>>>"
    )
    d = spark.read.schema(schema).format("xml").option("rowTag", "host").load(path).filter("status._state = 'up'")
    opened = F.filter("ports.port", lambda p: p["state"]["_state"] == "open")
    return d.select(
        F.filter("address", lambda a: a["_addrtype"] == "ipv4")[0]["_addr"].alias("ip"), F.col("hostnames.hostname")[0]["_name"].alias("host"),
        F.transform(opened, lambda p: F.concat(p["_portid"].cast("string"), F.lit("/"), p["_protocol"])).alias("ports"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform(opened, lambda p: p["service"]["_name"])))).alias("services"),
    )


def org_context(spark: SparkSession, path: str) -> DataFrame:
    """(asset, criticality, owner): unknown or missing criticality is standard; a malformed file gives no rows."""
    d = spark.read.schema("assets map<string,struct<criticality:string,owner:string,description:string>>").option("multiLine", True).json(path)
    rows = d.select(F.explode("assets").alias("asset", "a"))
    crit = F.when(F.col("a.criticality").isin(list(P.CRITICALITY_WEIGHT)), F.col("a.criticality")).otherwise("standard")
    return rows.select(F.lower("asset").alias("asset"), crit.alias("criticality"), F.col("a.owner").alias("owner"))


def saved_runs(spark: SparkSession, path: str) -> DataFrame:
    """(file, readable, run_id, generated_at, findings) of saved runs, oldest first; unreadable files are flagged, not dropped."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("doc"))
    v = F.try_parse_json("doc")
    get = lambda p: F.try_variant_get(v, p, "string")
    n = F.size(F.from_json(F.get_json_object("doc", "$.findings"), "array<string>"))
    return d.select("file", v.isNotNull().alias("readable"), get("$.runId").alias("run_id"), iso_time(get("$.generatedAt")).alias("generated_at"), F.when(n >= 0, n).alias("findings")).orderBy(F.col("generated_at").asc_nulls_first(), "file")


def message_level(rows: DataFrame) -> DataFrame:
    return rows.withColumn("level", level_from_text(F.coalesce("msg", F.lit(""))))


def vendor_events(rows: DataFrame, column: str = "json") -> DataFrame:
    """A row per event of vendor payloads (under ``events``, ``data`` or ``items``, or the payload itself): raw with sorted keys."""
    lists = [F.from_json(F.get_json_object(column, f"$.{w}"), "array<string>") for w in ("events", "data", "items")]
    keep = [c for c in rows.columns if c != column]
    d = rows.select(*keep, F.explode(F.coalesce(*lists, F.array(F.col(column)))).alias("_e"))
    entries = F.array_sort(F.map_entries(F.from_json("_e", "map<string,string>")))
    return d.select(*keep, F.to_json(F.map_from_entries(entries)).alias("raw"), F.from_json("_e", "map<string,string>").alias("fields"))


def splunk_export(lines: DataFrame) -> DataFrame:
    """(run_id, n, raw, fields) of exported search results: the object under ``result`` if there is one."""
    inner = F.coalesce(F.get_json_object("raw", "$.result"), F.col("raw"))
    return lines.select("run_id", "n", "raw", F.from_json(inner, "map<string,string>").alias("fields")).filter("fields is not null")


def xml_entries(spark: SparkSession, path: str, schema: str, tag: str = "entry") -> DataFrame:
    """Flat entries of a vendor's XML log export."""
    return spark.read.schema(schema).format("xml").option("rowTag", tag).load(path)
