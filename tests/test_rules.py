"""Golden cases: small logs typed in here, findings compared as (type, severity, entity) sets."""

import pytest
from pyspark.sql import functions as F

from loomwatch.operators import canonical as C, rules
from loomwatch.sources import envelopes as E, lines as L


def findings(spark, text, ident="run"):
    lines = spark.createDataFrame([(ident, k + 1, x) for k, x in enumerate(text)], "run_id string, n long, raw string")
    records = C.canonicalise(E.ingest(lines, L.sniff(lines)))
    out = rules.detect(records, C.drop_companions(records))
    return {(r.type, r.severity, r.entity) for r in out.collect()}


def stamp(k, step=10):
    s = k * step
    return f"2026-08-13T02:{10 + s // 60:02d}:{s % 60:02d}Z"


def fails(ip, n, step=10, level="WARN"):
    return [f"{stamp(k, step)} {level}  server-01 auth failed for user 'admin' from {ip} (invalid password)" for k in range(n)]


CASES = {
    "burst": (fails("198.51.100.10", 6), {("auth_bruteforce", "high", "198.51.100.10")}),
    "compromise": (
        fails("198.51.100.11", 6) + [f"{stamp(7)} INFO  server-01 auth success for user 'admin' from 198.51.100.11"],
        {("auth_bruteforce_success", "critical", "198.51.100.11")},
    ),
    "outbound": ([f"{stamp(0)} INFO  server-01 connection to 203.0.113.77:4444 allowed"], {("suspicious_outbound", "high", "203.0.113.77")}),
    "disk high": ([f"{stamp(0)} WARN  server-01 disk usage at 95% on /var"], {("disk_pressure", "high", "server-01")}),
    "disk medium": ([f"{stamp(0)} WARN  server-01 disk usage at 85% on /var"], {("disk_pressure", "medium", "server-01")}),
    "disk fine": ([f"{stamp(0)} WARN  server-01 disk usage at 78% on /var"], set()),
    "spike": ([f"{stamp(k)} ERROR server-01 job {k} broke" for k in range(5)], {("error_rate_spike", "medium", None)}),
    "spike at the limit": ([f"{stamp(k, 15)} ERROR server-01 job {k} broke" for k in range(5)], {("error_rate_spike", "medium", None)}),
    "no spike": ([f"{stamp(k, 16)} ERROR server-01 job {k} broke" for k in range(5)], set()),
    "four failures": (fails("198.51.100.30", 4), set()),
    "slow trickle": (fails("198.51.100.31", 6, 100), {("auth_bruteforce", "medium", "198.51.100.31")}),
    "window is inclusive": (fails("198.51.100.32", 5, 30), {("auth_bruteforce", "high", "198.51.100.32")}),
    "break-in": (
        [f"Jul  3 10:0{k}:00 combo sshd[1]: reverse mapping checking getaddrinfo for x [203.0.113.90] failed - POSSIBLE BREAK-IN ATTEMPT!" for k in range(3)],
        {("possible_break_in", "medium", "203.0.113.90")},
    ),
    "syslog": (
        [f"Jul  3 10:00:{10 * k:02d} combo sshd[{k}]: Failed password for root from 198.51.100.20 port 22" for k in range(6)],
        {("auth_bruteforce", "high", "198.51.100.20")},
    ),
    "companions count once": (
        [x for k in range(4) for x in (
            f"Jul  3 10:00:{10 * k:02d} combo sshd[{k}]: Invalid user bob from 198.51.100.40",
            f"Jul  3 10:00:{10 * k:02d} combo sshd[{k}]: Failed password for invalid user bob from 198.51.100.40",
        )],
        set(),
    ),
    "unrecognised": (["%%% nothing", "to see here"], set()),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    text, want = CASES[name]
    assert findings(spark, text) == want


def test_same_attack_in_two_formats(spark):
    a = fails("198.51.100.20", 6)
    b = [f"Aug 13 02:{10 + k // 6:02d}:{10 * (k % 6):02d} server-01 sshd[{k}]: Failed password for admin from 198.51.100.20" for k in range(6)]
    assert findings(spark, a) == findings(spark, b)


def test_partitioning_does_not_matter(spark):
    text = fails("198.51.100.10", 7) + [f"{stamp(k)} ERROR server-01 job {k} broke" for k in range(12)]
    lines = spark.createDataFrame([("r", k + 1, x) for k, x in enumerate(text)], "run_id string, n long, raw string")
    got = []
    for n in (1, 7):
        r = C.canonicalise(E.canonical(lines.repartition(n)))
        got.append(sorted(map(tuple, rules.detect(r).collect())))
    assert got[0] == got[1] and got[0]


def test_threat_gate_changes_nothing(spark):
    from pyspark.sql import functions as F

    from loomwatch.functions import patterns as P

    texts = ["ransomware seen", "Cobalt Strike beacon", "port scan from x", "nothing", "", "pass-the-hash then psexec", "powershell -c download"]
    d = spark.createDataFrame([(t,) for t in texts], "raw string")
    free = None
    for sev, kind, rx in P.THREATS:
        free = F.when(F.col("raw").rlike("(?i)" + rx), kind) if free is None else free.when(F.col("raw").rlike("(?i)" + rx), kind)
    rows = d.select(rules.first_threat(F.col("raw"))["type"].alias("a"), free.alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[0].a == "threat_ransomware" and rows[3].a is None


def test_windows_and_status_fields(spark):
    rows = [
        (1, "logon", {"eventid": "4625", "ipaddress": "203.0.113.5", "targetusername": "bob"}), (2, "logon", {"eventid": "4624", "ipaddress": "-"}),
        (3, "row", {"status": "Denied", "src_ip": "203.0.113.6", "user": "eve"}), (4, "cleared", {"eventid": "1102"}),
    ]
    d = spark.createDataFrame([("r", n, None, "INFO", "h", m, m, None, f) for n, m, f in rows], "run_id string, n long, ts timestamp, level string, host string, msg string, raw string, pid string, fields map<string,string>")
    c = {r.n: (r.kind, r.auth_source, r.msg) for r in C.canonicalise(d).collect()}
    assert c[1] == ("auth_fail", "windows_4625", "auth failed for user 'bob' from 203.0.113.5")
    assert c[2][0] is None and c[3][1] == "auth_csv" and c[4][0] is None
    assert {(r.type, r.severity) for r in rules.windows_events(d).collect()} == {("windows_audit_log_cleared", "critical")}


def test_opening_words_lose_no_match(spark):
    """The gate passes every text that a rule matches, and no rule's pattern is tried where none of its words stands."""
    from loomwatch.functions import patterns as P
    from loomwatch.operators import infra
    from loomwatch.operators.rules import opening_pattern, union_pattern

    texts = ["Link DOWN", "the uplink err-disabled", "é-port down", "_port down", "fibre channel path lost", "login attempt x failed", "spanning-tree root change", "clock has drift", "data leak detected", "ransomware", "xransomware", "DLP a violation", "firewall rule removed", "7port up", "nothing", ""]
    families = [("critical", P.INFRA_CRITICAL), ("high", P.INFRA_HIGH), ("medium", P.INFRA_MEDIUM), ("low", P.INFRA_LOW)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*(F.when(F.col("t").rlike(union_pattern(r).replace("(?is)", "(?i)")), s) for s, r in families))
    got = d.select("t", infra.text_severity(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(r.a is not None for r in got) > 8
    assert all(opening_pattern(r) for _, r in families) and opening_pattern([r"x\d+"]) is None
