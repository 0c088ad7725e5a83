"""Process forests: nodes from events, positions, chains, analysis and risk.

Positions in the forest come from pointer doubling: in each round every node's pointer takes its
target's, so a tree of depth d takes about log2(d) equi-joins on (endpoint, key), and cycles (reused
process numbers) end after the rounds that the number of nodes allows.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import basename_lower, micros, node_key
from ..sources.scratch import cut

# What counts as a process of the system, as excluded and as suspicious.
SYSTEM = "system svchost.exe winlogon.exe csrss.exe smss.exe wininit.exe services.exe lsass.exe explorer.exe dwm.exe conhost.exe audiodg.exe spoolsv.exe taskhost.exe taskhostw.exe".split()
EXCLUDED = "system svchost.exe winlogon.exe csrss.exe smss.exe wininit.exe services.exe lsass.exe explorer.exe dwm.exe".split()
SUSPICIOUS = "powershell cmd.exe wmic.exe certutil.exe rundll32.exe regsvr32.exe mshta.exe schtasks.exe sc.exe net.exe at.exe bitsadmin.exe wget.exe curl.exe ftp.exe telnet.exe".split()
PAIRS = [
    ("winword.exe", "powershell.exe", "Office spawning PowerShell", "high"),
    ("excel.exe", "powershell.exe", "Office spawning PowerShell", "high"),
    ("outlook.exe", "powershell.exe", "Office spawning PowerShell", "high"),
    ("chrome.exe", "powershell.exe", "Browser spawning PowerShell", "medium"),
    ("msedge.exe", "powershell.exe", "Browser spawning PowerShell", "medium"),
    ("powershell.exe", "cmd.exe", "PowerShell spawning cmd", "medium"),
    ("cmd.exe", "wmic.exe", "cmd spawning WMIC", "high"),
    ("powershell.exe", "certutil.exe", "PowerShell spawning certutil", "high"),
    ("powershell.exe", "rundll32.exe", "PowerShell spawning rundll32", "high"),
]
MIN_AGE_S, MANY, RECENT_S = 5, 20, 300


def _any(c: Column, words: list[str]) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?i)" + "|".join(w.replace(".", r"\.") for w in words))


def admitted(exe: Column, command: Column, ts: Column, as_of: Column, include: list[str] | None = None) -> Column:
    """Old enough, no process of the system, not excluded and, if there is a list, included.  Events without a time aren't."""
    old = F.coalesce(micros(as_of) - micros(ts) >= MIN_AGE_S * 1_000_000, F.lit(False))
    ok = old & ~_any(exe, SYSTEM) & ~_any(exe, EXCLUDED) & ~_any(command, EXCLUDED)
    if include:
        wanted = "|".join(f"(?:{p})" for p in include)
        ok = ok & (F.coalesce(exe, F.lit("")).rlike(wanted) | F.coalesce(command, F.lit("")).rlike(wanted))
    return ok


def suspicious(exe: Column, command: Column) -> Column:
    return _any(exe, SUSPICIOUS) | _any(command, SUSPICIOUS)


def build_nodes(events: DataFrame, as_of: Column, seq: str = "seq", include: list[str] | None = None) -> DataFrame:
    """Process events (endpoint_id, entity_id, parent_entity_id, pid, ppid, name, executable, command_line, ts, seq) to nodes.

    The last non-empty attribute stays; the last event's parent counts, and an empty one detaches; parents
    that were never seen are nodes without attributes.
    """
    e = events.where((F.col("endpoint_id") != "") & admitted(F.col("executable"), F.col("command_line"), F.col("ts"), as_of, include))
    e = e.withColumn("key", node_key(F.col("entity_id"), F.col("pid"))).withColumn("parent_key", node_key(F.col("parent_entity_id"), F.col("ppid"))).where(F.col("key").isNotNull())
    kept = [F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(seq))).alias(c) for c in ("pid", "ppid", "name", "executable", "command_line")]
    nodes = e.groupBy("endpoint_id", "key").agg(*kept, F.max_by("parent_key", seq).alias("parent_key"), F.min_by("ts", seq).alias("first_seen"), F.max("ts").alias("last_seen"))
    nodes = nodes.select("endpoint_id", "key", "parent_key", *[F.coalesce(c, F.lit("")).alias(c) for c in ("pid", "ppid", "name", "executable", "command_line")], "first_seen", "last_seen", F.lit(False).alias("placeholder"))
    missing = nodes.where(F.col("parent_key").isNotNull()).groupBy("endpoint_id", F.col("parent_key").alias("key")).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    missing = missing.join(nodes.select("endpoint_id", "key"), ["endpoint_id", "key"], "left_anti")
    blank = missing.select("endpoint_id", "key", F.lit(None).cast("string").alias("parent_key"), *[F.lit("").alias(c) for c in ("pid", "ppid", "name", "executable", "command_line")], "first_seen", "last_seen", F.lit(True).alias("placeholder"))
    return nodes.unionByName(blank).withColumn("suspicious", suspicious(F.col("executable"), F.col("command_line")))


def roots(nodes: DataFrame) -> DataFrame:
    """No parent, or one that is no node."""
    have = nodes.select("endpoint_id", F.col("key").alias("parent_key"))
    return nodes.join(have, ["endpoint_id", "parent_key"], "left_anti").select(nodes.columns)


def _double(pointers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., key, ptr, dist, done) until every pointer is done or in a cycle."""
    now = cut(pointers)
    rounds, n = 0, max(2, now.count())
    while rounds <= math.ceil(math.log2(n)) + 1 and not now.where(~F.col("done")).isEmpty():
        target = now.select(*keys, F.col("key").alias("ptr"), F.col("ptr").alias("_p"), F.col("dist").alias("_d"), F.col("done").alias("_done"))
        moved = now.join(target, [*keys, "ptr"], "left")
        go = ~F.col("done")
        now = cut(moved.select(*keys, "key", F.when(go, F.coalesce("_p", "ptr")).otherwise(F.col("ptr")).alias("ptr"), (F.col("dist") + F.when(go, F.coalesce("_d", F.lit(0))).otherwise(F.lit(0))).alias("dist"), F.when(go, F.coalesce("_done", F.lit(True))).otherwise(F.lit(True)).alias("done")))
        rounds += 1
    return now


def positions(nodes: DataFrame) -> DataFrame:
    """endpoint_id, key, root, depth (roots: 1); nodes of a cycle have neither."""
    top = roots(nodes).select("endpoint_id", "key", F.lit(True).alias("_top"))
    start = nodes.select("endpoint_id", "key", "parent_key").join(top, ["endpoint_id", "key"], "left")
    pointers = start.select("endpoint_id", "key", F.when(F.col("_top"), F.col("key")).otherwise(F.col("parent_key")).alias("ptr"), F.when(F.col("_top"), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("dist"), F.coalesce("_top", F.lit(False)).alias("done"))
    out = _double(pointers, ["endpoint_id"])
    return out.select("endpoint_id", "key", F.when(F.col("done"), F.col("ptr")).alias("root"), F.when(F.col("done"), F.col("dist") + 1).alias("depth"))


#: Recursion is bounded by the data here, as paths hold a key once; the session's limits stay as they were afterwards.
_LIMITS = ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit")


def _recursive(sql: str, views: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """The rows of a recursive query over views, which have names of their own in each call; runs at once."""
    spark = next(iter(views.values())).sparkSession
    mark = uuid.uuid4().hex
    old = {n: spark.conf.get(n, None) for n in _LIMITS}
    try:
        for n in _LIMITS:
            spark.conf.set(n, "-1")
        for n, df in views.items():
            df.createOrReplaceTempView(f"{n}_{mark}")
        return cut(spark.sql(sql.format(**{n: f"{n}_{mark}" for n in views}), args=args or {}))
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
        for n in views:
            spark.catalog.dropTempView(f"{n}_{mark}")


def chain(nodes: DataFrame, endpoint: str, key: str) -> DataFrame:
    """From the root down to a node: step (root: 1), key; ends where a cycle closes."""
    own = nodes.where(F.col("endpoint_id") == endpoint).select("key", "parent_key")
    up = _recursive("WITH RECURSIVE c(key, parent_key, n, path) AS (SELECT key, parent_key, 1, array(key) FROM {own} WHERE key = :key UNION ALL SELECT p.key, p.parent_key, c.n + 1, array_append(c.path, p.key) FROM c JOIN {own} p ON p.key = c.parent_key WHERE NOT array_contains(c.path, p.key)) SELECT key, n FROM c", {"own": own}, {"key": key})
    last = Window.orderBy(F.desc("n"))
    return up.select(F.row_number().over(last).alias("step"), "key")


def descendants(nodes: DataFrame, endpoint: str, key: str) -> DataFrame:
    """All nodes below one, with their depth under it (children: 1)."""
    own = nodes.where(F.col("endpoint_id") == endpoint).select("key", "parent_key")
    return _recursive("WITH RECURSIVE d(key, depth, path) AS (SELECT key, 0, array(key) FROM {own} WHERE key = :key UNION ALL SELECT n.key, d.depth + 1, array_append(d.path, n.key) FROM d JOIN {own} n ON n.parent_key = d.key WHERE NOT array_contains(d.path, n.key)) SELECT key, depth FROM d WHERE depth > 0", {"own": own}, {"key": key})


def snapshot(nodes: DataFrame, endpoint: str, key: str | None = None) -> DataFrame:
    """The trees of an endpoint (or of one root), as rows in display order: depth, path of keys, attributes."""
    own = nodes.where(F.col("endpoint_id") == endpoint)
    if own.isEmpty() or (key is not None and own.where(F.col("key") == key).isEmpty()):
        raise KeyError(f"{endpoint}/{key}")
    start = roots(own) if key is None else own.where(F.col("key") == key)
    views = {"own": own.select("key", "parent_key"), "start": start.select("key")}
    rows = _recursive("WITH RECURSIVE t(key, depth, path) AS (SELECT key, 1, array(key) FROM {start} UNION ALL SELECT n.key, t.depth + 1, array_append(t.path, n.key) FROM t JOIN {own} n ON n.parent_key = t.key WHERE NOT array_contains(t.path, n.key)) SELECT key, depth, path FROM t", views)
    top = start.select(F.col("key").alias("_root"), F.col("last_seen").alias("_seen"))
    return rows.join(own, "key").join(top, F.col("path")[0] == F.col("_root")).orderBy(F.desc("_seen"), "path").drop("_root", "_seen")


def stats(nodes: DataFrame) -> DataFrame:
    """By endpoint: nodes and suspicious ones."""
    return nodes.groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("suspicious").alias("suspicious"))


def analysis(nodes: DataFrame) -> DataFrame:
    """By endpoint: processes, suspicious ones, depth, roots, orphans (roots with a parent that is no node), children."""
    pos = positions(nodes)
    children = nodes.where(F.col("parent_key").isNotNull()).groupBy("endpoint_id", F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("children"))
    full = nodes.join(pos, ["endpoint_id", "key"]).join(children, ["endpoint_id", "key"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return full.groupBy("endpoint_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("suspicious").alias("suspicious"), F.max("depth").alias("tree_depth"), F.count_if(F.col("depth") == 1).alias("roots"),
        F.count_if((F.col("depth") == 1) & F.col("placeholder")).alias("orphans"), F.avg("children").alias("avg_children"), F.max("children").alias("max_children"),
    )


def executable_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("executable") != "").groupBy("endpoint_id", basename_lower(F.col("executable")).alias("executable")).agg(F.count(F.lit(1)).alias("n"))


def anomalies(nodes: DataFrame, many: int = MANY) -> DataFrame:
    """Executables seen more than ``many`` times."""
    c = executable_counts(nodes).where(F.col("n") > many)
    return c.select("endpoint_id", F.lit("excessive_children").alias("type"), F.lit("medium").alias("severity"), "executable", "n")


def ancestor_executables(nodes: DataFrame) -> DataFrame:
    """endpoint_id, key, exe, above: a node's executable and that of the nearest ancestor that has one."""
    exe = nodes.select("endpoint_id", "key", "parent_key", basename_lower(F.col("executable")).alias("exe"))
    parent = exe.select("endpoint_id", F.col("key").alias("parent_key"), F.col("exe").alias("_pe"), F.col("parent_key").alias("_pp"))
    start = exe.join(parent, ["endpoint_id", "parent_key"], "left")
    stop = F.col("_pe").isNull() | (F.col("_pe") != "") | F.col("_pp").isNull()
    pointers = start.select("endpoint_id", "key", F.col("parent_key").alias("ptr"), F.lit(1).cast("long").alias("dist"), stop.alias("done"))
    found = _double(pointers, ["endpoint_id"]).where("done").select("endpoint_id", "key", F.col("ptr").alias("_a"))
    names = exe.select("endpoint_id", F.col("key").alias("_a"), F.col("exe").alias("above"))
    return exe.join(found, ["endpoint_id", "key"], "left").join(names, ["endpoint_id", "_a"], "left").select("endpoint_id", "key", "exe", "above")


def suspicious_pairs(nodes: DataFrame) -> DataFrame:
    """Nodes whose executable and nearest named ancestor are one of the known pairs."""
    table = nodes.sparkSession.createDataFrame(PAIRS, "above string, exe string, description string, risk string")
    return ancestor_executables(nodes).join(F.broadcast(table), ["above", "exe"]).select("endpoint_id", "key", "above", "exe", "description", "risk")


def risk_level(score: Column) -> Column:
    return F.when(score >= 2.0, F.lit("critical")).when(score >= 1.5, F.lit("high")).when(score >= 1.0, F.lit("medium")).otherwise(F.lit("low"))


def risk_scores(detections: DataFrame, processes: DataFrame, as_of: Column) -> DataFrame:
    """Detections (process_key, rule_name, severity, confidence, ts) to a score, level and threats of each process."""
    sev = F.when(F.col("severity") == "critical", 0.4).when(F.col("severity") == "high", 0.3).when(F.col("severity") == "medium", 0.2).when(F.col("severity") == "low", 0.1).otherwise(0.0)
    recent = F.when(micros(as_of) - micros("ts") < RECENT_S * 1_000_000, 0.1).otherwise(0.0)
    own = detections.groupBy("process_key").agg(F.count(F.lit(1)).alias("detections"), F.sum(F.lit(0.3) + sev + F.col("confidence") * 0.2 + recent).alias("_s"), F.sort_array(F.collect_set("rule_name")).alias("threats"), F.max("ts").alias("last_ts"))
    flags = processes.select("process_key", suspicious(F.col("executable"), F.col("command_line")).alias("_f"))
    score = F.round(F.col("_s") + F.when(F.coalesce("_f", F.lit(False)), 0.2).otherwise(0.0), 6)
    out = own.join(flags, "process_key", "left").withColumn("score", score)
    return out.select("process_key", "detections", "score", risk_level(F.col("score")).alias("risk"), "threats", "last_ts")


def high_risk(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("score") >= 1.0)


def unexpired(scores: DataFrame, as_of: Column, window_s: int = RECENT_S) -> DataFrame:
    """Processes with a detection within twice the window."""
    return scores.where(micros(as_of) - micros("last_ts") <= 2 * window_s * 1_000_000)


def risk_stats(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("risk") == r).alias(r) for r in ("critical", "high", "medium", "low")], F.avg("score").alias("avg_score"))


# Advice by risk level and by threat.
ADVICE = {
    "critical": ["Immediate investigation required", "Consider isolating the endpoint", "Review process chain for lateral movement"],
    "high": ["Priority investigation required", "Monitor for additional suspicious activity", "Review process execution logs"],
    "medium": ["Schedule investigation", "Monitor process behavior"],
}
THREAT_ADVICE = {
    "powershell_suspicious": ["Review PowerShell execution policy", "Check for encoded commands"],
    "process_injection": ["Scan for malware", "Check for DLL hijacking"],
    "lateral_movement": ["Review network connections", "Check for credential theft"],
}


def recommendations(risk: Column, threats: Column) -> Column:
    level = [F.when(risk == r, F.array(*[F.lit(x) for x in xs])) for r, xs in ADVICE.items()]
    threat = [F.when(F.array_contains(threats, t), F.array(*[F.lit(x) for x in xs])) for t, xs in THREAT_ADVICE.items()]
    return F.flatten(F.array_compact(F.array(*level, *threat)))


# The report's words.
def report(row: dict, pairs: list[dict], found: list[dict], n_pairs: int | None = None, n_found: int | None = None) -> str:
    """The text report of one endpoint's analysis; the counts are of all, where not all are listed."""
    n_pairs, n_found = len(pairs) if n_pairs is None else n_pairs, len(found) if n_found is None else n_found
    more = lambda n, listed: [f"  ({n - len(listed)} more not listed)"] if n > len(listed) else []
    lines = ["Process Tree Analysis Report", f"Endpoint: {row['endpoint_id']}", f"Total Processes: {row['total']}", f"Suspicious Processes: {row['suspicious']}", f"Tree Depth: {row['tree_depth']}", f"Root Processes: {row['roots']}", f"Orphan Processes: {row['orphans']}", "", f"Suspicious Chains: {n_pairs}"]
    lines += [f"  {i}. {p['description']} (Risk: {p['risk']}, Count: 2)" for i, p in enumerate(pairs, 1)] + more(n_pairs, pairs)
    lines += ["", f"Anomalies: {n_found}"]
    lines += [f"  {i}. [{a['severity']}] {a['type']}: Process {a['executable']} has {a['n']} children" for i, a in enumerate(found, 1)] + more(n_found, found)
    return "\n".join(lines) + "\n"
