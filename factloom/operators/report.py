"""Coverage, findings, chains, correlation and chunking."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import skew_join
from ..functions.text import confidence, half_up

# ---------------------------------------------------------------- findings
#: Ranks of verdicts, severities and confidences.
VERDICTS = {"CONFIRM": 4, "DOWNGRADE": 3, "NEEDS_REVIEW": 2, "SUPPRESS": 1}
SEVERITIES = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
_SAME = {"CONFIRMED": "CONFIRM", "TRUE_POSITIVE": "CONFIRM", "DOWNGRADED": "DOWNGRADE", "NEED_REVIEW": "NEEDS_REVIEW", "REVIEW": "NEEDS_REVIEW", "REQUIRES_REVIEW": "NEEDS_REVIEW", "SUPPRESSED": "SUPPRESS", "FALSE_POSITIVE": "SUPPRESS"}


def _rank(c: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in ranks.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def verdict(c: Column | str) -> Column:
    """Upper case, - as _, synonyms merged; blank and NULL are CONFIRM."""
    t = F.regexp_replace(F.upper(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))), "-", "_")
    out = F.when(t == "", "CONFIRM")
    for k, v in _SAME.items():
        out = out.when(t == k, v)
    return out.otherwise(t)


def answer_array(text: str | None) -> list[dict]:
    """The JSON array of an answer: the whole text, else the last fenced block that is one, else the last suffix from a [ that is one."""
    t = (text or "").strip()

    def array(s: str) -> list | None:
        try:
            x = json.loads(s)
        except (ValueError, RecursionError):
            return None
        return x if isinstance(x, list) else None

    if (got := array(t)) is None:
        fenced = [x for m in re.finditer(r"```(?:json)?\s*([\s\S]*?)```", t) if (x := array(m.group(1).strip())) is not None]
        got = fenced[-1] if fenced else None
    if got is None and t.endswith("]"):  # a suffix can only be an array if the text ends with ]
        at = t.rfind("[")
        while at >= 0 and got is None:
            got = array(t[at:])
            at = t.rfind("[", 0, at)
    return [x for x in got or [] if isinstance(x, dict)]


def closed_json(text: str) -> object | None:
    """The value of a JSON text that was cut off: what stands before the last complete member or item, with the brackets open there closed. None if nothing can be saved."""
    open_, safe, quoted, at = [], None, False, 0
    while at < len(text):
        c = text[at]
        if quoted:
            at += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_.pop() != c:
                return None
            safe = (at + 1, list(open_))
        elif c == "," and open_:
            safe = (at, list(open_))
        at += 1
    if safe is None:
        return None
    try:
        return json.loads(text[: safe[0]] + "".join(reversed(safe[1])))
    except (ValueError, RecursionError):
        return None


def answer_envelope(text: str | None) -> dict | None:
    """The object with arrays `findings` and `selected_hunters` of an answer: the whole text, else a fenced block, else a suffix from a {; a text cut off is closed after its last complete part."""
    t = (text or "").strip()
    blocks = [m.group(1).strip() for m in re.finditer(r"```(?:json)?\s*([\s\S]*?)```", t)]
    starts = [t[m.start() :] for m in re.finditer(r"\{", t) if '"findings"' in t[m.start() :] and '"selected_hunters"' in t[m.start() :]]
    whole = lambda s: json.loads(s)
    for read, texts in ((whole, [t, *blocks, *reversed(starts)]), (closed_json, [*blocks, *reversed(starts)])):
        for s in texts:
            try:
                x = read(s)
            except (ValueError, RecursionError):
                continue
            if isinstance(x, dict) and isinstance(x.get("findings"), list) and isinstance(x.get("selected_hunters"), list):
                return x
    return None


def parse_answers(answers: DataFrame, text: str = "text", hunter: str = "hunter") -> DataFrame:
    """Findings of answer texts: canonical columns, and every other field as text in `extras`. Texts without an array give nothing."""

    @F.pandas_udf("array<map<string,string>>")
    def arrays(texts: pd.Series) -> pd.Series:
        show = lambda v: v if isinstance(v, str) else None if v is None else json.dumps(v)
        return pd.Series([[{k: show(v) for k, v in f.items()} for f in answer_array(t)] for t in texts], dtype=object)

    f = answers.withColumn("_f", F.explode(arrays(text)))

    def first(*keys: str) -> Column:
        return F.coalesce(*[F.when(F.trim(F.try_element_at("_f", F.lit(k))) != "", F.try_element_at("_f", F.lit(k))) for k in keys], F.lit(""))

    kind = F.upper(F.when(first("vuln_type", "vulnerability_type") == "", F.col(hunter)).otherwise(first("vuln_type", "vulnerability_type")))
    line = F.coalesce(first("start_line").try_cast("int"), first("line").try_cast("int"), F.lit(0))
    known = ["rule_id", "severity", "verdict", "status", "file_path", "file", "message", "description", "title", "vuln_type", "vulnerability_type", "discovered_by", "start_line", "line", "confidence"]
    keep = [c for c in answers.columns if c != text]
    return f.select(
        *keep, first("rule_id").alias("rule_id"), first("severity").alias("severity"), verdict(first("verdict", "status")).alias("verdict"), first("file_path", "file").alias("file_path"), line.alias("start_line"), first("message", "description", "title").alias("message"),
        kind.alias("vuln_type"), F.when(first("discovered_by") == "", F.col(hunter)).otherwise(first("discovered_by")).alias("discovered_by"), first("confidence").alias("confidence_raw"), confidence(first("confidence")).alias("confidence"), F.map_filter("_f", lambda k, v: ~k.isin(known)).alias("extras"),
    )


def dedup_findings(findings: DataFrame) -> DataFrame:
    """The best finding of each (rule_id, file_path, start_line): verdict rank, then confidence, then the first (ord)."""
    rest = [c for c in findings.columns if c not in ("rule_id", "file_path", "start_line")]
    best = F.min_by(F.struct(*rest), F.struct((-_rank(F.col("verdict"), VERDICTS)).alias("v"), (-F.col("confidence")).alias("c"), "ord")).alias("r")
    return findings.groupBy("rule_id", "file_path", "start_line").agg(best).select("rule_id", "file_path", "start_line", "r.*").select(findings.columns)


def by_severity(findings: DataFrame) -> DataFrame:
    """Sorted by severity and confidence, stable."""
    return findings.orderBy(F.desc(_rank(F.upper("severity"), SEVERITIES)), F.desc("confidence"), "ord")


def finding_stats(findings: DataFrame) -> DataFrame:
    """A5: (dimension, key, n) for total, severity, verdict, agent and vulnerability type; blanks count as UNKNOWN, CONFIRM, unknown, UNKNOWN. One pass: grouping sets."""
    text = lambda c, d: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", d).otherwise(F.col(c))
    f = findings.select(F.upper(text("severity", "UNKNOWN")).alias("severity"), F.upper(text("verdict", "CONFIRM")).alias("verdict"), text("discovered_by", "unknown").alias("agent"), text("vuln_type", "UNKNOWN").alias("vuln_type"))
    dims = ["severity", "verdict", "agent", "vuln_type"]
    g = f.groupingSets([[], *[[F.col(d)] for d in dims]], *dims).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    name = F.when(F.col("gid") == 15, "total")
    for i, d in enumerate(dims):
        name = name.when(F.col("gid") == 15 - (8 >> i), f"by_{d}")
    return g.select(name.alias("dimension"), F.coalesce(*dims, F.lit("")).alias("key"), "n")


#: Chain rules (id, amplifier types, target types, severity, confidence), their titles, and aliases of types.
CHAIN_RULES = [
    ("chain-ssrf-cmdinj", ["SSRF"], ["COMMAND_INJECTION"], "CRITICAL", 0.80), ("chain-ssrf-deser", ["SSRF"], ["DESERIALIZATION"], "CRITICAL", 0.80), ("chain-ssrf-xxe", ["SSRF"], ["XXE"], "HIGH", 0.70),
    ("chain-noauth-cmdinj", ["MISSING_AUTH"], ["COMMAND_INJECTION"], "CRITICAL", 0.85), ("chain-noauth-deser", ["MISSING_AUTH"], ["DESERIALIZATION"], "CRITICAL", 0.85), ("chain-noauth-ssrf", ["MISSING_AUTH"], ["SSRF"], "HIGH", 0.80),
    ("chain-weak-whitelist-ssrf", ["WEAK_WHITELIST"], ["SSRF"], "HIGH", 0.80), ("chain-ssti-cmdinj", ["SSTI"], ["COMMAND_INJECTION"], "CRITICAL", 0.75), ("chain-ssrf-whitelist-cmdinj", ["WEAK_WHITELIST"], ["COMMAND_INJECTION"], "CRITICAL", 0.85),
    ("chain-ssrf-credential-injection", ["SSRF"], ["AUTHORIZATION_BYPASS", "UNAUTHORIZED_ACTION"], "CRITICAL", 0.80), ("chain-unauth-ssrf-rce", ["MISSING_AUTH", "UNAUTHORIZED_ACTION"], ["SSRF", "COMMAND_INJECTION"], "CRITICAL", 0.90),
]
CHAIN_TITLES = {
    "chain-ssrf-cmdinj": "SSRF -> Command Injection -> RCE", "chain-ssrf-deser": "SSRF -> Deserialization -> RCE", "chain-ssrf-xxe": "SSRF -> XXE", "chain-noauth-cmdinj": "Missing Auth + Command Injection",
    "chain-noauth-deser": "Missing Auth + Deserialization", "chain-noauth-ssrf": "Missing Auth + SSRF", "chain-weak-whitelist-ssrf": "Weak Whitelist -> SSRF Bypass", "chain-ssti-cmdinj": "Template Injection -> Command Execution",
    "chain-ssrf-whitelist-cmdinj": "SSRF Whitelist Bypass -> Command Injection -> RCE", "chain-ssrf-credential-injection": "SSRF + Credential Auto-Injection -> Authenticated SSRF", "chain-unauth-ssrf-rce": "Missing Auth -> SSRF -> Internal RCE",
}
ALIASES = {"MISSING_AUTH": ["MISSING_AUTH", "UNAUTHORIZED_ACTION", "AUTHORIZATION_BYPASS", "VERTICAL_PRIVILEGE_ESCALATION"], "WEAK_WHITELIST": ["WEAK_WHITELIST", "SSRF"]}


def attack_chains(findings: DataFrame, app_package: str = "", group: list[str] | None = None) -> DataFrame:
    """Chains for each rule with an amplifier and a target: best of each (highest confidence, then first), their counts, severity, confidence, title,
    a message, and the two steps as data_flow_path; as findings they are of the type ATTACK_CHAIN.

    group: columns that keep chains apart, such as the repository. A type listed twice through aliases counts twice, as in the reference.
    If app_package is given and neither side lies in it, both need confidence 0.85, the chain's falls to 0.7 of the rule's, and under 0.60 it goes.
    """
    group = group or []
    spark = findings.sparkSession
    rows = [(i, rid, side, alias, t == "WEAK_WHITELIST" and alias == "SSRF", sev, conf) for i, (rid, am, ta, sev, conf) in enumerate(CHAIN_RULES) for side, types in (("amplifier", am), ("target", ta)) for t in types for alias in ALIASES.get(t, [t])]
    rules = spark.createDataFrame(rows, "rule_ord int, chain_id string, side string, type string, weak boolean, chain_severity string, base double")
    f = findings.withColumn("type", F.upper("vuln_type"))
    j = f.join(F.broadcast(rules), "type").where(~F.col("weak") | F.lower("rule_id").rlike("weak|whitelist|contains"))
    row = F.struct("rule_id", "file_path", "start_line", "confidence", "type")
    sides = j.groupBy(*group, "rule_ord", "chain_id", "chain_severity", "base").agg(
        *[x for s in ("amplifier", "target") for x in (F.max_by(F.when(F.col("side") == s, row), F.when(F.col("side") == s, F.struct(F.col("confidence"), (-F.col("ord")).alias("o")))).alias(s), F.count_if(F.col("side") == s).alias(f"{s}_count"))]
    )
    pack = app_package.replace(".", "/")
    inside = lambda s: F.lit(True) if not pack else F.regexp_replace(f"{s}.file_path", r"\\", "/").contains(pack)
    review = F.lit(bool(pack)) & ~inside("amplifier") & ~inside("target")
    c = sides.where("amplifier_count > 0 and target_count > 0").withColumn("review", review)
    c = c.where(~F.col("review") | (F.col("amplifier.confidence") >= 0.85) & (F.col("target.confidence") >= 0.85))
    c = c.withColumn("confidence", F.when(F.col("review"), half_up(F.col("base") * 0.7, 2)).otherwise(F.col("base"))).where("confidence >= 0.6")
    title = F.try_element_at(F.create_map(*[F.lit(x) for kv in CHAIN_TITLES.items() for x in kv]), F.col("chain_id"))
    message = F.concat(F.initcap(F.replace("amplifier.type", F.lit("_"), F.lit(" "))), F.lit(" may be combined with "), F.lower(F.replace("target.type", F.lit("_"), F.lit(" "))), F.lit("."), F.when(F.col("review"), " Reachability from application code requires review.").otherwise(""))
    step = lambda s: F.struct(F.lit(s).alias("step"), F.col(f"{s}.file_path").alias("file"), F.col(f"{s}.start_line").alias("line"), F.col(f"{s}.type").alias("type"), inside(s).alias("in_app_package"))
    c = c.withColumns({"title": title, "message": message, "data_flow_path": F.array(step("amplifier"), step("target"))})
    return c.select(*group, "rule_ord", F.col("chain_id"), "title", "message", F.lit("ATTACK_CHAIN").alias("vuln_type"), F.lit("chain-correlator").alias("discovered_by"), "data_flow_path", F.col("chain_severity").alias("severity"), "confidence", F.col("amplifier.file_path").alias("file_path"), F.col("amplifier.start_line").alias("start_line"), F.col("target.file_path").alias("target_file"), F.col("target.start_line").alias("target_line"), "amplifier_count", "target_count", F.col("review").alias("needs_review")).orderBy(*group, F.desc(_rank(F.col("chain_severity"), SEVERITIES)), F.desc("confidence"), "rule_ord").drop("rule_ord")


def summary(raw: DataFrame, deduped: DataFrame, chains: DataFrame) -> DataFrame:
    """One row of counts."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    j = one(raw, "total_raw").crossJoin(one(deduped, "after_dedup")).crossJoin(one(chains, "chain_findings"))  # three single rows
    return j.withColumn("final", F.col("after_dedup") + F.col("chain_findings"))


# ---------------------------------------------------------------- coverage and priority
def rate(part: Column, whole: Column) -> Column:
    """A4: share to 4 places, half up; 1.0 of nothing."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(half_up(part / whole, 4))


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """A1: (name, n), one row for each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


CONFIDENCES = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def by_priority(paths: DataFrame, conf: str = "static_confidence", depth: str = "call_depth", tie: str = "path_id") -> DataFrame:
    """Confidence rank, then depth, then the stable order."""
    return paths.orderBy(F.desc(_rank(F.upper(F.trim(conf)), CONFIDENCES)), depth, tie)


def authorization_surface(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Every entry with its reachable sink categories (sorted), number of paths and least depth (-1 without a path). Paths are combined before the join; categories are a small fixed set."""
    p = paths.groupBy("entry_id").agg(F.sort_array(F.collect_set("category")).alias("categories"), F.count("*").alias("paths"), F.min("call_depth").alias("depth"))
    j = entries.join(p, "entry_id", "left")
    return j.select(*entries.columns, F.coalesce("categories", F.expr("cast(array() as array<string>)")).alias("categories"), F.coalesce("paths", F.lit(0)).cast("long").alias("paths"), F.coalesce("depth", F.lit(-1)).cast("int").alias("min_depth"))


def stored_flows(writes: DataFrame, reads: DataFrame, most: int = 500) -> DataFrame:
    """Reads met by writes of the same storage key (without regard to case): of each project the first `most` distinct (write entry, read, sink), in order of reads, then writes.

    writes(write_ord, write_entry, storage_key, value_type); reads(read_ord, read_id, sink_id, storage_key, value_type); both may have `project`, else they are one. The bound is the
    feature: no pair beyond it can count, so of each key at most `most` writes and of all reads of a project that have a writer the first `most` (read, sink) are joined.
    """
    of = lambda df: df if "project" in df.columns else df.withColumn("project", F.lit(""))
    key = F.struct("project", F.lower("storage_key").alias("key")).alias("key")
    first = lambda df, part, *order: df.withColumn("_n", F.row_number().over(Window.partitionBy(part).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    w = of(writes).where("storage_key is not null").select(key, "write_ord", "write_entry", F.col("value_type").alias("write_type"))
    w = w.groupBy("key", "write_entry").agg(F.min(F.struct("write_ord", "write_type")).alias("w"))
    w = first(w, "key", "w.write_ord", "write_entry").select("key", "write_entry", "w.*")
    r = of(reads).where("storage_key is not null").select(key, "storage_key", "read_ord", "read_id", "sink_id", F.col("value_type").alias("read_type"))
    r = r.groupBy("key", "read_id", "sink_id").agg(F.min(F.struct("read_ord", "storage_key", "read_type")).alias("r")).select("key", "read_id", "sink_id", "r.*")
    r = first(skew_join(r, w.select("key").distinct(), "key", "left_semi"), F.col("key.project"), "read_ord", "read_id", "sink_id")
    p = r.join(w, "key").groupBy(F.col("key.project").alias("project"), "write_entry", "read_id", "sink_id").agg(F.min(F.struct("read_ord", "write_ord", "storage_key", "write_type", "read_type")).alias("p"))
    same = (F.col("p.write_type") != "") & (F.lower("p.write_type") == F.lower("p.read_type"))
    out = first(p, "project", "p.read_ord", "read_id", "sink_id", "p.write_ord", "write_entry")
    keep = ["project"] if "project" in reads.columns else []
    return out.select(*keep, "write_entry", "read_id", "sink_id", F.col("p.storage_key").alias("storage_key"), F.when(same, "HIGH").otherwise("MEDIUM").alias("correlation"), F.lit("STORAGE_CONTROLLED").alias("source_classification"))


# ---------------------------------------------------------------- batches and chunks
def batch_plan(batches: DataFrame, size: int = 80) -> DataFrame:
    """(batch_id, plan, chunks, items_from, items_to): candidate then stored chunks of a job in fixed windows of `size` (20 to 500), with the
    share of its `items` that falls on each window (cumulative whole-number proportion)."""
    size = min(500, max(20, size))
    n = F.coalesce(F.size("candidate_chunks"), F.lit(0)) + F.coalesce(F.size("stored_chunks"), F.lit(0))
    b = batches.select("batch_id", "items", F.greatest(n, F.lit(0)).alias("n")).where("n > 0")
    b = b.withColumn("plan", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {size} as int)"))))
    lo, hi = F.col("plan") * size, F.least(F.col("n"), (F.col("plan") + 1) * size)
    return b.select("batch_id", "plan", (hi - lo).cast("int").alias("chunks"), F.expr(f"items * (plan * {size}) div n").alias("items_from"), F.expr(f"items * least(n, (plan + 1) * {size}) div n").alias("items_to"))


#: Items after which a chunk always ends, so that a group of any length is packed by many tasks.
SPAN = 100_000


def chunk_plan(items: DataFrame, group: str, order: str, size: str, most_items: int = 50, most_bytes: int = 65_536, groups: DataFrame | None = None, envelope: bool = False) -> DataFrame:
    """(group, chunk, start_index, end_index, bytes) by greedy filling in order: at most `most_items` and `most_bytes` a chunk; a larger item is alone.

    envelope: bytes are those of the JSON object that holds a chunk ({"start_index", "end_index", "items"}, pretty-printed), not of its items alone. Groups of groups(group) that have no item get one
    empty chunk with end_index -1. Only ordinals and sizes are shuffled, never payloads. A group is cut into spans of SPAN ordinals that start chunks of their own (groups of
    up to SPAN items come out exactly as one sequential pass gives them). NULL sizes count 0; an empty frame gives an empty frame.
    """
    frame = len('{\n  "start_index" : ,\n  "end_index" : ,\n  "items" : [  ]\n}') if envelope else 0

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, start, n, total = [], None, 0, 0
        whole = lambda a, b, t, k: t + (frame + len(f"{a}{b}") + 2 * (k - 1) if frame else 0)
        for o, s in sorted(zip(pdf["o"], pdf["s"])):
            if n and (n >= most_items or whole(start, o, total + s, n + 1) > most_bytes):
                out.append((start, last, whole(start, last, total, n)))
                n, total = 0, 0
            if not n:
                start = o
            n, total, last = n + 1, total + int(s), o
        if n:
            out.append((start, last, whole(start, last, total, n)))
        return pd.DataFrame({"g": key[0], "span": key[1], "chunk": range(len(out)), "start_index": [x[0] for x in out], "end_index": [x[1] for x in out], "bytes": [x[2] for x in out]})

    kind = items.schema[group].dataType.simpleString()
    slim = items.select(F.col(group).alias("g"), F.expr(f"cast({order} div {SPAN} as bigint)").alias("span"), F.col(order).cast("long").alias("o"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("s"))
    c = slim.groupBy("g", "span").applyInPandas(fold, f"g {kind}, span bigint, chunk bigint, start_index bigint, end_index bigint, bytes bigint")
    if groups is not None:
        none = groups.select(F.col(group).alias("g")).distinct().join(slim.select("g").distinct(), "g", "left_anti")
        at = lambda n: F.lit(n).cast("long")
        c = c.unionByName(none.select("g", at(0).alias("span"), at(0).alias("chunk"), at(0).alias("start_index"), at(-1).alias("end_index"), at(frame and frame + 2).alias("bytes")))
    return c.select(F.col("g").alias(group), (F.col("span") * SPAN + F.col("chunk")).alias("chunk"), "start_index", "end_index", "bytes")


def retained(rows: DataFrame, key: str, order: str, most: int = 2000) -> DataFrame:
    """The last `most` rows of each key (the feature's bound); the rank limit is applied before the shuffle too."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= most).drop("_n")


def retained_jobs(jobs: DataFrame, most: int = 200) -> DataFrame:
    """jobs(job_id, created_at, status) newest first; if there are more than `most`, the oldest finished ones (DONE, FAILED) beyond that number are left out. Unfinished jobs always stay."""
    over = jobs.count() - most
    if over > 0:
        old = jobs.where(F.col("status").isin("DONE", "FAILED")).orderBy("created_at", "job_id").limit(over)
        jobs = jobs.join(old.select("job_id"), "job_id", "left_anti")
    return jobs.orderBy(F.desc("created_at"), "job_id")


# ---------------------------------------------------------------- sinks and restore
def write_facts(tables: dict[str, DataFrame], folder: str, capped: dict[str, int] | None = None) -> DataFrame:
    """Each table as JSON under folder/name; capped tables write at most that many rows, the first in order of their columns. Returns (name, total, written, truncated), also written."""
    capped = {"unresolved_calls": 5000} | (capped or {})
    rows = []
    for name, df in tables.items():
        total = df.count()
        (df.orderBy(*[c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]).limit(capped[name]) if name in capped else df).write.mode("overwrite").json(f"{folder}/{name}")
        rows.append((name, total, min(total, capped.get(name, total)), total > capped.get(name, total)))
    spark = next(iter(tables.values())).sparkSession
    info = spark.createDataFrame(rows, "name string, total bigint, written bigint, truncated boolean")
    info.coalesce(1).write.mode("overwrite").json(f"{folder}/index")
    return info


META = "job_id string, language string, status string, created_at string, message string"


def write_job(findings: DataFrame, meta: DataFrame, folder: str) -> None:
    """The findings and the meta data (META) of finished jobs, by job."""
    findings.write.mode("overwrite").partitionBy("job_id").json(f"{folder}/findings")
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def restore_jobs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The jobs written before with their meta data, `created` as a timestamp, and the number of their findings; a folder without any comes back as no rows."""
    from ..functions.text import instant

    n = restore(spark, folder, schema).groupBy("job_id").agg(F.count("*").alias("findings"))
    jobs = restore(spark, folder, META, "meta").withColumn("created", instant("created_at"))
    return jobs.join(n, "job_id", "left").fillna(0, ["findings"])


def restore(spark: SparkSession, folder: str, schema: str, name: str = "findings") -> DataFrame:
    """Findings written before; a job folder without any comes back as no rows."""
    try:
        return spark.read.schema(schema).json(f"{folder}/{name}")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
