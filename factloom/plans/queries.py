"""Queries of the core over the given tables: (spark, folder) -> DataFrame, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import scratch_root, skew_join
from ..common import table as t
from ..common import trimmed
from ..functions import text as tx
from ..operators import classify, graph, report, resolve, taint
from ..operators import hierarchy as hi
from ..sources import discover as disc
from ..sources import java_facts as jf
from ..sources import scanners
from ..streaming import events as ev
from . import pipeline

# ---------------------------------------------------------------- relations that several queries read
_CALL = r"^(?:([\w$.]+)\.)?([\w$]+)\((.*)\)$"
#: The file in a method id.
_AT = r"@(.*):\d+:\d+$"
#: Strings and characters of Java.
_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\])'"


def files(s: SparkSession, d: str) -> DataFrame:
    return jf.latest_files(t(s, d, "source_files"))


def methods(s: SparkSession, d: str) -> DataFrame:
    """One row an id: the one indexed last, smallest sequence number first."""
    m = t(s, d, "methods").where("id is not null")
    best = F.max_by(F.struct("method_seq", "class_name", "method_name", "parameter_count", "parameter_names", "file_path", "start_line", "signature"), F.struct("indexed_at", (-F.col("method_seq")).alias("n"))).alias("r")
    return m.groupBy("id").agg(best).select("id", "r.*")


def sinks(s: SparkSession, d: str) -> DataFrame:
    """One row an id, with the category in its plain form."""
    k = t(s, d, "sinks").groupBy("id").agg(F.min("sink_ord").alias("sink_ord"), *[F.max(c).alias(c) for c in ("category", "api", "method_id", "file_path", "line", "code")])
    return k.withColumn("category", F.upper(trimmed("category")))


def edges(s: SparkSession, d: str) -> DataFrame:
    """Distinct edges with trimmed ends; the latest record of a call counts."""
    e = t(s, d, "call_edges").select(trimmed("from_id").alias("from_id"), "edge_ord", trimmed("to_id").alias("to_id"), "line", "expression", "resolution")
    return e.where("from_id <> '' and to_id <> '' and edge_ord is not null").groupBy("from_id", "edge_ord", "to_id").agg(F.min(F.struct("line", "expression", "resolution")).alias("r")).select("from_id", "edge_ord", "to_id", "r.*")


def calls(s: SparkSession, d: str) -> DataFrame:
    """Call sites as call_edges tells them: receiver, method and arguments of the expression; receivers and arguments that the caller declares as variables have their types."""
    e = edges(s, d).where(F.col("expression").rlike(_CALL))
    part = lambda i: F.regexp_extract("expression", _CALL, i)
    arguments = F.when(F.trim(part(3)) == "", F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.split(part(3), ","), F.trim))
    known = t(s, d, "methods").where("id is not null").groupBy("id").agg(F.max_by("variable_types", F.struct("indexed_at", (-F.col("method_seq")).alias("n"))).alias("types"))
    e = skew_join(e, known.select(F.col("id").alias("from_id"), "types"), "from_id", "left")
    type_of = lambda v: F.coalesce(F.try_element_at("types", v), F.lit(""))
    return e.select(
        F.col("from_id").alias("method_id"), F.regexp_extract("to_id", "^([^#]*)#", 1).alias("callee_class"), F.regexp_extract("from_id", "^([^#]*)#", 1).alias("class_name"), F.regexp_extract("from_id", _AT, 1).alias("file_path"), F.col("edge_ord").cast("int").alias("call_ord"), part(2).alias("method_name"),
        part(1).alias("receiver"), type_of(part(1)).alias("receiver_type"), F.size(arguments).alias("argument_count"), F.transform(arguments, type_of).alias("argument_types"), arguments.alias("argument_expressions"), "line", "expression",
    )


def paths(s: SparkSession, d: str) -> DataFrame:
    """The counting row of each candidate path with its sink."""
    p = t(s, d, "candidate_paths").where("path_id is not null")
    p = p.groupBy("path_id").agg(F.max(F.struct("recorded_at", "entry_id", "sink_id", "static_confidence", "call_depth", "review_status", "taint_confidence")).alias("r")).select("path_id", "r.*")
    k = sinks(s, d).select(F.col("id").alias("sink_id"), "category", "file_path", "line")
    return p.join(k, "sink_id")


#: Kinds of vulnerability by sink category.
KIND = {"COMMAND_EXECUTION": "COMMAND_INJECTION", "NATIVE_DESERIALIZATION": "DESERIALIZATION", "OUTBOUND_HTTP": "SSRF", "XML_PARSE": "XXE", "FILTER_ENTRY": "MISSING_AUTH", "SERVLET_ENTRY": "MISSING_AUTH", "SCRIPT_OR_EXPRESSION_EXECUTION": "SSTI"}


def findings(s: SparkSession, d: str) -> DataFrame:
    """Candidate paths as findings: one a path, at its sink."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv]), F.col("category"))
    return paths(s, d).where("category <> ''").select(
        F.col("path_id").alias("ord"), F.col("category").alias("rule_id"), tx.unix_path("file_path").alias("file_path"), F.col("line").alias("start_line"), report.verdict("taint_confidence").alias("verdict"), tx.confidence("static_confidence").alias("confidence"),
        F.when(F.col("call_depth") <= 1, "CRITICAL").when(F.col("call_depth") <= 4, "HIGH").otherwise("MEDIUM").alias("severity"), F.coalesce("review_status", F.lit("")).alias("discovered_by"), F.coalesce(kind, F.col("category")).alias("vuln_type"),
    )


def sessions(s: SparkSession, d: str) -> DataFrame:
    """The events table as agent events of one session a user."""
    e = t(s, d, "events")
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "result").when(F.col("event_type") == "error", "error").otherwise("text")
    k = F.get_json_object("props", "$.k")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("type"), k.alias("task_id"), F.concat(F.lit("agent-"), k).alias("agent"), F.when(F.col("value") > 20, "completed").otherwise("stopped").alias("status"), F.col("props").alias("summary"), F.format_string("%.2f", "value").alias("result"))


def storage(s: SparkSession, d: str) -> DataFrame:
    """Reads and writes of stores, with the class of the callee as the receiver's type."""
    kind, key = classify.storage_sql("method_name", "receiver", "callee_class")
    return calls(s, d).withColumn("kind", F.expr(kind)).withColumn("storage_key", F.expr(key)).where("kind is not null")


def starts(s: SparkSession, d: str) -> DataFrame:
    """Entry methods: callers that nobody calls."""
    e = edges(s, d)
    return e.select(F.col("from_id").alias("method_id")).distinct().join(e.select(F.col("to_id").alias("method_id")), "method_id", "left_anti").withColumn("entry_id", F.col("method_id"))


def parsed(s: SparkSession, d: str) -> DataFrame:
    return jf.parse_files(files(s, d))


def _goal_sinks(s, d):
    return sinks(s, d).where("method_id <> '' and category <> ''")


def q_paths(s, d):
    return graph.candidate_paths(starts(s, d), edges(s, d), _goal_sinks(s, d))


def q_write_paths(s, d):
    a = storage(s, d).where("kind = 'WRITE'").select(F.concat_ws("|", "method_id", F.format_string("%05d", "call_ord")).alias("access_id"), F.struct("method_id", "call_ord").alias("access_ord"), "method_id").distinct()
    return graph.write_paths(starts(s, d).withColumn("entry_ord", F.col("entry_id")), edges(s, d), a, most=None).select("entry_id", "access_id", "call_depth", "correlation", "path")


def q_derived(s, d):
    f = edges(s, d).where(F.col("expression").rlike(r"\(.*[^\s()].*\)"))
    return graph.derived_sinks(methods(s, d), f, _goal_sinks(s, d))


def _resolved(s, d):
    """Call resolution with all rules: types of variables, parents that files declare, method references in signatures; names meet within a repository."""
    m = methods(s, d).withColumn("file_path", F.regexp_extract("id", _AT, 1))
    refs = m.select("class_name", "file_path", F.explode(F.regexp_extract_all("signature", F.lit(r"::\s*([A-Za-z_]\w*)"), 1)).alias("name"))
    return resolve.resolve_calls(calls(s, d), m, scanners.declared_parents(files(s, d)), refs, tx.project_of)


def q_resolve(s, d):
    return _resolved(s, d)[0].select("from_id", "call_ord", "to_id", "resolution")


def q_unresolved(s, d):
    return _resolved(s, d)[1]


def _matching(s, d):
    """The Java files that still hold the text of every method that the given index has of them (the index keeps 400 characters of each), with as many braces that open as close."""
    m = methods(s, d).select(tx.unix_path("file_path").alias("path"), "signature").where(F.col("path").endswith(".java") & F.col("signature").isNotNull())
    f = files(s, d).withColumn("flat", F.regexp_replace("content", r"\s+", " "))
    held = m.join(f, "path").groupBy("path").agg(F.bool_and(F.contains("flat", F.col("signature"))).alias("all")).where("all")
    code = F.regexp_replace("content", _STRINGS, "")
    even = F.length(F.replace(code, F.lit("{"), F.lit(""))) == F.length(F.replace(code, F.lit("}"), F.lit("")))
    return files(s, d).where(even).join(held.select("path"), "path", "left_semi")


def q_indexed(s, d):
    return jf.methods(jf.parse_files(_matching(s, d))).select("class_name", "method_name", "parameter_count", "parameter_names", "file_path", "start_line", "end_line", "signature")


def q_indexed_entries(s, d):
    return disc.discover(jf.parse_files(_matching(s, d))).select("protocol", F.array_join("operations", ",").alias("operations"), "route", "class_name", "method_name", "file_path", "framework", "discovery_source", "confidence")


def q_implementations(s, d):
    pairs = jf.implementations(parsed(s, d)).select(F.struct(tx.project_of("file_path").alias("pj"), F.col("parent").alias("cls")).alias("parent"), F.struct(tx.project_of("file_path").alias("pj"), F.col("child").alias("cls")).alias("child"))
    return resolve.closure(pairs).select(F.col("parent.pj").alias("project"), F.col("parent.cls").alias("parent"), F.col("child.cls").alias("child"))


def q_restored(s, d):
    """The findings as they come back from JSON."""
    f = findings(s, d)
    folder = f"{scratch_root(s)}/factloom-facts-{uuid.uuid4().hex}"
    report.write_facts({"findings": f.select("ord", "rule_id", "file_path", "start_line", "verdict", "confidence", "severity")}, folder)
    return report.restore(s, folder, "ord bigint, rule_id string, file_path string, start_line int, verdict string, confidence double, severity string")


def q_mapper_sinks(s, d):
    """J5 over the call edges, the class of the callee as the receiver's type."""
    c = calls(s, d).withColumn("receiver_type", F.col("callee_class"))
    return resolve.mapper_sinks(c, scanners.mapper_statements(files(s, d).where(F.col("path").endswith(".xml"))), tx.project_of).select("method_id", "file_path", "line", "api", "code").distinct()


def q_bind(s, d):
    e = t(s, d, "sinks").select("id", "file_path", F.regexp_extract("method_id", r"#([^/]*)/", 1).alias("method_name"), F.col("line").alias("start_line")).distinct().where("method_name <> ''")
    return resolve.bind_nearest(e, methods(s, d)).select("id", "file_path", "start_line", "method_id", "binding_status")


def q_stored(s, d):
    """J7, with the bound of 500 in each repository."""
    a = storage(s, d).withColumn("project", tx.project_of("file_path"))
    at = F.concat_ws("|", "method_id", F.format_string("%05d", "call_ord"))
    w = a.where("kind = 'WRITE'").select("project", at.alias("write_ord"), F.col("method_id").alias("write_entry"), "storage_key", F.lit("").alias("value_type"))
    r = skew_join(a.where("kind = 'READ'"), _goal_sinks(s, d).select("method_id", F.col("id").alias("sink_id")), "method_id")
    r = r.select("project", F.concat_ws("|", at, "sink_id").alias("read_ord"), at.alias("read_id"), "sink_id", "storage_key", F.lit("").alias("value_type"))
    return report.stored_flows(w, r).select("project", "write_entry", "read_id", "sink_id", "correlation")


def q_surface(s, d):
    e = paths(s, d).where(trimmed("entry_id") != "").select("entry_id").distinct()
    p = paths(s, d).where("category <> '' and call_depth >= 0")
    return report.authorization_surface(e, p)


def q_coverage(s, d):
    p = paths(s, d)
    one = p.agg(F.count("*").alias("paths"), F.countDistinct("entry_id").alias("entries_with_paths"), F.count_if(F.col("taint_confidence") == "CONFIRMED").alias("confirmed"))
    return one.select("paths", "entries_with_paths", "confirmed", report.rate(F.col("confirmed"), F.col("paths")).alias("confirmed_rate"))


def q_batches(s, d):
    b = t(s, d, "chunk_batches").dropDuplicates(["batch_id"])
    n = t(s, d, "chunk_items").select("item_id", "chunk_name").distinct().groupBy("chunk_name").agg(F.count("*").alias("k"))
    names = b.select("batch_id", F.explode(F.concat(F.coalesce("candidate_chunks", F.expr("array()")), F.coalesce("stored_chunks", F.expr("array()")))).alias("chunk_name"))
    items = names.join(n, "chunk_name").groupBy("batch_id").agg(F.sum("k").alias("items"))
    return report.batch_plan(b.join(items, "batch_id", "left").withColumn("items", F.coalesce("items", F.lit(0)).cast("long")), 20)


def q_chunks(s, d):
    i = t(s, d, "chunk_items").select("item_id", "chunk_name", "item_ord", F.octet_length("payload").alias("size")).distinct()
    return report.chunk_plan(i, "chunk_name", "item_ord", "size")


def q_ids(s, d):
    k = sinks(s, d).where("method_id <> ''")
    name = F.regexp_extract("method_id", r"^([^#]*)#([^/]*)/", 1), F.regexp_extract("method_id", r"^([^#]*)#([^/]*)/", 2)
    k = k.select("id", "category", F.array("api").alias("ops"), "code", name[0].alias("cls"), name[1].alias("m"), "file_path")
    return k.select("id", tx.entry_id("category", "ops", "code", "cls", "m", "file_path").alias("entry_id"), tx.java_hash("code").alias("code_hash"), tx.cache_key("file_path").alias("cache_key"))


def q_summaries(s, d):
    p = parsed(s, d)
    return taint.summaries(jf.methods(p), jf.calls(p))


def q_taint_sinks(s, d):
    p = parsed(s, d)
    c, m = jf.calls(p), jf.methods(p)
    k = pipeline.number_sinks(classify.classify_calls(c).withColumn("code", F.col("expression")))
    return taint.local_taint_sinks(m, c, k)


def q_analysis(s, d):
    return pipeline.analyze(files(s, d), project=tx.project_of).candidates.select("entry_id", "sink_id", "path", "call_depth", "static_confidence", "taint_confidence", "source_classification")


def _chain_columns(chains):
    step = lambda i: F.concat_ws(":", *[F.col("data_flow_path")[i][x].cast("string") for x in ("step", "file", "line", "type", "in_app_package")])
    return chains.withColumns({"first_step": step(0), "last_step": step(1)}).drop("message", "data_flow_path")


QUERIES = {
    "p4_found": lambda s, d: hi.cycles(t(s, d, "call_edges")),
    "p4_tree": lambda s, d: hi.hierarchy(t(s, d, "call_edges"), nodes=t(s, d, "methods").select("id")).fillna(-1, ["depth"]),
    "p4_descendants": lambda s, d: hi.descendants(hi.hierarchy(t(s, d, "call_edges"), nodes=t(s, d, "methods").select("id"))),
    "other_parents": lambda s, d: hi.other_parents(t(s, d, "call_edges")),
    # scans
    "java_methods": lambda s, d: jf.methods(parsed(s, d)).select("id", "class_name", "method_name", "parameter_count", "file_path", "start_line", "end_line", "signature"),
    "java_calls": lambda s, d: jf.calls(parsed(s, d)).select("method_id", "call_ord", "method_name", "receiver", "receiver_type", "argument_count", "line"),
    "java_implementations": q_implementations,
    "indexed_methods": q_indexed,
    "indexed_entries": q_indexed_entries,
    "java_diagnostics": lambda s, d: jf.diagnostics(parsed(s, d), most=None),
    "entry_points": lambda s, d: disc.discover(parsed(s, d)),
    "interface_inventory": lambda s, d: disc.inventory(disc.discover(parsed(s, d))),
    "yaml_templates": lambda s, d: scanners.yaml_templates(files(s, d)),
    "properties_templates": lambda s, d: scanners.properties_templates(files(s, d)),
    "xml_templates": lambda s, d: scanners.xml_templates(files(s, d).where(F.col("path").endswith(".xml"))),
    "mapper_statements": lambda s, d: scanners.mapper_statements(files(s, d).where(F.col("path").endswith(".xml"))).drop("ord"),
    "mapper_sinks": q_mapper_sinks,
    "declared_parents": lambda s, d: scanners.declared_parents(files(s, d)),
    "source_lines": lambda s, d: scanners.lines(files(s, d)).groupBy("path").agg(F.count("*").alias("lines"), F.count_if(scanners.strip("line") == "").alias("blank")),
    "structural_sinks": lambda s, d: classify.structural_sinks(jf.methods(p := parsed(s, d)), jf.classes(p)),
    "entries_by_discoverer": lambda s, d: disc.discover(parsed(s, d)).groupBy("discovery_source", "protocol", classify.protocol_side("protocol").alias("side")).agg(F.count("*").alias("n")),
    "source_hints": lambda s, d: scanners.source_hints(files(s, d)),
    "tech_profile": lambda s, d: scanners.tech_profile(files(s, d)),
    # classification
    "sink_rules": lambda s, d: sinks(s, d).select("id", F.expr(classify.sink_case("regexp_replace(api, '^.*[.]', '')", "api", "''")).alias("found")),
    "storage_accesses": lambda s, d: storage(s, d).select("method_id", "call_ord", "kind", "storage_key").distinct(),
    "hunter_sinks": lambda s, d: classify.for_hunters(sinks(s, d)).groupBy("hunter", "category").agg(F.count("*").alias("n")),
    "local_taint_sinks": q_taint_sinks,
    "suspicious_calls": lambda s, d: classify.suspicious_calls(jf.calls(p := parsed(s, d)), pipeline.number_sinks(classify.classify_calls(jf.calls(p)).withColumn("code", F.col("expression"))), jf.classes(p), most=None, project=tx.project_of),
    # joins and graph
    "resolved_calls": q_resolve,
    "unresolved_calls": q_unresolved,
    "nearest_binding": q_bind,
    "stored_flows": q_stored,
    "authorization_surface": q_surface,
    "missing_sinks": lambda s, d: disc.missing_ids(t(s, d, "candidate_paths").where("sink_id is not null").select(F.col("sink_id").alias("id")), t(s, d, "sinks")),
    "reverse_reach": lambda s, d: graph.reverse_reach(edges(s, d), _goal_sinks(s, d).select("method_id"), 20),
    "candidate_search": q_paths,
    "write_paths": q_write_paths,
    "derived_sinks": q_derived,
    "distinct_sinks": lambda s, d: graph.dedup_sinks(t(s, d, "sinks")).select("sink_ord", "id", "category", "method_id", "file_path", "line"),
    "taint_summaries": q_summaries,
    "analysis": q_analysis,
    # reports
    "coverage": q_coverage,
    "coverage_tables": lambda s, d: report.coverage({n: t(s, d, n) for n in ("source_files", "methods", "sinks", "call_edges", "candidate_paths", "parse_errors")}),
    "sinks_by_category": lambda s, d: sinks(s, d).groupBy("category").agg(F.count("*").alias("n")),
    "paths_by_category": lambda s, d: paths(s, d).groupBy("category").agg(F.count("*").alias("n")),
    "worst_findings": lambda s, d: report.by_severity(findings(s, d)).limit(100).select("ord", "severity", "confidence"),
    "first_candidates": lambda s, d: report.by_priority(paths(s, d).where("call_depth >= 0")).limit(100).select("path_id", "static_confidence", "call_depth"),
    "restored_findings": q_restored,
    "best_findings": lambda s, d: report.dedup_findings(findings(s, d)).select("ord", "rule_id", "file_path", "start_line", "verdict", "confidence"),
    "finding_stats": lambda s, d: report.finding_stats(findings(s, d)),
    "attack_chains": lambda s, d: _chain_columns(report.attack_chains(findings(s, d).withColumn("repo", F.substring_index("file_path", "/", 1)), group=["repo"])),
    "attack_chains_app": lambda s, d: _chain_columns(report.attack_chains(findings(s, d).withColumn("repo", F.substring_index("file_path", "/", 1)), "io.brightmoor", group=["repo"])),
    "findings_summary": lambda s, d: report.summary(f := findings(s, d), report.dedup_findings(f), report.attack_chains(f)),
    "candidate_priority": lambda s, d: report.by_priority(paths(s, d)).select("path_id", "static_confidence", F.coalesce("call_depth", F.lit(-1)).alias("call_depth")),
    "batch_plan": q_batches,
    "chunk_plan": q_chunks,
    "entry_ids": q_ids,
    # streams, over finished logs
    "last_results": lambda s, d: ev.last_results(sessions(s, d)),
    "log_levels": lambda s, d: t(s, d, "documents").groupBy(ev.log_level(ev.log_line("text")).alias("level")).agg(F.count("*").alias("n")),
    "text_sizes": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", tx.byte_size(F.octet_length("text")).alias("size"), tx.preview("text", 80).alias("shown"), tx.instant_text("created_at").alias("created"), (tx.instant(tx.instant_text("created_at")) == F.col("created_at").cast("timestamp")).alias("same")),
    "agent_progress": lambda s, d: ev.progress_batch(sessions(s, d)),
    "retained_events": lambda s, d: report.retained(t(s, d, "events"), "user_id", "event_id").select("user_id", "event_id"),
}

# ---------------------------------------------------------------- SQL
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_F, _T, _I = (_TRIM.format(x) for x in ("from_id", "to_id", "id"))
_LINKS = f"WITH RECURSIVE l AS (SELECT {_T} AS child, min({_F}) AS parent FROM call_edges WHERE {_F} <> '' AND {_T} <> '' GROUP BY 1),\n"
_TREE = (
    _LINKS
    + f"""n AS (SELECT child AS id FROM l UNION SELECT parent FROM l UNION SELECT {_I} FROM methods WHERE {_I} <> ''),
w AS (SELECT id, id AS root, 0 AS depth, [id] AS path FROM n WHERE id NOT IN (SELECT child FROM l)
      UNION ALL SELECT l.child, w.root, w.depth + 1, list_append(w.path, l.child) FROM w JOIN l ON l.parent = w.id)
"""
)
_FILES = "f AS (SELECT path, content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY committed_at DESC, file_id DESC) AS rn FROM source_files WHERE path IS NOT NULL) WHERE rn = 1 AND content IS NOT NULL)"
_METHODS = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, method_seq) AS rn FROM methods WHERE id IS NOT NULL) WHERE rn = 1)"
_SINKS = f"k AS (SELECT id, min(sink_ord) AS sink_ord, upper({_TRIM.format('max(category)')}) AS category, max(api) AS api, max(method_id) AS method_id, max(file_path) AS file_path, max(line) AS line, max(code) AS code FROM sinks GROUP BY id)"
_EDGES = f"""e AS (SELECT f AS from_id, edge_ord, t AS to_id, r.line AS line, r.expression AS expression, r.resolution AS resolution FROM (SELECT {_F} AS f, edge_ord, {_T} AS t,
    min(struct_pack(line := line, expression := expression, resolution := resolution)) AS r FROM call_edges WHERE {_F} <> '' AND {_T} <> '' AND edge_ord IS NOT NULL GROUP BY 1, 2, 3))"""
_VARS = "vt AS (SELECT id, arg_max(coalesce(variable_types, MAP {}), struct_pack(a := indexed_at, b := -method_seq)) AS types FROM methods WHERE id IS NOT NULL GROUP BY 1)"
_PART = "regexp_extract(expression, '" + _CALL + "', {})"
_CALLS = (
    _EDGES
    + f""", {_VARS}, c AS (SELECT *, split_part(regexp_replace(replace(file_path, '\\', '/'), '^(\\./|/)+', ''), '/', 1) AS pj, coalesce(types[receiver], '') AS receiver_type, list_transform(args, lambda x: coalesce(types[x], '')) AS argument_types FROM (
    SELECT from_id AS method_id, regexp_extract(from_id, '^([^#]*)#', 1) AS class_name, regexp_extract(from_id, '{_AT}', 1) AS file_path, edge_ord AS call_ord, {_PART.format(2)} AS method_name, {_PART.format(1)} AS receiver, regexp_extract(to_id, '^([^#]*)#', 1) AS callee_class, line, expression,
    CASE WHEN trim({_PART.format(3)}) = '' THEN [] ELSE list_transform(string_split({_PART.format(3)}, ','), lambda x: trim(x)) END AS args, len(args) AS n, vt.types FROM e LEFT JOIN vt ON vt.id = from_id WHERE regexp_matches(expression, '{_CALL}')))"""
)
_DUCK = lambda sql: sql.replace("regexp_like(", "regexp_matches(")
_SKIND, _SKEY = map(_DUCK, classify.storage_sql("method_name", "receiver", "callee_class"))
_STORE = _CALLS + f", a AS (SELECT *, {_SKIND} AS kind, {_SKEY} AS storage_key FROM c), st AS (SELECT *, method_id || '|' || printf('%05d', call_ord) AS access_id FROM a WHERE kind IS NOT NULL)"
_GOALS = _SINKS + ", g AS (SELECT method_id, id, category, sink_ord FROM k WHERE method_id <> '' AND category <> '')"
_UNIX = r"regexp_replace(replace({}, '\', '/'), '^(\./|/)+', '')"
_PATHS = f"""{_SINKS}, p AS (SELECT r.path_id, r.entry_id, r.sink_id, r.static_confidence, r.call_depth, r.review_status, r.taint_confidence, k.category, k.file_path, k.line FROM (SELECT *, row_number() OVER (PARTITION BY path_id
    ORDER BY recorded_at DESC, entry_id DESC NULLS LAST, sink_id DESC NULLS LAST, static_confidence DESC NULLS LAST, call_depth DESC NULLS LAST, review_status DESC NULLS LAST, taint_confidence DESC NULLS LAST) AS rn FROM candidate_paths WHERE path_id IS NOT NULL) r JOIN k ON k.id = r.sink_id WHERE rn = 1)"""
_CONF = "CASE upper(trim(static_confidence)) WHEN 'HIGH' THEN 0.9 WHEN 'MEDIUM' THEN 0.7 WHEN 'LOW' THEN 0.5 ELSE coalesce(TRY_CAST(trim(static_confidence) AS DOUBLE), 0.0) END"
_VERDICT = "CASE v WHEN '' THEN 'CONFIRM' " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in report._SAME.items()) + " ELSE v END"
_FINDINGS = f"""{_PATHS}, fi AS (SELECT path_id AS ord, category AS rule_id, {_UNIX.format('file_path')} AS file_path, line AS start_line, {_VERDICT} AS verdict, CAST({_CONF} AS DOUBLE) AS confidence,
    CASE WHEN call_depth <= 1 THEN 'CRITICAL' WHEN call_depth <= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, coalesce(review_status, '') AS discovered_by,
    CASE category {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KIND.items())} ELSE category END AS vuln_type FROM (SELECT *, replace(upper(trim(coalesce(taint_confidence, ''))), '-', '_') AS v FROM p WHERE category <> ''))"""
_RANK = lambda c, r: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in r.items()) + " ELSE 0 END"
_BEST = f"b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, file_path, start_line ORDER BY {_RANK('verdict', report.VERDICTS)} DESC, confidence DESC, ord) AS rn FROM fi) WHERE rn = 1)"
_RULES = ", ".join(f"({i}, '{rid}', '{side}', '{alias}', {'true' if ty == 'WEAK_WHITELIST' and alias == 'SSRF' else 'false'}, '{sev}', {conf})" for i, (rid, am, ta, sev, conf) in enumerate(report.CHAIN_RULES) for side, types in (("amplifier", am), ("target", ta)) for ty in types for alias in report.ALIASES.get(ty, [ty]))


def _chains(group: str, pack: str = "") -> str:
    pick = lambda side, col: f"arg_max({col}, struct_pack(a := confidence, b := -ord)) FILTER (WHERE side = '{side}')"
    inside = lambda f: f"contains(replace({f}, '\\', '/'), '{pack}')" if pack else "true"
    step = lambda s, f, n, ty: f"concat_ws(':', '{s}', {f}, {n}, {ty}, {inside(f)})"
    titles = ", ".join(f"('{k}', '{v}')" for k, v in report.CHAIN_TITLES.items())
    return f"""ru(rule_ord, chain_id, side, type, weak, chain_severity, base) AS (VALUES {_RULES}), ti(cid, title) AS (VALUES {titles}),
ch AS (SELECT {group} AS repo, chain_id, chain_severity AS severity, CAST(base AS DOUBLE) AS base, {pick('amplifier', 'file_path')} AS file_path, {pick('amplifier', 'start_line')} AS start_line, {pick('target', 'file_path')} AS target_file, {pick('target', 'start_line')} AS target_line,
    {pick('amplifier', 'confidence')} AS ac, {pick('target', 'confidence')} AS tc, {pick('amplifier', 'ru.type')} AS aty, {pick('target', 'ru.type')} AS tty,
    count(*) FILTER (WHERE side = 'amplifier') AS amplifier_count, count(*) FILTER (WHERE side = 'target') AS target_count
    FROM fi JOIN ru ON upper(fi.vuln_type) = ru.type WHERE NOT weak OR regexp_matches(lower(rule_id), 'weak|whitelist|contains') GROUP BY {group}, rule_ord, chain_id, chain_severity, base),
cr AS (SELECT *, NOT {inside('file_path')} AND NOT {inside('target_file')} AS needs_review FROM ch WHERE amplifier_count > 0 AND target_count > 0),
cs AS (SELECT *, CASE WHEN needs_review THEN floor(base * 0.7 * 100 + 0.5) / 100 ELSE base END AS confidence FROM cr WHERE NOT needs_review OR ac >= 0.85 AND tc >= 0.85),
cc AS (SELECT repo, chain_id, severity, confidence, file_path, start_line, target_file, target_line, amplifier_count, target_count, needs_review, title, 'ATTACK_CHAIN' AS vuln_type, 'chain-correlator' AS discovered_by,
    {step('amplifier', 'file_path', 'start_line', 'aty')} AS first_step, {step('target', 'target_file', 'target_line', 'tty')} AS last_step FROM cs JOIN ti ON ti.cid = chain_id WHERE confidence >= 0.6)"""


_START = "s AS (SELECT DISTINCT from_id AS id FROM e WHERE from_id NOT IN (SELECT to_id FROM e))"
_L = "l AS (SELECT from_id, to_id, o.edge_ord AS edge_ord, o.resolution AS resolution FROM (SELECT from_id, to_id, min(struct_pack(edge_ord := edge_ord, resolution := resolution)) AS o FROM e GROUP BY 1, 2))"
_WALK = """w AS (SELECT id AS entry_id, id AS at, [id] AS path, CAST([] AS INT[]) AS ords, CAST([] AS VARCHAR[]) AS res, 0 AS depth FROM s
      UNION ALL SELECT w.entry_id, l.to_id, list_append(path, l.to_id), list_append(ords, l.edge_ord), list_append(res, l.resolution), depth + 1 FROM w JOIN l ON l.from_id = w.at WHERE depth < {} AND NOT list_contains(path, l.to_id))"""
_CERTAIN = "[" + ", ".join(f"'{c}'" for c in graph.CERTAIN) + "]"
_PATHREGEX = scanners.PROPERTY_LINE
_LINES = r"ln AS (SELECT path, i AS line_no, string_split_regex(content, '\r\n|\n|\r')[i] AS line FROM (SELECT path, content, unnest(range(1, len(string_split_regex(content, '\r\n|\n|\r')) + 1)) AS i FROM f))"
_ISCMD = "(" + " OR ".join(f"contains(lower(v), '{w}')" for w in scanners.COMMANDS) + ")"
_ENTRY = r"sha256(coalesce(upper(category), '') || chr(10) || '[' || api || ']' || chr(10) || code || chr(10) || regexp_extract(method_id, '^([^#]*)#([^/]*)/', 1) || chr(10) || regexp_extract(method_id, '^([^#]*)#([^/]*)/', 2) || chr(10) || " + _UNIX.format("file_path") + ")"

_CODE = "regexp_replace(content, '" + _STRINGS.replace("'", "''") + "', '', 'g')"
_MATCHING = f"""mj AS (SELECT * EXCLUDE (file_path), {_UNIX.format('file_path')} AS path FROM m WHERE signature IS NOT NULL AND file_path LIKE '%.java'),
ok AS (SELECT mj.path FROM mj JOIN f ON f.path = mj.path GROUP BY 1 HAVING bool_and(contains(regexp_replace(content, '\\s+', ' ', 'g'), signature)) AND bool_and(length(replace({_CODE}, '{{', '')) = length(replace({_CODE}, '}}', ''))))"""
_MAPPERS = "sm AS (" + " UNION ALL ".join(
    f"""SELECT path, regexp_extract(regexp_extract(content, '(?i)<mapper\\s+namespace\\s*=\\s*"([^"]+)"', 1), '([^.]*)$', 1) AS mapper, regexp_extract_all(content, '(?i)<{w}\\s+[^>]*id\\s*=\\s*"([^"]+)"[^>]*>((?s:.)*?)</{w}>', 1) AS ids,
    regexp_extract_all(content, '(?i)<{w}\\s+[^>]*id\\s*=\\s*"([^"]+)"[^>]*>((?s:.)*?)</{w}>', 2) AS bodies, regexp_extract_all(content, '(?i)(<{w}\\s+[^>]*id\\s*=\\s*"([^"]+)"[^>]*>((?s:.)*?)</{w}>)', 1) AS wholes, content FROM f WHERE path LIKE '%.xml' AND regexp_matches(content, '(?i)<mapper\\s+namespace\\s*=\\s*"([^"]+)"')"""
    for w in ("select", "insert", "update", "delete")
) + """), mr AS (SELECT path, mapper, unnest(ids) AS statement_id, unnest(bodies) AS raw, instr(content, unnest(wholes)) AS place FROM sm),
ms AS (SELECT path, mapper, statement_id, place, CASE WHEN length(b) > 200 THEN substr(b, 1, 200) || '...' ELSE b END AS snippet FROM (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS b FROM mr WHERE regexp_matches(raw, '\\$\\{[^}]+\\}')))"""
_HEAD = scanners.TYPE_HEAD
_PARENTS = f"""hd AS (SELECT path AS file_path, unnest(regexp_extract_all(content, '{_HEAD}', 1)) AS child, unnest(regexp_extract_all(content, '{_HEAD}', 2)) AS clause FROM f WHERE path LIKE '%.java'),
im AS (SELECT DISTINCT * FROM (SELECT file_path, regexp_replace(regexp_replace(unnest(string_split(regexp_replace(regexp_replace(regexp_replace(clause, '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '\\b(?:extends|implements)\\b', ',', 'g'), ',')), '\\s+', '', 'g'), '^.*\\.', '') AS parent, child FROM hd)
    WHERE regexp_matches(parent, '^[A-Za-z_]\\w*$'))"""
_SIMPLE = "trim(regexp_replace(regexp_replace({}, '<.*>|\\[\\]', '', 'g'), '^.*[.$]', ''))"
_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_RESOLVE = f"""WITH RECURSIVE {_FILES}, {_PARENTS}, {_METHODS}, {_CALLS},
        mm AS (SELECT *, split_part(regexp_replace(replace(fp, '\\', '/'), '^(\\./|/)+', ''), '/', 1) AS pj, struct_pack(a := class_name, b := fp, c := start_line, d := id) AS rk FROM (SELECT *, regexp_extract(id, '{_AT}', 1) AS fp FROM m)),
        ip AS (SELECT DISTINCT split_part(file_path, '/', 1) AS pj, parent, child FROM im), cl AS (SELECT * FROM ip UNION SELECT cl.pj, cl.parent, ip.child FROM cl JOIN ip ON ip.pj = cl.pj AND ip.parent = cl.child),
        ct AS (SELECT *, {_SIMPLE.format("receiver_type")} AS ty FROM c),
        w0 AS (SELECT method_id, call_ord, pj, 0 AS pr, ty AS cls, 'receiver-type' AS resolution, method_name, n FROM ct WHERE ty <> ''
          UNION ALL SELECT method_id, call_ord, pj, 2, class_name, 'same-class', method_name, n FROM ct WHERE receiver IN ('', 'this', 'super')
          UNION ALL SELECT method_id, call_ord, pj, 3, {_SIMPLE.format("receiver")}, 'static-class-name', method_name, n FROM ct WHERE regexp_matches(receiver, '^\\p{{Lu}}')
          UNION ALL SELECT method_id, call_ord, pj, 4, {_SIMPLE.format("upper(receiver[1]) || receiver[2:]")}, 'field-name-type', method_name, n FROM ct WHERE regexp_matches(receiver, '^[^\\p{{Lu}}\\W\\d]') AND NOT contains(receiver, '(') AND receiver NOT IN ('this', 'super')),
        w AS (SELECT * FROM w0 UNION ALL SELECT w0.method_id, w0.call_ord, w0.pj, pr + 1, cl.child, CASE pr WHEN 0 THEN 'interface-implementation' ELSE 'field-name-type' END, method_name, n FROM w0 JOIN cl ON cl.pj = w0.pj AND cl.parent = w0.cls WHERE pr IN (0, 4)),
        hit AS (SELECT w.*, CASE WHEN pr <= 2 THEN 0 WHEN pr = 3 THEN 1 ELSE 2 END AS block, mm.id AS to_id, mm.rk FROM w JOIN mm ON mm.pj = w.pj AND mm.class_name = w.cls AND mm.method_name = w.method_name AND mm.parameter_count = w.n),
        lead AS (SELECT method_id, call_ord, min(block) AS block FROM hit GROUP BY 1, 2), one AS (SELECT pj, method_name, parameter_count AS n, min(id) AS id, min(rk) AS rk FROM mm GROUP BY 1, 2, 3 HAVING count(*) = 1),
        ag AS (SELECT DISTINCT method_id, call_ord, pj, method_name IN ({_LIST(resolve.DEFERRED)}) AS late, {_SIMPLE.format("arg")} AS cls FROM (SELECT *, unnest(argument_types) AS arg FROM ct) WHERE arg <> ''),
        rf AS (SELECT DISTINCT pj, class_name, unnest(regexp_extract_all(signature, '::\\s*([A-Za-z_]\\w*)', 1)) AS name FROM mm),
        al AS (SELECT hit.method_id, hit.call_ord, pr, to_id, rk, resolution FROM hit JOIN lead USING (method_id, call_ord, block)
          UNION ALL SELECT ct.method_id, ct.call_ord, 6, one.id, one.rk, 'unique-method-name-untyped' FROM ct JOIN one ON one.pj = ct.pj AND one.method_name = ct.method_name AND one.n = ct.n
            LEFT JOIN lead ON lead.method_id = ct.method_id AND lead.call_ord = ct.call_ord WHERE lead.method_id IS NULL AND ty = '' AND NOT regexp_matches(ct.receiver, '^\\p{{Lu}}')
          UNION ALL SELECT ag.method_id, ag.call_ord, 7, mm.id, mm.rk, CASE WHEN late THEN 'deferred-callback' ELSE 'runnable-arg-callback' END FROM ag JOIN mm ON mm.pj = ag.pj AND mm.class_name = ag.cls AND mm.method_name IN ('run', 'call')
          UNION ALL SELECT ct.method_id, ct.call_ord, 8, mm.id, mm.rk, 'functional-method-reference' FROM ct JOIN rf ON rf.pj = ct.pj AND rf.class_name = ct.class_name JOIN mm ON mm.pj = ct.pj AND mm.class_name = ct.class_name AND mm.method_name = rf.name
            WHERE ct.method_name IN ({_LIST(resolve.FUNCTIONAL)}) AND (ty IN ({_LIST(resolve.FUNCTIONAL_TYPES)}) OR contains(receiver, '('))),
        fs AS (SELECT method_id, call_ord, to_id, min(struct_pack(pr := pr, rk := rk, resolution := resolution)) AS r FROM al GROUP BY 1, 2, 3), pl AS (SELECT *, row_number() OVER (PARTITION BY method_id, call_ord ORDER BY r.pr, r.rk) AS place FROM fs)"""

ORACLES = {
    "p4_found": _LINKS
    + """a AS (SELECT child AS id, parent AS up FROM l UNION SELECT a.id, l.parent FROM a JOIN l ON l.child = a.up),
c AS (SELECT id FROM a WHERE id = up)
SELECT a.id, min(a.up) AS cycle_id FROM a WHERE a.up IN (SELECT id FROM c) GROUP BY a.id""",
    "p4_tree": _TREE + "SELECT n.id, w.root, coalesce(w.depth, -1) AS depth, w.path, w.id IS NULL AS cyclic FROM n LEFT JOIN w ON w.id = n.id",
    "p4_descendants": _TREE + "SELECT x AS id, id AS descendant, CAST(depth - i + 1 AS INT) AS distance FROM (SELECT id, depth, unnest(path) AS x, generate_subscripts(path, 1) AS i FROM w) WHERE i <= depth",
    "other_parents": f"WITH e AS (SELECT DISTINCT {_T} AS child, {_F} AS parent FROM call_edges WHERE {_F} <> '' AND {_T} <> '') SELECT child, parent FROM e WHERE parent <> (SELECT min(parent) FROM e x WHERE x.child = e.child)",
    "properties_templates": f"""WITH {_FILES}, {_LINES}, kv AS (SELECT path, regexp_extract(line, '{_PATHREGEX}', 1) AS key, regexp_replace(regexp_extract(line, '{_PATHREGEX}', 2), '^\\s+|\\s+$', '', 'g') AS v FROM ln)
        SELECT path AS config_file, key, v AS template_value, regexp_extract_all(v, '\\$\\{{([^}}]+)\\}}', 1) AS placeholders FROM kv WHERE key <> '' AND contains(v, '${{') AND {_ISCMD}""",
    "mapper_statements": f"""WITH {_FILES}, {_MAPPERS} SELECT path AS file_path, mapper, statement_id, snippet FROM ms""",
    "mapper_sinks": f"""WITH {_FILES}, {_MAPPERS}, {_CALLS}, one AS (SELECT split_part(path, '/', 1) AS pj, mapper, statement_id, arg_max(snippet, struct_pack(p := path, at := place)) AS code FROM ms GROUP BY 1, 2, 3)
        SELECT DISTINCT method_id, c.file_path, line, 'MyBatis ${{}}:' || expression AS api, one.code FROM c JOIN one ON one.mapper = c.callee_class AND one.statement_id = c.method_name AND one.pj = c.pj""",
    "indexed_methods": f"""WITH {_FILES}, {_METHODS}, {_MATCHING}
        SELECT class_name, method_name, parameter_count, parameter_names, mj.path AS file_path, start_line, end_line, signature FROM mj WHERE path IN (SELECT path FROM ok)""",
    "indexed_entries": f"""WITH {_FILES}, {_METHODS}, {_MATCHING}, {_LINES}, q AS (SELECT path, line_no, trim(line) AS line FROM ln WHERE path IN (SELECT path FROM ok) AND trim(line) <> ''),
        g AS (SELECT *, count(*) FILTER (WHERE line NOT LIKE '@%') OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM q),
        an AS (SELECT path, grp, list(struct_pack(name := regexp_extract(line, '^@(\\w+)', 1), args := regexp_extract(line, '^@\\w+\\((.*)\\)$', 1)) ORDER BY line_no) AS a FROM g WHERE line LIKE '@%' GROUP BY 1, 2),
        mt AS (SELECT an.path AS file_path, regexp_extract(line, '(\\w+)\\s*\\([^()]*\\)[^()]*$', 1) AS method_name, regexp_extract(an.path, '([^/]*)[.]java$', 1) AS class_name, a FROM an JOIN g ON g.path = an.path AND g.grp = an.grp WHERE line NOT LIKE '@%' AND contains(line, '(') AND contains(line, '{{')),
        ht AS (SELECT *, list_filter(a, lambda x: x.name IN ('GetMapping', 'PostMapping', 'PutMapping', 'DeleteMapping', 'PatchMapping')) AS h, list_filter(a, lambda x: x.name IN ('Scheduled', 'Async', 'EventListener', 'KafkaListener', 'JmsListener', 'RabbitListener')) AS t FROM mt)
        SELECT 'HTTP' AS protocol, array_to_string(list_transform(h, lambda x: upper(replace(x.name, 'Mapping', ''))), ',') AS operations, CASE WHEN regexp_extract(h[1].args, '"(/[^"]*)"', 1) = '' THEN '/' ELSE regexp_extract(h[1].args, '"(/[^"]*)"', 1) END AS route, class_name, method_name, file_path,
          'annotation-based' AS framework, 'annotated-http' AS discovery_source, 'HIGH' AS confidence FROM ht WHERE len(h) > 0
        UNION ALL SELECT CASE t[1].name WHEN 'Scheduled' THEN 'scheduled' WHEN 'Async' THEN 'async' WHEN 'EventListener' THEN 'event' ELSE 'message' END, t[1].name, t[1].args, class_name, method_name, file_path, 'spring-async', 'async-trigger', 'HIGH' FROM ht WHERE len(t) > 0""",
    "restored_findings": f"WITH {_FINDINGS} SELECT ord, rule_id, file_path, start_line, verdict, confidence, severity FROM fi",
    "source_lines": f"WITH {_FILES}, {_LINES} SELECT path, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(line, '^\\s*$')) AS blank FROM ln GROUP BY 1",
    "declared_parents": f"WITH {_FILES}, {_PARENTS} SELECT file_path, parent, child FROM im",
    # the rules are stated here once more, in words of their own
    "source_hints": f"""WITH {_FILES}, {_LINES}, h AS (SELECT path, CAST(line_no AS INT) AS line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS code FROM ln), k AS (SELECT * FROM h WHERE code <> '' AND code NOT LIKE '//%'),
        r AS (SELECT *, 'COMMAND_EXECUTION' AS category FROM k WHERE regexp_matches(code, '\\bProcessBuilder\\b') OR regexp_matches(code, 'Runtime\\s*[.]\\s*getRuntime\\s*[(][)]\\s*[.]\\s*exec\\s*[(]')
        UNION ALL SELECT *, 'SCRIPT_EXECUTION' FROM k WHERE regexp_matches(code, '\\bScriptEngine\\b') OR regexp_matches(code, '[.]eval\\s*[(]') OR contains(code, 'SpelExpressionParser') OR regexp_matches(code, 'parseExpression\\s*[(]')
        UNION ALL SELECT *, 'NATIVE_DESERIALIZATION' FROM k WHERE regexp_matches(code, '\\bObjectInputStream\\b') OR regexp_matches(code, '[.]readObject\\s*[(]') OR regexp_matches(code, '\\bXMLDecoder\\b') OR regexp_matches(code, '[.]fromXML\\s*[(]')
        UNION ALL SELECT *, 'DYNAMIC_LOADING' FROM k WHERE regexp_matches(code, '\\bURLClassLoader\\b') OR regexp_matches(code, 'Class\\s*[.]\\s*forName\\s*[(]') OR regexp_matches(code, '[.]loadClass\\s*[(]') OR regexp_matches(code, '[.]invoke\\s*[(]')
        UNION ALL SELECT *, 'JNDI_LOOKUP' FROM k WHERE regexp_matches(code, '\\bInitialContext\\b') OR regexp_matches(code, '[.]lookup\\s*[(]')
        UNION ALL SELECT *, 'NATIVE_LIBRARY' FROM k WHERE regexp_matches(code, 'System\\s*[.]\\s*load(Library)?\\s*[(]'))
        SELECT path, line_no, category, substr(code, 1, 500) AS code FROM r""",
    "tech_profile": f"""WITH {_FILES}, a AS (SELECT path, split_part(path, '/', 1) AS repo, regexp_extract(path, '([^/]*)$', 1) AS nm FROM (SELECT DISTINCT path FROM f) WHERE len(string_split(path, '/')) <= 9),
        x AS (SELECT repo, min(path) FILTER (WHERE nm = 'pom.xml') AS pom, min(path) FILTER (WHERE nm IN ('build.gradle', 'build.gradle.kts')) AS gradle, min(path) FILTER (WHERE nm LIKE '%.java') AS java FROM a GROUP BY 1),
        y AS (SELECT x.*, regexp_extract_all(p.content, '<dependency>((?s:.)*?)</dependency>', 1)[:100] AS bl, regexp_extract(j.content, '(?m)^\\s*package\\s+([A-Za-z_][\\w.]*)\\s*;', 1) AS pk FROM x LEFT JOIN f p ON p.path = x.pom LEFT JOIN f j ON j.path = x.java),
        z AS (SELECT *, list_transform(coalesce(bl, []), lambda b: struct_pack(group_id := trim(regexp_extract(b, '<groupId>((?s:.)*?)</groupId>', 1)), artifact_id := trim(regexp_extract(b, '<artifactId>((?s:.)*?)</artifactId>', 1)), version := trim(regexp_extract(b, '<version>((?s:.)*?)</version>', 1)))) AS dp FROM y),
        w AS (SELECT *, lower(array_to_string(list_transform(dp, lambda q: q.group_id || chr(10) || q.artifact_id || chr(10) || q.version), chr(10))) AS tx FROM z)
        SELECT repo, CASE WHEN coalesce(java, pom, gradle) IS NULL THEN 'unknown' ELSE 'java' END AS primary_language, CASE WHEN pom IS NOT NULL THEN 'maven' WHEN gradle IS NOT NULL THEN 'gradle' ELSE 'unknown' END AS build_tool,
        CASE WHEN contains(tx, 'spring-boot') THEN 'Spring Boot' WHEN contains(tx, 'spring-web') THEN 'Spring' WHEN contains(tx, 'jersey') THEN 'JAX-RS' ELSE 'unknown' END AS web_framework,
        CASE WHEN contains(tx, 'mybatis') THEN 'MyBatis' WHEN contains(tx, 'hibernate') THEN 'Hibernate' WHEN contains(tx, 'spring-data-jpa') THEN 'JPA' ELSE 'unknown' END AS orm,
        list_filter([CASE WHEN contains(tx, 'spring-security') THEN 'Spring Security' END, CASE WHEN contains(tx, 'shiro') THEN 'Apache Shiro' END], lambda q: q IS NOT NULL) AS security_libs, dp AS dependencies, coalesce(pk, '') AS app_package FROM w""",
    "sink_rules": f"WITH {_SINKS} SELECT id, {_DUCK(classify.sink_case('''regexp_replace(api, '^.*[.]', '')''', 'api', chr(39) * 2))} AS found FROM k",
    "storage_accesses": f"WITH {_STORE} SELECT DISTINCT method_id, call_ord, kind, storage_key FROM st",
    "hunter_sinks": f"WITH {_SINKS}, h(hunter, c) AS (VALUES {', '.join(f'''('{h}', '{c}')''' for h, cs in classify.HUNTERS.items() for c in cs)}) SELECT hunter, category, count(*) AS n FROM k JOIN h ON h.c = k.category GROUP BY 1, 2",
    "resolved_calls": f"""{_RESOLVE}
        SELECT method_id AS from_id, call_ord, to_id, r.resolution AS resolution FROM pl WHERE place <= 12""",
    "unresolved_calls": f"""{_RESOLVE}
        SELECT method_id, file_path, line, expression FROM c WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.method_id = c.method_id AND al.call_ord = c.call_ord)""",
    "nearest_binding": f"""WITH {_METHODS}, en AS (SELECT DISTINCT id, file_path, regexp_extract(method_id, '#([^/]*)/', 1) AS nm, line AS start_line FROM sinks WHERE regexp_extract(method_id, '#([^/]*)/', 1) <> ''),
        j AS (SELECT en.*, m.id AS mid, row_number() OVER (PARTITION BY en.id, en.file_path, en.start_line, nm ORDER BY abs(m.start_line - en.start_line), m.method_seq) AS rn FROM en LEFT JOIN m ON {_UNIX.format('m.file_path')} = {_UNIX.format('en.file_path')} AND m.method_name = nm)
        SELECT id, file_path, start_line, coalesce(mid, '') AS method_id, CASE WHEN mid IS NULL THEN 'UNRESOLVED' ELSE 'BOUND' END AS binding_status FROM j WHERE rn = 1""",
    "stored_flows": f"""WITH {_STORE}, {_GOALS}, wr AS (SELECT pj, access_id AS wo, method_id AS write_entry, lower(storage_key) AS key FROM st WHERE kind = 'WRITE'),
        rd AS (SELECT pj, access_id || '|' || g.id AS ro, access_id AS read_id, g.id AS sink_id, lower(storage_key) AS key FROM st JOIN g ON g.method_id = st.method_id WHERE kind = 'READ'),
        pr AS (SELECT pj, write_entry, read_id, sink_id, min(ro) AS ro, min(wo) AS wo FROM wr JOIN rd USING (pj, key) GROUP BY 1, 2, 3, 4)
        SELECT pj AS project, write_entry, read_id, sink_id, 'MEDIUM' AS correlation FROM (SELECT *, row_number() OVER (PARTITION BY pj ORDER BY ro, read_id, sink_id, wo, write_entry) AS rn FROM pr) WHERE rn <= 500""",
    "authorization_surface": f"""WITH {_PATHS}, en AS (SELECT DISTINCT entry_id FROM p WHERE {_TRIM.format('entry_id')} <> ''), q AS (SELECT entry_id, list_sort(list(DISTINCT category)) AS cs, count(*) AS n, min(call_depth) AS dp FROM p WHERE category <> '' AND call_depth >= 0 GROUP BY 1)
        SELECT entry_id, coalesce(cs, []) AS categories, coalesce(n, 0) AS paths, coalesce(dp, -1) AS min_depth FROM en LEFT JOIN q USING (entry_id)""",
    "missing_sinks": "SELECT DISTINCT sink_id AS id FROM candidate_paths WHERE sink_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sinks WHERE sinks.id = candidate_paths.sink_id)",
    "reverse_reach": f"WITH RECURSIVE {_EDGES}, {_GOALS}, w AS (SELECT DISTINCT method_id AS id, 0 AS hops FROM g UNION SELECT e.from_id, w.hops + 1 FROM w JOIN e ON e.to_id = w.id WHERE w.hops < 20) SELECT id, min(hops) AS hops FROM w GROUP BY id",
    "candidate_search": f"""WITH RECURSIVE {_EDGES}, {_GOALS}, {_L}, {_START}, {_WALK.format(20)}, st AS (SELECT w.*, gs.n FROM w JOIN (SELECT method_id, count(*) AS n FROM g GROUP BY 1) gs ON gs.method_id = w.at),
        cu AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY entry_id ORDER BY depth, ords, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st)
        SELECT entry_id, g.id AS sink_id, path, depth AS call_depth, CASE WHEN len(list_filter(res, lambda x: NOT list_contains({_CERTAIN}, x))) = 0 THEN 'HIGH' WHEN len(list_filter(res, lambda x: starts_with(x, 'unique-method-name'))) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS static_confidence
        FROM cu JOIN g ON g.method_id = cu.at WHERE before < 200""",
    "write_paths": f"""WITH RECURSIVE {_STORE}, {_L}, {_START}, {_WALK.format(12)}, ac AS (SELECT DISTINCT access_id, method_id FROM st WHERE kind = 'WRITE'),
        h AS (SELECT w.*, ac.access_id, row_number() OVER (PARTITION BY entry_id, access_id ORDER BY depth, ords, path) AS rn FROM w JOIN ac ON ac.method_id = w.at)
        SELECT entry_id, access_id, depth AS call_depth, CASE WHEN len(list_filter(res, lambda x: starts_with(x, 'unique-method-name'))) > 0 THEN 'MEDIUM' ELSE 'HIGH' END AS correlation, path FROM h WHERE rn = 1""",
    "derived_sinks": f"""WITH RECURSIVE {_EDGES}, {_GOALS}, {_METHODS}, b AS (SELECT method_id AS id, arg_max(category, sink_ord) AS category FROM g GROUP BY 1), fw AS (SELECT from_id, to_id, min(edge_ord) AS edge_ord FROM e WHERE regexp_matches(expression, '\\(.*[^\\s()].*\\)') AND from_id NOT IN (SELECT id FROM b) GROUP BY 1, 2),
        fs AS (SELECT fw.*, x.method_seq AS fseq, y.method_seq AS tseq, fw.to_id IN (SELECT id FROM b) AS base FROM fw JOIN m x ON x.id = fw.from_id LEFT JOIN m y ON y.id = fw.to_id),
        dd AS (SELECT from_id AS id FROM fs WHERE base UNION SELECT fs.from_id FROM fs JOIN dd ON dd.id = fs.to_id WHERE NOT base AND tseq < fseq),
        ch AS (SELECT from_id, min(struct_pack(o := edge_ord, t := to_id)) AS c FROM fs WHERE base OR tseq < fseq AND to_id IN (SELECT id FROM dd) GROUP BY 1),
        up AS (SELECT from_id AS id, c.t AS at FROM ch UNION ALL SELECT up.id, ch.c.t FROM up JOIN ch ON ch.from_id = up.at)
        SELECT up.id AS method_id, b.category, ch.c.t AS target_id FROM up JOIN b ON b.id = up.at JOIN ch ON ch.from_id = up.id""",
    "distinct_sinks": "SELECT sink_ord, id, category, method_id, file_path, line FROM (SELECT *, row_number() OVER (PARTITION BY method_id, category, file_path, line ORDER BY sink_ord, id) AS rn FROM sinks) WHERE rn = 1",
    "coverage": f"WITH {_PATHS} SELECT *, CASE WHEN paths = 0 THEN 1.0 ELSE floor(confirmed / paths * 10000 + 0.5) / 10000 END AS confirmed_rate FROM (SELECT count(*) AS paths, count(DISTINCT entry_id) AS entries_with_paths, count(*) FILTER (WHERE taint_confidence = 'CONFIRMED') AS confirmed FROM p)",
    "coverage_tables": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("source_files", "methods", "sinks", "call_edges", "candidate_paths", "parse_errors")),
    "sinks_by_category": f"WITH {_SINKS} SELECT category, count(*) AS n FROM k GROUP BY 1",
    "best_findings": f"WITH {_FINDINGS}, {_BEST} SELECT ord, rule_id, file_path, start_line, verdict, confidence FROM b",
    "finding_stats": f"WITH {_FINDINGS} SELECT 'total' AS dimension, '' AS key, count(*) AS n FROM fi UNION ALL SELECT 'by_severity', upper(severity), count(*) FROM fi GROUP BY 2 UNION ALL SELECT 'by_verdict', upper(verdict), count(*) FROM fi GROUP BY 2"
    " UNION ALL SELECT 'by_agent', CASE WHEN trim(discovered_by) = '' THEN 'unknown' ELSE discovered_by END, count(*) FROM fi GROUP BY 2 UNION ALL SELECT 'by_vuln_type', vuln_type, count(*) FROM fi GROUP BY 2",
    "attack_chains": f"WITH {_FINDINGS}, " + _chains("split_part(file_path, '/', 1)") + " SELECT * FROM cc",
    "attack_chains_app": f"WITH {_FINDINGS}, " + _chains("split_part(file_path, '/', 1)", "io/brightmoor") + " SELECT * FROM cc",
    "findings_summary": f"WITH {_FINDINGS}, {_BEST}, " + _chains("''") + " SELECT *, after_dedup + chain_findings AS final FROM (SELECT (SELECT count(*) FROM fi) AS total_raw, (SELECT count(*) FROM b) AS after_dedup, (SELECT count(*) FROM cc) AS chain_findings)",
    "candidate_priority": f"WITH {_PATHS} SELECT path_id, static_confidence, coalesce(call_depth, -1) AS call_depth FROM p",
    "paths_by_category": f"WITH {_PATHS} SELECT category, count(*) AS n FROM p GROUP BY 1",
    "worst_findings": f"WITH {_FINDINGS} SELECT ord, severity, confidence FROM fi ORDER BY {_RANK('upper(severity)', report.SEVERITIES)} DESC, confidence DESC, ord LIMIT 100",
    "first_candidates": f"WITH {_PATHS} SELECT path_id, static_confidence, call_depth FROM p WHERE call_depth >= 0 ORDER BY {_RANK('upper(trim(static_confidence))', report.CONFIDENCES)} DESC, call_depth, path_id LIMIT 100",
    "chunk_plan": """WITH RECURSIVE i AS (SELECT DISTINCT item_id, chunk_name, item_ord, coalesce(strlen(payload), 0) AS s FROM chunk_items),
        q AS (SELECT chunk_name, item_ord, s, row_number() OVER (PARTITION BY chunk_name ORDER BY item_ord, s) AS rn FROM i),
        w AS (SELECT chunk_name, rn, item_ord, CAST(0 AS BIGINT) AS chunk, 1 AS n, CAST(s AS BIGINT) AS total FROM q WHERE rn = 1
          UNION ALL SELECT q.chunk_name, q.rn, q.item_ord, CASE WHEN w.n >= 50 OR w.total + q.s > 65536 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.n >= 50 OR w.total + q.s > 65536 THEN 1 ELSE w.n + 1 END,
            CASE WHEN w.n >= 50 OR w.total + q.s > 65536 THEN q.s ELSE w.total + q.s END FROM w JOIN q ON q.chunk_name IS NOT DISTINCT FROM w.chunk_name AND q.rn = w.rn + 1)
        SELECT chunk_name, chunk, CAST(min(item_ord) AS BIGINT) AS start_index, CAST(max(item_ord) AS BIGINT) AS end_index, max(total) AS bytes FROM w GROUP BY 1, 2""",
    "log_levels": """SELECT CASE WHEN contains(text, '[FATAL]') OR contains(text, '[ERROR]') OR starts_with(replace(text, chr(13), ''), 'ERROR') THEN 'ERROR' WHEN contains(text, '[WARN]') OR starts_with(replace(text, chr(13), ''), 'WARN') THEN 'WARN' ELSE 'INFO' END AS level, count(*) AS n FROM documents GROUP BY 1""",
    "text_sizes": """WITH d AS (SELECT doc_id, strlen(text) AS n, regexp_replace(text, '\\r?\\n', ' | ', 'g') AS flat, created_at, date_part('microseconds', created_at) % 1000000 AS us FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f', n / 1024.0) || ' KB' END AS size, CASE WHEN length(flat) > 80 THEN substr(flat, 1, 80) || '…' ELSE flat END AS shown,
        strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us = 0 THEN '' WHEN us % 1000 = 0 THEN printf('.%03d', us // 1000) ELSE printf('.%06d', us) END || 'Z' AS created, CASE WHEN created_at IS NOT NULL THEN true END AS same FROM d""",
    "agent_progress": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'started' ELSE 'completed' END AS type, props->>'$.k' AS task_id, value, props FROM events WHERE event_type IN ('signup', 'purchase')),
        b AS (SELECT *, lag(type) OVER (PARTITION BY session_id, task_id ORDER BY seq) AS before FROM e),
        o AS (SELECT *, CASE WHEN type = 'started' AND coalesce(before, '') <> 'started' THEN 1 WHEN type = 'completed' AND before = 'started' THEN -1 ELSE 0 END AS opens FROM b),
        x AS (SELECT *, CAST(count(*) FILTER (WHERE type = 'completed') OVER w AS INT) AS completed, sum(opens) OVER w AS running FROM o WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
        SELECT session_id, seq, type, CASE WHEN type = 'started' OR before = 'started' THEN 'agent-' || task_id ELSE task_id END AS agent, CASE WHEN type = 'completed' THEN CASE WHEN value > 20 THEN 'done' ELSE 'stopped' END END AS status, completed,
        CAST(CASE WHEN type = 'completed' THEN completed + running END AS INT) AS total, CASE WHEN strlen(props) < 1024 THEN strlen(props) || ' B' ELSE printf('%.1f', strlen(props) / 1024.0) || ' KB' END AS result_size,
        CASE WHEN length(regexp_replace(props, '\\r?\\n', ' | ', 'g')) > 200 THEN substr(regexp_replace(props, '\\r?\\n', ' | ', 'g'), 1, 200) || '…' ELSE regexp_replace(props, '\\r?\\n', ' | ', 'g') END AS preview FROM x""",
    "batch_plan": """WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ingested_at) AS rn FROM chunk_batches) WHERE rn = 1), i AS (SELECT chunk_name, count(DISTINCT item_id) AS k FROM chunk_items GROUP BY 1),
        nm AS (SELECT batch_id, unnest(list_concat(coalesce(candidate_chunks, []), coalesce(stored_chunks, []))) AS chunk_name FROM b), it AS (SELECT batch_id, sum(k) AS items FROM nm JOIN i USING (chunk_name) GROUP BY 1),
        z AS (SELECT b.batch_id, CAST(coalesce(items, 0) AS BIGINT) AS items, coalesce(len(candidate_chunks), 0) + coalesce(len(stored_chunks), 0) AS n FROM b LEFT JOIN it USING (batch_id)), q AS (SELECT *, unnest(range(0, (n + 19) // 20)) AS p FROM z WHERE n > 0)
        SELECT batch_id, CAST(p AS INT) AS plan, CAST(least(n, (p + 1) * 20) - p * 20 AS INT) AS chunks, items * (p * 20) // n AS items_from, items * least(n, (p + 1) * 20) // n AS items_to FROM q""",
    "entry_ids": f"""WITH {_SINKS} SELECT id, substr({_ENTRY}, 1, 24) AS entry_id, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(code, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: (h * 31 + x) % 4294967296) AS BIGINT) AS code_hash, substr(sha256(file_path), 1, 16) AS cache_key
        FROM k WHERE method_id <> ''""",
    "last_results": """WITH x AS (SELECT CAST(user_id AS VARCHAR) AS session_id, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS r, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1)
        SELECT session_id, CASE WHEN NOT failed AND r IS NOT NULL THEN 'OK' ELSE 'ERROR' END AS state, printf('%.2f', r) AS result FROM x""",
    "retained_events": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 2000",
}
