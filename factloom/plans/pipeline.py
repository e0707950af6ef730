"""The whole analysis: parsed files in, a bundle of fact and result tables out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import cut
from ..operators import classify, graph, report, resolve, taint
from ..sources import discover as disc
from ..sources import java_facts as jf
from ..sources import scanners


@dataclass
class Analysis:
    methods: DataFrame
    calls: DataFrame
    sinks: DataFrame
    storage: DataFrame
    entries: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    candidates: DataFrame
    write_paths: DataFrame
    stored: DataFrame
    diagnostics: DataFrame
    coverage: DataFrame


def number_sinks(*parts: DataFrame) -> DataFrame:
    """Union of sink rows with one order (source first, then file, line, method, category), de-duplicated."""
    cols = ["category", "api", "method_id", "file_path", "line", "code"]
    rows = None
    for i, p in enumerate(parts):
        q = p.select(*[F.col(c) if c in p.columns else F.lit("").alias(c) for c in cols]).withColumn("_src", F.lit(i))
        rows = q if rows is None else rows.unionByName(q)
    key = F.struct("_src", "file_path", "line", "method_id", "category", "api", "code")
    rows = rows.withColumn("sink_ord", key).withColumn("id", F.concat(F.lit("sink-"), F.substring(F.sha2(F.concat_ws("|", "method_id", "category", "file_path", "line"), 256), 1, 16)))
    return graph.dedup_sinks(rows).drop("_src")


def analyze(files: DataFrame, extra_rules: DataFrame | None = None, reviewer: Callable[[DataFrame], DataFrame] | None = None, selected: DataFrame | None = None, depth: int = 20, per_entry: int = 200, project: Callable[[str], Column] | None = None) -> Analysis:
    """files(path, content), Java and configuration. project: from the path of a file to its project (such as functions.text.project_of): names, templates, unique methods and the
    bounds of the reference then hold within each project; None takes all files as one. extra_rules: see classify_calls. reviewer: rows of suspicious calls in, sink rows out; None
    (no reviewer at hand) adds nothing. selected: ids of entry points to follow; None or empty follows all."""
    pj = project or (lambda path: F.lit(""))
    parsed = jf.parse_files(files)
    methods, calls, classes = cut(jf.methods(parsed)), cut(jf.calls(parsed)), jf.classes(parsed)
    found = classify.classify_calls(calls, extra_rules).withColumn("code", F.col("expression"))
    parts = [found, classify.structural_sinks(methods, classes), resolve.mapper_sinks(calls, scanners.mapper_statements(files.where(F.col("path").endswith(".xml"))), project)]
    config = files.where(F.col("path").rlike(r"\.(ya?ml|properties|xml)$"))
    templates = scanners.properties_templates(config.where(F.col("path").endswith(".properties"))).unionByName(scanners.yaml_templates(config.where(F.col("path").rlike(r"\.ya?ml$")))).unionByName(scanners.xml_templates(config.where(F.col("path").endswith(".xml"))))
    parts.append(resolve.template_sinks(methods, calls, templates, project))
    sinks = cut(number_sinks(*parts))
    parts.append(taint.local_taint_sinks(methods, calls, sinks))
    if reviewer is not None:
        parts.append(reviewer(classify.suspicious_calls(calls, sinks, classes, project=project)))
    sinks = cut(number_sinks(*parts))
    edges, unresolved = resolve.resolve_calls(calls, methods, jf.implementations(parsed), jf.method_refs(parsed), project)
    edges = cut(edges)
    ordered = methods.withColumn("method_seq", F.struct("file_path", "ord"))
    derived = graph.derived_sinks(ordered, graph.forwarding(methods, calls, edges), sinks)
    derived = derived.join(methods.select(F.col("id").alias("method_id"), "file_path", F.col("start_line").alias("line")), "method_id").withColumn("api", F.concat(F.lit("transitive:"), F.regexp_replace("target_id", "@.*", "")))
    sinks = cut(number_sinks(*parts, derived))
    bound = resolve.bind_nearest(disc.discover(parsed), ordered)
    entries = cut(disc.select_entries(bound, selected).withColumn("entry_id", F.concat("id", F.lit("|"), "method_id")))
    starts = entries.where("method_id <> ''").select("entry_id", "method_id").distinct()
    paths = cut(graph.candidate_paths(starts, edges, sinks, depth, per_entry))
    info = entries.select("entry_id", "protocol", "framework").dropDuplicates(["entry_id"])
    p = paths.join(info, "entry_id").join(sinks.select(F.col("id").alias("sink_id"), "category", F.concat_ws(" ", "api", "code").alias("sink_text")), "sink_id")
    p = p.join(methods.select(F.col("id").alias("_first"), "parameter_count"), F.get("path", F.lit(0)) == F.col("_first"), "left").drop("_first").withColumn("parameter_count", F.coalesce("parameter_count", F.lit(0)))
    p = p.withColumn("path_key", F.struct("entry_id", "sink_id", "path"))
    candidates = cut(taint.verify_paths(p, taint.summaries(methods, calls)).drop("path_key", "sink_text"))
    storage = cut(classify.storage_accesses(calls).withColumn("access_id", F.concat_ws("|", "method_id", "call_ord")))
    outside = entries.where((F.col("method_id") != "") & F.upper("protocol").isin("HTTP", "MESSAGE")).select("entry_id", F.col("entry_id").alias("entry_ord"), "method_id", pj("file_path").alias("project")).distinct()
    writes = cut(graph.write_paths(outside, edges, storage.where("kind = 'WRITE'").select("access_id", F.struct("method_id", "call_ord").alias("access_ord"), "method_id")))
    w = writes.join(storage.select("access_id", "storage_key", "value_type", pj("file_path").alias("project")), "access_id").select("project", F.struct("entry_id", "call_depth", "path").alias("write_ord"), F.col("entry_id").alias("write_entry"), "storage_key", "value_type")
    on = candidates.select("entry_id", "sink_id", "call_depth", F.posexplode("path").alias("pos", "method_id")).join(storage.where("kind = 'READ'"), "method_id")
    r = on.select(pj("file_path").alias("project"), F.struct("entry_id", "call_depth", "sink_id", "pos", "call_ord").alias("read_ord"), F.col("access_id").alias("read_id"), "sink_id", "storage_key", "value_type")
    stored = cut(report.stored_flows(w, r))
    diagnostics = jf.diagnostics(parsed, project=project)
    cover = report.coverage({"files": parsed, "methods": methods, "entries": entries, "bound": entries.where("binding_status = 'BOUND'"), "sinks": sinks, "edges": edges, "unresolved_calls": unresolved, "candidates": candidates, "storage": storage, "write_paths": writes, "stored": stored, "diagnostics": diagnostics})
    return Analysis(methods, calls, sinks, storage, entries, edges, unresolved, candidates, writes, stored, diagnostics, cover)
