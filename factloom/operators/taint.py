"""Parameter flow: per-method summaries, checks along paths, sinks inside a method."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import skew_join
from .classify import protocol_side

#: Calls that pass text on, and those of them whose result is stored in the receiver.
STRING_CALLS = frozenset("replace replaceAll replaceFirst format formatted concat substring trim strip toLowerCase toUpperCase append insert toString split".split())
TAINT_CALLS = frozenset("replace replaceAll replaceFirst format formatted append split".split())
KINDS = {"replace": "replace", "replaceAll": "replace", "replaceFirst": "replace", "format": "format", "formatted": "format", "append": "concatenation", "split": "split", "<init>": "constructor-arg"}
FLOW = "array<struct<source_param:int,method_name:string,receiver:string,arg:int,propagation:string>>"
SUMMARY = f"method_id string, flows {FLOW}, params_reach_return array<int>, has_string_manipulation boolean, has_taint_propagation boolean"


def summarize(names: list[str], signature: str, calls: list[dict]) -> tuple:
    """Flows of one method's parameters through its calls in order; a tainted variable in a text call taints the receiver."""
    taint: dict[str, set[int]] = {n: {i} for i, n in reversed(list(enumerate(names)))}
    flows, strings, passed = [], False, False
    for c in calls:
        name, receiver = c["method_name"], c["receiver"] or ""
        for k, arg in enumerate(list(c["argument_expressions"])[: c["argument_count"]]):
            for var, params in list(taint.items()):
                if arg and re.search(rf"\b{re.escape(var)}\b", arg):
                    flows += [(p, name, receiver, k, KINDS.get(name, "direct")) for p in sorted(params)]
        if name in STRING_CALLS:
            strings = True
            root = re.split(r"[.\[(]", receiver, maxsplit=1)[0]
            passed = passed or bool(taint.get(root))
            if name in TAINT_CALLS:
                inside = [params for var, params in taint.items() if params and var in (c["expression"] or "")]
                passed = passed or bool(inside)
                if receiver and inside:
                    taint[root] = taint.get(root, set()).union(*inside)
    back = sorted({p for var, params in taint.items() if var in signature for p in params})
    return flows, back, strings, passed


def summaries(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """One summary a method; methods without calls have empty flows. The calls of one method meet in one row (they are one method's text)."""
    c = calls.groupBy("method_id").agg(F.array_sort(F.collect_list(F.struct("call_ord", "method_name", "receiver", "argument_count", "argument_expressions", "expression"))).alias("calls"))
    m = methods.select(F.col("id").alias("method_id"), "parameter_names", "signature").join(c, "method_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, names, sig, cs in zip(pdf["method_id"], pdf["parameter_names"], pdf["signature"], pdf["calls"]):
                flows, back, strings, passed = summarize(list(names) if names is not None else [], sig or "", [x if isinstance(x, dict) else x.asDict() for x in cs] if cs is not None else [])
                rows.append((i, [dict(zip(("source_param", "method_name", "receiver", "arg", "propagation"), f)) for f in flows], back, strings, passed))
            yield pd.DataFrame(rows, columns=["method_id", "flows", "params_reach_return", "has_string_manipulation", "has_taint_propagation"])

    return m.mapInPandas(run, SUMMARY)


def verify_paths(paths: DataFrame, summaries_: DataFrame) -> DataFrame:
    """paths(path_key, protocol, framework, parameter_count, path, sink_text) with taint_confidence, source_classification, taint_trace.

    Steps meet their summaries by a join on method id; the fold over a path (at most depth + 1 steps) is an aggregate expression.
    """
    steps = paths.select("path_key", F.posexplode("path").alias("pos", "method_id"))
    s = skew_join(steps, summaries_.select("method_id", "flows", F.col("has_taint_propagation").alias("passes"), F.lit(True).alias("known")), "method_id", "left")
    s = s.groupBy("path_key").agg(F.array_sort(F.collect_list(F.struct("pos", "method_id", "flows", "passes", "known"))).alias("steps"))
    p = paths.join(s, "path_key", "left").withColumn("steps", F.coalesce("steps", F.expr("cast(array() as array<struct<pos:int,method_id:string,flows:" + FLOW + ",passes:boolean,known:boolean>>)")))
    side = protocol_side("protocol")
    edges = F.greatest(F.size("steps") - 1, F.lit(0))
    every = F.when(F.col("parameter_count") > 0, F.sequence(F.lit(0), F.col("parameter_count") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    p = p.withColumn("_taint", F.when(side == "internal", F.expr("cast(array() as array<int>)")).otherwise(every)).withColumn("_edges", edges)
    short = "regexp_replace({}, '@.*', '')"
    fold = f"""aggregate(slice(steps, 1, _edges), named_struct('taint', _taint, 'edges', 0, 'text', false, 'hit', false, 'trace', cast(array() as array<string>)),
      (a, s) -> CASE WHEN s.known IS NULL THEN named_struct('taint', a.taint, 'edges', a.edges, 'text', a.text, 'hit', false, 'trace', concat(a.trace, array(concat('Step ', s.pos + 1, ': ', {short.format("s.method_id")}, ' has no summary, assumed propagated'))))
      WHEN exists(s.flows, f -> array_contains(a.taint, f.source_param)) THEN named_struct(
        'taint', array_distinct(transform(filter(s.flows, f -> array_contains(a.taint, f.source_param)), f -> f.arg)), 'edges', a.edges + 1,
        'text', a.text OR exists(s.flows, f -> array_contains(a.taint, f.source_param) AND f.propagation IN ('replace', 'format', 'split')), 'hit', true,
        'trace', concat(a.trace, transform(filter(s.flows, f -> array_contains(a.taint, f.source_param)), f -> concat('Step ', s.pos + 1, ': param[', f.source_param, '] of ', {short.format("s.method_id")}, ' to arg[', f.arg, '] of ', f.method_name, ' by ', f.propagation))))
      ELSE named_struct('taint', a.taint, 'edges', a.edges, 'text', a.text OR s.passes, 'hit', false,
        'trace', concat(a.trace, array(concat('Step ', s.pos + 1, ': ', {short.format("s.method_id")}, IF(s.passes, ' passes text on, assumed flowing', ' is a structural edge'))))) END)"""
    p = p.withColumn("_f", F.expr(fold))
    # an external entry reaches the sink at once if a parameter flows into a call that the sink text names; else the last edge must be tainted
    named = "CASE WHEN f.method_name = '<init>' THEN f.receiver <> '' AND contains(lower(sink_text), concat('new ', lower(f.receiver))) ELSE contains(lower(sink_text), lower(f.method_name)) END"
    direct = (side == "external") & F.coalesce(F.expr(f"exists(get(steps, 0).flows, f -> array_contains(_taint, f.source_param) AND {named})"), F.lit(False))
    reach = direct | (F.col("_edges") > 0) & F.col("_f.hit")
    conf = F.when(F.size("steps") == 0, "NONE").when(reach & F.col("_f.text"), "CONFIRMED").when(reach | (F.col("_f.edges") > F.floor(F.col("_edges") / 2)), "LIKELY").otherwise("STRUCTURAL")
    source = F.when(F.size("steps") == 0, "UNKNOWN").when(F.lower(F.coalesce("framework", F.lit(""))).contains("config"), "CONFIG_CONTROLLED").when(side == "external", F.when(reach, "REQUEST_CONTROLLED").otherwise("UNKNOWN")).when(side == "internal", "INTERNAL_DERIVED").otherwise("UNKNOWN")
    return p.withColumns({"taint_confidence": conf, "source_classification": source, "taint_trace": F.col("_f.trace")}).drop("steps", "_taint", "_edges", "_f")


#: Calls that work on text, and calls that run something (P5).
TEXT_WORK = "format replace replaceAll replaceFirst concat append toString valueOf substring trim strip toLowerCase toUpperCase".split()
RUNNERS = "exec start run evaluate".split()


def local_taint_sinks(methods: DataFrame, calls: DataFrame, sinks: DataFrame) -> DataFrame:
    """P5: (method_id, category, api, file_path, line, code) for methods with a command or script sink that a parameter can reach through text work.

    Parameter names come from the signature between the first ( and the last ), as in the reference; names match as substrings.
    """
    danger = sinks.where(F.col("category").isin("COMMAND_EXECUTION", "SCRIPT_OR_EXPRESSION_EXECUTION") & (F.col("method_id") != ""))
    low = F.lower("code")
    direct = F.coalesce((low.contains("replace") | low.contains("format") | low.contains("concat") | low.contains("+")) & (low.contains("exec") | low.contains("processbuilder") | low.contains("start()")), F.lit(False))
    d = danger.groupBy("method_id").agg(F.min_by("category", "sink_ord").alias("category"), F.collect_set("code").alias("codes"), F.bool_or(direct).alias("direct")).where("not direct")
    c = calls.groupBy("method_id").agg(F.array_sort(F.collect_list(F.struct("call_ord", "method_name", "expression"))).alias("calls"))
    m = methods.select(F.col("id").alias("method_id"), "class_name", "method_name", "file_path", F.col("start_line").alias("line"), "signature").where("signature <> ''")
    j = m.join(d, "method_id").join(c, "method_id")
    text = F.expr("CASE WHEN instr(signature, '(') > 0 AND length(signature) - instr(reverse(signature), ')') + 1 > instr(signature, '(') THEN substring(signature, instr(signature, '(') + 1, length(signature) - instr(reverse(signature), ')') - instr(signature, '(')) ELSE signature END")
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), r"\s+")), lambda p: F.size(p) >= 2)
    words = "abstract boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static super switch synchronized this throw throws transient true false try void volatile while".split()
    names = F.filter(F.transform(parts, lambda p: F.element_at(p, -1)), lambda n: n.rlike(r"^\p{Ll}") & ~F.lower(n).isin(words))
    # no name found between the brackets: any lower-case word of the signature that is no key word
    every = F.filter(F.regexp_extract_all("signature", F.lit(r"\b([a-z]\w*)\b"), 1), lambda n: ~F.lower(n).isin(words))
    j = j.withColumn("params", F.array_distinct(F.when(F.size(names) > 0, names).otherwise(every))).where(F.size("params") > 0)
    uses = lambda e: F.exists("params", lambda p: e.contains(p))
    text_work = F.exists("calls", lambda x: x["method_name"].isin(TEXT_WORK))
    plain = ~text_work & F.exists("codes", uses)
    through = F.exists("calls", lambda x: x["method_name"].isin(TEXT_WORK) & uses(x["expression"]) & F.exists("calls", lambda y: (y["call_ord"] > x["call_ord"]) & y["method_name"].isin(RUNNERS)))
    into = F.exists("calls", lambda x: (x["method_name"].isin(RUNNERS) | x["expression"].contains("ProcessBuilder") | x["expression"].contains("Runtime")) & uses(x["expression"]))
    j = j.where(~plain & (through | into))
    return j.select("method_id", "category", F.concat(F.lit("taint:"), "class_name", F.lit("."), "method_name").alias("api"), "file_path", "line", F.col("signature").alias("code"))
