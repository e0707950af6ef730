"""Calls to call edges: prioritised equi-joins on (class, method, arity) (J1-J3), nearest binding (J4), template sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut, skew_join
from ..functions.text import simple_name, unix_path

#: Methods that run an argument later; functional call names and types.
DEFERRED = "execute invokeAndWait invokeLater runAsync schedule scheduleAtFixedRate scheduleWithFixedDelay submit supplyAsync register registerTask addTask enqueue offer post".split()
FUNCTIONAL = "accept apply call run test".split()
FUNCTIONAL_TYPES = "BiConsumer BiFunction Callable Consumer Function Predicate Runnable Supplier".split()
TARGETS_PER_CALL = 12
#: Texts in a signature or class name, and in a call, that show that configuration is read.
CONFIG_READS = ["getProperty", "getString", "@Value", "@ConfigurationProperties", "environment.getProperty", "config.get", "props.get", "settings.get"]
CONFIG_CALLS = ["@Value", "@ConfigurationProperties", "environment.getProperty"]


def closure(pairs: DataFrame) -> DataFrame:
    """G1: transitive (parent, child) of (parent, child), cycle safe; NULL ends link nothing. Doubling: k joins reach 2^k levels."""
    all_ = cut(pairs.where("parent is not null and child is not null").select("parent", "child").distinct())
    n = all_.count()
    while True:
        step = all_.select(F.col("parent").alias("child"), F.col("child").alias("further"))
        more = skew_join(all_, step, "child").select("parent", F.col("further").alias("child"))
        all_ = cut(all_.unionByName(more).distinct())
        if (m := all_.count()) == n:
            return all_
        n = m


Project = Callable[[str], Column]


def _project(project: Project | None, path: str = "file_path") -> Column:
    return project(path) if project else F.lit("")


def resolve_calls(calls: DataFrame, methods: DataFrame, impls: DataFrame, refs: DataFrame, project: Project | None = None) -> tuple[DataFrame, DataFrame]:
    """edges(from_id, call_ord, edge_ord, to_id, line, expression, resolution) and unresolved(method_id, file_path, line, expression).

    Each rule is a join tagged with its priority; a rule counts for a call only if no rule before it gave a target, except that
    receiver-type, its implementations and same-class add up. The first resolution of a target wins; the first 12 targets of a call (by
    priority, then target order: class name and file) stay, as in the reference. Calls to one hot (class, method) spread by skew_join.
    project: from the path of a file to its project (calls, methods, impls and refs have file_path); names meet within a project only. None is one project.
    """
    named = lambda cls: F.struct(F.col("pj"), cls.alias("cls"))
    pj = _project(project).alias("pj")
    pairs = impls.where("parent is not null and child is not null").select(pj if project else F.lit("").alias("pj"), "parent", "child")
    closed = closure(pairs.select(named(F.col("parent")).alias("parent"), named(F.col("child")).alias("child")))
    c = calls.select("method_id", "class_name", "file_path", pj, "call_ord", "method_name", F.coalesce("receiver", F.lit("")).alias("receiver"), simple_name(F.coalesce("receiver_type", F.lit(""))).alias("type"), F.col("argument_count").cast("int").alias("argument_count"), "argument_types", "line", "expression")
    c = cut(c.withColumn("call_id", F.struct("method_id", "call_ord")))
    lower = F.col("receiver").rlike(r"^[^\p{Lu}\W\d]") & ~F.col("receiver").contains("(") & ~F.col("receiver").isin("this", "super")
    upper = F.col("receiver").rlike(r"^\p{Lu}")
    capital = F.concat(F.upper(F.substring("receiver", 1, 1)), F.expr("substring(receiver, 2)"))
    rule = lambda cond, priority, cls, name: F.when(cond, F.struct(F.lit(priority).alias("priority"), named(cls).alias("cls"), F.lit(name).alias("resolution")))
    want = F.array_compact(F.array(
        rule(F.col("type") != "", 0, F.col("type"), "receiver-type"), rule(F.col("receiver").isin("", "this", "super"), 2, F.col("class_name"), "same-class"), rule(upper, 3, simple_name("receiver"), "static-class-name"), rule(lower, 4, simple_name(capital), "field-name-type"),
    ))
    w = c.select("call_id", "method_name", "argument_count", F.inline(want))
    via = skew_join(w.where("priority in (0, 4)"), closed.select(F.col("parent").alias("cls"), F.col("child")), "cls")
    w = w.unionByName(via.select("call_id", "method_name", "argument_count", (F.col("priority") + 1).alias("priority"), F.col("child").alias("cls"), F.when(F.col("priority") == 0, "interface-implementation").otherwise("field-name-type").alias("resolution")))
    m = methods.select("*", pj).withColumns({"rank": F.struct("class_name", "file_path", "start_line", "id"), "n": F.col("parameter_count").cast("int")})
    target = m.select(F.struct(named(F.col("class_name")).alias("cls"), "method_name", "n").alias("key"), F.col("id").alias("to_id"), "rank")
    hit = skew_join(w.withColumn("key", F.struct("cls", "method_name", F.col("argument_count").alias("n"))), target, "key")
    # of the rules of a call only the leading block counts: 0-2 together, else 3, else 4-5
    block = F.when(F.col("priority") <= 2, 0).otherwise(F.when(F.col("priority") == 3, 1).otherwise(2))
    hit = cut(hit.select("call_id", block.alias("block"), "priority", "to_id", "rank", "resolution"))
    lead = hit.groupBy("call_id").agg(F.min("block").alias("block"))
    typed = hit.join(lead, ["call_id", "block"]).drop("block")
    untried = c.where((F.col("type") == "") & ~upper).join(lead.select("call_id"), "call_id", "left_anti")
    single = m.groupBy(F.struct("pj", "method_name", "n").alias("key")).agg(F.count("*").alias("many"), F.min("id").alias("to_id"), F.min("rank").alias("rank")).where("many = 1")
    alone = skew_join(untried.select("call_id", F.struct("pj", "method_name", F.col("argument_count").alias("n")).alias("key")), single, "key")
    typed = typed.unionByName(alone.select("call_id", F.lit(6).alias("priority"), "to_id", "rank", F.lit("unique-method-name-untyped").alias("resolution")))
    every = cut(typed.unionByName(_callbacks(c, m, refs.select("class_name", "name", pj))))
    first = every.groupBy("call_id", "to_id").agg(F.min(F.struct("priority", "rank", "resolution")).alias("r"))
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("r.priority", "r.rank"))
    kept = first.withColumn("place", place).where(F.col("place") <= TARGETS_PER_CALL)
    kept = kept.join(c.select("call_id", "line", "expression"), "call_id")
    edges = kept.select(F.col("call_id.method_id").alias("from_id"), F.col("call_id.call_ord").alias("call_ord"), (F.col("call_id.call_ord") * TARGETS_PER_CALL + F.col("place") - 1).cast("int").alias("edge_ord"), "to_id", "line", "expression", F.col("r.resolution").alias("resolution"))
    unresolved = c.join(every.select("call_id"), "call_id", "left_anti").select("method_id", "file_path", "line", "expression")
    return edges, unresolved


def _callbacks(c: DataFrame, methods: DataFrame, refs: DataFrame) -> DataFrame:
    """Tasks handed over as arguments, and method references run through a functional object. No arity check. Names meet within a project (pj)."""
    cls = lambda column: F.struct("pj", F.col(column).alias("class_name"))
    by_name = methods.select(F.struct(cls("class_name").alias("cls"), "method_name").alias("key"), F.col("id").alias("to_id"), "rank")
    runnable = by_name.where(F.col("key.method_name").isin("run", "call"))
    args = c.select("call_id", "pj", F.col("method_name").isin(DEFERRED).alias("deferred"), F.explode("argument_types").alias("arg")).where("arg <> ''").withColumn("arg", simple_name("arg"))
    keys = args.select("call_id", "deferred", F.explode(F.array(*[F.struct(cls("arg").alias("cls"), F.lit(m).alias("method_name")) for m in ("run", "call")])).alias("key"))
    ran = skew_join(keys, runnable, "key").select("call_id", F.lit(7).alias("priority"), "to_id", "rank", F.when(F.col("deferred"), "deferred-callback").otherwise("runnable-arg-callback").alias("resolution"))
    functional = c.where(F.col("method_name").isin(FUNCTIONAL) & (F.col("type").isin(FUNCTIONAL_TYPES) | F.col("receiver").contains("(")))
    pairs = refs.select(cls("class_name").alias("cls"), "name").distinct()
    named = skew_join(functional.select("call_id", cls("class_name").alias("cls")), pairs, "cls")
    keys = named.select("call_id", F.struct("cls", F.col("name").alias("method_name")).alias("key"))
    ref = skew_join(keys, by_name, "key").select("call_id", F.lit(8).alias("priority"), "to_id", "rank", F.lit("functional-method-reference").alias("resolution"))
    return ran.unionByName(ref)


def bind_nearest(entries: DataFrame, methods: DataFrame, line: str = "start_line") -> DataFrame:
    """Every entry with the method of the same file and name whose start line is nearest (ties: first in method order), method_id '' and
    binding_status UNRESOLVED if there is none. methods: (id, file_path, method_name, start_line, method_seq)."""
    e = entries.withColumn("_e", F.monotonically_increasing_id())
    e = cut(e)
    key = F.struct(unix_path("file_path").alias("f"), F.col("method_name").alias("m"))
    m = methods.select(key.alias("_key"), F.col("start_line").alias("_line"), F.col("method_seq").alias("_seq"), F.col("id").alias("_id"))
    best = skew_join(e.select("_e", F.col(line).alias("_at"), key.alias("_key")), m, "_key").groupBy("_e").agg(F.min_by("_id", F.struct(F.abs(F.col("_line") - F.col("_at")), "_seq")).alias("_id"))
    j = e.join(best, "_e", "left")
    return j.withColumn("method_id", F.coalesce("_id", F.lit(""))).withColumn("binding_status", F.when(F.col("_id").isNull(), "UNRESOLVED").otherwise("BOUND")).drop("_e", "_id")


def mapper_sinks(calls: DataFrame, statements: DataFrame, project: Project | None = None) -> DataFrame:
    """Calls on a mapper interface whose statement splices text in: (category, api, method_id, file_path, line, code). The last statement of an id (in its project) wins."""
    s = statements.groupBy(_project(project).alias("pj"), "mapper", "statement_id").agg(F.max_by("snippet", F.struct("file_path", "ord")).alias("code"))
    c = calls.select("method_id", "file_path", _project(project).alias("pj"), "line", simple_name("receiver_type").alias("mapper"), F.col("method_name").alias("statement_id"), "expression")
    return c.join(s, ["pj", "mapper", "statement_id"]).select(F.lit("SQL_EXECUTION").alias("category"), F.concat(F.lit("MyBatis ${}:"), "expression").alias("api"), "method_id", "file_path", "line", "code")


def template_sinks(methods: DataFrame, calls: DataFrame, templates: DataFrame, project: Project | None = None) -> DataFrame:
    """Methods that read configuration (by their signature, their class name or a call) and fill in a template: one COMMAND_EXECUTION sink each, at their first line, with the expression of
    their last replace, replaceAll or format call and the first template of the project (by file, then key)."""
    fill = calls.where(F.col("method_name").isin("replace", "replaceAll", "format")).groupBy("method_id").agg(F.max_by("expression", "call_ord").alias("code"))
    any_of = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    reads = calls.where(F.col("method_name").isin("getProperty", "getString") | any_of(F.coalesce("expression", F.lit("")), CONFIG_CALLS)).select("method_id").distinct()
    shown = F.concat_ws(" ", F.coalesce("signature", F.lit("")), F.coalesce("class_name", F.lit("")))
    annotated = methods.where(any_of(shown, CONFIG_READS)).select(F.col("id").alias("method_id"))
    first = templates.groupBy(_project(project, "config_file").alias("pj")).agg(F.min_by("key", F.struct("config_file", "key")).alias("template_key"))  # one row for each project
    at = methods.select(F.col("id").alias("method_id"), "file_path", _project(project).alias("pj"), F.col("start_line").alias("line"))
    hit = fill.join(reads.unionByName(annotated).distinct(), "method_id", "left_semi").join(at, "method_id").join(first, "pj")
    api = F.concat(F.lit("ConfigTemplate:"), "template_key", F.lit("→replace→exec"))
    return hit.select(F.lit("COMMAND_EXECUTION").alias("category"), api.alias("api"), "method_id", "file_path", "line", "code", "template_key")
