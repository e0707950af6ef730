"""Row-wise classification of calls, sinks, entry points and hunters.

Ordered rules are one CASE expression: evaluated inside a scan, no join and no shuffle. The conditions are SQL text over
m (method), x (select expression without arguments) and t (receiver type).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _has(where: str, *words: str) -> str:
    return f"regexp_like({where}, '{'|'.join(words)}')"


def _in(*words: str) -> str:
    return "m IN (" + ", ".join(f"'{w}'" for w in words) + ")"


_XT, _X, _T = "concat(lower(x), ' ', lower(t))", "lower(x)", "lower(t)"
_SIMPLE = "lower(regexp_replace(regexp_replace(t, '<.*', ''), '^.*[.$]', ''))"
#: Sink categories and their conditions, first match wins.
SINK_RULES = [
    ("COMMAND_EXECUTION", "m LIKE 'exec%' AND x LIKE '%Runtime%'"),
    ("COMMAND_EXECUTION", "m = 'start' AND (x LIKE '%ProcessBuilder%' OR t = 'ProcessBuilder')"),
    ("COMMAND_EXECUTION", _in("replace", "replaceAll") + " AND " + _has(_X, "bash", "sh ", "cmd", "exec", "processbuilder", "/bin/", "powershell", "python", "script", "shell")),
    (
        "SCRIPT_OR_EXPRESSION_EXECUTION",
        f"{_in('eval', 'executeExpression', 'parseExpression')} OR m = 'execute' AND ({_has(_X, 'mvel', 'compiled')} OR {_has(_T, 'mvel')})"
        f" OR {_in('evaluate', 'run', 'parseClass')} AND {_has(_XT, 'groovy', 'velocity', 'ognl', 'elprocessor')} OR m = 'process' AND {_has(_XT, 'template', 'freemarker')}"
        f" OR {_in('getValue', 'setValue', 'createValueExpression')} AND {_has(_XT, 'expression', 'ognl', 'elprocessor', 'spel')}",
    ),
    ("NATIVE_DESERIALIZATION", f"{_in('readObject', 'fromXML', 'enableDefaultTyping', 'activateDefaultTyping')} OR {_in('load', 'loadAll')} AND {_has(_XT, 'yaml')} OR {_in('parse', 'parseObject')} AND {_has(_XT, 'json')}"),
    (
        "DYNAMIC_LOADING",
        f"m = 'forName' AND {_SIMPLE} = 'class' OR m = 'loadClass' AND {_SIMPLE} LIKE '%classloader' OR m = 'defineClass' AND ({_SIMPLE} LIKE '%classloader' OR {_SIMPLE} = 'lookup')"
        f" OR m = 'invoke' AND {_SIMPLE} = 'method' OR m = 'newInstance' AND {_SIMPLE} IN ('class', 'constructor')",
    ),
    (
        "SQL_EXECUTION",
        f"{_in('createQuery', 'createNativeQuery', 'createSQLQuery')} AND {_has(_XT, 'entitymanager', 'session')} OR {_in('execute', 'executeQuery', 'executeUpdate', 'addBatch')} AND {_has(_XT, 'statement', 'query')}"
        f" OR {_in('batchUpdate', 'query', 'queryForList', 'queryForMap', 'queryForObject', 'update')} AND {_has(_XT, 'jdbctemplate')}",
    ),
    ("XML_PARSE", _in("parse", "parseText", "read") + " AND " + _has(_XT, "documentbuilder", "saxparser", "xmlreader", "saxbuilder", "saxreader", "dom4j", "xmlinputfactory")),
    ("HTTP_RESPONSE_WRITE", _in("append", "print", "println", "write") + " AND " + _has(_XT, "getwriter", "printwriter", "servletoutputstream")),
    ("HTTP_HEADER_WRITE", _in("addHeader", "setHeader") + " AND " + _has(_XT, "containerresponsecontext", "resp", "rsp")),
    ("HTTP_REDIRECT", "m = 'sendRedirect'"),
    ("JNDI_LOOKUP", f"m = 'lookup' AND {_has(_X, 'context', 'jndi')}"),
    ("FILE_WRITE", f"{_in('write', 'writeString', 'copy', 'move')} AND x LIKE 'Files.%' OR m = 'transferTo'"),
    ("OUTBOUND_HTTP", f"{_in('openConnection', 'send', 'sendAsync', 'exchange')} AND {_has(_X, 'http', 'resttemplate')}"),
    ("NATIVE_LIBRARY", f"{_in('load', 'loadLibrary')} AND x LIKE 'System.%'"),
]
#: Constructors that are sinks.
CONSTRUCTOR_SINKS = {
    "ProcessBuilder": "COMMAND_EXECUTION", "XMLDecoder": "NATIVE_DESERIALIZATION", "URLClassLoader": "DYNAMIC_LOADING", "RedirectView": "HTTP_REDIRECT",
    "FileOutputStream": "FILE_WRITE", "FileWriter": "FILE_WRITE", "RandomAccessFile": "FILE_WRITE",
}
#: Sink categories of each hunter, in hunter order.
HUNTERS = {
    "code_execution": ["COMMAND_EXECUTION", "SCRIPT_OR_EXPRESSION_EXECUTION", "NATIVE_LIBRARY"], "sql_injection": ["SQL_EXECUTION"], "unsafe_parsing": ["NATIVE_DESERIALIZATION", "DYNAMIC_LOADING", "XML_PARSE"], "ssrf": ["OUTBOUND_HTTP"],
    "file_operations": ["FILE_WRITE"], "http_output": ["HTTP_RESPONSE_WRITE", "HTTP_HEADER_WRITE", "HTTP_REDIRECT"], "authorization": ["SERVLET_ENTRY", "FILTER_ENTRY"], "component_vulns": ["ACTUATOR_ENDPOINT", "JNDI_LOOKUP"],
}
_READ, _WRITE = "find|get|read|load|query|select|fetch|poll|scan", "save|insert|update|write|put|set|persist|merge"
#: Method names worth a second look.
SUSPICIOUS = "exec execute run eval invoke parse load send query process call dispatch resolve lookup deserialize unmarshal decode".split()


def sink_case(method: str, expression: str, receiver_type: str) -> str:
    """SQL CASE of the sink rules over three SQL expressions; NULL if none matches."""
    names = {"m": f"coalesce({method}, '')", "x": f"coalesce({expression}, '')", "t": f"coalesce({receiver_type}, '')"}
    put = lambda c: re.sub(r"'[^']*'|\b[mxt]\b", lambda k: names.get(k.group(), k.group()), c)
    return "CASE " + " ".join(f"WHEN {put(c)} THEN '{k}'" for k, c in SINK_RULES) + " END"


def classify_calls(calls: DataFrame, extra_rules: DataFrame | None = None) -> DataFrame:
    """Calls with a sink `category`, the others left out. x is receiver.method; extra_rules(rule_ord, method_pattern, receiver_pattern,
    category) apply last, lowest rule_ord first; at most 200 of them are used (the reference's bound), so they are broadcast."""
    x = F.when(F.coalesce("receiver", F.lit("")) == "", F.col("method_name")).otherwise(F.concat("receiver", F.lit("."), "method_name"))
    c = calls.withColumn("api", x).withColumn("category", F.expr(sink_case("method_name", "api", "receiver_type")))
    made = F.create_map(*[F.lit(v) for kv in CONSTRUCTOR_SINKS.items() for v in kv])
    c = c.withColumn("category", F.coalesce("category", F.when(F.col("method_name") == "<init>", F.try_element_at(made, F.col("receiver_type")))))
    if extra_rules is not None:
        rules = F.broadcast(extra_rules.orderBy("rule_ord").limit(200))
        hit = (F.col("method_name") == F.col("method_pattern")) & F.lower("receiver_type").contains(F.col("receiver_pattern"))
        open_ = c.where("category is null").drop("category").join(rules, hit)
        first = Window.partitionBy("method_id", "call_ord").orderBy("rule_ord")
        more = open_.withColumn("_n", F.row_number().over(first)).where("_n = 1")
        c = c.where("category is not null").unionByName(more.select(c.columns))
    return c.where("category is not null")


def structural_sinks(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(category, method_id, file_path, line) for actuator operations, servlet methods and filters."""
    c = classes.select("file_path", "class_name", "extends_name", "implements_names", F.transform("annotations", lambda a: a["name"]).alias("marks"))
    m = methods.select(F.col("id").alias("method_id"), "file_path", "class_name", "method_name", F.col("start_line").alias("line"), F.transform("annotations", lambda a: a["name"]).alias("own"))
    j = m.join(c, ["file_path", "class_name"])
    actuator = F.exists("marks", lambda x: x.endswith("Endpoint")) & F.arrays_overlap("own", F.array(*map(F.lit, ["ReadOperation", "WriteOperation", "DeleteOperation"])))
    servlet = (F.col("extends_name") == "HttpServlet") & F.col("method_name").isin("doGet", "doPost", "doPut", "doDelete", "service")
    filt = F.array_contains("implements_names", "Filter") & (F.col("method_name") == "doFilter")
    kinds = F.array_compact(F.array(F.when(actuator, F.lit("ACTUATOR_ENDPOINT")), F.when(servlet, F.lit("SERVLET_ENTRY")), F.when(filt, F.lit("FILTER_ENTRY"))))
    return j.select(F.explode(kinds).alias("category"), "method_id", "file_path", "line")


STORE_WORDS = ("repository", "mapper", "dao", "entitymanager", "jdbctemplate", "redistemplate", "mongo", "consumer")


def storage_sql(method: str, receiver: str, receiver_type: str) -> tuple[str, str]:
    """P3 as SQL: (kind READ / WRITE or NULL, storage key). Writes are tested before reads."""
    where = f"lower(concat(coalesce({receiver_type}, ''), ' ', coalesce({receiver}, '')))"
    store = f"({_has(where, *STORE_WORDS)} OR lower(coalesce({receiver_type}, '')) LIKE '%cache%')"
    test = lambda words: "(" + " OR ".join(f"{method} LIKE '{w}%'" for w in words.split("|")) + ")"
    kind = f"CASE WHEN {store} AND {test(_WRITE)} THEN 'WRITE' WHEN {store} AND {test(_READ)} THEN 'READ' END"
    root = f"regexp_replace({receiver}, '[.(].*', '')"
    return kind, f"CASE WHEN coalesce({receiver_type}, '') <> '' THEN {receiver_type} ELSE {root} END"


def storage_accesses(calls: DataFrame) -> DataFrame:
    """Reads and writes of stores among calls, with key and value type (the last typed argument of a write)."""
    kind, key = storage_sql("method_name", "receiver", "receiver_type")
    value = F.element_at(F.filter(F.concat(F.array(F.lit("")), "argument_types"), lambda x: x != F.lit("")), -1)
    s = calls.withColumn("kind", F.expr(kind)).where("kind is not null")
    return s.select("method_id", "call_ord", "file_path", "line", "kind", F.expr(key).alias("storage_key"), "receiver_type", F.col("method_name").alias("operation"), "expression", F.coalesce(F.when(F.exists("argument_types", lambda x: x != ""), value), F.lit("")).alias("value_type"))


def protocol_side(protocol: Column | str) -> Column:
    """External, internal or unknown; NULL is unknown."""
    p = F.upper(protocol)
    return F.when(p.isin("HTTP", "MESSAGE", "WEBSOCKET"), "external").when(p.isin("LIFECYCLE", "SCHEDULED", "INIT", "EVENT", "ASYNC"), "internal").otherwise("unknown")


def hunter_table(spark) -> DataFrame:
    """(hunter, hunter_ord, category): a fixed table of under 20 rows."""
    return spark.createDataFrame([(h, i, c) for i, (h, cs) in enumerate(HUNTERS.items()) for c in cs], "hunter string, hunter_ord int, category string")


def for_hunters(rows: DataFrame, category: str = "category") -> DataFrame:
    """Rows repeated for each hunter that looks at their category; unknown categories go to none."""
    h = hunter_table(rows.sparkSession).withColumnRenamed("category", "_category")
    return rows.join(F.broadcast(h), rows[category] == F.col("_category")).drop("_category")


def schedule_hunters(available: DataFrame, signals: DataFrame) -> DataFrame:
    """(hunter, boosted, run_order) of the available hunters: boosted ones first, each half in hunter order. signals: one row with
    orm, dependencies (arrays of lower-case names). Fixed size: at most one row a hunter."""
    order = available.sparkSession.createDataFrame([(h, i) for i, h in enumerate(HUNTERS)], "hunter string, hunter_ord int")
    dep = lambda *w: F.exists("dependencies", lambda d: F.lit(False) | F.lower(d).rlike("|".join(w)))
    boost = (
        F.col("hunter").isin("code_execution", "authorization") | (F.col("hunter") == "sql_injection") & (F.size("orm") > 0)
        | (F.col("hunter") == "component_vulns") & dep("h2", "log4j", "actuator") | (F.col("hunter") == "unsafe_parsing") & dep("fastjson", "xstream", "snakeyaml")
    )
    r = available.join(F.broadcast(order), "hunter").crossJoin(F.broadcast(signals.select("orm", "dependencies").limit(1))).withColumn("boosted", boost)
    return r.select("hunter", "boosted", F.row_number().over(Window.orderBy(F.desc("boosted"), "hunter_ord")).alias("run_order"))


def suspicious_calls(calls: DataFrame, sinks: DataFrame, classes: DataFrame, most: int | None = 200, project=None) -> DataFrame:
    """P10: (receiver_type, method_name, file_path, line, method_id, expression) of calls to foreign types whose name suggests danger and that are no
    sink yet; the first of each type and name in a project. most: of each project only so many, in order of file, line and ordinal (the reference's bound);
    None keeps all. project: from the path of a file to its project; None is one project."""
    pj = (project("file_path") if project else F.lit("")).alias("pj")
    c = calls.where(F.lower("method_name").isin(SUSPICIOUS) & (F.coalesce("receiver_type", F.lit("")) != "")).withColumn("pj", pj)
    c = c.join(sinks.select("method_id", "line").distinct(), ["method_id", "line"], "left_anti")
    c = c.join(classes.select(pj, F.col("class_name").alias("receiver_type")).distinct(), ["pj", "receiver_type"], "left_anti")
    first = c.groupBy("pj", "receiver_type", "method_name").agg(F.min(F.struct("file_path", "line", "call_ord", "method_id", "expression")).alias("f")).select("pj", "receiver_type", "method_name", "f.*")
    if most is not None:
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy("pj").orderBy("file_path", "line", "call_ord"))).where(F.col("_n") <= most).drop("_n")
    return first.drop("pj", "call_ord")


#: Categories that an answer may name.
KNOWN_CATEGORIES = [
    "COMMAND_EXECUTION", "SCRIPT_OR_EXPRESSION_EXECUTION", "NATIVE_DESERIALIZATION", "DYNAMIC_LOADING", "SQL_EXECUTION", "XML_PARSE", "HTTP_RESPONSE_WRITE", "HTTP_HEADER_WRITE", "HTTP_REDIRECT", "JNDI_LOOKUP", "FILE_WRITE",
    "OUTBOUND_HTTP", "NATIVE_LIBRARY",
]


def rule_items(text: str | None) -> list[tuple[str, str, str]]:
    """(methodName, receiverType, category) of the JSON array in an answer; absent fields are blank. An object's text field `result` is read in its place; then the first
    fenced block that begins an array counts, else what lies between the first [ and the last ]. An item that is no flat object voids the answer."""
    text = text or ""
    try:
        whole = json.loads(text)
        text = str(whole["result"]) if isinstance(whole, dict) and "result" in whole else text
    except ValueError:
        pass
    fenced = [b.strip() for b in re.findall(r"```(?:json)?\s*([\s\S]*?)\s*```", text, re.I) if b.strip().startswith("[")]
    body = fenced[0] if fenced else text[text.find("[") : text.rfind("]") + 1] if "[" in text else ""
    try:
        items = json.loads(body)
    except (ValueError, RecursionError):
        return []
    if not isinstance(items, list) or any(not isinstance(x, dict) or any(isinstance(v, (dict, list)) for v in x.values()) for x in items):
        return []
    return [tuple("" if x.get(k) is None else str(x[k]).strip() for k in ("methodName", "receiverType", "category")) for x in items]


def answer_rules(answers: DataFrame, order: str, text: str = "text", fold_case: bool = True) -> DataFrame:
    """J10, rule parse: (rule_ord, method_pattern, receiver_pattern, category) of answer texts, distinct, in order of `order` and place.

    Blank methods or receivers and unknown categories are left out; receivers are in lower case, categories in upper case if fold_case (as for rules; for reviewed calls they must be exact).
    classify_calls() uses the first 200. NULL texts and texts without an array give nothing.
    """

    @F.pandas_udf("array<struct<method:string,receiver:string,category:string>>")
    def items(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"method": m, "receiver": r, "category": c} for m, r, c in rule_items(t)] for t in texts], dtype=object)

    rows = answers.select(F.col(order).alias("_o"), F.posexplode(items(text)).alias("_p", "i"))
    category = F.upper("i.category") if fold_case else F.col("i.category")
    r = rows.select("_o", "_p", F.col("i.method").alias("method_pattern"), F.lower("i.receiver").alias("receiver_pattern"), category.alias("category"))
    r = r.where((F.col("method_pattern") != "") & (F.col("receiver_pattern") != "") & F.col("category").isin(KNOWN_CATEGORIES))
    return r.groupBy("method_pattern", "receiver_pattern", "category").agg(F.min(F.struct("_o", "_p")).alias("rule_ord")).select("rule_ord", "method_pattern", "receiver_pattern", "category")


def reviewed_sinks(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_ord, category, api, method_id, file_path, line, code) of the reviewed calls that an answer names: equal method, and a receiver type (in lower case) that contains the answer's."""
    lower = F.lower("receiver_type")
    j = calls.join(rules, calls["method_name"] == rules["method_pattern"]).where(F.contains(lower, F.col("receiver_pattern")))
    return j.select("rule_ord", "category", F.concat(lower, F.lit("."), "method_name").alias("api"), "method_id", "file_path", "line", F.col("expression").alias("code"))
