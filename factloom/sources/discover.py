"""Entry points from the parsed Java facts (S18-S23): joins and filters over classes, methods, annotations and calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entry_id, join_paths
from . import java_facts as jf

COLUMNS = ["protocol", "operations", "route", "class_name", "method_name", "file_path", "start_line", "framework", "security_annotations", "discovery_source", "confidence"]
#: Annotations that guard a method; that map HTTP; HTTP verbs by annotation; triggers and their protocols; classes of operation endpoints.
SECURITY = ["PreAuthorize", "Secured", "RolesAllowed", "PermitAll", "DenyAll"]
MAPPED = ["RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "ReadOperation", "WriteOperation", "DeleteOperation"]
VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
OPERATIONS = {"ReadOperation": "GET", "WriteOperation": "POST", "DeleteOperation": "DELETE"}
TRIGGERS = {"Scheduled": "scheduled", "KafkaListener": "message", "JmsListener": "message", "RabbitListener": "message", "EventListener": "event", "Async": "async"}
ENDPOINTS = ["Endpoint", "WebEndpoint", "ControllerEndpoint", "RestControllerEndpoint"]
PATHS = ["Path", "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping"]
SERVLET = {"doGet": "GET", "doPost": "POST", "doPut": "PUT", "doDelete": "DELETE", "doPatch": "PATCH", "service": "ANY"}
FIRST_LINES, DUBBO_LINES = 120, 60


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _quoted(annotations: Column | str, *names: str) -> Column:
    """The quoted values in the arguments of annotations with these names, in order, each once."""
    own = F.filter(annotations, lambda a: a["name"].isin(*names))
    return F.array_distinct(F.flatten(F.transform(own, lambda a: F.regexp_extract_all(F.coalesce(a["args"], F.lit("")), F.lit('"([^"]*)"'), 1))))


def _paths(annotations: Column | str, *names: str) -> Column:
    """The quoted values that are blank or begin with /; [''] if there are none."""
    found = F.filter(_quoted(annotations, *names), lambda x: (F.trim(x) == "") | x.startswith("/"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def _names(column: str) -> Column:
    return F.transform(column, lambda a: a["name"])


def _out(df: DataFrame, protocol, operations, route, framework, source: str, confidence="HIGH", guard: Column | None = None) -> DataFrame:
    guard = F.filter(_names("annotations"), lambda n: n.isin(SECURITY)) if guard is None else guard
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(text(protocol).alias("protocol"), operations.alias("operations"), text(route).alias("route"), "class_name", "method_name", "file_path", "start_line", text(framework).alias("framework"), guard.alias("security_annotations"), F.lit(source).alias("discovery_source"), text(confidence).alias("confidence"))


def _with_class(parsed: DataFrame) -> DataFrame:
    c = jf.classes(parsed).select("file_path", "class_name", "extends_name", "implements_names", F.col("annotations").alias("marks"))
    names = parsed.select(F.col("path").alias("file_path"), "imports")
    return jf.methods(parsed).join(c.dropDuplicates(["file_path", "class_name"]), ["file_path", "class_name"]).join(names, "file_path")


def _imports(first: int, *texts: str) -> Column:
    """Whether one of the texts occurs in the imports of a file's first lines."""
    return F.exists("imports", lambda i: (i["line"] <= first) & i["name"].rlike("|".join(t.replace(".", r"\.") for t in texts)))


def annotated_http(parsed: DataFrame) -> DataFrame:
    """Class paths x method paths x mapped methods; ANY if no annotation names a verb; classes of operation endpoints lie under /actuator/<id>."""
    m = _with_class(parsed).where(F.arrays_overlap(_names("annotations"), F.array(*map(F.lit, MAPPED))))
    framework = F.when(_imports(FIRST_LINES, "org.springframework.web.bind.annotation"), "spring-mvc").when(_imports(FIRST_LINES, "jakarta.ws.rs", "javax.ws.rs"), "jax-rs").otherwise("annotation-based")
    point = F.arrays_overlap(_names("marks"), F.array(*map(F.lit, ENDPOINTS)))
    ids = _quoted("marks", *ENDPOINTS)
    class_paths = F.when(~point, _paths("marks", "Path", "RequestMapping")).when(F.size(ids) > 0, F.transform(ids, lambda i: F.concat(F.lit("/actuator/"), i))).otherwise(F.array(F.lit("/actuator")))

    def verbs(a: Column) -> Column:
        n = a["name"]
        named = F.when(n.isin(VERBS), n).when(n.isin(*OPERATIONS), F.try_element_at(_map(OPERATIONS), n)).when(n.endswith("Mapping") & (n != "RequestMapping"), F.upper(F.regexp_replace(n, "Mapping$", "")))
        return F.when(n == "RequestMapping", F.regexp_extract_all(F.coalesce(a["args"], F.lit("")), F.lit(r"RequestMethod\.(\w+)"), 1)).otherwise(F.array_compact(F.array(named)))

    ops = F.array_distinct(F.flatten(F.transform("annotations", verbs)))
    h = m.select("*", F.when(F.size(ops) > 0, ops).otherwise(F.array(F.lit("ANY"))).alias("_ops"), F.when(point, "spring-actuator").otherwise(framework).alias("_fw"), F.explode(class_paths).alias("_c"))
    h = h.withColumn("_m", F.explode(_paths("annotations", *PATHS)))
    return _out(h, "HTTP", F.col("_ops"), join_paths("_c", "_m"), F.col("_fw"), "annotated-http")


def async_triggers(parsed: DataFrame) -> DataFrame:
    """Scheduled, message, event and async methods by their first such annotation, whose arguments are the route; protocols in lower case."""
    first = F.filter("annotations", lambda a: a["name"].isin(*TRIGGERS))
    m = jf.methods(parsed).where(F.size(first) > 0).withColumn("_a", F.get(first, 0))
    return _out(m, F.try_element_at(_map(TRIGGERS), F.col("_a.name")), F.array("_a.name"), F.coalesce("_a.args", F.lit("")), "spring-async", "async-trigger")


def servlets_and_lifecycle(parsed: DataFrame) -> DataFrame:
    """Servlet methods (of classes that extend or implement HttpServlet, else of WebServlet classes, with the quoted values of that annotation as route), filters and interceptors,
    sockets, remote services, start-up hooks. Methods without an annotation give nothing (as in the reference); one method can give several rows."""
    m = _with_class(parsed).where(F.size("annotations") > 0)
    has = lambda column, *n: F.arrays_overlap(_names(column), F.array(*map(F.lit, n)))
    implements = lambda *n: F.arrays_overlap("implements_names", F.array(*map(F.lit, n)))
    blank = F.lit("")
    one = lambda cond, p, o, fw, conf, route=blank: F.when(cond, F.struct(F.lit(p).alias("p"), F.lit(o).alias("o"), F.lit(fw).alias("fw"), F.lit(conf).alias("conf"), route.alias("route")))
    name, parent = F.col("method_name"), F.coalesce("extends_name", blank)
    servlet = ((parent == "HttpServlet") | implements("HttpServlet")) & name.isin(*SERVLET)
    fixed = F.coalesce("signature", blank).rlike(r"\b(?:static|abstract)\b")
    dubbo = lambda column: has(column, "DubboService") | has(column, "Service") & _imports(DUBBO_LINES, "org.apache.dubbo", "com.alibaba.dubbo")
    sockets = ["handleMessage", "handleTextMessage", "handleBinaryMessage", "afterConnectionEstablished"]
    kinds = F.array_compact(F.array(
        *[one(servlet & (name == k), "HTTP", v, "servlet", "HIGH") for k, v in SERVLET.items()], one(~servlet & has("marks", "WebServlet"), "HTTP", "ANY", "servlet", "HIGH", F.array_join(_quoted("marks", "WebServlet"), ",")),
        one(implements("Filter") & (name == "doFilter"), "HTTP_FILTER", "FILTER", "servlet", "HIGH"), one(implements("HandlerInterceptor") & (name == "preHandle"), "HTTP_FILTER", "INTERCEPTOR", "spring-mvc", "MEDIUM"),
        one(has("annotations", "ServerEndpoint") | implements("WebSocketHandler") & name.isin(sockets), "WEBSOCKET", "MESSAGE", "websocket", "HIGH"),
        one(parent.rlike(r"^\w+ImplBase$") & (name != F.col("class_name")) & ~fixed, "GRPC", "UNARY", "grpc", "MEDIUM"), one(dubbo("marks") | dubbo("annotations"), "RPC", "DUBBO", "dubbo", "MEDIUM"),
        one(implements("CommandLineRunner", "ApplicationRunner") & (name == "run"), "LIFECYCLE", "STARTUP", "spring-lifecycle", "LOW"), one(has("annotations", "PostConstruct"), "LIFECYCLE", "INIT", "spring-lifecycle", "LOW"),
    ))
    k = m.withColumn("_k", F.explode(kinds))
    return _out(k, F.col("_k.p"), F.array("_k.o"), F.col("_k.route"), F.col("_k.fw"), "servlet-and-lifecycle", F.col("_k.conf"))


def webflux_routes(parsed: DataFrame) -> DataFrame:
    """GET("..."), POST("..."), ... calls in files that import the reactive web package, with the method they stand in; MEDIUM, and no security annotations."""
    reactive = parsed.where(_imports(FIRST_LINES, "org.springframework.web.reactive")).select(F.col("path").alias("file_path"))
    c = jf.calls(parsed).where(F.col("method_name").isin("GET", "POST", "PUT", "DELETE", "PATCH") & F.get("argument_expressions", 0).rlike('^"')).join(reactive, "file_path", "left_semi")
    m = jf.methods(parsed).select(F.col("id").alias("method_id"), F.col("method_name").alias("holder"))
    j = c.join(m, "method_id").withColumns({"_op": F.col("method_name"), "method_name": F.col("holder"), "start_line": F.col("line")})
    return _out(j, "HTTP", F.array("_op"), F.regexp_extract(F.get("argument_expressions", 0), '^"([^"]*)"', 1), "webflux", "webflux-router", "MEDIUM", F.expr("cast(array() as array<string>)"))


#: Registry of discoverers; users may add their own Callable[[parsed], rows].
DISCOVERERS: dict[str, Callable[[DataFrame], DataFrame]] = {"annotated-http": annotated_http, "async-trigger": async_triggers, "servlet-and-lifecycle": servlets_and_lifecycle, "webflux-router": webflux_routes}


def discover(parsed: DataFrame, discoverers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All entry points, with `id`."""
    out = None
    for f in (discoverers or DISCOVERERS).values():
        rows = f(parsed).select(COLUMNS)
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("id", entry_id("protocol", "operations", "route", "class_name", "method_name", "file_path"))


def selectable(entries: DataFrame) -> DataFrame:
    """Protocols a user can select."""
    return entries.where(F.upper("protocol").isin("HTTP", "WEBSOCKET"))


def inventory(entries: DataFrame) -> DataFrame:
    """Selectable entries, one a id (the first by file and line), sorted by route, operations, file and line."""
    first = selectable(entries).groupBy("id").agg(F.min(F.struct("file_path", "start_line", "route", "operations", "protocol", "class_name", "method_name")).alias("r"))
    return first.select("id", "r.*").orderBy("route", "operations", "file_path", "start_line")


def select_entries(entries: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Entries that are not selectable, or whose id is wanted(id); no or an empty selection keeps all."""
    if wanted is None or wanted.isEmpty():
        return entries
    chosen = entries.join(wanted.select("id").distinct(), "id", "left_semi")
    return chosen.unionByName(entries.where(~F.upper("protocol").isin("HTTP", "WEBSOCKET"))).distinct()


def missing_ids(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """Wanted ids that no entry has; empty if the request is valid."""
    return wanted.select("id").distinct().join(entries.select("id"), "id", "left_anti")
