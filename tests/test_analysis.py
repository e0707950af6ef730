"""Inline Java projects through the parser, the resolver and the whole analysis."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import classify, resolve, taint
from factloom.plans.pipeline import analyze
from factloom.sources import discover as disc
from factloom.sources import java_facts as jf
from factloom.sources import scanners

HOP = {
    "a/RunController.java": """package a;
import org.springframework.web.bind.annotation.*;
@RestController
@RequestMapping("/api")
public class RunController {
    private Launcher launcher;
    @PostMapping({"/run", "/go"})
    public String run(String name) { return launcher.launch(name); }
}""",
    "a/Launcher.java": "package a;\npublic interface Launcher { String launch(String name); }",
    "a/ShellLauncher.java": """package a;
public class ShellLauncher implements Launcher {
    private Worker worker;
    public String launch(String name) { worker.execute(String.format("sh %s", name)); return name; }
}""",
    "a/Worker.java": """package a;
public class Worker {
    public void execute(String cmd) throws Exception { Runtime.getRuntime().exec(cmd); }
}""",
    "a/Saver.java": """package a;
public class Saver {
    private JobRepository jobRepository;
    @PostMapping("/save")
    public void keep(String text) { jobRepository.save(new Job(text)); }
}""",
    "a/Nightly.java": """package a;
public class Nightly {
    private JobRepository jobRepository;
    @Scheduled(fixedDelay = 10)
    public void nightly() throws Exception { Job j = jobRepository.findNext(); Runtime.getRuntime().exec(j.text()); }
}""",
}


def files(spark, project):
    return spark.createDataFrame([(k, v) for k, v in project.items()], "path string, content string")


@pytest.fixture(scope="module")
def result(spark):
    return analyze(files(spark, HOP))


def test_path_through_an_interface(result):
    rows = [r for r in result.candidates.collect() if r.protocol == "HTTP" and len(r.path) == 3]
    names = [[p.split("#")[0] for p in r.path] for r in rows]
    assert ["RunController", "ShellLauncher", "Worker"] in names
    r = rows[names.index(["RunController", "ShellLauncher", "Worker"])]
    assert r.source_classification == "REQUEST_CONTROLLED" and r.static_confidence == "HIGH" and r.taint_confidence in ("CONFIRMED", "LIKELY")


def test_stored_flow_meets_the_scheduled_read(result):
    rows = result.stored.collect()
    assert len(rows) == 1 and rows[0].correlation == "MEDIUM" and rows[0].storage_key == "JobRepository"


def test_entry_points(result):
    rows = {(r.protocol, r.route, tuple(r.operations)) for r in result.entries.collect()}
    assert ("HTTP", "/api/run", ("POST",)) in rows and ("HTTP", "/api/go", ("POST",)) in rows and ("scheduled", "fixedDelay = 10", ("Scheduled",)) in rows
    assert result.entries.where("binding_status <> 'BOUND'").count() == 0


def test_selection_keeps_only_the_wanted_route(spark, result):
    e = result.entries
    wanted = e.where("route = '/api/go'").select("id")
    assert {r.route for r in disc.selectable(disc.select_entries(e, wanted)).collect()} == {"/api/go"}
    assert disc.select_entries(e, wanted.limit(0)).count() == e.count()
    assert disc.missing_ids(spark.createDataFrame([("no",)], "id string"), e).count() == 1
    inv = disc.inventory(e).collect()
    assert [r.route for r in inv] == sorted(r.route for r in inv) and all(len(r.id) == 24 for r in inv)


def test_empty_project(spark):
    r = analyze(spark.createDataFrame([], "path string, content string"))
    assert r.candidates.count() == 0 and {x.n for x in r.coverage.collect()} == {0}


CALL = "method_id string, class_name string, file_path string, call_ord int, method_name string, receiver string, receiver_type string, argument_count int, argument_types array<string>, argument_expressions array<string>, line int, expression string"
METHOD = "id string, class_name string, method_name string, parameter_count int, file_path string, start_line int"


def edges_of(spark, calls, methods, impls=(), refs=()):
    c = spark.createDataFrame([("m0", "Caller", "f", i, n, r, t, k, [""] * k if a is None else a, [], 1, f"{r}.{n}()") for i, (n, r, t, k, a) in enumerate(calls)], CALL)
    m = spark.createDataFrame([(f"{c}#{n}/{k}", c, n, k, "f", i) for i, (c, n, k) in enumerate(methods)], METHOD)
    e, u = resolve.resolve_calls(c, m, spark.createDataFrame(list(impls), "parent string, child string"), spark.createDataFrame(list(refs), "class_name string, name string"))
    return {(r.to_id, r.resolution) for r in e.collect()}, u.count()


def test_arity_picks_the_implementation(spark):
    got, n = edges_of(spark, [("save", "store", "Store", 1, None)], [("A", "save", 1), ("B", "save", 2)], [("Store", "A"), ("Store", "B")])
    assert got == {("A#save/1", "interface-implementation")} and n == 0


def test_untyped_receivers(spark):
    assert edges_of(spark, [("go", "x", "", 1, None)], [("A", "go", 2)]) == (set(), 1)
    assert edges_of(spark, [("go", "x", "", 1, None)], [("A", "go", 1)])[0] == {("A#go/1", "unique-method-name-untyped")}
    assert edges_of(spark, [("go", "x", "Other", 1, None)], [("A", "go", 1)]) == (set(), 1)  # a typed lookup blocks the fallback
    assert edges_of(spark, [("go", "service", "", 0, None)], [("Service", "go", 0), ("Z", "go", 0)])[0] == {("Service#go/0", "field-name-type")}
    assert edges_of(spark, [("go", "Tool", "", 0, None)], [("Tool", "go", 0)])[0] == {("Tool#go/0", "static-class-name")}
    assert edges_of(spark, [("go", "", "", 0, None)], [("Caller", "go", 0)])[0] == {("Caller#go/0", "same-class")}


def test_callbacks_and_the_cap(spark):
    got, _ = edges_of(spark, [("submit", "pool", "Pool", 1, ["Task"])], [("Task", "run", 0)])
    assert got == {("Task#run/0", "deferred-callback")}
    got, _ = edges_of(spark, [("handle", "x", "Y", 1, ["Task"])], [("Task", "call", 3)])
    assert got == {("Task#call/3", "runnable-arg-callback")}
    got, _ = edges_of(spark, [("accept", "f", "Consumer", 1, None)], [("Caller", "sink", 4)], refs=[("Caller", "sink")])
    assert got == {("Caller#sink/4", "functional-method-reference")}
    got, _ = edges_of(spark, [("go", "s", "S", 0, None)], [(f"I{i:02d}", "go", 0) for i in range(20)], [("S", f"I{i:02d}") for i in range(20)])
    assert {t for t, _ in got} == {f"I{i:02d}#go/0" for i in range(12)}


def test_parser_on_many_shapes():
    x = jf.parse_text("p/T.java", """package p; import java.util.*;
        /* class No {} */ public final class T<K extends Map<String, List<K>>> extends Base implements A, B.C {
          private final Map<String, List<Integer>> map = new HashMap<>(4); int a, b = f("x)");
          @Deprecated public T(int n) { super(n); this.a = n; }
          abstract void none();
          @GetMapping(value = "/x", produces = {"a"}) public <R> R get(final String s, int... more) throws E { String t = s.trim(); Runnable r = () -> t.length(); list.stream().map(T::of).toList(); return new Inner(t).go(more[0], "a,b"); }
          static class Inner { Inner(String q) {} void go(int i, String j) { for (Foo f : foos) { f.bar(); } } }
          enum E2 { X(1) { void y() {} }, Z; void m() { } }
          record Rec(int u, String v) { int w() { return u; } } }""")  # fmt: skip
    names = [(m["class_name"], m["method_name"], m["parameter_count"]) for m in x["methods"]]
    assert ("T", "<init>", 1) in names and ("T", "get", 2) in names and ("Inner", "go", 2) in names and ("E2", "m", 0) in names and ("Rec", "w", 0) in names and ("T", "none", 0) not in names
    get = next(m for m in x["methods"] if m["method_name"] == "get")
    assert get["annotations"][0]["name"] == "GetMapping" and get["method_refs"] == ["of"] and get["parameter_names"] == ["s", "more"]
    calls = {(c["method_name"], c["receiver"], c["receiver_type"], c["argument_count"]) for c in get["calls"]}
    assert ("trim", "s", "String", 0) in calls and ("length", "t", "String", 0) in calls and ("<init>", "", "Inner", 1) in calls and any(c[0] == "go" and c[3] == 2 for c in calls)
    t = next(c for c in x["classes"] if c["class_name"] == "T")
    assert t["extends_name"] == "Base" and t["implements_names"] == ["A", "C"]
    go = next(m for m in x["methods"] if m["method_name"] == "go")
    assert go["variable_types"]["f"] == "Foo" and go["calls"][0]["receiver_type"] == "Foo"


@pytest.mark.parametrize("text", [None, "", "}}}", "class", "class A {", "class A { void f( }", "@", "package", "class A { int x = ", '"unclosed'])
def test_parser_survives_damage(text):
    jf.parse_text("p/X.java", text)


def test_many_files_and_reading_a_folder(spark, tmp_path):
    for i in range(140):
        p = tmp_path / f"d{i % 7}"
        p.mkdir(exist_ok=True)
        (p / f"C{i}.java").write_text(f"class C{i} {{ void a() {{}} void b() {{}} }}")
    (tmp_path / "x.txt").write_text("class No { void a() {} }")
    f = jf.read_java(spark, str(tmp_path))
    p = jf.parse_files(f)
    assert jf.methods(p).count() == 280 and jf.diagnostics(p).count() == 0
    assert f.where(F.col("path") == "d0/C0.java").count() == 1


@pytest.mark.parametrize(
    "m,x,t,want",
    [
        ("exec", "Runtime.getRuntime().exec", "Runtime", "COMMAND_EXECUTION"), ("exec", "runtime.exec", "", None), ("start", "pb.start", "ProcessBuilder", "COMMAND_EXECUTION"), ("start", "job.start", "Job", None), ("replace", "script.replace", "String", "COMMAND_EXECUTION"),
        ("replace", "name.replace", "String", None), ("eval", "e.eval", "", "SCRIPT_OR_EXPRESSION_EXECUTION"), ("readObject", "in.readObject", "", "NATIVE_DESERIALIZATION"), ("load", "yaml.load", "", "NATIVE_DESERIALIZATION"), ("load", "System.load", "", "NATIVE_LIBRARY"),
        ("forName", "Class.forName", "java.lang.Class<?>", "DYNAMIC_LOADING"), ("forName", "Charset.forName", "Charset", None), ("loadClass", "l.loadClass", "a.URLClassLoader", "DYNAMIC_LOADING"), ("executeQuery", "a.executeQuery", "", "SQL_EXECUTION"), ("update", "x.update", "JdbcTemplate", "SQL_EXECUTION"),
        ("update", "x.update", "Digest", None), ("parse", "b.parse", "DocumentBuilder", "XML_PARSE"), ("write", "r.getWriter().write", "", "HTTP_RESPONSE_WRITE"), ("setHeader", "resp.setHeader", "", "HTTP_HEADER_WRITE"), ("lookup", "context.lookup", "", "JNDI_LOOKUP"), ("write", "Files.write", "Files", "FILE_WRITE"),
        ("exchange", "restTemplate.exchange", "", "OUTBOUND_HTTP"), ("sendRedirect", "r.sendRedirect", "", "HTTP_REDIRECT"), ("foo", "a.foo", "B", None), (None, None, None, None),
    ],
)
def test_sink_rules(spark, m, x, t, want):
    d = spark.createDataFrame([(m, x, t)], "a string, b string, c string")
    assert d.select(F.expr(classify.sink_case("a", "b", "c"))).first()[0] == want


def test_storage_rules_and_extra_rules(spark):
    c = spark.createDataFrame([("m", "C", "f", 0, "save", "orderRepository", "", 1, ["Order"], [], 1, "e"), ("m", "C", "f", 1, "get", "x", "LocalCache", 0, [], [], 1, "e"), ("m", "C", "f", 2, "get", "cache", "Map", 0, [], [], 1, "e"), ("m", "C", "f", 3, "zap", "gun", "RayGun", 0, [], [], 1, "e")], CALL)
    assert {(r.call_ord, r.kind, r.storage_key, r.value_type) for r in classify.storage_accesses(c).collect()} == {(0, "WRITE", "orderRepository", "Order"), (1, "READ", "LocalCache", "")}
    extra = spark.createDataFrame([(2, "zap", "gun", "B"), (1, "zap", "ray", "A")], "rule_ord int, method_pattern string, receiver_pattern string, category string")
    assert [(r.call_ord, r.category) for r in classify.classify_calls(c, extra).collect()] == [(3, "A")]


def test_structural_sinks_hunters_and_protocols(spark):
    p = jf.parse_files(files(spark, {"S.java": "class S extends HttpServlet { void doGet(A a) {} } class F implements Filter { void doFilter() {} } @Endpoint(id = \"x\") class E { @WriteOperation void w() {} }"}))
    assert {r.category for r in classify.structural_sinks(jf.methods(p), jf.classes(p)).collect()} == {"SERVLET_ENTRY", "FILTER_ENTRY", "ACTUATOR_ENDPOINT"}
    act = [r for r in disc.annotated_http(p).collect()]
    assert [(r.route, r.operations) for r in act] == [("/actuator/x", ["POST"])]
    d = spark.createDataFrame([("http",), ("Scheduled",), ("GRPC",), (None,)], "p string")
    assert [r[0] for r in d.select(classify.protocol_side("p")).collect()] == ["external", "internal", "unknown", "unknown"]
    k = spark.createDataFrame([("SQL_EXECUTION",), ("ODD",), (None,)], "category string")
    assert [r.hunter for r in classify.for_hunters(k).collect()] == ["sql_injection"]
    h = spark.createDataFrame([(x,) for x in classify.HUNTERS], "hunter string")
    sig = spark.createDataFrame([(["mybatis"], ["org.yaml:snakeyaml"])], "orm array<string>, dependencies array<string>")
    order = [r.hunter for r in classify.schedule_hunters(h, sig).orderBy("run_order").collect()]
    assert order[:4] == ["code_execution", "sql_injection", "unsafe_parsing", "authorization"] and len(order) == 8


def test_servlet_async_and_webflux_discovery(spark):
    p = jf.parse_files(files(spark, {
        "A.java": "import org.springframework.web.reactive.function.server.RouterFunctions; class R { X routes() { return route(GET(\"/w\"), this::h); } }",
        "B.java": "class L { @KafkaListener(topics = \"t\") void on(String m) {} @Async void go() {} @PostConstruct void init() {} } class W extends HttpServlet { @Override void doPost(A a) {} void doGet(A a) {} }",
    }))
    got = {(r.protocol, r.method_name, r.confidence) for r in disc.discover(p).collect()}
    assert got == {("HTTP", "routes", "MEDIUM"), ("message", "on", "HIGH"), ("async", "go", "HIGH"), ("LIFECYCLE", "init", "LOW"), ("HTTP", "doPost", "HIGH")}


def test_servlet_kinds(spark):
    p = jf.parse_files(files(spark, {
        "A.java": "import com.alibaba.dubbo.config.X;\n@WebServlet(urlPatterns = {\"/a\", \"/b\"}) class W { @Deprecated void any() {} }\nclass H implements HttpServlet { @Override void doPatch() {} }\n@Service class D { @PermitAll @Secured(\"x\") void call() {} void bare() {} }\n",
        "B.java": "class G extends PingImplBase { @Override void ping() {} @Override static void no() {} }\nclass I implements HandlerInterceptor { @Override boolean preHandle() { return true; } @Override void postHandle() {} }\nclass S implements WebSocketHandler { @Override void handleMessage() {} @ServerEndpoint(\"/s\") void on() {} }\nclass R implements CommandLineRunner { @Override void run() {} }\n@Service class N { @Async void x() {} }\n",
        "C.java": "import org.springframework.web.bind.annotation.GetMapping;\n@RequestMapping({\"/x\", \"y\"}) class C { @GetMapping(\"/g\") @PostMapping void g() {} @RequestMapping(method = {RequestMethod.PUT, RequestMethod.GET}, value = \"/h/\") void h() {} @MessageMapping(\"/m\") void m() {} }\n",
    }))
    got = {(r.class_name, r.method_name, r.protocol, tuple(r.operations), r.route, r.framework, r.confidence, tuple(r.security_annotations)) for r in disc.discover(p).collect()}
    assert got == {
        ("W", "any", "HTTP", ("ANY",), "/a,/b", "servlet", "HIGH", ()), ("H", "doPatch", "HTTP", ("PATCH",), "", "servlet", "HIGH", ()), ("D", "call", "RPC", ("DUBBO",), "", "dubbo", "MEDIUM", ("PermitAll", "Secured")),
        ("G", "ping", "GRPC", ("UNARY",), "", "grpc", "MEDIUM", ()), ("I", "preHandle", "HTTP_FILTER", ("INTERCEPTOR",), "", "spring-mvc", "MEDIUM", ()), ("S", "handleMessage", "WEBSOCKET", ("MESSAGE",), "", "websocket", "HIGH", ()), ("S", "on", "WEBSOCKET", ("MESSAGE",), "", "websocket", "HIGH", ()),
        ("R", "run", "LIFECYCLE", ("STARTUP",), "", "spring-lifecycle", "LOW", ()), ("N", "x", "async", ("Async",), "", "spring-async", "HIGH", ()),
        ("C", "g", "HTTP", ("GET", "POST"), "/x/g", "spring-mvc", "HIGH", ()), ("C", "h", "HTTP", ("PUT", "GET"), "/x/h", "spring-mvc", "HIGH", ()),
    }


def test_config_scanners(spark):
    f = files(spark, {
        "a.yml": "job:\n  run:\n    line: \"bash -c ${cmd} ${arg}\"\n  other: plain ${x}\nnext: python ${y}\n", "b.properties": "# c=bash ${n}\nrun.it = sh /bin/x ${a}\nno=thing\n", "c.xml": "<m><cmd>exec ${q}</cmd><p value=\"cmd ${r}\"/><p other=\"cmd ${z}\"/></m>", "n.xml": None,
    })
    y = {(r.key, tuple(r.placeholders)) for r in scanners.yaml_templates(f.where("path = 'a.yml'")).collect()}
    assert y == {("job.run.line", ("cmd", "arg")), ("next", ("y",))}
    assert [(r.key, r.template_value) for r in scanners.properties_templates(f.where("path = 'b.properties'")).collect()] == [("run.it", "sh /bin/x ${a}")]
    assert {(r.key, r.template_value) for r in scanners.xml_templates(f).collect()} == {("cmd", "exec ${q}"), ("attribute", "cmd ${r}")}
    pom = files(spark, {"pom.xml": "<dependency><groupId> g </groupId><artifactId>a</artifactId><version>1</version></dependency>" * 2 + "<dependency><groupId>x</groupId></dependency>"})
    assert [(r.group_id, r.artifact_id, r.version) for r in scanners.maven_dependencies(pom).orderBy("ord").collect()] == [("g", "a", "1")] * 2 + [("x", "", "")]


def folded_yaml(text):
    """The open keys of a YAML text, line by line."""
    import re

    out, open_, last = [], [], -1
    for line in re.split(r"\r\n|\n|\r", text):
        m = re.match(r"^\s*([\w.-]+)\s*:\s*(.*)$", line)
        if not line.strip() or line.strip().startswith("#") or not m:
            continue
        indent, value = len(re.match(r"[ \t]*", line).group().replace("\t", "  ")), m.group(2).strip()
        value = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
        if indent <= last:
            open_ = open_[: max(0, len(open_) - (last - indent) // 2 - 1)]
        if not value:
            open_, last = [*open_, m.group(1)], indent
        elif re.search(r"\$\{[^}]+}", value) and any(w in value.lower() for w in scanners.COMMANDS):
            out.append((".".join([*open_, m.group(1)]), value))
    return out


def test_yaml_levels_equal_the_line_by_line_fold(spark):
    import random

    r = random.Random(4)
    texts = {}
    for i in range(30):
        texts[f"p/{i}.yml"] = r.choice(["\n", "\r\n"]).join(r.choice(["", "  ", "    ", "\t", "\t\t", " "]) + r.choice(["a:", "b.c:", "d: bash ${x}", 'e: "sh ${y} ${z}"', "f: plain", "# g: cmd ${q}", "", "- h", "i : exec ${w}", 'j: "']) for _ in range(40))
    got = sorted((r.config_file, r.key, r.template_value) for r in scanners.yaml_templates(files(spark, texts)).collect())
    assert got == sorted((p, k, v) for p, t in texts.items() for k, v in folded_yaml(t)) and len(got) > 100


def test_tech_profile(spark):
    dep = lambda g, a: f"<dependency><groupId>{g}</groupId><artifactId>{a}</artifactId></dependency>"
    f = files(spark, {
        "r/pom.xml": dep("org.springframework.boot", "spring-boot-starter") + dep("org.mybatis", "mybatis") + dep("org.apache.shiro", "shiro-core"), "r/x/pom.xml": dep("a", "hibernate"), "r/b/B.java": "class B {}", "r/a/A.java": "// c\npackage q.w;\nclass A {}",
        "g/build.gradle.kts": "x", "n/readme.txt": "spring-boot", "n/1/2/3/4/5/6/7/8/Deep.java": "package no;", "e/E.java": None,
    })
    got = {r.repo: (r.primary_language, r.build_tool, r.web_framework, r.orm, r.security_libs, len(r.dependencies), r.app_package) for r in scanners.tech_profile(f).collect()}
    assert got == {"r": ("java", "maven", "Spring Boot", "MyBatis", ["Apache Shiro"], 3, "q.w"), "g": ("java", "gradle", "unknown", "unknown", [], 0, ""), "n": ("unknown", "unknown", "unknown", "unknown", [], 0, ""), "e": ("java", "unknown", "unknown", "unknown", [], 0, "")}
    assert scanners.tech_profile(f.limit(0)).count() == 0


def test_source_hints(spark):
    code = "  Runtime.getRuntime().exec(x);\n// new ProcessBuilder(y)\n\nClass.forName(n).invoke(o); m.invoke(ctx.lookup(k)); // eval\nSystem.loadLibrary(\"l\");\nx.eval (s); in.readObject();\n" + "y" * 600 + " InitialContext"
    got = {(r.line_no, r.category) for r in scanners.source_hints(files(spark, {"a.java": code})).collect()}
    assert got == {(1, "COMMAND_EXECUTION"), (4, "DYNAMIC_LOADING"), (4, "JNDI_LOOKUP"), (5, "NATIVE_LIBRARY"), (6, "SCRIPT_EXECUTION"), (6, "NATIVE_DESERIALIZATION"), (7, "JNDI_LOOKUP")}
    assert max(len(r.code) for r in scanners.source_hints(files(spark, {"a.java": code})).collect()) == 500


def test_declared_parents(spark):
    f = files(spark, {"r/A.java": "public class A<T extends X> extends b.Base<Map<String, T>> implements C, D<E> {\n}\ninterface F extends G, H { }\nclass Plain { int x; }\n", "r/x.js": "class Q extends R { }"})
    assert {(r.child, r.parent) for r in scanners.declared_parents(f).collect()} >= {("F", "G"), ("F", "H"), ("A", "Base"), ("A", "C"), ("A", "D")}
    assert all(r.child != "Q" and r.child != "Plain" for r in scanners.declared_parents(f).collect())


def test_names_meet_within_a_project(spark):
    from factloom.functions.text import project_of

    def repo(x, body):
        return {f"{x}/S.java": f"class S {{ void s() {{ helper.help(1); lone(2); }} }} class Helper {{ void help(int a) {{ }} }} {body}"}

    p = jf.parse_files(files(spark, repo("one", "") | repo("two", "class L { void lone(int b) { } }")))
    run = lambda project: resolve.resolve_calls(jf.calls(p), jf.methods(p), jf.implementations(p), jf.method_refs(p), project)[0].collect()
    inside = lambda r: r.from_id.split("@")[1][:3] == r.to_id.split("@")[1][:3]
    assert sorted((r.to_id[:6], inside(r)) for r in run(project_of)) == [("Helper", True), ("Helper", True), ("L#lone", True)]
    assert sum(not inside(r) for r in run(None)) == 3


def test_answers_and_rules(spark):
    a = [
        (1, '```json\n[{"methodName": " zap ", "receiverType": "RayGun", "category": "file_write"}, {"methodName": "", "receiverType": "x", "category": "FILE_WRITE"}, {"methodName": "m", "receiverType": "x", "category": "ODD"}]\n```'),
        (2, '{"result": "Sure: [{\\"methodName\\": \\"zap\\", \\"receiverType\\": \\"raygun\\", \\"category\\": \\"FILE_WRITE\\"}] done"}'), (3, "none"), (4, None), (5, '[{"methodName": {"a": 1}, "receiverType": "x", "category": "FILE_WRITE"}]'), (6, "[]"),
    ]
    d = spark.createDataFrame(a, "n int, text string")
    rules = classify.answer_rules(d, "n")
    assert [(r.method_pattern, r.receiver_pattern, r.category, r.rule_ord) for r in rules.collect()] == [("zap", "raygun", "FILE_WRITE", (1, 0))]
    assert [r.rule_ord[0] for r in classify.answer_rules(d, "n", fold_case=False).collect()] == [2]
    c = spark.createDataFrame([("m", "C", "f", 3, "zap", "gun", "a.RayGunX", 0, [], [], 7, "gun.zap()"), ("m", "C", "f", 4, "zap", "gun", None, 0, [], [], 1, "e"), ("m", "C", "f", 5, "Zap", "gun", "RayGun", 0, [], [], 1, "e")], CALL)
    assert [(r.category, r.api, r.line, r.code) for r in classify.reviewed_sinks(c, rules).collect()] == [("FILE_WRITE", "a.raygunx.zap", 7, "gun.zap()")]
    assert classify.reviewed_sinks(c, rules.limit(0)).count() == 0 and classify.answer_rules(d.limit(0), "n").count() == 0


def test_mapper_and_template_sinks(spark):
    f = files(spark, {
        "m.xml": '<mapper namespace="a.UserMapper"><select id="find" x="1">select * from ${t}</select><update id="ok">set #{x}</update></mapper>',
        "S.java": "class S { UserMapper userMapper; void a(String q) { userMapper.find(q); } @Value(\"x\") void b(String p) { String c = env.getProperty(\"k\"); run(c.replace(\"{p}\", p)); } }",
    })
    p = jf.parse_files(f)
    m = resolve.mapper_sinks(jf.calls(p), scanners.mapper_statements(f.where("path = 'm.xml'"))).collect()
    assert [(r.category, r.code) for r in m] == [("SQL_EXECUTION", "select * from ${t}")]
    t = spark.createDataFrame([("z.yml", "k2", "v", []), ("a.yml", "k1", "v", [])], "config_file string, key string, template_value string, placeholders array<string>")
    r = resolve.template_sinks(jf.methods(p), jf.calls(p), t).collect()
    assert [(x.template_key, "replace" in x.code) for x in r] == [("k1", True)]
    assert resolve.template_sinks(jf.methods(p), jf.calls(p), t.limit(0)).count() == 0


def test_taint_summary():
    call = lambda m, r, *args: {"method_name": m, "receiver": r, "argument_count": len(args), "argument_expressions": list(args), "expression": f"{r}.{m}({', '.join(args)})"}
    flows, back, strings, passed = taint.summarize(["one", "two"], "String f(String one, String two)", [call("append", "sb", "one"), call("run", "x", "sb.toString()", "onetwo")])
    assert (0, "append", "sb", 0, "concatenation") in flows and (0, "run", "x", 0, "direct") in flows and strings and passed and not any(f[0] == 1 for f in flows) and 0 in back
    # a text call taints its receiver by every variable whose name its text contains, word or not
    assert (0, "run", "x", 0, "direct") in taint.summarize(["b"], "", [call("append", "sb", "'y'"), call("run", "x", "sb")])[0]
    assert taint.summarize([], "", []) == ([], [], False, False)


def test_verification_without_parameters_and_inside(spark):
    s = spark.createDataFrame([("a", [(0, "run", "w", 0, "format")], [], True, True)], taint.SUMMARY)
    p = spark.createDataFrame([(1, "HTTP", "", 1, ["a", "b"], "x"), (2, "event", "", 1, ["a", "b"], "x"), (3, "HTTP", "", 0, ["b", "a"], "x"), (4, "HTTP", "config-x", 1, ["a", "b"], "x"), (5, "HTTP", "", 1, [], "x")], "path_key int, protocol string, framework string, parameter_count int, path array<string>, sink_text string")
    got = {r.path_key: (r.taint_confidence, r.source_classification) for r in taint.verify_paths(p, s).collect()}
    assert got == {1: ("CONFIRMED", "REQUEST_CONTROLLED"), 2: ("STRUCTURAL", "INTERNAL_DERIVED"), 3: ("STRUCTURAL", "UNKNOWN"), 4: ("CONFIRMED", "CONFIG_CONTROLLED"), 5: ("NONE", "UNKNOWN")}


def test_local_taint_sinks(spark):
    p = jf.parse_files(files(spark, {"T.java": "class T { void a(String host) { String c = String.format(\"ping %s\", host); Runtime.getRuntime().exec(c); } void b(String host) { Runtime.getRuntime().exec(host); } void c() { Runtime.getRuntime().exec(\"x\"); } }"}))
    c = jf.calls(p)
    from factloom.plans.pipeline import number_sinks

    k = number_sinks(classify.classify_calls(c).withColumn("code", F.col("expression")))
    assert [r.api for r in taint.local_taint_sinks(jf.methods(p), c, k).collect()] == ["taint:T.a"]
