"""Line and element scanners over text files (S8-S13, S22 in discover): regular expressions on the JVM, no per-row Python.

Every scanner takes (path, content) rows; NULL contents give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that make a configuration value look like a command.
COMMANDS = ["bash", "sh ", "/bin/", "exec", "cmd", "python", "script", "shell", "powershell"]
#: Line rules of the source hints (category, pattern).
HINT_RULES = [
    ("COMMAND_EXECUTION", r"\bProcessBuilder\b|Runtime\s*\.\s*getRuntime\s*\(\)\s*\.\s*exec\s*\("),
    ("SCRIPT_EXECUTION", r"\bScriptEngine\b|\.eval\s*\(|SpelExpressionParser|parseExpression\s*\("),
    ("NATIVE_DESERIALIZATION", r"\bObjectInputStream\b|\.readObject\s*\(|\bXMLDecoder\b|\.fromXML\s*\("),
    ("DYNAMIC_LOADING", r"\bURLClassLoader\b|Class\s*\.\s*forName\s*\(|\.loadClass\s*\(|\.invoke\s*\("),
    ("JNDI_LOOKUP", r"\bInitialContext\b|\.lookup\s*\("),
    ("NATIVE_LIBRARY", r"System\s*\.\s*load(?:Library)?\s*\("),
]
#: Patterns of configuration lines, elements and attributes.
PLACEHOLDER = r"\$\{([^}]+)}"
YAML_LINE = r"^\s*([\w.-]+)\s*:\s*(.*)$"
PROPERTY_LINE = r"^\s*([\w.-]+)\s*[=:]\s*(.+)$"
ELEMENT = r"<([\w.-]+)[^>]*>\s*([^<]*(?:\$\{[^}]+}[^<]*)*)\s*</\1>"
ATTRIBUTE = r"(?i)(?:value|command|script|exec|cmd)\s*=\s*\"([^\"]*\$\{[^}]+}[^\"]*)\""


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line): 1-based; \\r\\n, \\n and \\r end lines."""
    split = files.where("content is not null").select("path", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("pos", "line"))
    return split.select("path", (F.col("pos") + 1).alias("line_no"), "line")


def placeholders(value: Column | str) -> Column:
    """Names in ${...}, in order."""
    return F.regexp_extract_all(value, F.lit(PLACEHOLDER), 1)


def is_command(value: Column | str) -> Column:
    """Has a command word."""
    low = F.lower(value)
    out = low.contains(COMMANDS[0])
    for w in COMMANDS[1:]:
        out = out | low.contains(w)
    return out


def strip(c: Column | str) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _templates(rows: DataFrame) -> DataFrame:
    keep = rows.where(is_command("template_value") & F.col("template_value").rlike(PLACEHOLDER))
    return keep.select(F.col("path").alias("config_file"), "key", "template_value", placeholders("template_value").alias("placeholders"))


def properties_templates(files: DataFrame) -> DataFrame:
    """key=value and key: value lines with a placeholder and a command word; the value without outer white space. Comments and blank lines give nothing."""
    m = lines(files).select("path", F.regexp_extract("line", PROPERTY_LINE, 1).alias("key"), strip(F.regexp_extract("line", PROPERTY_LINE, 2)).alias("template_value"))
    return _templates(m.where("key <> ''"))


def yaml_templates(files: DataFrame) -> DataFrame:
    """Values of keys with a placeholder and a command word; key is the dotted path of the open keys and its own.

    Only keys without a value open a level. A line whose indentation (a tab counts 2) is not deeper than that of the key opened last closes one
    level for each 2 columns, and one more. The open keys are folded once over the key lines of a file, so the work is linear in its length.
    """
    text = F.filter(F.split("content", r"\r\n|\n|\r"), lambda x: ~x.rlike(r"^\s*(#|$)") & x.rlike(YAML_LINE))
    value = lambda x: strip(F.regexp_extract(x, YAML_LINE, 2))
    plain = lambda v: F.when(v.rlike('^".*"$'), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v)
    rows = F.transform(text, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, r"^([ \t]*)", 1), "\t", "  ")).alias("indent"), F.regexp_extract(x, YAML_LINE, 1).alias("key"), plain(value(x)).alias("value")))
    start = F.expr("named_struct('open', cast(array() as array<string>), 'last', -1, 'out', cast(array() as array<struct<key:string,value:string>>))")

    def step(at: Column, x: Column) -> Column:
        closed = F.when(x["indent"] <= at["last"], F.floor((at["last"] - x["indent"]) / 2) + 1).otherwise(0).cast("int")
        open_ = F.slice(at["open"], F.lit(1), F.greatest(F.lit(0), F.size(at["open"]) - closed))
        opens = x["value"] == ""
        hit = ~opens & is_command(x["value"]) & x["value"].rlike(PLACEHOLDER)
        found = F.array(F.struct(F.array_join(F.concat(open_, F.array(x["key"])), ".").alias("key"), x["value"].alias("value")))
        return F.struct(F.when(opens, F.concat(open_, F.array(x["key"]))).otherwise(open_).alias("open"), F.when(opens, x["indent"]).otherwise(at["last"]).alias("last"), F.when(hit, F.concat(at["out"], found)).otherwise(at["out"]).alias("out"))

    f = files.where("content is not null").select("path", F.inline(F.aggregate(rows, start, step, lambda at: at["out"])))
    return _templates(f.select("path", "key", F.col("value").alias("template_value")))


def xml_templates(files: DataFrame) -> DataFrame:
    """Texts of elements (a back-reference pairs the tags), and values of the attributes value, command, script, exec and cmd; key is the element name, or `attribute`."""
    f = files.where("content is not null")
    pair = F.arrays_zip(F.regexp_extract_all("content", F.lit(ELEMENT), 1).alias("key"), F.regexp_extract_all("content", F.lit(ELEMENT), 2).alias("template_value"))
    texts = f.select("path", F.inline(pair)).withColumn("template_value", strip("template_value"))
    values = f.select("path", F.lit("attribute").alias("key"), F.explode(F.regexp_extract_all("content", F.lit(ATTRIBUTE), 1)).alias("template_value"))
    return _templates(texts.unionByName(values))


#: The namespace of a mapper, and its statements (a back-reference pairs the tags).
NAMESPACE = r"(?i)<mapper\s+namespace\s*=\s*\"([^\"]+)\""
STATEMENT = r"(?i)<(select|insert|update|delete)\s+[^>]*id\s*=\s*\"([^\"]+)\"[^>]*>([\s\S]*?)</\1>"


def mapper_statements(files: DataFrame) -> DataFrame:
    """(file_path, mapper, ord, statement_id, snippet) of mapper statements that splice text in (${...}); mapper is the simple name of the first namespace, the
    snippet the body without outer white space, at most 200 characters and "..."."""
    f = files.where("content is not null").withColumn("ns", F.regexp_extract("content", NAMESPACE, 1)).where("ns <> ''")
    z = F.arrays_zip(F.regexp_extract_all("content", F.lit(STATEMENT), 2).alias("id"), F.regexp_extract_all("content", F.lit(STATEMENT), 3).alias("body"))
    s = f.select("path", "ns", F.posexplode(z).alias("ord", "s")).where(F.col("s.body").rlike(PLACEHOLDER))
    body = strip("s.body")
    cutoff = F.when(F.length(body) > 200, F.concat(F.substring(body, 1, 200), F.lit("..."))).otherwise(body)
    return s.select(F.col("path").alias("file_path"), F.substring_index("ns", ".", -1).alias("mapper"), "ord", F.col("s.id").alias("statement_id"), cutoff.alias("snippet"))


def source_hints(files: DataFrame) -> DataFrame:
    """(path, line_no, category, code), one row for each rule that matches a line; blank lines and // comments give nothing; code without outer white space, at most 500 characters."""
    hit = F.array_compact(F.array(*[F.when(F.col("code").rlike(p), F.lit(n)) for n, p in HINT_RULES]))
    h = lines(files).select("path", "line_no", strip("line").alias("code")).where((F.col("code") != "") & ~F.startswith("code", F.lit("//")))
    return h.select("path", "line_no", F.explode(hit).alias("category"), F.substring("code", 1, 500).alias("code"))


#: What a dependency shows, in order of precedence: (column, name, text that a group, artifact or version contains).
TECH = [
    ("web_framework", "Spring Boot", "spring-boot"), ("web_framework", "Spring", "spring-web"), ("web_framework", "JAX-RS", "jersey"),
    ("orm", "MyBatis", "mybatis"), ("orm", "Hibernate", "hibernate"), ("orm", "JPA", "spring-data-jpa"),
    ("security", "Spring Security", "spring-security"), ("security", "Apache Shiro", "shiro"),
]
PACKAGE = r"(?m)^\s*package\s+([A-Za-z_][\w.]*)\s*;"


def tech_profile(files: DataFrame, depth: int = 8) -> DataFrame:
    """(repo, primary_language, build_tool, web_framework, orm, security_libs, dependencies, app_package), one row for each repository (the first part of a path).

    The first pom.xml, Gradle file and Java file in order of path count, at most `depth` levels below the repository; "unknown" where nothing shows.
    """
    f = files.where("path is not null").select(F.substring_index("path", "/", 1).alias("repo"), "path", "content").where(F.size(F.split("path", "/")) - 1 <= depth)
    name = F.substring_index("path", "/", -1)
    kind = F.when(name == "pom.xml", "pom").when(name.isin("build.gradle", "build.gradle.kts"), "gradle").when(name.endswith(".java"), "java")
    of = lambda k: F.min(F.when(kind == k, F.col("path")))
    package = F.min_by(F.regexp_extract(F.coalesce("content", F.lit("")), PACKAGE, 1), F.when(kind == "java", F.col("path")))
    per = f.groupBy("repo").agg(of("pom").alias("pom"), of("gradle").alias("gradle"), of("java").alias("java"), package.alias("package"))
    poms = f.join(per.select(F.col("pom").alias("path")), "path", "left_semi")
    deps = maven_dependencies(poms).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "group_id", "artifact_id", "version"))).alias("d"))  # at most 100 a file
    p = per.join(deps.withColumnRenamed("path", "pom"), "pom", "left").withColumn("d", F.coalesce("d", F.expr("cast(array() as array<struct<ord:int,group_id:string,artifact_id:string,version:string>>)")))
    shown = F.transform("d", lambda x: F.lower(F.concat_ws("\n", x["group_id"], x["artifact_id"], x["version"])))
    has = lambda t: F.exists(shown, lambda x: x.contains(t))

    def one(column: str) -> Column:
        out = F.lit("unknown")
        for c, n, t in reversed(TECH):
            out = F.when(has(t), n).otherwise(out) if c == column else out
        return out.alias(column)

    some = F.col("java").isNotNull() | F.col("pom").isNotNull() | F.col("gradle").isNotNull()
    tool = F.when(F.col("pom").isNotNull(), "maven").when(F.col("gradle").isNotNull(), "gradle").otherwise("unknown")
    libs = F.array_compact(F.array(*[F.when(has(t), F.lit(n)) for c, n, t in TECH if c == "security"]))
    return p.select(
        "repo", F.when(some, "java").otherwise("unknown").alias("primary_language"), tool.alias("build_tool"), one("web_framework"), one("orm"), libs.alias("security_libs"),
        F.transform("d", lambda x: F.struct(x["group_id"].alias("group_id"), x["artifact_id"].alias("artifact_id"), x["version"].alias("version"))).alias("dependencies"), F.coalesce("package", F.lit("")).alias("app_package"),
    )


def maven_dependencies(files: DataFrame, most: int = 100) -> DataFrame:
    """(path, ord, group_id, artifact_id, version) of the first `most` dependencies of a pom.xml; absent parts are blank, values without outer white space."""
    block = F.slice(F.regexp_extract_all("content", F.lit(r"<dependency>([\s\S]*?)</dependency>"), 1), 1, most)
    p = files.where(F.col("path").endswith("pom.xml") & F.col("content").isNotNull()).select("path", F.posexplode(block).alias("ord", "d"))
    one = lambda tag: strip(F.regexp_extract("d", rf"<{tag}>([\s\S]*?)</{tag}>", 1))
    return p.select("path", "ord", one("groupId").alias("group_id"), one("artifactId").alias("artifact_id"), one("version").alias("version"))


#: The head of a type: its name, and its extends and implements clauses.
TYPE_HEAD = r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)[^{;=]*?\b((?:extends|implements)\b[^{;=]*)\{"


def declared_parents(files: DataFrame) -> DataFrame:
    """G1: (file_path, parent, child) simple names of the types that a Java text declares with extends or implements, distinct; by pattern, without parsing, so also from damaged files."""
    f = files.where(F.col("path").endswith(".java") & F.col("content").isNotNull())
    z = F.arrays_zip(F.regexp_extract_all("content", F.lit(TYPE_HEAD), 1).alias("child"), F.regexp_extract_all("content", F.lit(TYPE_HEAD), 2).alias("clause"))
    c = f.select(F.col("path").alias("file_path"), F.inline(z))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("clause", r"<[^<>]*>", ""), r"<[^<>]*>", ""), r"\b(?:extends|implements)\b", ",")
    parents = F.transform(F.split(plain, ","), lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+", ""), r"^.*\.", ""))
    return c.select("file_path", F.explode(parents).alias("parent"), "child").where(F.col("parent").rlike(r"^[A-Za-z_]\w*$")).distinct()
