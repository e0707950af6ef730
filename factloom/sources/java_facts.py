"""Java files to fact tables (S1-S5): one parse of each file inside its task, everything after it on the JVM.

parse_files() gives one row a file with nested arrays, written once; classes(), methods(), calls(), ... explode what they need.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import cut

_ANN = "array<struct<name:string,args:string,line:int>>"
CALL = "struct<call_ord:int,method_name:string,receiver:string,receiver_type:string,argument_count:int,argument_types:array<string>,argument_expressions:array<string>,line:int,expression:string>"
METHOD = f"struct<ord:int,class_name:string,method_name:string,parameter_count:int,parameter_names:array<string>,parameter_types:array<string>,start_line:int,end_line:int,signature:string,variable_types:map<string,string>,annotations:{_ANN},calls:array<{CALL}>,method_refs:array<string>>"
CLASS = f"struct<ord:int,class_name:string,kind:string,super_types:array<string>,extends_name:string,implements_names:array<string>,line:int,annotations:{_ANN}>"
FILE = f"path string, package string, imports array<struct<name:string,line:int>>, classes array<{CLASS}>, methods array<{METHOD}>, errors array<struct<line:int,message:string>>"

_TOKEN = re.compile(r'(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<str>"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|(?P<num>\d[\w.]*)|(?P<id>[^\W\d][\w$]*)|(?P<op>->|::|\.\.\.|[^\w\s])')
_NOT_CALLS = frozenset("if for while switch catch synchronized return throw new super this assert do else try case instanceof".split())
_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
_OPEN, _SHUT = {"(": ")", "{": "}", "[": "]"}, {")": "(", "}": "{", "]": "["}


class _File:
    """Tokens of a file with the partner of each bracket."""

    def __init__(self, text: str):
        self.text = text
        self.tok: list[str] = []
        self.at: list[int] = []
        self.line: list[int] = []
        self.errors: list[tuple[int, str]] = []
        line, last = 1, 0
        for m in _TOKEN.finditer(text):
            if m.lastgroup != "skip":
                line += text.count("\n", last, m.start())
                last = m.start()
                self.tok.append(m.group())
                self.at.append(m.start())
                self.line.append(line)
        self.mate: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tok):
            if t in _OPEN:
                stack.append(i)
            elif t in _SHUT:
                while stack and self.tok[stack[-1]] != _SHUT[t]:
                    self.errors.append((self.line[stack.pop()], "bracket is not closed"))
                if stack:
                    self.mate[i] = stack[-1]
                    self.mate[stack.pop()] = i
                else:
                    self.errors.append((self.line[i], "bracket is not open"))
        for i in stack:
            self.errors.append((self.line[i], "bracket is not closed"))
            self.mate[i] = len(self.tok) - 1

    def source(self, a: int, b: int) -> str:
        """Text of tokens a..b-1 with white space collapsed."""
        return " ".join(self.text[self.at[a] : self.at[b - 1] + len(self.tok[b - 1])].split()) if a < b else ""

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Token ranges between the commas of a..b-1 that no bracket (also < >) encloses."""
        out, start, i, angle = [], a, a, 0
        while i < b:
            t = self.tok[i]
            if t in _OPEN:
                i = min(self.mate.get(i, b), b)
            elif t == "<" and i > a and self.tok[i - 1][:1].isupper():
                angle += 1
            elif t == ">" and angle:
                angle -= 1
            elif t == "," and not angle:
                out.append((start, i))
                start = i + 1
            i += 1
        if start < b:
            out.append((start, b))
        return out

    def annotations(self, i: int) -> tuple[list[dict], int]:
        """Annotations that begin at i, and where they end."""
        found = []
        while i < len(self.tok) and (self.tok[i] in _MODIFIERS or self.tok[i] == "@" and self.tok[i + 1 : i + 2] != ["interface"]):
            if self.tok[i] != "@":
                i += 1
                continue
            start, i = i, i + 1
            name = ""
            while i < len(self.tok) and (self.tok[i][:1].isalpha() or self.tok[i] == "."):
                if self.tok[i][:1].isalpha() and name and self.tok[i - 1] != ".":
                    break
                name += self.tok[i]
                i += 1
            args = ""
            if i < len(self.tok) and self.tok[i] == "(":
                args = self.source(i + 1, self.mate.get(i, i + 1))
                i = self.mate.get(i, i) + 1
            found.append({"name": name.rpartition(".")[2], "args": args, "line": self.line[start]})
        return found, i


def simple_type(name: str) -> str:
    """Simple name of a type: no generics, no array marks, nothing before the last dot."""
    return re.split(r"[.$]", re.sub(r"<.*>|\[\s*\]|\.\.\.", "", name).strip())[-1].strip()


def _declared(f: _File, a: int, b: int) -> tuple[str, str] | None:
    """(name, type) of a parameter or declaration in tokens a..b-1."""
    _, a = f.annotations(a)
    if b - a < 2 or not f.tok[b - 1][:1].isalpha():
        return None
    return f.tok[b - 1], simple_type("".join(f.tok[a : b - 1]))


def _root(receiver: str) -> str:
    return re.split(r"[.\[(]", re.sub(r"^(?:this|super)\.", "", receiver))[0]


def _type_of(expr: str, variables: dict[str, str]) -> str:
    if m := re.match(r"new ([\w.]+)", expr):
        return simple_type(m.group(1))
    if expr.startswith('"'):
        return "String"
    root = _root(expr)
    return variables.get(root, root if root[:1].isupper() else "")


def _body(f: _File, a: int, b: int, variables: dict[str, str]) -> tuple[list[dict], list[str]]:
    """Calls and method references in tokens a..b-1; local declarations are added to `variables` as they are met."""
    calls, refs, tok = [], [], f.tok
    i = a
    while i < b:
        t = tok[i]
        nxt = tok[i + 1] if i + 1 < b else ""
        if t == "::" and nxt[:1].isalpha():
            refs.append(nxt)
        elif t[:1].isalpha() and nxt in ("=", ";", ":", ",", ")") and i > a and (tok[i - 1][:1].isalpha() or tok[i - 1] in (">", "]")) and tok[i - 1] not in _NOT_CALLS:
            j, angle = i - 1, 0  # a declaration: walk back over its type
            while j > a:
                if tok[j] == ">":
                    angle += 1
                elif tok[j] == "<":
                    angle -= 1
                elif not angle and not (tok[j][:1].isalpha() or tok[j] in (".", "[", "]")) or not angle and j + 1 < i and tok[j][:1].isalpha() and tok[j + 1][:1].isalpha():
                    break
                j -= 1
            kind = simple_type("".join(tok[j + 1 if j > a or not tok[j][:1].isalpha() else j : i]))
            if kind and (kind[:1].isalpha()):
                if kind == "var" and nxt == "=" and tok[i + 2 : i + 3] == ["new"]:
                    kind = tok[i + 3] if i + 3 < b else ""
                variables[t] = "" if kind == "var" else kind
        elif nxt == "(" and t[:1].isalpha() and t not in _NOT_CALLS:
            shut = min(f.mate.get(i + 1, b), b)
            before = tok[i - 1] if i > a else ""
            j = i
            while j - 2 >= a and tok[j - 1] == ".":  # walk back over the receiver
                j -= 2
                while j >= a and tok[j] in (")", "]"):
                    j = f.mate.get(j, j) - 1
                    if j < a or not (tok[j][:1].isalpha() or tok[j] in (")", "]")):
                        j += 1
                        break
            is_new = tok[j - 1] == "new" if j > a else False
            args = f.split(i + 2, shut)
            texts = [f.source(x, y)[:200] for x, y in args]
            if is_new and before != ".":
                name, receiver, kind = "<init>", "", t
            else:
                name = t
                receiver = re.sub(r"\s*([.()\[\],])\s*", r"\1", f.source(j, i - 1)) if before == "." else ""
                if is_new:
                    receiver = "new " + receiver
                kind = _type_of(receiver, variables) if receiver else ""
                if receiver.startswith("new "):
                    kind = simple_type(re.match(r"new ([\w.]*\w)", receiver).group(1)) if re.match(r"new ([\w.]*\w)", receiver) else ""
            if name != "<init>" or args:
                calls.append({"call_ord": len(calls), "method_name": name, "receiver": receiver, "receiver_type": kind, "argument_count": len(args), "argument_types": [_type_of(x, variables) for x in texts], "argument_expressions": texts, "line": f.line[i], "expression": f.source(j - 1 if is_new else j, min(shut + 1, b))[:500]})
        i += 1
    return calls, refs


def _class(f: _File, a: int, b: int, out: dict, annotations: list[dict], outer: dict[str, str]) -> int:
    """Reads the class whose keyword is token a; returns where it ends."""
    tok = f.tok
    kind, name = tok[a], tok[a + 1] if a + 1 < b else ""
    i, extends, implements, mode, fields, angle = a + 2, [], [], "", dict(outer), 0
    if kind == "record" and i < b and tok[i] == "(":
        for x, y in f.split(i + 1, f.mate.get(i, i)):
            if d := _declared(f, x, y):
                fields[d[0]] = d[1]
        i = f.mate.get(i, i) + 1
    start = i
    while i < b and tok[i] not in ("{", ";"):
        if tok[i] == "<":
            angle += 1
        elif tok[i] == ">":
            angle -= 1
        elif tok[i] in ("extends", "implements", "permits") and not angle:
            mode, start = tok[i], i + 1
        elif not angle and mode in ("extends", "implements") and tok[i][:1].isalpha() and (i + 1 >= b or tok[i + 1] != "."):
            (extends if mode == "extends" else implements).append(tok[i])
        i += 1
    out["classes"].append({"ord": len(out["classes"]), "class_name": name, "kind": kind, "super_types": extends + implements, "extends_name": extends[0] if extends and kind == "class" else "", "implements_names": implements, "line": f.line[a], "annotations": annotations})
    if i >= b or tok[i] == ";":
        return i + 1
    end = min(f.mate.get(i, b), b)
    i += 1
    members: list[tuple] = []
    if kind == "enum":
        while i < end and tok[i] not in (";",):
            i = f.mate[i] + 1 if tok[i] in _OPEN and i in f.mate else i + 1
    while i < end:
        found, j = f.annotations(i)
        i = max(i, j)
        if i >= end:
            break
        t = tok[i]
        if t in (";", "}"):
            i += 1
        elif t == "{":
            i = f.mate.get(i, end) + 1
        elif t in ("class", "interface", "enum") or t == "record" and i + 2 < end and tok[i + 2] in ("(", "<") or t == "@" and tok[i + 1 : i + 2] == ["interface"]:
            i += t == "@"
            i = _class(f, i, end, out, found, fields)
        else:
            k, angle = i, 0
            while k < end and (angle or tok[k] not in ("(", ";", "=", "{")):
                angle += (tok[k] == "<") - (tok[k] == ">")
                k += 1
            if k < end and tok[k] == "(":
                shut = f.mate.get(k, end)
                e = shut + 1
                while e < end and tok[e] not in ("{", ";"):
                    e += 1
                method = "<init>" if tok[k - 1] == name else tok[k - 1]
                if e < end and tok[e] == "{":
                    members.append((i, k, shut, e, min(f.mate.get(e, end), end), method, found))
                    i = min(f.mate.get(e, end), end) + 1
                else:
                    i = e + 1
            else:
                if d := _declared(f, i, k):
                    fields[d[0]] = d[1]
                e = k
                while e < end and tok[e] != ";":
                    e = f.mate.get(e, e) + 1 if tok[e] in _OPEN else e + 1
                i = e + 1
    for i, k, shut, e, stop, method, found in members:
        params = [d for x, y in f.split(k + 1, shut) if (d := _declared(f, x, y))]
        variables = fields | dict(params)
        calls, refs = _body(f, e + 1, stop, variables)
        first = f.line[i]
        while i and tok[i - 1] in _MODIFIERS:
            i -= 1
        out["methods"].append({"ord": len(out["methods"]), "class_name": name, "method_name": method, "parameter_count": len(params), "parameter_names": [p for p, _ in params], "parameter_types": [p for _, p in params], "start_line": first, "end_line": f.line[min(stop, len(f.line) - 1)], "signature": f.source(i, min(stop + 1, len(tok)))[:400], "variable_types": variables, "annotations": found, "calls": calls, "method_refs": refs})
    return end + 1


def parse_text(path: str, text: str | None) -> dict:
    """Facts of one file; a NULL or empty text has none."""
    f = _File(text or "")
    out: dict = {"path": path, "package": "", "imports": [], "classes": [], "methods": [], "errors": [{"line": n, "message": m} for n, m in sorted(f.errors)]}
    i, n, tok = 0, len(f.tok), f.tok
    while i < n:
        if tok[i] in ("package", "import"):
            j = i
            while j < n and tok[j] != ";":
                j += 1
            name = "".join(t for t in tok[i + 1 : j] if t != "static")
            if tok[i] == "package":
                out["package"] = name
            else:
                out["imports"].append({"name": name, "line": f.line[i]})
            i = j + 1
            continue
        found, j = f.annotations(i)
        i = j if j > i else i
        if i < n and (tok[i] in ("class", "interface", "enum") or tok[i] == "record" and i + 2 < n and tok[i + 2] in ("(", "<") or tok[i] == "@" and tok[i + 1 : i + 2] == ["interface"]):
            i = _class(f, i + (tok[i] == "@"), n, out, found, {})
        else:
            i += 1
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "package", "imports", "classes", "methods", "errors"]
    for pdf in batches:
        if len(pdf):
            yield pd.DataFrame([parse_text(p, c) for p, c in zip(pdf["path"], pdf["content"])], columns=columns)


def read_java(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every *.java file below a folder, paths relative to it."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.java")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:/*", "/")
    return files.select(F.regexp_replace(path, F.concat(F.lit("^\\Q"), F.lit(root), F.lit("\\E/*")), F.lit("")).alias("path"), F.col("value").alias("content"))


def latest_files(files: DataFrame) -> DataFrame:
    """(path, content, lang): the row of each path with the latest committed_at; rows without a path or content are left out."""
    last = files.where("path is not null").groupBy("path").agg(F.max(F.struct("committed_at", "file_id")).alias("k")).select(F.col("k.file_id").alias("file_id"))
    return files.where("content is not null").join(last, "file_id", "left_semi").dropDuplicates(["path"]).select("path", "content", "lang")


def parse_files(files: DataFrame) -> DataFrame:
    """One row of nested facts for each .java file of (path, content), written once."""
    java = files.where(F.col("path").endswith(".java")).select("path", "content")
    return cut(java.mapInPandas(_parse, FILE))


def classes(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("path").alias("file_path"), "package", F.inline("classes"))


def _method_id(m) -> F.Column:
    return F.concat(m("class_name"), F.lit("#"), m("method_name"), F.lit("/"), m("parameter_count"), F.lit("@"), F.col("file_path"), F.lit(":"), m("start_line"), F.lit(":"), m("ord"))


def methods(parsed: DataFrame) -> DataFrame:
    """S3: methods and constructors with a body. id = Class#name/arity@file:line:ordinal, the ordinal counting within the file."""
    m = parsed.select(F.col("path").alias("file_path"), "package", F.inline("methods"))
    return m.withColumn("id", _method_id(F.col)).drop("calls", "method_refs")


def calls(parsed: DataFrame) -> DataFrame:
    """(method_id, class_name, call_ord, ...) one row for each invocation."""
    m = parsed.select(F.col("path").alias("file_path"), F.explode("methods").alias("m"))
    return m.select(_method_id(lambda c: F.col("m")[c]).alias("method_id"), F.col("m.class_name").alias("class_name"), "file_path", F.inline("m.calls"))


def method_refs(parsed: DataFrame) -> DataFrame:
    m = parsed.select(F.col("path").alias("file_path"), F.explode("methods").alias("m"))
    return m.select(_method_id(lambda c: F.col("m")[c]).alias("method_id"), F.col("m.class_name").alias("class_name"), "file_path", F.posexplode("m.method_refs").alias("ref_ord", "name"))


def implementations(parsed: DataFrame) -> DataFrame:
    """(file_path, parent, child) simple names, distinct."""
    return parsed.select(F.col("path").alias("file_path"), F.explode("classes").alias("c")).select("file_path", F.explode("c.super_types").alias("parent"), F.col("c.class_name").alias("child")).distinct()


def diagnostics(parsed: DataFrame, most: int | None = 1000, project: Callable[[str], Column] | None = None) -> DataFrame:
    """What did not parse; the first `most` of each project by path, line and message (a feature of the reference's report), all of them if None. project: from the path to the project; None is one project."""
    e = parsed.select(F.col("path").alias("file_path"), F.inline("errors"))
    if most is None:
        return e
    place = F.row_number().over(Window.partitionBy(project("file_path") if project else F.lit("")).orderBy("file_path", "line", "message"))
    return e.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
