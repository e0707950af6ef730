"""Source files that do not parse, and the rates of them by repository and language.

Each file is scanned and parsed by the error-correcting chart parser of chart.py with the grammar of its extension; a nonzero edit cost, or an
exact parser of Python, JSON or XML that rejects it, flags it, and the places of the edits tell truncation, merge conflicts and mismatched languages apart. Files are parsed where they are:
the only shuffle picks the counting row of each path.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chart, grammars
from .handwritten import counting_rows

VERDICT = "path string, lang string, edits int, cause string, line int"
_CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \r\n]|$)", re.M)


#: Limits of the exact parsers themselves, which say nothing about the text.
_LIMITS = re.compile("too many nested|too deeply nested|too complex|Exceeds the limit|stack overflow|recursion", re.I)


def _exact(lang: str, text: str) -> int | None:
    """What an exact parser of Python, JSON or XML says: 0 if it accepts the text, else the line of the error. None if it cannot tell; the other languages have none here."""
    text = text.removeprefix("\ufeff")
    try:
        if lang == "py":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif lang == "json":
            json.loads(text, parse_constant=lambda x: (_ for _ in ()).throw(json.JSONDecodeError(x, text, 0)), parse_int=str, parse_float=str)
        elif lang == "xml":
            expat.ParserCreate("utf-8").Parse(text.encode(), True)
        else:
            return None
    except (SyntaxError, json.JSONDecodeError, expat.ExpatError) as e:
        return None if _LIMITS.search(str(e)) else max(1, e.lineno or 1)
    except Exception:
        return None
    return 0


def verdict(lang: str, text: str) -> tuple[int, str | None, int | None]:
    """(edit cost, cause, line of the first edit); cost 0 for texts that parse. Where an exact parser can tell, it decides: what it alone rejects costs one edit at its line.

    cause: conflict (edits between conflict marks, or within two lines of one), mismatch (several edits, more than one for four lines, or many from the first
    lines on), truncation (all edits at the end), else damage.
    """
    tokens = grammars.LANGUAGES[lang][2](text)
    cost, edits = chart.parse(grammars.grammar(lang), tokens)
    said = _exact(lang, text)
    if said == 0 or not cost and said is None:
        return 0, None, None
    if not cost:
        cost, edits = 1, [("exact", said)]
    lines = text.count("\n") + 1
    first = min((n for _, n in edits), default=1)
    marks = [text.count("\n", 0, m.start()) + 1 for m in _CONFLICT.finditer(text)]
    if marks and any(marks[0] - 2 <= n <= marks[-1] + 2 for _, n in edits):
        cause = "conflict"
    elif cost * 4 > lines and cost > chart.MOST_EDITS // 2 or cost >= chart.MOST_EDITS and first <= 3:
        cause = "mismatch"
    elif all(what == "end" or what != "exact" and n >= lines - 2 for what, n in edits):
        cause = "truncation"
    else:
        cause = "damage"
    return cost, cause, first


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(p, (x := p.rpartition(".")[2]), *verdict(x, c)) for p, c in zip(pdf["path"], pdf["content"])]
        yield pd.DataFrame(rows, columns=["path", "lang", "edits", "cause", "line"]).astype({"line": "Int32"})


def check_files(files: DataFrame) -> DataFrame:
    """(path, lang, edits, cause, line) of the counting row of each path in a known language; edits = 0 and NULL cause for valid files.

    NULL content is no case and gives no row; empty content is parsed (an empty JSON or XML file is invalid). Repeated and older rows do not count.
    """
    rows = counting_rows(files).where(F.col("path").rlike(r"\.(java|py|js|json|xml)$") & F.col("content").isNotNull())
    return rows.select("path", "content").mapInPandas(_verdicts, VERDICT)


def invalid_rates(verdicts: DataFrame) -> DataFrame:
    """(repo, lang, files, invalid, rate) from check_files(); the repository is the first part of a path."""
    repo = F.substring_index("path", "/", 1).alias("repo")
    counts = verdicts.groupBy(repo, "lang").agg(F.count("*").alias("files"), F.count_if(F.col("edits") > 0).alias("invalid"))
    return counts.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
