"""Generated, compressed, copied and data-only source files, so that hand-written source remains.

Code is cut into tokens; identifiers and literals are masked (key words and marks stay), a long literal counts as one token for each PIECE characters. A file is
a row of units (a unit ends with a statement, a block or a line after UNIT tokens), and a unit is the set of its masked five-token shingles. Near copies of
units, by MinHash banding with exact verification, are clusters, and clusters decide:

- family: a cluster with several members in one repository that crowd in few files. A file that consists of families of its repository to a
  good part is output of a tool, or compressed if it has hardly any white space.
- literal cluster: a cluster of units of literals and marks only. A file that mostly consists of them is data.
- copies: near copies of the unmasked shingles of whole files in several repositories are third-party code. So is a file with a mark (first comment, or
  package root) that most of its files share with such copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..common import cut, drop_cut, skew_join
from . import near

SHINGLE = 5
#: Least and most tokens of a unit; characters of a literal that count as one token.
UNIT, UNIT_MOST, PIECE = 16, 64, 16
#: Words that masking keeps, of the three languages.
KEY_WORDS = frozenset(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for if implements import instanceof int
    interface long native new package private protected public return short static super switch synchronized this throw throws transient try void volatile while true false null var
    record yield function let of typeof in delete async await export from def elif except lambda pass raise with as global nonlocal del and or not is None True False print""".split()
)
_C = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_Q = r'"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?'
_WORD = r"\b\d[\w.]*|[^\W\d][\w$]*|\$[\w$]*|[^\s\w]"
#: The tokens of each language: comments, strings, words and marks; line ends count in Python only.
TOKENS = {
    "java": re.compile(rf'{_C}|"""[\s\S]*?(?:"""|\Z)|{_Q}|{_WORD}'),
    "js": re.compile(rf"{_C}|`(?:\\.|[^`\\])*`?|{_Q}|{_WORD}"),
    "py": re.compile(rf'\#[^\n]*|[rbuRBUfF]{{0,2}}(?:"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|{_Q})|{_WORD}|\n'),
}
#: Kinds of tokens.
MARK, NAME, WORD, LITERAL, COMMENT, LINE = range(6)

FACTS = pa.schema([
    ("file", pa.int64()), ("path", pa.string()), ("repo", pa.string()), ("unit", pa.bool_()), ("cid", pa.binary()), ("k", pa.int32()), ("tokens", pa.int32()), ("words", pa.int32()), ("space", pa.float64()), ("banner", pa.int64()),
    ("package", pa.string()), ("sh", pa.list_(pa.int64())),
])


def _kind(token: str, lang: str) -> int:
    if token == "\n":
        return LINE
    c = token[0]
    if c == "#" and lang == "py" or lang != "py" and token[:2] in ("//", "/*"):
        return COMMENT
    if c.isdigit() or c in "\"'`" and (lang == "js" or c != "`") or len(token) > 1 and token[-1] in "\"'":
        return LITERAL
    return WORD if token in KEY_WORDS else NAME if c.isalpha() or c in "_$" else MARK


NAME_HASH, LITERAL_HASH = xxhash.xxh64_intdigest("I"), xxhash.xxh64_intdigest("L")


class Tokens:
    """Numbers of the tokens that a worker has met, with their masked and unmasked hashes (numpy tables that grow)."""

    MOST = 500_000

    def __init__(self, lang: str):
        self.lang, self.number = lang, {}
        self.table = np.zeros((1024, 5), np.uint64)  # masked hash, unmasked hash, kind, characters, ends a unit

    def codes(self, tokens: list[str]) -> np.ndarray:
        """One row of the table for each token."""
        if len(self.number) > self.MOST:
            self.number.clear()
        number, lang = self.number, self.lang
        if new := [t for t in set(tokens) if t not in number]:
            rows = []
            for t in new:
                kind, plain = _kind(t, lang), xxhash.xxh64_intdigest(t)
                rows.append((NAME_HASH if kind == NAME else LITERAL_HASH if kind == LITERAL else plain, plain, kind, len(t), t in ";}"))
                number[t] = len(number)
            while len(number) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(number) - len(new) : len(number)] = np.array(rows, np.uint64)
        return self.table[np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted and distinct, as np.unique but quicker for short arrays."""
    s = np.sort(values)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of each SHINGLE tokens in a row; fewer tokens are one shingle."""
    n = max(min(1, len(h)), len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _units(stops: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(from, to) of the units of n tokens; stops: positions after which a unit may end. Fewer than UNIT tokens are none."""
    out, a = [], 0
    for b in stops.tolist():
        while b - a > UNIT_MOST:
            out.append((a, a + UNIT_MOST))
            a += UNIT_MOST
        if b - a >= UNIT:
            out.append((a, b))
            a = b
    while n - a >= UNIT:
        out.append((a, min(n, a + UNIT_MOST)))
        a += UNIT_MOST
    return out


def file_rows(file: int, path: str, repo: str | None, text: str, tokens: Tokens, least: int = 60) -> Iterator[tuple]:
    """The rows of FACTS of one file: its units, equal ones once with their number, and the file itself. Files under `least` tokens have no set."""
    words = TOKENS[tokens.lang].findall(text)
    t = tokens.codes(words)
    kind = t[:, 2]
    first = next((w for w, k in zip(words, kind.tolist()) if k != LINE), None) if len(words) and COMMENT in kind[:50] else None
    first = first if first is not None and _kind(first, tokens.lang) == COMMENT else None
    # a line end lets the unit before it end; comments fall away
    ends = t[:, 4].copy()
    here = np.flatnonzero(kind == LINE)
    ends[here[here > 0] - 1] = 1
    keep = (kind != LINE) & (kind != COMMENT)
    t, ends = t[keep], ends[keep]
    times = np.where(t[:, 2] == LITERAL, (t[:, 3] + np.uint64(PIECE - 1)) // np.uint64(PIECE), 1).astype(np.int64)
    masked = np.repeat(t[:, 0], times)
    worded = np.repeat((t[:, 2] == NAME) | (t[:, 2] == WORD), times)
    stops = np.cumsum(times)[ends > 0]
    sh, total = _shingles(masked), np.concatenate([[0], np.cumsum(worded)])
    units: dict[bytes, list] = {}
    for a, b in _units(stops, len(masked)):
        key = sh[a : b - SHINGLE + 1].tobytes()
        u = units.setdefault(key, [0, 0, 0])
        u[0], u[1], u[2] = u[0] + 1, u[1] + b - a, u[2] + int(total[b] - total[a])
    merged: dict[bytes, list] = {}
    for key, (k, n, w) in units.items():
        s = _distinct(np.frombuffer(key, np.int64))
        u = merged.setdefault(xxhash.xxh3_128_digest(s.tobytes()), [0, 0, 0, s])
        u[0], u[1], u[2] = u[0] + k, u[1] + n, u[2] + w
    for cid, (k, n, w, s) in merged.items():
        yield file, None, repo, True, cid, k, n, w, None, None, None, s
    whole = _distinct(_shingles(t[:, 1])) if len(t) >= least else None
    package = re.search(r"^\s*package\s+([\w.]+)", text, re.M) if tokens.lang == "java" else None
    spaces = sum(map(text.count, " \t\r\n")) / len(text)
    banner = xxhash.xxh64_intdigest(" ".join(first.split())) - 2**63 if first else None
    cid = None if whole is None else xxhash.xxh3_128_digest(whole.tobytes())
    yield file, path, repo, False, cid, 1, len(t), None, spaces, banner, package and ".".join(package.group(1).split(".")[:2]), whole


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = {k: Tokens(k) for k in TOKENS}
    sent: set[bytes] = set()  # sets that this task has given already; each is wanted once
    for batch in batches:
        for at in range(0, batch.num_rows, 200):  # a bounded number of files in one answer
            rows = []
            for file, path, repo, text in zip(*(c.to_pylist() for c in batch.slice(at, 200).select(["file", "path", "repo", "content"]).columns)):
                rows += file_rows(file, path, repo, text, tokens[path.rpartition(".")[2]])
            columns = list(zip(*rows))
            sets = [None if cid is None or cid in sent or sent.add(cid) else s for cid, s in zip(columns[4], columns[-1])]
            ends = np.cumsum([0] + [0 if s is None else len(s) for s in sets])
            flat = np.concatenate([s for s in sets if s is not None] or [np.zeros(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([s is None for s in sets]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FACTS)][:-1] + [lists], schema=FACTS)
            if len(sent) > 2_000_000:
                sent.clear()


def counting_rows(files: DataFrame) -> DataFrame:
    """The row of each path with the latest committed_at (equal ones are alike); NULL times come first, NULL paths are left out."""
    last = files.where("path is not null").groupBy("path").agg(F.max(F.struct("committed_at", "file_id")).alias("k")).select(F.col("k.file_id").alias("file_id"))
    return files.join(last, "file_id", "left_semi").dropDuplicates(["path"])


def unit_shares(units: DataFrame, classes: DataFrame, members: int = 3, crowd: int = 2) -> DataFrame:
    """(file, family, literal) of units(file, repo, cid, k, tokens, words): the shares of a file's tokens that lie in families of its repository and in literal clusters.

    The cluster of a class holds it and its near copies. It is a family of a repository in which it has at least `members` members and at least `crowd` for each file that
    holds one; it is a literal cluster if it has at least `members` members anywhere and the unit's words are at most a tenth of its tokens.
    """
    star = near.stars(near.pairs(classes), classes)
    per = skew_join(units.select("file", "repo", "cid", "k"), star, "cid").groupBy("leader", "repo", "file").agg(F.sum("k").alias("k"))
    per = cut(per.groupBy("leader", "repo").agg(F.sum("k").alias("k"), F.count("*").alias("files")))
    everywhere = per.groupBy("leader").agg((F.sum("k") >= members).alias("many")).where("many")
    per = per.join(everywhere, "leader")  # a family is a cluster of many members as well
    family = (F.col("k") >= members) & (F.col("k") >= crowd * F.col("files"))
    found = per.select(F.struct(F.col("leader").alias("cid"), "repo").alias("at"), family.alias("family"), F.lit(True).alias("many"))
    u = units.select("file", "tokens", (F.col("words") * 10 <= F.col("tokens")).alias("plain"), F.struct("cid", "repo").alias("at"))
    u = skew_join(u, found, "at", "left")
    share = lambda c: F.round(F.sum(F.when(c, F.col("tokens")).otherwise(0)) / F.sum("tokens"), 6)
    return u.groupBy("file").agg(share(F.col("family")).alias("family"), share(F.col("many") & F.col("plain")).alias("literal"))


def copies(files: DataFrame, classes: DataFrame) -> DataFrame:
    """(file, repos) of files(file, repo, cid) with a set: from how many repositories the near copies of a file come."""
    star = near.stars(near.pairs(classes), classes)
    per = skew_join(files.select("repo", "cid").distinct(), star, "cid").select("leader", "repo").distinct()
    repos = per.groupBy(F.col("leader").alias("cid")).agg(F.count("*").alias("repos")).where("repos > 1")
    return skew_join(files.select("file", "cid"), repos, "cid").select("file", "repos")


def classify(files: DataFrame, repos: DataFrame, family: float = 0.5, literal: float = 0.5, copied: int = 2) -> DataFrame:
    """(path, reason) of the .java, .py and .js files that nobody of the repository wrote by hand.

    reason: data (at least `literal` of the file in literal clusters), generated or compressed (at least `family` of it in families of its repository), copied
    (near copies in at least `copied` repositories, or a mark of such copies). Files of a repository's own package are never copied: they are what others took.
    Files without content, and paths of other kinds, give no row. The repository of a path is its first part. An empty frame gives an empty frame.
    """
    code = counting_rows(files).where(F.col("path").rlike(r"\.(java|py|js)$") & (F.length("content") > 0))
    code = code.select(F.xxhash64("path").alias("file"), "path", F.substring_index("path", "/", 1).alias("repo"), "content")
    facts = cut(code.mapInArrow(_facts, from_arrow_schema(FACTS)))
    classes = cut(facts.where("sh is not null").groupBy("unit", "cid").agg(F.first("sh").alias("sh")))
    units, whole = facts.where("unit"), facts.where("not unit").select("file", "path", "repo", "cid", "space", "banner", "package")
    home = repos.groupBy("repo").agg(F.max("base_package").alias("base"))  # one row for each repository
    shares = unit_shares(units, classes.where("unit").select("cid", "sh"))
    f = whole.join(shares, "file", "left").join(copies(whole.where("cid is not null"), classes.where("not unit").select("cid", "sh")), "file", "left")
    f = skew_join(f, home, "repo", "left")
    own = F.col("package").isNotNull() & F.startswith(F.concat("base", F.lit(".")), F.concat("package", F.lit(".")))
    tool = F.when(F.col("space") < 0.06, "compressed").otherwise("generated")
    reason = F.when(F.col("literal") >= literal, "data").when(F.col("family") >= family, tool).when((F.col("repos") >= copied) & ~F.coalesce(own, F.lit(False)), "copied")
    marks = F.array_compact(F.array("banner", F.when(F.col("package").isNotNull() & ~F.coalesce(own, F.lit(False)), F.xxhash64(F.lit("package"), "package"))))
    f = cut(f.select("path", marks.alias("marks"), reason.alias("reason")))
    # a mark that most of its files share with copies names the project they come from
    mark = f.select("path", "reason", F.explode("marks").alias("mark"))
    known = mark.groupBy("mark").agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "copied").alias("k")).where("n >= 3 and k >= 0.6 * n").select("mark")
    marked = skew_join(mark.where("reason is null"), known, "mark", "left_semi").select("path", F.lit("copied").alias("reason")).distinct()
    out = cut(f.where("reason is not null").select("path", "reason").unionByName(marked))
    for x in (facts, classes, f):
        drop_cut(x)
    return out


def handwritten(facts: DataFrame, found: DataFrame, column: str = "file_path") -> DataFrame:
    """The rows of methods or sinks whose file is not in `found`; other separators and leading parts of `column` are reconciled."""
    key = F.regexp_replace(F.regexp_replace(column, r"\\", "/"), r"^(\./|/)+", "")
    return facts.withColumn("_path", key).join(found.select(F.col("path").alias("_path")), "_path", "left_anti").drop("_path")
