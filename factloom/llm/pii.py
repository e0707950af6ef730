"""Personal information in free text by a semi-Markov conditional random field.

Candidate segments of bounded length come from generous shapes (any number group, any run of capitalised words, ...). A segment is
scored as a whole (its shape, its words, the words and marks around it, a transition from a segment just before it), and
dynamic programming over the candidates chooses boundaries and kinds together. The weights maximise the conditional likelihood
(forward-backward over the same lattice) of segments that telling contexts label in a bounded sample of the corpus; segments
whose label the contexts leave open stay out of the training lattice. Prediction is a map over the corpus: no shuffle, and only the
weights (at most FEATURES of them) are broadcast.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
#: Bounds of the fit: rows of the sample, characters of a row in it, passes, features kept.
SAMPLE_ROWS, SAMPLE_CHARS, PASSES, FEATURES = 6_000, 4_000, 4, 50_000
#: Segments this close (characters) have a transition weight.
NEAR = 3

_U, _L = "A-ZÀ-ÖØ-ÞŁŚŻŠŽČĆĐŘĚŇŮΑ-ΩА-ЯЁЄІЇ", "a-zß-öø-ÿłśżšžčćđęąńőřěňůά-ώа-яёєії"
_CAP = rf"[{_U}][{_L}{_U}'’]+(?:-[{_U}][{_L}{_U}'’]+)*"
_RUN = re.compile(rf"(?<![\w@./-])(?:{_CAP}|[{_U}]\.)(?:,? (?:{_CAP}|[{_U}]\.|(?:van|von|de|der|del|la|bin|al)(?= [{_U}])))+")
_PART = re.compile(r"[^ ]+")
_LOCAL, _DOT = r"(?<![\w.+@/-])[A-Za-z0-9](?:[\w.+-]*\w)?", r"(?:\.| ?[\[({<] ?(?:dot|DOT) ?[\])}>] ?| dot )"
_HOST = rf"(?:[A-Za-z0-9-]+{_DOT})+[A-Za-z]{{2,12}}(?![\w@-]|\.\w)"
#: Addresses with a sign for "at", and with the word; the latter may overlap.
_MAIL = re.compile(rf"{_LOCAL}(?:@| ?[\[({{<] ?(?:at|AT) ?[\])}}>] ?){_HOST}")
_MAIL_WORDS = re.compile(rf"(?={_LOCAL} at )(?=({_LOCAL} at {_HOST}))")
_NUMBER = re.compile(r"(?<![\w.+])(?:(?:\+|00)\d{1,3}[ .-]?)?\(?\d(?:[ .()/-]{0,2}\d){6,16}(?![\w])")
_IDS = re.compile(
    r"(?<![\w.-])(?:\d{3}[- ]?\d{2}[- ]?\d{4}|[A-Za-z]{2}(?: ?\d{2}){3} ?[A-Za-z]|\d{6}[-+ ]?\d{4}|[A-Za-z]{1,2}\d{2}-\d{6}-\d|[A-Za-z]{1,3}-?\d{6,9}[A-Za-z]?|\d{8}-?[A-Z]|[A-Z]-?\d{7}-?[A-Z]|\d{11}|\d{9})(?![\w])(?!-\d)"
)
_FRONT = re.compile(rf"(?<![\w./:-])\d{{1,5}}[A-Za-z]?,? (?:[{_U}][\w'’]*\.?(?:-[{_U}]\w+)?(?: |(?![\w-]))){{1,5}}")
_BACK = re.compile(rf"(?<![\w./:-])[{_U}][\w'’-]*\.?(?: (?:[{_U}][\w'’-]*\.?|de|del|la|las|los|el|der|am|an|im|zum|zur)){{0,4}},? \d{{1,5}}(?: ?[A-Za-z])?(?![\w.:/-])")
_HEX = re.compile(r"(?:^ ?|\b)(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{6,}(?: ?$|\b)")


#: Words for kinds of streets, without full stop, in English (last word) and in German and Spanish.
STREETS = frozenset(
    """street st road rd avenue ave lane ln drive dr court ct close row terrace place pl way square sq crescent boulevard blvd grove mews parade walk hill
    straße strasse str allee weg gasse platz ring damm ufer chaussee calle avenida avda paseo plaza camino ronda carrera travesía rue via viale""".split()
)


def _shape(s: str) -> str:
    return re.sub(r"a+", "a", re.sub(r"A+", "A", re.sub(r"[A-Z]", "A", re.sub(r"[^\W\d_A-Z]", "a", re.sub(r"\d", "9", s)))))


def _street(s: str) -> str:
    """Where an address candidate names its kind of street: "end" (before or after the number), "start", "joined" or "no"."""
    words = [w.strip(".,").lower() for w in re.findall(r"[^\W\d_][\w'’.-]*", s)]
    if not words:
        return "no"
    if s[0].isdigit():
        words = [w for w in words if len(w) > 1] or words
        return "end" if words[-1] in STREETS else "inner" if any(w in STREETS for w in words) else "no"
    words = words[:-1] if len(words) > 1 and len(words[-1]) == 1 else words
    return "start" if words[0] in STREETS else "end" if words[-1] in STREETS else "joined" if re.search(r"(?:straße|strasse|weg|gasse|platz|allee|str)$", words[-1]) else "no"


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), sorted; several may overlap."""
    out = set()
    for m in _MAIL.finditer(text):
        out.add((m.start(), m.end(), "EMAIL"))
    for m in _MAIL_WORDS.finditer(text):
        out.add((m.start(1), m.end(1), "EMAIL"))
    for m in _NUMBER.finditer(text):
        s = m.group()
        ends = {i + 1 for i in range(len(s)) if s[i].isdigit() and (i + 1 == len(s) or not s[i + 1].isdigit())}
        starts = {0} | {i for i in range(1, len(s)) if s[i - 1] in " (" and s[i] in "(0123456789"}
        for a in starts:
            for b in ends:
                piece = s[a:b]
                if 9 <= sum(map(str.isdigit, piece)) <= 15 and piece.count("(") == piece.count(")"):
                    out.add((m.start() + a, m.start() + b, "PHONE"))
    for m in _IDS.finditer(text):
        out.add((m.start(), m.end(), "ID_NUMBER"))
    for m in _FRONT.finditer(text):
        s = m.group().rstrip()
        cuts = [x.end() for x in _PART.finditer(s)]
        for c in cuts[2:]:
            out.add((m.start(), m.start() + len(s[:c].rstrip(".,'’")), "ADDRESS"))
    for m in _BACK.finditer(text):
        s = m.group()
        for p in list(_PART.finditer(s))[:-1]:
            if p.group()[0].isupper():
                out.add((m.start() + p.start(), m.end(), "ADDRESS"))
    for m in _RUN.finditer(text):
        parts = [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m.group())]
        for i in range(len(parts)):
            for j in range(i + 1, min(i + 4, len(parts))):
                a = parts[i][0]
                s = text[a : parts[j][1]].rstrip(",")
                b = a + len(s)
                if "," in s and (s.count(",") > 1 or text[parts[i][1] - 1] != "," or s[1] == "."):
                    continue
                if s.endswith(".") and not ("," in s and s[-2:-1].isupper()):
                    continue
                out.add((a, b, "NAME"))
    return sorted(out)


class Lexicon:
    """Words of labelled names, and words that occur in lower case, in the sample."""

    def __init__(self, given: set[str], family: set[str], common: set[str]):
        self.given, self.family, self.common = given, family, common


_WORDS = re.compile(r"[^\W_]+|[^\w\s]")


def _before(text: str, a: int) -> tuple[str, str, str, bool, str]:
    """What stands before an offset: the text, its last two words or marks, whether the last begins in upper case, and the character just before (a for letters and digits)."""
    left = text[max(0, a - 40) : a]
    words = _WORDS.findall(left)[-2:]
    return left, words[-1].lower() if words else "^", words[-2].lower() if len(words) > 1 else "^", bool(words) and words[-1][0].isupper(), left[-1:] if not left[-1:].isalnum() else "a"


def _behind(text: str, b: int) -> tuple[str, str, bool, str]:
    """What stands behind an offset, as in _before(), with one word."""
    right = text[b : b + 24]
    m = _WORDS.search(right)
    return right, m.group().lower() if m else "$", bool(m) and m.group()[0].isupper(), right[:1] if not right[:1].isalnum() else "a"


def features(text: str, a: int, b: int, kind: str, lex: Lexicon, memo: dict | None = None) -> list[str]:
    """The features of a segment. memo: keeps what stands around the offsets of one text, which candidates share."""
    memo = {} if memo is None else memo
    if (around := memo.get(a)) is None:
        around = memo[a] = _before(text, a)
    if (behind := memo.get(~b)) is None:
        behind = memo[~b] = _behind(text, b)
    s, (left, p1, p2, upper_before, at), (right, n1, upper_behind, to) = text[a:b], around, behind
    out = [kind, f"{kind}<{p1}", f"{kind}<{p2} {p1}", f"{kind}>{n1}", f"{kind}<<{at}", f"{kind}>>{to}"]
    if kind == "NAME":
        parts = re.split(r",? ", s)
        low = [w.rstrip(".").lower() for w in parts]
        kinds = "".join("i" if len(w) < 3 and w.endswith(".") else "U" if w.isupper() else "c" for w in parts) + ("," if "," in s else "")
        known = _known(s, lex)
        camel = any(re.search(r"[a-z][A-Z]", w) for w in parts)
        side = lambda x: "F" if x in lex.family else "G" if x in lex.given else "n"
        out += [f"N:{',' in s} after {side(p1) if left[-1:] == ' ' and upper_before else '-'}", f"N:{',' in s} before {side(n1) if right[:1] == ' ' and upper_behind else '-'}"]
        out += [f"N:{kinds}", f"N:{known}", f"N:camel{camel}", f"N:common{sum(w in lex.common for w in low)}", f"N:open{min(2, len(parts))}"]
    elif kind == "ADDRESS":
        w = [x.lower().strip(".,") for x in s.split()]
        front = s[0].isdigit()
        out += [f"A:street {_street(s)}", f"A:{'front' if front else 'back'}", f"A:{w[-1] if front else w[0]}", f"A:{w[-2] if front else w[-2]}", f"A:n{len(w)}", f"A:hyphen{right[:1] == '-'}", f"A:len{max(map(len, re.findall(r'\d+', s)), default=0)}"]
        if any(re.search(r"[a-z][A-Z]", x) for x in s.split()):
            out.append("A:camel")
    elif kind == "EMAIL":
        sep = re.sub(r"[A-Za-z0-9]", "", re.sub(r"[A-Za-z0-9_.+-]+", "a", s, count=1))
        tld = re.search(r"[A-Za-z]+$", s).group().lower()
        way = "@" if "@" in s else "[" if re.search(r"[\[({<]", s) else "at"
        local = re.match(r"[^@\[({< ]*", s).group()
        out += [f"E:{way}", f"E:{tld in TOP}{way}", f"E:dot{'.' in s[len(local):]}{way}", f"E:mark{bool(re.search(r'[0-9._+-]', local))}{way}", f"E:colon{right[:1] == ':' and right[1:2].isalnum()}", f"E:pre{left[-1:] == '/'}", f"E:sep{len(sep) > 4}"]
    else:
        digits = sum(map(str.isdigit, s))
        if _HEX.search(left[-12:]) or _HEX.match(right[:12]):
            out.append(f"{kind[0]}:hex")
        year = bool(re.match(r"(?:19|20)\d\d", s)) and digits > 9
        out += [f"{kind[0]}:{_shape(s)}", f"{kind[0]}:n{digits}", f"{kind[0]}:{'+' if s[0] == '+' else '(' if s[0] == '(' else '00' if s[:2] == '00' else '0' if s[0] == '0' else 'd'}", f"{kind[0]}:year{year}", f"{kind[0]}:same{len(set(re.sub(r'[^0-9]', '', s))) < 3}"]
    return out


#: Top-level domains, generic and reserved.
TOP = frozenset("com org net edu gov int io dev app info biz name eu uk de fr es it nl se no fi dk pl ch at cz pt ru cn jp in br mx us ca au nz example test invalid localhost".split())
#: Contexts that label a candidate of the sample, in the languages of the corpus: words that stand right before a piece of its kind wherever people write to each other
#: or fill in forms (salutations, by-lines, the names of form fields), and words right after. What they leave open is not used in training.
_Q = r"[\"'(<|:=\s;,/.：]*"
_FOR = {
    "NAME": (r"(?i:\b(?:hi|hello|dear|cc|contact(?:o)?|联系人|(?:reported|signed|written|started|reviewed|approved|sent|called|answered|handled|owned|requested|opened|closed|raised) by|(?:reviewed|signed-off|acked|tested)[- ]by|@?author|maintainer|owner|user|name|nombre|handed to|letter to|thanks|regards|gruß|grüße|bitte|liebe[r]?|hallo|hola|saludos|gracias|mr|mrs|ms|dr|herr|frau|señor|señora))" + _Q + r"$", r"^" + _Q + r"(?:signed off|wrote|said|called|asked|replied|reported|approved|fragen)\b"),
    "PHONE": (r"(?i:\b(?:tel|tel[eé]fono?|telefon|rufnummer|fon|fax|call|dial|cell|phone|mobile|mobil|m[oó]vil|llamar al|ring|reach (?:me|us) on)|电话|手机)\"?" + _Q + r"$", r"^ (?:ext|durchwahl)\b"),
    "ID_NUMBER": (r"(?i:\b(?:ssn|social security(?: number)?|passport(?: no| number)?|(?:personal|national|tax|taxpayer|identity|insurance|travel document|document|nin|dni|nie|nif|ausweis|steuer)(?: ?-?(?:id|no|number|nummer|identification))?|documento|n[uú]mero)(?: (?:is|was|holds|contains|reads))?|证件号|身份证号?|护照号?)\"?" + _Q + r"$", r"^$"),
    "ADDRESS": (r"(?i:\b(?:lives? (?:at|in)|address|addr|adresse|direcci[oó]n|wohnhaft|wohnt|vive en|domicilio|street|moved (?:from|to)|drop(?:s|ped)? at|deliver(?:ed|s)? (?:to|at)|ship to|desk at|office at|home at)|地址|寄到|住在)\"?" + _Q + r"$", r"^$"),
    "EMAIL": (r"(?i:\b(?:e-?mail|mail|correo|notify|contact|reach me at|write to)|邮箱|邮件)\"?" + _Q + r"$", r"^$"),
}
_AGAINST = re.compile(r"(?i:\b(?:build|trace|span|version|release|licen[cs]e|range|rule|port|pid|hash|ticket|issue|window|runner|team|the|commit|id|revision|line|row|order|job|port))" + r"[\s:=#]*$")
_NO_MAIL = re.compile(r"(?i:\b(?:remote(?: is)?|clone|npm|install|handle|pull|push|fetch|package))[\s:=]*$")
_FOR_RE = {k: (re.compile(a), re.compile(b)) for k, (a, b) in _FOR.items()}


#: Words of greeting and title, which are part of no name.
_POLITE = frozenset("hi hello dear regards wishes thanks sincerely gruß grüße grüßen bitte liebe lieber hallo hola saludos gracias atentamente mr mrs ms dr prof herr frau señor señora kind best many".split())

#: Orders of given (G) and family (F) names and initials (i) that are a name whatever stands around them.
_NAMES = frozenset(["GF", "GiF", "iF", "iiF", "F,G", "F,Gi", "F,i"])


def _known(s: str, lex: Lexicon) -> str:
    """The words of a name candidate: G given, F family, B both, i initial, w common, ? unknown; a comma if it has one."""
    out = ""
    for w in re.split(r"(,?) ", s):
        if w in (",", ""):
            out += w
            continue
        w = w.rstrip(".").lower()
        some = {*w.split("-")}
        g, f = some & lex.given, some & lex.family or w in lex.family
        out += "i" if len(w) == 1 else "B" if g and f else "G" if g else "F" if f else "w" if w in lex.common else "?"
    return out


def label(text: str, cand: list[tuple[int, int, str]], common: set[str], lex: Lexicon | None = None) -> list[int | None]:
    """1 personal, 0 not, None open, for each candidate, by contexts alone, or by contexts and the names of a first fit."""
    got: list[int | None] = []
    for a, b, kind in cand:
        s, left, right = text[a:b], text[max(0, a - 30) : a], text[b : b + 30]
        before, after = _FOR_RE[kind]
        hit = bool(before.search(left) or after.search(right))
        if kind == "EMAIL":
            hit = hit or "@" in s and s.rpartition(".")[2].lower() in TOP and not re.match(r":\w", right)
        if kind == "NAME":
            low = [w.strip(".,").lower() for w in s.split()]
            hit = hit or lex is not None and _known(s, lex) in _NAMES
            if any(re.search(r"[a-z][A-Z]", w) for w in s.split()) or sum(w in common for w in low) == len(low) or any(w in _POLITE for w in low):
                got.append(0)
                continue
            full = [w.isupper() for w in re.split(r",? ", s) if len(w.strip(".")) > 1]
            if any(full) and not all(full) or any(len(w) > 1 and w in common for w in low):
                got.append(None if hit else 0)
                continue
        if kind in ("PHONE", "ID_NUMBER") and (_HEX.search(left[-12:]) or _HEX.match(right[:12])):
            got.append(0)
            continue
        if kind == "ADDRESS" and _street(s) in ("no", "inner"):
            got.append(0)
            continue
        if kind in ("PHONE", "ID_NUMBER") and hit and len(set(re.sub(r"\D", "", s))) < 2:
            hit = False
        if kind == "EMAIL":
            against = _NO_MAIL.search(left) or re.match(r":\w", right) or re.search(r"[A-Za-z]+$", s).group().lower() not in TOP
        else:
            against = _AGAINST.search(left) or right[:1] == "-"
        got.append(1 if hit else 0 if against else None)
    # of overlapping positives those stay that cover most together; whatever overlaps one of them is negative
    order = sorted((i for i, g in enumerate(got) if g == 1), key=lambda i: (cand[i][1], cand[i][0]))
    ends = [cand[i][1] for i in order]
    best: list[tuple[int, tuple]] = [(0, ())]
    for n, i in enumerate(order):
        a, b, _ = cand[i]
        before = best[bisect.bisect_right(ends, a, 0, n)]
        best.append(max(best[-1], (before[0] + b - a, (*before[1], i)), key=lambda x: x[0]))
    stay = set(best[-1][1])
    taken = [cand[i][:2] for i in stay]
    for i in order:
        got[i] = int(i in stay)
    for i, (a, b, _) in enumerate(cand):
        if got[i] is None and any(x < b and a < y for x, y in taken):
            got[i] = 0
    return got


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def fit(texts: list[str]) -> tuple[dict[str, float], Lexicon]:
    """Weights and lexicon from a bounded list of texts. Deterministic."""
    lower = Counter(w for t in texts for w in set(re.findall(r"(?<![\w@.+-])[a-zß-ÿ]{2,}(?![\w@.+-])", t)))
    common = {w for w, n in lower.items() if n >= 3}
    lex = None
    for _ in range(2):  # the names that contexts label first then label themselves elsewhere
        rows, given, family = [], Counter(), Counter()
        for t in texts:
            cand = candidates(t)
            known = [(c, g) for c, g in zip(cand, label(t, cand, common, lex)) if g is not None]
            if known:
                rows.append((t, known))
            for (a, b, k), g in known:
                if g and k == "NAME":
                    s = t[a:b]
                    first, last = s.split(", ")[::-1] if "," in s else (s.rpartition(" ")[0], s.rpartition(" ")[2])
                    given.update(w.strip(".").lower() for w in re.split(r"[ -]", first) if len(w.strip(".")) > 1)
                    family.update([last.lower(), *([] if "-" not in last else last.lower().split("-"))] if len(last) > 2 else [])
        lex = Lexicon({w for w, n in given.items() if n >= 2 and n >= family[w]}, {w for w, n in family.items() if n >= 2 and n >= given[w]}, common)
    data = []
    for t, known in rows:
        memo: dict = {}
        data.append([(a, b, k, g, features(t, a, b, k, lex, memo)) for (a, b, k), g in known])
    seen = Counter(f for row in data for x in row for f in x[4])
    keep = {f for f, n in seen.most_common(FEATURES) if n >= 2}
    w: dict[str, float] = dict.fromkeys(keep, 0.0)
    square: dict[str, float] = dict.fromkeys(keep, 1e-6)
    for p in range(PASSES):
        for row in data:
            fs = [[f for f in x[4] if f in keep] for x in row]
            s = [sum(w[f] for f in x) for x in fs]
            n = len(row)
            near = lambda i, j: w.get(f"{row[i][2]}+{row[j][2]}", 0.0) if 0 <= row[j][0] - row[i][1] <= NEAR else 0.0
            fore, back = [0.0] * n, [0.0] * n
            order = sorted(range(n), key=lambda i: row[i][0])
            for i in order:
                fore[i] = s[i] + _log_add([0.0] + [fore[j] + near(j, i) for j in order if row[j][1] <= row[i][0]])
            for i in reversed(order):
                back[i] = _log_add([0.0] + [s[k] + near(i, k) + back[k] for k in order if row[k][0] >= row[i][1]])
            z = _log_add([0.0, *fore])
            for i in range(n):
                g = row[i][3] - math.exp(min(0.0, fore[i] + back[i] - z))
                if abs(g) > 1e-3:
                    for f in fs[i]:
                        square[f] += g * g
                        w[f] += 0.5 * (g - 2e-4 * w[f]) / math.sqrt(square[f])
            for i in range(n):  # transitions: observed minus expected
                for j in range(n):
                    if 0 <= row[j][0] - row[i][1] <= NEAR:
                        key = f"{row[i][2]}+{row[j][2]}"
                        both = math.exp(min(0.0, fore[i] + near(i, j) + s[j] + back[j] - z))
                        w[key] = w.get(key, 0.0) + 0.05 * (row[i][3] * row[j][3] - both)
    return w, lex


def find(text: str, w: dict[str, float], lex: Lexicon) -> list[tuple[int, int, str]]:
    """The best-scoring set of segments that do not overlap."""
    cand = candidates(text)
    if not cand:
        return []
    cand.sort(key=lambda c: (c[1], c[0]))
    ends, best, via = [], [], []  # by end: the best score of a chain that ends with this candidate
    top, top_at, memo = [], [], {}  # best over all candidates up to here
    for i, (a, b, k) in enumerate(cand):
        s = sum(w.get(f, 0.0) for f in features(text, a, b, k, lex, memo))
        # chains that end NEAR or more before it have no transition; those that end closer pay theirs, whatever its sign
        far, close = bisect.bisect_left(ends, a - NEAR), bisect.bisect_right(ends, a)
        before, at = (top[far - 1], top_at[far - 1]) if far and top[far - 1] > 0 else (0.0, -1)
        for j in range(far, close):
            x = best[j] + w.get(f"{cand[j][2]}+{k}", 0.0)
            if x > before:
                before, at = x, j
        ends.append(b)
        best.append(s + before)
        via.append(at)
        if top and top[-1] >= best[-1]:
            top.append(top[-1])
            top_at.append(top_at[-1])
        else:
            top.append(best[-1])
            top_at.append(i)
    out, i = [], top_at[-1] if top[-1] > 0 else -1
    while i >= 0:
        out.append(cand[i])
        i = via[i]
    return out[::-1]


def train(df: DataFrame, ident: str, text: str) -> tuple[dict[str, float], Lexicon]:
    """Fits on at most SAMPLE_ROWS texts of at most SAMPLE_CHARS characters, the ones of smallest id hash: a uniform, repeatable sample."""
    sample = df.where(F.length(text).between(1, SAMPLE_CHARS)).select(ident, text).orderBy(F.xxhash64(ident), ident, text).limit(SAMPLE_ROWS)
    return fit([r[1] for r in sample.collect()])


def segments(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, kind, start, end, pii_text, clean): found segments of each text (start and end count characters), with the text in which each is
    replaced by its kind in brackets. Texts without a finding, NULL and empty texts have one row with NULL kind."""
    w, lex = train(df, ident, text)
    model = df.sparkSession.sparkContext.broadcast((w, lex))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, words = model.value
        for pdf in batches:
            out = []
            for i, t in zip(pdf[ident], pdf[text]):
                got = find(t, weights, words) if isinstance(t, str) and t else []
                clean, at = [], 0
                for a, b, k in got:
                    clean += [t[at:a], f"[{k}]"]
                    at = b
                whole = "".join([*clean, t[at:]]) if isinstance(t, str) else None
                out += [(i, k, a, b, t[a:b], whole) for a, b, k in got] or [(i, None, None, None, None, whole)]
            yield pd.DataFrame(out, columns=[ident, "kind", "start", "end", "pii_text", "clean"]).astype({"start": "Int32", "end": "Int32"})

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, text).mapInPandas(rows, f"`{ident}` {kind}, kind string, start int, end int, pii_text string, clean string")


def found(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, kind, pii_text), distinct."""
    return segments(df, ident, text).where("kind is not null").select(ident, "kind", "pii_text").distinct()


def masked(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, clean): every text with its findings replaced; NULL stays NULL."""
    return segments(df, ident, text).select(ident, "clean").distinct()
