"""Grammars and token patterns of the five languages for the chart parser (Java 17, JavaScript, Python 3, strict JSON, XML)."""

from __future__ import annotations

import re

from .chart import Grammar

# ---------------------------------------------------------------- Java
JAVA = r"""
File = ( Ann* package Qual ; )? ( import static? Qual ( . '*' )? ; | ; )* ( TypeDecl | ; )*
Id = I | var | record | yield | sealed | permits | when
Qual = Id % .
Ann = @ Qual P[AnnArgs]?
Mod = public | protected | private | static | abstract | final | native | synchronized | transient | volatile | strictfp | default | sealed | non-sealed | Ann
TArgs = < ( TAtom % TSep )? >
TAtom = Ann? ( '?' | ( '?' ( extends | super ) )? ( PRIM | Id ) TArgs? ) K[Empty]*
TSep = , | . | &
Type = Ann* ( PRIM | ( Id TArgs? ) % . ) ( Ann* K[Empty] )*
TParams = < ( Ann* Id ( extends ( Type % & ) )? ) % , >
Types = Type % ,
TypeDecl = Mod* ( class Id TParams? ( extends Type )? ( implements Types )? ( permits Types )? B[ClassBody] | @? interface Id TParams? ( extends Types )? ( permits Types )? B[ClassBody]
  | enum Id ( implements Types )? B[EnumBody] | record Id TParams? P[Params] ( implements Types )? B[ClassBody] )
Empty =
ClassBody = Member*
Member = ; | static? B[Block] | TypeDecl | Mod* TParams? ( Id ( P[Params] Throws? )? B[Block] | ( void | Type ) Id P[Params] K[Empty]* Throws? ( B[Block] | ; | default AnnVal ; ) ) | Mod* Type ( Declr % , ) ;
Throws = throws Types
Declr = Id K[Empty]* ( EQ ( Expr | B[ArrayInit] ) )?
ArrayInit = ( ( Expr | B[ArrayInit] ) % , )? ,?
EnumBody = ( ( Ann* Id P[Args]? B[ClassBody]? ) % , )? ,? ( ; Member* )?
Params = ( ( ( final | Ann )* Type ...? ( Id | this ) K[Empty]* ) % , )?
LParams = ( Id % , )? | Params
Args = ( Expr % , )?
AnnArgs = ( Id EQ AnnVal ) % , | AnnVal?
AnnVal = Expr | Ann | B[AnnArr]
AnnArr = ( AnnVal % , )? ,?
Paren = Expr
CastType = Type % &
Catch = ( final | Ann )* ( Type % '|' ) Id
Resources = ( ( ( final | Ann )* Type Id EQ Expr | Expr ) % ; ) ;?
ForHead = ( ( final | Ann )* Type Id : Expr ) | ( ( final | Ann )* Type ( Declr % , ) | Expr % , )? ; Expr? ; ( Expr % , )?
RecPat = ( ( Type Id | Type P[RecPat] Id? ) % , )?
Block = Stmt*
Pre = while P[Paren] | for P[ForHead] | Id : | if P[Paren] | if P[Paren] ( Inner | Branch ) else
Stmt = Pre* Core
Branch = Stmt
Inner = ( while P[Paren] | for P[ForHead] | if P[Paren] )* Core
Core = B[Block] | ; | ( return | throw | yield ) Expr ; | assert ( Expr % : ) ; | Effect ; | return ; | ( break | continue ) Id? ; | do ( B[Block] | Branch ) while P[Paren] ;
  | ( final | Ann )* Type ( Declr % , ) ; | try ( P[Resources] B[Block] ( catch P[Catch] B[Block] )* | B[Block] ( catch P[Catch] B[Block] )+ ) ( finally B[Block] )? | try B[Block] finally B[Block]
  | switch P[Paren] B[SwitchBody] | synchronized P[Paren] B[Block] | ( abstract | final | static | strictfp | Ann )* ( class Id TParams? ( extends Type )? ( implements Types )? B[ClassBody] | enum Id ( implements Types )? B[EnumBody] | interface Id TParams? ( extends Types )? B[ClassBody] | record Id TParams? P[Params] ( implements Types )? B[ClassBody] )
Effect = Prim Post* ( P[Args] | ( '++' | -- ) | ( EQ | ASSIGN ) Expr ) | New ( . Id | K[Paren] | P[Args] )* | ( '++' | -- ) Prim Post*
SwitchBody = ( Label ( Label | Stmt )* )?
Label = ( case ( ( Expr | Type Id | Type P[RecPat] | default ) % , ) ( when Expr )? | default ) ( : | -> ( Expr ; )? )
Lam = ( Id | P[LParams] ) ->
Un = ( '+' | - | ! | ~ | '++' | -- | P[CastType] )* Lam* ( Prim | New ) Post* ( '++' | -- )? | P[CastType]* Lam+ B[Block]
Prim = LIT | Id | this | super | P[Paren] | switch P[Paren] B[SwitchBody] | PRIM K[Empty]* ( . class | :: new ) | void . class | Id ( . Id )* K[Empty]+ ( . class | :: new ) | Id TArgs ( . Id TArgs? )* K[Empty]* :: ( Id | new )
New = new Ann* ( PRIM | ( Id TArgs? ) % . ) ( P[Args] B[ClassBody]? | K[Paren]+ K[Empty]* | K[Empty]+ B[ArrayInit] )
Post = . ( ( < ( ( Id % . ) % , ) > )? Id | this | super | class | new Id P[Args] B[ClassBody]? ) | P[Args] | K[Paren] | :: ( Id | new )
Op = '+' | - | '*' | / | MOD | & | '|' | ^ | && | '||' | == | != | < | > | <= | > > | > > > | < < | EQ | ASSIGN | GE
Bin = ( Un ( instanceof final? Ann* Type ( Id | P[RecPat] Id? )? )? ) % Op
Expr = Bin % ( '?' Expr : )
"""
#: Reserved words of Java, and words with a meaning in some places only.
JAVA_WORDS = frozenset(
    """abstract assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface native new package private
    protected public return static strictfp super switch synchronized this throw throws transient try void volatile while const goto""".split()
)
JAVA_SOFT = frozenset("var record yield sealed permits when".split())
_JAVA = re.compile(
    r'(?P<space>\s+|//[^\n\r]*|/\*[\s\S]*?\*/)|(?P<str>"""[ \t\f]*\r?\n(?:\\[\s\S]|(?!""")[^\\])*"""|"(?!"")(?:\\(?:[btnfrs"\'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4})|[^"\\\r\n])*"|""(?!")|\'(?:\\(?:[btnfrs"\'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4})|[^\'\\\r\n]{1,2})\')'
    r"|(?P<num>(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))"
    r"|(?P<word>non-sealed\b|[^\W\d][\w$]*|\$[\w$]*)|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<op>->|::|\.\.\.|\+\+|--|&&|\|\||==|!=|<=|<<=|>>>=|>>=|>=|[-+*/%&|^]=|[-+*/%&|^!~?:;,.@<>=])"
)
_PRIMITIVE = frozenset("int long short byte char boolean float double".split())
_LITERAL = frozenset("true false null".split())
_ASSIGN = frozenset("+= -= *= /= %= &= |= ^= <<= >>= >>>=".split())
_KIND = {"(": "P", "[": "K", "{": "B", ")": "P", "]": "K", "}": "B"}


def _lines(text: str):
    """A function from rising offsets to line numbers."""
    state = [0, 1]

    def line(at: int) -> int:
        state[1] += text.count("\n", state[0], at)
        state[0] = at
        return state[1]

    return line


def _bad(text: str, at: int) -> int:
    """Where scanning goes on after an offset at which no token begins."""
    m = re.compile(r"\w+|.|\n").match(text, at)
    return m.end()


def java_tokens(text: str) -> list[tuple[str, str, int]]:
    out, at, line, n = [], 0, _lines(text), len(text)
    match, add = _JAVA.match, out.append
    while at < n:
        m = match(text, at)
        if m is None:
            add(("!", "lexical", line(at)))
            at = _bad(text, at)
            continue
        kind, s = m.lastgroup, m.group()
        if kind == "word":
            if s in JAVA_WORDS or s in JAVA_SOFT or s == "non-sealed":
                add(("", s, line(at)))
            else:
                add(("", "PRIM" if s in _PRIMITIVE else "LIT" if s in _LITERAL else "I", line(at)))
        elif kind == "op":
            add(("", "EQ" if s == "=" else "ASSIGN" if s in _ASSIGN else "MOD" if s == "%" else "GE" if s == ">=" else s, line(at)))
        elif kind == "open":
            add(("<", _KIND[s], line(at)))
        elif kind == "close":
            add((">", _KIND[s], line(at)))
        elif kind != "space":
            add(("", "LIT", line(at)))
        at = m.end()
    return out


# ---------------------------------------------------------------- JavaScript (script or CommonJS module)
JS = r"""
File = Stmt*
Block = Stmt*
Id = I | let | async | of | get | set | static | await | yield
End = ; | NL | EOB
Pre = ( while | with ) P[Cond] | for await? P[ForHead] | Id : | if P[Cond] | if P[Cond] Stmt else
Stmt = Pre* Core
Core = B[Block] | ; | ( var | let | const ) ( ( Target ( EQ Expr )? ) % , ) End | ( throw | return )? Exprs End | return End | ( break | continue ) Id? End | debugger End | do Stmt while P[Cond] End? | try B[Block] ( catch P[Bind]? B[Block] ( finally B[Block] )? | finally B[Block] )
  | switch P[Cond] B[SwitchBody] | async? function '*'? Id P[Params] B[Block] | class Id ( extends Base )? B[ClassBody]
Base = ( Id | P[Group] ) ( . Name | P[Args] | K[Index] )*
Target = Id | K[Array] | B[Object]
Bind = Target
SwitchBody = ( ( case Exprs | default ) : Stmt* )*
Cond = Exprs
ForHead = ( ( var | let | const ) ( ( Target ( EQ Expr )? ) % , ) | Exprs )? ; Exprs? ; Exprs? | ( var | let | const )? ForTarget ( in Exprs | of Expr )
ForTarget = Target | Prim Post+
Params = ( ( ...? Target ( EQ Expr )? ) % , )? ,?
Args = ( ( ...? Expr ) % , )? ,?
Array = ( ,* ( ...? Expr ) ( ,+ ...? Expr )* )? ,*
Index = Exprs
Hole = ( Exprs % MID )
Object = ( Prop % , )? ,?
Prop = ... Expr | Key : Expr | Id ( EQ Expr )? | ( async | '*' | async '*' | get | set )? Key P[Params] B[Block]
Key = Id | S | N | K[Index] | PRIVATE | LIT | KEYWORD
ClassBody = ( ; | NL | EOB | static B[Block] | static? ( async | '*' | async '*' | get | set )? Key P[Params] B[Block] | static? Key ( EQ Expr )? End )*
Lam = async? ( Id | P[Params] ) ->
Un = ( '+' | - | ! | ~ | '++' | -- | typeof | void | delete | await | yield '*'? | new )* Lam* ( Prim Post* ( '++' | -- )? ) | ( ! | '+' | - | void | await )* Lam+ B[Block] | yield
Prim = LIT | Id | S | N | RE | T[Hole] | this | super | P[Group] | K[Array] | B[Object] | async? function '*'? Id? P[Params] B[Block] | class Id? ( extends Base )? B[ClassBody] | new . Id | import P[Args] | PRIVATE
Group = Exprs
Post = '?.' ( Name | P[Args] | K[Index] ) | . ( Name | PRIVATE ) | P[Args] | K[Index] | S_T | T[Hole]
Name = Id | WORD | LIT
Op = '+' | - | '*' | '**' | / | MOD | & | '|' | ^ | && | '||' | '??' | CMP | in | instanceof | EQ | ASSIGN
Bin = Un % Op
Expr = Bin % ( '?' Expr : )
Exprs = Expr % ,
"""
#: Reserved words of JavaScript.
JS_WORDS = frozenset(
    """break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof
    var void while with enum""".split()
)
JS_SOFT = frozenset("let async of get set static await yield".split())
JS = JS.replace("KEYWORD", " | ".join(sorted(JS_WORDS)))
_JS = re.compile(
    r"(?P<space>[^\S\n\r\u2028\u2029]+|//[^\n\r]*|\#!(?<!.\#!)[^\n]*)|(?P<nl>[\n\r\u2028\u2029]|/\*[\s\S]*?\*/)|(?P<str>\"(?:\\[\s\S]|[^\"\\\r\n])*\"|'(?:\\[\s\S]|[^'\\\r\n])*')"
    r"|(?P<num>(?:0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO]?[0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)(?![\w$]))|(?P<word>\#?(?:[^\W\d]|\$)[\w$\u200c\u200d]*)|(?P<open>[({\[])|(?P<close>[)}\]])"
    r"|(?P<op>=>|\.\.\.|\?\.(?!\d)|\?\?=|\?\?|\*\*=|\*\*|\+\+|--|&&=|\|\|=|&&|\|\||===|!==|==|!=|<=|>>>=|>>>|>>=|>>|<<=|<<|>=|[-+*%&|^]=|[-+*%&|^!~?:;,.<>=])"
)
_JS_RE = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[\w$]*")
_JS_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*(`|\$\{)")
_JS_CMP = frozenset("== != === !== < > <= >= >> << >>>".split())


def js_tokens(text: str) -> list[tuple[str, str, int]]:
    out, at, line, n = [], 0, _lines(text), len(text)
    add, braces, operand = out.append, [], False  # operand: the last token ends an operand, so `/` divides
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    while at < n:
        c = text[at]
        if c == "/" and not operand and (m := _JS_RE.match(text, at)):
            add(("", "RE", line(at)))
            at, operand = m.end(), True
            continue
        if c == "/" and text[at : at + 2] not in ("//", "/*"):
            size = 2 if text[at : at + 2] == "/=" else 1
            add(("", "ASSIGN" if size == 2 else "/", line(at)))
            at, operand = at + size, False
            continue
        if c == "`" or c == "}" and braces and braces[-1] == "T":
            m = _JS_TEMPLATE.match(text, at + 1)
            if m is None:
                add(("!", "lexical", line(at)))
                at = n
                continue
            whole = m.group(1) == "`"
            if c == "`":
                add(("", "S_T" if operand else "S", line(at)) if whole else ("<", "T", line(at)))
                if not whole:
                    braces.append("T")
            elif whole:
                add((">", "T", line(at)))
                braces.pop()
            else:
                add(("", "MID", line(at)))
            at, operand = m.end(), whole
            continue
        m = _JS.match(text, at)
        if m is None:
            add(("!", "lexical", line(at)))
            at = _bad(text, at)
            continue
        kind, s = m.lastgroup, m.group()
        if kind == "nl":
            if "\n" in s or "\r" in s or len(s) == 1:
                if out and out[-1][1] != "NL":
                    add(("", "NL", line(at)))
        elif kind == "word":
            name = "PRIVATE" if s[0] == "#" else s if s in JS_SOFT else "LIT" if s in _LITERAL else s if s in JS_WORDS else "I"
            last = next((x for x in reversed(out[-2:]) if x[1] != "NL"), None)
            after_dot = last is not None and not last[0] and last[1] in (".", "?.")
            if name in JS_WORDS and after_dot:
                name = "WORD"
            add(("", name, line(at)))
            operand = name not in JS_WORDS or name in ("this", "super") or after_dot
            if name in ("await", "yield", "of") and not after_dot:
                operand = False
        elif kind == "op":
            add(("", "->" if s == "=>" else "EQ" if s == "=" else "ASSIGN" if s[-1] == "=" and s not in _JS_CMP else "CMP" if s in _JS_CMP else "MOD" if s == "%" else s, line(at)))
            operand = s in ("++", "--") and operand
        elif kind == "open":
            add(("<", _KIND[s], line(at)))
            braces.append(s)
            operand = False
        elif kind == "close":
            if braces:
                braces.pop()
            if s == "}":
                add(("", "EOB", line(at)))
            add((">", _KIND[s], line(at)))
            operand = s != "}"
        elif kind != "space":
            add(("", "N" if kind == "num" else "S", line(at)))
            operand = True
        at = m.end()
    add(("", "EOB", line(n)))
    return out


# ---------------------------------------------------------------- Python 3 (an exact check follows)
PY = r"""
File = Stmt*
Block = Stmt+
Stmt = L[Simple] | L[Inline] | L[If] B[Block] ( L[Elif] B[Block] )* ( L[Else] ( B[Block] ) )? | L[Loop] B[Block] ( L[Else] B[Block] )? | L[Try] B[Block] ( ( L[Except] B[Block] )+ ( L[Else] B[Block] )? ( L[Finally] B[Block] )? | L[Finally] B[Block] ) | L[With] B[Block]
  | L[Deco]* L[Def] B[Block] | L[Deco]+ L[Inline] | L[Match] B[Cases]
Cases = ( L[Case] B[Block] | L[Inline] )+
Simple = ( Small % SEMI ) SEMI?
Inline = ( if Named | elif Named | else | while Named | Async? for Exprs in Exprs | try | except ( '*'? Exprs ( as I )? )? | finally | Async? with ( ( Expr ( as Expr )? ) % , ) | Async? def I TParams? P[Params] ( -> Expr )? | class I TParams? P[Args]? | case Exprs ( if Named )? ) : ( Small % SEMI ) SEMI?
Async = async
If = if Named :
Elif = elif Named :
Else = else :
Loop = while Named : | Async? for Exprs in Exprs :
Try = try :
Except = except ( '*'? Exprs ( as I )? )? :
Finally = finally :
With = Async? with ( ( Expr ( as Expr )? ) % , ) :
Deco = @ Named
Def = Async? def I TParams? P[Params] ( -> Expr )? : | class I TParams? P[Args]? :
Match = match Exprs :
Case = case ( CExpr % , ) ,? ( if Named )? :
CExpr = '*'? Bin ( as I )?
Small = ( ( '*'? Named ) % Sep ) Tail? | ( yield from? | return | del | await ) Exprs | yield | return | pass | break | continue | raise ( Expr ( from Expr )? )? | ( global | nonlocal ) ( I % , ) | assert ( Expr % , ) | import ( ( ( I % . ) ( as I )? ) % , )
  | from ( . | ... )* ( I % . )? import ( '*' | P[Names] | ( I ( as I )? ) % , ) | I I TParams? EQ Expr
Sep = , | EQ | EQ yield | ASSIGN | ASSIGN yield | : | , EQ
Tail = , | EQ yield
Names = ( I ( as I )? ) % , ,?
TParams = K[Args]
Params = ( ( ( I | '*' I? | '**' I | / ) ( : '*'? Expr )? ( EQ Expr )? ) % , )? ,?
Args = ( ( ( I EQ )? Named Comp? | ( '*' | '**' ) Expr ) % , )? ,?
Comp = ( async? for Exprs in Bin ( if Bin )* )+
Tuple = ( ( '*'? Named ) % , )? ,? | Named Comp | yield from? Exprs?
List = ( ( '*'? Named ) % , )? ,? | Named Comp
Dict = ( ( Expr : Expr | '**' Expr | '*'? Named ) % , )? ,? | Expr ( : Expr )? Comp
Index = ( ( Named | '*' Expr | ( Expr % :+ ) | : | :+ Expr ( : Expr? )? | Expr : :? ) % , ) ,?
Named = Expr ( := Expr )?
Exprs = ( ( '*'? Expr ) % , ) ,?
Un = ( '+' | - | ~ | not | await )* Prim ( . I | P[Args] | K[Index] )*
Prim = I | match | case | LIT | N | S+ | ... | P[Tuple] | K[List] | B[Dict]
Op = '+' | - | '*' | '**' | / | // | MOD | @ | & | '|' | ^ | << | >> | and | or | CMP | in | not in | is | is not
Bin = Un % Op
Lambda = lambda ( ( I | '*' I? | '**' I | / ) % ( , | EQ LIT , | EQ N , | EQ S , | EQ I , ) )? ( EQ Bin )? :
Expr = ( Lambda* Bin ) % ( if Bin else )
"""
#: Reserved words of Python 3.
PY_WORDS = frozenset(
    """and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield""".split()
)
_PY_TOKEN = re.compile(
    r"(?P<space>[ \t\f]+|\\\r?\n|\#[^\n\r]*)|(?P<nl>\r?\n|\r)|(?P<str>[rbuRBUfFtT]{0,2}(?:\"\"\"(?:\\[\s\S]|(?!\"\"\")[^\\])*\"\"\"|'''(?:\\[\s\S]|(?!''')[^\\])*'''|\"(?!\"\")(?:\\[\s\S]|[^\"\\\r\n])*\"|'(?!'')(?:\\[\s\S]|[^'\\\r\n])*'|\"\"(?!\")|''(?!')))"
    r"|(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?))|(?P<word>[^\W\d]\w*)|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<op>\*\*=|//=|>>=|<<=|:=|->|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|[-+*/%&|^@]=|[-+*/%&|^~:;,.<>=@])"
)
_PY_CMP = frozenset("== != < > <= >=".split())


def py_tokens(text: str) -> list[tuple[str, str, int]]:
    """Every logical line is a group of kind L, every indented block one of kind B."""
    out, at, line, n = [], 0, _lines(text), len(text)
    add, depth, indents, fresh, within = out.append, 0, [0], True, False
    while at < n:
        if fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(text, at)
            rest = text[m.end() : m.end() + 1]
            if rest and rest not in "\r\n#":
                width = len(m.group().expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    add(("<", "B:indent", line(at)))
                while width < indents[-1]:
                    indents.pop()
                    add((">", "B:indent", line(at)))
                if width != indents[-1]:
                    add(("!", "indentation", line(at)))
                add(("<", "L:line", line(at)))
                within = True
            at = m.end()
            fresh = False
            if at >= n:
                break
        m = _PY_TOKEN.match(text, at)
        if m is None:
            add(("!", "lexical", line(at)))
            at = _bad(text, at)
            continue
        kind, s = m.lastgroup, m.group()
        if kind == "nl":
            if not depth:
                if within:
                    add((">", "L:line", line(at)))
                within, fresh = False, True
        elif kind == "word":
            add(("", s if s in PY_WORDS or s in ("match", "case") else "LIT" if s in ("True", "False", "None") else "I", line(at)))
        elif kind == "op":
            add(("", "EQ" if s == "=" else "SEMI" if s == ";" else "CMP" if s in _PY_CMP else "MOD" if s == "%" else "ASSIGN" if s[-1] == "=" and s != ":=" else s, line(at)))
        elif kind == "open":
            add(("<", _KIND[s], line(at)))
            depth += 1
        elif kind == "close":
            add((">", _KIND[s], line(at)))
            depth = max(0, depth - 1)
        elif kind != "space":
            add(("", "N" if kind == "num" else "S", line(at)))
        at = m.end()
    if within and not depth:
        add((">", "L:line", line(n)))
    if not depth:
        for _ in indents[1:]:
            add((">", "B:indent", line(n)))
    return out


# ---------------------------------------------------------------- JSON
JSON = """
File = Value
Value = S | N | LIT | B[Object] | K[Array]
Object = ( ( S : Value ) % , )?
Array = ( Value % , )?
"""
_JSON = re.compile(r'(?P<space>[ \t\r\n]+)|(?P<str>"(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|[^"\\\x00-\x1f])*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<lit>(?:true|false|null)\b)|(?P<open>[{\[])|(?P<close>[}\]])|(?P<op>[:,])')


def json_tokens(text: str) -> list[tuple[str, str, int]]:
    out, at, line, n = [], 0, _lines(text), len(text)
    while at < n:
        m = _JSON.match(text, at)
        if m is None:
            out.append(("!", "lexical", line(at)))
            at = _bad(text, at)
            continue
        kind, s = m.lastgroup, m.group()
        if kind in ("open", "close"):
            out.append(("<" if kind == "open" else ">", _KIND[s], line(at)))
        elif kind != "space":
            out.append(("", {"str": "S", "num": "N", "lit": "LIT"}.get(kind, s), line(at)))
        at = m.end()
    return out


# ---------------------------------------------------------------- XML
XML = """
File = DECL? Misc* ( DOCTYPE Misc* )? Element Misc*
Misc = SPACE | COMMENT | PI
Element = E[Content] | EMPTY
Content = ( SPACE | TEXT | COMMENT | PI | CDATA | Element )*
"""
_NAME = r"[^\W\d][\w.:-]*"
_REF = r"&(?:#\d+|#x[0-9a-fA-F]+|[^\W\d][\w.:-]*);"
_ATTRS = rf"(?:\s+{_NAME}\s*=\s*(?:\"(?:[^<&\"]|{_REF})*\"|'(?:[^<&']|{_REF})*'))*\s*"
_XML = re.compile(
    rf"(?P<decl><\?xml\s[^?]*\?>)|(?P<pi><\?(?!xml\s)[\s\S]*?\?>)|(?P<comment><!--(?:(?!--)[\s\S])*-->)|(?P<cdata><!\[CDATA\[[\s\S]*?\]\]>)|(?P<doctype><!DOCTYPE(?:[^\[>\"']|\"[^\"]*\"|'[^']*'|\[[\s\S]*?\]\s*(?=>))*>)"
    rf"|(?P<empty><{_NAME}{_ATTRS}/>)|(?P<open><(?P<o>{_NAME}){_ATTRS}>)|(?P<close></(?P<e>{_NAME})\s*>)|(?P<space>\s+)|(?P<text>(?:[^<&\]\x00-\x08\x0b\x0c\x0e-\x1f]|\](?!\]>)|{_REF})+)"
)


def xml_tokens(text: str) -> list[tuple[str, str, int]]:
    text = text.removeprefix("\ufeff")
    out, at, line, n = [], 0, _lines(text), len(text)
    while at < n:
        m = _XML.match(text, at)
        if m is None:
            out.append(("!", "lexical", line(at)))
            at = _bad(text, at)
            continue
        if m["open"]:
            out.append(("<", "E:" + m["o"], line(at)))
        elif m["close"]:
            out.append((">", "E:" + m["e"], line(at)))
        elif m["decl"]:
            out.append(("", "DECL" if at == 0 else "LATE", line(at)))
        else:
            kind = next(k for k in ("pi", "comment", "cdata", "doctype", "empty", "space", "text") if m[k])
            out.append(("", kind.upper(), line(at)))
        at = m.end()
    return out


#: Rules, how often the automaton unrolls a rule within itself, and the scanner.
LANGUAGES = {
    "java": (JAVA, {"TArgs": 2, "TAtom": 2, "Core": 0, "Pre": 0, "Branch": -1}, java_tokens),
    "js": (JS, {"Pre": 0}, js_tokens),
    "py": (PY, {}, py_tokens),
    "json": (JSON, {}, json_tokens),
    "xml": (XML, {}, xml_tokens),
}
_built: dict[str, Grammar] = {}


def grammar(lang: str) -> Grammar:
    if lang not in _built:
        rules, depth, _ = LANGUAGES[lang]
        _built[lang] = Grammar(rules, depth, recursive=lang in ("java", "js"))  # an exact parser decides for the others
    return _built[lang]
