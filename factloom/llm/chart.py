"""Error-correcting chart parsing of bracketed token streams.

A grammar has right-hand sides that are regular over tokens and bracket groups (an extended context-free grammar), so the chart of a text
factors along its bracket tree: for every group, bottom up, the chart holds the least edit cost and the non-terminals that attain it. A
right-hand side is matched by sets of automaton states; level c of the table holds the states reachable with c edits (delete, insert or
replace a token). Level 0 is an ordinary parse, kept as a lazily built deterministic automaton and remembered for equal groups, and
only groups that level 0 rejects go on to higher levels.

Recursion that is not bracketed (generic arguments, conditional operators, unbraced branches) is unrolled to a fixed depth in the automaton. A
group that it rejects after a place where the unrolling ended is decided by an Earley parse of the rules themselves, so nesting of any
depth derives at cost 0; only the edit costs of broken groups come from the unrolled rules.
"""

from __future__ import annotations

import re

#: Edits after which a group counts as unparseable (its cost saturates); such files are flagged anyway.
MOST_EDITS = 8
#: Groups whose result a Python worker remembers.
MEMORY = 300_000


class Grammar:
    """rules: text of lines `Name = expression`; words that are not rules are tokens, 'x' quotes one, X[Rule] is a group of kind X whose
    content derives Rule, `A % B` is a list of A separated by B. depth: how often the automaton unrolls a rule inside itself (default 1, -1: not even
    once). recursive: what lies deeper is decided by derives()."""

    def __init__(self, rules: str, depth: dict[str, int] | None = None, recursive: bool = False):
        self.rules = dict(re.split(r"\s*=\s*", line.strip(), maxsplit=1) for line in re.sub(r"\n\s+", " ", rules).strip().split("\n") if line.strip())
        self.depth = depth or {}
        self.recursive, self.ends = recursive, set()
        self.parsed: dict[str, tuple] = {}
        self.eps: list[list[int]] = []
        self.edges: dict[object, dict[int, list[int]]] = {}
        wanted = {(k, r) for e in self.rules.values() for k, r in re.findall(r"\b([A-Z])\[(\w+)\]", e)} | {("F", "File")}
        self.kinds: dict[str, list[str]] = {}
        for k, r in sorted(wanted):
            self.kinds.setdefault(k, []).append(r)
        self.start, self.final = {}, {}
        for r in sorted({r for _, r in wanted}):
            a, b = self._state(), self._state()
            self._build(("rule", r), a, b, ())
            self.start[r], self.final[r] = a, b
        self._close()
        if recursive:
            self._build_recursive()
        self.derived: dict[tuple, bool] = {}
        self.dfa: dict[int, int] = {}
        self.sets: list[int] = []
        self.ended: list[bool] = []
        self.next: list[dict[int, int]] = []
        self.symbols: dict[object, int] = {}
        self.symbol_of: list[object] = []
        self.memory: dict[tuple, tuple[int, int, tuple]] = {}
        self.any_memory: dict[int, int] = {}

    # building
    def _state(self) -> int:
        self.eps.append([])
        return len(self.eps) - 1

    def _parse(self, name: str) -> tuple:
        if name not in self.parsed:
            toks = re.findall(r"'[^']+'|[A-Z]\[\w+\]|[()|?*+%]|[^\s()|?*+%']+", self.rules[name])
            tree, rest = self._alt(toks)
            assert not rest, (name, rest)
            self.parsed[name] = tree
        return self.parsed[name]

    def _alt(self, t: list[str]) -> tuple[tuple, list[str]]:
        options = []
        while True:
            items = []
            while t and t[0] not in "|)":
                if t[0] == "(":
                    item, t = self._alt(t[1:])
                    t = t[1:]
                elif t[0][0] == "'":
                    item, t = ("tok", t[0][1:-1]), t[1:]
                elif t[0][1:2] == "[" and len(t[0]) > 2:
                    item, t = ("tok", (t[0][0], t[0][2:-1])), t[1:]
                else:
                    item, t = ("rule" if t[0] in self.rules else "tok", t[0]), t[1:]
                while t and t[0] in "?*+":
                    item, t = ({"?": "opt", "*": "star", "+": "plus"}[t[0]], item), t[1:]
                if items and items[-1] == "%":
                    items[-2:] = [("list", items[-2], item)]
                else:
                    items.append(item)
                if t and t[0] == "%":
                    items.append("%")
                    t = t[1:]
            options.append(("seq", items))
            if t and t[0] == "|":
                t = t[1:]
            else:
                return ("alt", options), t

    def _build(self, node: tuple, a: int, b: int, stack: tuple) -> None:
        kind = node[0]
        if kind == "tok":
            self.edges.setdefault(node[1], {}).setdefault(a, []).append(b)
        elif kind == "rule":
            if stack.count(node[1]) <= self.depth.get(node[1], 1):
                self._build(self._parse(node[1]), a, b, (*stack, node[1]))
            elif self.recursive:
                self.ends.add(a)
        elif kind == "seq":
            for item in node[1]:
                c = self._state()
                self._build(item, a, c, stack)
                a = c
            self.eps[a].append(b)
        elif kind == "alt":
            for item in node[1]:
                self._build(item, a, b, stack)
        else:
            c, d = self._state(), self._state()
            self._build(node[1], c, d, stack)
            self.eps[a].append(c)
            self.eps[d].append(b)
            if kind in ("opt", "star"):
                self.eps[a].append(b)
            if kind in ("star", "plus"):
                self.eps[d].append(c)
            if kind == "list":
                self._build(node[2], d, c, stack)

    def _close(self) -> None:
        """Numbers only the states that tokens leave or that end a rule; folds empty moves into the targets of the others."""
        keep = sorted({s for e in self.edges.values() for s in e} | set(self.final.values()) | self.ends)
        bit = {s: 1 << i for i, s in enumerate(keep)}
        closed: dict[int, int] = {}

        def closure(s: int) -> int:
            if s not in closed:
                seen, todo, out = {s}, [s], 0
                while todo:
                    x = todo.pop()
                    out |= bit.get(x, 0)
                    for y in self.eps[x]:
                        if y not in seen:
                            seen.add(y)
                            todo.append(y)
                closed[s] = out
            return closed[s]

        number = {s: i for i, s in enumerate(keep)}
        self.moves: dict[object, tuple[int, dict[int, int]]] = {}
        self.any_move: dict[int, int] = {}
        for tok, e in self.edges.items():
            to = {}
            for s, targets in e.items():
                m = 0
                for t in targets:
                    m |= closure(t)
                to[number[s]] = m
                self.any_move[number[s]] = self.any_move.get(number[s], 0) | m
            self.moves[tok] = (sum(1 << s for s in to), to)
        self.begin = {r: closure(s) for r, s in self.start.items()}
        self.end = {r: bit[s] for r, s in self.final.items()}
        self.end_of_unrolling = sum(bit[s] for s in self.ends)

    def _build_recursive(self) -> None:
        """One automaton a rule, whose edges are tokens or calls of rules; self.net holds for each state, over its empty moves, the token edges, the calls and the rules that end there."""
        eps: list[list[int]] = []
        tokens: list[list[tuple[object, int]]] = []
        calls: list[list[tuple[str, int]]] = []

        def state() -> int:
            eps.append([])
            tokens.append([])
            calls.append([])
            return len(eps) - 1

        def build(node: tuple, a: int, b: int) -> None:
            kind = node[0]
            if kind == "tok":
                tokens[a].append((node[1], b))
            elif kind == "rule":
                calls[a].append((node[1], b))
            elif kind == "seq":
                for item in node[1]:
                    c = state()
                    build(item, a, c)
                    a = c
                eps[a].append(b)
            elif kind == "alt":
                for item in node[1]:
                    build(item, a, b)
            else:
                c, d = state(), state()
                build(node[1], c, d)
                eps[a].append(c)
                eps[d].append(b)
                if kind in ("opt", "star"):
                    eps[a].append(b)
                if kind in ("star", "plus"):
                    eps[d].append(c)
                if kind == "list":
                    build(node[2], d, c)

        self.enter, leave = {}, {}
        for rule in self.rules:
            self.enter[rule], leave[rule] = state(), state()
            build(self._parse(rule), self.enter[rule], leave[rule])
        ends = {s: rule for rule, s in leave.items()}

        def closure(s: int) -> set[int]:
            seen, todo = {s}, [s]
            while todo:
                x = todo.pop()
                for y in [*eps[x], *(t for rule, t in calls[x] if rule in empty)]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return seen

        empty: set[str] = set()
        while more := {rule for rule in self.rules if rule not in empty and leave[rule] in closure(self.enter[rule])}:
            empty |= more
        self.net = []
        for s in range(len(eps)):
            at, to = closure(s), {}
            for x in at:
                for tok, t in tokens[x]:
                    to.setdefault(tok, []).append(t)
            self.net.append((to, [c for x in at for c in calls[x]], [ends[x] for x in at if x in ends]))

    # running
    def symbol(self, key: object) -> int:
        """Number of a token, or of a group (kind, set of non-terminals as bits)."""
        if key not in self.symbols:
            self.symbols[key] = len(self.symbol_of)
            self.symbol_of.append(key)
        return self.symbols[key]

    def _step(self, states: int, sym: int) -> int:
        key = self.symbol_of[sym]
        if isinstance(key, tuple):
            names = [(key[0], r) for i, r in enumerate(self.kinds.get(key[0], ())) if key[1] >> i & 1]
        else:
            names = [key]
        out = states if key in ("NL", "EOB") else 0
        for name in names:
            if name in self.moves:
                mask, to = self.moves[name]
                hit = states & mask
                while hit:
                    low = hit & -hit
                    out |= to[low.bit_length() - 1]
                    hit ^= low
        return out

    def derives(self, rule: str, content: tuple[int, ...]) -> bool:
        """Whether the rule derives the content, with recursion of any depth (Earley's algorithm)."""
        if (rule, content) not in self.derived:
            if len(self.derived) > 10_000:
                self.derived.clear()
            self.derived[rule, content] = self._derives(rule, content)
        return self.derived[rule, content]

    def _derives(self, rule: str, content: tuple[int, ...]) -> bool:
        net, enter = self.net, self.enter
        waiting: list[dict[str, list[tuple[int, int]]]] = []
        column = {(enter[rule], 0)}
        for i in range(len(content) + 1):
            wait: dict[str, list[tuple[int, int]]] = {}
            waiting.append(wait)
            todo = list(column)
            while todo:
                s, origin = todo.pop()
                _, calls, ends = net[s]
                for name, t in calls:
                    if name not in wait:
                        wait[name] = []
                        if (new := (enter[name], i)) not in column:
                            column.add(new)
                            todo.append(new)
                    wait[name].append((t, origin))
                if origin < i:  # rules that derive nothing are empty moves
                    for name in ends:
                        for new in waiting[origin].get(name, ()):
                            if new not in column:
                                column.add(new)
                                todo.append(new)
            if i == len(content):
                return any(origin == 0 and rule in net[s][2] for s, origin in column)
            key = self.symbol_of[content[i]]
            names = [(key[0], r) for k, r in enumerate(self.kinds.get(key[0], ())) if key[1] >> k & 1] if isinstance(key, tuple) else [key]
            nxt = set(column) if key in ("NL", "EOB") else set()
            for s, origin in column:
                to = net[s][0]
                for name in names:
                    for t in to.get(name, ()):
                        nxt.add((t, origin))
            column = nxt
            if not column:
                return False
        return False

    def _any(self, states: int) -> int:
        if states not in self.any_memory:
            if len(self.any_memory) > 20_000:
                self.any_memory.clear()
            out, hit = 0, states
            while hit:
                low = hit & -hit
                out |= self.any_move.get(low.bit_length() - 1, 0)
                hit ^= low
            self.any_memory[states] = out
        return self.any_memory[states]

    def _intern(self, states: int) -> int:
        if states not in self.dfa:
            self.dfa[states] = len(self.sets)
            self.sets.append(states)
            self.ended.append(bool(states & self.end_of_unrolling))
            self.next.append({})
        return self.dfa[states]

    def exact(self, rule: str, content: tuple[int, ...]) -> int:
        """-1 if the rule derives the content, else the number of tokens that could be read."""
        at, nxt, ended = self._intern(self.begin[rule]), self.next, self.ended
        deeper, read = ended[at], len(content)
        for i, sym in enumerate(content):
            to = nxt[at].get(sym)
            if to is None:
                to = nxt[at][sym] = self._intern(self._step(self.sets[at], sym))
            at = to
            deeper = deeper or ended[at]
            if not self.sets[at]:
                read = i
                break
        if self.sets[at] & self.end[rule] or deeper and self.derives(rule, content):
            return -1
        return read

    def _free(self, content: tuple[int, ...]) -> list[bool]:
        return [self.symbol_of[s] in ("NL", "EOB") for s in content]

    def _levels(self, rule: str, content: tuple[int, ...], most: int) -> list[list[int]]:
        """The table of a repair: for each number of edits the states that can be reached before each position, up to the level that derives the content, or `most`."""
        end, n, free = self.end[rule], len(content), self._free(content)
        levels: list[list[int]] = []
        for c in range(most + 1):
            below, row, cur = levels[-1] if levels else None, [], 0
            for i in range(n + 1):
                new = self._step(cur, content[i - 1]) if i else (self.begin[rule] if not c else 0)
                if below is not None:
                    new |= self._any(below[i])
                    if i and not free[i - 1]:
                        new |= below[i - 1] | self._any(below[i - 1])
                cur = new
                row.append(cur)
            levels.append(row)
            if cur & end:
                break
        return levels

    def repair(self, rule: str, content: tuple[int, ...], most: int) -> int:
        """Least number of edits that make the content derivable, or most + 1."""
        levels = self._levels(rule, content, most)
        return len(levels) - 1 if levels[-1][-1] & self.end[rule] else most + 1

    @staticmethod
    def _leading(states: int, target: int, step) -> int:
        """Those of the states from which the step leads to a target state."""
        out = 0
        while states:
            low = states & -states
            if step(low) & target:
                out |= low
            states ^= low
        return out

    def places(self, rule: str, content: tuple[int, ...], cost: int) -> tuple[tuple[str, int], ...]:
        """The edits of one cheapest repair as (what, position), read back from the table; what: insert (before the position), delete or replace."""
        levels, free = self._levels(rule, content, cost), self._free(content)
        out, c, i, target = [], len(levels) - 1, len(content), self.end[rule]
        if not levels[-1][-1] & target:
            return ()
        while c or i:
            if i and (pre := self._leading(levels[c][i - 1], target, lambda s: self._step(s, content[i - 1]))):
                target, i = pre, i - 1
            elif i and not free[i - 1] and levels[c - 1][i - 1] & target:
                out.append(("delete", i - 1))
                target, i, c = levels[c - 1][i - 1] & target, i - 1, c - 1
            elif i and not free[i - 1] and (pre := self._leading(levels[c - 1][i - 1], target, self._any)):
                out.append(("replace", i - 1))
                target, i, c = pre, i - 1, c - 1
            else:
                out.append(("insert", i))
                target, c = self._leading(levels[c - 1][i], target, self._any), c - 1
        return tuple(reversed(out))

    def group(self, kind: str, content: tuple[int, ...]) -> tuple[int, int, tuple]:
        """(least edit cost, bits of the non-terminals that attain it, edits of one cheapest repair) of a group's content."""
        key = (kind, content)
        got = self.memory.get(key)
        if got is None:
            rules, bits = self.kinds.get(kind, []), 0
            reach = [self.exact(r, content) for r in rules]
            for i, far in enumerate(reach):
                if far < 0:
                    bits |= 1 << i
            got = (0, bits, ())
            if not bits and rules:
                # rules that read the most come first: their cost bounds the table of the rest
                best, lead = MOST_EDITS + 1, None
                for i in sorted(range(len(rules)), key=lambda i: -reach[i]):
                    c = self.repair(rules[i], content, min(best, MOST_EDITS))
                    if c < best:
                        best, bits, lead = c, 1 << i, rules[i]
                    elif c == best and c <= MOST_EDITS:
                        bits |= 1 << i
                where = self.places(lead, content, best) if lead else (("content", min(max(reach), len(content))),)
                got = (best, bits or (1 << len(rules)) - 1, where)
            if len(self.memory) > MEMORY:
                self.memory.clear()
            self.memory[key] = got
        return got


CLOSERS = {"P": ")", "K": "]", "B": "}"}


def parse(grammar: Grammar, tokens: list[tuple[str, str, int]]) -> tuple[int, list[tuple[str, int]]]:
    """(edit cost, edits as (what, line)) of a token list.

    tokens: (role, name, line); role "" is a plain token, "!" one of no language (an edit), "<" opens a group of kind name[0] with label name[1:], ">" closes
    one. A closer that fits no open group is deleted; one that fits an outer group closes the inner ones (an insertion each).
    """
    edits: list[tuple[str, int]] = []
    symbol, extra = grammar.symbol, 0
    stack: list[tuple[str, int, list[int], list[int]]] = [("F", 1, [], [])]

    def close(line: int) -> None:
        nonlocal extra
        kind, opened, content, at = stack.pop()
        cost, bits, where = grammar.group(kind[0], tuple(content))
        if cost:
            extra += cost
            edits.extend((what, at[i] if i < len(at) else line) for what, i in where)
        if stack:
            stack[-1][2].append(symbol((kind[0], bits)))
            stack[-1][3].append(opened)

    line = 1
    for role, name, line in tokens:
        if not role:
            stack[-1][2].append(symbol(name))
            stack[-1][3].append(line)
        elif role == "<":
            stack.append((name, line, [], []))
        elif role == ">":
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == name), 0)
            if not depth:
                extra += 1
                edits.append(("closer", line))
            else:
                while len(stack) - 1 > depth:
                    extra += 1
                    edits.append(("unclosed", stack[-1][1]))
                    close(line)
                close(line)
        else:
            extra += 1
            edits.append((name, line))
    while len(stack) > 1:
        extra += 1
        edits.append(("end", line))
        close(line)
    kind, _, content, at = stack[0]
    if grammar.exact("File", tuple(content)) >= 0:
        cost, _, where = grammar.group("F", tuple(content))
        extra += max(cost, 1)
        edits.extend(("end" if i >= len(at) else what, at[i] if i < len(at) else line) for what, i in where)
    return extra, edits
