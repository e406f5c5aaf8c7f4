"""Parser of start conditions.

Grammar, loosest first: or (| or the word OR), and (& or AND), then terms:
a term in parentheses, one negated by !, or a predicate. Predicates are
status tests (success, failure, done, notrunning, terminated, or their first
letters, and activated) of a job, which may name another instance (job^INST)
and a look-back in hours (job, h); exit codes e(job) op number; and globals
v(name) op literal.

The parser turns a text into postfix steps, which are flat rows: they can be
stored, joined with statuses, and folded without recursion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Predicate names of the language.
STATUS_TESTS = {
    "s": "success", "success": "success", "f": "failure", "failure": "failure", "d": "done", "done": "done",
    "n": "notrunning", "notrunning": "notrunning", "t": "terminated", "terminated": "terminated", "activated": "activated",
}
VALUE_TESTS, EXIT_TESTS = ("v", "value"), ("e", "exitcode")
COMPARISONS = ("!=", "<>", "<=", ">=", "=", "<", ">")
#: Statuses that make each test true; notrunning is true of all others.
TRUE_OF = {
    "success": ("SUCCESS", "ON_ICE"),
    "failure": ("FAILURE",),
    "done": ("SUCCESS", "FAILURE", "TERMINATED", "ON_ICE"),
    "terminated": ("TERMINATED",),
    "activated": ("ACTIVATED",),
}
FALSE_OF_NOTRUNNING = ("STARTING", "RUNNING", "RESTART")
_LEXER = re.compile(
    r"\s*(?:(?P<op>!=|<>|<=|>=|[=<>])|(?P<mark>[&|()!,])|\"(?P<quoted>(?:[^\"\\]|\\.)*)\"|(?P<word>-?[A-Za-z0-9_#][A-Za-z0-9_.:%^#-]*))"
)


class ConditionError(ValueError):
    """A text that is no condition."""


@dataclass(frozen=True)
class Step:
    """One postfix step: kind and, or, not, status, exit or value, with what it asks."""

    kind: str
    test: str | None = None
    name: str | None = None
    instance: str | None = None
    hours: float | None = None
    comparison: str | None = None
    literal: str | None = None


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEXER.match(text, at)
        if not m:
            raise ConditionError(f"unexpected character at {at}")
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "word" and value.upper() in ("AND", "OR"):
            kind, value = "mark", "&" if value.upper() == "AND" else "|"
        out.append((kind, value))
        at = m.end()
    return out


def parse(text: str) -> list[Step]:
    """Postfix steps of a condition; ConditionError if the text is none.

    Precedence climbing with explicit stacks, so nesting has no limit.
    """
    tokens = _tokens(text)
    out: list[Step] = []
    marks: list[str] = []
    rank = {"|": 1, "&": 2, "!": 3}
    names = {"|": "or", "&": "and", "!": "not"}
    operand = True  # whether a term is due
    i = 0

    def take(kind: str, *values: str) -> str:
        nonlocal i
        if i >= len(tokens) or tokens[i][0] != kind or (values and tokens[i][1] not in values):
            raise ConditionError(f"expected {' or '.join(values) or kind}")
        i += 1
        return tokens[i - 1][1]

    while i < len(tokens):
        kind, value = tokens[i]
        if operand:
            if kind == "mark" and value in "(!":
                marks.append(value)
                i += 1
            elif kind == "word":
                out.append(_predicate(take, lambda: tokens[i] if i < len(tokens) else ("", "")))
                operand = False
            else:
                raise ConditionError(f"unexpected {value}")
        elif kind == "mark" and value in "&|":
            while marks and marks[-1] != "(" and rank[marks[-1]] >= rank[value]:
                out.append(Step(names[marks.pop()]))
            marks.append(value)
            operand = True
            i += 1
        elif kind == "mark" and value == ")":
            while marks and marks[-1] != "(":
                out.append(Step(names[marks.pop()]))
            if not marks:
                raise ConditionError("unmatched )")
            marks.pop()
            i += 1
        else:
            raise ConditionError(f"unexpected {value}")
    if operand:
        raise ConditionError("the condition breaks off")
    while marks:
        m = marks.pop()
        if m == "(":
            raise ConditionError("unmatched (")
        out.append(Step(names[m]))
    return out


def _predicate(take, peek) -> Step:
    word = take("word")
    take("mark", "(")
    name = take("quoted") if peek()[0] == "quoted" else take("word")
    name, _, instance = name.partition("^")
    hours = None
    if word in STATUS_TESTS and peek() == ("mark", ","):
        take("mark", ",")
        try:
            hours = float(take("word").replace(":", "."))
        except ValueError:
            raise ConditionError("a look-back is a number of hours") from None
    take("mark", ")")
    if word in STATUS_TESTS:
        return Step("status", STATUS_TESTS[word], name, instance or None, hours)
    kind = "exit" if word in EXIT_TESTS else "value" if word in VALUE_TESTS else None
    if kind is None:
        raise ConditionError(f"unknown test {word}")
    comparison = take("op")
    literal = take("quoted") if peek()[0] == "quoted" else take("word")
    return Step(kind, None, name, instance or None, None, "!=" if comparison == "<>" else comparison, literal)


def references(text: str) -> list[tuple[str, str | None]]:
    """Distinct (job, instance) that a condition refers to, in order of appearance."""
    return list(dict.fromkeys((s.name, s.instance) for s in parse(text) if s.kind in ("status", "exit")))


def render(steps: list[Step], form: str = "long") -> str:
    """The text of postfix steps, in long or short predicates; an or within an and stands in parentheses."""
    short = {v: k for k, v in reversed(STATUS_TESTS.items()) if len(k) == 1}
    stack: list[tuple[str, int]] = []
    for s in steps:
        if s.kind in ("and", "or"):
            level = 2 if s.kind == "and" else 1
            (b, lb), (a, la) = stack.pop(), stack.pop()
            wrap = lambda t, have, need: f"({t})" if have < need else t
            stack.append((f"{wrap(a, la, level)} {'&' if level == 2 else '|'} {wrap(b, lb, level + 1)}", level))
        elif s.kind == "not":
            a, la = stack.pop()
            stack.append((f"!({a})" if la < 3 else f"!{a}", 3))
        else:
            name = s.name + (f"^{s.instance}" if s.instance else "")
            if s.kind == "status":
                test = s.test if form == "long" else short.get(s.test, s.test)
                stack.append((f"{test}({name}{'' if s.hours is None else f', {s.hours:g}'})", 3))
            else:
                test = {"exit": ("exitcode", "e"), "value": ("value", "v")}[s.kind][form != "long"]
                literal = s.literal if re.fullmatch(r"-?\d+(\.\d+)?", s.literal) else f'"{s.literal}"'
                stack.append((f"{test}({name}) {s.comparison} {literal}", 3))
    return stack[0][0] if stack else ""


def renamed(text: str, names: dict[str, str], form: str = "long") -> str:
    """The condition with jobs renamed; references to other instances and globals stay as they are."""
    steps = [Step(**(s.__dict__ | {"name": names.get(s.name, s.name)})) if s.kind in ("status", "exit") and not s.instance else s for s in parse(text)]
    return render(steps, form)
