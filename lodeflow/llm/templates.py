"""A small sandboxed template language for conversations, compiled to Python closures.

    {% for message in messages %}<|im_start|>{{ message.role | header }}
    {% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% endif %}...
    {% endfor %}

Statements: for, if / elif / else, set, generation; `-` inside a mark strips white space on that side; {# notes #} go.
Expressions: text, whole numbers, true, false, none, names, `.name` and `['name']` of records, `loop.first`, `loop.last`,
`loop.index`, `loop.index0`, `+` of numbers, `~` of texts, `==`, `!=`, `<`, `<=`, `>`, `>=`, `in`, `not`, `and`, `or`, `x if c else y`,
and filters from FILTERS. Nothing else of Python is within reach: no calls, no attributes of objects, no imports.

A text becomes tokens, then a syntax tree (parse), then a smaller tree (fold: constant expressions, branches that can't be
taken, neighbouring texts), then closures (compile_template). The one loop over `messages` must stand at the top level:
a conversation is rendered turn by turn and never held whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

Value = object
Scope = dict[str, Value]


class TemplateError(ValueError):
    """What a template must not hold, or a value that it can't use."""


def escape(text: str) -> str:
    r"""No `<|` is left: `<`, any `\`, `|` gets one `\` more."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


_HEADER = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}
_PLAIN = {v[1]: k for k, v in _HEADER.items()}


def header(text: str) -> str:
    """One line without `|`."""
    return re.sub(r"[\\\n|]", lambda m: _HEADER[m[0]], text)


def unheader(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def _text(v: Value) -> str:
    return "" if v is None else "true" if v is True else "false" if v is False else str(v)


FILTERS: dict[str, Callable[[Value], Value]] = {
    "escape": lambda v: escape(_text(v)),
    "header": lambda v: header(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, str) else 0,
}


# -- the syntax tree ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Value


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Show:
    of: object


@dataclass(frozen=True)
class If:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    of: object


@dataclass(frozen=True)
class Generation:
    body: tuple


# -- tokens and parsing ------------------------------------------------------------------------------------------------

_MARK = re.compile(r"(\{\{-?|\{%-?|\{#-?)(.*?)(-?\}\}|-?%\}|-?#\})", re.S)
_CLOSE = {"{{": "}}", "{%": "%}", "{#": "#}"}
_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<sign>==|!=|<=|>=|[-+~<>()\[\].|]))")
_BACKSLASH = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "false": False, "none": None}


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, inside) of each text, {{ }} and {% %}."""
    out, at, strip = [], 0, False
    for m in _MARK.finditer(source):
        if m[3].lstrip("-") != _CLOSE[m[1][:2]]:
            raise TemplateError(f"{m[1]} is closed by {m[3]}")
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        out.append(("text", text.rstrip() if m[1].endswith("-") else text))
        if m[1][:2] != "{#":
            out.append((m[1][:2], m[2].strip()))
        at, strip = m.end(), m[3].startswith("-")
    rest = source[at:]
    if re.search(r"\{\{|\{%|\{#", rest):
        raise TemplateError("a mark isn't closed")
    out.append(("text", rest.lstrip() if strip else rest))
    return [p for p in out if p != ("text", "")]


class _Reader:
    """The tokens of one expression or statement."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(source.rstrip()):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        """The next token if it is one of those, else an empty text."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "sign") and self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return ""

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing before {self.peek()!r}")

    def name(self) -> str:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError(f"a name is missing before {self.peek()!r}")
        self.at += 1
        found = self.tokens[self.at - 1][1]
        if found.startswith("__"):
            raise TemplateError(f"{found!r} is no name")
        return found

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.peek()!r} is too much")

    # loosest first
    def choice(self):
        yes = self.chain("or")
        if not self.take("if"):
            return yes
        test = self.chain("or")
        self.need("else")
        return Choice(test, yes, self.choice())

    def chain(self, sign: str):
        below = (lambda: self.chain("and")) if sign == "or" else self.negation
        args = [below()]
        while self.take(sign):
            args.append(below())
        return args[0] if len(args) == 1 else Op(sign, tuple(args))

    def negation(self):
        return Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        left = self.sum()
        if sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            return Op(sign, (left, self.sum()))
        return left

    def sum(self):
        left = self.filtered()
        while sign := self.take("+", "~"):
            left = Op(sign, (left, self.filtered()))
        return left

    def filtered(self):
        left = self.primary()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            left = Filter(left, name)
        return left

    def primary(self):
        if self.take("("):
            left = self.choice()
            self.need(")")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "number":
            left = Const(int(self.tokens[self.at][1]))
            self.at += 1
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "text":
            inside = self.tokens[self.at][1][1:-1]
            left = Const(re.sub(r"\\(.)", lambda m: _BACKSLASH.get(m[1], m[0]), inside, flags=re.S))
            self.at += 1
        else:
            name = self.name()
            left = Const(_WORDS[name]) if name in _WORDS else Name(name)
        while sign := self.take(".", "["):
            if sign == ".":
                left = Item(left, Const(self.name()))
            else:
                left = Item(left, self.choice())
                self.need("]")
        return left


def _expression(source: str):
    reader = _Reader(source)
    out = reader.choice()
    reader.end()
    return out


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of texts (Const), Show, If, For, Set and Generation."""
    pieces, at = _pieces(source), 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str, str]:
        """What stands before one of the ends, that end, and what it says."""
        nonlocal at
        out = []
        while at < len(pieces):
            kind, inside = pieces[at]
            at += 1
            if kind == "text":
                out.append(Const(inside))
            elif kind == "{{":
                out.append(Show(_expression(inside)))
            else:
                word, _, rest = inside.partition(" ")
                if word in ends:
                    return tuple(out), word, rest
                out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(out), "", ""

    def statement(word: str, rest: str):
        if word == "for":
            reader = _Reader(rest)
            name = reader.name()
            reader.need("in")
            over = reader.choice()
            reader.end()
            return For(name, over, block(("endfor",))[0])
        if word == "set":
            name, equals, value = rest.partition("=")
            if not equals or not re.fullmatch(r"[A-Za-z][A-Za-z_0-9]*", name.strip()):
                raise TemplateError(f"can't set {rest!r}")
            return Set(name.strip(), _expression(value))
        if word == "generation":
            return Generation(block(("endgeneration",))[0])
        if word == "if":
            return branch(rest)
        raise TemplateError(f"there is no statement {word!r}")

    def branch(test: str) -> If:
        yes, end, rest = block(("elif", "else", "endif"))
        if end == "elif":
            no = (branch(rest),)
        else:
            no = block(("endif",))[0] if end == "else" else ()
        return If(_expression(test), yes, no)

    return block(())[0]


# -- meaning -----------------------------------------------------------------------------------------------------------


def _compared(sign: str, a: Value, b: Value) -> bool:
    if sign == "==":
        return a == b
    if sign == "!=":
        return a != b
    if sign == "in":
        return a in b if isinstance(a, str) and isinstance(b, str) else isinstance(b, dict) and a in b
    if not (isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int)):
        raise TemplateError(f"{a!r} and {b!r} have no order")
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]


def _apply(sign: str, a: Value, b: Value) -> Value:
    if sign == "~":
        return _text(a) + _text(b)
    if sign == "+":
        if isinstance(a, int) and isinstance(b, int) or isinstance(a, str) and isinstance(b, str):
            return a + b
        raise TemplateError(f"can't add {a!r} and {b!r}")
    return _compared(sign, a, b)


def _get(of: Value, key: Value) -> Value:
    return of.get(key) if isinstance(of, dict) else None


def fold(node):
    """The same meaning with constants computed: in expressions, in branches, in texts that meet."""
    if isinstance(node, tuple):
        out: list = []
        for each in map(fold, node):
            for part in each if isinstance(each, tuple) else (each,):
                if isinstance(part, Const) and out and isinstance(out[-1], Const):
                    out[-1] = Const(out[-1].value + part.value)
                elif part != Const(""):
                    out.append(part)
        return tuple(out)
    if isinstance(node, Show):
        of = fold(node.of)
        return Const(_text(of.value)) if isinstance(of, Const) else Show(of)
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no)
        return If(test, fold(node.yes), fold(node.no))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.of))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Item):
        of, key = fold(node.of), fold(node.key)
        return Const(_get(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Choice):
        test = fold(node.test)
        return fold(node.yes if test.value else node.no) if isinstance(test, Const) else Choice(test, fold(node.yes), fold(node.no))
    if isinstance(node, Op):
        args = [fold(a) for a in node.args]
        if node.sign in ("and", "or"):
            kept = []
            for k, a in enumerate(args):
                if isinstance(a, Const) and bool(a.value) == (node.sign == "and") and k + 1 < len(args):
                    continue  # decides nothing
                kept.append(a)
                if isinstance(a, Const):
                    break  # what follows isn't looked at
            return kept[0] if len(kept) == 1 else Op(node.sign, tuple(kept))
        if all(isinstance(a, Const) for a in args):
            values = [a.value for a in args]
            return Const(not values[0]) if node.sign == "not" else Const(_apply(node.sign, *values))
        return Op(node.sign, tuple(args))
    return node


def _value(node) -> Callable[[Scope], Value]:
    """An expression as a closure over a scope."""
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)
        if isinstance(node.of, Name) and isinstance(node.key, Const):
            return lambda scope, n=node.of.name, k=node.key.value: _get(scope.get(n), k)
        return lambda scope: _get(of(scope), key(scope))
    if isinstance(node, Filter):
        of, change = _value(node.of), FILTERS[node.name]
        return lambda scope: change(of(scope))
    if isinstance(node, Choice):
        test, yes, no = _value(node.test), _value(node.yes), _value(node.no)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    args = [_value(a) for a in node.args]
    if node.sign == "not":
        return lambda scope: not args[0](scope)
    if node.sign in ("and", "or"):
        stop = node.sign == "or"

        def chain(scope: Scope) -> Value:
            v = None
            for a in args:
                v = a(scope)
                if bool(v) == stop:
                    return v
            return v

        return chain
    a, b, sign = *args, node.sign
    return lambda scope: _apply(sign, a(scope), b(scope))


@dataclass
class Output:
    """Rendered text and the spans of what the model is to generate, in code points from `base` on."""

    base: int = 0
    texts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.texts.append(text)
        self.length += len(text)


def _action(node) -> Callable[[Scope, Output], None]:
    """A statement, or several, as a closure that writes."""
    if isinstance(node, tuple):
        steps = [_action(n) for n in node]
        if len(steps) == 1:
            return steps[0]

        def each(scope: Scope, out: Output) -> None:
            for s in steps:
                s(scope, out)

        return each
    if isinstance(node, Const):
        return lambda scope, out, t=node.value: out.write(t)
    if isinstance(node, Show):
        of = _value(node.of)
        return lambda scope, out: out.write(_text(of(scope)))
    if isinstance(node, If):
        test, yes, no = _value(node.test), _action(node.yes), _action(node.no)
        return lambda scope, out: yes(scope, out) if test(scope) else no(scope, out)
    if isinstance(node, Set):
        of = _value(node.of)

        def put(scope: Scope, out: Output) -> None:
            scope[node.name] = of(scope)

        return put
    if isinstance(node, Generation):
        body = _action(node.body)

        def mark(scope: Scope, out: Output) -> None:
            start = out.length
            body(scope, out)
            out.spans.append((out.base + start, out.base + out.length))

        return mark
    raise TemplateError("a loop stands at the top level, once, over messages")


@dataclass(frozen=True)
class Template:
    """Closures for what stands before the turns, for a turn, and after the turns. `message` names a turn's record."""

    head: Callable[[Scope, Output], None]
    turn: Callable[[Scope, Output], None]
    tail: Callable[[Scope, Output], None]
    message: str

    def render(self, messages: list[dict], **names: Value) -> tuple[str, list[tuple[int, int]]]:
        """A conversation as one text, and its spans to generate. For what fits memory; tasks go turn by turn."""
        scope, out = dict(names), Output()
        self.head(scope, out)
        for k, m in enumerate(messages):
            self.one(scope, out, m, k, k + 1 == len(messages))
        self.tail(scope, out)
        return "".join(out.texts), out.spans

    def one(self, scope: Scope, out: Output, record: dict, index: int, last: bool) -> None:
        scope[self.message] = record
        scope["loop"] = {"first": index == 0, "last": last, "index": index + 1, "index0": index}
        self.turn(scope, out)


def compile_template(source: str) -> Template:
    tree = fold(parse(source))
    loops = [k for k, n in enumerate(tree) if isinstance(n, For)]
    if len(loops) != 1 or tree[loops[0]].over != Name("messages"):
        raise TemplateError("a template has one loop, over messages, at its top level")
    k = loops[0]
    return Template(_action(tree[:k]), _action(tree[k].body), _action(tree[k + 1 :]), tree[k].name)
