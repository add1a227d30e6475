"""Chat formatting: a compiler for a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python
closures that yield text and generation marks. The language has

* output ``{{ expression }}``, ``{% set name = expression %}``,
* ``{% if %} … {% elif %} … {% else %} … {% endif %}``, ``{% for name in expression %} … {% endfor %}``,
* ``{% generation %} … {% endgeneration %}`` around text a model learns to write.

Expressions are literals, names, ``a.b`` and ``a['b']`` on mappings, ``a[0]``, ``a[-1]`` and ``a[1:3]`` on messages,
``+ - ~ == != < > <= >= in and or not``, ``x if c else y`` and filters ``x | f`` from ``FILTERS``. Nothing else
can be called or reached, and only texts, numbers, truth values and none can be written, so a template cannot touch
Python objects. What has no meaning, such as ``1 + 'a'``, raises TemplateError when it is reached.
``loop.first``, ``loop.last``, ``loop.index0`` and ``loop.index`` are known in a loop.

Messages are read one at a time. A template that goes over them once, as the default one does, holds
one message; any other finds those already read in a :class:`Messages`, which keeps long ones in a file of the task.
"""

from __future__ import annotations

import hashlib
import operator
import os
import pickle
import re
import tempfile
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, partitions, pick, scratch_root

PART_CHARS = 1 << 20  # a formatted conversation is stored in parts of whole turns of about this size

START, END = "<|im_start|>", "<|im_end|>"
CHATML = (
    "{% for m in messages %}" + START + "{{ m.role | line | escape }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + END + "\n{% endfor %}"
)


def escape(text: str) -> str:
    """No control string is left: ``<|`` gets a backslash in between, as does each ``<\\…|``."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "|" in text else text


def one_line(text: str) -> str:
    """No line break is left."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def many_lines(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


FILTERS: dict[str, Callable] = {"escape": escape, "line": one_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}
HELD_CHARS = 1 << 22  # messages beyond this go to a file if they are needed again


class Messages:
    """Messages read from an iterator as far as needed; unless ``once``, those read can be read again."""

    def __init__(self, source: Iterable[dict], once: bool = False) -> None:
        self.source, self.once = iter(source), once
        self.held: list[dict] = []
        self.chars = 0
        self.file = None
        self.places = array("q")

    def __iter__(self) -> Iterator[dict]:
        if self.once:
            yield from self.source
            return
        at = 0
        while self._reach(at):
            yield self[at]
            at += 1

    def _reach(self, at: int) -> bool:
        """Whether there is a message number ``at``, reading up to it."""
        while len(self.held) + len(self.places) <= at:
            message = next(self.source, None)
            if message is None:
                return False
            if self.chars < HELD_CHARS:
                self.held.append(message)
                self.chars += sum(map(len, message.values()))
                continue
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=scratch_root())  # gone with the conversation
            self.places.append(self.file.seek(0, os.SEEK_END))
            pickle.dump(message, self.file)
        return True

    def __len__(self) -> int:
        while self._reach(len(self.held) + len(self.places)):
            pass
        return len(self.held) + len(self.places)

    def __getitem__(self, at: int) -> dict | None:
        """The message number ``at``, from the end if negative; none if there is no such message."""
        if at < 0:
            at += len(self)
        if at < 0 or not self._reach(at):
            return None
        if at < len(self.held):
            return self.held[at]
        self.file.seek(self.places[at - len(self.held)])
        return pickle.load(self.file)

    def part(self, start: int | None, stop: int | None) -> Part:
        return Part(self, start, stop)


class Part:
    """Messages from ``start`` up to before ``stop``, as Python slices."""

    def __init__(self, of: Messages | Part, start: int | None, stop: int | None) -> None:
        self.of, self.start, self.stop = of, start, stop

    def __iter__(self) -> Iterator[dict]:
        if (self.start or 0) >= 0 and (self.stop or 0) >= 0:
            return islice(iter(self.of), self.start, self.stop)
        start, stop, _ = slice(self.start, self.stop).indices(len(self.of))
        return islice(iter(self.of), start, max(start, stop))

    def __len__(self) -> int:
        return len(range(*slice(self.start, self.stop).indices(len(self.of))))

    def __getitem__(self, at: int) -> dict | None:
        if at < 0:
            at += len(self)
        return next(islice(iter(self), at, None), None) if at >= 0 else None

    def part(self, start: int | None, stop: int | None) -> Part:
        return Part(self, start, stop)


# -- syntax tree ---------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    key: object


@dataclass(frozen=True)
class Between:
    """The messages ``of[start:stop]``; a bound may be missing."""

    of: object
    start: object
    stop: object


@dataclass(frozen=True)
class Apply:
    """A filter, an operator, ``and``, ``or``, ``not`` or ``if`` on its parts."""

    what: str
    parts: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class TemplateError(ValueError):
    """The template is not in the language."""


# -- parser --------------------------------------------------------------------

_TAG = re.compile(r"(\{\{-?|\{%-?)(.*?)(-?\}\}|-?%\})", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>+~|.()\[\]=:]))")
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return value if kind in ("op", "name") else ""

    def take(self, *values: str) -> bool:
        if self.peek() in values and values and self.peek():
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "name" or value in _WORDS or value.startswith("_"):
            raise TemplateError(f"name expected, not {value!r}")
        self.at += 1
        return value

    def whole(self):
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self):
        node = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Apply("if", (test, node, self.choice()))
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = Apply("or", (node, self.both()))
        return node

    def both(self):
        node = self.negation()
        while self.take("and"):
            node = Apply("and", (node, self.negation()))
        return node

    def negation(self):
        return Apply("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        node = self.joined()
        while self.peek() in _COMPARE or self.peek() == "in":
            what = self.peek()
            self.at += 1
            node = Apply(what, (node, self.joined()))
        return node

    def joined(self):
        node = self.filtered()
        while self.peek() in ("+", "-", "~"):
            what = self.peek()
            self.at += 1
            node = Apply(what, (node, self.filtered()))
        return node

    def filtered(self):
        node = self.primary()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Apply(f"|{name}", (node,))
        return node

    def primary(self):
        if self.at >= len(self.tokens):
            raise TemplateError("expression expected")
        kind, value = self.tokens[self.at]
        if self.take("("):
            node = self.choice()
            self.need(")")
        elif self.take("-"):
            return Apply("-", (Const(0), self.primary()))
        elif kind == "str":
            self.at += 1
            node = Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        elif kind == "int":
            self.at += 1
            node = Const(int(value))
        elif value in ("true", "false", "none"):
            self.at += 1
            node = Const({"true": True, "false": False, "none": None}[value])
        else:
            node = Name(self.name())
        while self.peek() in (".", "["):
            if self.take("."):
                node = Field(node, Const(self.name()))
            else:
                self.need("[")
                start = None if self.peek() == ":" else self.choice()
                if self.take(":"):
                    node = Between(node, start, None if self.peek() == "]" else self.choice())
                else:
                    node = Field(node, start)
                self.need("]")
        return node


def parse(source: str) -> tuple:
    """Syntax tree of a template."""
    tokens: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        tokens.append(("text", text.rstrip() if m[1].endswith("-") else text))
        tokens.append(("out" if m[1].startswith("{{") else "tag", m[2].strip()))
        at, strip = m.end(), m[3].startswith("-")
    tokens.append(("text", source[at:].lstrip() if strip else source[at:]))
    tokens.reverse()  # popped from the end
    return _block(tokens, ())[0]


def _block(tokens: list, ends: tuple[str, ...]) -> tuple[tuple, str]:
    body: list = []
    while tokens:
        kind, value = tokens.pop()
        word = value.split(None, 1)[0] if kind == "tag" and value else ""
        rest = value[len(word) :]
        if kind == "text":
            if value:
                body.append(Output(Const(value)))
        elif kind == "out":
            body.append(Output(_Expression(value).whole()))
        elif word in ends:
            return tuple(body), value
        elif word == "set":
            e = _Expression(rest)
            name = e.name()
            e.need("=")
            body.append(Set(name, e.whole()))
        elif word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            over = e.whole()
            body.append(For(name, over, _block(tokens, ("endfor",))[0]))
        elif word == "if":
            body.append(_branches(tokens, rest))
        elif word == "generation":
            body.append(Generation(_block(tokens, ("endgeneration",))[0]))
        else:
            raise TemplateError(f"unknown tag {value!r}")
    if ends:
        raise TemplateError(f"{' or '.join(ends)} is missing")
    return tuple(body), ""


def _branches(tokens: list, test: str) -> If:
    then, stop = _block(tokens, ("elif", "else", "endif"))
    other: tuple = ()
    if stop.startswith("elif"):
        other = (_branches(tokens, stop[4:]),)
    elif stop == "else":
        other = _block(tokens, ("endif",))[0]
    return If(_Expression(test).whole(), then, other)


# -- constant folding ----------------------------------------------------------


def _fold_value(node):
    if isinstance(node, Field):
        return Field(_fold_value(node.of), _fold_value(node.key))
    if isinstance(node, Between):
        return Between(_fold_value(node.of), *[None if b is None else _fold_value(b) for b in (node.start, node.stop)])
    if not isinstance(node, Apply):
        return node
    parts = tuple(_fold_value(p) for p in node.parts)
    node = Apply(node.what, parts)
    if node.what == "if" and isinstance(parts[0], Const):
        return parts[1] if parts[0].value else parts[2]
    if node.what in ("and", "or") and isinstance(parts[0], Const):
        return parts[1] if bool(parts[0].value) == (node.what == "and") else parts[0]
    if all(isinstance(p, Const) for p in parts):
        try:
            return Const(_value(node)({}))
        except TemplateError:
            return node  # raised if it is ever reached
    return node


def fold(tree: tuple) -> tuple:
    """The tree without constant expressions, dead branches and split texts."""
    out: list = []
    for node in tree:
        if isinstance(node, Output):
            node = Output(_fold_value(node.value))
            if isinstance(node.value, Const):
                text = _text(node.value.value)
                if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    text = out.pop().value.value + text
                if text:
                    out.append(Output(Const(text)))
                continue
            out.append(node)
        elif isinstance(node, If):
            test = _fold_value(node.test)
            if isinstance(test, Const):
                out = list(fold((*out, *(node.then if test.value else node.other))))
            else:
                out.append(If(test, fold(node.then), fold(node.other)))
        elif isinstance(node, For):
            out.append(For(node.name, _fold_value(node.over), fold(node.body)))
        elif isinstance(node, Generation):
            out.append(Generation(fold(node.body)))
        else:
            out.append(Set(node.name, _fold_value(node.value)))
    return tuple(out)


# -- closures ------------------------------------------------------------------


def _text(value) -> str:
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, (bool, int)):
        return str(value).lower()
    raise TemplateError("only texts, numbers, truth values and none can be written")


def _number(value) -> int:
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    raise TemplateError("a whole number expected")


def _get(of, key):
    if isinstance(of, dict) and isinstance(key, str):
        return of.get(key)
    if isinstance(of, (Messages, Part)):
        return of[_number(key)]
    raise TemplateError("only mappings have fields, only messages have numbers")


def _between(of, start, stop):
    if not isinstance(of, (Messages, Part)):
        raise TemplateError("only messages can be cut")
    return of.part(*[None if b is None else _number(b) for b in (start, stop)])


def _filtered(name: str, value):
    if name == "length" and isinstance(value, (Messages, Part, dict)):
        return len(value)
    return FILTERS[name](_text(value))


def _true(value) -> bool:
    """Messages count as true if there are any; only the first is read for that."""
    return value[0] is not None if isinstance(value, (Messages, Part)) else bool(value)


def _within(a, b) -> bool:
    if isinstance(b, (Messages, Part)):
        return any(a == m for m in b)
    return a in b


def _sum(a, b):
    if isinstance(a, (str, int)) and isinstance(b, (str, int)):
        return a + b
    raise TemplateError("only texts and numbers can be added")


_OPERATORS: dict[str, Callable] = {
    **_COMPARE, "+": _sum, "-": lambda a, b: _number(a) - _number(b), "~": lambda a, b: _text(a) + _text(b), "in": _within
}


def _apply(what: str, a, b):
    try:
        return _OPERATORS[what](a, b)
    except TypeError:
        raise TemplateError(f"{what!r} has no meaning here") from None


def _value(node) -> Callable[[dict], object]:
    """Closure that evaluates an expression in a scope."""
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Field):
        of, key = _value(node.of), _value(node.key)
        return lambda scope: _get(of(scope), key(scope))
    if isinstance(node, Between):
        of, start, stop = _value(node.of), *[_value(Const(None) if b is None else b) for b in (node.start, node.stop)]
        return lambda scope: _between(of(scope), start(scope), stop(scope))
    parts = [_value(p) for p in node.parts]
    a = parts[0]
    if node.what.startswith("|"):
        name = node.what[1:]
        return lambda scope: _filtered(name, a(scope))
    if node.what == "not":
        return lambda scope: not _true(a(scope))
    b = parts[1]
    if node.what == "if":
        c = parts[2]
        return lambda scope: b(scope) if _true(a(scope)) else c(scope)
    if node.what == "and":
        return lambda scope: b(scope) if _true(left := a(scope)) else left
    if node.what == "or":
        return lambda scope: left if _true(left := a(scope)) else b(scope)
    what = node.what
    return lambda scope: _apply(what, a(scope), b(scope))


# Events of a rendering: text, True and False around generations, None where a part may end.
Events = Iterator[str | bool | None]


def _loop(name: str, over: Callable, body: Callable, scope: dict, top: bool) -> Events:
    several = over(scope)
    if not isinstance(several, (Messages, Part, str, dict, type(None))):
        raise TemplateError("only messages, texts and mappings can be gone over")
    items = iter(() if several is None else several)
    following = next(items, _END)
    index = 0
    while following is not _END:
        item, following = following, next(items, _END)
        inner = dict(scope)
        inner[name] = item
        inner["loop"] = {"first": index == 0, "last": following is _END, "index0": index, "index": index + 1}
        yield from body(inner)
        if top:
            yield None
        index += 1


_END = object()


def _closure(tree: tuple, top: bool = True) -> Callable[[dict], Events]:
    """Closure that renders a list of nodes."""
    steps: list[Callable[[dict], Iterable]] = []
    for node in tree:
        if isinstance(node, Output):
            value = _value(node.value)
            steps.append(lambda scope, value=value: (_text(value(scope)),))
        elif isinstance(node, Set):
            steps.append(lambda scope, name=node.name, value=_value(node.value): scope.update({name: value(scope)}) or ())
        elif isinstance(node, If):
            then, other = _closure(node.then, False), _closure(node.other, False)
            steps.append(lambda scope, test=_value(node.test), then=then, other=other: then(scope) if _true(test(scope)) else other(scope))
        elif isinstance(node, For):
            steps.append(partial(_loop, node.name, _value(node.over), _closure(node.body, False), top=top))
        else:
            steps.append(lambda scope, body=_closure(node.body, False): _marked(body(scope)))

    def run(scope: dict) -> Events:
        for step in steps:
            yield from step(scope)

    return run


def _marked(body: Events) -> Events:
    yield True
    yield from body
    yield False


def compile_template(source: str) -> Callable[[Iterable[dict]], Events]:
    """Function from messages (``role``, ``text``) to the events of their rendering."""
    tree = fold(parse(source))
    run, once = _closure(tree), _goes_once(tree)
    return lambda messages: run({"messages": Messages(messages, once)})


def _uses(node) -> int:
    """How often ``messages`` is named."""
    if isinstance(node, Name):
        return int(node.name == "messages")
    if isinstance(node, tuple):
        return sum(map(_uses, node))
    return sum(_uses(getattr(node, f)) for f in getattr(node, "__dataclass_fields__", ()))


def _goes_once(tree: tuple) -> bool:
    """Whether the one use of ``messages`` is a loop that is not itself in a loop."""
    loops = [n for n in tree if isinstance(n, For) and n.over == Name("messages")]
    return len(loops) == 1 and _uses(tree) == 1


# -- operator ------------------------------------------------------------------

FORMATTED = "conv_id long, part int, formatted string, spans array<struct<start: long, stop: long>>"
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
])


def _rows(batches: Batches, *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _parts(events: Events, part_chars: int) -> Iterator[tuple[str, list[dict]]]:
    """Text and generation spans of whole turns; spans count from the start of the part."""
    pieces, spans, size, opened = [], [], 0, None
    for event in events:
        if isinstance(event, str):
            pieces.append(event)
            size += len(event)
        elif event is True:
            opened = size
        elif event is False:
            spans.append({"start": opened, "stop": size})
        elif size >= part_chars:
            yield "".join(pieces), spans
            pieces, spans, size = [], [], 0
    if pieces:
        yield "".join(pieces), spans


def _format(batches: Batches, template: str, part_chars: int) -> Batches:
    render = compile_template(template)
    out, size = [], 0
    for conv_id, rows in groupby(_rows(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
        messages = ({"role": role or "", "text": text or ""} for _, role, text in rows)
        for part, (text, spans) in enumerate(_parts(render(messages), part_chars)):
            out.append({"conv_id": conv_id, "part": part, "formatted": text, "spans": spans})
            size += len(text)
            if size > 4 << 20 or len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def format_conversations(turns: DataFrame, template: str = CHATML, part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted conversations: ``conv_id, part, formatted, spans``.

    ``turns`` needs ``conv_id``, ``turn`` (longs), ``role`` and ``text``; other columns are ignored. Turns
    are ordered by ``turn`` (null first), ties by role and text; repeated rows are repeated turns.
    Null roles and texts count as empty; a null ``conv_id`` is a conversation of its own. A conversation
    is one part, or several parts of whole turns, in order, once it passes ``part_chars``
    characters, so that a task holds one part at a time however long the conversation is. ``spans`` are
    the code points of a part inside generation marks. An empty table gives no rows.
    """
    ordered = (
        pick(turns, "conv_id", "turn", "role", "text")
        .repartition(partitions(turns), "conv_id")
        .sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    )
    return ordered.mapInArrow(partial(_format, template=template, part_chars=part_chars), FORMATTED)


def parse_part(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a part that the default template wrote."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        if not formatted.startswith(START, at):
            raise ValueError("turn without a start")
        yield many_lines(unescape(formatted[at + len(START) : line])), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


def _read(batches: Batches) -> Batches:
    out: list[tuple] = []
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
    for conv_id, parts in groupby(_rows(batches, "conv_id", "formatted", "spans"), key=lambda r: r[0]):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        for _, formatted, spans in parts:
            chars += len(formatted)
            for role, text in parse_part(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for span in spans:
                text = unescape(formatted[span["start"] : span["stop"]])
                loss.update(text.encode())
                loss_chars += len(text)
        out.append((conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if len(out) >= 4096:
            yield pack()
            out.clear()
    if out:
        yield pack()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from their text and spans alone.

    Takes the rows of :func:`format_conversations` as they come, which are ordered within their
    partitions: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    """
    return formatted.mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
