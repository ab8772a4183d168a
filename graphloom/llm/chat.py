"""A compiler for chat templates, and conversations rendered with it.

The template language is a small sandbox: text, `{{ expression }}`, `{% if %}/{% elif %}/{% else %}/
{% endif %}`, `{% for m in messages %}/{% endfor %}`, `{% generation %}/{% endgeneration %}` and
`{# comments #}`.  Expressions know literals, the variables handed in, `.name` / `['name']` of
mappings, `== != < > <= >= in not and or + ~` and the filters of FILTERS.  There are no calls, no
attributes of objects, and no loops but over a variable, so a template ends and reaches nothing.

A template is parsed to a syntax tree, constants are folded, and each node becomes a Python closure.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import partitions, ship
from graphloom.storage import StageTables


class TemplateError(ValueError):
    """A template that cannot be compiled, or that asks for something it may not have."""


# ---- syntax tree ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Constant:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Operation:
    name: str
    parts: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Branch:
    cases: tuple  # (condition, nodes)
    otherwise: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- parser ---------------------------------------------------------------------------------

_TAGS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+)|(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")"""
    r"""|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[<>+~|.\[\]()]))""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}


def _tokens(source: str) -> list[tuple[str, object]]:
    found, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at : at + 12]!r}")
        at = m.end()
        if m["number"]:
            found.append(("value", int(m["number"])))
        elif m["text"]:
            found.append(("value", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m["text"][1:-1], flags=re.S)))
        elif m["name"]:
            found.append(("name", m["name"]))
        else:
            found.append(("mark", m["mark"]))
    return found


class _Expression:
    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def next_is(self, *marks: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "value" and self.tokens[self.at][1] in marks:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, mark: str) -> None:
        if not self.next_is(mark):
            raise TemplateError(f"{mark!r} expected")

    def whole(self):
        found = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def either(self):
        left = self.both()
        while self.next_is("or"):
            left = Operation("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.next_is("and"):
            left = Operation("and", (left, self.negated()))
        return left

    def negated(self):
        return Operation("not", (self.negated(),)) if self.next_is("not") else self.compared()

    def compared(self):
        left = self.joined()
        while mark := self.next_is("==", "!=", "<", ">", "<=", ">=", "in"):
            left = Operation(mark, (left, self.joined()))
        return left

    def joined(self):
        left = self.filtered()
        while mark := self.next_is("+", "~"):
            left = Operation(mark, (left, self.filtered()))
        return left

    def filtered(self):
        value = self.single()
        while mark := self.next_is(".", "[", "|"):
            if mark == "[":
                value = Item(value, self.either())
                self.need("]")
                continue
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name":
                raise TemplateError("a name must follow")
            self.at += 1
            if mark == "|" and name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            value = Filter(name, value) if mark == "|" else Item(value, Constant(name))
        return value

    def single(self):
        if self.next_is("("):
            value = self.either()
            self.need(")")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "value":
            return Constant(value)
        if kind != "name" or value in ("and", "or", "not", "in"):
            raise TemplateError(f"unexpected {value!r}")
        return Constant(_WORDS[value.lower()]) if value.lower() in _WORDS else Name(value)


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of nodes."""
    pieces = _TAGS.split(source)
    # "{%-" and "-%}" drop the white space on their side.
    for i in range(1, len(pieces), 2):
        if not pieces[i].startswith("{#"):
            if pieces[i][2] == "-":
                pieces[i - 1] = pieces[i - 1].rstrip()
            if pieces[i][-3] == "-":
                pieces[i + 1] = pieces[i + 1].lstrip()
    parts = iter(enumerate(pieces))

    def nodes(*ends: str) -> tuple[tuple, str, str]:
        found = []
        for i, piece in parts:
            if i % 2 == 0:
                if piece:
                    found.append(Output(Constant(piece)))
            elif piece.startswith("{{"):
                found.append(Output(_Expression(piece[2:-2].strip("-")).whole()))
            elif piece.startswith("{%"):
                word, _, rest = piece[2:-2].strip("-").strip().partition(" ")
                if word in ends:
                    return tuple(found), word, rest
                if word == "if":
                    cases, otherwise, condition = [], (), rest
                    while True:
                        body, end, rest = nodes("elif", "else", "endif")
                        cases.append((_Expression(condition).whole(), body))
                        condition = rest
                        if end == "else":
                            otherwise = nodes("endif")[0]
                        if end != "elif":
                            break
                    found.append(Branch(tuple(cases), otherwise))
                elif word == "for":
                    name, _, over = rest.partition(" in ")
                    if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                        raise TemplateError(f"bad loop {rest!r}")
                    found.append(Loop(name.strip(), _Expression(over).whole(), nodes("endfor")[0]))
                elif word == "generation":
                    found.append(Generation(nodes("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(found), "", ""

    return nodes()[0]


# ---- constants ------------------------------------------------------------------------------


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _plus(a: object, b: object) -> object:
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


_TWO: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": _plus,
    "~": lambda a, b: _text(a) + _text(b),
}

# The marks of the format below, and how a text that holds them is told apart: a backslash before
# each backslash and before the first character of each mark.
HEADINGS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
OTHER, END = "### Role ", "</turn>"
_MARKS = re.compile("|".join([r"\\", *(re.escape(m) for m in (*HEADINGS.values(), OTHER, END))]))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: object) -> str:
    return _MARKS.sub(lambda m: "\\" + m[0], _text(text))


def escape_role(text: object) -> str:
    """Escapes a role, whose end is marked by a colon."""
    return re.sub(r"[\\:]", lambda m: "\\" + m[0], _text(text))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable] = {
    "escape": escape,
    "escape_role": escape_role,
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v),
}


def fold(node):
    """The node with everything computed that does not depend on variables."""
    if isinstance(node, tuple):
        return _fold_all(node)
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Filter):
        of = fold(node.of)
        return Constant(FILTERS[node.name](of.value)) if isinstance(of, Constant) else Filter(node.name, of)
    if isinstance(node, Operation):
        parts = tuple(fold(p) for p in node.parts)
        first = parts[0]
        if isinstance(first, Constant):
            if node.name == "not":
                return Constant(not first.value)
            if node.name in ("and", "or"):
                return first if bool(first.value) == (node.name == "or") else parts[1]
            if isinstance(parts[1], Constant):
                return Constant(_TWO[node.name](first.value, parts[1].value))
        return Operation(node.name, parts)
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


def _fold_all(nodes: tuple) -> tuple:
    found: list = []
    for node in nodes:
        if isinstance(node, Branch):
            cases, otherwise = [], fold(node.otherwise)
            for condition, body in node.cases:
                condition = fold(condition)
                if isinstance(condition, Constant) and not condition.value:
                    continue
                if isinstance(condition, Constant):  # always taken if reached
                    otherwise = fold(body)
                    break
                cases.append((condition, fold(body)))
            new = [Branch(tuple(cases), otherwise)] if cases else list(otherwise)
        else:
            new = [fold(node)]
        for one in new:
            if isinstance(one, Output) and isinstance(one.value, Constant):
                text = _text(one.value.value)
                if found and isinstance(found[-1], Output) and isinstance(found[-1].value, Constant):
                    text = found.pop().value.value + text
                one = Output(Constant(text))
                if not text:
                    continue
            found.append(one)
    return tuple(found)


# ---- closures -------------------------------------------------------------------------------


class Sink:
    """Collects rendered text and the spans inside generation marks."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Constant):
        return lambda env, v=node.value: v
    if isinstance(node, Name):

        def look_up(env, name=node.name):
            if name not in env:
                raise TemplateError(f"unknown variable {name!r}")
            return env[name]

        return look_up
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)

        def item(env):
            holder = of(env)
            if not isinstance(holder, dict):
                raise TemplateError("only mappings have items")
            return holder.get(key(env))

        return item
    if isinstance(node, Filter):
        apply, of = FILTERS[node.name], _value(node.of)
        return lambda env: apply(of(env))
    parts = [_value(p) for p in node.parts]
    if node.name == "not":
        return lambda env: not parts[0](env)
    if node.name == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if node.name == "or":
        return lambda env: parts[0](env) or parts[1](env)
    apply = _TWO[node.name]
    return lambda env: apply(parts[0](env), parts[1](env))


def _writer(nodes: tuple) -> Callable[[dict, Sink], None]:
    steps = [_write_one(n) for n in nodes]

    def run(env: dict, sink: Sink) -> None:
        for step in steps:
            step(env, sink)

    return steps[0] if len(steps) == 1 else run


def _write_one(node) -> Callable[[dict, Sink], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Constant):
            text = _text(node.value.value)
            return lambda env, sink: sink.write(text)
        value = _value(node.value)
        return lambda env, sink: sink.write(_text(value(env)))
    if isinstance(node, Branch):
        cases = [(_value(c), _writer(b)) for c, b in node.cases]
        otherwise = _writer(node.otherwise)

        def branch(env: dict, sink: Sink) -> None:
            for condition, body in cases:
                if condition(env):
                    return body(env, sink)
            return otherwise(env, sink)

        return branch
    if isinstance(node, Generation):
        body = _writer(node.body)

        def generation(env: dict, sink: Sink) -> None:
            start = sink.size
            body(env, sink)
            sink.spans.append((start, sink.size))

        return generation
    over, body = _value(node.over), _writer(node.body)

    def loop(env: dict, sink: Sink) -> None:
        rows = list(over(env) or ())
        for i, row in enumerate(rows):
            body({**env, node.name: row, "loop": _loop(i, i == len(rows) - 1)}, sink)

    return loop


def _loop(index: int, last: bool) -> dict:
    return {"index0": index, "index": index + 1, "first": index == 0, "last": last}


class Template:
    """A compiled template.

    render(variables) gives (text, spans) of a whole conversation in memory.  turn(...) gives the
    part of one message: what stands before the loop over `messages` goes with the first message
    and what follows it with the last, so that conversations of any length can be streamed.  It
    needs a single loop over `messages` at the top level, and no other use of `messages`.
    """

    def __init__(self, source: str):
        self.nodes = fold(parse(source))
        self.whole = _writer(self.nodes)
        loops = [i for i, n in enumerate(self.nodes) if isinstance(n, Loop) and n.over == Name("messages")]
        self.streams = len(loops) == 1 and repr(self.nodes).count("Name(name='messages')") == 1
        if self.streams:
            at = loops[0]
            self.before, self.after = _writer(self.nodes[:at]), _writer(self.nodes[at + 1 :])
            self.name, self.body = self.nodes[at].name, _writer(self.nodes[at].body)

    def render(self, variables: dict) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        self.whole(variables, sink)
        return "".join(sink.parts), sink.spans

    def turn(self, message: dict, index: int, last: bool, variables: dict) -> tuple[str, list[tuple[int, int]]]:
        if not self.streams:
            raise TemplateError("the template needs one loop over messages at its top level")
        sink = Sink()
        if index == 0:
            self.before(variables, sink)
        self.body({**variables, self.name: message, "loop": _loop(index, last)}, sink)
        if last:
            self.after(variables, sink)
        return "".join(sink.parts), sink.spans


TURNS = """{% for message in messages -%}
{% if message.role == 'assistant' -%}
### Assistant: {% generation %}{{ message.content | escape }}{% endgeneration -%}
{% elif message.role == 'user' %}### User: {{ message.content | escape -}}
{% elif message.role == 'system' %}### System: {{ message.content | escape -}}
{% else %}### Role {{ message.role | escape_role }}: {{ message.content | escape }}{% endif %}</turn>
{% endfor -%}"""

_HEAD = re.compile(r"### (?:(System|User|Assistant): |Role ((?:\\.|[^\\:])*): )", re.S)
_STOP = re.compile(r"\\.|</turn>", re.S)


def read_turns(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns in text that TURNS has written; start and end span the
    escaped text."""
    found, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        if not head:
            raise ValueError(f"no turn at {at}")
        stop = next((m for m in _STOP.finditer(text, head.end()) if m[0] == END), None)
        if not stop or not text.startswith("\n", stop.end()):
            raise ValueError(f"no end of the turn at {at}")
        role = head[1].lower() if head[1] else unescape(head[2])
        found.append((role, unescape(text[head.end() : stop.start()]), head.end(), stop.start()))
        at = stop.end() + 1
    return found


# ---- tables ---------------------------------------------------------------------------------

PIECES = "conv_id long, piece long, text string, loss array<struct<start: int, stop: int>>"
_PIECES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("piece", pa.int64()),
        ("text", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ]
)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str)) + 64
        if size > most or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_conversations(rows: DataFrame, source: str = TURNS, variables: dict | None = None) -> DataFrame:
    """The formatted text of all conversations, one piece per turn: conv_id, piece, text, loss.

    rows: (conv_id, turn, role, text).  The pieces of a conversation, joined in order, are its text;
    `loss` holds the spans of a piece that lie inside generation marks, in characters.  Turns come by
    (turn, role, text), nulls first; null roles and texts count as empty; rows without conv_id form
    one conversation; repeated rows are turns of their own.  Rows are sorted within partitions and
    streamed with one row of lookahead, so a conversation may have any number of turns.
    """
    spark = rows.sparkSession
    ship(spark)
    Template(source)  # faults of a template show here
    given = variables or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source)

        def pieces():
            waiting, index = None, 0
            for row in _rows(batches):
                if waiting is not None:
                    same = waiting["conv_id"] == row["conv_id"]
                    yield piece(waiting, index, not same)
                    index = index + 1 if same else 0
                waiting = row
            if waiting is not None:
                yield piece(waiting, index, True)

        def piece(row, index, last):
            message = {"role": row["role"] or "", "content": row["text"] or "", "turn": row["turn"]}
            text, spans = template.turn(message, index, last, given)
            return row["conv_id"], index, text, [{"start": a, "stop": b} for a, b in spans]

        yield from _in_batches(pieces(), _PIECES)

    columns = ["conv_id", "turn", "role", "text"]
    ordered = rows.select(*columns).repartition(partitions(spark), "conv_id").sortWithinPartitions(*columns)
    return ordered.mapInArrow(run, PIECES)


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted pieces (by TURNS) hold, per conversation: see DIGEST.

    turns_sha256 is over role, newline, text, newline of every turn; loss_* over the unescaped text
    of the loss spans.  A digest goes through a conversation in order, in constant memory.
    """
    spark = pieces.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests():
            conv, open_, turns, loss, counts = None, False, None, None, [0, 0, 0]
            for row in _rows(batches):
                if not open_ or row["conv_id"] != conv:
                    if open_:
                        yield conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]
                    conv, open_, turns, loss, counts = row["conv_id"], True, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                text = row["text"]
                for role, said, _, _ in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    counts[0] += 1
                for span in row["loss"]:
                    said = unescape(text[span["start"] : span["stop"]])
                    loss.update(said.encode())
                    counts[1] += len(said)
                counts[2] += len(text)
            if open_:
                yield conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        yield from _in_batches(digests(), _DIGEST)

    ordered = pieces.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.mapInArrow(run, DIGEST)


def format_and_read(rows: DataFrame) -> DataFrame:
    """Formats by TURNS into the shared stage folder and reads the files back."""
    written, _ = StageTables(rows.sparkSession, "chat").put(format_conversations(rows), "pieces")
    return read_back(written)
