"""Chat formatting: a sandboxed template language compiled to Python closures.

    {{ expression }}            output
    {% for m in messages %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = e %}
    {% generation %} ... {% endgeneration %}     what a model learns to say
    {# comment #}

Expressions: string and integer literals, names, .field and ['field'], + == != and or not,
parentheses, and the filters trim, upper, lower, escape. There is nothing else: no calls, no
attributes of Python objects, no imports; an unknown name or filter is an error when the
template is compiled. A template is parsed to a tree, constants are folded, and each node
becomes a closure that yields pieces of text, so a conversation of any length is rendered as
a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Piece = tuple[str, bool]
_TAG = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+.|()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """A template that the language has no meaning for."""


# ---- expressions: ("const", v) ("name", n) ("field", e, n) (op, a, b) ("not", e) ("filter", e, n)


class _Expression:
    def __init__(self, source: str, filters: Iterable[str]):
        self.tokens, self.filters, at = [], set(filters), 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(m.group(m.lastindex) if m.lastindex != 1 else ("text", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m[1][1:-1], flags=re.S)))
            at = m.end()
        self.at = 0

    def peek(self) -> Any:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> Any:
        token = self.peek()
        if token is None or wanted is not None and token != wanted:
            raise TemplateError(f"expected {wanted or 'more'}, found {token!r}")
        self.at += 1
        return token

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek() is not None:
            raise TemplateError(f"cannot read on from {self.peek()!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.peek() == "or":
            self.take()
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.peek() == "and":
            self.take()
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        if self.peek() == "not":
            self.take()
            return ("not", self.negated())
        return self.compared()

    def compared(self) -> tuple:
        tree = self.added()
        while self.peek() in ("==", "!="):
            tree = (self.take(), tree, self.added())
        return tree

    def added(self) -> tuple:
        tree = self.filtered()
        while self.peek() == "+":
            self.take()
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.single()
        while self.peek() in (".", "[", "|"):
            token = self.take()
            if token == "|":
                name = self.take()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                tree = ("filter", tree, name)
            else:
                name = self.take()
                if token == "[":
                    if not isinstance(name, tuple):
                        raise TemplateError("a field's name is a string")
                    name = name[1]
                    self.take("]")
                elif not isinstance(name, str) or not name.isidentifier():
                    raise TemplateError(f"no field {name!r}")
                tree = ("field", tree, name)
        return tree

    def single(self) -> tuple:
        token = self.take()
        if isinstance(token, tuple):
            return ("const", token[1])
        if token.isdigit():
            return ("const", int(token))
        if token == "(":
            tree = self.either()
            self.take(")")
            return tree
        if token in ("true", "false"):
            return ("const", token == "true")
        if token.isidentifier() and token not in ("and", "or", "not", "in"):
            return ("name", token)
        raise TemplateError(f"cannot read {token!r}")


class Template:
    """A compiled template. render(messages) yields (text, is generated) pieces."""

    def __init__(self, source: str, controls: Iterable[str] = (), names: Iterable[str] = ("messages",)):
        self.escape = Escaper(controls)
        self.filters: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "escape": self.escape}
        self.tree = self._fold(self._parse(source))
        self.slots = {n: k for k, n in enumerate(names)}
        self._body = self._block(self.tree, set(names))

    # ---- source to tree: ("text", s) ("out", e) ("for", name, e, body) ("if", [(e, body)]) ("set", name, e) ("gen", body)

    def _parse(self, source: str) -> list[tuple]:
        parts, at = [], 0
        for m in _TAG.finditer(source):
            if m.start() > at:
                parts.append(("text", source[at : m.start()]))
            tag = m[0]
            if tag[1] == "{":
                parts.append(("out", self._expression(tag[2:-2])))
            elif tag[1] == "%":
                parts.append(("tag", tag[2:-2].strip()))
            at = m.end()
        if at < len(source):
            parts.append(("text", source[at:]))
        parts.reverse()
        tree, end = self._body_until(parts, ())
        if end is not None:
            raise TemplateError(f"nothing to end by {end!r}")
        return tree

    def _expression(self, source: str) -> tuple:
        return _Expression(source, self.filters).whole()

    def _body_until(self, parts: list[tuple], ends: tuple[str, ...]) -> tuple[list[tuple], str | None]:
        body: list[tuple] = []
        while parts:
            kind, value = parts.pop()
            if kind != "tag":
                body.append((kind, value))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return body, value
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"cannot read {value!r}")
                inner, _ = self._body_until(parts, ("endfor",))
                body.append(("for", m[1], self._expression(m[2]), inner))
            elif word == "if":
                cases, condition = [], self._expression(rest)
                while True:
                    inner, end = self._body_until(parts, ("elif", "else", "endif"))
                    cases.append((condition, inner))
                    if end == "endif":
                        break
                    condition = ("const", True) if end == "else" else self._expression(end[4:])
                body.append(("if", cases))
            elif word == "set":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"cannot read {value!r}")
                body.append(("set", m[1], self._expression(m[2])))
            elif word == "generation":
                inner, _ = self._body_until(parts, ("endgeneration",))
                body.append(("gen", inner))
            else:
                raise TemplateError(f"no tag {value!r}")
        if ends:
            raise TemplateError(f"the template ends before {ends[-1]!r}")
        return body, None

    # ---- folding

    def _fold_expression(self, e: tuple) -> tuple:
        if e[0] in ("const", "name"):
            return e
        if e[0] == "field":
            return ("field", self._fold_expression(e[1]), e[2])
        args = [self._fold_expression(x) if isinstance(x, tuple) else x for x in e[1:]]
        folded = (e[0], *args)
        if e[0] == "+" and args[0][0] == "+" and args[0][2][0] == args[1][0] == "const":  # (x + 'a') + 'b'
            return self._fold_expression(("+", args[0][1], ("+", args[0][2], args[1])))
        if all(x[0] == "const" for x in args if isinstance(x, tuple)):
            return ("const", self._closure(folded, set())({}))
        return folded

    def _fold(self, body: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for node in body:
            kind = node[0]
            if kind == "out":
                e = self._fold_expression(node[1])
                node = ("text", _shown(e[1])) if e[0] == "const" else ("out", e)
            elif kind == "for":
                node = ("for", node[1], self._fold_expression(node[2]), self._fold(node[3]))
            elif kind == "set":
                node = ("set", node[1], self._fold_expression(node[2]))
            elif kind == "gen":
                node = ("gen", self._fold(node[1]))
            elif kind == "if":
                cases = []
                for condition, inner in node[1]:
                    condition = self._fold_expression(condition)
                    if condition[0] == "const" and not condition[1]:
                        continue
                    cases.append((condition, self._fold(inner)))
                    if condition[0] == "const":
                        break
                if not cases:
                    continue
                if cases[0][0][0] == "const":
                    out = self._fold(out + cases[0][1])
                    continue
                node = ("if", cases)
            if node[0] == "text" and out and out[-1][0] == "text":
                node = ("text", out.pop()[1] + node[1])
            if node != ("text", ""):
                out.append(node)
        return out

    # ---- tree to closures

    def _closure(self, e: tuple, known: set[str]) -> Callable[[dict], Any]:
        kind = e[0]
        if kind == "const":
            value = e[1]
            return lambda scope: value
        if kind == "name":
            name = e[1]
            if name not in known:
                raise TemplateError(f"no name {name!r}")
            return lambda scope: scope[name]
        if kind == "field":
            inner, name = self._closure(e[1], known), e[2]
            return lambda scope: _field(inner(scope), name)
        if kind == "filter":
            inner, change = self._closure(e[1], known), self.filters[e[2]]
            return lambda scope: change(_shown(inner(scope)))
        if kind == "not":
            inner = self._closure(e[1], known)
            return lambda scope: not inner(scope)
        a, b = self._closure(e[1], known), self._closure(e[2], known)
        if kind == "+":
            return lambda scope: _shown(a(scope)) + _shown(b(scope))
        if kind == "==":
            return lambda scope: a(scope) == b(scope)
        if kind == "!=":
            return lambda scope: a(scope) != b(scope)
        if kind == "and":
            return lambda scope: a(scope) and b(scope)
        return lambda scope: a(scope) or b(scope)

    def _block(self, body: list[tuple], known: set[str]) -> Callable[[dict, bool], Iterator[Piece]]:
        known = set(known)
        steps = []
        for node in body:
            steps.append(self._step(node, known))
            if node[0] == "set":
                known.add(node[1])

        def run(scope: dict, generated: bool) -> Iterator[Piece]:
            for step in steps:
                yield from step(scope, generated)

        return run

    def _step(self, node: tuple, known: set[str]) -> Callable[[dict, bool], Iterator[Piece]]:
        kind = node[0]
        if kind == "text":
            text = node[1]
            return lambda scope, generated: iter(((text, generated),))
        if kind == "out":
            value = self._closure(node[1], known)
            return lambda scope, generated: iter(((_shown(value(scope)), generated),))
        if kind == "gen":
            inner = self._block(node[1], known)
            return lambda scope, generated: inner(scope, True)
        if kind == "set":
            name, value = node[1], self._closure(node[2], known)

            def assign(scope: dict, generated: bool) -> Iterator[Piece]:
                scope[name] = value(scope)
                return iter(())

            return assign
        if kind == "if":
            cases = [(self._closure(c, known), self._block(b, known)) for c, b in node[1]]

            def choose(scope: dict, generated: bool) -> Iterator[Piece]:
                for condition, inner in cases:
                    if condition(scope):
                        return inner(scope, generated)
                return iter(())

            return choose
        name, items, inner = node[1], self._closure(node[2], known), self._block(node[3], known | {node[1], "loop"})

        def repeat(scope: dict, generated: bool) -> Iterator[Piece]:
            rows = iter(items(scope))
            ahead = next(rows, None)
            index = 0
            while ahead is not None:
                row, ahead = ahead, next(rows, None)
                index += 1
                yield from inner(scope | {name: row, "loop": {"index": index, "first": index == 1, "last": ahead is None}}, generated)

        return repeat

    def render(self, messages: Iterable[dict]) -> Iterator[Piece]:
        for text, generated in self._body({"messages": messages}, False):
            if text:
                yield text, generated


def _shown(value: Any) -> str:
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    raise TemplateError("only strings and integers can be shown")


def _field(value: Any, name: str) -> Any:
    if not isinstance(value, dict):
        raise TemplateError(f"no field {name!r} here")
    return value.get(name)


class Escaper:
    """Puts one backslash after the first character of every control string in a text.

    Control strings that hold backslashes there already get one more, so undo() takes one
    from each and gives back the text as it was; no control string is left in between.
    """

    def __init__(self, controls: Iterable[str]):
        controls = sorted(set(controls), key=lambda c: (-len(c), c))
        if any(len(c) < 2 or "\\" in c for c in controls):
            raise TemplateError("a control string has two characters or more and no backslash")
        parts = "|".join(f"(?<={re.escape(c[0])})(\\\\*)(?={re.escape(c[1:])})" for c in controls)
        self._found = re.compile(parts) if parts else None

    def __call__(self, text: str) -> str:
        return self._found.sub(lambda m: m[0] + "\\", text) if self._found else text

    def undo(self, text: str) -> str:
        return self._found.sub(lambda m: m[0][1:], text) if self._found else text


#: The default template: instructions in brackets, answers up to the end mark.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}<s> {% generation %}{{ m.text | escape }}{% endgeneration %} </s>"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE][INST] {{ m.text | escape }} [/INST]{% endif %}"
    "{% endfor %}"
)


class Reader:
    """Reads turns and the learnt text back from what the default template has rendered."""

    def __init__(self, escape: Escaper):
        self.escape = escape
        self.turns = self.chars = self.loss_chars = 0
        self._turns, self._loss = hashlib.sha256(), hashlib.sha256()
        self._open = ""
        self._learnt: list[str] = []

    def feed(self, text: str, generated: bool) -> None:
        self.chars += len(text)
        self._open += text
        if generated:
            self._learnt.append(text)
        elif self._learnt:
            self._flush()
        while (turn := self._next()) is not None:
            role, said = turn
            self.turns += 1
            self._turns.update(f"{role}\n{said}\n".encode())

    def _next(self) -> tuple[str, str] | None:
        text = self._open
        if text.startswith("[INST] "):
            role, begin, end = "user", 7, " [/INST]"
        elif text.startswith("<s> "):
            role, begin, end = "assistant", 4, " </s>"
        elif text.startswith("[ROLE]"):
            close = text.find("[/ROLE][INST] ")
            if close < 0:
                return None
            role, begin, end = self.escape.undo(text[6:close]), close + 14, " [/INST]"
        else:
            return None
        at = text.find(end, begin)
        if at < 0:
            return None
        self._open = text[at + len(end) :]
        return role, self.escape.undo(text[begin:at])

    def _flush(self) -> None:
        said = self.escape.undo("".join(self._learnt))
        self._learnt = []
        self.loss_chars += len(said)
        self._loss.update(said.encode())

    def result(self) -> dict[str, Any]:
        if self._learnt:
            self._flush()
        if self._open:
            raise TemplateError(f"cannot read back {self._open[:60]!r}")
        return {"n_turns": self.turns, "turns_sha256": self._turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self._loss.hexdigest(), "formatted_chars": self.chars}


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation one after another; ties by role and text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations as streams of their turns, each to be used up before the next."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True)

    stream = rows()
    ahead = next(stream, None)

    def turns(conv: int | None) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            row, ahead = ahead, next(stream, None)
            yield {"role": row[1], "text": row[2]}

    while ahead is not None:
        conv = ahead[0]
        yield conv, turns(conv)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """Formatted conversations in pieces: conv_id, piece (from 0), text, generated.

    The pieces of a conversation in order are its formatted text, and those with generated
    are what a model learns. Rows are dealt by conversation, sorted by turn and rendered as a
    stream, so memory doesn't grow with the length of a conversation.

    A null text or role counts as empty; turns that share a number go by role, then text;
    repeated rows are turns like others; null turns come first; rows with a null conv_id are
    one conversation; other columns are left out; an empty table gives no pieces.
    """
    compiled = Template(template, controls)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            c = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.bool_())], names=["conv_id", "piece", "text", "generated"])

        for conv, turns in _by_conversation(batches):
            for k, (text, generated) in enumerate(compiled.render(turns)):
                held.append((conv, k, text, generated))
                size += len(text) + 50
                if size > 1 << 21:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return _ordered(conversations).mapInArrow(work, "conv_id long, piece long, text string, generated boolean")


def read_back(conversations: DataFrame) -> DataFrame:
    """Renders each conversation by the default template and reads turns and learnt text back.

    One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Formatting and reading share a stream; cases are as in
    format_conversations.
    """
    compiled = Template(TEMPLATE, CONTROLS)
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(held, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

        for conv, turns in _by_conversation(batches):
            reader = Reader(compiled.escape)
            for text, generated in compiled.render(turns):
                reader.feed(text, generated)
            held.append({"conv_id": conv} | reader.result())
            if len(held) >= 4096:
                yield out()
                held = []
        if held:
            yield out()

    return _ordered(conversations).mapInArrow(work, "conv_id long, " + ", ".join(f"{n} {'string' if 'sha' in n else 'long'}" for n in names))
