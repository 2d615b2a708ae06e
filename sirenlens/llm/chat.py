"""Chat formatting: a small template language, compiled to Python closures.

Template text is parsed into a syntax tree, constants are folded, and every node becomes a closure
that writes into a rendering. Templates are sandboxed: they see only the values handed over, have
no calls, no attributes of Python objects, and loops over given lists only, so a rendering ends and
reaches nothing else.

    {{ expr }}  {% if expr %} {% elif expr %} {% else %} {% endif %}
    {% for name in expr %} {% endfor %}  {% set name = expr %}
    {% generation %} {% endgeneration %}     marks what a loss is computed on

    expr: "text", 12, true, false, none, name, a.key, a["key"], loop.first, loop.last, loop.index0,
          + == != and or not in, parentheses, filters  | escape | trim | lower | upper
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns between marks that texts cannot contain: escaping puts a backslash before their characters.
TEMPLATE = (
    '{% for m in messages %}{% if m.role == "assistant" %}'
    "<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    '{% else %}{{ "[INST" + " " }}{{ m.role | escape }}]{{ m.text | escape }}[/INST]{% endif %}{% endfor %}'
)
_CONTROL = re.compile(r"[\\\[\]<>]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLAIN = r"[^\\\[\]<>]*(?:\\.[^\\\[\]<>]*)*"
_TURN = re.compile(rf"\[INST ({_PLAIN})\]({_PLAIN})\[/INST\]|<s>({_PLAIN})</s>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "lower": str.lower, "upper": str.upper}


class TemplateError(ValueError):
    pass


@dataclass
class Rendering:
    """Text so far, and the spans written inside generation marks."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


# Syntax tree. Expressions: ("const", v) ("name", n) ("get", e, key) ("not", e) ("filter", name, e) (op, a, b).
# Statements: ("text", s) ("emit", e) ("if", [(e, body)], else) ("for", name, e, body) ("set", name, e)
# ("generation", body).
_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.DOTALL)
_LEX = re.compile(r"\s*(?:(\"[^\"]*\"|'[^']*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[+.|()\[\]]))")


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        found = _LEX.match(source, at)
        if not found:
            raise TemplateError(f"cannot read {source[at:]!r}")
        kind = ("text", "number", "name", "op")[found.lastindex - 1]
        out.append((kind, found[found.lastindex]))
        at = found.end()
    return [*out, ("end", "")]


class _Expression:
    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def take(self, *values: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, kind: str) -> str:
        found, value = self.tokens[self.at]
        if found != kind:
            raise TemplateError(f"{kind} expected, not {value!r}")
        self.at += 1
        return value

    def whole(self) -> tuple:
        tree = self.either()
        self.need("end")
        return tree

    def _chain(self, part: Callable[[], tuple], *ops: str) -> tuple:
        tree = part()
        while op := self.take(*ops):
            tree = (op, tree, part())
        return tree

    def either(self) -> tuple:
        return self._chain(self.both, "or")

    def both(self) -> tuple:
        return self._chain(self.negated, "and")

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        return self._chain(self.added, "==", "!=", "in")

    def added(self) -> tuple:
        return self._chain(self.filtered, "+")

    def filtered(self) -> tuple:
        tree = self.value()
        while self.take("|"):
            name = self.need("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            tree = ("filter", name, tree)
        return tree

    def value(self) -> tuple:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            tree: tuple = ("const", value[1:-1])
        elif kind == "number":
            tree = ("const", int(value))
        elif kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            tree = ("const", fixed[value]) if value in fixed else ("name", value)
        elif value == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError(") expected")
        else:
            raise TemplateError(f"a value expected, not {value!r}")
        while op := self.take(".", "["):
            if op == ".":
                tree = ("get", tree, self.need("name"))
            else:
                tree = ("get", tree, self.need("text")[1:-1])
                if not self.take("]"):
                    raise TemplateError("] expected")
        return tree


def parse(template: str) -> list[tuple]:
    items: list[tuple[str, str]] = []
    at = 0
    for found in _PARTS.finditer(template):
        if found.start() > at:
            items.append(("text", template[at : found.start()]))
        items.append(("emit", found[1]) if found[1] is not None else ("tag", found[2].strip()))
        at = found.end()
    if at < len(template):
        items.append(("text", template[at:]))
    position = 0

    def body(*ends: str) -> tuple[list[tuple], str]:
        nonlocal position
        out: list[tuple] = []
        while position < len(items):
            kind, value = items[position]
            position += 1
            if kind == "text":
                out.append(("text", value))
                continue
            if kind == "emit":
                out.append(("emit", _Expression(value).whole()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return out, value
            if word == "if":
                arms, last, test = [], [], rest
                while True:
                    inner, end = body("elif", "else", "endif")
                    arms.append((_Expression(test).whole(), inner))
                    word, _, test = end.partition(" ")
                    if word == "else":
                        last, _ = body("endif")
                    if word != "elif":
                        break
                out.append(("if", arms, last))
            elif word == "for":
                found = re.fullmatch(r"(\w+) in (.*)", rest, re.DOTALL)
                if not found:
                    raise TemplateError(f"cannot read for {rest}")
                inner, _ = body("endfor")
                out.append(("for", found[1], _Expression(found[2]).whole(), inner))
            elif word == "set":
                name, _, expr = rest.partition("=")
                out.append(("set", name.strip(), _Expression(expr).whole()))
            elif word == "generation":
                inner, _ = body("endgeneration")
                out.append(("generation", inner))
            else:
                raise TemplateError(f"no tag {word}")
        if ends:
            raise TemplateError(f"{ends[-1]} expected")
        return out, ""

    return body()[0]


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _apply(op: str, a: object, b: object) -> object:
    if op == "+":
        return _text(a) + _text(b) if isinstance(a, str) or isinstance(b, str) else a + b
    if op == "in":
        return a in b if isinstance(b, list | dict | str) else False
    return {"==": a == b, "!=": a != b}[op]


def fold_expr(tree: tuple) -> tuple:
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "get":
        return ("get", fold_expr(tree[1]), tree[2])
    if kind == "not":
        inner = fold_expr(tree[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "filter":
        inner = fold_expr(tree[2])
        return ("const", FILTERS[tree[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    a, b = fold_expr(tree[1]), fold_expr(tree[2])
    if a[0] == "const" and kind in ("and", "or"):
        return b if bool(a[1]) == (kind == "and") else a
    if a[0] == b[0] == "const" and kind not in ("and", "or"):
        return ("const", _apply(kind, a[1], b[1]))
    return (kind, a, b)


def fold(body: list[tuple]) -> list[tuple]:
    """Constant expressions become values, constant output joins the text, dead branches go."""
    out: list[tuple] = []

    def text(s: str) -> None:
        if out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + s)
        elif s:
            out.append(("text", s))

    for node in body:
        if node[0] == "text":
            text(node[1])
        elif node[0] == "emit":
            tree = fold_expr(node[1])
            text(_text(tree[1])) if tree[0] == "const" else out.append(("emit", tree))
        elif node[0] == "if":
            arms, last = [], fold(node[2])
            for test, inner in node[1]:
                test = fold_expr(test)
                if test[0] != "const":
                    arms.append((test, fold(inner)))
                elif test[1]:
                    last = fold(inner)
                    break
            if arms:
                out.append(("if", arms, last))
            else:
                for inner in last:
                    text(inner[1]) if inner[0] == "text" else out.append(inner)
        elif node[0] == "for":
            out.append(("for", node[1], fold_expr(node[2]), fold(node[3])))
        elif node[0] == "set":
            out.append(("set", node[1], fold_expr(node[2])))
        else:
            out.append(("generation", fold(node[1])))
    return out


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        fixed = tree[1]
        return lambda scope: fixed
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "get":
        inner, key = _value(tree[1]), tree[2]

        def get(scope: dict) -> object:
            held = inner(scope)
            return held.get(key) if type(held) is dict else None

        return get
    if kind == "not":
        inner = _value(tree[1])
        return lambda scope: not inner(scope)
    if kind == "filter":
        function, inner = FILTERS[tree[1]], _value(tree[2])
        return lambda scope: function(_text(inner(scope)))
    a, b = _value(tree[1]), _value(tree[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope: _apply(kind, a(scope), b(scope))


def _block(body: list[tuple]) -> Callable[[dict, Rendering], None]:
    steps = [_step(node) for node in body]

    def run(scope: dict, out: Rendering) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node: tuple) -> Callable[[dict, Rendering], None]:
    kind = node[0]
    if kind == "text":
        fixed = node[1]
        return lambda scope, out: out.write(fixed)
    if kind == "emit":
        value = _value(node[1])
        return lambda scope, out: out.write(_text(value(scope)))
    if kind == "set":
        name, value = node[1], _value(node[2])

        def assign(scope: dict, out: Rendering) -> None:
            scope[name] = value(scope)

        return assign
    if kind == "if":
        arms, last = [(_value(test), _block(inner)) for test, inner in node[1]], _block(node[2])

        def choose(scope: dict, out: Rendering) -> None:
            for test, inner in arms:
                if test(scope):
                    return inner(scope, out)
            return last(scope, out)

        return choose
    if kind == "for":
        name, value, inner = node[1], _value(node[2]), _block(node[3])

        def each(scope: dict, out: Rendering) -> None:
            items = value(scope)
            items = items if isinstance(items, list) else []
            for k, item in enumerate(items):
                loop = {"first": k == 0, "last": k == len(items) - 1, "index0": k}
                inner({**scope, name: item, "loop": loop}, out)

        return each
    inner = _block(node[1])

    def generated(scope: dict, out: Rendering) -> None:
        begin = out.length
        inner(scope, out)
        out.spans.append((begin, out.length))

    return generated


def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from values to the rendered text and its generation spans."""
    block = _block(fold(parse(template)))

    def render(values: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Rendering()
        block(dict(values), out)
        return "".join(out.parts), out.spans

    return render


_SPAN = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _format(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for batch in batches:
            texts, spans = [], []
            for messages in batch["messages"].to_pylist():
                text, marked = render({"messages": messages})
                texts.append(text)
                spans.append([{"begin": a, "end": b} for a, b in marked])
            yield pa.record_batch(
                [batch["conv_id"], pa.array(texts, pa.string()), pa.array(spans, _SPAN)],
                names=["conv_id", "formatted", "loss_spans"],
            )

    return run


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, formatted, loss_spans`` for each conversation of ``turns(conv_id, turn, role, text)``.

    Turns go by number, null first, ties by role and text; null roles and texts are empty. Repeated
    rows are turns of their own. Rows without a conversation id are one conversation.
    """
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    grouped = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(turn)).alias("messages")
    )
    return grouped.mapInArrow(
        _format(template), "conv_id long, formatted string, loss_spans array<struct<begin: long, end: long>>"
    )


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a text that ``TEMPLATE`` has rendered."""
    turns, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            raise ValueError(f"no turn at {at}")
        at = found.end()
        said = found[3]
        turns.append(("assistant", unescape(said)) if said is not None else (unescape(found[1]), unescape(found[2])))
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for formatted, spans in zip(batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True):
            turns = read_turns(formatted)
            whole = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            loss = "".join(unescape(formatted[s["begin"] : s["end"]]) for s in spans)
            rows.append((len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.record_batch(
            [batch["conv_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations gets back, as counts and digests."""
    return formatted.mapInArrow(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
