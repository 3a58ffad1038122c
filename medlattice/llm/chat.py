r"""Chat formatting by a template compiler.

``compile_template`` parses a sandboxed template language into a syntax tree, folds constants (expressions and
conditions without names, neighbouring text) and generates Python closures.  The language has text, ``{{ expression }}``,
``{# comment #}``, hyphens that trim white space beside a tag, ``{% for x in e %}`` with ``loop``, ``{% if %} / elif / else``, ``{% set %}`` and
``{% generation %} ... {% endgeneration %}``, which marks what the model is to learn.  Expressions have literals, names,
``a.b`` and ``a['b']`` on mappings and lists only, comparison, ``in``, ``and or not``, ``+``, ``~`` and filters.  There is
no access to attributes, calls or builtins, and loops run only over data.

Rendering writes to a sink, and ``for`` takes any iterable, so turns are read one by one; the output of the conversation
at hand is held until it ends, then emitted in parts of about ``PART`` characters with the learnt spans as offsets in the
whole output.  A conversation is one task's work: its output and digests are sequences.

Control strings in texts are escaped reversibly: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``; in roles a line feed
becomes ``\n``.  Defined results: null text or role counts as empty; rows with a null conversation id form one
conversation; equal turn numbers (ties) are ordered by role, then text; repeated rows are repeated turns; very long texts
and conversations leave in parts; an empty table gives no conversations; other columns are not read and cannot clash.
"""
from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template of the query: each turn between control strings, assistant texts to be learnt.
CHATML = """{% for m in messages %}<|im_start|>{{ m.role | guard_line }}
{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}<|im_end|>
{% endfor %}"""
PART = 1 << 18


class TemplateError(ValueError):
    pass


def guard(text) -> str:
    return str(text).replace("\\", "\\\\").replace("<|", "<\\|")


def guard_line(text) -> str:
    return guard(text).replace("\n", "\\n")


def unguard(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable] = {"guard": guard, "guard_line": guard_line, "trim": lambda s: str(s).strip(), "upper": lambda s: str(s).upper(), "lower": lambda s: str(s).lower(), "length": len, "string": str}

# --- syntax tree: tuples whose first item names the node

_INNER = r"((?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^'\"])*?)"  # brackets inside a literal end no tag
_TAG = re.compile(r"\{\{(-?)" + _INNER + r"(-?)\}\}|\{%(-?)" + _INNER + r"(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.\[\]()]))")
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] >= 3 and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {values}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.peek("or"):
            self.take("or")
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.peek("and"):
            self.take("and")
            node = ("and", node, self.negated())
        return node

    def negated(self):
        if self.peek("not"):
            self.take("not")
            return ("not", self.negated())
        return self.compared()

    def compared(self):
        node = self.joined()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            node = (self.take("==", "!=", "<", ">", "<=", ">=", "in"), node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while self.peek("+", "~"):
            node = (self.take("+", "~"), node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while self.peek("|", ".", "["):
            if self.take("|", ".", "[") == "[":
                node = ("item", node, self.either())
                self.take("]")
                continue
            kind, name = self.tokens[self.at - 1][1], self.tokens[self.at : self.at + 1]
            if not name or name[0][0] != 3:
                raise TemplateError("a name must follow")
            self.at += 1
            if kind == "|" and name[0][1] not in FILTERS:
                raise TemplateError(f"no filter {name[0][1]!r}")
            node = ("filter", node, name[0][1]) if kind == "|" else ("item", node, ("const", name[0][1]))
        return node

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return ("const", int(value))
        if kind == 2:
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == 3:
            return ("const", _WORDS[value]) if value in _WORDS else ("name", value)
        if value == "(":
            node = self.either()
            self.take(")")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """The template's statements as a tree."""
    parts, at, trim = [], 0, False

    def plain(text: str, trim_end: bool) -> None:
        text = text.lstrip() if trim else text
        if text := text.rstrip() if trim_end else text:
            parts.append(("text", text))

    for m in _TAG.finditer(source):
        plain(source[at : m.start()], bool(m[1] or m[4] or m[7]))
        at, trim = m.end(), bool(m[3] or m[6] or m[8])  # a hyphen at a tag's end takes the white space beside it
        if m[2] is not None:
            parts.append(("show", _Expression(m[2]).whole()))
        elif m[5] is not None:
            parts.append(("tag", m[5].strip()))
    plain(source[at:], False)
    if bad := next((p[1] for p in parts if p[0] == "text" and ("{{" in p[1] or "{%" in p[1])), None):
        raise TemplateError(f"an open tag in {bad[:30]!r}")
    pos = 0

    def body(*ends: str) -> tuple[list, str]:
        nonlocal pos
        out = []
        while pos < len(parts):
            kind, value = parts[pos]
            pos += 1
            if kind != "tag":
                out.append((kind, value))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return out, value
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"bad loop {value!r}")
                out.append(("for", m[1], _Expression(m[2]).whole(), body("endfor")[0]))
            elif word == "if":
                arms, test = [], _Expression(rest).whole()
                while True:
                    inner, end = body("elif", "else", "endif")
                    arms.append((test, inner))
                    if end == "endif":
                        break
                    test = ("const", True) if end == "else" else _Expression(end.partition(" ")[2]).whole()
                out.append(("if", arms))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.*)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"bad set {value!r}")
                out.append(("set", m[1], _Expression(m[2]).whole()))
            elif word == "generation":
                out.append(("generation", body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    return body()[0]


# --- meaning of the operators, for folding and for the closures alike


def _item(value, key):
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else None
    return None


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}", "item": _item,
}


def fold(node: tuple) -> tuple:
    """The expression with every part that has no name replaced by its value; parts that fail are left to fail when run."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        inner = fold(node[1])
        try:
            return ("const", FILTERS[node[2]](inner[1])) if inner[0] == "const" else ("filter", inner, node[2])
        except TypeError:
            return ("filter", inner, node[2])
    args = [fold(a) for a in node[1:]]
    if kind in ("and", "or") and args[0][0] == "const":
        return args[1] if bool(args[0][1]) == (kind == "and") else args[0]
    if all(a[0] == "const" for a in args):
        try:
            return ("const", not args[0][1] if kind == "not" else _BINARY[kind](*(a[1] for a in args)))
        except (TypeError, KeyError):
            pass
    return (kind, *args)


def optimise(nodes: list[tuple]) -> list[tuple]:
    """Fold expressions, choose arms of constant conditions, merge neighbouring text."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "show":
            e = fold(node[1])
            new = [("text", "" if e[1] is None else str(e[1]))] if e[0] == "const" else [("show", e)]
        elif kind == "if":
            arms = []
            for test, inner in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, optimise(inner)))
                if test[0] == "const":
                    break
            new = arms[0][1] if arms and arms[0][0][0] == "const" else [("if", arms)] if arms else []
        elif kind == "for":
            new = [("for", node[1], fold(node[2]), optimise(node[3]))]
        elif kind == "set":
            new = [("set", node[1], fold(node[2]))]
        elif kind == "generation":
            new = [("generation", optimise(node[1]))]
        else:
            new = [node]
        for n in new:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)
    return out


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "filter":
        return lambda env, f=FILTERS[node[2]], a=_value(node[1]): f(a(env))
    a = _value(node[1])
    if kind == "not":
        return lambda env: not a(env)
    b = _value(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    return lambda env, f=_BINARY[kind]: f(a(env), b(env))


def _statements(nodes: list[tuple]) -> Callable:
    steps = [_statement(n) for n in nodes]

    def run(env, sink):
        for s in steps:
            s(env, sink)

    return steps[0] if len(steps) == 1 else run


def _statement(node: tuple) -> Callable:
    kind = node[0]
    if kind == "text":
        return lambda env, sink, t=node[1]: sink.write(t)
    if kind == "show":
        e = _value(node[1])

        def show(env, sink):
            v = e(env)
            if v is not None:
                sink.write(v if isinstance(v, str) else str(v))

        return show
    if kind == "set":
        return lambda env, sink, n=node[1], e=_value(node[2]): env.__setitem__(n, e(env))
    if kind == "generation":
        inner = _statements(node[1])

        def generation(env, sink):
            begin = sink.size
            inner(env, sink)
            sink.learn(begin, sink.size)

        return generation
    if kind == "if":
        arms = [(_value(t), _statements(b)) for t, b in node[1]]

        def choose(env, sink):
            for test, inner in arms:
                if test(env):
                    return inner(env, sink)

        return choose
    name, e, inner = node[1], _value(node[2]), _statements(node[3])

    def loop(env, sink):
        own = dict(env)
        it = iter(e(env) or ())
        item, i = next(it, _END), 0
        while item is not _END:
            after = next(it, _END)  # one item ahead, for loop.last
            own[name], own["loop"] = item, {"index": i + 1, "index0": i, "first": i == 0, "last": after is _END}
            inner(own, sink)
            item, i = after, i + 1

    return loop


_END = object()


class Sink:
    """Collects what is rendered; hands on parts once they are ``part`` characters long."""

    def __init__(self, part: int = PART):
        self.part, self.size, self.done = part, 0, 0
        self.held: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.ready: list[tuple[str, list]] = []

    def write(self, text: str) -> None:
        self.held.append(text)
        self.size += len(text)
        if self.size - self.done >= self.part:
            self.flush()

    def learn(self, begin: int, end: int) -> None:
        self.spans.append((begin, end))

    def flush(self) -> None:
        self.ready.append(("".join(self.held), self.spans))
        self.held, self.spans, self.done = [], [], self.size


def compile_template(source: str) -> Callable[[dict, Sink], None]:
    """A function that renders variables to a sink."""
    return _statements(optimise(parse(source)) or [("text", "")])


def render(source: str, **variables) -> tuple[str, list[tuple[int, int]]]:
    """The whole output and its learnt spans."""
    sink = Sink(1 << 62)
    compile_template(source)(variables, sink)
    return "".join(sink.held), sink.spans


# --- over DataFrames


def _rows(it: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    for batch in it:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield from zip(*(c.to_pylist() for c in part.columns))


def format_conversations(turns: DataFrame, template: str = CHATML, part: int = PART) -> DataFrame:
    """(conv_id, part, formatted, learnt spans as [start, end) in the whole output); parts of a conversation are
    consecutive rows of one partition.  ``turns`` has conv_id, turn, role, text; one shuffle by conv_id."""
    slim = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    compile_template(template)  # fail on the driver, not in tasks
    target = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("learnt", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        go = compile_template(template)
        out, size = [], 0
        for conv, rows in itertools.groupby(_rows(it), key=lambda r: r[0]):
            sink, n = Sink(part), 0

            def messages(rows=rows, sink=sink):
                for _, turn, role, text in rows:
                    yield {"turn": turn, "role": role, "text": text}

            go({"messages": messages()}, sink)
            for _ in rows:  # a template may leave turns unread
                pass
            sink.flush()
            for text, spans in sink.ready:
                out.append((conv, n, text, [{"start": a, "end": b} for a, b in spans]))
                n, size = n + 1, size + len(text)
            if size >= part or len(out) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id bigint, part bigint, formatted string, learnt array<struct<start:bigint,end:bigint>>")


class Reader:
    """Reads a conversation back from its output, turn by turn, with the learnt spans."""

    _turn = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

    def __init__(self):
        self.held, self.at, self.n, self.chars, self.learnt = "", 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.spans: list[tuple[int, int]] = []

    def feed(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.spans += spans
        self.held += text
        self.chars += len(text)
        end = 0
        if "<|im_end|>" not in self.held:
            return
        for m in self._turn.finditer(self.held):
            if m.start() != end:
                raise ValueError("text between turns")
            for i in (1, 2):
                self.turns.update((unguard(m[i]) + "\n").encode("utf-8", "surrogatepass"))
            self.n, end = self.n + 1, m.end()
        due = [s for s in self.spans if s[1] <= self.at + end]
        for a, b in due:
            learnt = unguard(self.held[a - self.at : b - self.at])
            self.learnt += len(learnt)
            self.loss.update(learnt.encode("utf-8", "surrogatepass"))
        self.spans = self.spans[len(due) :]
        self.held, self.at = self.held[end:], self.at + end

    def result(self) -> tuple:
        if self.held or self.spans:
            raise ValueError("an unfinished turn")
        return self.n, self.turns.hexdigest(), self.learnt, self.loss.hexdigest(), self.chars


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation from ``format_conversations``' rows, taken in their order: counts and digests."""
    target = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, reader = [], None, None
        for conv, part, text, spans in _rows(it, 32):
            if part == 0:
                if reader:
                    done.append((key, *reader.result()))
                key, reader = conv, Reader()
                if len(done) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), target)], schema=target)
                    done = []
            reader.feed(text, [(s["start"], s["end"]) for s in spans])
        if reader:
            done.append((key, *reader.result()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), target)], schema=target)

    return parts.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
