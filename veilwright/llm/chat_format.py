"""Chat formatting by a template compiler.

A template of a small sandboxed language is parsed into a syntax tree, constants are folded, and
what is left becomes Python closures. Rendering gives segments of text, each marked as inside or
outside of a generation block, so that the loss mask is known by its exact places.

    {{ expression }}                                       output
    {% for x in expression %} ... {% endfor %}             loop.index0, loop.first, loop.last
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}               counts for the loss
    {# comment #}

Expressions have strings, whole numbers, true, false, none, names, `a.b` and `a['b']` on mappings
and lists, + ~ - * % , comparisons, `in`, and, or, not, `x if c else y`, and the filters trim, lower, upper,
length, escape (control strings in a text) and label (the same for a role). There are no calls,
no imports and no attributes of Python objects; loops run over given lists alone.

Rows of a conversation are ordered by turn, then role and text; null roles and texts are empty.
Repeated rows are turns of their own. A null conversation id is a conversation. An empty table
gives no conversations.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.llm._common import map_rows, table

OPEN, CLOSE = "### ", "</turn>"
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '### ' ~ (m.role | label) ~ ': ' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '</turn>' ~ '\\n' }}"
    "{% endfor %}"
)


def escape(text: str) -> str:
    """No control string is left in the result; unescape() restores the text."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    if "##" in text:
        text = re.sub("#(?=##)", r"#\\", text)
    return text.replace(CLOSE, "<\\/turn>") if CLOSE in text else text


def label(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


class TemplateError(ValueError):
    pass


# --- tokens ---------------------------------------------------------------------------------

_SPLIT = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~*%|.()\[\]<>,]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


def _tokens(code: str) -> list[tuple[str, object]]:
    found, at, code = [], 0, code.strip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"cannot read {code[at : at + 20]!r}")
        number, text, name, sign = m.groups()
        if number:
            found.append(("const", int(number)))
        elif text:
            found.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[0]), text[1:-1], flags=re.S)))
        elif name:
            found.append(("name", name))
        else:
            found.append(("sign", sign))
        at = m.end()
    return found


# --- syntax tree ----------------------------------------------------------------------------

def _fails_as_template(name: str, f):
    """f, with an error of its arguments' kinds as one of the template."""

    def checked(*values):
        try:
            return f(*values)
        except (TypeError, AttributeError, ZeroDivisionError) as e:
            raise TemplateError(f"{name}: {e}") from None

    return checked


FILTERS = {"trim": str.strip, "lower": str.lower, "upper": str.upper, "length": len, "escape": escape, "label": label}
_BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: _times(a, b), "%": lambda a, b: _modulo(a, b), "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}
FILTERS = {name: _fails_as_template(name, f) for name, f in FILTERS.items()}
_BINARY = {name: _fails_as_template(name, f) for name, f in _BINARY.items()}
_LEVELS = [["==", "!=", "<", ">", "<=", ">=", "in"], ["+", "-", "~"], ["*", "%"]]


def _times(a, b):
    if not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("* is for numbers")
    return a * b


def _modulo(a, b):
    if not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("% is for numbers")
    return a % b


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


class _Expression:
    def __init__(self, code: str):
        self.t, self.i = _tokens(code), 0

    def peek(self, value=None):
        here = self.t[self.i] if self.i < len(self.t) else (None, None)
        return here if value is None else here[1] == value and here[0] != "const"

    def take(self, value):
        if not self.peek(value):
            raise TemplateError(f"{value!r} expected, {self.peek()[1]!r} found")
        self.i += 1

    def whole(self):
        node = self.choice()
        if self.i < len(self.t):
            raise TemplateError(f"{self.peek()[1]!r} not expected")
        return node

    def choice(self):
        node = self.either()
        if self.peek("if"):
            self.i += 1
            test = self.either()
            self.take("else")
            node = ("if", test, node, self.choice())
        return node

    def either(self):
        node = self.all()
        while self.peek("or"):
            self.i += 1
            node = ("or", node, self.all())
        return node

    def all(self):
        node = self.negated()
        while self.peek("and"):
            self.i += 1
            node = ("and", node, self.negated())
        return node

    def negated(self):
        if self.peek("not"):
            self.i += 1
            return ("not", self.negated())
        return self.level(0)

    def level(self, k):
        if k == len(_LEVELS):
            return self.filtered()
        node = self.level(k + 1)
        while self.peek()[0] != "const" and self.peek()[1] in _LEVELS[k]:
            sign = self.peek()[1]
            self.i += 1
            node = ("binary", sign, node, self.level(k + 1))
        return node

    def filtered(self):
        node = self.item()
        while self.peek("|"):
            self.i += 1
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.i += 1
            node = ("filter", name, node)
        return node

    def item(self):
        node = self.atom()
        while True:
            if self.peek("."):
                self.i += 1
                kind, name = self.peek()
                if kind != "name":
                    raise TemplateError("a name expected after .")
                self.i += 1
                node = ("item", node, ("const", name))
            elif self.peek("["):
                self.i += 1
                key = self.choice()
                self.take("]")
                node = ("item", node, key)
            else:
                return node

    def atom(self):
        kind, value = self.peek()
        self.i += 1
        if kind == "const":
            return ("const", value)
        if kind == "name":
            return ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
        if value == "(":
            node = self.choice()
            self.take(")")
            return node
        if value == "-":
            return ("binary", "-", ("const", 0), self.item())
        raise TemplateError(f"{value!r} not expected")


def parse(template: str) -> tuple:
    """The syntax tree of a template: ("block", nodes)."""
    parts = [p for p in _SPLIT.split(template) if p and not p.startswith("{#")]
    at = 0

    def block(*ends: str):
        nonlocal at
        nodes = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(("out", _Expression(part[2:-2]).whole()))
                continue
            if not part.startswith("{%"):
                nodes.append(("out", ("const", part)))
                continue
            word, _, rest = part[2:-2].strip().partition(" ")
            if word in ends:
                return ("block", nodes), word, rest
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"cannot read for {rest!r}")
                nodes.append(("for", m[1], _Expression(m[2]).whole(), block("endfor")[0]))
            elif word == "if":
                cases, test, other = [], rest, ("block", [])
                while True:
                    body, end, more = block("elif", "else", "endif")
                    cases.append((_Expression(test).whole(), body))
                    if end == "elif":
                        test = more
                        continue
                    if end == "else":
                        other = block("endif")[0]
                    break
                for test, body in reversed(cases):
                    other = ("case", test, body, other)
                nodes.append(other)
            elif word == "set":
                name, _, value = rest.partition("=")
                if not name.strip().isidentifier():
                    raise TemplateError(f"cannot read set {rest!r}")
                nodes.append(("set", name.strip(), _Expression(value).whole()))
            elif word == "generation":
                nodes.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown statement {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", nodes), "", ""

    return block()[0]


def fold(node: tuple) -> tuple:
    """The tree with constant parts computed, dead branches gone, and neighbouring output joined."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "block":
        nodes: list[tuple] = []
        folded = [fold(x) for x in node[1]]
        for x in (y for x in folded for y in (x[1] if x[0] == "block" else [x])):
            if x[0] == "out" and x[1][0] == "const" and nodes and nodes[-1][0] == "out" and nodes[-1][1][0] == "const":
                nodes[-1] = ("out", ("const", _text(nodes[-1][1][1]) + _text(x[1][1])))
            else:
                nodes.append(x)
        return ("block", nodes)
    parts = [fold(x) if isinstance(x, tuple) else x for x in node[1:]]
    consts = [x[1] for x in parts if isinstance(x, tuple) and x[0] == "const"]
    if kind == "case" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind == "if" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if kind == "not" and consts:
        return ("const", not consts[0])
    if kind == "binary" and len(consts) == 2:
        return ("const", _BINARY[parts[0]](*consts))
    if kind == "filter" and consts:
        return ("const", FILTERS[parts[0]](consts[0]))
    return (kind, *parts)


# --- closures -------------------------------------------------------------------------------


def _item(value, key):
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    raise TemplateError(f"no item {key!r}")


def _value(node: tuple):
    """A closure from the names' values to the expression's value."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda names: value
    if kind == "name":
        name = node[1]
        return lambda names: names.get(name)
    if kind == "item":
        a, b = _value(node[1]), _value(node[2])
        return lambda names: _item(a(names), b(names))
    if kind == "binary":
        f, a, b = _BINARY[node[1]], _value(node[2]), _value(node[3])
        return lambda names: f(a(names), b(names))
    if kind == "filter":
        f, a = FILTERS[node[1]], _value(node[2])
        return lambda names: f(a(names))
    if kind == "not":
        a = _value(node[1])
        return lambda names: not a(names)
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    c = _value(node[3])
    return lambda names: b(names) if a(names) else c(names)


def _writer(node: tuple, marked: bool = False):
    """A closure from names and a list to which it adds (text, marked) segments."""
    kind = node[0]
    if kind == "block":
        writers = [_writer(x, marked) for x in node[1]]
        if len(writers) == 1:
            return writers[0]

        def block(names, out):
            for w in writers:
                w(names, out)

        return block
    if kind == "out":
        value = _value(node[1])
        return lambda names, out: out.append((_text(value(names)), marked))
    if kind == "generation":
        return _writer(node[1], True)
    if kind == "set":
        name, value = node[1], _value(node[2])
        return lambda names, out: names.__setitem__(name, value(names))
    if kind == "case":
        test, then, other = _value(node[1]), _writer(node[2], marked), _writer(node[3], marked)
        return lambda names, out: (then if test(names) else other)(names, out)
    name, items, body = node[1], _value(node[2]), _writer(node[3], marked)

    def loop(names, out):
        rows = items(names) or []
        if not isinstance(rows, (list, tuple)):
            raise TemplateError("for is for lists")
        inner = dict(names)
        for i, x in enumerate(rows):
            inner[name] = x
            inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(rows) - 1}
            body(inner, out)

    return loop


class Template:
    """A compiled template; render(names) gives the text and the marked places (from, to)."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._write = _writer(self.tree)

    def render(self, **names) -> tuple[str, list[tuple[int, int]]]:
        out: list[tuple[str, bool]] = []
        self._write(names, out)
        spans, at = [], 0
        for text, marked in out:
            if marked:
                spans.append((at, at + len(text)))
            at += len(text)
        return "".join(x for x, _ in out), spans


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of what the standard template wrote."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not in the format of the template")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted and loss_spans (code point places from, to) for each conversation."""
    rows = turns.select(F.col(conv_id).alias("_c"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_m"))
    whole = rows.groupBy("_c").agg(F.sort_array(F.collect_list("_m")).alias("messages"))
    Template(template)  # a fault shows here, not in a task

    def make():
        compiled = Template(template)

        def f(messages):
            out, spans = compiled.render(messages=messages)
            return out, [{"from": a, "to": b} for a, b in spans]

        return f

    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    made = map_rows(whole, ["messages"], pa.schema([("formatted", pa.string()), ("loss_spans", span)]), "formatted string, loss_spans array<struct<from:bigint,to:bigint>>", make, drop=("messages",))
    return made.withColumnRenamed("_c", conv_id)


#: The conversation that every run formats besides the table's, with control strings in its texts.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    made = format_conversations(turns.unionByName(probe))

    def make():
        def f(formatted, spans):
            turns = read_back(formatted)
            loss = "".join(unescape(formatted[s["from"] : s["to"]]) for s in spans)
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            return len(turns), sha256(whole.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(formatted)

        return f

    added = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return map_rows(made, ["formatted", "loss_spans"], added, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", make, drop=("formatted", "loss_spans"))


_LENGTH = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7"
SQL = {
    "op10_chat_format": f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE_TEXT}'), ({PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(14 + {_LENGTH.format("text")} + {_LENGTH.format("role")} + length(role) - length(replace(role, ':', ''))) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id"""
}
QUERIES = {"op10_chat_format": op10_chat_format}
