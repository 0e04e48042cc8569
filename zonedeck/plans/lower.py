"""Row-local programs as DataFrame steps.

A program whose statements only change its own items is run over a DataFrame: a row is one
run, columns named like items give their first values, and each statement is a projection
under the condition of the branches around it. Loops that depend on data, jumps, tables, files
and calls stop the lowering before a DataFrame is built; plans.machine runs those, from
the same statements.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arithmetic, moves, predicates
from .copybook import picture
from .program import SourceError

_TOKEN = re.compile(r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|\d+\.\d+|\d+(?![\w-])|[A-Za-z0-9][\w-]*|>=|<=|<>|\*\*|[-+*/=<>():]|\.(?=\s|$)")
_FIGURES = {"ZERO": "ZERO", "ZEROS": "ZERO", "ZEROES": "ZERO", "SPACE": "SPACE", "SPACES": "SPACE", "HIGH-VALUE": "HIGH-VALUE", "HIGH-VALUES": "HIGH-VALUE", "LOW-VALUE": "LOW-VALUE", "LOW-VALUES": "LOW-VALUE", "QUOTE": "QUOTE", "QUOTES": "QUOTE"}
_VERBS = frozenset(
    "MOVE ADD SUBTRACT MULTIPLY DIVIDE COMPUTE IF EVALUATE DISPLAY PERFORM SET CONTINUE STOP GOBACK EXIT GO ALTER SEARCH STRING UNSTRING INSPECT"
    " EXAMINE CALL OPEN CLOSE READ WRITE REWRITE DELETE SORT RELEASE RETURN READY RESET".split()
)
_ENDS = frozenset("ELSE WHEN ON NOT SIZE AT OVERFLOW END-IF END-EVALUATE END-COMPUTE END-ADD END-SUBTRACT END-MULTIPLY END-DIVIDE END-SEARCH END-STRING END-UNSTRING END-READ END-RETURN END-WRITE END-CALL .".split())
_MAX_TIMES = 1000


@dataclass(frozen=True)
class Item:
    name: str
    text: bool
    length: int = 0
    digits: int = 0
    scale: int = 0
    signed: bool = False
    usage: str = "display"
    value: str | None = None


@dataclass
class Program:
    items: dict[str, Item] = field(default_factory=dict)
    conditions: dict[str, tuple[str, list, list]] = field(default_factory=dict)
    paragraphs: dict[str, list] = field(default_factory=dict)
    first: str = ""


def _fail(what: str) -> SourceError:
    return SourceError("CBL-RT-UNSUPPORTED", what)


def _literal(token: str):
    """Text or number of a literal, None if the token isn't one."""
    if token[0] in "\"'":
        return token[1:-1].replace(token[0] * 2, token[0])
    return token if re.fullmatch(r"[-+]?\d+(\.\d+)?", token) else None


def divided(source: str) -> tuple[str, str, str]:
    """What comes before the PROCEDURE DIVISION, its heading, and its body."""
    parts = re.split(r"(PROCEDURE\s+DIVISION[^.]*\.)", source, maxsplit=1, flags=re.I)
    if len(parts) < 3:
        raise _fail("no PROCEDURE DIVISION")
    return parts[0], parts[1], parts[2]


def parse(source: str) -> Program:
    """The items and paragraphs of a normalized source (see program.preprocess)."""
    head, _, body = divided(source)
    out = Program()
    _items(head, out)
    out.paragraphs = procedure(body)
    return out


def procedure(body: str) -> dict[str, list]:
    """Statements by paragraph, in order; what comes before the first name is the paragraph ''. A section's name is a paragraph without its suffix."""
    out: dict[str, list] = {}
    name, tokens = "", []
    for line in body.splitlines():
        m = re.fullmatch(r"\s*([A-Za-z0-9][\w-]*)(\s+SECTION)?\s*\.\s*", line, re.I)
        if m and m[1].upper() not in _VERBS | _ENDS:
            out[name], name, tokens = _statements(tokens), m[1].upper(), []
        else:
            tokens += _TOKEN.findall(line)
    out[name] = _statements(tokens)
    return out


def _items(text: str, out: Program) -> None:
    parent = None
    for sentence in re.split(r"\.(?:\s+|$)", text):
        m = re.match(r"\s*(\d{1,2})\s+([\w-]+)(.*)", sentence, re.S)
        if not m:
            continue
        level, name, rest = int(m[1]), m[2].upper(), m[3]
        value = re.search(r"\bVALUES?\s+(?:IS\s+|ARE\s+)?(.*)", rest, re.I | re.S)
        if level == 88:
            tokens = [t for t in _TOKEN.findall(value[1]) if t != "."] if value else []
            singles, ranges, k = [], [], 0
            while k < len(tokens):
                if k + 2 < len(tokens) and tokens[k + 1].upper() in ("THRU", "THROUGH"):
                    ranges.append((_literal(tokens[k]), _literal(tokens[k + 2])))
                    k += 3
                else:
                    singles.append(_literal(tokens[k]))
                    k += 1
            out.conditions[name] = (parent, singles, ranges)
            continue
        if re.search(r"\b(REDEFINES|OCCURS)\b", rest, re.I):
            raise _fail(f"{name}: tables and redefinitions")
        pic = re.search(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", rest, re.I)
        if not pic:
            continue
        p = picture(pic[1])
        usage = "packed" if re.search(r"COMP(UTATIONAL)?-3|PACKED-DECIMAL", rest, re.I) else "binary" if re.search(r"\bCOMP|\bBINARY\b", rest, re.I) else "display"
        start = value and (_literal(value[1].split()[0]) if value[1][0] not in "\"'" else _literal(_TOKEN.findall(value[1])[0]))
        start = start if start is not None else value and _FIGURES.get(value[1].split()[0].upper())
        out.items[name] = Item(name, True, p["length"], value=start) if p["text"] else Item(name, False, 0, p["total_digits"], p["scale"], p["signed"], usage, start)
        parent = name


class _Reader:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k].upper() if self.at + k < len(self.tokens) else ""

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise _fail("the statement ends too soon")
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False


def _statements(tokens: list[str]) -> list:
    r = _Reader(tokens)
    out = []
    while r.at < len(tokens):
        if r.take("."):
            continue
        out += _block(r)
        if r.peek() and not r.take("."):
            raise _fail(f"at {r.peek()}")
    return out


def _block(r: _Reader) -> list:
    out = []
    while r.peek() in _VERBS:
        out.append(_statement(r))
    return out


def _operand(r: _Reader):
    """A token, or (name, subscripts, (start, length)) of a table's element or a part of a text."""
    token = r.next()
    if r.peek() != "(" or not re.match(r"[A-Za-z0-9]", token) or _literal(token) is not None:
        return token
    subscripts, part = [], None
    while r.take("("):
        inner = []
        while not r.take(")"):
            inner.append(_expression(r))
            if r.take(":"):
                part = (inner.pop(), None if r.peek() == ")" else _expression(r))
        subscripts += inner
    return token, tuple(subscripts), part


def _operands(r: _Reader, *stops: str) -> list:
    out = []
    while r.peek() and r.peek() not in stops and r.peek() not in _VERBS | _ENDS:
        out.append(_operand(r))
    return out


def _statement(r: _Reader):
    verb = r.next().upper()
    if verb == "MOVE":
        if r.peek() in ("CORRESPONDING", "CORR"):
            raise _fail("MOVE CORRESPONDING of groups")
        source = ("all", r.next()) if r.take("ALL") else _operand(r)
        if source in ("+", "-"):
            source += r.next()
        if not r.take("TO"):
            raise _fail("MOVE without TO")
        return "move", source, _operands(r)
    if verb in ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"):
        words = _operands(r, "GIVING")
        giving = _operands(r) if r.take("GIVING") else []
        return "arith", verb, words, giving, *_size(r, verb)
    if verb == "COMPUTE":
        targets = _operands(r, "=")
        r.next()
        return "compute", targets, _expression(r), *_size(r, verb)
    if verb == "IF":
        condition = _condition(r)
        r.take("THEN")
        then = _block(r)
        other = _block(r) if r.take("ELSE") else []
        r.take("END-IF")
        return "if", condition, then, other
    if verb == "EVALUATE":
        subjects = [_subject(r)]
        while r.take("ALSO"):
            subjects.append(_subject(r))
        whens: list = []
        while r.take("WHEN"):
            if r.take("OTHER"):
                whens.append((None, _block(r)))
                continue
            rows = [_patterns(r)]
            while r.take("WHEN"):
                rows.append(_patterns(r))
            if any(len(row) != len(subjects) for row in rows):
                raise _fail("EVALUATE: as many patterns as subjects are needed")
            whens.append((rows, _block(r)))
        r.take("END-EVALUATE")
        return "evaluate", subjects, whens
    if verb == "DISPLAY":
        return "display", _operands(r)
    if verb == "PERFORM":
        return _perform(r)
    if verb == "SET":
        names = _operands(r, "TO", "UP", "DOWN")
        if r.take("TO", "TRUE"):
            return "set", names
        if r.take("TO"):
            return "index", names, "TO", _operand(r)
        way = r.next().upper()
        if way not in ("UP", "DOWN") or not r.take("BY"):
            raise _fail("SET")
        return "index", names, way, _operand(r)
    if verb in ("STOP", "GOBACK", "EXIT"):
        if verb == "STOP" and not r.take("RUN"):
            raise _fail("STOP literal")
        if verb == "EXIT" and not r.take("PROGRAM"):
            return ("continue",)
        return "stop" if verb == "STOP" else "back",
    if verb in _OTHERS:
        return _OTHERS[verb](r)
    return ("continue",)


def _span(r: _Reader) -> tuple[str, str]:
    """The first and last paragraph of a range."""
    first = r.next().upper()
    return first, r.next().upper() if r.take("THRU") or r.take("THROUGH") else first


def _perform(r: _Reader):
    span = _span(r)
    if r.peek(1) == "TIMES":
        times = r.next()
        r.next()
        return "perform", *span, ("times", times)
    varying = None
    if r.take("VARYING"):
        item = _operand(r)
        if not r.take("FROM"):
            raise _fail("PERFORM VARYING without FROM")
        start = _operand(r)
        if not r.take("BY"):
            raise _fail("PERFORM VARYING without BY")
        step = r.next()
        varying = (item, start, step + r.next() if step in ("-", "+") else step)
    if r.take("WITH") or r.peek() == "TEST":
        if not r.take("TEST", "BEFORE"):
            raise _fail("PERFORM with another test than before")
    if r.take("UNTIL"):
        return "perform", *span, ("until", varying, _condition(r))
    if varying:
        raise _fail("PERFORM VARYING without UNTIL")
    return "perform", *span, None


def _go(r: _Reader):
    r.take("TO")
    names = [x.upper() for x in _operands(r, "DEPENDING")]
    if r.take("DEPENDING"):
        r.take("ON")
        return "depending", names, _operand(r)
    return "goto", names[0] if names else ""


def _alter(r: _Reader):
    name = r.next().upper()
    if not r.take("TO"):
        raise _fail("ALTER without TO")
    r.take("PROCEED", "TO")
    return "alter", name, r.next().upper()


def _ended(r: _Reader, verb: str, *words: str) -> tuple[list | None, list]:
    """Statements of AT END, OVERFLOW and the like (None: not given), and of their NOT."""
    bad, good = None, []
    while r.peek() in ("AT", "ON", "NOT", words[0]):
        negative = r.take("NOT")
        r.take("AT") or r.take("ON")
        if not r.take(*words):
            raise _fail(f"{verb}: at {r.peek()}")
        if negative:
            good = _block(r)
        else:
            bad = _block(r)
    r.take(f"END-{verb}")
    return bad, good


def _search(r: _Reader):
    every = r.take("ALL")
    name = r.next().upper()
    varying = r.next().upper() if r.take("VARYING") else None
    at_end = []
    if r.take("AT", "END") or r.take("END"):
        at_end = _block(r)
    whens = []
    while r.take("WHEN"):
        whens.append((_condition(r), _block(r)))
    r.take("END-SEARCH")
    return "search", every, name, varying, at_end, whens


def _string(r: _Reader):
    parts = []
    while not r.take("INTO"):
        some = _operands(r, "DELIMITED", "INTO")
        if not r.take("DELIMITED"):
            raise _fail("STRING without DELIMITED")
        r.take("BY")
        by = None if r.take("SIZE") else r.next()
        parts += [(x, by) for x in some]
    target = _operand(r)
    r.take("WITH")
    pointer = _operand(r) if r.take("POINTER") else None
    return "string", parts, target, pointer, *_ended(r, "STRING", "OVERFLOW")


def _unstring(r: _Reader):
    source = _operand(r)
    if not r.take("DELIMITED"):
        raise _fail("UNSTRING without DELIMITED")
    r.take("BY")
    every, by = r.take("ALL"), r.next()
    if not r.take("INTO"):
        raise _fail("UNSTRING without INTO")
    targets: list = []
    while r.peek() and r.peek() not in ("WITH", "POINTER", "TALLYING") and r.peek() not in _VERBS | _ENDS:
        target = _operand(r)
        count = None
        if r.take("COUNT"):
            r.take("IN")
            count = _operand(r)
        targets.append((target, count))
    r.take("WITH")
    pointer = _operand(r) if r.take("POINTER") else None
    tally = None
    if r.take("TALLYING"):
        r.take("IN")
        tally = _operand(r)
    return "unstring", source, by, every, targets, pointer, tally, *_ended(r, "UNSTRING", "OVERFLOW")


def _inspect(r: _Reader):
    item = _operand(r)
    if r.take("TALLYING"):
        count = _operand(r)
        if not r.take("FOR", "ALL"):
            raise _fail("INSPECT TALLYING other than FOR ALL")
        return "inspect", "tally", item, count, r.next()
    if r.take("REPLACING"):
        if not r.take("ALL"):
            raise _fail("INSPECT REPLACING other than ALL")
        what = r.next()
        if not r.take("BY"):
            raise _fail("INSPECT REPLACING without BY")
        return "inspect", "replace", item, what, r.next()
    if r.take("CONVERTING"):
        what = r.next()
        if not r.take("TO"):
            raise _fail("INSPECT CONVERTING without TO")
        return "inspect", "convert", item, what, r.next()
    raise _fail("INSPECT")


def _examine(r: _Reader):
    item = _operand(r)
    tally = r.take("TALLYING")
    if not tally and not r.take("REPLACING"):
        raise _fail("EXAMINE")
    if not r.take("ALL"):
        raise _fail("EXAMINE other than ALL")
    what = r.next()
    by = None
    if (r.take("REPLACING", "BY") if tally else r.take("BY")):
        by = r.next()
    return "examine", item, tally, what, by


def _call(r: _Reader):
    name = r.next()
    using = _operands(r) if r.take("USING") else []
    r.take("END-CALL")
    return "call", name, using


def _open(r: _Reader):
    files = []
    while r.peek() in ("INPUT", "OUTPUT", "I-O", "EXTEND"):
        mode = r.next().upper()
        files += [(mode, f.upper()) for f in _operands(r, "INPUT", "OUTPUT", "I-O", "EXTEND")]
    return "open", files


def _read(r: _Reader):
    name = r.next().upper()
    r.take("RECORD")
    into = _operand(r) if r.take("INTO") else None
    return "read", name, into, *_ended(r, "READ", "END")


def _return(r: _Reader):
    name = r.next().upper()
    r.take("RECORD")
    into = _operand(r) if r.take("INTO") else None
    return "return", name, into, *_ended(r, "RETURN", "END")


def _write(r: _Reader):
    name = r.next().upper()
    source = _operand(r) if r.take("FROM") else None
    advancing = None
    if r.peek() in ("AFTER", "BEFORE"):
        when = r.next().upper()
        r.take("ADVANCING")
        advancing = (when, "PAGE" if r.take("PAGE") else _operand(r))
        r.take("LINES") or r.take("LINE")
    r.take("END-WRITE")
    return "write", name, source, advancing


def _sort(r: _Reader):
    name = r.next().upper()
    r.take("ON")
    descending = r.take("DESCENDING")
    if not descending and not r.take("ASCENDING"):
        raise _fail("SORT without a key")
    r.take("KEY")
    key = r.next().upper()
    spans = []
    for way in ("INPUT", "OUTPUT"):
        if not r.take(way, "PROCEDURE"):
            raise _fail("SORT other than by INPUT and OUTPUT PROCEDURE, or several keys")
        r.take("IS")
        spans.append(_span(r))
    return "sort", name, key, descending, *spans


def _from(kind: str):
    def parsed(r: _Reader):
        name = r.next().upper()
        return kind, name, _operand(r) if r.take("FROM") else None

    return parsed


def _trace(on: bool):
    def parsed(r: _Reader):
        r.take("TRACE")
        return "trace", on

    return parsed


def _delete(r: _Reader):
    name = r.next().upper()
    r.take("RECORD")
    return "delete", name


_OTHERS = {
    "GO": _go, "ALTER": _alter, "SEARCH": _search, "STRING": _string, "UNSTRING": _unstring, "INSPECT": _inspect, "EXAMINE": _examine, "CALL": _call,
    "OPEN": _open, "CLOSE": lambda r: ("close", [x.upper() for x in _operands(r)]), "READ": _read, "WRITE": _write, "REWRITE": _from("rewrite"), "DELETE": _delete,
    "SORT": _sort, "RELEASE": _from("release"), "RETURN": _return, "READY": _trace(True), "RESET": _trace(False),
}


def _size(r: _Reader, verb: str) -> tuple[list | None, list]:
    """Statements ON SIZE ERROR (None: not given) and NOT ON SIZE ERROR."""
    bad, good = None, []
    while r.peek() in ("ON", "SIZE", "NOT"):
        negative = r.take("NOT")
        r.take("ON")
        if not r.take("SIZE", "ERROR"):
            raise _fail(f"{verb}: at {r.peek()}")
        if negative:
            good = _block(r)
        else:
            bad = _block(r)
    r.take(f"END-{verb}")
    return bad, good


def _subject(r: _Reader):
    return ("true",) if r.take("TRUE") else _operand(r)


def _patterns(r: _Reader) -> list:
    out = [_pattern(r)]
    while r.take("ALSO"):
        out.append(_pattern(r))
    return out


def _pattern(r: _Reader):
    if r.take("ANY"):
        return ("any",)
    if r.peek(1) in ("THRU", "THROUGH"):
        low = r.next()
        r.next()
        return "range", low, r.next()
    if r.peek(1) in ("=", "<", ">", ">=", "<=", "<>", "IS", "NOT", "EQUAL", "GREATER", "LESS") or r.peek() in ("NOT", "("):
        return "condition", _condition(r)
    return "value", r.next()


def _expression(r: _Reader):
    left = _term(r)
    while r.peek() in ("+", "-"):
        left = ("op", r.next(), left, _term(r))
    return left


def _term(r: _Reader):
    left = _factor(r)
    while r.peek() in ("*", "/"):
        left = ("op", r.next(), left, _factor(r))
    if r.peek() == "**":
        raise _fail("exponentiation")
    return left


def _factor(r: _Reader):
    if r.take("("):
        inner = _expression(r)
        if not r.take(")"):
            raise _fail("missing )")
        return inner
    if r.take("-"):
        return "op", "-", ("leaf", "0"), _factor(r)
    return "leaf", _operand(r)


def _condition(r: _Reader):
    left = _conjunction(r)
    while r.take("OR"):
        left = ("or", left, _conjunction(r))
    return left


def _conjunction(r: _Reader):
    left = _simple(r)
    while r.take("AND"):
        left = ("and", left, _simple(r))
    return left


def _simple(r: _Reader):
    if r.take("NOT"):
        return "not", _simple(r)
    if r.peek() == "(":
        mark = r.at
        r.next()
        try:
            inner = _condition(r)
            if r.take(")"):
                return inner
        except SourceError:
            pass
        r.at = mark
    left = _expression(r)
    r.take("IS")
    negative = r.take("NOT")
    out = None
    for words, op in ((("GREATER", "THAN", "OR", "EQUAL", "TO"), ">="), (("LESS", "THAN", "OR", "EQUAL", "TO"), "<="), (("GREATER", "THAN"), ">"), (("LESS", "THAN"), "<"), (("EQUAL", "TO"), "="), (("GREATER",), ">"), (("LESS",), "<"), (("EQUAL",), "="), *(((o,), o) for o in ("=", ">", "<", ">=", "<=", "<>"))):
        if r.take(*words):
            out = ("relation", left, op, _expression(r))
            break
    if out is None:
        for word in ("NUMERIC", "ALPHABETIC", "ALPHABETIC-UPPER", "ALPHABETIC-LOWER", "POSITIVE", "NEGATIVE"):
            if r.take(word):
                out = ("class", left, word)
                break
    if out is None:
        out = ("class", left, "ZERO") if r.peek() in ("ZERO", "ZEROS") and r.next() else ("name", left)
    return ("not", out) if negative else out


class Lowered:
    """A program over the rows of a DataFrame."""

    def __init__(self, program: Program):
        self.p, self.n = program, 0

    def run(self, rows: DataFrame) -> DataFrame:
        """rows with the items' last values and `display`, the lines shown."""
        given = {c.upper(): c for c in rows.columns}
        first = {}
        for item in self.p.items.values():
            start = F.col(given[item.name]) if item.name in given else self._start(item)
            first[item.name] = start.cast("string") if item.text else start.cast(self._kind(item))
            if item.text:
                first[item.name] = F.rpad(F.coalesce(first[item.name], F.lit("")), item.length, " ")
        keep = [c for c in rows.columns if c.upper() not in self.p.items]
        self.df = rows.select(*keep, *[c.alias(n) for n, c in first.items()], F.array().cast("array<string>").alias("display"), F.lit(True).alias("_going"))
        for name in self.p.paragraphs:  # control falls from one paragraph into the next
            self._block(self.p.paragraphs[name], F.lit(True), (name,))
        return self.df.select(*keep, *self.p.items, "display")

    @staticmethod
    def _kind(item: Item) -> str:
        return f"decimal({item.digits},{item.scale})"

    def _start(self, item: Item) -> Column:
        if item.text:
            return moves.move_figurative(item.value, item.length) if item.value in _FIGURES.values() else F.lit(item.value or "")
        return F.lit("0" if item.value is None or item.value in _FIGURES.values() else item.value)

    def _guard(self, guard: Column) -> Column:
        """The guard as a column of its own: it is judged once, before what it guards."""
        self.n += 1
        name = f"_g{self.n}"
        self.df = self.df.withColumn(name, F.col("_going") & F.coalesce(guard, F.lit(False)))
        return F.col(name)

    def _item(self, name: str) -> Item:
        if isinstance(name, tuple):
            raise _fail(f"{name[0]}: tables and parts of texts")
        if name.upper() not in self.p.items:
            raise SourceError("CBL-RT-REFERENCE", name)
        return self.p.items[name.upper()]

    def _value(self, token: str) -> tuple[Column, bool, Item | None]:
        """(value, whether it is text, its item)."""
        if isinstance(token, tuple):
            raise _fail(f"{token[0]}: tables and parts of texts")
        literal = _literal(token)
        if literal is not None:
            if token[0] in "\"'":
                return F.lit(literal), True, None
            whole, _, part = literal.partition(".")
            return F.lit(literal).cast(f"decimal({max(len(whole) + len(part), 1)},{len(part)})"), False, None
        if token.upper() in _FIGURES:
            return (F.lit(0).cast("decimal(1,0)"), False, None) if _FIGURES[token.upper()] == "ZERO" else (F.lit(moves.FIGURATIVE[_FIGURES[token.upper()]]), True, None)
        item = self._item(token)
        return F.col(item.name), item.text, item

    def _number(self, tree) -> Column:
        if tree[0] == "leaf":
            value, text, _ = self._value(tree[1])
            if text:
                raise SourceError("CBL-RT-UNSUPPORTED-OPERAND", tree[1])
            return value
        _, op, a, b = tree
        x, y = self._number(a), self._number(b)
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: arithmetic.divide(x, y)}[op]()

    def _true(self, c) -> Column:
        kind = c[0]
        if kind in ("and", "or"):
            a, b = self._true(c[1]), self._true(c[2])
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~self._true(c[1])
        if kind == "name":
            name = c[1][1].upper() if c[1][0] == "leaf" else ""
            if name not in self.p.conditions:
                raise SourceError("CBL-RT-CONDITION", name)
            parent, singles, ranges = self.p.conditions[name]
            item = self._item(parent)
            shaped = lambda v: F.rpad(F.lit(v), item.length, " ") if item.text else F.lit(v).cast("decimal(38,18)")
            value = F.col(item.name) if item.text else F.col(item.name).cast("decimal(38,18)")
            hits = [value == shaped(v) for v in singles] + [value.between(shaped(a), shaped(b)) for a, b in ranges]
            return reduce(lambda a, b: a | b, hits, F.lit(False))
        if kind == "class":
            _, tree, word = c
            if word in ("POSITIVE", "NEGATIVE", "ZERO"):
                return predicates.sign_test(self._number(tree), word.lower())
            value, text, _ = self._value(tree[1])
            if word == "NUMERIC":
                return predicates.is_numeric(value) if text else F.lit(True)
            return predicates.is_alphabetic(value, {"ALPHABETIC": None, "ALPHABETIC-UPPER": "upper", "ALPHABETIC-LOWER": "lower"}[word])
        _, left, op, right = c
        texts = [t[0] == "leaf" and self._value(t[1])[1] for t in (left, right)]
        if texts[0] != texts[1]:
            raise SourceError("CBL-RT-UNSUPPORTED-COMPARISON", f"{left} {op} {right}")
        if texts[0]:
            return predicates.compare(self._value(left[1])[0], op, self._value(right[1])[0], text=True)
        return predicates.compare(self._number(left), op, self._number(right))

    def _put(self, item: Item, value: Column, guard: Column) -> None:
        self.df = self.df.withColumn(item.name, F.when(guard, value).otherwise(F.col(item.name)))

    def _moved(self, source, item: Item) -> Column:
        if isinstance(source, tuple) and len(source) == 3:
            raise _fail(f"{source[0]}: tables and parts of texts")
        if isinstance(source, tuple):
            text = _literal(source[1]) or ""
            return F.rpad(F.lit(text * (item.length // max(len(text), 1) + 1)), item.length, " ")
        if source.upper() in _FIGURES:
            return moves.move_figurative(_FIGURES[source.upper()], item.length) if item.text else F.lit(0).cast(self._kind(item))
        value, text, from_item = self._value(source)
        if item.text:
            if not text:
                digits = from_item.digits if from_item else len(source.replace(".", ""))
                value = F.lpad(F.regexp_replace(F.abs(value).cast("string"), r"\.", ""), digits, "0")
            return moves.move_text(value, item.length)
        if text:
            value = F.coalesce(F.trim(value).try_cast("decimal(38,18)"), F.raise_error(F.lit("CBL-RT-DECIMAL: not a number")).cast("decimal(38,18)"))
        return self._stored(value, item)

    def _stored(self, value: Column, item: Item, rounded: bool = False) -> Column:
        """The value in the item's shape: DISPLAY cuts high-order digits, packed and binary items raise; lost fraction digits raise."""
        wide = F.round(value, item.scale) if rounded else value
        fits = arithmetic.fitted(wide, item.digits, item.scale, signed=item.signed or item.usage == "display")
        if item.usage == "display":
            exact = F.round(wide.cast("decimal(38,18)"), item.scale) == wide.cast("decimal(38,18)")
            room = F.lit("1" + "0" * (item.digits - item.scale)).cast("decimal(20,0)")
            cut = (wide.cast("decimal(38,18)") % room).cast(self._kind(item))
            fits = F.when(exact, cut)
        fits = F.coalesce(fits, F.raise_error(F.lit(f"CBL-RT-DECIMAL: {item.name}")).cast(self._kind(item)))
        return fits if item.signed else F.abs(fits).cast(self._kind(item))

    def _assign(self, targets: list[tuple[Item, bool]], value, guard: Column, bad: list | None, good: list, keeps: bool, path: tuple) -> None:
        """Each target := value(target); with ON SIZE ERROR, or in COMPUTE (keeps), a target that doesn't fit stays."""
        failed = F.lit(False)
        for item, rounded in targets:
            new = arithmetic.fitted(value(item), item.digits, item.scale, rounded, item.signed)
            if bad is None and not keeps:
                self._put(item, self._stored(value(item), item, rounded), guard)
                continue
            ok = self._guard(guard & new.isNotNull())
            failed = failed | (guard & ~ok)
            self._put(item, F.coalesce(new, F.col(item.name)), ok)
        if bad or good:
            error = self._guard(failed)
            self._block(bad or [], error, path)
            self._block(good, self._guard(guard & ~error), path)

    def _targets(self, words: list[str]) -> list[tuple[Item, bool]]:
        out: list[tuple[Item, bool]] = []
        for w in words:
            if w.upper() == "ROUNDED":
                out[-1] = (out[-1][0], True)
            else:
                item = self._item(w)
                if item.text:
                    raise SourceError("CBL-RT-UNSUPPORTED-OPERAND", w)
                out.append((item, False))
        return out

    def _block(self, statements: list, guard: Column, path: tuple) -> None:
        for s in statements:
            self._one(s, self._guard(guard), path)

    def _one(self, s: tuple, guard: Column, path: tuple) -> None:
        kind = s[0]
        if kind == "move":
            for name in s[2]:
                item = self._item(name)
                self._put(item, self._moved(s[1], item), guard)
        elif kind == "compute":
            tree = self._number(s[2])
            self._assign(self._targets(s[1]), lambda _: tree, guard, s[3], s[4], True, path)
        elif kind == "arith":
            self._arith(s, guard, path)
        elif kind == "if":
            yes = self._guard(guard & self._true(s[1]))
            no = self._guard(guard & ~yes)
            self._block(s[2], yes, path)
            self._block(s[3], no, path)
        elif kind == "evaluate":
            hits, open_ = [], guard
            for rows, _ in s[2]:
                hit = self._guard(open_ & (F.lit(True) if rows is None else reduce(lambda a, b: a | b, [self._matches(s[1], row) for row in rows])))
                open_ = self._guard(open_ & ~hit)
                hits.append(hit)
            for hit, (_, block) in zip(hits, s[2]):
                self._block(block, hit, path)
        elif kind == "display":
            line = F.concat(*[self._shown(t) for t in s[1]])
            self.df = self.df.withColumn("display", F.when(guard, F.concat("display", F.array(line))).otherwise(F.col("display")))
        elif kind == "perform":
            names = list(self.p.paragraphs)
            for name in s[1:3]:
                if name not in self.p.paragraphs:
                    raise SourceError("CBL-RT-PROCEDURE", name)
            span = names[names.index(s[1]) : names.index(s[2]) + 1]
            if set(span) & set(path):
                raise _fail(f"PERFORM {s[1]} of itself")
            times = 1
            if s[3]:
                times = _literal(s[3][1]) if s[3][0] == "times" and isinstance(s[3][1], str) else None
                if times is None or not times.isdigit() or not 0 < int(times) <= _MAX_TIMES:
                    raise _fail(f"PERFORM {s[1]} with a loop that data decide")
            for _ in range(int(times)):
                for name in span:
                    self._block(self.p.paragraphs[name], guard, (*path, *span))
        elif kind == "set":
            for name in s[1]:
                if name.upper() not in self.p.conditions:
                    raise SourceError("CBL-RT-CONDITION", name)
                parent, singles, ranges = self.p.conditions[name.upper()]
                item, value = self._item(parent), predicates.first_value(singles, ranges)
                self._put(item, F.rpad(F.lit(value), item.length, " ") if item.text else F.lit(value).cast(self._kind(item)), guard)
        elif kind in ("stop", "back"):
            self.df = self.df.withColumn("_going", F.col("_going") & ~guard)
        elif kind != "continue":
            raise _fail(f"{kind} isn't a projection of a row")

    def _matches(self, subjects: list, row: list) -> Column:
        out = F.lit(True)
        for subject, p in zip(subjects, row):
            if p[0] == "any":
                continue
            if p[0] == "condition":
                out = out & self._true(p[1])
            elif subject == ("true",):
                out = out & self._true(("name", ("leaf", p[1])))
            elif p[0] == "range":
                out = out & self._true(("relation", ("leaf", subject), ">=", ("leaf", p[1]))) & self._true(("relation", ("leaf", subject), "<=", ("leaf", p[2])))
            else:
                out = out & self._true(("relation", ("leaf", subject), "=", ("leaf", p[1])))
        return out

    def _arith(self, s: tuple, guard: Column, path: tuple) -> None:
        _, verb, words, giving, bad, good = s
        link = {"ADD": "TO", "SUBTRACT": "FROM", "MULTIPLY": "BY", "DIVIDE": "INTO"}[verb]
        upper = [w.upper() for w in words]
        by = verb == "DIVIDE" and "BY" in upper
        cut = upper.index("BY" if by else link) if (by or link in upper) else len(words)
        sources, rest = words[:cut], words[cut + 1 :]
        values = [self._value(w)[0] for w in sources]
        total = reduce(lambda a, b: a + b, values)
        if giving:
            last = [self._value(w)[0] for w in rest]
            value = {
                "ADD": lambda: reduce(lambda a, b: a + b, [*values, *last]), "SUBTRACT": lambda: last[0] - total, "MULTIPLY": lambda: total * last[0],
                "DIVIDE": lambda: arithmetic.divide(total, last[0]) if by else arithmetic.divide(last[0], total),
            }[verb]()
            self._assign(self._targets(giving), lambda _: value, guard, bad, good, False, path)
            return
        if by:
            raise _fail("DIVIDE BY without GIVING")
        op = {"ADD": lambda x: x + total, "SUBTRACT": lambda x: x - total, "MULTIPLY": lambda x: x * total, "DIVIDE": lambda x: arithmetic.divide(x, total)}[verb]
        self._assign(self._targets(rest), lambda item: op(F.col(item.name)), guard, bad, good, False, path)

    def _shown(self, token: str) -> Column:
        value, text, item = self._value(token)
        if text or item is None:
            return value.cast("string")
        plain = F.lpad(F.regexp_replace(F.abs(value).cast("string"), r"\.", ""), item.digits, "0")
        return F.concat(F.when(value < 0, "-").otherwise(""), plain) if item.signed else plain


def run(source: str, rows: DataFrame) -> DataFrame:
    """The program over the rows."""
    return Lowered(parse(source)).run(rows)
