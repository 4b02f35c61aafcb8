"""The few per-row parsers that no built-in expression covers, as Arrow-batched
functions. Native short cuts come first where there are any."""

from __future__ import annotations

import ast
import re
from html import escape, unescape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ------------------------------------------------------------------ longest common subsequence


def places(items) -> dict:
    """Item -> the places it stands at, as bits."""
    where: dict = {}
    size = len(items) // 8 + 1
    for k, x in enumerate(items):
        if x not in where:
            where[x] = bytearray(size)
        where[x][k >> 3] |= 1 << (k & 7)
    return {x: int.from_bytes(bits, "little") for x, bits in where.items()}


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel: one big-integer step per character of the shorter text."""
    if len(a) < len(b):
        a, b = b, a
    where = places(a)
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def edit_distance(a, b) -> int:
    """Levenshtein distance of two texts or lists, bit-parallel: a few big-integer steps
    per item of the shorter one; the differences down the last column add up to it. Common ends are taken off first."""
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a  # a step per item of the shorter one
    where, full = places(a), (1 << len(a)) - 1
    up, down = full, 0
    for x in b:
        same = where.get(x, 0)
        v = same | down
        h = (((same & up) + up) ^ up) | same
        more = (down | (~(h | up) & full)) << 1 | 1
        up = ((up & h) << 1 | ~(v | more)) & full
        down = more & v
    return len(b) + up.bit_count() - down.bit_count()


@F.pandas_udf(T.LongType())
def edit_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of whole texts, or of arrays of words."""
    one = lambda x: x if isinstance(x, str) else list(x)
    return pd.Series([None if x is None or y is None else edit_distance(one(x), one(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(T.DoubleType())
def indel_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 1.0 if not x and not y else 2.0 * lcs_length(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def indel_similarity(a, b):
    """2 * LCS / total length; equal texts and empty ones reach Python as nulls (a condition around a pandas
    function does not keep rows from it)."""
    asked = (a != b) & (a != "") & (b != "")
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(indel_udf(F.when(asked, a), F.when(asked, b)))


def error_rate(reference, given, length):
    """Character or word error rate (of texts, or of arrays of words): edits over the
    reference's length; an empty reference counts 0 where both are equal, else 1."""
    return F.when(length == 0, F.when(reference == given, 0.0).otherwise(1.0)).otherwise(F.when(reference == given, 0).otherwise(edit_distance_udf(F.when(reference != given, reference), given)) / length)


# ------------------------------------------------------------------ tables

#: Tags that make up a table's structure, and tags that never close.
STRUCTURAL = {"table", "thead", "tbody", "tfoot", "tr", "td", "th"}
CHILDLESS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CELLS = {"td", "th"}
_TOKEN = re.compile(
    r"""<!--(?P<note>.*?)-->|</\s*(?P<close>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<open>[a-zA-Z][^\s/>]*)(?P<given>(?:[^>"']|"[^"]*"|'[^']*')*)>|(?P<odd><[!?/])|(?P<words>[^<]+|<)""",
    re.DOTALL,
)
_GIVEN = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


def table_tokens(text: str):
    """(kind, name, attributes) in order: open, close, words (the name holds them), bad."""
    for m in _TOKEN.finditer(text):
        if m["open"] is not None:
            name, given = m["open"].lower(), m["given"]
            attributes = {}
            for key, *values in _GIVEN.findall(given):
                attributes[key.lower()] = " ".join(unescape("".join(values)).split())
            yield "open", name, attributes
            if given.endswith("/") and name not in CHILDLESS:
                yield "close", name, {}
        elif m["close"] is not None:
            yield "close", m["close"].lower(), {}
        elif m["words"] is not None:
            if words := " ".join(unescape(m["words"]).split()):
                yield "words", words, {}
        elif m["odd"] or m["note"].strip():
            yield "bad", "", {}


def span_of(attributes: dict, side: str) -> int | None:
    """1 where a span is not given, None where it is no positive integer."""
    given = attributes.get(side, "1").strip()
    return int(given) if re.fullmatch(r"\+?[0-9]{1,18}", given) and int(given) else None


def shape(rows: list[list[tuple[int, int]]]) -> tuple[int, int]:
    """Height and width of rows of (rowspan, colspan) cells laid out on a grid; a span
    past the last row adds rows. Spans are kept as runs of columns with the row where
    they end, so their size costs nothing."""
    high, wide, busy = len(rows), 0, []
    for r, row in enumerate(rows):
        busy = sorted(b for b in busy if b[2] > r)
        at = 0
        for down, across in row:
            for start, stop, _ in sorted(busy):
                if start < at + across and stop > at:
                    at = stop
            busy.append((at, at + across, r + down))
            at += across
            high, wide = max(high, r + down), max(wide, at)
    return high, wide


NO_TABLE = (False, [], [], [], 0, 0, 0, False)


def table_facts(text: str | None) -> tuple:
    """What a text says that is one complete table and nothing else (else NO_TABLE):
    canonical tokens with sorted attributes, structure tokens with spans, words cell by
    cell, and the laid-out size. Rows are not nested, cells stand in rows, tables hold no
    tables, and every tag closes in order."""
    inside: list[str] = []
    canonical_tokens, structure, rows, cells = [], [], [], []
    for k, (kind, name, attributes) in enumerate(table_tokens(text or "")):
        if kind == "bad" or (k and not inside) or (not k and (kind, name) != ("open", "table")):
            return NO_TABLE
        if kind == "words":
            canonical_tokens.append(escape(name, quote=False))
            if CELLS & set(inside):
                cells[-1][2].extend(name.split())
        elif kind == "open":
            canonical_tokens.append(f"<{name}" + "".join(f' {a}="{escape(v)}"' for a, v in sorted(attributes.items())) + ">")
            if (name == "table" and inside) or (name == "tr" and "tr" in inside):
                return NO_TABLE
            if name == "tr":
                rows.append([])
            if name in CELLS:
                down, across = span_of(attributes, "rowspan"), span_of(attributes, "colspan")
                if not down or not across or "tr" not in inside or CELLS & set(inside):
                    return NO_TABLE
                structure.append(f"<{name}:r{down}:c{across}>")
                cells.append((down, across, []))
                rows[-1].append((down, across))
            elif name in STRUCTURAL:
                structure.append(f"<{name}>")
            if name not in CHILDLESS:
                inside.append(name)
        else:
            if not inside or inside.pop() != name:
                return NO_TABLE
            canonical_tokens.append(f"</{name}>")
            if name in STRUCTURAL:
                structure.append(f"</{name}>")
    if inside or not cells:
        return NO_TABLE
    content = [w for _, _, words in cells for w in [*words, "<CELL>"]]
    return True, canonical_tokens, structure, content, *shape(rows), len(cells), any(down > 1 or across > 1 for down, across, _ in cells)


TOKENS = T.ArrayType(T.StringType())
TABLE_TYPE = T.StructType().add("valid", T.BooleanType()).add("canonical", TOKENS).add("structure", TOKENS).add("content", TOKENS).add("num_rows", T.LongType()).add("num_cols", T.LongType()).add("num_cells", T.IntegerType()).add("merged", T.BooleanType())


@F.pandas_udf(TABLE_TYPE)
def table_parts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([table_facts(t if isinstance(t, str) else None) for t in texts], columns=TABLE_TYPE.names)


# ------------------------------------------------------------------ grid text of tables


#: Marks of grid text that make a cell, or widen one.
FULL, EMPTY, FROM_LEFT, FROM_ABOVE, NEW_ROW = "fcel", "ecel", "lcel", "ucel", "nl"


def grid_html(text: str | None) -> str:
    """Grid text to an HTML table. A mark takes the next place of its row: a cell with or without
    words, or one more place for the last cell made in its row or its column. A mark of a place
    to widen without such a cell makes an empty one; any other mark leaves its place covered."""
    if not (text or "").strip():
        return "<table></table>"
    lines, above = [], {}
    rows = text.split(f"<{NEW_ROW}>")
    for row in rows if rows[-1] else rows[:-1]:
        line, places = [], re.split("<([a-z]+)>", row)
        for column, (mark, words) in enumerate(zip(places[1::2], places[2::2], strict=True)):
            if mark == FROM_LEFT and line:
                line[-1]["colspan"] += 1
            elif mark == FROM_ABOVE and column in above:
                above[column]["rowspan"] += 1
            elif mark in (FULL, EMPTY, FROM_LEFT, FROM_ABOVE):
                above[column] = {"rowspan": 1, "colspan": 1, "words": words.strip() if mark == FULL else ""}
                line.append(above[column])
        lines.append(line)

    def shown(cell: dict) -> str:
        spans = "".join(f' {side}="{cell[side]}"' for side in ("rowspan", "colspan") if cell[side] > 1)
        return f"<td{spans}>" + re.sub("\r\n|\r|\n", "<br>", escape(cell["words"])) + "</td>"

    return "<table>" + "".join("<tr>" + "".join(map(shown, line)) + "</tr>" for line in lines) + "</table>"


@F.pandas_udf(T.StringType())
def grid_to_html(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else grid_html(t))


# ------------------------------------------------------------------ layout lists

#: Names that answers use for the parts of an element.
BOX, LABEL, CONTENT = ("bbox", "box", "coordinates"), ("label", "category", "type"), ("content", "text")
_BOX_KEY = r"""['"](?:bbox|box|coordinates)['"]\s*:"""


def literal(text: str) -> object:
    """A Python or JSON-like literal, None where it is none."""
    try:
        return ast.literal_eval(text)
    except Exception:  # noqa: BLE001 - broken syntax, wrong types, too deep or too large
        return None


def layout_item(value: object) -> tuple | None:
    """(box, label, content) of an object with four numbers as its box."""
    if not isinstance(value, dict):
        return None
    first = lambda names, default: next((value[n] for n in names if value.get(n)), default)
    box = first(BOX, None)
    if not isinstance(box, list | tuple) or len(box) != 4 or not all(isinstance(v, int | float | str) for v in box):
        return None
    try:
        numbers = [float(v) for v in box]
    except ValueError:
        return None
    return numbers, str(first(LABEL, "Text")).strip() or "Text", str(first(CONTENT, "")).strip()


def brackets(text: str, left: str, right: str) -> tuple[dict[int, int], list[int]]:
    """Where each bracket that closes was opened, and the places that stay open."""
    opened, match = [], {}
    for m in re.finditer(f"[{re.escape(left + right)}]", text):
        if m[0] == left:
            opened.append(m.start())
        elif opened:
            match[opened.pop()] = m.start()
    return match, opened


def list_texts(text: str) -> list[str]:
    """The outermost lists of a text, and all from the first one on with what is not
    closed closed at the end."""
    match, opened = brackets(text, "[", "]")
    outer, after = [], -1
    for start in sorted(match):
        if start > after and not any(o < start for o in opened):
            outer.append(text[start : match[start] + 1])
            after = match[start]
    if opened:
        first = min([*match, *opened])
        outer.append(text[first:].strip() + "]" * len(opened))
    return list(dict.fromkeys(outer))


def object_texts(text: str) -> list[str]:
    """The objects that hold a box key of their own, the innermost around each key;
    objects that are not closed are closed at the end."""
    match, opened = brackets(text, "{", "}")
    ends = sorted([*match, *opened])
    wanted, stack, at = set(), [], 0
    for m in re.finditer(_BOX_KEY, text):
        while at < len(ends) and ends[at] < m.start():
            stack.append(ends[at])
            at += 1
        while stack and match.get(stack[-1], len(text)) < m.start():
            stack.pop()
        if stack:
            wanted.add(stack[-1])
    open_at = {start: len(opened) - k for k, start in enumerate(opened)}
    return list(dict.fromkeys(text[s : match[s] + 1] if s in match else text[s:].strip() + "}" * open_at[s] for s in sorted(wanted)))


def layout_items(text: str | None) -> list[tuple]:
    """(box, label, content) of a model's answer: all of it as one list, else its best
    list or its single objects, whichever gives more."""
    t = (text or "").strip()
    if t.startswith("```") and t.endswith("```") and len(t) > 5:  # without its fence, and the name of a language after it
        t = re.sub("^(json|python)", "", t[3:-3], flags=re.IGNORECASE).strip()
    items = lambda x: [i for v in x if (i := layout_item(v))] if isinstance(x, list) else []
    if whole := items(literal(t)):
        return whole
    best = max((items(literal(x)) for x in list_texts(t)), key=len, default=[])
    single = items([literal(x) for x in object_texts(t)])
    return single if len(single) > len(best) else best


@F.pandas_udf(T.ArrayType(T.StructType().add("bbox", T.ArrayType(T.DoubleType())).add("label", T.StringType()).add("content", T.StringType())))
def layout_list(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("bbox", "label", "content"), x, strict=True)) for x in layout_items(t)])
