"""Rows that fail to parse: minimum-cost error parse of delimited lines.

Every line is read by one dynamic programme over (position, field, mode, start of the field). Following the
line as it stands costs nothing; inserting or deleting a quote or a delimiter costs
``EDIT``, a field whose value does not fit its type costs ``BAD_VALUE``. A delimiter put inside a word costs ``SPLIT``, more
than a delimiter and an unfit value together, so words are cut only where both parts fit and no empty field does as well.
A line whose cheapest parse costs nothing loads as a typed row; any other line is set apart and the edit
operations of its cheapest parse are the reason.

What a field's text is follows from where it starts and how it was opened, so texts are no part of the states. The programme
steps from one quote or delimiter to the next, by least cost first. Once a field's text can no longer change whether it fits, its
start drops out of the state, so states grow with structural characters x fields. There is no cap: each line gets its operations.

Plain lines (no quote, all values in their everyday form) are the layer of cost zero for which no programme is needed; they are
taken by one regular expression in the JVM. The others, a few in a hundred, go through the programme.

Defined results
---------------
* null and blank lines: rejected, reason ``blank line``, cost null.
* a source without a layout: rejected, reason ``unknown layout``.
* one carriage return at the end of the line is dropped.
* empty table: empty result. Repeated lines are judged one by one. Columns of the input
  that are named like an output column are renamed by the caller (``keep`` lists what stays).
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDIT, BAD_VALUE, SPLIT = 2, 3, 6
#: A value put together from several pieces counts as a number or a word of fixed form only up to this length.
MENDED = 64
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", re.ASCII)
_QUOTED = re.compile(r'"((?:[^"]|"")*+)"')


def number(text: str) -> float | None:
    """The finite double that an ASCII numeral names, else None."""
    if not NUMBER.fullmatch(text):
        return None
    value = float(text)
    return value if math.isfinite(value) else None


def is_logical(v: str) -> bool:
    return v.isascii() and v.upper() in ("TRUE", "FALSE")


def is_position(v: str) -> bool:
    return v in ("e", "f", "m", "l")


def is_step(v: str) -> bool:
    return v == "NA" or ((x := number(v)) is not None and x >= 0)


def is_name(v: str) -> bool:
    return v not in ("", "NA")


def is_free(v: str) -> bool:
    return True


def is_sign(v: str) -> bool:
    return v == "NA" or number(v) in (-1.0, 0.0, 1.0)


CHECKS = {"logical": is_logical, "position": is_position, "step": is_step, "name": is_name, "free": is_free, "sign": is_sign}


@dataclass(frozen=True)
class Layout:
    """Names and kinds (keys of ``CHECKS``) of a line's fields."""

    names: tuple[str, ...]
    kinds: tuple[str, ...]


SAMPLE_SHEET = Layout(("isTs", "is1stLast", "prevCol", "del.t", "condName"), ("logical", "position", "free", "step", "name"))
GOLD_STANDARD = Layout(("target", *(f"G{i}" for i in range(1, 21))), ("name", *["sign"] * 20))


@lru_cache(maxsize=65536)
def _short_fits(kind: str, value: str) -> bool:
    return CHECKS[kind](value.strip(" "))


def _fits(kind: str, value: str) -> bool:
    return _short_fits(kind, value) if len(value) <= 64 else CHECKS[kind](value.strip(" "))


def free_parse(line: str, delimiter: str = "\t") -> tuple[list[str] | None, str]:
    """The layer of cost zero: the fields of the line as it stands, or where it breaks."""
    if '"' not in line:
        return line.split(delimiter), ""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            m = _QUOTED.match(line, i)
            if not m:
                return None, f"unclosed quote at {i + 1}"
            fields.append(m[1].replace('""', '"'))
            i = m.end()
            if i < n and line[i] != delimiter:
                return None, f"text after closing quote at {i + 1}"
        else:
            end = line.find(delimiter, i)
            end = n if end < 0 else end
            if (q := line.find('"', i, end)) >= 0:
                return None, f"quote inside field at {q + 1}"
            fields.append(line[i:end])
            i = end
        if i >= n:
            return fields, ""
        i += 1


def cut(word: str, first: str, second: str) -> int | None:
    """The first place where a word falls into two parts that fit these kinds, numbers in plain decimal notation."""
    lead, tail = len(word) - len(word.lstrip(" ")), len(word.rstrip(" "))
    if first in ("position", "logical"):
        places = range(lead + 1, lead + 2) if first == "position" else range(lead + 4, lead + 6)
    elif first in ("step", "sign"):
        m = re.match(r" *(?:NA|[+-]?[0-9]*\.?[0-9]*)" if first == "step" else r" *(?:NA|[+-]?0*1?\.?0*)", word)
        places = range(lead + 1, m.end() + 1)
    elif second in ("step", "sign"):
        digits, low = "0123456789" if second == "step" else "0", word[:tail]
        if low.endswith("NA"):
            low = low[:-2]
        else:
            low = low.rstrip(digits)
            if low.endswith("."):
                low = low[:-1].rstrip(digits)
            if second == "sign" and low.endswith("1"):
                low = low[:-1].rstrip("0")
            low = low[:-1] if low[-1:] in ("+", "-") else low
        places = range(max(lead + 1, len(low)), tail)
    else:
        places = range(lead + 1, lead + 2)
    return next((k for k in places if k < len(word) and _fits(first, word[:k]) and _fits(second, word[k:])), None)


DEAD, SURE = -1, -2


def prospect(kind: str, text: str) -> int:
    """Whether longer texts that begin with this one never fit (``DEAD``), always fit (``SURE``), or it depends (0)."""
    t = text.strip(" ")
    if kind == "free" or (kind == "name" and t not in ("", "N", "NA")):
        return SURE
    if kind == "name" or not t:
        return 0
    if kind == "logical":
        return 0 if "TRUE".startswith(t.upper()) or "FALSE".startswith(t.upper()) else DEAD
    if kind == "position":
        return 0 if is_position(t) else DEAD
    return 0 if t in ("N", "NA") or not t.strip("+-.0123456789eE") else DEAD


def cheapest_parse(line: str, layout: Layout, delimiter: str = "\t") -> tuple[int, list[str], list[str]]:
    """Cost, fields and edit operations of the cheapest parse of a line.

    Least cost first over (position, field, mode, start of the field). The estimate of what is left, the delimiters that
    are certainly missing, never exceeds the true rest. The start counts only as long as the field's text can still turn
    out either way. A quote inside a quoted field is doubled where the kind can hold one and deleted where it cannot;
    either costs the same, so one state a place is enough."""
    kinds, names, width, n = layout.kinds, layout.names, len(layout.kinds), len(line)
    fields, _ = free_parse(line, delimiter)
    if fields is not None and len(fields) == width and all(map(_fits, kinds, fields)):
        return 0, fields, []
    marks = [i for i, c in enumerate(line) if c == delimiter or c == '"'] + [n]  # where anything can happen
    tabs = [0] * len(marks)  # delimiters from a mark on
    for k in range(len(marks) - 2, -1, -1):
        tabs[k] = tabs[k + 1] + (line[marks[k]] == delimiter)

    START, PLAIN, QUOTED, CLOSED, DONE = range(5)
    EMPTY = (None, 0, "")  # parts of a field's text, linked from the last; its prospect; the text itself while that is open
    heap: list = []
    seen: set = set()
    serial = 0

    def push(cost: int, i: int, f: int, mode: int, start: int, buf: tuple, trail: tuple | None) -> None:
        nonlocal serial
        if mode != DONE and (f >= width or (i, f, mode, buf[1] or start) in seen):
            return
        serial += 1
        rest = 0 if mode == DONE else max(0, width - 1 - f - tabs[bisect_left(marks, i)]) * EDIT
        heapq.heappush(heap, (cost + rest, -i, -f, serial, cost, mode, start, buf, trail))

    def longer(f: int, buf: tuple, part: str) -> tuple:
        parts, hope, text = buf
        if not hope:
            mended, text = bool(text), text + part
            if part in (delimiter, '"') or (mended and len(text) > MENDED):
                hope = SURE if kinds[f] in ("free", "name") else DEAD
            else:
                hope = prospect(kinds[f], text)
        return (parts, part), hope, text if not hope else ""

    def judged(f: int, buf: tuple, trail: tuple | None) -> tuple[int, tuple]:
        """What the field's value costs, and the trail with it."""
        parts, hope, text = buf
        fits = hope == SURE or (not hope and _fits(kinds[f], text))
        return 0 if fits else BAD_VALUE, (trail, f, parts, fits)

    def end_field(cost: int, i: int, f: int, buf: tuple, trail: tuple | None) -> None:
        if f + 1 < width:
            more, trail = judged(f, buf, trail)
            push(cost + more, i, f + 1, START, i, EMPTY, trail)

    def op(trail: tuple | None, what: str, where: int) -> tuple:
        return trail, -1, what, where + 1

    def read_off(trail: tuple | None) -> tuple[list[str], list[str]]:
        steps = []
        while trail:
            steps.append(trail)
            trail = trail[0]
        done, ops = [], []
        for _, f, what, more in reversed(steps):
            if f < 0:
                ops.append(f"{what} at {more}")
                continue
            parts = []
            while what:
                what, part = what
                parts.append(part)
            done.append("".join(reversed(parts)))
            if not more:
                ops.append(f"invalid {names[f]} {done[-1][:40]!r}")
        return done, ops

    push(0, 0, 0, START, 0, EMPTY, None)
    while heap:
        _, minus_i, minus_f, _, cost, mode, start, buf, trail = heapq.heappop(heap)
        i, f = -minus_i, -minus_f
        if mode == DONE:
            return cost, *read_off(trail)
        if (i, f, mode, buf[1] or start) in seen:
            continue
        seen.add((i, f, mode, buf[1] or start))
        if mode == START:
            if i < n:  # a field that was left out
                end_field(cost + EDIT, i, f, EMPTY, op(trail, "insert delimiter", i))
                if line[i] == '"':
                    push(cost, i + 1, f, QUOTED, i + 1, EMPTY, trail)
                    push(cost + EDIT, i + 1, f, PLAIN, i + 1, EMPTY, op(trail, "delete quote", i))
                    continue
                push(cost + EDIT, i, f, QUOTED, i, EMPTY, op(trail, "insert quote", i))
            mode = PLAIN
        if mode == CLOSED:  # the value is judged, only what follows counts
            if i >= n:
                if f == width - 1:
                    push(cost, n, f, DONE, n, EMPTY, trail)
                else:
                    push(cost + EDIT, n, f + 1, START, n, EMPTY, op(trail, "insert delimiter", n))
            elif line[i] == delimiter:
                push(cost, i + 1, f + 1, START, i + 1, EMPTY, trail)
                push(cost + EDIT, i + 1, f, CLOSED, 0, EMPTY, op(trail, "delete delimiter", i))
            else:
                push(cost + EDIT, i, f + 1, START, i, EMPTY, op(trail, "insert delimiter", i))
                if line[i] == '"':
                    push(cost + EDIT, i + 1, f, CLOSED, 0, EMPTY, op(trail, "delete quote", i))
            continue
        stop = marks[bisect_left(marks, i)]
        whole = buf is EMPTY
        if stop > i:
            word = line[i:stop]
            if mode == PLAIN and whole and f + 1 < width and (stop == n or line[stop] == delimiter) and (c := cut(word, kinds[f], kinds[f + 1])) is not None:
                end_field(cost + SPLIT, i + c, f, longer(f, EMPTY, word[:c]), op(trail, "insert delimiter", i + c))
            buf = longer(f, buf, word)
        if mode == PLAIN:
            if stop == n:
                if f == width - 1:
                    more, trail = judged(f, buf, trail)
                    push(cost + more, n, f, DONE, n, EMPTY, trail)
                else:
                    end_field(cost + EDIT, n, f, buf, op(trail, "insert delimiter", n))
            elif line[stop] == delimiter:
                end_field(cost, stop + 1, f, buf, trail)
                push(cost + EDIT, stop + 1, f, PLAIN, start, buf, op(trail, "delete delimiter", stop))
            else:
                push(cost + EDIT, stop + 1, f, PLAIN, start, buf, op(trail, "delete quote", stop))
                if buf is not EMPTY:
                    end_field(cost + EDIT, stop, f, buf, op(trail, "insert delimiter", stop))
        elif stop == n or line[stop] == delimiter:
            more, shut = judged(f, buf, op(trail, "insert quote", stop))
            push(cost + EDIT + more, stop, f, CLOSED, 0, EMPTY, shut)
            if stop < n:
                push(cost, stop + 1, f, QUOTED, start, longer(f, buf, delimiter), trail)
        else:
            more, shut = judged(f, buf, trail)
            push(cost + more, stop + 1, f, CLOSED, 0, EMPTY, shut)
            if line[stop + 1 : stop + 2] == '"':
                push(cost, stop + 2, f, QUOTED, start, longer(f, buf, '"'), trail)
            elif kinds[f] in ("free", "name"):
                push(cost + EDIT, stop + 1, f, QUOTED, start, longer(f, buf, '"'), op(trail, "insert quote", stop))
            else:
                push(cost + EDIT, stop + 1, f, QUOTED, start, buf, op(trail, "delete quote", stop))
    raise AssertionError("every line has a parse")


#: Values in their everyday form, as regular expressions: sufficient, not necessary.
_EVERYDAY = {
    "logical": " *(?:[Tt][Rr][Uu][Ee]|[Ff][Aa][Ll][Ss][Ee]) *", "position": " *[eflm] *", "step": r" *(?:NA|\+?[0-9]{1,30}(?:\.[0-9]{0,30})?) *",
    "name": r" *(?!NA *(?:\t|\r?\z))[^ \t\"\r][^\t\"]*", "free": r"[^\t\"]*", "sign": " *(?:NA|[+-]?[01]) *",
}


def everyday(layout: Layout, delimiter: str = "\t") -> str | None:
    """A regular expression of the JVM; each line that has it is a plain line of cost zero."""
    return r"\A" + r"\t".join(_EVERYDAY[k] for k in layout.kinds) + r"\r?\z" if delimiter == "\t" and set(layout.kinds) <= set(_EVERYDAY) else None


def parse_lines(df: DataFrame, layouts: dict[str, Layout], *, line: str = "line", layout: str = "source", keep: list[str] | None = None, delimiter: str = "\t") -> DataFrame:
    """Columns ``keep`` plus ``parse_layout``, ``parse_cost`` (0: the row loads), ``parse_fields``
    (the fields, unquoted, of the cheapest parse), ``parse_reason`` (null if the row loads).

    No shuffle. Plain lines stay in the JVM; the others pass the programme in Arrow batches.
    """
    keep = keep if keep is not None else [c for c in df.columns if c not in (line, layout)]
    schema = T.StructType([df.schema[c] for c in keep] + [
        T.StructField("parse_layout", T.StringType()), T.StructField("parse_cost", T.IntegerType()),
        T.StructField("parse_fields", T.ArrayType(T.StringType())), T.StructField("parse_reason", T.StringType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cost, fields, reason = [], [], []
            for text, kind in zip(b["__line"], b["__layout"]):
                if text is None or not text.strip():
                    c, v, r = None, None, "blank line"
                elif kind not in layouts:
                    c, v, r = None, None, "unknown layout"
                else:
                    c, v, ops = cheapest_parse(text[:-1] if text.endswith("\r") else text, layouts[kind], delimiter)
                    r = "; ".join(ops) if c != 0 else None
                cost.append(c)
                fields.append(v)
                reason.append(r)
            out = b[keep].copy() if keep else pd.DataFrame(index=b.index)
            out["parse_layout"] = b["__layout"]
            out["parse_cost"] = pd.array(cost, dtype="Int32")
            out["parse_fields"] = fields
            out["parse_reason"] = reason
            yield out

    q = lambda c: F.col(f"`{c}`")
    rows = df.select(*[q(c) for c in keep], q(line).alias("__line"), F.trim(q(layout)).alias("__layout"))
    plain = F.lit(False)
    for name, shape in layouts.items():
        if (regex := everyday(shape, delimiter)) is not None:
            plain = plain | ((F.col("__layout") == name) & F.col("__line").rlike(regex))
    plain = F.coalesce(plain, F.lit(False))
    straight = rows.where(plain).select(
        *[q(c) for c in keep], F.col("__layout").alias("parse_layout"), F.lit(0).alias("parse_cost"),
        F.split(F.regexp_replace("__line", r"\r\z", ""), delimiter, -1).alias("parse_fields"), F.lit(None).cast("string").alias("parse_reason"),
    )
    return straight.unionByName(rows.where(~plain).mapInPandas(run, schema))


def rejected(parsed: DataFrame) -> DataFrame:
    """Lines set apart, each with its reason."""
    return parsed.where(F.col("parse_cost").isNull() | (F.col("parse_cost") > 0))


def loaded(parsed: DataFrame, name: str, layout: Layout, keep: list[str] | None = None) -> DataFrame:
    """The valid lines of one layout as typed rows; NA becomes null. Typing stays in the JVM."""
    keep = keep or []
    rows = parsed.where((F.col("parse_cost") == 0) & (F.col("parse_layout") == name))
    cols = []
    for i, (field, kind) in enumerate(zip(layout.names, layout.kinds)):
        v = F.trim(F.element_at("parse_fields", i + 1))
        known = F.when(v != "NA", v)
        typed = {
            "logical": F.upper(v) == "TRUE", "step": known.cast("double"), "sign": known.cast("double").cast("int"),
            "free": F.when((v != "") & (v != "NA"), v),
        }.get(kind, v)
        cols.append(typed.alias(field))
    return rows.select(*[F.col(f"`{c}`") for c in keep], *cols)
