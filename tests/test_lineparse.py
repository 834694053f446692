import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.operators.lineparse import BAD_VALUE, CHECKS, EDIT, GOLD_STANDARD, SAMPLE_SHEET, SPLIT, Layout, cheapest_parse, free_parse, loaded, number, parse_lines, rejected

LAYOUTS = {"meta_data": SAMPLE_SHEET, "gold_standard": GOLD_STANDARD}


@pytest.mark.parametrize("text, value", [("1", 1.0), ("+.5", 0.5), ("1e3", 1000.0), ("1.", 1.0), ("1e400", None), (".", None), ("1,5", None), ("nan", None), ("٣", None), ("1e", None), (" 1", None)])
def test_number(text, value):
    assert number(text) == value


@pytest.mark.parametrize("line, fields", [("a\tb", ["a", "b"]), ('"a\tb"\tc', ["a\tb", "c"]), ('"a""b"', ['a"b']), ('""\t', ["", ""]), ('a"b', None), ('"a', None), ('"a"b\tc', None), ("", [""])])
def test_free_parse(line, fields):
    assert free_parse(line)[0] == fields


def _naive(line):
    """Character by character, written apart from the operator."""
    fields, i, n = [], 0, len(line)
    while True:
        if line[i : i + 1] == '"':
            buf, i, closed = "", i + 1, False
            while i < n:
                if line[i : i + 2] == '""':
                    buf, i = buf + '"', i + 2
                elif line[i] == '"':
                    closed, i = True, i + 1
                    break
                else:
                    buf, i = buf + line[i], i + 1
            if not closed or (i < n and line[i] != "\t"):
                return None
        else:
            j = i
            while i < n and line[i] != "\t":
                if line[i] == '"':
                    return None
                i += 1
            buf = line[j:i]
        fields.append(buf)
        if i >= n:
            return fields
        i += 1


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='a"\t ', max_size=14))
def test_free_parse_against_naive(line):
    assert free_parse(line)[0] == _naive(line)


@pytest.mark.parametrize(
    "line, cost, words",
    [
        ("TRUE\tm\tS1\t10\tS2", 0, []),
        (' true \t"m"\tNA\tNA\t"a ""b"" c"', 0, []),
        ("TRUE\tm\tS1\t-0\tS2", 0, []),
        ("TRUE\tm\tS1\tx\tS2", 3, ["invalid del.t 'x'"]),
        ("TRUE\tm\tS1\t10\tS2\"", 2, ["delete quote at 16"]),
        ("TRUE\tm\tS1\t10\t\"S2", 2, ["quote"]),
        ("TRUEm\tS1\t10\tS2", 6, ["insert delimiter at 5"]),
        ("TRUE\tS1\t10\tS2", 5, ["", ""]),
        ("TRUE\tm\tS1", 7, ["insert delimiter", "", ""]),
        ("TRUE\tm\tS1\t\t10\tS2", 2, ["delete delimiter"]),
    ],
)
def test_cheapest_parse(line, cost, words):
    got, _, ops = cheapest_parse(line, SAMPLE_SHEET)
    assert got == cost and len(ops) == len(words) and all(w in o for w, o in zip(words, ops))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["TRUE", "f", "NA", "1", '"', "\t", "\t", "x"]), max_size=9).map("".join))
def test_cost_is_zero_just_for_sound_lines(line):
    fields = _naive(line)
    ok = fields is not None and len(fields) == 5 and fields[0] == "TRUE" and fields[1] == "f" and (fields[3] == "NA" or re.fullmatch("1+", fields[3]) is not None) and fields[4] not in ("", "NA")
    cost, _, ops = cheapest_parse(line, SAMPLE_SHEET)
    assert (cost == 0) == bool(ok)
    assert ok or ops


def test_very_long_lines_have_their_operations():
    for line, layout in (("x\t" * 20_000, SAMPLE_SHEET), ('a"b\t' * 3_000, SAMPLE_SHEET), ('"' * 5_001, SAMPLE_SHEET), ("1" * 100_000, GOLD_STANDARD), ("0" * 100_000, GOLD_STANDARD), ('0"0\t' * 300, GOLD_STANDARD), ("G169\t", GOLD_STANDARD)):
        cost, fields, ops = cheapest_parse(line, layout)
        assert cost > 0 and ops and len(fields) == len(layout.kinds)
    assert cheapest_parse("TRUE\tm\tS1\t1\t" + "y" * 1_000_000, SAMPLE_SHEET)[0] == 0


def exhaustive(line, layout):
    """Least cost over all states that carry the field's text, written apart from the operator."""
    kinds, width, n = layout.kinds, len(layout.kinds), len(line)
    best, todo = {}, [(0, 0, 0, "start", "")]
    low = None
    while todo:
        todo.sort()
        cost, i, f, mode, buf = todo.pop(0)
        if low is not None and cost >= low:
            break
        if best.get((i, f, mode, buf), 1e9) <= cost:
            continue
        best[i, f, mode, buf] = cost
        bad = lambda: 0 if CHECKS[kinds[f]](buf.strip(" ")) else BAD_VALUE  # noqa: B023, E731
        if i == n and mode != "quoted" and f == width - 1:
            end = cost + (0 if mode == "closed" else bad())
            low = end if low is None else min(low, end)
        out = []
        done = lambda extra, j: out.append((cost + extra + (0 if mode == "closed" else bad()), j, f + 1, "start", ""))  # noqa: B023, E731
        c = line[i] if i < n else ""
        if mode == "quoted":
            if i == n or c == "\t":
                out.append((cost + EDIT + bad(), i, f, "closed", ""))
            if c == '"':
                out += [(cost + bad(), i + 1, f, "closed", ""), (cost + EDIT, i + 1, f, mode, buf), (cost + EDIT, i + 1, f, mode, buf + '"')]
                if line[i + 1 : i + 2] == '"':
                    out.append((cost, i + 2, f, mode, buf + '"'))
            elif c:
                out.append((cost, i + 1, f, mode, buf + c))
        else:
            word = re.search(r'[^\t"]*\Z', line[:i])[0]
            if i == n or c == '"' or mode != "plain":
                if not (mode == "plain" and not buf):
                    done(EDIT, i)
            elif c != "\t" and word == buf and re.match(r'[^\t"]*(\t|\Z)', line[i:]):
                rest = re.match(r'[^\t"]*', line[i:])[0]
                if f + 1 < width and not bad() and CHECKS[kinds[f + 1]](rest.strip(" ")) and i - len(word) == len(line[:i]) - len(buf):
                    done(SPLIT, i)
            if c == "\t":
                done(0, i + 1)
                out.append((cost + EDIT, i + 1, f, "plain" if mode == "start" else mode, buf))
            elif c == '"':
                if mode == "start":
                    out.append((cost, i + 1, f, "quoted", ""))
                out.append((cost + EDIT, i + 1, f, "plain" if mode == "start" else mode, buf))
            elif c and mode != "closed":
                out.append((cost, i + 1, f, "plain", buf + c))
            if mode == "start" and c != '"' and c:
                out.append((cost + EDIT, i, f, "quoted", ""))
        todo += [o for o in out if o[2] < width]
    return low


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["TRUE", "m", "NA", "1", '"', '"', "\t", "\t", "x"]), max_size=7).map("".join))
def test_cost_against_exhaustive_search(line):
    layout = Layout(("a", "b", "c"), ("logical", "name", "sign"))
    assert cheapest_parse(line, layout)[0] == exhaustive(line, layout)


def test_operator_on_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "meta_data", None, "a"), (2, "meta_data", "  ", "a"), (3, "meta_data", "TRUE\tm\tS1\t10\tS2\r", "a"), (4, "meta_data", "TRUE\tm\tS1\t10\tS2\r", "a"), (5, None, "x", "a"), (6, "gold_standard", "G1" + "\t1e0" * 20, "a"), (7, "gold_standard", "G1" + "\t0.5" * 20, "a")]
    df = spark.createDataFrame(rows, "raw_id long, source string, line string, parse_line string")
    p = parse_lines(df, LAYOUTS, keep=["raw_id", "parse_line"])
    assert {r.raw_id: r.parse_reason for r in rejected(p).collect() if r.raw_id < 6} == {1: "blank line", 2: "blank line", 5: "unknown layout"}
    good = loaded(p, "meta_data", SAMPLE_SHEET, ["raw_id"]).collect()
    assert [(r["isTs"], r["del.t"], r["condName"]) for r in good] == [(True, 10.0, "S2")] * 2
    assert loaded(p, "gold_standard", GOLD_STANDARD).collect()[0]["G20"] == 1
    assert parse_lines(df.limit(0), LAYOUTS).count() == 0
    assert math.isfinite(number("1e308"))
