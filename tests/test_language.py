import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.errors import ParseError
from tidemark.lang import Binary, Number, Selector, ValueType, parse, selectors
from tidemark.lang.lexer import tokens
from tidemark.model import Matcher, format_duration, parse_duration, python_pattern, valid_label_name
from tidemark.regex import finite_set

ROUND_TRIPS = [
    "up", 'up{job="api"}', 'up{job="api", instance!="a"}', '{__name__="up"}', "up offset 5m", "up offset -5m", "rate(http_requests_total[5m])", 'rate(http_requests_total{job="api"}[5m] offset 1h)', "sum(rate(x[5m]))",
    "sum by (job) (rate(x[5m]))", "sum without (instance) (up)", "count without () (up)", "topk(5, up)", "quantile(0.99, up) by (a, b)", "1 + 2 * 3", "(1 + 2) * 3", "2 ^ 3 ^ 2", "-1", "-up ^ 2", "up > 0", "up > bool 0", 'a{x="1"} / on (i) b',
    "a / on () b", "a - ignoring (x, y) b", "up and up", "up unless up", "up or up", "clamp_min(cpu, 0)", "round(cpu, 0.5)", "time()", "scalar(up)", "vector(1)", "1e5", "0.5", "Inf", "1e-9", '"text"', 'a{b=~"x|y\\\\d+"}',
]


@pytest.mark.parametrize("query", ROUND_TRIPS)
def test_printed_form_parses_to_the_same_tree(query):
    tree = parse(query)
    assert parse(str(tree)) == tree
    assert str(parse(str(tree))) == str(tree)


ERRORS = [
    ("", "empty query"), ("{", "no closing }"), ("up{", "no closing }"), ("up{job}", "followed by"), ("up{job=api}", "no quoted string"), ("sum(", "no expression begins"), ("rate(up)", "not a range vector"),
    ("sum(rate(up[5m])[5m])", "aggregation: ) should stand here"), ("up[5m] + 1", "side of + is a range vector"), ("1 + ", "no expression begins"), ("topk(up)", "lacks its parameter"), ("sum(1, up)", "has no parameter"), ("rate(up[5m], up[5m])", "has 2 arguments, not 1"),
    ("nosuchfunc(up)", "no function named 'nosuchfunc'"), ("1 == 1", "has to be == bool"), ("up + bool 1", "no comparison"), ('{job=~".*"}', "takes an empty value"), ("up[0s]", "holds nothing"), ('"unterminated', "string"),
    ("up @", "character"), ("up[1.5h]", "duration"), ("up[5m:1m]", "range selector: a duration should stand here"), ("1 and up", "joins instant vectors only"), ('-"x"', "no meaning before"), ("topk(up, up)", "not a scalar"), ("sum(1)", "works on an instant vector"),
    ('a{b=~"(?=x)"}', "bad pattern"), ('a{b=~"("}', "bad pattern"), ("up up", "the expression ends before"), ("a ! b", "!"), ("5minutes", "ends before"),
]


@pytest.mark.parametrize("query,message", ERRORS)
def test_errors_say_what_is_wrong(query, message):
    with pytest.raises(ParseError, match=re.escape(message)):
        parse(query)


def test_error_points_at_its_place():
    with pytest.raises(ParseError) as e:
        parse("sum(\n  up +)")
    assert e.value.position == 11
    assert e.value.pretty().split("\n")[:2] == ["  up +)", "      ^"]


def test_precedence():
    def shape(node):
        return f"({shape(node.left)}{node.op}{shape(node.right)})" if isinstance(node, Binary) else str(node)

    assert shape(parse("1 + 2 * 3 ^ 4 ^ 5 - 6")) == "((1+(2*(3^(4^5))))-6)"
    assert shape(parse("a or b and c unless d == e + f")) == "(aor((bandc)unless(d==(e+f))))"
    assert parse("-2 ^ 2").inner.op == "^"


@pytest.mark.parametrize("text,ms", [("1ms", 1), ("1s", 1000), ("1h30m", 5_400_000), ("1d12h", 129_600_000), ("90s", 90_000), ("1w", 604_800_000), ("1y", 31_536_000_000)])
def test_durations(text, ms):
    assert parse_duration(text) == ms == parse_duration(format_duration(ms))


@pytest.mark.parametrize("text", ["", "5", "5x", "m", "-5m", "5mm", "1.5h"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)


@pytest.mark.parametrize("text,kind", [("5", "number"), ("5m", "duration"), ("5ms", "duration"), ("5h30m", "duration"), ("1e5", "number"), ("0x1f", "number"), ("0.5", "number"), (".5", "number")])
def test_numbers_and_durations(text, kind):
    assert [(t.kind, t.text) for t in tokens(text)][:-1] == [(kind, text)]
    assert not isinstance(parse("0x1f") and parse("0x1f"), Selector) and parse("0x1f") == Number(31.0)


@pytest.mark.parametrize("query", ['up{by="1"}', 'up{on="x"}', 'up{bool="true"}', "by", "sum", "sum + 1", "offset offset 5m", "a OR b", "sum(a) by (x,)", 'a{x="1",}', "on", "ignoring offset 5m"])
def test_keywords_are_names_and_trailing_commas_are_fine(query):
    parse(query)


@pytest.mark.parametrize("query,value", [('up{a="b\\"c"}', 'b"c'), ('up{a="b\\nc"}', "b\nc"), ("up{a=`b\\nc`}", "b\\nc"), ("up{a='b\"c'}", 'b"c'), ('up{a="\\u00e9\\x41"}', "éA")])
def test_string_escapes(query, value):
    assert parse(query).matchers[1].value == value


@pytest.mark.parametrize("query,kind", [("1", "scalar"), ("up", "instant vector"), ("up[5m]", "range vector"), ("rate(up[5m])", "instant vector"), ("scalar(up)", "scalar"), ("1 + 1", "scalar"), ("up + 1", "instant vector"), ('"a"', "string")])
def test_value_types(query, kind):
    assert parse(query).type is ValueType(kind)


def test_selectors_and_comments():
    assert [s.name for s in selectors(parse("sum(rate(a[5m])) / b + c # d"))] == ["a", "b", "c"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='abe1."{}()[],=~!+-*/^<> \n#|5ms', max_size=24))
def test_any_text_parses_or_fails_with_a_parse_error(text):
    try:
        tree = parse(text)
    except ParseError:
        return
    assert parse(str(tree)) == tree


PATTERNS = ["web-1|web-2", "web-[1-3]", "a(b|c)d", "", ".*", "a+", "[^a]", r"x\.y", "(?i)a", "a|", "(a|b)(c|d)", "[ab]x", "a.b", "(?:ab)+", "[[:digit:]]+", r"\d{2}", "a$", "^a"]
VALUES = ["", "web-1", "web-2", "web-4", "abd", "acd", "x.y", "xzy", "a", "b", "A", "aa", "ac", "bx", "a\nb", "web-1\n", "12", "abab", "a\rb"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_finite_patterns_accept_what_the_pattern_does(pattern):
    literals = finite_set(pattern)
    for v in VALUES:
        want = bool(re.fullmatch(python_pattern(pattern), v))
        assert Matcher("l", "=~", pattern).matches(v) == want
        assert literals is None or (v in literals) == want


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)", "(?<=a)", r"\1", "a**", "a*+", "(", ")", "[a", r"\Z", "a{2}{3}", "*a", "(?P=x)"])
def test_patterns_of_another_dialect_are_rejected(pattern):
    with pytest.raises(ValueError):
        Matcher("l", "=~", pattern)


def test_label_names():
    assert all(map(valid_label_name, ["a", "_a1", "A_b"])) and not any(map(valid_label_name, ["", "1a", "a-b", "é", "a\n"]))
