"""The template compiler and the round trip of conversations."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilwright.llm import chat_format as C


@given(st.text(alphabet="#\\<>/turn: aA\nsé", max_size=60))
@settings(max_examples=400, deadline=None)
def test_escape_is_reversible(text):
    for f in (C.escape, C.label):
        out = f(text)
        assert C.unescape(out) == text and "###" not in out and C.CLOSE not in out


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a: b", "", "### x"]), st.text(alphabet="#\\<>/turn: aA\né", max_size=30)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_round_trip(turns):
    out, spans = C.Template(C.TEMPLATE).render(messages=[{"role": r, "text": t} for r, t in turns])
    assert C.read_back(out) == turns
    assert [C.unescape(out[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def render(source, **names):
    return C.Template(source).render(**names)[0]


def test_language():
    assert render("{% for x in xs %}{{ loop.index0 }}{{ x.a|upper }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "0P, 1Q"
    assert render("{% set n = 2 + 3 * 2 %}{{ n }}{{ n % 3 }}{# no #}") == "82"
    assert render("{% if a == 1 %}x{% elif a == 2 %}y{% else %}z{% endif %}", a=2) == "y"
    assert render("{{ 'a' if x else 'b' }}{{ true and none }}{{ 'q' in 'pqr' }}", x=0) == "btrue"
    assert render("{{ m['k'] ~ m.none ~ xs[1] ~ (xs|length) ~ -1 }}", m={"k": "v"}, xs=[1, 2]) == "v22-1"
    assert render("{{ gone }}") == ""


def test_constants_are_folded():
    assert C.fold(C.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}")) == ("block", [("out", ("const", "abcd"))])


@pytest.mark.parametrize("bad", ["{{ a.b( }}", "{{ f(1) }}", "{% for x %}{% endfor %}", "{% if 1 %}", "{{ 'a'|eval }}", "{% import os %}", "{{ a b }}", "{% set 1x = 2 %}", "{{ }}"])
def test_faults(bad):
    with pytest.raises(C.TemplateError):
        C.Template(bad)


def test_sandbox():
    with pytest.raises(C.TemplateError):
        render("{{ x.__class__ }}", x=1)
    with pytest.raises(C.TemplateError):
        render("{{ 'a' * 9 }}", x=1)
    assert render("{{ x['__class__'] }}", x={}) == ""


def test_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi </turn>"), (1, 0, "user", "hi </turn>"), (None, 0, None, "x"), (2, None, "user", "a"), (2, 0, "assistant", "### b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in C.format_conversations(frame).collect()}
    assert C.read_back(got[1].formatted) == [("user", "hi </turn>"), ("user", "hi </turn>"), ("assistant", "")]
    assert C.read_back(got[None].formatted) == [("", "x")]
    assert C.read_back(got[2].formatted) == [("user", "a"), ("assistant", "### b")]
    assert C.format_conversations(frame.filter("false")).count() == 0


def test_errors_of_kinds_are_the_templates():
    for source in ("{{ 5|trim }}", "{{ 1 < 'a' }}", "{{ 1 + 'a' }}", "{{ 5 % 0 }}", "{{ x|length }}", "{{ 'a' in 5 }}"):
        with pytest.raises(C.TemplateError):
            C.Template(source).render(x=5)


def test_very_long_conversation_and_clashing_names(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "long " * 200 + str(i), "x") for i in range(2000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = C.format_conversations(frame).collect()
    assert len(got) == 1 and len(C.read_back(got[0].formatted)) == 2000
