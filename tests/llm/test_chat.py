import hashlib
from collections import defaultdict

import pytest

from graphloom.llm import chat


def test_language():
    source = """{# note #}{{ 'a' ~ 1 + 2 }}{% if x == 'q' and not y %}Q{% elif x in 'xyz' %}in {{ x | upper }}{% else %}-{% endif %}
{%- for m in messages -%}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}"""
    render = chat.Template(source).render
    assert render({"x": "q", "y": 0, "messages": [1, 2]})[0] == "a12Q1,2"
    assert render({"x": "y", "y": 0, "messages": []})[0] == "a12in Y"
    assert render({"x": "k", "y": 1, "messages": None})[0] == "a12-"


def test_constants_are_folded():
    nodes = chat.fold(chat.parse("a{{ 'b' | upper }}{% if 1 > 2 %}no{% elif true %}c{% else %}no{% endif %}{{ 'd' ~ 'e' }}{% if x %}{{ 1 + 2 }}{% endif %}"))
    assert nodes[0] == chat.Output(chat.Constant("aBcde"))
    assert nodes[1].cases[0][1] == (chat.Output(chat.Constant("3")),)
    assert chat.fold(chat.parse("{% if false %}x{% endif %}")) == ()


@pytest.mark.parametrize(
    "source",
    ["{% if x %}", "{{ x | shell }}", "{{ f() }}", "{% import os %}", "{{ x. }}", "{{ 'a }}", "{{ }}", "{% for 1 in x %}{% endfor %}", "{{ a b }}"],
)
def test_faults(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_sandbox():
    with pytest.raises(chat.TemplateError):
        chat.Template("{{ x.__class__ }}").render({"x": "text"})
    with pytest.raises(chat.TemplateError):
        chat.Template("{{ missing }}").render({})
    assert chat.Template("{{ x.__class__ }}").render({"x": {}})[0] == ""


HARD = [
    r"\### Assistant: </turn> ok", "### User: </turn>\n### Assistant: x", "\\", "\\\\</turn>", "#### System: ", "", "</turn", "### Role : x", "a\nb",
]


def test_marks_in_texts_come_back():
    messages = [{"role": r, "content": t} for r in ("user", "assistant", "system", "to:ol\\", "", "### User: ") for t in HARD]
    text, spans = chat.Template(chat.TURNS).render({"messages": messages})
    turns = chat.read_turns(text)
    assert [(r, t) for r, t, _, _ in turns] == [(m["role"], m["content"]) for m in messages]
    assert [chat.unescape(text[a:b]) for a, b in spans] == HARD
    with pytest.raises(ValueError):
        chat.read_turns("### User: x")
    with pytest.raises(ValueError):
        chat.read_turns("user: x</turn>\n")


def test_streamed_turns_equal_the_whole():
    source = "<s>{% for m in messages %}{{ loop.index0 }}{{ m.content }}{% if loop.last %}!{% endif %}{% endfor %}</s>"
    template = chat.Template(source)
    messages = [{"content": c} for c in "abc"]
    parts = [template.turn(m, i, i == 2, {})[0] for i, m in enumerate(messages)]
    assert "".join(parts) == template.render({"messages": messages})[0] == "<s>0a1b2c!</s>"
    with pytest.raises(chat.TemplateError):
        chat.Template("{{ messages | length }}{% for m in messages %}{% endfor %}").turn({}, 0, True, {})


def test_conversations(spark):
    rows = [(1, 2, "assistant", "later", 9), (1, 1, "user", "first", 9), (1, None, "system", None, 9), (1, 2, "assistant", "later", 9)]
    rows += [(2, 1, None, HARD[0], None), (None, 1, "assistant", "no id", 1), (None, 2, "user", None, 1)]
    rows += [(3, i, ["user", "assistant"][i % 2], f"{i} " + "x" * (i * 50) + HARD[i % len(HARD)], 0) for i in range(600)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int").repartition(3)
    pieces = chat.format_conversations(table)
    found = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    whole = defaultdict(list)
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        whole[conv].append((role or "", text or ""))
    template = chat.Template(chat.TURNS)
    assert set(found) == set(whole)
    for conv, turns in whole.items():
        r, loss = found[conv], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(template.render({"messages": [{"role": a, "content": b} for a, b in turns]})[0])
    assert chat.format_and_read(table.where("false")).collect() == []
