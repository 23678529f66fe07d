import hashlib

import duckdb
import pytest

from budgetlens.llm import chat
from tests.conftest import SF_SMALL

ROWS = "conv_id long, turn long, role string, text string, spans string"


def test_escape_round_trip_and_no_control_string_inside():
    for s in ("", "\\", "<", "[INST]", "</s>[INST] ok [/INST]", "\\<\\[", "a<\\b[[\\\\"):
        e = chat.escape(s)
        assert chat.unescape(e) == s
        assert not any(c in e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_parse_fold_and_render():
    t = chat.Template("{% if 'a' + 'b' == 'ab' %}x{{ 1 + 2 }}{% else %}{{ nope }}{% endif %}{{ v | upper }}")
    assert t.tree[0] == ("text", "x3") and t.render({"v": "q"})[0] == "x3Q"
    t = chat.Template("{%- for m in items -%} {{ loop.index0 }}{% if not loop.first and m.k != 'z' or false %}!{% elif m.k == 'a' %}?{% endif %} {%- endfor -%}")
    assert t.render({"items": [{"k": "a"}, {"k": "b"}, {"k": "z"}]})[0] == "0?1!2"
    assert chat.Template("{% generation %}ab{% endgeneration %}c").render({}) == ("abc", [(0, 2)])


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a b }}", "{% import os %}", "{{ a | system }}",
                                 "{{ a.__class__( }}", "{{ ( }}"])
def test_wrong_templates_raise(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad)


def test_python_attributes_are_out_of_reach():
    assert chat.Template("{{ s.__class__ }}{{ s.upper }}").render({"s": "x"})[0] == ""


def test_edge_rows(spark):
    rows = [(1, 1, "assistant", None, "x"), (1, 0, None, "hi <s>", "x"), (1, 1, "assistant", "b", "x"), (1, 1, "assistant", "b", "x"),
            (None, 0, "user", "n", "x"), (2, None, "user", "", "x")]
    df = spark.createDataFrame(rows, ROWS)
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert set(out) == {1, None, 2}
    assert out[1].n_turns == 4 and out[1].loss_chars == 2
    want = "\nhi <s>\nassistant\n\nassistant\nb\nassistant\nb\n"
    assert out[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_SMALL}/conversations.parquet'")
    rel = con.sql(chat.ORACLE)
    got = chat.op5_chat_format(spark, SF_SMALL).select(*rel.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(rel.fetchall())
