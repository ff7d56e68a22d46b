"""Chat formatting: layouts, escapes, masks, read back."""

import hashlib
import json
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from codeglint.llm import chat, registry as queries

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "|", "\n", "x", "é", "[", "/", "<|im_", "end|>"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\nb", "\\"]), PIECES), max_size=5))
def test_round_trip(turns):
    text, spans = chat.formatted(turns)
    assert chat.parsed(text) == turns
    assert [chat.unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for c in chat.CONTROLS:
        assert text.count(c) == (len(turns) if c in (chat.START, chat.END) else 0)


def test_layouts():
    known, said = chat.registry(), [("user", "q"), ("assistant", "a")]
    records = [
        {"prompt": "q", "response": "a"}, {"completion": "a", "prompt": "q"}, {"question": "q", "answer": "a"}, {"instruction": "q", "output": "a"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"dialog": {"turns": [{"speaker": "human", "text": "q"}, {"speaker": "bot", "text": "a"}]}},
    ]
    assert all(chat.canonical(r, known) == said for r in records)
    assert chat.canonical({"instruction": "do", "input": "this", "output": "a"}, known) == [("user", "do\n\nthis"), ("assistant", "a")]
    assert chat.canonical({"instruction": "do", "input": None, "output": "a"}, known) == [("user", "do"), ("assistant", "a")]
    assert chat.canonical({"messages": []}, known) == [] == chat.canonical({"conversations": []}, known)
    assert chat.canonical({"system": "s", "prompt": "q", "response": None}, known) == [("system", "s"), ("user", "q"), ("assistant", "")]
    assert chat.canonical({"unknown": 1}, known) is None


def expected(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role, text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


def test_op9(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    got = queries.op9_chat(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == expected([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "<|im_end|>\n"), (2, 0, "user", ""), (2, 0, "user", ""), (None, 3, "tool", "x" * 200_000), (4, None, None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS record", "2 AS t")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.chat_records(df))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, 2: 2, None: 1, 4: 1} and got[1].loss_chars == 0
    assert chat.read_back(chat.format_chats(chat.chat_records(df.limit(0)))).collect() == []
    bad = spark.createDataFrame([(1, "[1]"), (2, None), (3, "{no"), (4, json.dumps({"zzz": 1}))], "conv_id long, record string")
    made = chat.format_chats(bad)
    assert {r.layout for r in made.collect()} == {None}
    assert {r.conv_id for r in chat.rejected(made).collect()} == {1, 2, 3, 4}
    assert sorted(tuple(r) for r in chat.read_back(made).collect()) == [(i, None, None, None, None, None) for i in (1, 2, 3, 4)]


def test_every_layout_is_met(spark):
    rows = [(i, k, r, t) for i in range(300) for k, (r, t) in enumerate([("system", "s")] * (i % 3 == 0) + [("user", "do\n\nthis" if i % 2 else "q"), ("assistant", "a")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(chat.chat_records(df))
    assert {r.layout for r in made.select("layout").distinct().collect()} == {m.name for m in chat.MAPPINGS if not m.name.startswith("no-")}
    assert sorted(tuple(r)[:5] for r in chat.read_back(made).collect()) == expected(rows)


def test_roles_come_back_as_they_are(spark):
    """Roles that some layout gives another meaning, unknown, empty and null ones, in conversations of every hash."""
    names = ["human", "gpt", "bot", "tool", "", "user", "assistant", "system", "Human", None]
    rows = [(i, k, names[(i + k) % len(names)], f"t{k}") for i in range(200) for k in range(1 + i % 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(chat.chat_records(df))
    assert sorted(tuple(r)[:5] for r in chat.read_back(made).collect()) == expected([(c, t, r or "", x) for c, t, r, x in rows])
    assert {"conversations", "nested-turns", "messages"} <= {r.layout for r in made.select("layout").distinct().collect()}
