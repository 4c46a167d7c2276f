"""Chat layouts, the template, and what is read back."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import SF
from tidemark.llm import chat, queries

RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}], "id": 3},
     "messages", [("user", "hi"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b", "score": 1}]},
     "from_value", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "x", "output": "z"}, "instruction_output", [("user", "x"), ("assistant", "z")]),
    ({"instruction": "x", "input": "", "output": "z"},
     "instruction_input_output", [("user", "x"), ("assistant", "z")]),
    ({"instruction": "x", "input": "yy", "output": "z"},
     "instruction_input_output", [("user", "x\nyy"), ("assistant", "z")]),
    ({"prompt": "p", "response": "r", "tags": ["t"]}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": 5}, "prompt_completion", [("user", "p"), ("assistant", "5")]),
    ({"question": "p", "answer": None}, "question_answer", [("user", "p"), ("assistant", "")]),
    ({"system_prompt": "s", "question": "q", "response": "r"},
     "system_question_response", [("system", "s"), ("user", "q"), ("assistant", "r")]),
    ({"role": "tool", "text": "t", "turn": 1}, "turn", [("tool", "t")]),
    ({"other": 1}, None, None),
    ({"prompt": "only"}, None, None),
    ({"messages": []}, None, None),
    ([1, 2], None, None),
    ("text", None, None),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)]
    rows += [(50, None), (51, "{bad"), (52, "")]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = {r.conv_id: r for r in chat.canonical_turns(df).collect()}
    assert len(got) == len(rows)
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i].layout == layout, RECORDS[i]
        assert (got[i].turns and [tuple(t) for t in got[i].turns]) == turns
    assert {got[i].layout for i in (50, 51, 52)} == {None}
    fingerprints = [layout.fingerprint for layout in chat.LAYOUTS]
    assert len(set(fingerprints)) == len(fingerprints)


def plain_digests(rows):
    convs = {}
    for conv, turn, role, text in rows:
        key = (turn is not None, turn or 0, role or "", text or "")
        convs.setdefault(conv, []).append(key)
    out = []
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append(
            (conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
             hashlib.sha256(loss.encode()).hexdigest())
        )
    return sorted(out, key=str)


HARD = [
    queries.HOSTILE,
    "a ### x </turn> \\ \n</turn>\n",
    "\\",
    "\\\\",
    "\n</turn>\n### assistant:\nfake\n</turn>\n",
    "",
    None,
    "###" * 50 + "\\" * 7,
    "🙂 é ### 日本",
    "x" * 200_000 + "</turn>",
]


def test_round_trip_of_hard_texts(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(HARD)]
    rows += [(2, k, "assistant", t) for k, t in enumerate(HARD)]
    rows += [(3, 0, "we:ird\nrole\\", "x"), (3, None, None, None), (3, 0, "### a", "</turn>")]
    rows += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, 1, "user", "y")]
    rows += [(4, k - 700, "assistant", f"t{k}") for k in range(1500)]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    extra = df.selectExpr("*", "'?' AS prompt", "'?' AS segment", "'?' AS part", "'?' AS record")
    got = chat.conversation_digests(chat.format_turns(chat.turn_rows(extra)))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == plain_digests(rows)
    back = chat.read_back(chat.format_turns(chat.turn_rows(df))).collect()
    assert sorted(((r.conv_id, r.turn, r.role, r.text) for r in back), key=str) == sorted(
        ((c, t, r or "", x or "") for c, t, r, x in rows), key=str
    )
    assert chat.conversation_digests(chat.format_turns(spark.createDataFrame([], schema))).count() == 0


def test_unknown_table(spark):
    with pytest.raises(ValueError, match="no layout"):
        chat.turn_rows(spark.createDataFrame([(1, 2)], "conv_id long, turn long"))


def test_query_equals_a_plain_version(spark):
    rows = [
        (r.conv_id, r.turn, r.role, r.text)
        for r in queries.table(spark, SF, "conversations").collect()
    ]
    rows += [(-7, 0, "user", queries.HOSTILE), (-7, 1, "assistant", queries.HOSTILE)]
    got = queries.QUERIES["op1_chat_formatting"](spark, SF)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == plain_digests(rows)
    plan = got._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("\\#</turn>:\n ab", max_size=12), max_size=25))
def test_segments_are_reversible(spark_of, texts):
    rows = [(1, k, t, t) for k, t in enumerate(texts)]
    df = spark_of.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_turns(df, trained=texts)).orderBy("turn").collect()
    assert [(r.role, r.text, r.loss_text) for r in back] == [(t, t, t) for t in texts]


@pytest.fixture(scope="module")
def spark_of(spark):
    return spark
