import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hoopspark.llm import chat

PARTS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]", "\\", "<", "[", "INST]", "s>", " ", "a", "é", "\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[INST] x"]), st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), max_size=5))
def test_grammar_round_trip(turns):
    segments = [chat.round_trip(r, t) for r, t in turns]
    parsed = chat.parse("".join(s for s, _, _ in segments))
    assert [p[:2] for p in parsed] == turns
    assert all(chat.unescape(s[a:b]) == t for (s, a, b), (_, t) in zip(segments, turns))
    assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)


def test_plain_text_is_not_escaped():
    assert chat.round_trip("user", "a [b] <c> \\") == ("[INST] a [b] <c> \\ [/INST]", 7, 18)
    assert chat.round_trip("assistant", "</s>[INST] ok [/INST]")[0].count("</s>") == 1


@pytest.mark.parametrize("bad", ["x", "[INST] a", "[INST] a </s>", "<s>a </s>", "[ROLE]x", "[INST] [INST] a [/INST]"])
def test_strings_outside_the_grammar(bad):
    with pytest.raises(ValueError):
        chat.parse(bad)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "</s>a"), (2, 0, None, None), (2, 0, "user", ""), (None, None, "assistant", "x"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"),
            (4, 0, "user", "long " * 40_000)] + [(5, i, "assistant" if i % 2 else "user", f"t{i} [INST]") for i in range(400)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(3)
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.read_turns(chat.format_turns(df))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv]["formatted_chars"] == sum(len(chat.round_trip(r, x)[0]) for _, _, r, x in turns)
    assert chat.conversation_digests(chat.read_turns(chat.format_turns(df.limit(0)))).count() == 0
