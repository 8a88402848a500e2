import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from uttera.llm import chat
from uttera.session import ship

TEXT = st.lists(st.sampled_from([*"\\<>|/[]s:turnexd \n", *chat.CONTROL, "é"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_round_trip(turns):
    text, mask = chat.formatted(turns)
    assert chat.parsed(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
    for _, body in turns:
        assert not any(c in chat.escape(body) for c in chat.CONTROL)


def test_layouts():
    known = chat.registry()
    want = [("user", "q"), ("assistant", "a")]
    for record in (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"id": "1", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"}, {"source": "s", "prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"},
        {"data": {"dialog": [{"speaker": "human", "utterance": "q"}, {"speaker": "bot", "utterance": "a"}]}},
    ):
        assert chat.canonical(record, known) == want
    assert chat.canonical({"instruction": "s", "output": "a"}, known) == [("system", "s"), ("assistant", "a")]
    assert chat.canonical({"messages": []}, known) == []
    with pytest.raises(ValueError):
        chat.canonical({"messages": [{"role": "user"}]}, known)


def test_fingerprint_ignores_order_and_number():
    a = {"m": [{"x": "1", "y": 2}], "n": None}
    b = {"n": None, "m": [{"y": 5, "x": "z"}, {"x": "", "y": 0}]}
    assert chat.fingerprint(chat.paths(a)) == chat.fingerprint(chat.paths(b))
    assert chat.fingerprint(chat.paths(a)) != chat.fingerprint(chat.paths({"m": [{"x": 1, "y": 2}], "n": None}))
    json.dumps(a)


def test_tables(spark):
    ship(spark)
    rows = [(1, 1, "assistant", None, "c"), (1, 0, "user", "q", "c"), (2, 0, None, "x\\</s>", "c"), (2, 0, None, "x\\</s>", "c"), (None, None, "assistant", "y" * 200_000, "c")]
    rows += [(3, k, "assistant" if k % 2 else "human", f"t{k}", "c") for k in range(chat.SEGMENT * 2 + 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.format_turns(df).collect()}
    for key in (1, 2, 3, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x, _ in rows if c == key))
        assert got[key].n_turns == len(own)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[key].formatted_chars == sum(len(chat.formatted([(r, x)])[0]) for _, r, x in own)
    assert chat.format_turns(df.limit(0)).count() == 0
