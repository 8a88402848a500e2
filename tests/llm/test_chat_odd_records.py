"""Null ends, extra fields, unknown layouts and broken JSON: each gives a row."""

import json

from uttera.llm import chat
from uttera.session import ship


def test_odd_records(spark):
    ship(spark)
    records = [
        {"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": "a"}]},
        {"messages": [{"role": None, "content": "x"}]},
        {"prompt": "p", "response": None},
        {"instruction": "i", "input": None, "output": "o"},
        {"messages": [{"role": "user", "content": "x"}], "lang": "en"},
        [1, 2],
        {},
        {"messages": "text"},
        {"messages": [{"role": "user"}, {"content": "x"}]},
        {"messages": [{"role": "user", "content": "x"}, {"role": "user"}]},
    ]
    texts = [json.dumps(r) for r in records] + ["{broken", "", None, "[" * 100_000, '{"messages":' * 50_000, '{"a":' * 900 + "1" + "}" * 900]
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "conv_id long, segment long, record string").coalesce(1)
    pieces = chat.format_records(df)
    got = {r.conv_id: r for r in pieces.collect()}
    assert [chat.parsed(got[k].formatted) for k in range(4)] == [[("user", ""), ("assistant", "a")], [("", "x")], [("user", "p"), ("assistant", "")], [("system", "i"), ("user", ""), ("assistant", "o")]]
    assert all(got[k].formatted is None and got[k].error for k in range(4, len(texts))) and not any(got[k].error for k in range(4))
    assert [r.n_turns for r in sorted(chat.read_back(pieces).collect())] == [2, 1, 2, 3] + [0] * 12


def test_null_and_missing_input_differ():
    known = chat.registry()
    assert chat.canonical({"instruction": "i", "output": "o"}, known) == [("system", "i"), ("assistant", "o")]
    assert chat.canonical({"id": None, "prompt": "p", "response": "r"}, known) == [("user", "p"), ("assistant", "r")]
