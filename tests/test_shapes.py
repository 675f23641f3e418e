"""Every shape of record, session and turn that loosely shaped JSON may have."""

import json

import pytest

from memengine.sources import turns as T

SAID = [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "hi"}]
BOTH = [("user", "hello"), ("assistant", "hi")]


def read(spark, tmp_path, *docs):
    (tmp_path / "r.json").write_text(json.dumps(list(docs)))
    sessions = T.explode_sessions(T.read_records(spark, str(tmp_path / "r.json")))
    rows = T.explode_turns(sessions).orderBy("record_id", "event_ord").collect()
    out = {}
    for r in rows:
        out.setdefault(r["record_id"], []).append(r)
    return out


def test_record_keys(spark, tmp_path):
    many = {k: {"id": k, k: [{"messages": SAID}]} for k in T.SESSION_KEYS}
    one = {f"flat_{k}": {"id": f"flat_{k}", k: SAID} for k in T.MESSAGE_KEYS}
    got = read(spark, tmp_path, *many.values(), *one.values())
    assert {k: [(r["speaker"], r["text"]) for r in v] for k, v in got.items()} == dict.fromkeys([*many, *one], BOTH)
    assert {v[0]["session_id"] for k, v in got.items() if k.startswith("flat_")} == {"session_0000"}
    assert got["histories"][0]["session_id"] == "histories_sess_0000"


def test_session_shapes_and_turn_keys(spark, tmp_path):
    shapes = {f"key_{k}": {k: SAID} for k in T.TURN_KEYS} | {"list": SAID, "pair": {"user": "hello", "assistant": "hi"}}
    got = read(spark, tmp_path, *[{"id": k, "sessions": [s]} for k, s in shapes.items()], {"id": "text", "sessions": ["just a line"]}, {"id": "half", "sessions": [{"assistant": "hi", "user": ""}]}, {"id": "none", "sessions": [3, {"x": 1}]})
    assert {k: [(r["speaker"], r["text"]) for r in got[k]] for k in shapes} == dict.fromkeys(shapes, BOTH)
    assert [(r["speaker"], r["text"]) for r in got["text"]] == [("unknown", "just a line")]
    assert [(r["speaker"], r["text"]) for r in got["half"]] == [("assistant", "hi")]
    assert "none" not in got


@pytest.mark.parametrize("keys,wrap", [(T.SESSION_KEYS, lambda k, t: {k: [[{"content": t}]]}), (T.TURN_KEYS, lambda k, t: {"sessions": [{k: [{"content": t}]}]})])
def test_precedence(spark, tmp_path, keys, wrap):
    docs = []
    for i in range(len(keys) - 1):
        first, then = wrap(keys[i], "first"), wrap(keys[i + 1], "then")
        if "sessions" in first and "sessions" in then and keys is T.TURN_KEYS:
            first = {"sessions": [{**then["sessions"][0], **first["sessions"][0]}]}
            then = {}
        docs.append({"id": f"r{i}", **then, **first})
    got = read(spark, tmp_path, *docs)
    assert {k: v[0]["text"] for k, v in got.items()} == {f"r{i}": "first" for i in range(len(keys) - 1)}


def test_sessions_come_before_messages_and_turn_fields(spark, tmp_path):
    turns = [{"speaker": "ann", "text": "a", "time": "t1"}, {"from": "bob", "message": "b", "datetime": "d", "created_at": "c"}, "bare", {"author": "cy", "utterance": ["x", "y"]}, {"role": "", "content": ["p", "q"]}, {"role": "user", "content": "  "}, 7]
    got = read(spark, tmp_path, {"id": "r", "messages": [{"content": "no"}], "history": [{"id": "s9", "date": "d0", "turns": turns}]})["r"]
    assert [(r["speaker"], r["text"], r["ts_raw"], r["turn_id"]) for r in got if r["turn_id"] != 3] == [("ann", "a", "t1", 0), ("bob", "b", "c", 1), ("unknown", "bare", "d0", 2), ("unknown", "p\nq", "d0", 4), ("unknown", "7", "d0", 6)]
    assert {r["session_id"] for r in got} == {"s9"}
