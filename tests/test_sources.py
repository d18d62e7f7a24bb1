import json

import pytest

from lorekeep.operators import stats
from lorekeep.sources import exports


def put(tmp_path, data, name="export.json"):
    path = tmp_path / name
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(path)


def node(parent, children, message=None):
    return {"parent": parent, "children": children, "message": message}


def said(i, role, content, hidden=None, at=None):
    return {"id": i, "author": {"role": role}, "create_time": at, "metadata": {"is_visually_hidden_from_conversation": hidden} if hidden is not None else {}, "content": content}


def tree():
    text = lambda *p: {"content_type": "text", "parts": list(p)}
    context = {"content_type": "user_editable_context", "user_profile": "gardener", "user_instructions": "be brief"}
    one = {"r": node(None, ["c", "m1"]), "c": node("r", [], said("ctx", "user", context)), "m1": node("r", [], said("1", "user", text("lost")))}
    two = {
        "r": node(None, ["a"]),
        "a": node("r", ["b", "b2"], said("a", "user", text("Hello ", {"x": 1}, "there"), at=5.0)),
        "b": node("a", ["d"], said("b", "assistant", {"content_type": "code", "text": "x = 1"})),
        "b2": node("a", [], said("b2", "assistant", text("other branch"))),
        "d": node("b", ["e"], said("d", "user", {"content_type": "multimodal_text", "parts": ["see ", {"image": "p"}]}, hidden=True)),
        "e": node("d", ["f"], None),
        "f": node("e", [], {"id": "f", "content": {"content_type": "odd"}}),
    }
    cycle = {"r": node(None, ["s"], said("r", "user", text("once"))), "s": node("r", ["r"], said("s", "user", text("twice")))}
    return [{"id": "t1", "title": "One", "create_time": 1.5, "mapping": one}, {"id": "t2", "mapping": two}, {"id": "t3", "title": "Cycle", "create_time": 2.0, "mapping": cycle}, {"id": "t4", "title": "Empty", "mapping": {}}]


def test_tree(spark, tmp_path):
    kind, conversations, messages, profile = exports.read_export(spark, put(tmp_path, tree()))
    assert kind == exports.TREE_EXPORT
    assert [(r.conv_ord, r.id, r.title, r.create_time) for r in conversations.orderBy("conv_ord").collect()] == [(0, "t1", "One", 1.5), (1, "t2", "Untitled", 0.0), (2, "t3", "Cycle", 2.0), (3, "t4", "Empty", 0.0)]
    got = [(r.conv_id, r.id, r.role, r.content, r.timestamp, r.is_hidden) for r in messages.orderBy("conv_ord", "msg_ord").collect()]
    assert got[:4] == [("t1", "ctx", "user", "gardener\nbe brief", None, True), ("t2", "a", "user", "Hello there", 5.0, False), ("t2", "b", "assistant", "x = 1", None, False), ("t2", "d", "user", "see ", None, True)]
    assert got[4][:3] == ("t2", "f", "unknown") and [g[3] for g in got[5:]] == ["once", "twice"]
    assert profile.first().user_profile == "gardener"
    row = stats.export_stats(conversations, messages, profile).first()
    assert (row.conversations, row.messages, row.user_messages, row.has_profile) == (4, 7, 3, True)


def test_flat_and_times(spark, tmp_path):
    data = [
        {"uuid": "u1", "name": "", "created_at": "2024-01-02T03:04:05Z", "chat_messages": [
            {"uuid": "a", "sender": "human", "text": "top", "content": [], "created_at": "2024-01-02T03:04:06.5+00:00"},
            {"uuid": "b", "sender": "assistant", "text": "unused", "content": [{"type": "thinking"}, {"type": "text", "text": "one "}, {"type": "text", "text": "two"}], "created_at": "nonsense"}]},
        {"uuid": "u2", "name": "N", "created_at": "never", "chat_messages": []},
    ]
    kind, conversations, messages, profile = exports.read_export(spark, put(tmp_path, data), run_ts=7.0)
    assert kind == exports.FLAT_EXPORT and profile.count() == 0
    assert [(r.title, r.create_time) for r in conversations.orderBy("conv_ord").collect()] == [("Untitled", 1704164645.0), ("N", 7.0)]
    assert [(r.role, r.content, r.timestamp) for r in messages.orderBy("msg_ord").collect()] == [("user", "top", 1704164646.5), ("assistant", "one two", 1704164645.0)]


@pytest.mark.parametrize("data,kind", [([{"mapping": {}}], "chatgpt"), ([{"uuid": "x", "chat_messages": []}], "claude"), ([], "unknown"), ({"mapping": {}}, "unknown"), ([{"mapping": []}], "unknown"), ([{"uuid": "x"}], "unknown"), ("not json", "unknown")])
def test_detection(spark, tmp_path, data, kind):
    assert exports.detect(exports.load_export(spark, put(tmp_path, data))).first().export_type == kind


def test_unknown_missing_and_input_checks(spark, tmp_path):
    with pytest.raises(ValueError, match="Unknown export type"):
        exports.read_export(spark, put(tmp_path, [{"x": 1}]))
    assert exports.validate_input(spark, "")[0] is False and "not found" in exports.validate_input(spark, str(tmp_path / "none"))[2]
    assert "not a file" in exports.validate_input(spark, str(tmp_path))[2]
    assert exports.validate_input(spark, put(tmp_path, "[]"))[:2] == (True, 2)


def test_duplicate_ids(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "a", None, "", "b", *[f"d{k % 6}" for k in range(12)]])], "conv_ord long, id string")
    with pytest.raises(ValueError, match=r"'', 'a', 'd0', 'd1', 'd2' \(and 3 more\)"):
        stats.require_unique_ids(df)
    stats.require_unique_ids(df.filter("id = 'b'"))


def test_memories(spark, tmp_path):
    data = [{"conversations_memory": "likes tea", "account_uuid": "acc", "project_memories": {"12345678-rest": {"uuid": "skip", "Purpose": "book", "n": 3, "State": "draft"}, "p2": "plain"}}]
    path = put(tmp_path, data, "memories.json")
    found = exports.read_memories(spark, path)
    assert found.first().project_memories == {"12345678-rest": "**Purpose**\n\nbook\n\n**State**\n\ndraft", "p2": "plain"}
    prose = exports.memories_prose(found).first().context
    assert prose.startswith("likes tea\n\n\n---\n\n## Project-Specific Context\n\n\n### Project 12345678...\n\n**Purpose**")
    assert exports.memories_path(spark, str(tmp_path)).endswith("memories.json")
    for bad in ("[]", "{", json.dumps([{"conversations_memory": ""}])):
        assert exports.read_memories(spark, put(tmp_path, bad, "bad.json")).count() == 0
    assert exports.read_memories(spark, str(tmp_path / "missing.json")).count() == 0
    profile = spark.createDataFrame([("me", "")], "user_profile string, user_instructions string")
    assert exports.trusted_context(found, profile).first().context == prose
    assert exports.trusted_context(found.limit(0), profile).first().context == "## About the User\n\nme"
