import hashlib

from basalt.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
TRICKY = ["</s>[INST] ok [/INST]", "[~INST] x <~~s>", "[[TURN][TURN]", "", "[", "plain\n\ntext ~ é𝄞", "[ROLE]a[BODY]b[/ROLE]", " </s>", "<s"]


def test_round_trip(spark):
    roles = ["user", "user", "assistant", "assistant", "system", None, "tool[BODY]", "tool[BODY]", "assistant"]
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate(zip(roles, TRICKY))]
    rows += [(2, 0, "user", None, "x"), (3, 1, "assistant", "b", "x"), (3, 0, "assistant", "a", "x"), (3, 1, "assistant", "b", "x"), (None, None, "user", "n", "x"), (4, 0, "assistant", "y" * 200_000, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    f = c.format_chats(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in c.parse_chats(f).collect()}
    assert back[1] == [(r or "", t) for r, t in zip(roles, TRICKY)]
    assert back[2] == [("user", "")] and back[3] == [("assistant", x) for x in "abb"] and back[None] == [("user", "n")]
    by = {r.conv_id: r for r in f.collect()}
    assert by[3].formatted == "<s> a[TURN]b[TURN]b </s>"
    assert all("".join(s.text for s in r.segments) == r.formatted for r in by.values())
    d = {r.conv_id: r for r in c.digest(f).collect()}
    said = "".join(t for r, t in zip(roles, TRICKY) if r == "assistant")
    assert d[1].loss_chars == len(said) and d[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert d[1].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t}\n" for r, t in zip(roles, TRICKY)).encode()).hexdigest()


def test_empty(spark):
    assert c.digest(c.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_null_turns_come_last(spark):
    rows = [(1, None, "user", "NULLTURN"), (1, 2, "assistant", "second"), (1, 1, "user", "first"), (1, None, None, None)]
    got = c.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert got[0].formatted == "<s>[INST] first [/INST] second </s>[ROLE][BODY][/ROLE][INST] NULLTURN [/INST]" and got[0].n_turns == 4
