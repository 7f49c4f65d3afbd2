import hashlib
import json
import random

from tests.conftest import DATA

from slidegrid.llm import chat, queries


def test_render_and_parse_are_inverse():
    rng = random.Random(1)
    pieces = ["###", "#", "\\", "</turn>", " </turn>\n", "### Assistant: ", "\\h", "\\t", "é", ":", "\n", " ", "a", "r"]
    for _ in range(500):
        make = lambda n: "".join(rng.choice(pieces) for _ in range(rng.randrange(n)))
        turns = [(rng.choice(["user", "assistant", "system", "tool", "User", "", make(4)]), make(8)) for _ in range(rng.randrange(5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts_by_fingerprint():
    select = chat.Selector()
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "instruction": {"instruction": "q", "input": None, "output": "a"},
        "prompt": {"prompt": "q", "completion": "a"},
        "response": {"prompt": "q", "response": "a"},
        "question": {"question": "q", "answer": "a"},
    }
    prints = set()
    for name, record in records.items():
        print_, layout = select(record)
        prints.add(print_)
        assert layout.name == name and layout.read(record) == [("user", "q"), ("assistant", "a")]
    assert len(prints) == len(records) == len(select.known)
    assert select({"prompt": "q", "system": "s", "completion": "a"})[1].name == "prompt"
    assert select({"messages": []})[1].name == "messages"
    assert select({"other": 1})[1] is None and select({})[1] is None
    assert select({"prompt": "q", "extra": 1})[1] is None


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b </turn> ###"), (1, 0, "user", None), (2, 0, None, "x"), (2, None, "assistant", "é"), (2, None, "assistant", "é"), (None, 3, "user", ""), (3, 0, "user", "t" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_records(chat.conversation_records(df.withColumn("formatted", df.text)))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 2 and got[1].turns_sha256 == sha("user\n\nassistant\nb </turn> ###\n") and got[1].loss_sha256 == sha("b </turn> ###") and got[1].loss_chars == 13
    assert got[2].n_turns == 3 and got[2].turns_sha256 == sha("assistant\né\nassistant\né\n\nx\n") and got[2].loss_sha256 == sha("éé")
    assert got[None].n_turns == 1 and got[None].loss_chars == 0 and len(got) == 4
    assert chat.conversation_records(df.where("false")).count() == 0
    odd = spark.createDataFrame([(1, None), (2, "no json"), (3, json.dumps([1]))], "conv_id long, record string")
    assert [(r.layout, r.formatted) for r in chat.format_records(odd).collect()] == [(None, "")] * 3


def test_query_against_plain_loops(spark):
    """All conversations, the one with control strings among them, whatever layout each came in."""
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    control = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", control), (-7, 1, "assistant", control)]
    turns = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or "")):
        turns.setdefault(conv, []).append((role, text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = queries.op2_chat_formatting(spark, f"{DATA}/sf0.01").collect()
    assert sorted(r.conv_id for r in got) == sorted(turns)
    for r in got:
        own = turns[r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{a}\n{t}\n" for a, t in own)), len(loss), sha(loss))
        assert r.formatted_chars == len(chat.render(own)[0])
    assert {r.layout for r in got} == {x.name for x in chat.LAYOUTS}
