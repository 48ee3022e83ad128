"""Formatting is reversible, whatever the texts say."""

import hashlib
import random

from palaver.llm import chat

BITS = ["<", "|", ">", "\\", "s>", "/", "</s>", "<s>", "[INST]", "[/INST]", "[", "INST]", "<|end|>\n", "<|user|>\n", "<<SYS>>", "<</SYS>>", "\n", "é", "<|image:1|>", "ok"]


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(x in safe for x in ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"])


def digests(turns):
    full = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha(full), len(loss), sha(loss)


def test_conversations(spark):
    rng = random.Random(2)
    rows = {}
    for c in [*range(40), None, -7]:
        roles = ["user", "assistant", "system", "tool|>\n", None, ""]
        rows[c] = [(rng.choice(roles), rng.choice([None, "".join(rng.choice(BITS) for _ in range(rng.randrange(9)))])) for _ in range(rng.choice([1, 2, 7]))]
    flat = [(c, i, r, t, 0) for c, turns in rows.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(flat)
    df = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, conv_key int")
    pieces = chat.format_turns(df, chat.text_parts(df["text"]))
    got = {r["conv_key"]: tuple(r)[1:5] for r in chat.read_back(pieces).collect()}
    assert got == {None if c is None else str(c): digests(t) for c, t in rows.items()}
    assert {r["conv_key"]: tuple(r)[1:5] for r in chat.read_back(pieces, in_order=True).collect()} == got
    for moved in (pieces.repartition(4), pieces.orderBy("formatted")):
        again = chat.read_back(moved).collect()
        assert len(again) == len(got) and {r["conv_key"]: tuple(r)[1:5] for r in again} == got
    assert chat.read_back(chat.format_turns(df.limit(0), chat.text_parts(df["text"]))).collect() == []


def test_parts(spark):
    content = [
        ("text", "look: ", None, None, None, None, None), ("image", None, "s3://b/a.png", 57, 28, None, None), ("text", " and <|image:1|> ", None, None, None, None, None),
        ("audio", None, "x.wav", None, None, 2.1, None), ("document", None, "d.pdf", None, None, None, 3), ("image", None, "b.png", None, None, None, None), ("video", "?", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", content), (1, 2, "user", None), (2, None, "user", [None])],
                               f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    rows = sorted(chat.format_turns(df, df["parts"]).collect(), key=lambda r: (r["conv_key"], r["seq"]))
    first = rows[0]
    assert first["formatted"] == "<|user|>\nlook: <|image:1|> and <\\|image:1|> <|audio:1|><|document:1|><|image:2|>?<|end|>\n"
    assert [tuple(a) for a in first["attachments"]] == [("image", 1, "s3://b/a.png", 3), ("audio", 1, "x.wav", 27), ("document", 1, "d.pdf", 768), ("image", 2, "b.png", 0)]
    assert first["expanded_tokens"] == first["text_tokens"] + 798 and first["mask"] == []
    second = rows[1]
    assert "".join(chat.unescape(second["formatted"][m["first"]:m["last"]]) for m in second["mask"]) == "look:  and <|image:1|> ?"
    assert [a["number"] for a in second["attachments"]] == [3, 2, 2, 4] and rows[2]["formatted"] == "<|user|>\n<|end|>\n"
    assert len(rows) == 4


def test_long_text(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "<|" * 200_000)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_turns(df, chat.text_parts(df["text"]))).first()
    assert tuple(got)[1:5] == digests([("assistant", "<|" * 200_000)])
