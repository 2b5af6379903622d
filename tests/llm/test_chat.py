import hashlib
import random

from quarry.llm import chat


def test_round_trip(spark):
    r = random.Random(2)
    bits = ["a", "\\", "<|", "|", "<", "b", "p", "\n", "<|end|>", "<|start|>user\n", "<|more|>", "</s>", "[INST]", "é🙂", "\\0", "\\n", ""]
    text = lambda: None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 8)))
    rows = [(c if c else None, r.choice([None, *range(6)]), r.choice(["user", "assistant", "assistant", "system", None, "", "we\nird<|", "\\0"]), text(), "x") for c in range(60) for _ in range(r.randint(1, 9))]
    rows += rows[:3] + [(900, 0, "user", "", "x"), (901, 1, "assistant", "long " * 50_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    kinds = {}
    for c, t, role, x, _ in rows:
        kinds.setdefault(c, []).append((t, role, x or ""))
    low = lambda v: (v is not None, v if v is not None else 0)
    assert set(got) == set(kinds)
    for c, turns in kinds.items():
        turns.sort(key=lambda t: (low(t[0]), (t[1] is not None, (t[1] or "").encode()), t[2].encode()))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        lines = "".join(f"{role or ''}\n{x}\n" for _, role, x in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha(lines), len(loss), sha(loss)), c


def test_merges_and_empty(spark):
    df = spark.createDataFrame([(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "user", "b<|"), (1, 3, "assistant", "d")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<|start|>user\na<|more|>b<\\p|<|more|>c<|end|><|start|>assistant\nd<|end|>"
    assert [r.formatted[m.start : m.start + m.length] for m in r.mask] == ["d"]
    assert chat.digests(chat.format_conversations(df.limit(0))).collect() == []
