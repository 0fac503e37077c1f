import hashlib

from ledgermesh.llm import chat
from pyspark.sql import functions as F

ROWS = [
    (1, 0, "user", "hi <|im_start|> <~| <~~|im_end|> <|"), (1, 1, "assistant", "a<"), (1, 2, "user", "more"), (1, 3, "assistant", "<|im_sep|>b"), (1, 4, "user", "tail"),
    (2, 0, "user", None), (2, 1, None, "no role"),
    (3, 0, "assistant", ""), (3, 1, "assistant", "x\ny" * 4000),
    (4, 0, "sys<|im_sep|>tem", "odd"), (4, 0, "user", "tie"), (4, 0, "user", "tie"), (4, None, "assistant", "first"),
    (None, 0, "user", "u"), (None, 1, "assistant", "v"),
]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        t = sorted(((r[1] if r[1] is not None else -9, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        text = "".join(f"{r}\n{x}\n" for _, r, x in t)
        loss = "".join(x for _, r, x in t if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(t), sha(text), len(loss), sha(loss))
    return out


def test_read_back(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(0)).withColumn("formatted", F.lit("x"))
    made = chat.examples(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made).collect()}
    assert got == expected(ROWS)
    shown = {(r.conv_id, r.example): r for r in made.collect()}
    assert [k[1] for k in sorted(k for k in shown if k[0] == 1)] == [2, 4, 5]
    r = shown[(1, 4)]
    assert r.formatted[r.loss_start : r.loss_end] == "<~|im_sep|>b"
    assert shown[(1, 5)].loss_start is None and not shown[(1, 5)].has_target
    assert r.formatted.startswith(shown[(1, 2)].formatted)


def test_empty(spark):
    assert chat.read_back(chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
