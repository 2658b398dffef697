from pyspark.sql import functions as F

from storyloom.llm import chat


def test_control_strings_survive(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|><|start|>user<|message|>", "\\", "<\\", "\\<\\[", "", None, "a\nb", "😀<|"]
    rows = [(1, k, "assistant" if k % 2 else "user", t, 9) for k, t in enumerate(nasty)] + [(None, 0, None, "x", 1), (2, 1, "r<|", "y", 1), (2, 1, "r<|", "y", 1), (2, 0, "system", "z", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    out = chat.format_chat(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.back] for r in out.select("conv_id", chat.parsed_turns(F.col("formatted")).alias("back")).collect()}
    assert back[1] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(nasty)]
    assert back[None] == [("", "x")] and back[2] == [("system", "z"), ("r<|", "y"), ("r<|", "y")]
    loss = {r.conv_id: r.loss for r in out.select("conv_id", chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert loss[1] == "".join(t or "" for k, t in enumerate(nasty) if k % 2) and loss[2] == ""
    assert chat.format_chat(df.limit(0)).count() == 0


def test_typed_parts(spark):
    kind = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    rows = [
        (1, 0, "user", [("text", "see <|image:0|> ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("text", None, None, None, None, None, None)]),
        (1, 1, "assistant", [("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 2), ("odd", None, None, None, None, None, None)]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {kind}")
    out = {r.conv_id: r for r in chat.format_chat(chat.flatten_parts(df)).collect()}
    assert out[1].formatted == "<|start|>user<|message|>see <\\|image:0|> <|image:0|><|end|><|start|>assistant<|message|><|audio:1|><|document:2|><|document:3|><|end|>"
    assert [tuple(a) for a in out[1].attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1024), (3, "document", None, 0)]
    assert out[1].expanded_tokens == 4 + 38 + 1024 and out[2].attachments == [] and out[2].expanded_tokens == 0


def test_order_of_ties_is_the_order_of_the_output(spark):
    """Turns of one number and role, rows that repeat, and columns called like those that are added."""
    kind = f"array<{chat.PART}>"
    image = lambda ref: ("image", None, ref, 14, 14, None, None)
    rows = [(1, 0, "user", [image(f"{k}.png"), None], k, "x") for k in (3, 1, 2, 1)] + [(1, 0, None, None, 9, None), (1, 0, "", [("text", "t", None, None, None, None, None)], 9, None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {kind}, place int, content string").repartition(3)
    flat = chat.flatten_parts(df)
    assert flat.columns == ["conv_id", "turn", "role", "parts", "place", "content", "attachments", "expanded_tokens"]
    out = chat.format_chat(flat).first()
    assert [a.ordinal for a in out.attachments] == list(range(8))
    assert [a.ref for a in out.attachments] == ["1.png", None, "1.png", None, "2.png", None, "3.png", None]
    shown = [p for p in out.formatted.replace("<|end|>", "").split("<|start|>") if p]
    assert shown == ["<|message|>", "<|message|>t", *(f"user<|message|><|image:{k}|><|document:{k + 1}|>" for k in (0, 2, 4, 6))]
    assert out.expanded_tokens == 4 and chat.flatten_parts(df.limit(0)).count() == 0
