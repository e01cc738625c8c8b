"""Extra fields, clashing columns, nulls, long conversations and empty tables of chat formatting."""

import json

from pyspark.sql import functions as F

from pixelweave.llm import chat_format


def test_extra_fields_do_not_change_the_layout(spark):
    records = [
        (1, json.dumps({"id": 7, "instruction": "i", "output": "o", "source": "s"})),
        (2, json.dumps({"uuid": "x", "messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "content": "a"}]})),
        (3, json.dumps({"prompt": "p", "response": "r", "rating": 5})),
        (4, json.dumps({"messages": [{"role": None, "content": None}, {"role": "assistant", "content": ""}]})),
        (5, json.dumps({"messages": []})),
    ]
    out = {r.id: r for r in chat_format.format_chats(spark.createDataFrame(records, "id long, record string")).collect()}
    assert [out[i].layout for i in (1, 2, 3)] == ["instruction", "messages", None]
    assert [tuple(t) for t in out[2].turns] == [("user", "u"), ("assistant", "a")] and out[3].turns == [] and out[3].formatted == ""
    assert out[4].layout in ("messages", None) and all(t.role is not None and t.text is not None for t in out[4].turns) and out[5].turns == []


def test_columns_of_the_records_stay(spark):
    names = ["v", "layout", "turns", "fingerprint", "formatted", "loss_mask", "row", "a.b"]
    frame = spark.createDataFrame([("{\"prompt\":\"p\",\"response\":\"r\"}", *names)], ["record", *names])
    out = chat_format.format_chats(frame)
    row = out.first().asDict()
    assert all(row[n] == n for n in names) and row["_layout"] == "prompt" and row["_formatted"].count("<|im_start|>") == 2 and len(row["_loss_mask"]) == 1
    assert not chat_format.format_chats(frame.where("false")).collect()


def test_null_roles_and_long_conversations(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} " * 40) for k in range(2000)] + [(2, None, None, None), (2, 0, "assistant", None), (None, 0, "user", "x"), (None, 0, "user", "x")]
    out = chat_format.format_chats(chat_format.as_records(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
    back = out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("b"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    by = {r.conv_id: r for r in back.collect()}
    assert [tuple(t) for t in by[1].b] == [(r, t) for _, _, r, t in rows[:2000]] and by[1].loss == "".join(t for _, _, r, t in rows[:2000] if r == "assistant")
    assert [tuple(t) for t in by[2].b] == [("", ""), ("assistant", "")] and [tuple(t) for t in by[None].b] == [("user", "x")] * 2
