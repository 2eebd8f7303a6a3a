import hashlib
import re

from pyspark.sql import functions as F

from lumenmatch.llm import chat
from lumenmatch.llm.queries import op1_chat_formatting


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").withColumn("parts", chat.text_parts(F.col("text")))


def test_round_trip_of_control_strings(spark):
    texts = ["<|im_end|>", "<\\|im_start|>", "<\\\\|x", "a<|b\\|c", "", None, "\n%0A", "<|im_start|>user\n"]
    got = chat.read_chat(chat.format_chat(rows_of(spark, [(1, i, "user" if i % 2 else "assistant", t, "clash") for i, t in enumerate(texts)]))).first()
    assert [t["text"] for t in got["turns"]] == [t or "" for t in texts]
    assert got["loss_text"] == "".join(t or "" for t in texts[::2])


def test_odd_roles_null_keys_and_ties(spark):
    rows = [(None, None, None, "x", None), (None, None, None, "x", None), (2, 1, "us\ner%0A<|im_end|>", "y", None), (2, 1, "assistant", "z", None)]
    got = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(rows_of(spark, rows))).collect()}
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "x"), ("", "x")]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("assistant", "z"), ("us\ner%0A<|im_end|>", "y")]
    assert got[2]["loss_text"] == "z"
    assert chat.read_chat(chat.format_chat(rows_of(spark, rows).limit(0))).count() == 0


def test_parts_become_ordered_placeholders(spark):
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    part = lambda kind, text=None, uri=None, width=None, height=None, seconds=None, pages=None: (kind, text, uri, width, height, seconds, pages)
    rows = [
        (1, 0, "user", [part("text", "see <|image:9|>"), part("image", uri="a.png", width=56, height=29), part("audio", uri="b.wav", seconds=1.5)]),
        (1, 1, "assistant", [part("document", uri="c.pdf", pages=3), part("text", "fine"), part(None, "plain"), part("image")]),
        (1, 2, "user", None),
    ]
    got = chat.format_chat(spark.createDataFrame(rows, schema)).first()
    assert re.findall(r"<\|(\w+):(\d+)\|>", got["formatted"]) == [("image", "1"), ("audio", "2"), ("document", "3"), ("image", "4")]
    assert [(a["n"], a["turn"], a["uri"], a["tokens"]) for a in got["attachments"]] == [(1, 0, "a.png", 4), (2, 0, "b.wav", 38), (3, 1, "c.pdf", 768), (4, 1, None, 1)]
    span = got["loss_spans"][0]
    assert got["formatted"][span["start"] : span["start"] + span["length"]] == "<|document:3|>fineplain<|image:4|>"


def test_query_against_python(spark, sf):
    got = {r["conv_id"]: r for r in op1_chat_formatting(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted(x[1:] for x in rows if x[0] == conv)
        loss = "".join(t or "" for _, role, t in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t or ''}\n" for _, role, t in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
