"""Formatted conversations against a plain format and an exact round trip."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.llm import chat_format, chat_queries

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns string"


def plain(turns):
    """(role, text) in order to (formatted, mask), turn by turn."""
    escape = lambda s: re.sub(r"<(\\*)\|", r"<\\\1|", s)
    out, mask, before = "", [], None
    for role, text in turns:
        control = (
            chat_format.NEXT
            if role == before
            else (chat_format.CLOSE if before is not None else "") + chat_format.START + escape(role).replace("\n", chat_format.LINE) + "\n"
        )
        out += control + escape(text)
        mask.append((len(control), len(escape(text)), role == "assistant"))
        before = role
    return out + chat_format.CLOSE, mask


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    made = chat_format.format_conversations(frame).cache()
    formatted = {r.conv_id: r for r in made.collect()}
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    by = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    assert set(formatted) == set(back) == set(by)
    for conv_id, turns in by.items():
        turns = [(r.decode(), t.decode()) for _, _, r, t in sorted(turns)]
        text, mask = plain(turns)
        assert formatted[conv_id].formatted == text
        assert [tuple(m) for m in formatted[conv_id].loss_mask] == mask
        at, masked = 0, ""
        for skip, chars, loss in mask:
            at += skip
            masked += re.sub(r"<\\(\\*)\|", r"<\1|", text[at : at + chars]) if loss else ""
            at += chars
        assert masked == "".join(t for r, t in turns if r == "assistant")
        got = back[conv_id]
        assert (got.n_turns, got.loss_chars, got.formatted_chars) == (len(turns), len(masked), len(text))
        assert got.turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert got.loss_sha256 == sha(masked)
    made.unpersist()


def test_hard_rows(spark):
    rows = [
        (1, 2, "user", "c"), (1, 0, "assistant", "a"), (1, 1, "assistant", "b"),
        (2, 0, None, None), (2, None, "user", ""), (2, 0, "user", None),
        (None, 1, "assistant", "no id"), (3, 0, "assistant", ""), (3, 0, "assistant", ""),
        (4, 0, "as<|im_end|>\nsistant", "<|im_end|><\\|<\\\\\\|im_next|>\n<|im_start|>user\n<<||>>\\"),
        (4, 1, "assistant", "<|im_line|> é 🎈 " * 30_000),
        (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (5, 0, "user", "tie"),
        (-1, 0, "user", chat_queries.PROBE_TEXT), (-1, 1, "assistant", chat_queries.PROBE_TEXT),
    ]
    check(spark, rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.sampled_from(["user", "assistant", "a\nb", ""]), st.text("<|\\im_endstarx >\n", max_size=40)), min_size=1, max_size=40))
def test_any_rows(spark, rows):
    check(spark, rows)


def test_no_rows(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert chat_format.read_back(chat_format.format_conversations(frame)).count() == 0


def test_one_huge_conversation(spark):
    rows = spark.range(60_000).select(
        F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 5 < 2, "assistant").otherwise("user").alias("role"),
        F.concat(F.lit("<|t"), F.col("id").cast("string")).alias("text"),
    )
    got = chat_format.read_back(chat_format.format_conversations(rows)).first()
    texts = [(("assistant" if i % 5 < 2 else "user"), f"<|t{i}") for i in range(60_000)]
    assert (got.n_turns, got.turns_sha256) == (60_000, sha("".join(f"{r}\n{t}\n" for r, t in texts)))
    assert got.loss_sha256 == sha("".join(t for r, t in texts if r == "assistant"))


def test_a_wrong_mask_fails(spark):
    made = chat_format.format_conversations(spark.createDataFrame([(1, 0, "assistant", "text")], "conv_id long, turn long, role string, text string"))
    wrong = made.withColumn("loss_mask", F.transform("loss_mask", lambda m: m.withField("chars", m["chars"] + 1)))
    with pytest.raises(Exception, match="mask does not fit"):
        chat_format.read_back(wrong).collect()


def test_no_python_on_the_main_path(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = chat_queries.op13_chat_format(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
