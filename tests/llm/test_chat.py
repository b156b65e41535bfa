"""Formatted conversations: the parser gives back every turn, whatever it holds."""

import hashlib
import inspect
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from barlytics.llm import chat
from conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = [
    "", " ", "\n", "<|im_end|>", "<|im_start|>", "<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<|", "<", "a<", "<\\", "|im_end|>", "<|im_end",
    "<<|im_start|>>", "<|im_end|>\n<|im_start|>assistant\nok", "\\n\\p\\\\", "$1 \\$1", "é日本😀<|", "x\r\ny", "x" * 200_000 + "<|im_end|>",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(learned), sha(learned))
    return out


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(df).collect()}


def test_hard_texts_and_roles(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)]
    rows += [(2, i, t, "said") for i, t in enumerate(HARD[:-1])]
    rows += [(3, None, None, None), (3, 1, "assistant", None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (None, 0, "user", "x"), (None, 0, "assistant", "y")]
    turns = spark.createDataFrame(rows, SCHEMA)
    assert got(chat.formatted(turns)) == plain(rows)


def test_other_columns_and_none(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)
    assert got(chat.formatted(turns.selectExpr("*", "1 AS _parts", "2 AS segments", "3 AS parts"))) == plain([(1, 0, "user", "x")])
    assert got(chat.formatted(turns.filter("false"))) == {}


def test_only_what_needs_it_is_escaped(spark):
    turns = chat.with_hostile(spark.createDataFrame([(1, 0, "user", "a <|x|> b"), (1, 1, "assistant", "<\\|")], SCHEMA))
    texts = {r["conv_id"]: r for r in chat.with_spans(chat.formatted(turns)).collect()}
    assert texts[1]["formatted"] == "<|im_start|>user\na <|x|> b<|im_end|>\n<|im_start|>assistant\n<\\\\|<|im_end|>\n"
    for r in texts.values():
        marks = re.findall(r"<\|im_(?:start|end)\|>", r["formatted"])
        assert marks == ["<|im_start|>", "<|im_end|>"] * 2
        assert [r["formatted"][s["begin"] - 10 : s["begin"]] for s in r["loss_spans"]] == ["assistant\n"]
        assert all(r["formatted"].startswith("<|im_end|>\n", s["end"]) for s in r["loss_spans"])


def test_damaged_text_is_not_read_as_turns(spark):
    from pyspark.sql import functions as F

    texts = ["x<|im_start|>user\na<|im_end|>\n", "<|im_start|>user a<|im_end|>\n", "<|im_start|>user\na", "<|im_start|>user\na<|im_end|>\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(None in r["p"] for r in df.select(chat.parsed(F.col("t")).alias("p")).collect())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("<|\\>im_startend\np", max_size=12), st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<", "\\", "|", "a", "\n"]), max_size=8)), max_size=12))
def test_any_turns_come_back(spark, turns):
    rows = [(5, i, role, "".join(text)) for i, (role, text) in enumerate(turns)] or [(5, 0, "user", "")]
    assert got(chat.formatted(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_given_conversations_without_python(spark):
    turns = chat.with_hostile(spark.read.parquet(f"{SF}/conversations.parquet"))
    rows = [tuple(r) for r in turns.collect()]
    made = chat.formatted(turns)
    assert got(made) == plain(rows)
    plan = chat.digests(made)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert "udf" not in inspect.getsource(chat)
