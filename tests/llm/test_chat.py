import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF
from oracle import rows as both
from pyspark.sql import functions as F

from mendery.llm.chat import ORACLE_OP8, escape, op8_chat_windows, read_back, unescape, windows


def test_query_equals_sql(spark):
    got, want = both(spark, op8_chat_windows, ORACLE_OP8)
    assert got == want and got


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    alphabet = st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "</s>", "[INST]", " ", "é"])
    found = []

    @settings(max_examples=300, database=None)
    @given(st.lists(alphabet, max_size=8))
    def gather(parts):
        found.append("".join(parts))

    gather()
    df = spark.createDataFrame([(x,) for x in set(found)], "t string").withColumn("e", escape(F.col("t"))).withColumn("u", unescape(F.col("e")))
    for r in df.collect():
        assert r.t == r.u
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_odd_rows_history_and_mask(spark):
    long = "z" * 3000
    data = [(1, 0, "system", "be kind"), (1, 1, "user", "a" * 1000), (1, 2, "assistant", "b" * 900), (1, 3, "user", "c"), (1, 4, "assistant", "d"), (1, 5, "user", long), (1, 6, "assistant", None), (None, None, None, None), (2, 1, "user", "x"), (2, 1, "user", "x"), (3, None, "assistant", "</s> \\ [INST]")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(3)).withColumn("ord", F.lit("q"))
    w = {(r.conv_id, r.window): r for r in windows(df).collect()}
    later = [r for (c, k), r in sorted(w.items(), key=str) if c == 1 and k > 0]
    assert later and all("be kind" in r.formatted for r in later)
    out = {r.conv_id: r for r in read_back(windows(df)).collect()}
    assert set(out) == {1, 2, 3, None}
    assert out[1].turns_text == "".join(f"{r}\n{t or ''}\n" for _, _, r, t in data[:7])
    assert out[1].loss_text == "b" * 900 + "d" and out[3].loss_text == data[-1][3]
    assert out[2].n_turns == 2 and out[None].turns_text == "\n\n"
    assert windows(df.limit(0)).count() == 0


def test_special_conversation(spark):
    r = op8_chat_windows(spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(text)
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_spans_keep_the_budget(spark):
    """No span has more than 384 tokens (characters / 4, rounded up, and 8 a turn), unless it is one turn."""
    df = spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("conv_id", "turn", "role", "text")
    odd = [(-5, i, "user", "x" * n) for i, n in enumerate([3000, 10, 10, 1500, 1504, 1496, 700, 700, 90, 4, 0, 5000, 8])]
    rows = windows(df.unionByName(spark.createDataFrame(odd, df.schema))).collect()
    spans = []
    for r in rows:
        turns = r.formatted.split("</s>")[r.n_repeated : r.n_repeated + r.n_new]
        spans.append([-(-len(x.partition(" [/INST]")[2]) // 4) + 8 for x in turns])
    assert all(sum(x) <= 384 or len(x) == 1 for x in spans) and sum(len(x) > 1 for x in spans) > 20
