"""Conversations as budgeted windows of formatted turns, with a loss mask; DataFrame functions only.

A turn is written `<s>[INST] role [/INST]text</s>`. Inside a role or text every
control string gets a backslash after its first character (`</s>` becomes
`<\\/s>`), and one that already looks escaped gets one more, so that taking one
backslash away gives back the very text.

Turns are ordered by (turn, role, text), null first. Prefix sums of their
estimated tokens (a token per four characters and eight for the markers) choose
the spans: turns that lie between two multiples of the span budget make a span,
and a turn that crosses a multiple is a span of its own. Spans are aligned to
turns, none is cut; only a turn longer than the budget makes a span longer than it. A window is the conversation's first system turn, the last
turns before the span within a history limit, and the span; repeated turns stay
out of the loss mask, so each assistant text is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mendery.llm.common import read

#: The template's control strings.
OPEN, ROLE, BODY, CLOSE = "<s>", "[INST] ", " [/INST]", "</s>"
_CONTROL = r"/?s>|/?INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\({_CONTROL})", "$1$2$3")


def windows(df: DataFrame, span_tokens: int = 384, history_turns: int = 2, history_tokens: int = 96, block_turns: int = 256) -> DataFrame:
    """Windows of all conversations: conv_id, window, formatted, loss, n_repeated, n_new.

    `df` has conv_id, turn, role, text; other columns play no part. Null roles and
    texts count as empty, a null conv_id is a conversation of its own, repeated
    rows are turns like others, an empty table has no windows. `loss` holds
    (start, end) character offsets of the escaped assistant texts of the span;
    the first `n_repeated` turns of a window are repeated ones.

    Ranks and prefix sums are taken within blocks of `block_turns` turn numbers
    and shifted by the sums of the blocks before, and history is fetched by
    (conversation, ordinal): a very long conversation is spread over tasks.
    """
    t = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumns({"block": F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(2**62))), "tokens": F.ceil(F.length("text") / 4) + 8})
    in_block = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = t.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("m"))
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(a) for c, a in (("n", "n0"), ("m", "m0"))])
    t = t.withColumns({"k": F.count("*").over(in_block), "upto": F.sum("tokens").over(in_block)}).alias("t").join(sums.alias("b"), F.col("t.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("t.block") == F.col("b.block")))
    t = t.select("t.conv_id", "role", "text", "tokens", (F.col("n0") + F.col("k") - 1).alias("ord"), (F.col("m0") + F.col("upto")).alias("end"))
    at = F.floor((F.col("end") - F.col("tokens")) / span_tokens)
    crosses = at < F.floor((F.col("end") - 1) / span_tokens)
    t = t.select("conv_id", "role", "text", "tokens", "ord", (2 * at + crosses.cast("long")).alias("window"))

    spans = t.groupBy("conv_id", "window").agg(F.min("ord").alias("first"))
    asked = spans.withColumn("ord", F.explode(F.sequence(F.greatest(F.col("first") - history_turns, F.lit(0)), F.col("first") - 1))).filter("first > 0")
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    history = asked.alias("a").join(t.alias("t"), same("a", "t") & (F.col("a.ord") == F.col("t.ord"))).select("a.conv_id", "a.window", "a.first", "a.ord", "role", "text", "tokens")
    near = W.partitionBy("conv_id", "window").orderBy(F.desc("ord")).rowsBetween(W.unboundedPreceding, W.currentRow)
    history = history.withColumn("far", F.sum("tokens").over(near)).filter(F.col("far") <= history_tokens)
    system = t.filter("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("ord", "role", "text")).alias("s"))
    kept = spans.alias("a").join(system.alias("s"), same("a", "s")).filter(F.col("s.ord") < F.col("first")).select("a.conv_id", "window", "s.ord", "s.role", "s.text")

    new = lambda x: F.lit(x).alias("new")
    rows = t.select("conv_id", "window", "ord", "role", "text", new(True))
    rows = rows.unionByName(kept.select("conv_id", "window", "ord", "role", "text", new(False))).unionByName(history.select("conv_id", "window", "ord", "role", "text", new(False)))
    # a system turn within the history is there twice: once is enough
    rows = rows.select("conv_id", "window", F.struct("ord", "new", "role", "text").alias("x")).groupBy("conv_id", "window").agg(F.array_sort(F.collect_set("x")).alias("turns"))
    head = F.transform("turns", lambda x: F.concat(F.lit(OPEN + ROLE), escape(x["role"]), F.lit(BODY)))
    body = F.transform("turns", lambda x: escape(x["text"]))
    rows = rows.withColumns({"head": head, "body": body})
    parts = F.zip_with("head", "body", lambda h, b: F.concat(h, b, F.lit(CLOSE)))
    # offsets of each turn's start: running sums over the window's few turns
    ends = F.aggregate(F.transform("parts", lambda p: F.length(p)), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = rows.withColumn("parts", parts).withColumn("at", ends)
    spots = F.transform("turns", lambda x, i: F.struct((x["new"] & (x["role"] == "assistant")).alias("on"), (F.get("at", i) + F.length(F.get("head", i))).alias("start"), (F.get("at", i + 1) - len(CLOSE)).alias("end")))
    loss = F.transform(F.filter(spots, lambda s: s["on"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    repeated = F.size(F.filter("turns", lambda x: ~x["new"]))
    return rows.select("conv_id", "window", F.concat_ws("", "parts").alias("formatted"), loss.alias("loss"), repeated.alias("n_repeated"), (F.size("turns") - repeated).alias("n_new"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The conversations again, from windows(): conv_id, n_turns, turns_text, loss_text, formatted_chars.

    turns_text is role, newline, text, newline for each turn in order; loss_text
    all text under the mask. Both are unescaped. One row holds one conversation.
    """
    turns = F.slice(F.split(F.col("formatted"), CLOSE, -1), F.col("n_repeated") + 1, F.col("n_new"))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, BODY, 1)
        return F.concat(unescape(F.substr(role, F.lit(len(OPEN + ROLE) + 1))), F.lit("\n"), unescape(F.substr(p, F.length(role) + len(BODY) + 1)), F.lit("\n"))

    masked = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    each = formatted.select("conv_id", "window", "n_new", F.length("formatted").cast("long").alias("chars"), F.concat_ws("", F.transform(turns, turn)).alias("turns"), F.concat_ws("", masked).alias("loss"))
    whole = each.groupBy("conv_id").agg(F.sum("n_new").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", F.concat_ws("", "w.turns").alias("turns_text"), F.concat_ws("", "w.loss").alias("loss_text"), "formatted_chars")


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted in windows and read back."""
    extra = spark.sql("SELECT cast(-1 as long) AS conv_id, cast(t as long) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS x(t, r)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(windows(rows))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select("conv_id", "n_turns", digest("turns_text").alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), digest("loss_text").alias("loss_sha256"), "formatted_chars")


#: The same windows' sums in DuckDB; a repeated turn counts by its ordinal.
ORACLE_OP8 = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, CAST(ceil(length(text) / 4.0) + 8 AS BIGINT) AS tokens, row_number() OVER w - 1 AS ord FROM src WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY ord) AS upto FROM o),
t AS (SELECT *, CASE WHEN (upto - tokens) // 384 < (upto - 1) // 384 THEN 'turn ' || ord ELSE 'block ' || ((upto - tokens) // 384) END AS win,
  length('<s>[INST] ' || regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g') || ' [/INST]' || regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g') || '</s>') AS chars FROM e),
s AS (SELECT conv_id, win, min(ord) AS first FROM t GROUP BY conv_id, win),
h AS (SELECT s.conv_id, s.win, t.ord, t.chars, sum(t.tokens) OVER (PARTITION BY s.conv_id, s.win ORDER BY t.ord DESC) AS far
  FROM s JOIN t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.ord BETWEEN s.first - 2 AND s.first - 1),
y AS (SELECT conv_id, arg_min(ord, ord) AS ord, arg_min(chars, ord) AS chars FROM t WHERE role = 'system' GROUP BY conv_id),
again AS (SELECT conv_id, win, ord, chars FROM h WHERE far <= 96
  UNION SELECT s.conv_id, s.win, y.ord, y.chars FROM s JOIN y ON y.conv_id IS NOT DISTINCT FROM s.conv_id AND y.ord < s.first),
f AS (SELECT conv_id, sum(chars) AS chars FROM (SELECT conv_id, chars FROM again UNION ALL SELECT conv_id, chars FROM t) GROUP BY conv_id)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY ord) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(any_value(f.chars) AS BIGINT) AS formatted_chars
FROM t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY t.conv_id
"""
