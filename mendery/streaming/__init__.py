"""Texts that arrive in chunks: keyed accumulation, decoded as they grow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mendery.operators.decode import parse
from mendery.types import Spec

_OUT = "key string, text string, n_chunks long, final boolean"


def accumulate(chunks: DataFrame, key: str, seq: str, chunk: str, last: str, idle: str = "10 minutes", ts: str = "ts", max_chars: int | None = None) -> DataFrame:
    """The text of each key so far after every micro-batch: key, text, n_chunks, final.

    `chunks` is a stream with a watermark on `ts`. Chunks are put together by
    `seq`, however late they come; state holds those of open keys. A text is final
    when the chunk marked `last` and all before it are there, or when the key was
    idle for `idle` behind the watermark; its state then goes. Texts are whole
    whatever their length: a key whose chunks hold more than `max_chars` characters
    fails the stream, None sets no limit.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts: dict[int, str] = {}
        end = -1
        if state.exists:
            seqs, texts, end = state.get
            parts = dict(zip(list(seqs), list(texts), strict=True))
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], "".join(parts[i] for i in sorted(parts)), len(parts), True)], columns=["key", "text", "n_chunks", "final"])
            return
        newest = 0
        for f in frames:
            for i, t, fin, when in zip(f["seq"], f["chunk"], f["last"], f["ts"], strict=True):
                parts[int(i)] = t if isinstance(t, str) else ""
                end = int(i) if fin else end
                newest = max(newest, int(pd.Timestamp(when).timestamp() * 1000))
        if max_chars is not None and (held := sum(map(len, parts.values()))) > max_chars:
            raise ValueError(f"key {k[0]!r} holds {held} characters, more than max_chars = {max_chars}")
        run = []
        while len(run) in parts:
            run.append(parts[len(run)])
        text = "".join(run)
        final = 0 <= end < len(run)
        if final:
            if state.exists:
                state.remove()
        else:
            order = sorted(parts)
            state.update((order, [parts[i] for i in order], end))
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1) + idle_ms)
        yield pd.DataFrame([(k[0], text, len(parts), final)], columns=["key", "text", "n_chunks", "final"])

    named = chunks.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(chunk).alias("chunk"), F.col(last).alias("last"), F.col(ts).alias("ts"))
    return named.groupBy("key").applyInPandasWithState(step, _OUT, "seqs array<long>, texts array<string>, last long", "append", GroupStateTimeout.EventTimeTimeout)


def decode_stream(chunks: DataFrame, spec: Spec, key: str, seq: str, chunk: str, last: str, **more) -> DataFrame:
    """accumulate(), each text decoded as far as it has come: key, n_chunks, final, parsed."""
    keep = {k: more.pop(k) for k in ("idle", "ts", "max_chars") if k in more}
    # Python functions need rows of a projection, not those that the state operator makes
    rows = accumulate(chunks, key, seq, chunk, last, **keep).select("key", F.coalesce("text", F.lit("")).alias("text"), "n_chunks", "final")
    return rows.select("key", "n_chunks", "final", parse(F.col("text"), spec, allow_partial=True, **more).alias("parsed"))
