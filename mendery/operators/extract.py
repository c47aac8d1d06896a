"""Candidates and repairs as columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mendery.kernel.loads import dedent, plain
from mendery.kernel.repair import repair
from mendery.kernel.scan import candidates


def extract_candidates(text: Column) -> Column:
    """array<struct<origin, text, json, complete, fixes>>: fenced blocks, then objects and arrays, in order. For explode()."""

    @F.pandas_udf("array<struct<origin:string,text:string,json:string,complete:boolean,fixes:array<string>>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            return None if t is None else [{"origin": c.origin, "text": c.text, "json": json.dumps(plain(c.node), ensure_ascii=False), "complete": c.node.complete, "fixes": c.fixes} for c in candidates(t)]

        return texts.map(one, na_action="ignore")

    return run(text)


def repair_json(text: Column) -> Column:
    """The text repaired to valid JSON where that is possible; valid JSON passes untouched without Python work."""
    from mendery.functions.scalars import strict_json

    ok = strict_json(text).isNotNull()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: repair(t), na_action="ignore")

    return F.when(ok, F.trim(text)).otherwise(run(F.when(~ok, text)))


def dedent_text(text: Column) -> Column:
    """Without blank edge lines and the indentation that all lines share."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(dedent, na_action="ignore")

    return run(text)
