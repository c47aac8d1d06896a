"""parse(): a text column to a typed column.

Valid JSON whose values already have the target's types is decoded by native
expressions. Only other texts reach the kernel, once for each distinct text
of an Arrow batch; it answers with canonical JSON, which native from_json types.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendery.functions import scalars as N
from mendery.kernel.cascade import Options, decode
from mendery.kernel.coerce import FIELD_NAMES, squeeze
from mendery.types import Array, Bool, Enum, Field, Map, Nullable, Number, Optional, Spec, String, Struct, spark_type

_ANSWER = "json string, ok boolean, error string, strategy string, fixes array<string>, complete boolean, checks string"


def kernel_udf(spec: Spec, opts: Options):
    """The kernel as a function of a text column; null for null."""

    @F.pandas_udf(_ANSWER)
    def run(texts: pd.Series) -> pd.DataFrame:
        seen: dict[str, tuple] = {}
        rows = []
        for t in texts:
            if t is None or t != t:
                rows.append((None,) * 7)
                continue
            if t not in seen:
                r = decode(t, spec, opts)
                seen[t] = (r.json, r.ok, r.error, r.strategy, r.fixes, r.complete, json.dumps(r.checks))
            rows.append(seen[t])
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _ANSWER.split(", ")])

    return run


def _path(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def native(v: Column, spec: Spec) -> Column | None:
    """Whether a VARIANT needs no coercion, or nothing if the type isn't native."""
    kind = F.schema_of_variant(v)
    if isinstance(spec, Number):
        # what a double can't hold is the kernel's to refuse
        return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & (F.abs(F.try_variant_get(v, "$", "double")) < float("inf"))
    if isinstance(spec, String):
        return kind == "STRING"
    if isinstance(spec, Bool):
        return kind == "BOOLEAN"
    if isinstance(spec, Enum):
        return (kind == "STRING") & F.try_variant_get(v, "$", "string").isin(*spec.values)
    if isinstance(spec, Nullable | Optional):
        inner = native(v, spec.item)
        return None if inner is None or isinstance(spec.item, Enum) else (kind == "VOID") | inner
    if isinstance(spec, Array):
        if native(v, spec.item) is None:
            return None
        return kind.startswith("ARRAY") & F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda x: native(x, spec.item))
    if isinstance(spec, Map):
        if not isinstance(spec.key, String) or native(v, spec.value) is None:
            return None
        return kind.startswith("OBJECT") & F.forall(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: native(x, spec.value))
    if isinstance(spec, Struct):
        return _native_struct(v, kind, spec)
    return None


def _native_struct(v: Column, kind: Column, spec: Struct) -> Column | None:
    if not spec.fields or any(f.done or f.not_null or native(v, f.spec) is None for f in spec.fields):
        return None
    # another key that could mean a field is the kernel's business
    names = [f.name for f in spec.fields]
    like = sorted({squeeze(n) for f in spec.fields for n in (f.name, *f.aliases, *FIELD_NAMES.get(f.name.lower(), ()))})
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    ok = kind.startswith("OBJECT") & F.forall(keys, lambda k: k.isin(*names) | ~F.lower(F.regexp_replace(k, r"[-_\s]", "")).isin(*like))
    for f in spec.fields:
        at = F.try_variant_get(v, _path(f.name), "variant")
        ok = ok & F.coalesce(native(at, f.spec), F.lit(isinstance(f.spec, Optional)))
    return ok


def fits(text: Column, spec: Spec) -> Column | None:
    """Whether a text is valid JSON whose values have the target's types; nothing if the type isn't native."""
    if native(F.lit(None).cast("variant"), spec) is None:
        return None
    # through an array, so that the text is parsed once
    return F.coalesce(F.transform(F.array(N.strict_json(text)), lambda v: native(v, spec))[0], F.lit(False))


def result_type(spec: Spec) -> T.StructType:
    return T.StructType([T.StructField("v", spark_type(spec))])


def parse(col: Column | str, spec: Spec, native_tier: bool = True, **options) -> Column:
    """struct<value, ok, error, strategy, fixes, complete, checks> of a text column.

    `options` are those of kernel.cascade.Options. A null text is an error without
    a value. With `native_tier` off every text goes to the kernel.
    """
    opts = Options(**options)
    text = F.col(col) if isinstance(col, str) else col
    clean = fits(text, spec) if native_tier else None
    r = kernel_udf(spec, opts)(F.when(~clean, text) if clean is not None else text)
    # the kernel gives nothing for texts that it was not given
    given = r["ok"].isNotNull() | text.isNull() if clean is not None else F.lit(True)
    ok = F.coalesce(r["ok"], ~given)
    return F.struct(
        F.from_json(F.when(given, r["json"]).otherwise(F.concat(F.lit('{"v":'), text, F.lit("}"))), result_type(spec))["v"].alias("value"),
        ok.alias("ok"),
        F.coalesce(r["error"], F.when(text.isNull(), F.lit("no text"))).alias("error"),
        F.when(given, r["strategy"]).otherwise(F.lit("json")).alias("strategy"),
        F.when(given, r["fixes"]).otherwise(F.array().cast("array<string>")).alias("fixes"),
        F.coalesce(r["complete"], ~given).alias("complete"),
        F.from_json(r["checks"], "map<string,boolean>").alias("checks"),
    )


class LenientParser:
    """The same as an object: transform() adds the decoded column to a table."""

    def __init__(self, spec: Spec, **options):
        self.spec, self.options = spec, options

    def transform(self, df: DataFrame, text: str, out: str = "parsed") -> DataFrame:
        return df.withColumn(out, parse(F.col(text), self.spec, **self.options))


def value(col: Column | str, spec: Spec, **options) -> Column:
    """The decoded value alone."""
    return parse(col, spec, **options)["value"]


def field(name: str, spec: Spec) -> Field:
    return Field(name, spec)
