"""Target types: what a text column is to be decoded into."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T


class Spec:
    """Base of all target types."""

    def optional(self) -> Optional:
        return Optional(self)

    def nullable(self) -> Nullable:
        return Nullable(self)

    def require(self, name: str, test: Callable[[Any], bool]) -> Check:
        """A hard constraint: values that fail it are errors."""
        return Check(self, name, test, True)

    def check(self, name: str, test: Callable[[Any], bool]) -> Check:
        """A soft constraint: its outcome is reported beside the value."""
        return Check(self, name, test, False)


@dataclass(frozen=True)
class String(Spec):
    pass


@dataclass(frozen=True)
class Number(Spec):
    pass


@dataclass(frozen=True)
class Bool(Spec):
    pass


@dataclass(frozen=True)
class Null(Spec):
    pass


@dataclass(frozen=True)
class Literal(Spec):
    value: str | float | bool


@dataclass(frozen=True)
class Enum(Spec):
    """One of `values`; `aliases` maps other spellings to a value."""

    values: tuple[str, ...]
    aliases: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Array(Spec):
    item: Spec


@dataclass(frozen=True)
class Field:
    """`done`: null until the value is complete. `not_null`: an object without a value here is an error."""

    name: str
    spec: Spec
    aliases: tuple[str, ...] = ()
    done: bool = False
    not_null: bool = False


@dataclass(frozen=True)
class Struct(Spec):
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Map(Spec):
    key: Spec
    value: Spec


@dataclass(frozen=True)
class Union(Spec):
    options: tuple[Spec, ...]


@dataclass(frozen=True)
class Tagged(Spec):
    """Structs told apart by a literal field."""

    tag: str
    options: tuple[Struct, ...]


@dataclass(frozen=True)
class Optional(Spec):
    item: Spec


@dataclass(frozen=True)
class Nullable(Spec):
    item: Spec


@dataclass(frozen=True)
class Lazy(Spec):
    """A recursive type, by name; `get` gives it."""

    name: str
    get: Callable[[], Spec] = field(hash=False, compare=False)


@dataclass(frozen=True)
class State(Spec):
    """A value with its state while text arrives: Pending, Incomplete or Complete."""

    item: Spec


@dataclass(frozen=True)
class Check(Spec):
    item: Spec
    name: str
    test: Callable[[Any], bool] = field(hash=False, compare=False)
    hard: bool = True


string, number, boolean, null = String(), Number(), Bool(), Null()


def literal(value: str | float | bool) -> Literal:
    return Literal(value)


def enum(*values: str, aliases: dict[str, str] | None = None) -> Enum:
    return Enum(values, aliases or {})


def array(item: Spec) -> Array:
    return Array(item)


def struct(fields: dict[str, Spec | Field] | None = None, **more: Spec | Field) -> Struct:
    both = (fields or {}) | more
    return Struct(tuple(replace(s, name=n) if isinstance(s, Field) else Field(n, s) for n, s in both.items()))


def alias(spec: Spec, *names: str, done: bool = False, not_null: bool = False) -> Field:
    """A field with other names that its key may have in the text, and stream directives."""
    return Field("", spec, names, done, not_null)


def mapping(key: Spec, value: Spec | None = None) -> Map:
    """A map; with one argument it is the values' type."""
    return Map(String(), key) if value is None else Map(key, value)


def union(*options: Spec) -> Union:
    return Union(options)


def tagged(tag: str, *options: Struct) -> Tagged:
    return Tagged(tag, options)


def core(spec: Spec) -> Spec:
    """The type within optional, nullable, checked and lazy ones."""
    while isinstance(spec, Optional | Nullable | Check | Lazy):
        spec = spec.get() if isinstance(spec, Lazy) else spec.item
    return spec


def spark_type(spec: Spec) -> T.DataType:
    """The column type of a decoded value; unions and recursive types are VARIANT."""
    if isinstance(spec, Lazy | Union | Tagged):
        return T.VariantType()
    if isinstance(spec, Optional | Nullable | Check):
        return spark_type(spec.item)
    if isinstance(spec, State):
        return T.StructType([T.StructField("value", spark_type(spec.item)), T.StructField("state", T.StringType())])
    if isinstance(spec, Number) or isinstance(spec, Literal) and isinstance(spec.value, int | float) and not isinstance(spec.value, bool):
        return T.DoubleType()
    if isinstance(spec, Bool) or isinstance(spec, Literal) and isinstance(spec.value, bool):
        return T.BooleanType()
    if isinstance(spec, Array):
        return T.ArrayType(spark_type(spec.item))
    if isinstance(spec, Struct):
        return T.StructType([T.StructField(f.name, spark_type(f.spec)) for f in spec.fields])
    if isinstance(spec, Map):
        return T.MapType(T.StringType(), spark_type(spec.value))
    return T.StringType()


def from_spark(kind: T.DataType, nullable: bool = True) -> Spec:
    """The target type of a Spark type, as in from_ddl()."""
    if isinstance(kind, T.StructType):
        return Struct(tuple(Field(f.name, Nullable(from_spark(f.dataType)) if f.nullable and nullable else from_spark(f.dataType, nullable)) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return Array(from_spark(kind.elementType, nullable))
    if isinstance(kind, T.MapType):
        return Map(String(), from_spark(kind.valueType, nullable))
    if isinstance(kind, T.BooleanType):
        return Bool()
    if isinstance(kind, T.NumericType):
        return Number()
    return String()


def from_ddl(ddl: str, nullable: bool = False) -> Spec:
    """A struct from a DDL string such as `name string, v double, tags array<string>`; fields are required unless `nullable`."""
    return from_spark(T.StructType.fromDDL(ddl), nullable)
