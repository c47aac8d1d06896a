"""Schema-directed decoding of messy, JSON-like text columns on Spark."""

from mendery import types
from mendery.kernel.cascade import Options, decode
from mendery.operators.decode import LenientParser, parse, value
from mendery.operators.extract import dedent_text, extract_candidates, repair_json

__all__ = ["LenientParser", "Options", "decode", "dedent_text", "extract_candidates", "parse", "repair_json", "types", "value"]
