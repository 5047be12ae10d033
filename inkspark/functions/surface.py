"""Functions and table functions registered with a session, for queries in SQL text.

What Spark's own expressions can say is a SQL function and runs in the JVM. Splits and parsers that follow a text from its
start are table functions over Arrow arrays, for lateral joins; folds over Unicode are Arrow functions.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkspark.functions.pieces import narration_pieces, speech_pieces, title_form
from inkspark.plans.structure import soft_split
from inkspark.sources.markup import page_blocks, page_links

#: JSON text of an array of numbers as doubles; null for any other JSON, and for no JSON.
NUMBERS = """CASE WHEN schema_of_variant(try_parse_json({0})) RLIKE '^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL.*)>$'
  AND forall(try_variant_get(try_parse_json({0}), '$', 'array<double>'), x -> x IS NOT NULL) THEN try_variant_get(try_parse_json({0}), '$', 'array<double>') END"""
DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), DOUBLE(0), (s, x) -> s + x)"
SQL_FUNCTIONS = {
    "json_numbers(doc STRING) RETURNS ARRAY<DOUBLE>": NUMBERS.format("doc"),
    # Null for arrays that are empty, of other lengths, without length, or whose products leave the range of doubles.
    "array_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        f"CASE WHEN size(a) > 0 AND size(a) = size(b) AND {DOT.format('a', 'a')} * {DOT.format('b', 'b')} > 0 AND {DOT.format('a', 'a')} * {DOT.format('b', 'b')} < DOUBLE('Infinity') "
        f"THEN {DOT.format('a', 'b')} / (sqrt({DOT.format('a', 'a')}) * sqrt({DOT.format('b', 'b')})) END",
    "json_cosine(a STRING, b STRING) RETURNS DOUBLE": "array_cosine(json_numbers(a), json_numbers(b))",
}


def canonical(text: str | None) -> str | None:
    """JSON with keys in order of code points and no spaces; null for what is no JSON. Numbers and nulls stay as they are written."""
    try:
        doc = json.loads(text, parse_float=Number, parse_int=Number) if text is not None else None
    except ValueError:
        return None
    return None if text is None else written(doc)


class Number(str):
    """A number as it is written."""


def written(doc) -> str:
    if isinstance(doc, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(doc[k])}" for k in sorted(doc)) + "}"
    if isinstance(doc, list):
        return "[" + ",".join(map(written, doc)) + "]"
    return str(doc) if isinstance(doc, Number) else json.dumps(doc, ensure_ascii=False)


def of_strings(f):
    """An Arrow function of strings from one of a string."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def digest(text: str) -> str | None:
    doc = canonical(text)
    return None if doc is None else hashlib.sha256(unicodedata.normalize("NFC", doc).encode()).hexdigest()


def hard_pieces(text: str, most: int):
    """(piece) of ``most`` UTF-16 units, one at least; a cut that would split a pair falls before it."""
    wide = text.encode("utf-16-le", "surrogatepass")
    units = len(wide) // 2
    split = lambda at: 0 < at < units and 0xDC <= wide[2 * at + 1] <= 0xDF
    cuts = [min(at, units) - split(at) for at in range(0, max(units, 1) + most, most)]
    return ((wide[2 * a : 2 * b].decode("utf-16-le", "surrogatepass"),) for a, b in zip(cuts, cuts[1:]))


def table_function(schema: pa.Schema, read):
    """A table function of (text[, numbers]) with (ordinal, columns): a row for each tuple that ``read`` gives for a text."""
    kinds = {pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}
    out = pa.schema([pa.field("ordinal", pa.int32()), *schema])

    class Reader:
        def eval(self, text, *given):
            for ordinal, row in enumerate([] if text is None else read(text, *given)):
                yield (ordinal, *row)

    return F.udtf(Reader, returnType=", ".join(f"{f.name} {kinds[f.type]}" for f in out), useArrow=True)


def fields(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


#: Arrow functions and table functions by name; null texts give null, or no rows.
FUNCTIONS = {"canonical_json": canonical, "canonical_json_sha256": digest, "title_key": title_form}
TABLE_FUNCTIONS = {
    "hard_pieces": (fields(piece=pa.string()), hard_pieces),
    "soft_pieces": (fields(start=pa.int32(), finish=pa.int32()), lambda text, most: soft_split(text, most)),
    "speech_pieces": (fields(piece=pa.string()), lambda text, most: ((p,) for p in speech_pieces(text, most))),
    "narration_pieces": (fields(piece=pa.string()), lambda text, most: ((p,) for p in narration_pieces(text, most))),
    "page_blocks": (fields(kind=pa.string(), text=pa.string(), level=pa.int32(), flattened=pa.bool_()), page_blocks),
    "page_links": (fields(depth=pa.int32(), label=pa.string(), href=pa.string()), page_links),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions as temporary ones of the session, replacing those of before, and gives their names."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, of_strings(f))
    for name, (schema, read) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, table_function(schema, read))
    return [head.split("(")[0] for head in SQL_FUNCTIONS] + [*FUNCTIONS, *TABLE_FUNCTIONS]
