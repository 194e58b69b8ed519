"""Canonical JSON as column expressions: sorted keys, no blanks, numbers in their shortest form.

What two programs hash has to be the same text. Spark's to_json keeps the order of fields, drops
nulls and writes 1.0E16, so the text is built from the column's type instead, at every depth.
A double that isn't finite has no JSON form: the whole text is null then.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Escapes with a letter of their own; other control characters are \\u00xx. Fixed values of JSON.
_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def _hex(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def text(s: Column, ascii_only: bool = False) -> Column:
    """A JSON string. With ascii_only everything from 0x7F on is \\uxxxx, in two halves above 0xFFFF."""
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(_SHORT.get(code, f"\\u{code:04x}")))
    out = F.when(s.rlike(r'[\x00-\x1f"\\]'), out).otherwise(s)
    if ascii_only:

        def one(c):
            code = F.ascii(c)
            pair = F.concat(_hex(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), _hex(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)))
            return F.when(code < 0x7F, c).when(code < 0x10000, _hex(code)).otherwise(pair)

        out = F.when(out.rlike(r"[^\x00-\x7e]"), F.array_join(F.transform(F.split(out, ""), one), "")).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def number(x: Column) -> Column:
    """A double in the fewest digits that give it back: plain from 1e-4 up to 1e16, with an exponent of two digits at least beyond."""
    # the JVM's own digits may be one too many: rounded to fewer they are tried first
    tried = lambda digits: F.coalesce(*[F.when(r.try_cast("double") == x, r) for r in (F.format_string(f"%.{n}e", x) for n in digits)], F.format_string("%.16e", x))
    # above 2**53 they can lie halfway between two roundings, where the integer itself decides; the least doubles have few digits
    long = F.abs(x).try_cast("long")
    near = F.coalesce(*[F.when(r.cast("double") == F.abs(x), r) for r in (F.round(long, -k) for k in (4, 3, 2, 1))], long).cast("string")
    exact = F.concat(F.substring(near, 1, 1), F.lit("."), F.substring(near, 2, 20), F.lit("e+"), F.length(near) - 1)
    fewest = F.when(F.abs(x).between(2.0**53, 9e18), exact).when(F.abs(x) < 1e-307, tried(range(16))).otherwise(tried((14, 15)))
    whole = F.struct(F.regexp_replace(F.regexp_extract(fewest, r"^-?([0-9.]+)e", 1), r"\.?0*$", "").alias("d"), F.regexp_extract(fewest, r"e([+-][0-9]+)$", 1).cast("int").alias("e"))

    def laid(v):
        d, e = F.replace(v["d"], F.lit("."), F.lit("")), v["e"]
        n, zeros = F.length(d), lambda k: F.repeat(F.lit("0"), k)
        fraction = F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise("")
        power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        return (
            F.when((e < -4) | (e >= 16), F.concat(F.substring(d, 1, 1), fraction, F.lit("e"), power))
            .when(e >= n - 1, F.concat(d, zeros(e - n + 1), F.lit(".0")))
            .when(e >= 0, F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, n)))
            .otherwise(F.concat(F.lit("0."), zeros(-e - 1), d))
        )

    body = F.transform(F.array(whole), laid)[0]
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.concat(sign, F.when(x == 0, "0.0").otherwise(body)))


def raw_number(token: Column) -> Column:
    """A number as it stands in a JSON text: an integer keeps its digits, anything else is a double."""
    return F.when(token.rlike(r"^-?(0|[1-9][0-9]*)$"), F.when(token == "-0", "0").otherwise(token)).otherwise(number(token.try_cast("double")))


def canonical(value: Column, kind: T.DataType, ascii_only: bool = False) -> Column:
    """value, of type kind, as canonical JSON. Keys are in order of code points; nulls are null, dates ISO texts."""
    inner = lambda v, k: canonical(v, k, ascii_only)
    joined = lambda parts, a, b: F.concat(F.lit(a), *[p for i, part in enumerate(parts) for p in ([F.lit(",")] if i else []) + [part]], F.lit(b))
    # array_join leaves nulls out: an element without JSON form makes the list null
    listed = lambda parts, a, b: F.when(~F.exists(parts, lambda p: p.isNull()), F.concat(F.lit(a), F.array_join(parts, ","), F.lit(b)))
    match kind:
        case T.StructType():
            out = joined([F.concat(text(F.lit(f.name), ascii_only), F.lit(":"), inner(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)], "{", "}")
        case T.MapType():
            # array_sort compares keys by their bytes, that is by code point
            entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
            out = listed(F.transform(entries, lambda e: F.concat(text(e["key"], ascii_only), F.lit(":"), inner(e["value"], kind.valueType))), "{", "}")
        case T.ArrayType():
            out = listed(F.transform(value, lambda v: inner(v, kind.elementType)), "[", "]")
        case T.DoubleType() | T.FloatType():
            out = number(value.cast("double"))
        case T.IntegralType() | T.BooleanType():
            out = value.cast("string")
        case T.DateType():
            out = text(F.date_format(value, "yyyy-MM-dd"))
        case T.StringType():
            out = text(value, ascii_only)
        case _:
            raise TypeError(f"no canonical JSON for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


def digest(json_text: Column) -> Column:
    return F.sha2(json_text.cast("binary"), 256)
