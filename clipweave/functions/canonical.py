"""Canonical JSON as column expressions, and hashes over it: equal values of nested columns have equal bytes, whatever the order of their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters with an escape of their own; the other controls are written by number.
_NAMED = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _once(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.transform(F.array(value), body)[0]


def json_number(x: Column) -> Column:
    """A double in its shortest form that reads back as itself: positional between 1e-4 and 1e16, else with an exponent of two digits at least."""

    def shortest(forms: list[Column], x: Column) -> Column:
        out = forms[-1]
        for f in reversed(forms[:-1]):
            out = F.when(f.cast("double") == x, f).otherwise(out)
        return out

    def rounded_whole(v: Column, n: int) -> Column:
        """A whole number of 16 to 19 digits to n digits, from its exact value."""
        text = v.cast("string")
        size = F.length(text)
        kept, rest = F.substring(text, 1, n).cast("long"), text.substr(F.lit(n + 1), size)
        half = F.rpad(F.lit("5"), F.greatest(size - n, F.lit(1)), F.lit("0"))
        up = (size > n) & ((rest > half) | ((rest == half) & (kept % 2 == 1)))
        return F.concat((kept + up.cast("long")).cast("string"), F.lit("e"), (F.greatest(size, F.lit(n)) - n).cast("string"))

    def whole(v: Column) -> Column:
        # Read back as digits times a power of ten; laid out from the exponent of the first digit.
        s = shortest([rounded_whole(v, n) for n in (15, 16, 17)], v.cast("double"))
        return _once(s, lambda s: F.concat(F.substring_index(s, "e", 1), F.lit("e"), (F.length(F.substring_index(s, "e", 1)) + F.substring_index(s, "e", -1).cast("int") - 1).cast("string")))

    def form(x: Column) -> Column:
        size = F.abs(x)
        # The first of 15, 16 and 17 digits that reads back; the smallest numbers hold fewer digits, and large whole ones are rounded from their exact value.
        s = F.when(size < 2.3e-308, shortest([F.format_string(f"%.{n}e", x) for n in range(17)], x))
        s = s.when((size >= 2.0**53) & (size < 9.2e18), F.concat(F.when(x < 0, "-").otherwise(""), _once(size.cast("long"), whole)))
        return _once(s.otherwise(shortest([F.format_string(f"%.{n}e", x) for n in (14, 15, 16)], x)), layout)

    def layout(s: Column) -> Column:
        exponent = F.substring_index(s, "e", -1).cast("int")
        digits = F.rtrim(F.regexp_replace(F.substring_index(s, "e", 1), r"[-.]", ""), F.lit("0"))
        return F.concat(F.when(s.startswith("-"), "-").otherwise(""), _once(F.struct(F.when(digits == "", "0").otherwise(digits).alias("d"), exponent.alias("e")), place))

    def place(v: Column) -> Column:
        d, e = v["d"], v["e"]
        n = F.length(d)
        whole = F.concat(F.substring(F.rpad(d, 17, "0"), 1, 17), F.lit("00"))
        above = F.concat(whole.substr(F.lit(1), e + 1), F.lit("."), F.when(n > e + 1, d.substr(e + 2, n)).otherwise("0"))
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        tail = F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        far = F.concat(d.substr(F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), d.substr(F.lit(2), n))).otherwise(""), tail)
        return F.when((e >= 0) & (e < 16), above).when((e < 0) & (e >= -4), below).otherwise(far)

    x = x.cast("double")
    zero = F.when(x.cast("string").startswith("-"), "-0.0").otherwise("0.0")
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(x == 0, zero).otherwise(_once(x, form))


def _code(c: Column) -> Column:
    """The escape of a code point by number: one of four digits, or a pair of surrogates."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    over = c - 0x10000
    return F.when(c < 0x10000, unit(c)).otherwise(F.concat(unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(0x3FF) + 0xDC00)))


def json_string(s: Column, ascii: bool = False) -> Column:
    """A string in quotes, escaped; ``ascii`` writes all other characters by number as well."""
    out = s
    for c, escaped in _NAMED.items():
        out = F.replace(out, F.lit(c), F.lit(escaped))
    rare = r"[\x00-\x1f]" if not ascii else r"[^\x20-\x7e]"
    by_number = lambda c: F.when((F.ascii(c) < 0x20) | (F.ascii(c) > (0x7E if ascii else 0x10FFFF)), _code(F.ascii(c))).otherwise(c)
    out = F.when(out.rlike(rare), F.array_join(F.transform(F.split(out, ""), by_number), "")).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def _key(name: str, ascii: bool) -> Column:
    return F.concat(json_string(F.lit(name), ascii), F.lit(":"))


def canonical_json(value: Column, kind: T.DataType, ascii: bool = False, omit_nulls: bool = False) -> Column:
    """``value`` of type ``kind`` as compact JSON with the keys of structs and maps in order of code points at every depth.

    A null is ``null``, also within arrays; ``omit_nulls`` leaves null fields of structs out, for structs that stand for records of several shapes. Numbers are whole or doubles;
    other types (dates, decimals, bytes) have no one form and are refused: cast them first.
    """
    inner = lambda v, k: canonical_json(v, k, ascii, omit_nulls)
    if isinstance(kind, T.StructType):
        fields = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            v = value[f.name]
            text = F.concat(_key(f.name, ascii), inner(v, f.dataType))
            fields.append(F.when(v.isNotNull(), text) if omit_nulls else text)
        out = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ",") if fields else F.lit(""), F.lit("}"))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError(f"keys of JSON objects are strings, not {kind.keyType.simpleString()}")
        pairs = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(json_string(k, ascii), F.lit(":"), inner(F.element_at(value, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: inner(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        out = json_string(value, ascii)
    elif isinstance(kind, T.BooleanType):
        out = F.when(value, "true").otherwise("false")
    elif isinstance(kind, _WHOLE):
        out = value.cast("string")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = json_number(value)
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON form")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)


def canonical_hash(value: Column, kind: T.DataType, ascii: bool = True) -> Column:
    """The SHA-256 of canonical JSON, in hex."""
    return F.sha2(canonical_json(value, kind, ascii), 256)


def config_digest(value: Column, kind: T.StructType, own: str = "config_hash") -> Column:
    """``sha256:`` and the hash of a configuration without the field that holds it."""
    rest = T.StructType([f for f in kind.fields if f.name != own])
    bare = F.when(value.isNotNull(), F.struct(*[value[f.name].alias(f.name) for f in rest.fields]))
    return F.concat(F.lit("sha256:"), canonical_hash(bare, rest))


def recipe_json(ops: Column, kind: T.ArrayType) -> Column:
    """A list of edits, each with the fields it has, as the canonical recipe of version 1."""
    return F.concat(F.lit('{"ops":'), canonical_json(ops, kind, omit_nulls=True), F.lit(',"schema_version":1}'))


def revision_hash(source: Column, ops: Column, kind: T.ArrayType, prefix: str, renderer: str) -> Column:
    """The key of a rendered revision: the SHA-256 of prefix, source hash, renderer and recipe, a line each; null without edits."""
    return F.when(F.size(ops) > 0, F.sha2(F.concat(F.lit(prefix + "\n"), source, F.lit("\n" + renderer + "\n"), recipe_json(ops, kind)), 256))


def identity_hash(size: Column, chunk_hashes: Column) -> Column:
    """The SHA-256 of a size in eight bytes and the digests of a file's chunks, given in hex."""
    return F.sha2(F.unhex(F.concat(F.lpad(F.hex(size.cast("long")), 16, "0"), F.array_join(chunk_hashes, ""))), 256)
