"""Untrusted JSON to typed values, and what is derived from a segment.

A typed segment is a struct (name, type, char, sequence, length, empty): strings are "" unless they
were strings, ``length`` is null unless it was an integer (true and false count as 1 and 0), and
``empty`` tells that the object had no keys.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import filled, strip

# The region that a placeholder letter stands for.
LETTER_REGIONS = {
    "B": "barcode",
    "U": "umi",
    "I": "index",
    "L": "ligation",
    "R": "rt_barcode",
    "T": "tn5_barcode",
    "X": "linker",
    "V": "capture",
}

SEGMENT = "struct<name:string,type:string,char:string,sequence:string,length:bigint,empty:boolean>"


def _kind(value: str, path: str) -> str:
    return f"schema_of_variant(variant_get({value}, '{path}', 'variant'))"


def string_at(value: str, path: str) -> str:
    """SQL: the string at a path of a VARIANT, "" if there is none."""
    return f"if({_kind(value, path)} = 'STRING', variant_get({value}, '{path}', 'string'), '')"


def object_at(value: str, path: str) -> str:
    """SQL: the object at a path, {} if there is none."""
    return f"if({_kind(value, path)} LIKE 'OBJECT%', variant_get({value}, '{path}', 'variant'), parse_json('{{}}'))"


def integer_at(value: str, path: str) -> str:
    """SQL: the integer at a path; booleans count, other types give null."""
    return f"CASE {_kind(value, path)} WHEN 'BIGINT' THEN variant_get({value}, '{path}', 'bigint') WHEN 'BOOLEAN' THEN cast(variant_get({value}, '{path}', 'boolean') AS bigint) END"


def objects_at(value: str, path: str) -> str:
    """SQL: the objects of the list at a path, other elements left out; an empty array if it is no list."""
    return f"filter(if({_kind(value, path)} LIKE 'ARRAY%', cast(variant_get({value}, '{path}', 'variant') AS array<variant>), cast(array() AS array<variant>)), x -> coalesce(schema_of_variant(x) LIKE 'OBJECT%', false))"


def segments_at(value: str, path: str) -> str:
    """SQL: the typed segments at a path."""
    fields = ", ".join(f"'{k}', {string_at('s', '$.' + k)}" for k in ("name", "type", "char", "sequence"))
    return f"transform({objects_at(value, path)}, s -> named_struct({fields}, 'length', {integer_at('s', '$.length')}, 'empty', schema_of_variant(s) = 'OBJECT<>'))"


def letter(segment: Column) -> Column:
    return F.coalesce(F.upper(strip(segment["char"])), F.lit(""))


def region(segment: Column) -> Column:
    """By the letter, else by the declared type, else unknown; missing for no or an empty segment."""
    letters = F.create_map(*(F.lit(x) for pair in LETTER_REGIONS.items() for x in pair))
    found = F.coalesce(F.try_element_at(letters, letter(segment)), filled(F.lower(strip(segment["type"]))), F.lit("unknown"))
    return F.when(segment.isNull() | segment["empty"], F.lit("missing")).otherwise(found)


def segment_length(segment: Column) -> Column:
    """The declared length if it is an integer, else the sequence's."""
    own = F.coalesce(segment["length"], F.length(segment["sequence"]).cast("long"), F.lit(0).cast("long"))
    return F.when(segment.isNull() | segment["empty"], F.lit(0).cast("long")).otherwise(own)


#: The parts of a JSON text: strings, numbers, the three words, and the marks between.
JSON_PARTS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*|[a-z]+|[^\s]'


def _plain_number(x: Column) -> Column:
    """One text for all JSON numbers of one value, and for true and false those of 1 and 0."""
    number = x.try_cast("double")
    whole = F.when(F.abs(number) < 1e37, F.when(number % 1.0 == 0, number.try_cast("decimal(38,0)").cast("string")))
    integer = F.when(x.rlike("^-?[0-9]+$"), F.when(x == "-0", "0").otherwise(x))
    return F.when(x == "true", "1").when(x == "false", "0").when(x.rlike("^-?[0-9]"), F.coalesce(integer, whole, number.cast("string"))).otherwise(x)


def same_value(left: Column, right: Column) -> Column:
    """Are two JSON texts with keys in one order (as ``to_json`` of a VARIANT has them) equal by value?  Numbers
    are equal whatever their notation, integers exactly and others as doubles, and true and false equal 1 and 0."""
    plain = lambda x: F.transform(F.regexp_extract_all(x, F.lit(JSON_PARTS), 0), _plain_number)
    return F.when(left == right, F.lit(True)).otherwise(plain(left) == plain(right))
