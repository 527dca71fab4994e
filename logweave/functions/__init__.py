"""Name functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_module(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def dotted(name: Column) -> Column:
    return F.replace(name, F.lit("::"), F.lit("."))


def underscored(name: Column) -> Column:
    # fixed values: the two patterns decide which names come out
    split = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.translate(split, "-", "_"))


def message_type(name: Column) -> Column:
    return underscored(dotted(name))


def method_name(name: Column) -> Column:
    return underscored(last_module(name))


def prefixed_type(prefix: Column, name: Column) -> Column:
    return F.lower(F.concat_ws(".", prefix, name))


def class_name(snake: Column) -> Column:
    """snake_case to ClassName."""
    return F.replace(F.initcap(F.replace(snake, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def step_key(name: Column, args: Column) -> Column:
    """Key of a workflow step, as ``reactors.step_key`` has it: the same in every process. ``args``: JSON of the arguments' array."""
    return F.sha2(F.concat(F.lit('{"name":'), F.regexp_extract(F.to_json(F.array(name)), r"^\[(.*)\]$", 1), F.lit(',"args":'), args, F.lit("}")), 256)


def handler_method(prefix: Column, type_: Column) -> Column:
    """Name of the method that handles a message type: the prefix, and the type with what isn't a word character as ``_``."""
    return F.concat_ws("_", prefix, F.regexp_replace(F.lower(type_), "[^a-z0-9_]+", "_"))


def joined_types(types: Column) -> Column:
    """Distinct types, in order, as one line."""
    return F.array_join(F.array_distinct(types), ",")


def split_types(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, ","), F.trim), lambda t: t != "")


def new_id(prefix: str = "") -> Column:
    """A random id for live use; batch queries derive ids instead, so that they can be done again."""
    return F.concat(F.lit(prefix), F.uuid()) if prefix else F.uuid()


def string_keys(json: Column) -> Column:
    """A JSON object as a map of its top-level fields, values as JSON."""
    return F.from_json(json, "map<string,string>")
