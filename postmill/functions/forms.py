"""What a request carries, as columns: query strings, JSON bodies without nulls, and maps of the text parts of a form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def query_string(params: Column) -> Column:
    """A map of texts as ``key=value&key=value`` in the order of the map, encoded as forms are (a blank is a plus).

    An entry without a value is left out; a null or empty map gives an empty text."""
    entries = F.filter(F.map_entries(params), lambda e: e.value.isNotNull())
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(F.url_encode(e.key), F.lit("="), F.url_encode(e.value))), "&"), F.lit(""))


def with_query(path: Column, params: Column) -> Column:
    """A path with its query string, and the path alone where that is empty."""
    query = query_string(params)
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def without_nulls(value: Column, kind: T.DataType) -> Column:
    """The value without null elements of lists and null values of maps, at any depth (null fields go when JSON is written)."""
    if isinstance(kind, T.ArrayType):
        return F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: without_nulls(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(value, lambda _, v: v.isNotNull()), lambda _, v: without_nulls(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(without_nulls(value.getField(f.name), f.dataType).alias(f.name) for f in kind)))
    return value


def json_body(value: Column, kind: T.DataType) -> Column:
    """The JSON of a struct, map or list of this type without nulls at any depth; emptied lists and objects stay. Null stays null."""
    return F.to_json(without_nulls(value, kind), {"ignoreNullFields": "true"})


def text_parts(parts: Column) -> Column:
    """Parts of a form, array<struct<name, text>>, as a map from name to text.

    Parts without a name, or a blank one, are left out; of equal names the last one counts; a null text is empty. A null
    list, or one without named parts, gives an empty map."""
    named = F.reverse(F.filter(parts, lambda p: F.coalesce(F.trim(p["name"]), F.lit("")) != ""))
    names = F.transform(named, lambda p: p["name"])
    last = F.filter(named, lambda p, i: F.array_position(names, p["name"]) == i + 1)
    made = F.map_from_entries(F.transform(last, lambda p: F.struct(p["name"], F.coalesce(p["text"], F.lit("")))))
    return F.coalesce(made, F.create_map().cast("map<string,string>"))
