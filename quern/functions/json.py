"""JSON functions of the dialect.  Reading is native; editing, which Spark cannot express, is an Arrow-batched UDF."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"\.\"([^\"]*)\"|\.([^.\[]+)|\[(\d+)\]|\['([^']*)'\]|\[\"([^\"]*)\"\]")


def steps(path: str) -> list[str | int] | None:
    """``$.a[0]['b']`` -> ["a", 0, "b"]; None if it is no path."""
    if not path.startswith("$"):
        return None
    at, out = 1, []
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            return None
        out.append(int(m[3]) if m[3] is not None else next(g for g in (m[1], m[2], m[4], m[5]) if g is not None))
        at = m.end()
    return out


def extract(doc: Column, *paths: str) -> Column:
    """One path: the SQL value as text; several: a JSON array of the values."""
    if len(paths) == 1:
        return F.get_json_object(doc, paths[0])
    return F.concat(F.lit("["), F.array_join(F.array(*[F.coalesce(arrow(doc, p), F.lit("null")) for p in paths]), ","), F.lit("]"))


def arrow(doc: Column, path: str) -> Column:
    """``->``: the value at the path as JSON text."""
    return F.to_json(F.variant_get(F.try_parse_json(doc), path, "variant"))


def arrow2(doc: Column, path: str) -> Column:
    """``->>``: the value at the path as SQL text."""
    return F.get_json_object(doc, path)


def kind(doc: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; null where the path leads nowhere."""
    s = F.schema_of_variant(F.variant_get(F.try_parse_json(doc), path, "variant"))
    value = F.get_json_object(doc, path)
    return (
        F.when(s.isNull(), None).when(s == "VOID", "null").when(s == "BOOLEAN", value).when(s == "BIGINT", "integer").when(s.startswith("DECIMAL") | (s == "DOUBLE"), "real")
        .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("text")
    )


def valid(doc: Column) -> Column:
    # alone a parser may stop after the first value; inside an array and an object it must reach the end
    one = F.coalesce(F.json_array_length(F.concat(F.lit("["), doc, F.lit("]"))) == 1, F.lit(False))
    return F.when(doc.isNotNull(), (one & F.try_parse_json(F.concat(F.lit('{"a":'), doc, F.lit("}"))).isNotNull()).cast("int"))


def length(doc: Column) -> Column:
    """Elements of an array; 0 for what is none."""
    return F.when(doc.isNotNull(), F.coalesce(F.json_array_length(doc), F.lit(0)).cast("bigint"))


def array(*values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array(*[quote(v) for v in values]), ","), F.lit("]"))


def obj(**values: Column) -> Column:
    parts = [F.concat(F.lit(json.dumps(k) + ":"), quote(v)) for k, v in values.items()]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))


def quote(value: Column) -> Column:
    """A SQL value as JSON text."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(value)), r"^\[([\s\S]*)\]$", 1), F.lit("null"))


def group_array(value: Column, order: Column) -> Column:
    """JSON array of a group's values in the order given."""
    return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]))


def _put(doc, path: list, value, add: bool, replace: bool):
    if not path:
        return value if replace else doc
    node = doc
    for step, after in zip(path, [*path[1:], None], strict=True):
        last = after is None
        if isinstance(node, dict) and isinstance(step, str):
            if step in node:
                if last and replace:
                    node[step] = value
            elif add:
                node[step] = value if last else ([] if isinstance(after, int) else {})
            if last or step not in node:
                return doc
            node = node[step]
        elif isinstance(node, list) and isinstance(step, int):
            if step < len(node):
                if last and replace:
                    node[step] = value
            elif add and step == len(node):
                node.append(value if last else ([] if isinstance(after, int) else {}))
            if last or step >= len(node):
                return doc
            node = node[step]
        else:
            return doc
    return doc


def _remove(doc, path: list):
    if not path:
        return None
    node = doc
    for step in path[:-1]:
        try:
            node = node[step]
        except (KeyError, IndexError, TypeError):
            return doc
    step = path[-1]
    if (isinstance(node, dict) and step in node) or (isinstance(node, list) and isinstance(step, int) and step < len(node)):
        del node[step]
    return doc


def _edit(doc: Column, change) -> Column:
    def one(text):
        if text is None:
            return None
        try:
            out = change(json.loads(text))
        except ValueError:
            return None
        return None if out is None else json.dumps(out, separators=(",", ":"), ensure_ascii=False)

    @F.pandas_udf("string")
    def edit(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return edit(doc)


def insert(doc: Column, path: str, value) -> Column:
    """Adds where nothing is."""
    return _edit(doc, lambda d: _put(d, steps(path), value, True, False))


def replace(doc: Column, path: str, value) -> Column:
    """Changes what is there."""
    return _edit(doc, lambda d: _put(d, steps(path), value, False, True))


def put(doc: Column, path: str, value) -> Column:
    """json_set: adds or changes."""
    return _edit(doc, lambda d: _put(d, steps(path), value, True, True))


def remove(doc: Column, *paths: str) -> Column:
    def change(d):
        for p in paths:
            d = _remove(d, steps(p))
        return d

    return _edit(doc, change)


def each(doc: Column) -> Column:
    """For explode: (key, value) of an object's or array's members (an array's keys are its places); null for other values.

    A member that is a text is given as it is, any other as JSON.
    """
    is_array = F.coalesce(F.ltrim(doc).startswith("["), F.lit(False))
    members = F.from_json(F.when(is_array, doc), "array<string>")
    placed = F.transform(members, lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")))
    return F.when(is_array, placed).otherwise(F.map_entries(F.from_json(F.when(~is_array, doc), "map<string,string>")))
