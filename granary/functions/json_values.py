"""Free JSON in text columns: paths with wildcards, deep comparison, setting and merging, by VARIANT.

A text is parsed to a VARIANT, which sorts the keys of objects at every depth, keeps
the order of arrays, tells numbers from strings and null from missing, and writes
equal decimal numbers alike (1, 1.0).  A whole number written with an exponent stays
a floating-point number.  Texts that are no JSON (one key twice included) are null.
Paths are ``$``, ``.key``, ``['key']``, ``[n]``, ``[*]`` and ``.*``.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.scalars import let

STEP = re.compile(r"\.(?P<key>[\w-]+)|\['(?P<quoted>[^']*)'\]|\[(?P<place>\d+)\]|(?P<all>\[\*\]|\.\*)")
ALL = object()


def steps_of(path: str) -> list:
    """Keys, places and ALL of a path; an error if it isn't one."""
    at, steps = 1, []
    while path[:1] == "$" and at < len(path):
        step = STEP.match(path, at)
        if not step:
            break
        steps.append(ALL if step["all"] else int(step["place"]) if step["place"] else step["key"] or step["quoted"])
        at = step.end()
    if path[:1] != "$" or at < len(path):
        raise ValueError(f"not a path: {path}")
    return steps


def canonical(text: Column) -> Column:
    """The text's value with sorted keys; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def literal(value) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def same_json(a: Column, b: Column) -> Column:
    """Deep equality: whatever the order of keys, but not of array elements; texts that are no JSON compare as they are."""
    return F.coalesce(canonical(a), a).eqNullSafe(F.coalesce(canonical(b), b)) & (F.try_parse_json(a).isNull() == F.try_parse_json(b).isNull())


def _at(value: Column, steps: list, kind: str = "variant") -> Column:
    """The value some keys and places further in, as a kind: one step, since each variant that is taken out is a copy."""
    return F.try_variant_get(value, "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps), kind)


def _inside(value: Column, steps: list, kind: str) -> Column:
    """array<kind> of the elements or members of the value some keys and places further in."""
    return F.coalesce(_at(value, steps, f"array<{kind}>"), F.map_values(_at(value, steps, f"map<string,{kind}>")), F.array().cast(f"array<{kind}>"))


def values_at(value: Column, path: str, kind: str = "variant") -> Column:
    """array<kind> of all values at a path, in order; empty where there are none, null in place of a value that is of no such kind.

    A kind of plain types or structs is read in one pass, without a variant for each value.
    """
    steps = steps_of(path)
    if kind == "variant" or steps[-1:] == [ALL]:
        return _values(value, steps, kind)
    return F.transform(_values(value, steps, "variant"), lambda v: F.try_variant_get(v, "$", kind))


def _values(value: Column, steps: list, kind: str) -> Column:
    """Another kind than variant only where the last step is ALL."""
    if ALL not in steps:
        return F.filter(F.array(_at(value, steps, kind)), lambda v: v.isNotNull())
    first = steps.index(ALL)
    before, rest = steps[:first], steps[first + 1 :]
    if not rest:
        return _inside(value, before, kind)
    if isinstance(rest[0], str):  # of each element only this member is read
        key, rest = rest[0], rest[1:]
        found = F.transform(_inside(value, before, "struct<`{}`:variant>".format(key.replace("`", "``"))), lambda v: v[key])
    else:
        found = _inside(value, before, "variant")
    if ALL in rest:
        return F.flatten(F.transform(found, lambda v: _values(v, rest, kind)))
    return F.filter(F.transform(found, lambda v: _at(v, rest, kind)) if rest else found, lambda v: v.isNotNull())


def read_path(value: Column, path: str, kind: str = "variant") -> Column:
    """The value at a dotted path as a kind, where a number is a place in an array or else a key; null if missing or of no such kind."""
    steps = [s for s in path.split(".") if s]
    places = [i for i, s in enumerate(steps) if s.isdigit()]
    if not places:
        return _at(value, steps, kind)
    before, step, rest = steps[: places[0]], steps[places[0]], ".".join(steps[places[0] + 1 :])
    return read_path(F.coalesce(_at(value, [*before, int(step)]), _at(value, [*before, step])), rest, kind)


def text_of(value: Column) -> Column:
    """A scalar's text, an object's or array's JSON; null for JSON null."""
    return F.try_variant_get(value, "$", "string")


def with_value(text: Column, path: str, new: Column) -> Column:
    """The text with ``new`` (JSON text) at a path without wildcards; all else keeps its value.

    What is missing on the way, or is no object or array, becomes one; arrays are
    filled with null up to a place.  Null for a text that is no JSON.
    """
    return F.when(F.try_parse_json(text).isNotNull(), _set(text, steps_of(path), new))


def _set(text: Column, steps: list, new: Column) -> Column:
    if not steps:
        return F.to_json(F.parse_json(new))
    step, rest = steps[0], steps[1:]
    if isinstance(step, int):

        def in_array(a: Column) -> Column:
            inner = F.parse_json(_set(F.coalesce(F.to_json(F.get(a, F.lit(step))), F.lit("null")), rest, new))
            last = F.greatest(F.size(a) - 1, F.lit(step))
            return F.to_json(F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i == step, inner).otherwise(F.coalesce(F.get(a, i), F.parse_json(F.lit("null"))))))

        return let(F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), F.array().cast("array<variant>")), in_array)

    def in_object(m: Column) -> Column:
        inner = F.parse_json(_set(F.coalesce(F.to_json(F.try_element_at(m, F.lit(step))), F.lit("null")), rest, new))
        return F.to_json(F.when(F.map_contains_key(m, step), F.transform_values(m, lambda k, v: F.when(k == step, inner).otherwise(v))).otherwise(F.map_concat(m, F.create_map(F.lit(step), inner))))

    return let(F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), in_object)


def merged(a: Column, b: Column) -> Column:
    """Two objects as one, where keys of the second win; two arrays one after the other; null for anything else."""
    maps = [F.try_variant_get(F.try_parse_json(x), "$", "map<string,variant>") for x in (a, b)]
    lists = [F.try_variant_get(F.try_parse_json(x), "$", "array<variant>") for x in (a, b)]
    objects = let(maps[0], lambda m: let(maps[1], lambda n: F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(n, k)), n)))
    return F.coalesce(F.to_json(objects), F.to_json(F.concat(*lists)))

