"""Values set and taken out at a path of keys inside JSON objects, as expressions on VARIANT values.

The result's keys come sorted, as VARIANT objects keep them.  Text that is no
JSON object is left as it is and counts as unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAP = "map<string,variant>"


def _object(v: Column) -> Column:
    """An object's entries; null for any other value."""
    return v.try_cast(_MAP)


def _entries(v: Column) -> Column:
    return F.coalesce(_object(v), F.create_map().cast(_MAP))


def _but(entries: Column, key: str) -> Column:
    return F.map_filter(entries, lambda k, _: k != key)


def variant_set(v: Column, keys: Sequence[str], value: Column) -> Column:
    """``v`` with ``value`` (a VARIANT) at the path ``keys``: what isn't an object on the way becomes one."""
    if not keys:
        return value
    entries = _entries(v)
    inner = variant_set(F.try_element_at(entries, F.lit(keys[0])), keys[1:], value)
    return F.to_variant_object(F.map_concat(_but(entries, keys[0]), F.create_map(F.lit(keys[0]), inner)))


def variant_at(v: Column, keys: Sequence[str]) -> Column:
    """The value at the path; SQL null where there is none, which a JSON null is not."""
    for k in keys:
        v = F.try_element_at(_object(v), F.lit(k))
    return v


def variant_unset(v: Column, keys: Sequence[str]) -> Column:
    """``v`` without the last key of the path; ``v`` itself where the path isn't there."""
    entries = _object(v)
    if len(keys) == 1:
        out = F.to_variant_object(_but(entries, keys[0]))
    else:
        inner = variant_unset(F.try_element_at(entries, F.lit(keys[0])), keys[1:])
        out = F.to_variant_object(F.map_concat(_but(entries, keys[0]), F.create_map(F.lit(keys[0]), inner)))
    return F.when(variant_at(v, keys).isNull(), v).otherwise(out)


def json_set(text: Column, keys: Sequence[str], value: Column) -> Column:
    """``body, changed`` of JSON text with ``value`` (JSON text) at the path; a value that stands there already changes nothing, and a missing one counts as null."""
    v = F.try_parse_json(text)
    new = F.try_parse_json(value)
    as_text = lambda x: F.coalesce(F.to_json(x), F.lit("null"))
    fits = _object(v).isNotNull() & new.isNotNull()
    changed = F.coalesce(fits, F.lit(False)) & (as_text(variant_at(v, keys)) != as_text(new))
    return F.struct(F.when(changed, F.to_json(variant_set(v, keys, new))).otherwise(text).alias("body"), changed.alias("changed"))


def json_unset(text: Column, keys: Sequence[str]) -> Column:
    """``body, changed`` of JSON text without the last key of the path."""
    v = F.try_parse_json(text)
    changed = F.coalesce(variant_at(v, keys).isNotNull(), F.lit(False))
    return F.struct(F.when(changed, F.to_json(variant_unset(v, keys))).otherwise(text).alias("body"), changed.alias("changed"))
