"""Nested records into flat tables that keep parent-child links, by Dewey labels.

Every node of a record's tree has a label: the ordinals on the way from the root to it
(position of a field in its struct, of an element in its array, of an entry in its map). The
label of the parent is the label cut by the last step, so tables join on a prefix and need
no generated keys. Nodes are grouped by schema path; each path that repeats is one table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T


def holds_value(col: Column, kind: T.DataType) -> Column:
    """Whether a value is there and has at least one non-null value at any depth (never null itself)."""
    if isinstance(kind, T.StructType):
        inner = F.lit(False)
        for f in kind.fields:
            inner = inner | holds_value(col.getField(f.name), f.dataType)
        return col.isNotNull() & inner
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(col, lambda x: holds_value(x, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.exists(F.map_values(col), lambda x: holds_value(x, kind.valueType)), F.lit(False))
    return col.isNotNull()


@dataclass
class Shredded:
    """One table of a schema path: ``frame`` has the record key and the columns below."""

    path: tuple[str, ...]
    frame: DataFrame


#: Columns of every table beside the record key and the node's own values.
LABEL, PARENT, ORDINAL, MAP_KEY, FILLED = "label", "parent_label", "ordinal", "map_key", "filled"


def _atomic(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def shred(df: DataFrame, key: str, columns: list[str]) -> dict[tuple[str, ...], DataFrame]:
    """Tables by schema path for the nested ``columns`` of ``df``.

    A path is a tuple of field names with ``[]`` for array elements and ``{}`` for map entries.
    Each table has ``key``, ``label`` (``4.0.7.2``), ``parent_label``, ``ordinal``, ``map_key``
    (null but for map entries), ``filled`` (a non-null value at some depth) and either the
    atomic fields of the node's struct or the column ``value``. A field named like one of these
    columns comes out as ``field_<name>``. Null elements keep their position and come out with
    ``filled`` false; null and empty arrays or maps give no row; a null key stays null. Tables
    are lazy: one that is not used costs nothing.
    """
    tables: dict[tuple[str, ...], DataFrame] = {}
    for column in columns:
        field = df.schema[column]
        ordinal = df.schema.fieldNames().index(column)
        base = df.select(
            F.col(key).alias("__key"), F.lit(str(ordinal)).alias("__label"), F.col(column).alias("__node"),
            F.lit(None).cast("string").alias("__map_key"), F.lit(ordinal).alias("__ord"),
        )
        _walk(base, field.dataType, (column,), key, tables, 1, 0)
    return tables


def _own(frame: DataFrame, kind: T.DataType, key: str, above: int) -> DataFrame:
    """A path's table; its rows' parents are their labels cut to the first ``above`` ordinals."""
    taken = {key, LABEL, PARENT, ORDINAL, MAP_KEY, FILLED}
    values = [F.col("__node").alias("value")]
    if isinstance(kind, T.StructType):
        values = [
            F.col("__node").getField(f.name).alias(f"field_{f.name}" if f.name in taken else f.name)
            for f in kind.fields if _atomic(f.dataType)
        ]
    return frame.select(
        F.col("__key").alias(key), F.col("__label").alias(LABEL), cut(F.col("__label"), above).alias(PARENT),
        F.col("__ord").alias(ORDINAL), F.col("__map_key").alias(MAP_KEY),
        holds_value(F.col("__node"), kind).alias(FILLED), *values,
    )


def _walk(frame: DataFrame, kind: T.DataType, path: tuple[str, ...], key: str, tables: dict, depth: int, above: int) -> None:
    """``depth`` ordinals make a label here, and the first ``above`` of them that of the row it belongs to."""
    if isinstance(kind, T.StructType):
        tables[path] = _own(frame.filter(F.col("__node").isNotNull()) if len(path) == 1 else frame, kind, key, above)
        for i, f in enumerate(kind.fields):
            if not _atomic(f.dataType):
                inner = frame.select(
                    "__key", F.concat("__label", F.lit(f".{i}")).alias("__label"),
                    F.col("__node").getField(f.name).alias("__node"), F.lit(None).cast("string").alias("__map_key"), F.lit(i).alias("__ord"),
                )
                _walk(inner, f.dataType, (*path, f.name), key, tables, depth + 1, depth)
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        is_map = isinstance(kind, T.MapType)
        element = kind.valueType if is_map else kind.elementType
        exploded = frame.select("__key", F.col("__label").alias("__up"), F.posexplode("__node").alias("__ord", *(("__mk", "__node") if is_map else ("__node",))))
        step = (*path, "{}" if is_map else "[]")
        inner = exploded.select(
            "__key", F.concat_ws(".", "__up", F.col("__ord").cast("string")).alias("__label"), "__node",
            (F.col("__mk") if is_map else F.lit(None)).cast("string").alias("__map_key"), "__ord",
        )
        # the parent of an element is the nearest node that is a row itself
        if path[-1] in ("[]", "{}"):
            above = depth
        if not isinstance(element, T.StructType):
            tables[step] = _own(inner, element, key, above)
        _walk(inner, element, step, key, tables, depth + 1, above)


def cut(label: Column, ordinals: int) -> Column:
    """The label of the node so many ordinals below the root: its first ``ordinals``; the empty text for none."""
    return F.substring_index(label, ".", ordinals)


def parent_of(label: Column, steps: int = 1) -> Column:
    """The label cut by ``steps`` ordinals; the empty text at the root."""
    return F.regexp_replace(label, rf"(?:(?:^|\.)\d+){{{steps}}}$", "")
