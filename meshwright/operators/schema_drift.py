"""Files whose schemas drift: one consistent table, and a report of every change.

Each record's schema is a tree of keys. The cheapest edit script between the target schema and
that tree (``tree_edit``: keep, rename, move to another parent, delete, add) tells where each
target field is: costs weigh the likeness of names and of contents, so a field is found under
any key while a key that only looks alike is not taken for it. A script is compiled into the
projection of all records of its shape; records share both through a cache. The target schema,
with what its fields' contents look like, is a parameter.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field as dataclass_field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from meshwright.operators import tree_edit

_LAT, _LNG = ("lat", "latitude", "y"), ("lng", "lon", "long", "longitude", "x")
_TRUE, _FALSE = {"true", "yes", "t", "y", "1"}, {"false", "no", "f", "n", "0"}
_PAIRS = re.compile(r"\s*-?\d+(?:\.\d+)?[ ,]\s*-?\d+(?:\.\d+)?(?:\s*[;|]\s*-?\d+(?:\.\d+)?[ ,]\s*-?\d+(?:\.\d+)?)*\s*;?\s*")


@dataclass(frozen=True)
class Target:
    """A field of the consistent table and what its contents look like (content class -> likeness).

    1 tells the field by itself, 0.3 fits but says little, -1 (any class not named) rules it out.
    """

    name: str
    contents: tuple[tuple[str, float], ...]


@dataclass(frozen=True)
class Schema:
    """Target fields, and the words of a coded vocabulary (class ``kind``; its numbers are ``code``)."""

    fields: tuple[Target, ...]
    words: tuple[str, ...] = ()
    numeric: frozenset = dataclass_field(init=False, compare=False)

    def __post_init__(self) -> None:
        exact = {t.name for t in self.fields if {k for k, _ in t.contents} == {"number", "flagnum", "code"}}
        object.__setattr__(self, "numeric", frozenset(exact))
        object.__setattr__(self, "_hash", hash((self.fields, self.words)))

    def __hash__(self) -> int:  # a key of caches that are asked for every value
        return self._hash


_NUMBERS = (("number", 0.3), ("flagnum", 0.3), ("code", 0.3))
#: Edge files. The kinds of healing that they name.
EDGES = Schema(
    (
        Target("stem", (("text", 0.3),)),
        Target("u", _NUMBERS),
        Target("v", _NUMBERS),
        Target("bc", _NUMBERS),
        Target("w", _NUMBERS),
        Target("healed", (("bool", 0.3), ("null", 0.0))),
        Target("conf", (("text", 0.3), ("null", 0.0))),
        Target("geo", (("bool", 0.4), ("flagtext", 0.5), ("flagnum", 0.3), ("null", 0.0))),
        Target("ll", (("places", 1.0), ("null", 0.0))),
        Target("hk", (("kind", 1.0), ("kinds", 1.0), ("code", 0.3), ("flagnum", 0.3), ("text", 0.1), ("texts", 0.1), ("null", 0.0))),
    ),
    words=("canopy", "geom", "trace"),
)


def json_type(value) -> str | None:
    """The JSON type of a value, for a list with that of its elements; null for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "flag"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "text"
    if isinstance(value, dict):
        return "object"
    inner = sorted({json_type(x) for x in value if x is not None})
    return "list<" + "|".join(inner) + ">"


def content_class(value, schema: Schema = EDGES) -> str:
    """What a value looks like, coarser than its type where that helps and finer where it does."""
    kind = type(value)
    if value is None:
        return "null"
    if kind is bool:
        return "bool"
    if kind is int or kind is float:
        return "flagnum" if value in (0, 1) else "code" if 2 <= value <= len(schema.words) and value == int(value) else "number"
    if kind is str:
        return _text_class(value, schema) if len(value) < 64 else "places" if _PAIRS.fullmatch(value) else "text"
    if kind is list:
        if value and type(value[0]) is str and all(isinstance(x, str) for x in value):
            return "kinds" if all(x.strip().lower() in schema.words for x in value) else "texts"
        return "places" if _placed(value) else "list"
    return "object"


@lru_cache(maxsize=50_000)
def _text_class(value: str, schema: Schema) -> str:
    low = value.strip().lower()
    if low in schema.words:
        return "kind"
    if low in _TRUE or low in _FALSE:
        return "flagtext"
    return "places" if _PAIRS.fullmatch(value) else "text"


def _placed(value: list) -> bool:
    """Whether a list looks like a line of places, by its first element that is one."""
    first = next((x for x in value if x is not None), None)
    if isinstance(first, list):
        return 2 <= len(first) <= 3 and all(x is None or _number(x) is not None for x in first)
    if isinstance(first, dict):
        return any(k.lower() in _LAT for k in first) and any(k.lower() in _LNG for k in first)
    return _number(first) is not None and len(value) % 2 == 0 and _number(value[-1]) is not None


def _number(x) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _places(value) -> list[list[float | None] | None] | None:
    """Any spelling of a line as [[lat, lng], ...]; null if it is none."""
    if isinstance(value, str):
        if not _PAIRS.fullmatch(value):
            return None
        return [[float(n) for n in re.split(r"[ ,]\s*", p.strip())[:2]] for p in re.split(r"[;|]", value) if p.strip()]
    if not isinstance(value, list):
        return None
    if all(x is None or isinstance(x, list) for x in value):
        return [None if x is None else [_number(n) for n in x] for x in value]
    if all(x is None or isinstance(x, dict) for x in value):
        out: list = []
        for x in value:
            low = {k.lower(): v for k, v in (x or {}).items()}
            lat = next((low[k] for k in _LAT if k in low), None)
            lng = next((low[k] for k in _LNG if k in low), None)
            out.append(None if x is None else [_number(lat), _number(lng)])
        return out
    if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value) and len(value) % 2 == 0:
        return [[float(a), float(b)] for a, b in zip(value[::2], value[1::2])]
    return None


@lru_cache(maxsize=100_000)
def name_likeness(field: str, path: tuple[str, ...]) -> float:
    """1 for the same name, down to 0; a parent's name counts less than the key's own."""
    best = 0.0
    for part, weight in [(path[-1], 1.0), *((p, 0.7) for p in path[:-1])]:
        words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", part)]
        whole = part.lower()
        if part == field:
            like = 1.0
        elif whole == field:
            like = 0.95
        elif field in words:
            like = 0.8
        elif "".join(w[0] for w in words) == field and len(words) > 1:
            like = 0.8
        elif len(field) > 2 and whole.startswith(field):
            like = 0.7
        else:
            a, b = {field[i : i + 2] for i in range(len(field) - 1)}, {whole[i : i + 2] for i in range(len(whole) - 1)}
            like = 0.6 * len(a & b) / len(a | b) if a | b else 0.0
        best = max(best, weight * like)
    return best


def _key_tree(shape: tuple[tuple[tuple[str, ...], str], ...]) -> tree_edit.Node:
    """The tree of keys whose leaves, with their content classes, are ``shape``."""
    inner: dict = {}
    for path, kind in sorted(shape):
        at = inner
        for part in path[:-1]:
            at = at.setdefault(part, {})
        at[path[-1]] = kind
    node = lambda name, x: tree_edit.Node(name, children=tuple(node(k, v) for k, v in x.items())) if isinstance(x, dict) else tree_edit.Node(name, x)
    return node("", inner)


@lru_cache(maxsize=50_000)
def edit_script(shape: tuple[tuple[tuple[str, ...], str], ...], schema: Schema = EDGES) -> tuple[float, tuple[tuple[str, str, str], ...]]:
    """Cost and steps ``(operation, target field, path)`` of the cheapest script for a shape.

    ``shape`` lists the record's leaves with their content class. Taking a leaf for a field costs
    ``2 - likeness of names - 1.2 x likeness of contents``; see ``tree_edit`` for the rest.
    """
    likes = {t.name: dict(t.contents) for t in schema.fields}
    fit = lambda want, _, path, kind: 2 - name_likeness(want[-1], path) - 1.2 * likes[want[-1]].get(kind, -1.0)
    alike = lambda want, path: 1 - name_likeness(want[-1], path)
    target = tree_edit.Node("", children=tuple(tree_edit.Node(t.name, "field") for t in schema.fields))
    script = tree_edit.edit_script(target, _key_tree(shape), fit, alike)
    return script.cost, tuple((op, ".".join(want), ".".join(path)) for op, want, path in script.steps)


_BETWEEN = "\u0000"  # between the keys of a path


def _flatten(record: dict, above: str, keys: list, values: list) -> None:
    for key, value in record.items():
        if type(value) is dict:
            _flatten(value, above + key + _BETWEEN, keys, values)
        else:
            keys.append(above + key)
            values.append(value)


def field_paths(record: dict, schema: Schema = EDGES) -> dict[str, tuple[str, object]]:
    """For each target field that the record has: its path and value."""
    keys, values = list(record), list(record.values())
    if dict in map(type, values):
        keys, values = [], []
        _flatten(record, "", keys, values)
    # a number under the very name of a numeric field: which number makes no other shape
    numeric = schema.numeric
    kinds = [
        "number" if (type(v) is float or type(v) is int) and k in numeric else content_class(v, schema) for k, v in zip(keys, values)
    ]
    return {f: (path, values[k]) for f, path, k in _projection(tuple(keys), tuple(kinds), schema)}


@lru_cache(maxsize=50_000)
def _projection(keys: tuple, kinds: tuple, schema: Schema) -> tuple[tuple[str, str, int], ...]:
    """The script compiled for records of these leaves: fields with their path and place among the leaves."""
    paths = [tuple(k.split(_BETWEEN)) for k in keys]
    place = {".".join(p): k for k, p in enumerate(paths)}
    return tuple((f, path, place[path]) for _, f, path in edit_script(tuple(sorted(zip(paths, kinds))), schema)[1] if f and path)


def _flag(value) -> bool | None:
    if isinstance(value, bool):
        return value
    low = str(value).strip().lower()
    return True if low in _TRUE else False if low in _FALSE else None


def _kind(value) -> str | None:
    """One name for any spelling: the text, the first of a list, a code as text."""
    if isinstance(value, list):
        value = next((x for x in value if x is not None), None)
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return str(int(value)) if math.isfinite(value) and value == int(value) else str(value)
    return str(value).strip()


CONSISTENT = (
    "stem string, u long, v long, bc double, w double, healed boolean, conf string, geo boolean, "
    "ll array<array<double>>, hk string"
)
_LL = pa.list_(pa.list_(pa.float64()))


def _parse(body) -> dict | None:
    """A record, or null for a line that is no valid JSON object."""
    if body is None:
        return None
    try:
        record = json.loads(body)
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _long(x):
    n = _number(x)
    return int(n) if n is not None and math.isfinite(n) and abs(n) < 2**63 else None


def consistent_edges(raw: DataFrame, schema: Schema = EDGES) -> DataFrame:
    """All valid lines of all files in one table: file, line and the consistent fields.

    A null or invalid body gives no row; a line delivered twice gives one. Values that cannot be
    read as the field's type become null. A healing kind given as a code stays a code, as text:
    nothing in the files says what the codes mean.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("file_id", "line_no", "stem", "u", "v", "bc", "w", "healed", "conf", "geo", "ll", "hk")}
            for file_id, line_no, body in zip(*(c.to_pylist() for c in batch.columns)):
                record = _parse(body)
                if record is None:
                    continue
                got = {f: v for f, (_, v) in field_paths(record, schema).items()}
                text = lambda x: x if isinstance(x, str) else None if x is None else json.dumps(x)
                row = {
                    "file_id": file_id, "line_no": line_no, "stem": text(got.get("stem")), "u": _long(got.get("u")),
                    "v": _long(got.get("v")), "bc": _number(got.get("bc")), "w": _number(got.get("w")),
                    "healed": _flag(got.get("healed")), "conf": text(got.get("conf")), "geo": _flag(got.get("geo")),
                    "ll": _places(got.get("ll")), "hk": _kind(got.get("hk")),
                }
                for k, x in row.items():
                    out[k].append(x)
            types = {"file_id": pa.int64(), "line_no": pa.int32(), "u": pa.int64(), "v": pa.int64(), "bc": pa.float64(), "w": pa.float64(), "healed": pa.bool_(), "geo": pa.bool_(), "ll": _LL}
            yield pa.RecordBatch.from_pydict({k: pa.array(x, types.get(k, pa.string())) for k, x in out.items()})

    lines = raw.select(F.col("file_id").cast("long"), F.col("line_no").cast("int"), F.col("body").cast("string"))
    return lines.mapInArrow(run, f"file_id long, line_no int, {CONSISTENT}").distinct()


def _profiles(raw: DataFrame, fields: tuple[str, ...], target: Schema) -> DataFrame:
    """Path and type of each field in each line; a line that is no record has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, types = {f: [] for f in fields}, {f: [] for f in fields}
            for body in batch.column(4).to_pylist():
                record = _parse(body)
                got = field_paths(record, target) if record is not None else {}
                for f in fields:
                    path, value = got.get(f, (None, None))
                    paths[f].append(None if value is None else path)
                    types[f].append(json_type(value))
            columns = [batch.column(i) for i in range(4)]
            columns += [pa.array(x[f], pa.string()) for f in fields for x in (paths, types)]
            names = ["feed", "file_id", "written_at", "digest", *(f"{f}_{x}" for f in fields for x in ("path", "type"))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "feed string, file_id long, written_at timestamp_ntz, digest binary, " + ", ".join(
        f"{f}_path string, {f}_type string" for f in fields
    )
    lines = raw.select(
        F.col("feed").cast("string"), F.col("file_id").cast("long"), F.col("written_at").cast("timestamp_ntz"),
        F.unhex(F.md5(F.col("body").cast("string"))).alias("digest"), F.col("body").cast("string"),
    ).filter("feed is not null and file_id is not null")
    return lines.mapInArrow(run, schema)


def drift_report(raw: DataFrame, fields: tuple[str, ...] = ("geo", "ll", "hk"), schema: Schema = EDGES) -> DataFrame:
    """``(file_id, field, drift)``: each file but a feed's first against the file before it.

    A file's name for a field is the path most of its records with a non-null value use, its
    type the JSON type most of those values have; on a tie the first in order of text. Invalid
    lines do not count, though their file does; a line delivered twice counts once. ``drift`` is
    ``added``, ``removed``, ``renamed`` or ``retyped``. Rows with a null feed or file are left
    out; a null ``written_at`` comes first in its feed; an empty table gives an empty report.
    """
    profiles = _profiles(raw, fields, schema).distinct()
    seen = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_path").alias("path"), F.col(f"{f}_type").alias("type")) for f in fields])
    )
    long = profiles.select("feed", "file_id", "written_at", seen.alias("x")).select("feed", "file_id", "written_at", "x.*")
    counts = long.groupBy("feed", "file_id", "field", "path", "type").agg(F.count(F.lit(1)).alias("n"), F.min("written_at").alias("at"))
    of = ["feed", "file_id", "field"]
    here = F.when(F.col("path").isNotNull(), F.col("n")).otherwise(0)
    by_path = counts.groupBy(*of, "path").agg(F.sum(here).alias("n"), F.min("at").alias("at"))
    names = by_path.groupBy(*of).agg(
        F.min("at").alias("at"), F.min(F.struct(-F.col("n"), F.col("path"))).getField("path").alias("path")
    )
    by_type = counts.groupBy(*of, "type").agg(F.sum(here).alias("n"))
    types = by_type.groupBy(*of).agg(F.min(F.struct(-F.col("n"), F.col("type"))).getField("type").alias("type"))
    files = names.join(types, of).groupBy("feed", "file_id").agg(
        F.min("at").alias("at"),
        F.map_from_entries(F.collect_list(F.struct("field", F.struct("path", "type")))).alias("has"),
    )
    both = previous_of_feed(files).filter(F.col("before").isNotNull())
    field = both.select("file_id", F.explode(F.array(*map(F.lit, fields))).alias("field"), "has", "before")
    old, new = F.col("before")[F.col("field")], F.col("has")[F.col("field")]
    drift = F.when(old["path"].isNull() & new["path"].isNotNull(), F.array(F.lit("added")))
    drift = drift.when(old["path"].isNotNull() & new["path"].isNull(), F.array(F.lit("removed"))).otherwise(
        F.array_compact(
            F.array(
                F.when(old["path"] != new["path"], F.lit("renamed")), F.when(old["type"] != new["type"], F.lit("retyped"))
            )
        )
    )
    return field.select("file_id", "field", F.explode(drift).alias("drift"))


def previous_of_feed(files: DataFrame) -> DataFrame:
    """Add ``before``: ``has`` of the file before in the feed's order of time, then file.

    Files of one feed are ordered day by day, and days among themselves: a feed with a third of
    all files is not sorted by one task.
    """
    dated = files.withColumn("day", F.coalesce(F.to_date("at"), F.to_date(F.lit("0001-01-01"))))
    place = F.struct(F.coalesce(F.col("at"), F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))), F.col("file_id"))
    inner = dated.withColumn("earlier", F.lag("has").over(W.partitionBy("feed", "day").orderBy(place)))
    last = dated.groupBy("feed", "day").agg(F.max_by("has", place).alias("final"))
    carried = last.select(
        F.col("feed").alias("f"), F.col("day").alias("d"), F.lag("final").over(W.partitionBy("feed").orderBy("day")).alias("carried")
    )
    return (
        inner.join(carried, (F.col("feed") == F.col("f")) & (F.col("day") == F.col("d")))
        .withColumn("before", F.coalesce("earlier", "carried"))
        .drop("f", "d", "day", "earlier", "carried")
    )
