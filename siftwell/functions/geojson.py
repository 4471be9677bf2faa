"""Strict GeoJSON: validation with structural error paths, features, round trips.

Documents are checked by SQL expressions over VARIANT; collections of geometries
are opened level by level, as deep as JSON may nest.  Documents that fail go to an
Arrow UDF that walks them along a list of what is still to do, so no nesting
exhausts a stack, and names the first fault.  JSON itself is that of
``json_scan``: the last of equal keys wins, and numbers beyond a double or texts nested over
127 levels are faults of kind ``Json`` with their place.
Null gives null; a faulty document gives ``ok = false`` and an error.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import as_column, free_name, let
from .json_scan import MOST_NESTED, doubtful, scan, struct_array
from .numbers import number_text, number_text_of, plain_numbers
from .strict_json import json_type, known_json, strict_json

ERROR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("path", T.StringType()), T.StructField("message", T.StringType())])
#: A collection takes two levels of JSON, its object and its list.
NESTING = MOST_NESTED // 2 + 1
EPSILON = 2.220446049250313e-16
#: Depth of the coordinate arrays of each geometry.
DEPTH = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def _array_type(depth: int) -> str:
    return "array<" * depth + "double" + ">" * depth


def _coordinates(geometry: Column, depth: int) -> Column:
    return F.from_json(F.to_json(F.variant_get(geometry, "$.coordinates", "variant")), _array_type(depth))


def _checked_coordinates(geometry: Column, depth: int) -> Column:
    """Coordinates of a geometry known to be valid: no type is in doubt, so the VARIANT is cast as it is."""
    return F.try_variant_get(geometry, "$.coordinates", _array_type(depth))


def _position_ok(p: Column) -> Column:
    number = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return F.coalesce(F.size(p).between(2, 3) & F.forall(p, number), F.lit(False))


def _all_ok(array: Column, depth: int, ok) -> Column:
    return F.coalesce(ok(array) if depth == 0 else F.forall(array, lambda x: _all_ok(x, depth - 1, ok)), F.lit(False))


def _ring_ok(ring: Column) -> Column:
    first, last = F.get(ring, F.lit(0)), F.try_element_at(ring, F.lit(-1))
    near = lambda i: F.abs(F.get(first, F.lit(i)) - F.get(last, F.lit(i))) <= F.lit(EPSILON)
    return (F.size(ring) >= 4) & near(0) & near(1)


def _text_type(value: Column) -> Column:
    """The ``type`` member where it is a string."""
    member = F.variant_get(value, "$.type", "variant")
    return F.when(json_type(member) == "STRING", F.try_variant_get(value, "$.type", "string"))


def _simple_ok(geometry: Column) -> Column:
    """Whether a VARIANT is a valid geometry that is no collection.

    Here and below no inner lambda uses a variable of an outer one: Spark would
    not recognise the expression again where an Arrow UDF depends on it.
    """

    def simple(geometry: Column, kind: str) -> Column:
        depth = DEPTH[kind]

        def check(c: Column) -> Column:
            ok = _all_ok(c, depth - 1, _position_ok)
            return ok & _all_ok(c, depth - 2, _ring_ok) if kind.endswith("Polygon") else ok

        return F.coalesce(let(_coordinates(geometry, depth), check), F.lit(False))

    def of_kind(x: Column) -> Column:
        result = F.when(x["kind"] == "Point", simple(x["geometry"], "Point"))
        for k in list(DEPTH)[1:]:
            result = result.when(x["kind"] == k, simple(x["geometry"], k))
        return F.coalesce(result, F.lit(False))

    return let(F.struct(_text_type(geometry).alias("kind"), geometry.alias("geometry")), of_kind)


def _members(geometry: Column) -> Column:
    """The members of a collection (a null where it has no list of them), else the geometry alone."""
    listed = F.coalesce(F.try_variant_get(geometry, "$.geometries", "array<variant>"), F.array(F.lit(None).cast("variant")))
    return F.when(_text_type(geometry) == "GeometryCollection", listed).otherwise(F.array(geometry))


def _work_list(geometries: Column) -> Column:
    """Struct (geometries, more): whether some of them are collections, still to be opened."""
    return let(geometries, lambda gs: F.struct(gs.alias("geometries"), F.coalesce(F.exists(gs, lambda g: F.coalesce(_text_type(g) == "GeometryCollection", F.lit(False))), F.lit(False)).alias("more")))


def _document_ok(value: Column) -> Column:
    """Whether a document is valid; false where only the walk can tell."""

    def geometry_of(feature: Column) -> Column:
        return F.variant_get(feature, "$.geometry", "variant")

    def checked(x: Column) -> Column:
        kind, value = x["kind"], x["value"]
        features = F.when(kind == "FeatureCollection", F.try_variant_get(value, "$.features", "array<variant>")).when(kind == "Feature", F.array(value))
        present = F.filter(features, lambda f: geometry_of(f).isNotNull() & ~F.is_variant_null(geometry_of(f)))
        collected = kind.isin("FeatureCollection", "Feature")
        geometries = F.when(collected, F.transform(present, geometry_of)).otherwise(F.array(value))
        # each step opens one level of collections, while there are any, so every geometry is checked by one copy of the rules
        step = lambda todo, _: F.when(todo["more"], _work_list(F.flatten(F.transform(todo["geometries"], _members)))).otherwise(todo)
        opened = let(_work_list(geometries), lambda w: F.when(w["more"], F.aggregate(F.sequence(F.lit(1), F.lit(NESTING)), w, step)).otherwise(w))
        geometries = opened["geometries"]
        named = F.when(collected, F.forall(features, lambda f: F.coalesce(_text_type(f) == "Feature", F.lit(False)))).otherwise(F.lit(True))
        return F.coalesce(kind.isNotNull() & named & F.forall(geometries, _simple_ok), F.lit(False))

    return let(F.struct(_text_type(value).alias("kind"), value.alias("value")), checked)


# ---- the walk, for rejected documents only


class _Fault(Exception):
    def __init__(self, kind: str, path: str, message: str):
        self.error = {"kind": kind, "path": path, "message": message}


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _need_array(value, kind: str, path: str, message: str) -> list:
    if not isinstance(value, list):
        raise _Fault(kind, path, message)
    return value


def _walk_position(p, path: str) -> None:
    _need_array(p, "MalformedCoordinates", path, "position must be an array")
    if not 2 <= len(p) <= 3:
        raise _Fault("MalformedCoordinates", path, f"position must have 2 or 3 elements, got {len(p)}")
    if not all(map(_is_number, p)):
        raise _Fault("MalformedCoordinates", path, "coordinate must be a number")


def _walk_positions(value, path: str) -> None:
    for i, p in enumerate(_need_array(value, "MalformedCoordinates", path, "expected array of positions")):
        _walk_position(p, f"{path}[{i}]")


def _walk_rings(value, path: str, message: str) -> None:
    for i, ring in enumerate(_need_array(value, "MalformedCoordinates", path, message)):
        at = f"{path}[{i}]"
        _walk_positions(ring, at)
        if len(ring) < 4:
            raise _Fault("InvalidRing", at, f"ring must have at least 4 positions, got {len(ring)}")
        if any(abs(ring[0][k] - ring[-1][k]) > EPSILON for k in (0, 1)):
            raise _Fault("InvalidRing", at, "polygon ring is not closed (first position != last position)")


def _member(value, name: str):
    return value.get(name) if isinstance(value, dict) else None


def _walk_geometry(g, path: str) -> None:
    todo = [(g, path)]
    while todo:
        g, path = todo.pop()
        if members := _walk_one(g, path):
            # what comes first in the text is taken first
            todo += [(inner, f"{path}.geometries[{i}]") for i, inner in reversed(list(enumerate(members)))]


def _walk_one(g, path: str) -> list | None:
    """Checks one geometry; the members of a collection are left to the caller."""
    kind = _member(g, "type")
    if not isinstance(kind, str):
        raise _Fault("InvalidType", f"{path}.type", "geometry missing 'type' field")
    if kind == "GeometryCollection":
        return _need_array(g.get("geometries"), "InvalidType", f"{path}.geometries", "GeometryCollection missing 'geometries' array")
    if kind not in DEPTH:
        raise _Fault("InvalidType", f"{path}.type", f"unknown geometry type '{kind}'")
    at = f"{path}.coordinates"
    if "coordinates" not in g:
        raise _Fault("MalformedCoordinates", at, "missing 'coordinates' field")
    c = g["coordinates"]
    if kind == "Point":
        _walk_position(c, at)
    elif kind in ("MultiPoint", "LineString"):
        _walk_positions(c, at)
    elif kind == "MultiLineString":
        for i, line in enumerate(_need_array(c, "MalformedCoordinates", at, "expected array of line strings")):
            for j, p in enumerate(_need_array(line, "MalformedCoordinates", f"{at}[{i}]", "expected array")):
                _walk_position(p, f"{at}[{i}][{j}]")
    elif kind == "Polygon":
        _walk_rings(c, at, "polygon coordinates must be an array of rings")
    else:
        for i, polygon in enumerate(_need_array(c, "MalformedCoordinates", at, "expected array of polygons")):
            _walk_rings(polygon, f"{at}[{i}]", "polygon must be an array of rings")
    return None


def _shown(value) -> str:
    """A JSON value in debug notation."""
    if isinstance(value, bool):
        return f"Bool({str(value).lower()})"
    if value is None:
        return "Null"
    if isinstance(value, str):
        return f"String({json.dumps(value, ensure_ascii=False)})"
    if _is_number(value):
        return f"Number({value})"
    if isinstance(value, list):
        return "Array [" + ", ".join(map(_shown, value)) + "]"
    return "Object {" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {_shown(value[k])}" for k in sorted(value)) + "}"


def _walk_feature(f, path: str) -> None:
    if _member(f, "type") != "Feature":
        got = f"Some({_shown(f['type'])})" if isinstance(f, dict) and "type" in f else "None"
        raise _Fault("InvalidType", f"{path}.type", f"expected 'Feature', got {got}")
    if f.get("geometry") is not None:
        _walk_geometry(f["geometry"], f"{path}.geometry")


def first_fault(value) -> dict | None:
    """The first fault of a parsed document in reading order, or None."""
    try:
        kind = _member(value, "type")
        if not isinstance(kind, str):
            raise _Fault("InvalidType", ".type", "missing or non-string 'type' field")
        if kind == "FeatureCollection":
            for i, f in enumerate(_need_array(value.get("features"), "InvalidType", ".features", "FeatureCollection missing 'features' array")):
                _walk_feature(f, f"features[{i}]")
        elif kind == "Feature":
            _walk_feature(value, "")
        else:
            _walk_geometry(value, "")
    except _Fault as fault:
        return fault.error
    return None


#: ``text`` is the document as exact JSON, where Spark's parser could not be trusted with it.
_LOCATED = T.StructType([*ERROR.fields, T.StructField("text", T.StringType())])


def _examine(text: str, doubted: bool) -> dict:
    none = dict.fromkeys(_LOCATED.names)
    if doubted:
        found = scan(text)
        if found["reason"]:
            return none | {"kind": "Json", "path": "", "message": f"{found['reason']} at line {found['line']} column {found['column']}"}
        text = found["text"]
    return none | {"text": text if doubted else None} | (first_fault(json.loads(text)) or {})


@F.arrow_udf(_LOCATED)
def _locate(rejected: pa.Array) -> pa.Array:
    raw, doubted = (x.to_pylist() for x in rejected.flatten())
    # equal texts have equal faults: each is looked at once a batch
    found = {x: _examine(*x) for x in {*zip(raw, doubted, strict=True)} if x[0] is not None}
    return struct_array([found.get(x) for x in zip(raw, doubted, strict=True)], dict.fromkeys(_LOCATED.names, pa.string()))


def geo_parse(text: Column | str) -> Column:
    """Struct (ok, root_kind, value, error); value is null where the document is faulty."""
    c = as_column(text)

    def document(v: Column) -> Column:
        kind = _text_type(v)
        root = F.when(kind.isin("Feature", "FeatureCollection"), kind).otherwise("Geometry")
        return F.when(v.isNotNull(), F.struct(root.alias("root_kind"), v.alias("value")))

    def rejected(x: Column) -> Column:
        return F.when(x["doubted"] | ~_document_ok(x["value"]), F.struct(x["raw"].alias("raw"), x["doubted"].alias("doubted")))

    # Spark evaluates what a UDF reads apart from what reads the UDF's result: the rules stand in the first alone
    parsed = let(c, lambda t: F.struct(t.alias("raw"), strict_json(t).alias("value")))
    judged = let(parsed, lambda x: F.struct(x["raw"].alias("raw"), x["value"].alias("value"), doubtful(x["raw"], x["value"]).alias("doubted")))
    fault = _locate(F.when(c.isNotNull(), let(judged, rejected)))

    def result(x: Column) -> Column:
        fault = x["fault"]
        # an accepted document has no fault, as it is not looked at again
        whole = F.when(fault["text"].isNotNull(), F.try_parse_json(fault["text"])).otherwise(known_json(x["raw"]))
        kept = F.when(fault["kind"].isNull(), let(whole, document))
        error = F.when(fault["kind"].isNotNull(), F.struct(*[fault[n].alias(n) for n in ERROR.names]))
        return let(F.struct(kept.alias("d"), error.alias("e")), lambda y: F.struct(y["d"].isNotNull().alias("ok"), y["d"]["root_kind"].alias("root_kind"), y["d"]["value"].alias("value"), y["e"].alias("error")))

    return F.when(c.isNotNull(), let(F.struct(c.alias("raw"), fault.alias("fault")), result))


def geo_error_text(error: Column) -> Column:
    def said(e: Column) -> Column:
        prefix = F.when(e["kind"] == "InvalidType", "invalid type: ").when(e["kind"] == "MalformedCoordinates", "malformed coordinates: ").when(e["kind"] == "InvalidRing", "invalid ring: ").otherwise("JSON error: ")
        return F.concat(F.lit("geojson error at "), e["path"], F.lit(": "), prefix, e["message"])

    return let(error, said)


# ---- parts of valid documents


def bbox(value: Column) -> Column:
    """The numbers of the ``bbox`` array; others in it are dropped; null where it is missing or no array."""
    items = F.try_variant_get(value, "$.bbox", "array<variant>")
    numbers = F.filter(items, lambda x: json_type(x).rlike("^(BIGINT|DOUBLE|DECIMAL)"))
    return F.transform(numbers, lambda x: F.variant_get(x, "$", "double"))


def foreign_members(value: Column, kind: str) -> Column:
    """Members that are not of the standard, as MAP<STRING, VARIANT>."""
    known = ["type", "features", "bbox"] if kind == "FeatureCollection" else ["type", "geometry", "properties", "id", "bbox"]
    return F.map_filter(F.variant_get(value, "$", "map<string,variant>"), lambda k, _: ~k.isin(known))


def position_parts(position: Column) -> Column:
    """Struct (longitude, latitude, altitude) of a position array; altitude may be null."""
    return F.struct(*[F.get(position, F.lit(i)).alias(n) for i, n in enumerate(("longitude", "latitude", "altitude"))])


def point_position(geometry: Column) -> Column:
    return F.when(_text_type(geometry) == "Point", position_parts(_checked_coordinates(geometry, 1)))


def geo_features(df: DataFrame, text_col: str) -> DataFrame:
    """One row for each feature of valid documents: the columns of ``df``, pos, geometry, properties, id, bbox, foreign.

    A lone Feature is its own list; a document that is a geometry has none.
    """
    geo, feature = free_name(df, "geo"), free_name(df, "feature")
    kept = [F.col(f"`{c}`") for c in df.columns]
    parsed = df.withColumn(geo, geo_parse(text_col)).where(f"{geo}.ok")
    value, kind = F.col(f"{geo}.value"), F.col(f"{geo}.root_kind")
    features = F.when(kind == "FeatureCollection", F.variant_get(value, "$.features", "array<variant>")).when(kind == "Feature", F.array(value))
    rows = parsed.select(*kept, F.posexplode(features).alias("pos", feature))
    f = F.col(feature)
    some = lambda name: F.variant_get(f, f"$.{name}", "variant")
    geometry = some("geometry")
    return rows.select(
        *kept,
        "pos",
        F.when(~F.is_variant_null(geometry), geometry).alias("geometry"),
        some("properties").alias("properties"),
        some("id").alias("id"),
        bbox(f).alias("bbox"),
        foreign_members(f, "Feature").alias("foreign"),
    )


# ---- writing


def geometry_json(geometry: Column, nesting: int = 1) -> Column:
    """Canonical text of a valid geometry: type and coordinates (as floats), other members dropped; null where collections are nested deeper."""
    kind = _text_type(geometry)
    text = lambda k: F.concat(F.lit(f'{{"type":"{k}","coordinates":'), F.to_json(_checked_coordinates(geometry, DEPTH[k])), F.lit("}"))
    result = F.when(kind == "Point", text("Point"))
    for k in list(DEPTH)[1:]:
        result = result.when(kind == k, text(k))
    if nesting:
        inner = F.transform(F.try_variant_get(geometry, "$.geometries", "array<variant>"), lambda g: geometry_json(g, nesting - 1))
        whole = F.when(F.forall(inner, lambda g: g.isNotNull()), F.array_join(inner, ","))
        result = result.when(kind == "GeometryCollection", F.concat(F.lit('{"type":"GeometryCollection","geometries":['), whole, F.lit("]}")))
    return result


def _extras(value: Column, kind: str) -> Column:
    foreign = F.map_entries(foreign_members(value, kind))
    members = F.transform(F.transform(foreign, lambda e: F.to_json(F.create_map(e["key"], e["value"]))), lambda t: F.concat(F.lit(","), t.substr(F.lit(2), F.length(t) - 2)))
    return F.concat(F.coalesce(F.concat(F.lit(',"bbox":'), F.to_json(bbox(value))), F.lit("")), F.array_join(members, ""))


def feature_json(feature: Column) -> Column:
    geometry = F.variant_get(feature, "$.geometry", "variant")
    member = lambda n: F.to_json(F.variant_get(feature, f"$.{n}", "variant"))
    shown = F.when(geometry.isNull() | F.is_variant_null(geometry), F.lit("null")).otherwise(geometry_json(geometry))
    return F.concat(
        F.lit('{"type":"Feature","geometry":'), shown, F.lit(',"properties":'), F.coalesce(member("properties"), F.lit("null")),
        F.coalesce(F.concat(F.lit(',"id":'), member("id")), F.lit("")), _extras(feature, "Feature"), F.lit("}"),
    )


def _geometry_text(g: dict) -> str:
    if g["type"] == "GeometryCollection":
        return '{"type":"GeometryCollection","geometries":[' + ",".join(map(_geometry_text, g["geometries"])) + "]}"
    shown = lambda c: "[" + ",".join(map(shown, c)) + "]" if isinstance(c, list) else number_text_of(c)
    return f'{{"type":"{g["type"]}","coordinates":{shown(g["coordinates"])}}}'


def _compact(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _document_text(doc: dict) -> str:
    """What ``geo_to_json`` gives, for documents nested too deep for it."""
    if doc["type"] not in ("Feature", "FeatureCollection"):
        return _geometry_text(doc)
    if doc["type"] == "FeatureCollection":
        head, known = '"features":[' + ",".join(map(_document_text, doc["features"])) + "]", ("type", "features", "bbox")
    else:
        g = doc.get("geometry")
        head = '"geometry":' + ("null" if g is None else _geometry_text(g)) + ',"properties":' + _compact(doc.get("properties"))
        head += ',"id":' + _compact(doc["id"]) if "id" in doc else ""
        known = ("type", "geometry", "properties", "id", "bbox")
    box = ',"bbox":[' + ",".join(number_text_of(x) for x in doc["bbox"] if _is_number(x)) + "]" if isinstance(doc.get("bbox"), list) else ""
    return f'{{"type":"{doc["type"]}",{head}{box}' + "".join(f",{_compact(k)}:{_compact(doc[k])}" for k in sorted(doc) if k not in known) + "}"


@F.pandas_udf(T.StringType())
def _deep_text(documents: pd.Series) -> pd.Series:
    return documents.map(lambda x: None if x is None else _document_text(json.loads(x))).astype(object)


def geo_to_json(value: Column) -> Column:
    """Canonical text of a valid document (the ``value`` of ``geo_parse``); those nested too deep for SQL go to an Arrow UDF."""

    def written(x: Column) -> Column:
        kind, value = x["kind"], x["value"]
        features = F.when(kind == "FeatureCollection", F.try_variant_get(value, "$.features", "array<variant>")).when(kind == "Feature", F.array(value))
        texts = F.transform(features, feature_json)
        whole = F.when(F.forall(texts, lambda t: t.isNotNull()), F.array_join(texts, ","))
        return (
            F.when(kind == "FeatureCollection", F.concat(F.lit('{"type":"FeatureCollection","features":['), whole, F.lit("]"), _extras(value, "FeatureCollection"), F.lit("}")))
            .when(kind == "Feature", whole)
            .otherwise(geometry_json(value))
        )

    text = let(F.struct(_text_type(value).alias("kind"), value.alias("value")), written)
    # a document nested too deep names two collections; to look for them is cheaper than to write it twice
    deep = let(F.to_json(value), lambda raw: F.when(raw.rlike('(?s)"GeometryCollection".*"GeometryCollection"'), raw))
    return plain_numbers(F.coalesce(text, _deep_text(deep)))


# ---- comparing


def canonical_key(value: Column) -> Column:
    """Struct (text, hash) of a VARIANT: a normal form by which parsed values can be compared, joined and grouped, which VARIANT itself cannot be.

    Keys of objects are in order; numbers that are equal have one text, whether they were written as whole numbers,
    decimals or with an exponent.  ``hash`` is SHA-256 of the text.
    """
    number = r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?$"
    pieces = F.regexp_extract_all(F.to_json(value), F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|[^"0-9-]++|.'), F.lit(0))

    def normal(p: Column) -> Column:
        # a whole number that a double holds is written as one, so that 1, 1.0 and 1e0 are one number; a longer one keeps its digits
        exact = p.rlike("[.eE]") | (F.length(p) <= 15)
        return F.when(p.rlike(number), F.when(exact, number_text(F.when(p.cast("double") == 0, F.lit(0.0)).otherwise(p.cast("double")))).otherwise(p)).otherwise(p)

    return let(F.array_join(F.transform(pieces, normal), ""), lambda t: F.struct(t.alias("text"), F.sha2(t, 256).alias("hash")))
