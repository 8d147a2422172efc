"""Shapes and documents that several tests use."""

import json


def square(x, y, side=0.001):
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]


LOT_WIDTH, LOT_DEPTH = 2.0 ** -10, 2.0 ** -11
WEST, SOUTH = -50.5, -15.25


def lot_corner(i):
    """Eight lots to a street, three streets; exact binary fractions."""
    return WEST + (i % 8) * 2.0 ** -8, SOUTH + (i // 8) * 2.0 ** -7


def rectangle(x, y, width, height):
    return [[x, y], [x + width, y], [x + width, y + height], [x, y + height], [x, y]]


def collection(*features, kind="FeatureCollection"):
    return json.dumps({"type": kind, "features": list(features)})


def feature(coordinates, kind="Polygon", **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def documents(spark, **by_slug):
    return spark.createDataFrame(list(by_slug.items()), "slug string, document string")
