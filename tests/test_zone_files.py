"""Zone files of several kinds in one folder, and their coordinate systems."""

import json

import pytest
from pyspark.sql import functions as F

from zonetide.functions.projection import forward, inverse, projection_of
from zonetide.sources.zones import read_zones


def feature(number, x=0.0, y=0.0, size=1.0):
    square = [[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]
    return {"type": "Feature", "properties": {"LocationID": number, "zone": f"Z{number}", "borough": "B"},
            "geometry": {"type": "Polygon", "coordinates": [square]}}


def collection(features, crs=None):
    declared = {"crs": {"type": "name", "properties": {"name": crs}}} if crs else {}
    return {"type": "FeatureCollection", **declared, "features": features}


def test_each_file_is_taken_for_what_it_is(spark, tmp_path):
    (tmp_path / "one collection.json").write_text(json.dumps(collection([feature(1), feature(2)]), indent=2))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(feature(n)) for n in (3, 4)) + "\n\n")
    (tmp_path / "rows.json").write_text("\n".join(json.dumps(collection([feature(n), feature(n + 1)])) for n in (5, 7)))
    (tmp_path / "single.json").write_text(json.dumps(feature(9), indent=1))
    # Features one a line inside a document.
    inner = ",\n".join(json.dumps(feature(n)) for n in (10, 11))
    (tmp_path / "document.json").write_text('{"type": "FeatureCollection", "features": [\n' + inner + "\n]}")
    (tmp_path / "none.json").write_text(json.dumps(collection([])))
    (tmp_path / "empty.json").write_text("")
    rows = read_zones(spark, str(tmp_path)).collect()
    assert sorted(r.location_id for r in rows) == list(range(1, 12))
    assert all(r.zone_name == f"Z{r.location_id}" and len(r.geom[0][0]) == 5 for r in rows)


def test_a_declared_system_holds_for_its_document(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(collection([feature(1, 0, 0, 1000)], "urn:ogc:def:crs:EPSG::3857"), indent=2))
    (tmp_path / "b.json").write_text(json.dumps(collection([feature(2, 500_000, 0, 1000)], "urn:ogc:def:crs:EPSG::32631")))
    (tmp_path / "c.json").write_text(json.dumps(collection([feature(3, 7, 8)], "urn:ogc:def:crs:OGC:1.3:CRS84")))
    (tmp_path / "d.json").write_text(json.dumps(feature(4, 984250.0, 0.0)))
    starts = {r.location_id: r.geom[0][0][0] for r in read_zones(spark, str(tmp_path), "EPSG:2263").collect()}
    for number, (lon, lat) in {1: (0, 0), 2: (3, 0), 3: (7, 8), 4: (-74, 40 + 1 / 6)}.items():
        assert starts[number].x == pytest.approx(lon, abs=1e-9) and starts[number].y == pytest.approx(lat, abs=1e-9)


def test_what_is_not_a_feature_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"type": "Polygon", "coordinates": []}))
    with pytest.raises(Exception, match="not a GeoJSON"):
        read_zones(spark, str(tmp_path)).collect()
    (tmp_path / "a.json").write_text(json.dumps(collection([feature(1)], "urn:ogc:def:crs:EPSG::9999")))
    with pytest.raises(ValueError, match="UTM"):
        read_zones(spark, str(tmp_path))


def test_an_empty_folder_has_no_zones(spark, tmp_path):
    (tmp_path / "nothing.json").write_text("\n")
    assert read_zones(spark, str(tmp_path)).collect() == []


# Known places: (code, lon, lat, x, y), from the definition of each grid.
@pytest.mark.parametrize(("code", "lon", "lat", "x", "y"), [
    ("EPSG:32631", 3.0, 0.0, 500_000.0, 0.0),
    ("EPSG:32733", 15.0, 0.0, 500_000.0, 10_000_000.0),
    ("EPSG:32618", -75.0, 40.0, 500_000.0, 4_427_757.218739),
    ("EPSG:3857", 180.0, 0.0, 20_037_508.342789, 0.0),
    ("EPSG:3857", -74.0, 45.0, -8_237_642.318702, 5_621_521.486192)])
def test_known_places(spark, code, lon, lat, x, y):
    row = spark.range(1).select(*forward(F.lit(lon), F.lit(lat), projection_of(code))).first()
    assert row[0] == pytest.approx(x, abs=1e-5) and row[1] == pytest.approx(y, abs=1e-5)


@pytest.mark.parametrize("code", ["EPSG:32618", "EPSG:26918", "EPSG:32733", "EPSG:25832", "EPSG:3857", "EPSG:32118"])
def test_round_trips(spark, code):
    p = projection_of(code)
    middle = getattr(p, "longitude_0", 10.0)
    points = spark.range(200).select((middle - 3.2 + F.col("id") % 20 / 3).alias("lon"),
                                     (F.col("id") * 0.8 - 79).alias("lat"))
    if code == "EPSG:32118":
        points = points.where("lat > 20 AND lat < 60")
    x, y = forward(F.col("lon"), F.col("lat"), p)
    lon, lat = inverse(F.col("x"), F.col("y"), p)
    worst = points.withColumns({"x": x, "y": y}).select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(worst) < 2e-9


def test_codes():
    assert projection_of("EPSG:4326") is None and projection_of("EPSG:4269") is None
    assert projection_of("EPSG:32601").longitude_0 == -177 and projection_of("EPSG:32760").false_northing == 10_000_000
    for wrong in ("EPSG:32600", "EPSG:32661", "EPSG:26924", "EPSG:0", "2263", "EPSG:x"):
        with pytest.raises(ValueError, match="Unknown coordinate system"):
            projection_of(wrong)
