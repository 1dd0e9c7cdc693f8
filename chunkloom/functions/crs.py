"""Reference systems by EPSG code, as CF grid mappings: the codes that rasters mostly have, by
rule. With pyproj at hand, any code."""

from __future__ import annotations

#: CF names of the projection methods by GeoTIFF coordinate transformation code.
BY_TRANSFORMATION = {
    1: "transverse_mercator", 3: "oblique_mercator", 7: "mercator", 8: "lambert_conformal_conic", 9: "lambert_conformal_conic", 10: "lambert_azimuthal_equal_area",
    11: "albers_conical_equal_area", 12: "azimuthal_equidistant", 14: "stereographic", 15: "polar_stereographic", 21: "orthographic", 24: "sinusoidal", 28: "lambert_cylindrical_equal_area",
}
#: CF names by EPSG projection method, for pyproj's answers.
BY_METHOD = {
    9801: "lambert_conformal_conic", 9802: "lambert_conformal_conic", 9804: "mercator", 9805: "mercator", 9807: "transverse_mercator", 9809: "stereographic",
    9810: "polar_stereographic", 9829: "polar_stereographic", 9830: "polar_stereographic", 9820: "lambert_azimuthal_equal_area", 9822: "albers_conical_equal_area",
    9835: "lambert_cylindrical_equal_area", 9840: "orthographic",
}
#: Geographic systems (name, datum, ellipsoid, radius, inverse flattening).
GEOGRAPHIC = {
    4326: ("WGS 84", "WGS_1984", "WGS 84", 6378137.0, 298.257223563), 4269: ("NAD83", "North_American_Datum_1983", "GRS 1980", 6378137.0, 298.257222101),
    4258: ("ETRS89", "European_Terrestrial_Reference_System_1989", "GRS 1980", 6378137.0, 298.257222101), 4267: ("NAD27", "North_American_Datum_1927", "Clarke 1866", 6378206.4, 294.978698213898),
}
#: Zones of 6 degrees: first and last code, the zone of the first, the geographic system, south or not.
UTM = ((32601, 32660, 1, 4326, False), (32701, 32760, 1, 4326, True), (26901, 26923, 1, 4269, False), (25828, 25838, 28, 4258, False), (26701, 26722, 1, 4267, False))


def _number(x: float) -> str:
    return repr(int(x)) if x == int(x) else repr(x)


def _geographic(code: int) -> str:
    name, datum, ball, radius, flat = GEOGRAPHIC[code]
    return (
        f'GEOGCS["{name}",DATUM["{datum}",SPHEROID["{ball}",{_number(radius)},{_number(flat)}]],PRIMEM["Greenwich",0],'
        f'UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","{code}"]]'
    )


def _projected(name: str, base: int, method: str, parameters: dict[str, float], code: int) -> str:
    said = ",".join(f'PARAMETER["{k}",{_number(v)}]' for k, v in parameters.items())
    return f'PROJCS["{name}",{_geographic(base)},PROJECTION["{method}"],{said},UNIT["metre",1],AUTHORITY["EPSG","{code}"]]'


def by_rule(code: int) -> dict | None:
    """grid_mapping_name, crs_wkt and the method's parameters, of a code that a rule covers."""
    if code in GEOGRAPHIC:
        _, _, _, radius, flat = GEOGRAPHIC[code]
        return {"grid_mapping_name": "latitude_longitude", "crs_wkt": _geographic(code), "semi_major_axis": radius, "inverse_flattening": flat}
    if code == 3857:
        said = {"central_meridian": 0.0, "scale_factor": 1.0, "false_easting": 0.0, "false_northing": 0.0}
        return {"grid_mapping_name": "mercator", "crs_wkt": _projected("WGS 84 / Pseudo-Mercator", 4326, "Mercator_1SP", said, code)}
    for first, last, zone, base, south in UTM:
        if first <= code <= last:
            zone += code - first
            middle = 6.0 * zone - 183
            said = {"latitude_of_origin": 0.0, "central_meridian": middle, "scale_factor": 0.9996, "false_easting": 500000.0, "false_northing": 10000000.0 if south else 0.0}
            name = f"{GEOGRAPHIC[base][0]} / UTM zone {zone}{'S' if south else 'N'}"
            return {
                "grid_mapping_name": "transverse_mercator", "crs_wkt": _projected(name, base, "Transverse_Mercator", said, code), "longitude_of_central_meridian": middle,
                "latitude_of_projection_origin": 0.0, "scale_factor_at_central_meridian": 0.9996, "false_easting": 500000.0, "false_northing": said["false_northing"],
            }
    return None


def by_library(code: int) -> dict | None:
    """The same by pyproj, where that is installed; what it cannot name has no grid_mapping_name."""
    try:
        import pyproj
    except ImportError:
        return None
    try:
        crs = pyproj.CRS.from_epsg(code)
    except pyproj.exceptions.CRSError:
        return None
    out = {"crs_wkt": crs.to_wkt("WKT1_GDAL")}
    if crs.is_geographic:
        out["grid_mapping_name"] = "latitude_longitude"
    elif crs.coordinate_operation is not None and crs.coordinate_operation.method_code and int(crs.coordinate_operation.method_code) in BY_METHOD:
        out["grid_mapping_name"] = BY_METHOD[int(crs.coordinate_operation.method_code)]
    return out


def grid_mapping(code: int | None, keys: dict[int, object] | None = None) -> dict:
    """A grid mapping's attributes: by the code, else the method's name by the GeoKeys alone."""
    if code is not None and (found := by_rule(code) or by_library(code)):
        return found
    name = BY_TRANSFORMATION.get((keys or {}).get(3075))
    return {"grid_mapping_name": name} if name else {}
