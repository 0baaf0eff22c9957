"""Distances and place predicates as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna import values as V


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * V.EARTH_RADIUS_M) * F.asin(F.sqrt(chord))


def flat_km(dlat: Column, dlon: Column) -> Column:
    """Distance on a flat grid of 111 km by 109 km degrees."""
    return F.sqrt(F.pow(dlat * 111, 2) + F.pow(dlon * 109, 2))


def extent_km(south: Column, north: Column, west: Column, east: Column) -> Column:
    return F.round(flat_km(north - south, east - west), 2)


def is_area_centroid(place_type: Column) -> Column:
    return place_type.isin(V.AREA_PLACE_TYPES)


def categorise(tags: Column) -> Column:
    """First matching category of a tag map, null when none matches."""
    out = F
    for category, rules in V.CATEGORY_RULES:
        hit = F.lit(False)
        for key, accepted in rules:
            hit = hit | F.coalesce(F.try_element_at(tags, F.lit(key)).isin(accepted), F.lit(False))
        out = out.when(hit, F.lit(category))
    return out.otherwise(F.lit(None).cast("string"))


def feature_label(name: Column, category: Column) -> Column:
    named = F.when(F.length(name) > 0, name)
    return F.coalesce(named, F.concat(F.lit("unnamed "), F.replace(category, F.lit("_"), F.lit(" "))))
