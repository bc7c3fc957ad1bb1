"""Column lists of the clean, lookup and enriched tables."""

#: The output contract, in order.
CLEAN = [
    "building_id", "source", "relation_id", "quadkey", "quadkey_prefix_6", "last_update", "geom_wkb",
    "centroid_lon", "centroid_lat", "bbox_xmin", "bbox_ymin", "bbox_xmax", "bbox_ymax",
    "footprint_area_m2", "height_raw", "occupancy_raw", "floorspace_source_m2",
    "height_source_type", "height_m", "stories_exact", "stories_min", "stories_max", "height_quality",
    "occupancy_code", "occupancy_group", "occupancy_quality", "floorspace_est_m2", "attribute_completeness_score",
]
BUILDING = [c for c in CLEAN if c != "geom_wkb"]
MATCH = ["coordinate_valid", "building_match_type", "building_distance_m", "building_confidence"]
