"""Fixed values.

These word lists, tables, constants and patterns decide results, so they are
stated here plainly and in one place.  Characters that look like something else
are written as escapes.
"""

# --- character repair: mis-encoded character -> intended character -----------
REPAIR_LETTERS = [
    (0x010F, "b"), (0x0110, "c"), (0x0175, "m"), (0x0176, "n"),
    (0x018C, "r"), (0x018B, "q"), (0x01C0, "v"), (0x01C1, "w"),
    (0x01C6, "x"), (0x01C7, "y"), (0x201C, "S"), (0x2018, "R"),
]
REPAIR_DIGITS = [(0x03EC + d, str(d)) for d in range(10)]
REPAIR_PUNCTUATION = [
    (0x035E, '"'), (0x035F, '"'), (0x035A, "'"),
    (0x035B, "'"), (0x037E, "("), (0x037F, ")"),
]
REPAIR_PAIRS = REPAIR_LETTERS + REPAIR_DIGITS + REPAIR_PUNCTUATION
BAD_CHARS = "".join(chr(b) for b, _ in REPAIR_PAIRS)
GOOD_CHARS = "".join(g for _, g in REPAIR_PAIRS)

# Blocks that carry glyph-mapping noise, and typography that is never suspect.
SUSPECT_RANGES = [
    (0x0100, 0x017F), (0x0180, 0x024F), (0x0250, 0x02AF), (0x02B0, 0x02FF),
    (0x0300, 0x036F), (0x0370, 0x03FF), (0x0400, 0x052F), (0x1E00, 0x1EFF),
    (0x2C60, 0x2C7F), (0xA720, 0xA7FF),
]
LEGITIMATE_TYPOGRAPHY = [
    0x2013, 0x2014, 0x2026, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2010,
    0x00B0, 0x00B2, 0x00B3, 0x00BD, 0x00BC, 0x00BE, 0x00D7, 0x00A7,
]

# --- page grading ------------------------------------------------------------
MIN_TEXT_CHARS = 120
HEAVY_CORRUPTION_PER_1000 = 4.0
PAGE_QUALITIES = ["clean", "repaired", "heavily_repaired", "unreadable", "residual_corruption"]

# --- flattened tables --------------------------------------------------------
SUBCOLUMN_HINTS = ["base", "total", "maximum allowable", "allowable against", "permissible", "minimum"]
MIN_VALUE_ROWS = 3
HEADER_LINES = 12
RISK_LEVELS = ["none", "low", "ambiguous_columns", "severe"]
RISKY_LEVELS = ["ambiguous_columns", "severe"]

# --- chunking ----------------------------------------------------------------
MAX_CHUNK_CHARS = 1400
MIN_CHUNK_CHARS = 60

# --- retrieval ---------------------------------------------------------------
STOPWORDS = (
    "a an the of for to in on at by and or as be is are was were shall may can with "
    "which that this these those such any all not no if then than from into within under "
    "over per it its their there here have has had been being do does did"
).split()
SYNONYMS = {
    "far": ["floor", "area", "ratio"],
    "tdr": ["transferable", "development", "rights"],
    "setback": ["margin", "setbacks"],
    "buffer": ["buffers", "zone"],
    "coverage": ["ground"],
    "height": ["storeys", "floors"],
    "parking": ["parkings"],
    "lake": ["water", "bodies", "tank"],
    "drain": ["stream", "valley", "kaluve", "halla"],
    "plot": ["site", "sites", "plots"],
    "transit": ["tod"],
    "oriented": ["tod"],
    "transferable": ["tdr"],
    "floor": ["far"],
    "ratio": ["far"],
}
BM25_K1 = 1.5
BM25_B = 0.75
DEFINITION_INTENT = r"(?i)\b(define[sd]?|definition|what is (a|an|the)\b|what does .{1,30} mean|meaning of)\b"
DEFINITION_CLAUSE = r"(?i)[0-9]+\.[0-9]+\s+[A-Z][^:\n]{1,60}:\s*means"
DEFINITION_BOOST = 2.0
DISTINCTIVE_IDF = 3.0
MIN_DISTINCTIVE_TERMS = 1
TOP_K = 8
AGENT_TOP_K = 6
DESCRIPTOR_TAIL = 260
FOLLOWING_HEAD = 200
NEAREST_TAIL = 180
PROXIMITY_PAGES = 3
PROVISION_CONTEXT = 110
BLIND_REASON = "no machine-readable text; scanned pages or drawings"

# --- geography ---------------------------------------------------------------
EARTH_RADIUS_M = 6_371_000.0
AREA_PLACE_TYPES = [
    "suburb", "neighbourhood", "quarter", "city", "town", "village", "state", "county",
    "administrative", "postcode", "residential", "city_district",
]
# Category and search radius in metres.
QUERY_PLAN = [
    ("rail_station", 3000),
    ("bus_stop", 1000),
    ("major_road", 1000),
    ("water", 1200),
    ("stream", 1200),
    ("hospital", 3000),
    ("school", 2000),
    ("park", 1500),
]
CATEGORIES = [c for c, _ in QUERY_PLAN]
# (category, [(tag key, accepted values)]) in matching order.
CATEGORY_RULES = [
    ("rail_station", [("railway", ["station", "halt"]), ("station", ["subway"])]),
    ("bus_stop", [("highway", ["bus_stop"])]),
    ("major_road", [("highway", ["motorway", "trunk", "primary", "secondary"])]),
    ("water", [("natural", ["water"]), ("waterway", ["riverbank"])]),
    ("stream", [("waterway", ["stream", "drain", "river", "canal"])]),
    ("hospital", [("amenity", ["hospital"])]),
    ("school", [("amenity", ["school"])]),
    ("park", [("leisure", ["park"])]),
]
PROXIES = [
    ("rail_station", "public transport accessibility"),
    ("major_road", "road connectivity"),
    ("hospital", "access to emergency healthcare"),
    ("school", "neighbourhood amenity"),
    ("water", "proximity to a regulated water body"),
    ("stream", "proximity to a regulated watercourse"),
    ("park", "access to open space"),
]
# bearing label, northward factor, eastward factor
BEARINGS = [
    ("N", 1.0, 0.0), ("NE", 0.7, 0.7), ("E", 0.0, 1.0), ("SE", -0.7, 0.7),
    ("S", -1.0, 0.0), ("SW", -0.7, -0.7), ("W", 0.0, -1.0), ("NW", 0.7, -0.7),
]
SAMPLE_RADIUS_M = 400
LEVEL_BAND_M = 2.0

# --- statements and review ---------------------------------------------------
STATEMENT_TYPES = ["fact", "inference", "assumption", "recommendation"]
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
MIN_LEXICAL_SUPPORT = 0.55
OVERCLAIM = (
    r"(?i)\b(complies?|compliant|is permitted|is allowed|you can build|guarantee[sd]?|"
    r"certainly|definitely|will be approved|no restrictions?|fully satisfies)\b"
)
INTERPRETIVE = r"(?i)\baccessib|\bconnectivit|\bsuitab|\bdesirab|\battractiv|\bwell[- ]served\b"
BUFFER_LANGUAGE = r"(?i)\bbuffer\b|\bno development zone\b|eco[- ]sensitive|setback from|from the edge"
WATER_LANGUAGE = r"(?i)\blake|water bod|\bstream|\bdrain|valley|\braja\b|\bhalla\b|watercourse"
ZONING_LANGUAGE = r"\bFAR\b|land use|zoning"
CHECKS = [
    ("sourced", "every fact carries a source"),
    ("quoted", "claim text appears in its cited passage"),
    ("proxied", "proxy measurements declare what they stand for"),
    ("capped", "confidence does not exceed evidence quality"),
    ("overclaimed", "no compliance or permission is asserted"),
    ("grounded", "generated sentences are grounded in retrieved evidence"),
]
CHECK_NAMES = dict(CHECKS)

# --- reports -----------------------------------------------------------------
# (position, key, label, keyword) of a comparison row.
DIMENSIONS = [
    ("water", "Nearest water body", ["nearest mapped water"]),
    ("stream", "Nearest watercourse", ["nearest mapped stream"]),
    ("major_road", "Nearest major road", ["nearest mapped major road"]),
    ("rail", "Nearest rail station", ["nearest mapped rail station"]),
    ("hospital", "Nearest hospital", ["nearest mapped hospital"]),
    ("rainfall", "Mean annual rainfall", ["mean annual precipitation"]),
    ("extreme_rain", "Extreme rainfall days", ["peak recorded daily rainfall"]),
    ("terrain", "Elevation & local relief", ["site elevation"]),
    ("density", "Mapped feature density", ["features mapped near this point"]),
]
PANELS = [
    ("location", ["resolves to"]),
    ("mobility", ["rail station", "bus stop", "major road", "features mapped"]),
    ("water", ["water", "stream"]),
    ("amenities", ["hospital", "school", "park"]),
    ("climate", ["precipitation", "rainfall"]),
    ("terrain", ["elevation", "relief"]),
]
# How much a sentence quotes of a region's introduction, and how many claims a conflict names.
SHOWN_CHARS = 170
RELATED_IDS = 3
# How many matched terms and unreadable regions a sentence names, and how much it quotes of a region's surroundings.
NAMED_TERMS = 8
NAMED_REGIONS = 3
NAMED_PAGES = 5
DESCRIBED_BEFORE = 200
DESCRIBED_AFTER = 160
STALE_AFTER_DAYS = 30

# Checks of an evaluation case, with the metric each one feeds.
CASE_CHECKS = [
    ("page_recall", "citation_page_recall"),
    ("page_precision_at_1", "citation_precision_at_1"),
    ("phrase_found", "governing_phrase_retrieved"),
    ("blind_spot_reported", "blind_spot_recall"),
    ("no_false_blind_spot", "blind_spot_precision"),
    ("repair_caveat_present", "repair_caveat_propagation"),
    ("table_risk_flagged", "table_damage_detection"),
    ("absence_handled", "absence_handling"),
    ("no_overclaim", "overclaim_resistance"),
]
UNMEASURED_METRICS = ["unsupported_claim_rate", "uncertainty_calibration", "answer_completeness", "cost_per_analysis"]
