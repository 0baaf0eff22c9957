from lacuna.workload import readings
from lacuna.workload import reports as R

CELLS = [
    # All sites agree; one differs; one has nothing; one differs in case only.
    *((s, "soil", "Soil", 1, "clay", True) for s in "012"),
    *((s, "rain", "Rain", 2, v, True) for s, v in zip("012", ["wet", "wet", "dry"], strict=True)),
    *((s, "slope", "Slope", 3, v, v is not None) for s, v in zip("012", ["flat", None, "flat"], strict=True)),
    *((s, "zone", "Zone", 4, v, True) for s, v in zip("012", ["Z", "z", "Z"], strict=True)),
]


def test_dimensions_are_compared_over_all_sites(spark, monkeypatch):
    cells = spark.createDataFrame(CELLS, "site string, dimension string, label string, row_order int, value string, established boolean")
    monkeypatch.setattr(R, "_cells", lambda *_: cells)
    assert [tuple(r) for r in readings.undifferentiating_dimensions(spark, "").collect()] == [("soil", "Soil")]
    assert "undifferentiating_dimensions" in readings.QUERIES
