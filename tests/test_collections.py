"""Collections as folders."""

import pytest

from textloom.sources.collections import Schema, Store, Unavailable, Unfit

SCHEMA = Schema(3, metadata={"model": "m"}, indexes=("source_id",))


def test_life_of_a_collection(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    assert store.health() == ("ready", None) and store.names() == []
    assert store.ensure("b", SCHEMA) and store.ensure("a", SCHEMA) and not store.ensure("b", SCHEMA, production=True) and store.names() == ["a", "b"]
    points = spark.createDataFrame([("p", "s1", [1.0, 0.0, 0.0]), ("q", "s2", [0.0, 1.0, 0.0])], "point_id string, source_id string, content array<double>")
    store.write("a", points)
    assert store.read("a").where("source_id = 's2'").select("point_id").first()[0] == "q"
    with pytest.raises(Unfit, match="lack source_id"):
        store.write("a", points.drop("source_id"))
    assert store.live_check(SCHEMA, points) == {"made": True, "points": 2, "clean": True}
    assert store.drop("a") and store.names() == ["b"] and not store.drop("a")
    with pytest.raises(Unfit):
        store.write("a", points)


@pytest.mark.parametrize("other,reason", [(Schema(4, metadata={"model": "m"}), "size is 3, not 4"), (Schema(3, "title"), "vector_name"), (Schema(3, distance="dot"), "distance"), (Schema(3, metadata={"model": "n"}), "metadata differs: model"), (Schema(3, indexes=("source_id", "license_id")), "missing indexes: license_id")])
def test_unfit(spark, tmp_path, other, reason):
    store = Store(spark, str(tmp_path))
    store.ensure("a", SCHEMA)
    with pytest.raises(Unfit, match=reason):
        store.ensure("a", other, production=True)


def test_states(spark):
    assert Store(spark, None).health()[0] == "disabled" and Store(spark, "nowhere://x/y").health()[0] == "unavailable"
    with pytest.raises(Unavailable):
        Store(spark, None).names()
    assert Schema(3).preflight({"vector_name": "content", "size": 3, "distance": "cosine", "strict": False}) == "filters on other fields are permitted"
