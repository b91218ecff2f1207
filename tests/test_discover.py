import pytest
from pyspark.sql import functions as F

from lodeflow.operators import discover as m


@pytest.fixture
def frames(spark):
    people = spark.range(900).select((F.col("id") + 5000).alias("person"), (F.col("id") % 30 + 1).alias("place id"), F.lit("x").alias("flat"))
    places = spark.range(30).select((F.col("id") + 1).cast("double").alias("key"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("person"))
    visits = spark.range(4000).select((F.col("id") + 10**6).alias("visit"), (F.col("id") * 7 % 900 + 5000).cast("string").alias("who"))
    return people, places, visits


def test_links(frames):
    people, places, visits = frames
    known = [m.sketches(f) for f in frames]
    (link,) = m.links(known[0], known[1])
    assert (link.left, link.right) == ("place id", "key") and link.alike == 1
    assert m.links(known[1], known[2]) == [] == m.links(known[0], known[2])  # texts are no numbers in typed frames
    cells = [m.sketches(f, cells=True) for f in frames]
    assert [(x.left, x.right) for x in m.links(cells[0], cells[2])][0] == ("person", "who")


def test_merges_by_content(frames):
    people, places, visits = frames
    out = m.merge_by_content([visits, places, people], cells=True)
    assert out.columns == ["visit", "who", "place id", "flat", "person"] and out.count() == 4000
    row = out.where("visit = 1000010").first()
    assert (row["who"], row["place id"], row["person"]) == ("5070", 11.0, "p10")
    with pytest.raises(ValueError):
        m.merge_by_content([visits, places])
    with pytest.raises(ValueError):
        m.merge_by_content([])


def test_estimates_of_large_columns(spark):
    a = spark.range(200_000).select(F.col("id").alias("a"))
    b = spark.range(100_000, 300_000).select(F.col("id").alias("b"), F.lit(None).cast("string").alias("none"))
    c = spark.range(150_000).select((F.col("id") + 10).alias("c"))
    known = [m.sketches(x) for x in (a, b, c)]
    assert known[1].count() == 1 and m.links(known[0], known[1]) == []
    (link,) = m.links(known[0], known[2])
    assert link.contained > 0.95 and abs(link.alike - 0.75) < 0.05
