"""Paths that many rows share, and prefixes of files in progress."""

from pyspark.sql import functions as F

from mediacat.operators import library


def test_a_path_of_all_rows(spark):
    """10**5 rows with one path on both sides: their classes and members, without the 10**10 pairs."""
    side = lambda host: spark.range(100_000).select("id", F.concat(F.lit(f"https://{host}/?q="), F.col("id").cast("string")).alias("url"))
    left = side("a.example").union(spark.createDataFrame([(1, None), (2, "https://a.example/only"), (3, "https://a.example/x")], "id long, url string"))
    right = side("b.example").union(spark.createDataFrame([(7, "http://c.example/x#f"), (8, None)], "id long, url string"))
    classes = library.path_classes(left, right)
    assert sorted(map(tuple, classes.collect())) == [("/", 100_000, 100_000), ("/x", 1, 1)]
    members = library.path_members(left, classes)
    assert members.columns == ["id", "url", "path"] and members.count() == 100_001
    few = library.match_by_path(left.where("id = 3 and url like '%x'"), right).select("path").collect()
    assert [r.path for r in few] == ["/x"]


def test_prefixes_of_parts(spark):
    media = spark.createDataFrame([(1, "clip 1"), (2, "clip 12"), (3, "other"), (4, "long title of a clip")], "media_id int, title string")
    files = spark.createDataFrame([("clip 12.mp4.part3", 9), ("long title of a clip.mp4", 5_000_000), ("x.part", 1)], "name string, size long")
    got = {r.media_id: r.state for r in library.find_completed(media, files).collect()}
    assert got == {1: "partial", 2: "partial", 4: "complete"}
    assert library.find_completed(media.limit(0), files).count() == 0
