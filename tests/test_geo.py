from pyspark.sql import functions as F

from postlab.functions import geo


def test_location_cues(one):
    texts = ["📍 Paris, France", "BASED IN  Rome\nlover of cats", "from \nOslo", "Location:\n\n  Köln  ",
             "from x", "📍 a, b. Based in Lima", "nothing here", None, "UBICACIÓN: Quito", "from " + "y" * 80]
    assert one(lambda c: geo.extract_location_patterns(c, "v1"), texts) == [
        "Paris", "Rome", "Oslo", "Köln", None, "Lima", None, None, None, "y" * 50]
    assert one(lambda c: geo.extract_location_patterns(c, "v2"), texts)[8] == "Quito"


def test_false_positives_only_in_v3(one):
    texts = ["from https://x.org", "from the TECH world", "from AI land", "living in www.x\nfrom Bonn"]
    assert one(lambda c: geo.extract_location_patterns(c, "v3"), texts) == [None, None, "AI land", "Bonn"]
    assert one(lambda c: geo.extract_location_patterns(c, "v1"), texts)[0] == "https://x.org"


def test_handle(one):
    handles = ["a.uk", "A.B.DE", "uk", "x.zz", "x.kr", None]
    assert one(lambda c: geo.location_from_handle(c, "v1"), handles) == ["UK", "Germany", None, None, "South Korea", None]
    assert one(lambda c: geo.location_from_handle(c, "v3"), handles)[0] == "United Kingdom"


def test_mentions_are_substrings_unless_asked(one):
    texts = ["I love Ukraine", "made in atlanta", "New York and Norway", "quiet", None]
    assert one(geo.location_from_mentions, texts) == ["UK", "LA", "Norway", None, None]
    assert one(lambda c: geo.location_from_mentions(c, True), texts) == [None, None, "Norway", None, None]


def test_resolve_order(spark):
    rows = [("from Lima", "a.de"), ("", "a.de"), ("in Japan", "a.xx"), (None, "a.xx")]
    df = spark.createDataFrame(rows, "d string, h string")
    got = [r[0] for r in df.select(geo.resolve_location("d", "h", "v1")).collect()]
    assert got == ["Lima", "Germany", "Japan", ""]


def test_country(one):
    places = ["Paris, France", "London, uk ", "BRASIL", "guinea-bissau", None, "a,b, ", "NYC, US"]
    assert one(geo.country_from_location, places) == [
        "France", "United Kingdom", "Brazil", "Guinea-Bissau", "Unknown", "", "United States"]


def test_geo_point(spark):
    df = spark.createDataFrame(
        [([10.0, 20.0], [0.0, 0.0, 2.0, 4.0], "P", "C"), (None, [0.0, 0.0, 2.0, 4.0], "P", "C"),
         (None, None, "P", "C"), ([], None, None, None)],
        "p array<double>, b array<double>, n string, c string")
    got = [r[0] and tuple(r[0]) for r in df.select(geo.geo_point("p", "b", "n", "c")).collect()]
    assert got == [(20.0, 10.0, "coordinates", "", ""), (2.0, 1.0, "place_center", "P", "C"), None, None]


def test_first_place_wins(spark):
    from postlab.operators.joins import join_place
    places = spark.createDataFrame(
        [("p", "second", "B", ([1.0],), 2), ("p", "first", "A", ([2.0],), 1)],
        "id string, full_name string, country_code string, geo struct<bbox:array<double>>, ord long")
    tweets = spark.createDataFrame([("1", ("p",)), ("2", (None,))], "id string, geo struct<place_id:string>")
    got = join_place(tweets, places).orderBy("id").select("place_full_name").collect()
    assert [r[0] for r in got] == ["first", None]


def test_geocode_keeps_misses(spark):
    from postlab.operators.aggregates import geocode_stats
    from postlab.operators.joins import geocode_join, new_locations
    df = spark.createDataFrame([(" Paris\t",), ("paris",), ("Nowhere",)], "location_str string")
    gaz = spark.createDataFrame([("paris", 1.0, 2.0)], "location_key string, latitude double, longitude double")
    joined = geocode_join(df, gaz)
    assert joined.where(F.col("latitude") == 1.0).count() == 2
    assert geocode_stats(joined).first().asDict() == {
        "unique_locations": 3, "unique_keys": 2, "geocoded_locations": 1, "final_rows": 2, "removed_rows": 1}
    assert [r[0] for r in new_locations(df, gaz).collect()] == ["nowhere"]
