"""Brands by a dictionary table against the expression and against plain loops."""

import random

from pyspark.sql import functions as F

from shelfwright import constants as K
from shelfwright.functions import text
from shelfwright.operators.brands import infer_brands


def dictionary(spark, brands):
    return spark.createDataFrame(list(enumerate(brands)), "pos long, brand string")


def test_same_answer_as_the_expression(spark):
    rng = random.Random(7)
    pieces = [*K.BRANDS, *[b.lower() for b in K.BRANDS], "x", "K1", "helmet", "-", "'", "the", "é", "2", "_"]
    names = [(i, rng.choice(["", " "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))) for i in range(1500)]
    names += [(2000, None), (2001, ""), (2002, names[0][1]), (2003, names[0][1])]
    df = spark.createDataFrame(names, "id long, name string")
    want = {r.id: r.b for r in df.select("id", text.infer_brand(F.col("name")).alias("b")).collect()}
    got = {r.id: r.brand for r in infer_brands(df, dictionary(spark, list(dict.fromkeys(K.BRANDS)))).collect()}
    assert got == want and len(set(want.values())) > 20


def test_brands_of_odd_characters(spark):
    brands = ["R&G", "'47 Brand", "&", "A\\EB", "$ign", "Ünit", "under_score", "X-1", "", None, "dup", "DUP"]
    names = ["an r&g one", "x'47 brand", "'47 brand", "a&b", "a & b", "a\\eb", "the $ign", "x$ign", "ünit one", "under_score", "under", "x-1x", "x-1",
             "the dup", "r & g"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    table = spark.createDataFrame([(i, b) for i, b in enumerate(brands)], "pos long, brand string")
    got = {names[r.id]: r.brand for r in infer_brands(df, table).collect()}
    alike = df.select("id", text.infer_brand(F.col("name"), [b for b in brands if b]).alias("b")).collect()
    assert got == {names[r.id]: r.b for r in alike}
    assert (got["an r&g one"], got["x'47 brand"], got["a&b"], got["x$ign"], got["under"]) == ("R&G", "'47 Brand", "&", "$ign", None)


def test_a_hundred_thousand_brands(spark):
    brands = spark.range(100_000).select(
        F.col("id").alias("pos"), F.concat(F.lit("Maker"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, " Works").otherwise("")).alias("brand")
    )
    names = spark.range(5_000).select(
        "id", F.concat(F.lit("the maker"), (F.col("id") * 19).cast("string"), F.when(F.col("id") % 2 == 0, " works glove").otherwise(" glove")).alias("name")
    )
    got = {r.id: r.brand for r in infer_brands(names, brands).collect()}
    for i in range(5_000):
        n = i * 19
        want = f"Maker{n} Works" if n % 3 == 0 and i % 2 == 0 else f"Maker{n}" if n % 3 else None
        assert got[i] == want


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "AGV one", "old", 5)], "id long, title string, brand string, pos int")
    table = dictionary(spark, ["agv"])
    assert infer_brands(df, table, name_col="title").collect()[0].asDict() == {"id": 1, "title": "AGV one", "pos": 5, "brand": "agv"}
    assert infer_brands(df.limit(0), table, name_col="title").collect() == []
    assert infer_brands(df, table.limit(0), name_col="title").first().brand is None
