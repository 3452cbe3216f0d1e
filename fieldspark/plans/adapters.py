"""The provided tables as points, labelled voxels, trajectories, grids, graphs and tag sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Pieces that the receivers of a nation are dealt into.
PIECES = 48


def shift(digits: int) -> float:
    return 3.7 * 10.0 ** -(digits + 3)


def rd(x, digits: int = 4) -> Column:
    """Rounded for comparison: a small shift keeps exact halves off the edge, and no negative zero is left."""
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double") + F.lit(shift(digits)), digits) + F.lit(0.0)


def sq(expr: str, digits: int = 4) -> str:
    """rd() in SQL."""
    return f"(round(CAST({expr} AS DOUBLE) + {shift(digits):.10g}, {digits}) + 0.0)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch_seconds(ts) -> Column:
    """Seconds since 1970, whatever the session's time zone (for timestamps without a zone)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    return day * 86400.0 + F.hour(ts) * 3600.0 + F.minute(ts) * 60.0 + F.date_part(F.lit("SECOND"), ts).cast("double")


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    hundred = lambda c: F.round(F.col(c) * 100)
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_quantity").alias("x"), hundred("l_discount").alias("y"), hundred("l_tax").alias("z"), F.col("l_extendedprice").alias("value"))


def points2d(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("x"), (day / 10.0).alias("y"))


def points3d(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("x"), (day / 10.0).alias("y"), (F.col("o_custkey") % 100).cast("double").alias("z"))


def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    run = F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2)
    return table(spark, sf, "events").select(F.col("user_id").alias("pid"), (F.row_number().over(w) - 1).cast("long").alias("step"), epoch_seconds("ts").alias("t"), run.alias("x"), F.col("value").alias("y"), F.col("event_type").alias("tag"))


def grid2d(spark: SparkSession, sf: str) -> DataFrame:
    cell = [(F.col("l_quantity") - 1).cast("long").alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j")]
    return table(spark, sf, "lineitem").groupBy(*cell).agg(rd(F.avg("l_extendedprice"), 2).alias("v"))


def grid3d(spark: SparkSession, sf: str) -> DataFrame:
    cell = [(F.col("l_quantity") - 1).cast("long").alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j"), F.round(F.col("l_tax") * 100).cast("long").alias("k")]
    rows = table(spark, sf, "lineitem").select(*cell, (F.col("l_suppkey") % 5).cast("long").alias("tag"), F.col("l_extendedprice").alias("p"))
    tags = rows.groupBy("i", "j", "k", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"))
    return tags.groupBy("i", "j", "k").agg(rd(F.sum("s") / F.sum("n"), 2).alias("v"), F.max_by("tag", F.struct("n", -F.col("tag"))).alias("tag"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def geo_places(spark: SparkSession, sf: str) -> DataFrame:
    """geo_pairs() by place: a source with each place of its nation's receivers, of which `rcvs` are the ids, and its km and tt once."""
    from ..functions.expr import EARTH_KM, central_angle

    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"), "s_nationkey", "s_acctbal")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("rcv"), "c_nationkey")
    s = s.select("*", (F.col("src") * 37 % 360 - 180.0).alias("slon"), (F.col("src") * 53 % 170 - 85.0).alias("slat"))
    c = c.select("*", (F.col("rcv") * 91 % 360 - 179.5).alias("rlon"), (F.col("rcv") * 29 % 170 - 84.75).alias("rlat"))
    c = c.groupBy("c_nationkey", "rlon", "rlat").agg(F.collect_list(F.struct("rcv")).alias("rcvs"))
    s, c = [df.withColumns({f"{n}sin": F.sin(F.radians(f"{n}lat")), f"{n}cos": F.cos(F.radians(f"{n}lat"))}) for df, n in ((s, "s"), (c, "r"))]
    # There are few nations: a nation's places are dealt into pieces, each of which meets all of its sources.
    s = s.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    c = c.withColumn("piece", F.pmod(F.xxhash64("rlon", "rlat"), F.lit(PIECES)).cast("int"))
    s = s.hint("merge")  # its copies aren't in Spark's estimate of its size, and pairs are made by as many tasks as there are cores
    df = s.join(c, (s["s_nationkey"] == c["c_nationkey"]) & (s["piece"] == c["piece"]))
    df = df.withColumn("km", F.lit(EARTH_KM) * central_angle("ssin", "scos", "rsin", "rcos", F.radians(F.col("rlon") - F.col("slon"))))
    return df.select("src", "slon", "slat", "rcvs", "rlon", "rlat", "km", (F.col("km") / 6 + F.col("s_acctbal") / 1e4).alias("tt"))


def each_receiver(rows: DataFrame) -> DataFrame:
    """Rows over geo_places() with rcv in place of rcvs: one row a receiver."""
    return rows.withColumn("rcvs", F.explode("rcvs")).select(*[F.col("rcvs.rcv") if c == "rcvs" else F.col(c) for c in rows.columns])


def geo_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return each_receiver(geo_places(spark, sf))


def tag_sets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter(F.col("text").isNotNull())
    tags = F.array_sort(F.array_distinct(F.transform(F.split("text", " "), lambda w: (F.length(w) % 12).cast("int"))))
    return docs.select(F.col("doc_id").alias("vertex"), tags.alias("tags"))


def triangles(spark: SparkSession, sf: str) -> DataFrame:
    """Two triangles for each grid cell of four corners; vertex ids are i * 11 + j."""
    g = grid2d(spark, sf).filter("i < 49 AND j < 10")
    at = F.col("i") * 11 + F.col("j")
    halves = F.array(F.struct((2 * at).alias("tri"), at.alias("v0"), (at + 11).alias("v1"), (at + 1).alias("v2")), F.struct((2 * at + 1).alias("tri"), (at + 12).alias("v0"), (at + 1).alias("v1"), (at + 11).alias("v2")))
    return g.select(F.explode(halves).alias("t")).select("t.*")


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices of triangles(): id, x, y, value."""
    return grid2d(spark, sf).select((F.col("i") * 11 + F.col("j")).alias("id"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.col("v").alias("value"))


#: The same tables in SQL, as common table expressions by name.
VIEWS = {
    "voxels": "SELECT l_suppkey AS label, l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z, l_extendedprice AS value FROM lineitem",
    "points2d": "SELECT o_orderkey AS id, o_totalprice / 1000 AS x, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 10.0::DOUBLE AS y FROM orders",
    "points3d": "SELECT o_orderkey AS id, o_totalprice / 1000 AS x, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 10.0::DOUBLE AS y, CAST(o_custkey % 100 AS DOUBLE) AS z FROM orders",
    "trajectories": "SELECT user_id AS pid, row_number() OVER w - 1 AS step, epoch(ts) AS t, round(sum(value) OVER w, 2) AS x, value AS y, event_type AS tag FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)",
    "grid2d": f"SELECT CAST(l_quantity AS BIGINT) - 1 AS i, CAST(round(l_discount * 100) AS BIGINT) AS j, {sq('avg(l_extendedprice)', 2)} AS v FROM lineitem GROUP BY 1, 2",
    "tags3d": "SELECT CAST(l_quantity AS BIGINT) - 1 AS i, CAST(round(l_discount * 100) AS BIGINT) AS j, CAST(round(l_tax * 100) AS BIGINT) AS k, l_suppkey % 5 AS tag, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2, 3, 4",
    "grid3d": f"SELECT i, j, k, {sq('sum(s) / sum(n)', 2)} AS v, arg_max(tag, n * 10 - tag) AS tag FROM tags3d GROUP BY i, j, k",
    "vectors": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings",
    "pairs0": "SELECT s_suppkey AS src, s_suppkey * 37 % 360 - 180.0::DOUBLE AS slon, s_suppkey * 53 % 170 - 85.0::DOUBLE AS slat, c_custkey AS rcv, c_custkey * 91 % 360 - 179.5::DOUBLE AS rlon, c_custkey * 29 % 170 - 84.75::DOUBLE AS rlat, s_acctbal FROM supplier JOIN customer ON s_nationkey = c_nationkey",
    "geo_pairs": "SELECT src, slon, slat, rcv, rlon, rlat, km, km / 6 + s_acctbal / 10000.0 AS tt FROM (SELECT *, 6371.0 * acos(greatest(-1.0, least(1.0, sin(radians(slat)) * sin(radians(rlat)) + cos(radians(slat)) * cos(radians(rlat)) * cos(radians(rlon - slon))))) AS km FROM pairs0)",
    "tag_sets": "SELECT doc_id AS vertex, list_sort(list_distinct([CAST(length(w) % 12 AS INT) for w in string_split(text, ' ')])) AS tags FROM documents WHERE text IS NOT NULL",
    "triangles": "SELECT UNNEST([{'tri': 2 * (i * 11 + j), 'v0': i * 11 + j, 'v1': i * 11 + j + 11, 'v2': i * 11 + j + 1}, {'tri': 2 * (i * 11 + j) + 1, 'v0': i * 11 + j + 12, 'v1': i * 11 + j + 1, 'v2': i * 11 + j + 11}], recursive := true) FROM grid2d WHERE i < 49 AND j < 10",
    "vertices": "SELECT i * 11 + j AS id, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, v AS value FROM grid2d",
}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """`sql` (a SELECT, or further expressions 'name AS (...), ... SELECT ...' after a leading '+') over the named views."""
    need = {"grid3d": ["tags3d"], "geo_pairs": ["pairs0"], "triangles": ["grid2d"], "vertices": ["grid2d"]}
    order: list[str] = []
    for n in names:
        order += [x for x in [*need.get(n, []), n] if x not in order]
    head = "WITH " + "RECURSIVE " * recursive + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    return head + (", " + sql[1:] if sql.startswith("+") else " " + sql)
