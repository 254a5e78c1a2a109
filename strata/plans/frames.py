"""Shared derived frames on the test tables (the study's tables re-expressed).

* ``area``   — customer x nation: State, County, custkey, Metro (Urban/Rural),
               segment, c_acctbal, flag (negative balance), flag2 (high balance)
* ``years``  — orders summed per customer and year into a column pop<year> for
               every year that has orders (null where a customer has none)
* ``score``  — lineitem with the unique five-column key, label ``y``
               (return flag R) and two rule scores stacked by ``model``
* ``early`` / ``late`` — lineitem before / from the cut date
* ``indicator`` — per-user count and total of the events of one type; users
               without a large one have no total, like the gaps of the study's tables
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.scalar import binarise
from strata.sources.readers import read_table

# Fixed values of the test-table layout.
LKEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
URBAN_SEGMENTS = ["BUILDING", "AUTOMOBILE"]
PERIOD_CUT = "1998-07-01"
EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]
LARGE_EVENT = 100.0
HIGH_BALANCE = 5000.0


def area(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    n = read_table(spark, d, "nation")
    # nation is a 25-row dimension; the planner broadcasts it from its file size.
    j = c.join(n, c.c_nationkey == n.n_nationkey, "inner")
    return j.select(
        F.col("n_name").alias("State"),
        F.col("c_name").alias("County"),
        F.col("c_custkey").alias("custkey"),
        F.when(F.col("c_mktsegment").isin(*URBAN_SEGMENTS), F.lit("Urban")).otherwise(F.lit("Rural")).alias("Metro"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal"),
        (F.col("c_acctbal") < 0).cast("int").alias("flag"),
        (F.col("c_acctbal") > HIGH_BALANCE).cast("int").alias("flag2"),
    )


def years(spark: SparkSession, d: str) -> DataFrame:
    """Order totals per customer in a column per year; the years are those of the table.

    The list of years is a small aggregate of its own; with it the pivot is one
    hash aggregate. Orders without a date belong to no year.
    """
    o = read_table(spark, d, "orders")
    yr = F.year("o_orderdate")
    found = sorted(r[0] for r in o.select(yr.alias("y")).filter("y is not null").distinct().collect())
    return o.groupBy(F.col("o_custkey").alias("custkey")).agg(
        *[F.sum(F.when(yr == y, F.col("o_totalprice"))).alias(f"pop{y}") for y in found]
    )


RULE_SCORES = {
    "qty": lambda: F.col("l_quantity") / F.lit(50.0),
    "price": lambda: F.least(F.col("l_extendedprice") / F.lit(105000.0), F.lit(1.0)),
}


def score(spark: SparkSession, d: str, models: tuple[str, ...] = ("qty", "price")) -> DataFrame:
    """Rule scores stacked by model from one scan: ``inline`` of an array of
    (model, p1) structs, not a union of one scan per model."""
    li = read_table(spark, d, "lineitem")
    base = [
        *LKEY,
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    ]
    if len(models) == 1:
        m = models[0]
        scored = li.select(*base, F.lit(m).alias("model"), RULE_SCORES[m]().alias("p1"))
    else:
        pairs = [F.struct(F.lit(m).alias("model"), RULE_SCORES[m]().alias("p1")) for m in models]
        scored = li.select(*base, F.inline(F.array(*pairs)))
    return scored.withColumn("prediction", binarise("p1", 0.5))


def lineitem_period(spark: SparkSession, d: str, period: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    cut = F.lit(PERIOD_CUT).cast("timestamp_ntz")
    cond = F.col("l_shipdate") < cut if period == "early" else F.col("l_shipdate") >= cut
    return li.filter(cond)


def indicator(spark: SparkSession, d: str, event_type: str) -> DataFrame:
    """Per-user count and total of the events of one type.

    Every user with such an event has a row. The total is missing for users
    without a large event; the purchase table also carries a text column
    ``tier`` that is missing below a spending level, so missing-data operators
    see nulls of both kinds.
    """
    e = read_table(spark, d, "events").filter(F.col("event_type") == event_type)
    total = F.sum("value")
    aggs = [F.count(F.lit(1)).alias(f"n_{event_type}"), F.when(F.max("value") > LARGE_EVENT, total).alias(f"v_{event_type}")]
    if event_type == "purchase":
        aggs.append(F.when(total >= 250, F.lit("high")).alias("tier"))
    return e.groupBy("user_id").agg(*aggs)


def indicators(spark: SparkSession, d: str) -> list[DataFrame]:
    return [indicator(spark, d, t) for t in EVENT_TYPES]


def indicators_wide(spark: SparkSession, d: str) -> DataFrame:
    """The merged indicator table built in one pass: one scan of events, one
    shuffle on user_id, conditional aggregates per type.

    Equal to the full outer merge of ``indicators`` (a user appears with an event
    of any of the types; a type it lacks gives null count and total), without
    five scans and five shuffles.
    """
    e = read_table(spark, d, "events")
    aggs = []
    for t in EVENT_TYPES:
        is_t = F.col("event_type") == t
        total = F.sum(F.when(is_t, F.col("value")))
        aggs.append(F.nullif(F.count_if(is_t), F.lit(0)).alias(f"n_{t}"))
        aggs.append(F.when(F.max(F.when(is_t, F.col("value"))) > LARGE_EVENT, total).alias(f"v_{t}"))
        if t == "purchase":
            aggs.append(F.when(total >= 250, F.lit("high")).alias("tier"))
    some = F.count_if(F.col("event_type").isin(*EVENT_TYPES))
    return e.groupBy("user_id").agg(*aggs, some.alias("_some")).filter("_some > 0").drop("_some")
