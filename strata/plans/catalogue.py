"""Query catalogue on the test tables: one callable per operator of the survey.

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
column names and types match the SQL oracle of the same name. Floats are
rounded to 4 digits at the very end (``_round``), only for comparison.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from strata.functions import scalar as S
from strata.operators import clean as CL
from strata.operators import categorical as C
from strata.operators import evaluate as EV
from strata.operators import forest as FO
from strata.operators import joins as J
from strata.operators import ml as ML
from strata.operators import profile as P
from strata.operators import setops as SO
from strata.operators import stats as ST
from strata.operators import window as W
from strata.plans import frames as FR
from strata.schema import Roles, non_numeric_columns, numeric_columns
from strata.session import checkpoint_dir
from strata.sources.checked import read_csv_checked
from strata.sources.export import export_committed, read_export
from strata.sources.keyed import merge_stored, store_keyed, store_spine
from strata.sources.readers import read_table
from strata.sources.scored_schema import SCORED_SCHEMA

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _round(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column and fold -0.0 into 0.0."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append((F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- profiles


@query
def group_mean_profile(spark: SparkSession, d: str) -> DataFrame:
    """O-40/O-80: AREA joined to orders, mean balance and order value by Metro, long."""
    a = FR.area(spark, d)
    o = read_table(spark, d, "orders")
    # Pre-aggregate orders per customer (map-side combined) so the join moves
    # one row per customer, not one per order; the means over order rows are
    # then weighted by each customer's order count.
    per_cust = o.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("o_totalprice").alias("_s")
    )
    j = a.join(per_cust, "custkey", "inner")
    wide = j.groupBy("Metro").agg(
        (F.sum(F.col("c_acctbal") * F.col("_n")) / F.sum("_n")).alias("c_acctbal"),
        (F.sum("_s") / F.sum("_n")).alias("o_totalprice"),
    )
    return _round(P.to_long(wide, ids=["Metro"]))


TOPICS = {
    "pricing": ["l_extendedprice", "l_discount", "l_tax"],
    "volume": ["l_quantity"],
}
LINE_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query
def topic_profile(spark: SparkSession, d: str) -> DataFrame:
    """O-28/O-81: named metric topic, selected before the aggregate, means by return flag."""
    li = read_table(spark, d, "lineitem")
    return _round(P.topic_profile(li, ["l_returnflag"], TOPICS, "pricing"))


@query
def group_sum_profile(spark: SparkSession, d: str) -> DataFrame:
    """O-41/O-9: sums of every numeric non-key lineitem column by line status (wide)."""
    li = read_table(spark, d, "lineitem")
    roles = Roles(keys=LINE_KEYS, groups=("l_linestatus",))
    return _round(P.aggregate_metrics(li, ["l_linestatus"], how="sum", roles=roles))


def _qty_scores(spark: SparkSession, d: str) -> DataFrame:
    return FR.score(spark, d, ("qty",))


@query
def composite_profile_mean(spark: SparkSession, d: str) -> DataFrame:
    """O-84/O-85/O-18: mean measures by predicted class x line status, key ``class-status``, long."""
    s = _qty_scores(spark, d).withColumn("pred", F.col("prediction").cast("int"))
    return _round(P.profile(s, ["pred", "l_linestatus"], FR.LINE_MEASURES, how="mean", key="class"))


@query
def composite_profile_sum(spark: SparkSession, d: str) -> DataFrame:
    """O-84: as ``composite_profile_mean`` with sums."""
    s = _qty_scores(spark, d).withColumn("pred", F.col("prediction").cast("int"))
    return _round(P.profile(s, ["pred", "l_linestatus"], FR.LINE_MEASURES, how="sum", key="class"))


@query
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    """O-43/O-83: count by predicted class x line status."""
    return P.class_counts(_qty_scores(spark, d), ["prediction", "l_linestatus"])


@query
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    """O-43a: negative- and high-balance counts by Metro, long."""
    return P.flag_counts(FR.area(spark, d), "Metro", ["flag", "flag2"])


@query
def flag_counts_legacy(spark: SparkSession, d: str) -> DataFrame:
    """O-43a quirk: summing factor level codes (1/2) gives group size + flag count."""
    return P.flag_counts(FR.area(spark, d), "Metro", ["flag", "flag2"], legacy_codes=True)


@query
def area_probability(spark: SparkSession, d: str) -> DataFrame:
    """O-86/O-43b/O-27: ATTR of a per-area probability at (State, segment) grain, Rural/Urban only."""
    a = FR.area(spark, d).filter(F.col("Metro").isin("Rural", "Urban"))
    a = a.withColumn("p", F.col("flag").cast("double"))
    return P.attr_by(a, ["State", "segment"], "p")


@query
def rollup_state(spark: SparkSession, d: str) -> DataFrame:
    """O-43c/O-22: State -> Metro drill path totals with record counts and grouping level."""
    return _round(P.rollup_totals(FR.area(spark, d), ["State", "Metro"], ["c_acctbal"]))


@query
def drill_defaults(spark: SparkSession, d: str) -> DataFrame:
    """O-43c/O-43b: State -> Metro drill path, each field by its own default aggregate."""
    a = FR.area(spark, d).withColumn("low", F.col("c_acctbal")).withColumn("high", F.col("c_acctbal"))
    a = P.with_aggregate(a, c_acctbal="mean", segment="attr", custkey="count", low="min", high="max")
    return _round(P.drill_path(a, ["State", "Metro"]))


@query
def scatter_sample(spark: SparkSession, d: str) -> DataFrame:
    """O-59/O-82: 100 customers of each segment with the share they stand for."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return _round(ST.sample_by_class(c, ["c_mktsegment"], ["c_custkey"], 100))


@query
def year_totals(spark: SparkSession, d: str) -> DataFrame:
    """O-79/O-55/O-42/O-19/O-12/O-10: yearly order totals (millions) by Metro."""
    a = FR.area(spark, d).select("custkey", "Metro")
    y = FR.years(spark, d)
    j = a.join(y, "custkey", "inner")
    return _round(P.year_series(j, ["Metro"], "pop", unit=1e6, na_rm=True))


@query
def density_by_group(spark: SparkSession, d: str) -> DataFrame:
    """O-44 (aggregate form): area = sum(size), pop = sum(price), density = pop / area."""
    part = read_table(spark, d, "part")
    out = P.group_totals(
        part, ["p_brand", "p_type"], {"area": "p_size", "pop": "p_retailprice"}, ratio=("density", "pop", "area")
    )
    return _round(out)


@query
def density_window(spark: SparkSession, d: str) -> DataFrame:
    """O-44 literal window form incl. the reference quirk (density summed over the group's rows)."""
    part = read_table(spark, d, "part")
    t = W.group_totals_window(part, ["p_brand", "p_type"], {"area": "p_size", "pop": "p_retailprice"}, "_rows")
    # Quirk: the reference sums the (already constant) ratio over the group's rows.
    t = t.withColumn("density", F.col("_rows") * F.try_divide(F.col("pop"), F.col("area"))).drop("_rows")
    return _round(t)


@query
def density_detail(spark: SparkSession, d: str) -> DataFrame:
    """O-11/O-59/O-82: per-part price per size unit (safe ratio) with a class key."""
    part = read_table(spark, d, "part")
    return _round(
        part.select(
            "p_partkey",
            S.paste("p_type", "p_brand").alias("class"),
            S.safe_ratio("p_retailprice", "p_size").alias("density"),
        )
    )


@query
def density_bins(spark: SparkSession, d: str) -> DataFrame:
    """O-59/O-82 bounded form: price vs size scatter reduced to a 10 x 10 grid per part type."""
    part = read_table(spark, d, "part")
    return _round(ST.bin2d(part, "p_size", "p_retailprice", (10, 10), ["p_type"]))


@query
def recode_class(spark: SparkSession, d: str) -> DataFrame:
    """O-13: recode status codes to labels, unmatched codes unchanged."""
    o = read_table(spark, d, "orders")
    return o.select("o_orderkey", S.recode("o_orderstatus", {"F": "Filled", "O": "Open"}).alias("status"))


@query
def level_codes(spark: SparkSession, d: str) -> DataFrame:
    """O-17: factor level codes (1-based, levels sorted) of the market segment."""
    c = read_table(spark, d, "customer")
    return C.level_codes(c.select("c_custkey", "c_mktsegment"), "c_mktsegment", "level")


@query
def safe_casts(spark: SparkSession, d: str) -> DataFrame:
    """O-16: identifier to text, text to number with bad values -> null."""
    part = read_table(spark, d, "part")
    return part.select(
        "p_partkey",
        S.to_text("p_partkey").alias("key_text"),
        S.to_number(F.substring_index("p_brand", "#", -1), "int").alias("brand_no"),
        S.to_number("p_name", "double").alias("name_num"),
    )


@query
def composite_key(spark: SparkSession, d: str) -> DataFrame:
    """O-18: ``paste`` key where a missing part prints as NA."""
    a = FR.area(spark, d)
    return a.select("custkey", S.paste("Metro", F.nullif(F.col("segment"), F.lit("HOUSEHOLD"))).alias("key"))


@query
def type_split(spark: SparkSession, d: str) -> DataFrame:
    """O-9: the numeric side of a table (key kept, key role not scaled)."""
    part = read_table(spark, d, "part")
    num = numeric_columns(part, Roles(keys=("p_partkey",)))
    return part.select("p_partkey", *num)


@query
def type_split_text(spark: SparkSession, d: str) -> DataFrame:
    """O-9: the non-numeric side of the same split: values and distinct values of each column."""
    li = read_table(spark, d, "lineitem")
    texts = non_numeric_columns(li)
    wide = li.agg(*[f(F.col(c)).alias(f"{c}_{k}") for c in texts for k, f in (("n", F.count), ("d", F.count_distinct))])
    rows = [F.struct(F.lit(c).alias("variable"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_d").alias("values")) for c in texts]
    return wide.select(F.inline(F.array(*rows)))


@query
def outlier_labels(spark: SparkSession, d: str) -> DataFrame:
    """O-15: label a nation only where its mean balance is above a threshold."""
    a = FR.area(spark, d)
    g = a.groupBy("State").agg(F.avg("c_acctbal").alias("mean_balance"))
    return _round(g.withColumn("label", S.label_if(F.col("mean_balance") > 4500.0, "State")))


@query
def cohort_filter(spark: SparkSession, d: str) -> DataFrame:
    """O-24: compound equality filter on the scored rows."""
    s = FR.score(spark, d)
    f = s.filter((F.col("model") == "qty") & (F.col("y") == 1) & (F.col("l_linestatus") == "F"))
    return _round(f.select(*FR.LKEY, "p1"))


@query
def key_length_filter(spark: SparkSession, d: str) -> DataFrame:
    """O-25/O-20: keep rows whose source code has at most 4 characters."""
    docs = read_table(spark, d, "documents").select("doc_id", "source", "lang")
    return CL.key_length_filter(docs, "source", 4)


@query
def probability_bins(spark: SparkSession, d: str) -> DataFrame:
    """O-23: fixed 0.1-wide probability bins (closed top folded into bin 9), counts per model."""
    s = FR.score(spark, d).withColumn("bin", S.fixed_bin("p1", 0.1, 0.0, top_bin=9))
    return s.groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- missing data on the indicator merge


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """The merged indicator table (one scan, one shuffle); equal to the outer
    merge of the five indicator tables, which ``outer_merge_*`` exercise."""
    return FR.indicators_wide(spark, d)


IND_NUMERIC = [c for t in FR.EVENT_TYPES for c in (f"n_{t}", f"v_{t}")]


@query
def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    """O-29: fill numerics with 0 and text with "0"."""
    return _round(CL.fill_missing(_merged(spark, d)))


@query
def fill_levels(spark: SparkSession, d: str) -> DataFrame:
    """O-29/O-30: numbers, text and a factor with level "0" are filled; a factor without it stays missing."""
    k = F.col("c_custkey")
    c = read_table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(k % 3 > 0, F.col("c_name")).alias("word"),
        F.when(k % 4 > 0, (F.col("c_acctbal") < 0).cast("int").cast("string")).alias("flag"),
        F.when(k % 5 > 0, F.col("c_mktsegment")).alias("segment"),
    )
    c = C.as_factor(C.as_factor(c, "flag", ["0", "1"]), "segment")
    filled = CL.fill_missing(c)
    return _round(filled.withColumn("complete", F.col("segment").isNotNull().cast("int")))


@query
def drop_incomplete(spark: SparkSession, d: str) -> DataFrame:
    """O-30: ``na.omit``."""
    return _round(CL.drop_incomplete(_merged(spark, d)))


@query
def missing_profile(spark: SparkSession, d: str) -> DataFrame:
    """O-34: share missing per column and overall."""
    return _round(CL.missing_profile(_merged(spark, d)))


@query
def roughfix_impute(spark: SparkSession, d: str) -> DataFrame:
    """O-33: median for numerics (as R numeric), most frequent value for text."""
    m = _merged(spark, d)
    m = m.select("user_id", *[F.col(c).cast("double").alias(c) for c in IND_NUMERIC], "tier")
    return _round(CL.roughfix_impute(m, IND_NUMERIC, ["tier"]))


@query
def null_policy_sum(spark: SparkSession, d: str) -> DataFrame:
    """O-32: sums with NA skipped vs NA propagated."""
    return _round(CL.null_policy_sum(_merged(spark, d), IND_NUMERIC))


# ---------------------------------------------------------------- joins


@query
def label_backfill(spark: SparkSession, d: str) -> DataFrame:
    """O-3/O-31/O-37: positive-only list (toxic docs) backfilled to 0/1, counts by language."""
    docs = read_table(spark, d, "documents").select("doc_id", "lang")
    pos = read_table(spark, d, "labels").filter(F.col("toxic") == 1)
    labelled = J.label_backfill(docs, pos, ["doc_id"], "toxic")
    return labelled.groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query
def natural_inner(spark: SparkSession, d: str) -> DataFrame:
    """O-35: natural inner join on all common columns (custkey)."""
    return _round(J.merge(FR.area(spark, d), FR.years(spark, d), how="inner"))


@query
def composite_join(spark: SparkSession, d: str) -> DataFrame:
    """O-36: join two aggregates on a two-column key; the planner chooses the join."""
    li = read_table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_returnflag"]
    qty = li.groupBy(*keys).agg(F.sum("l_quantity").alias("qty"))
    price = li.groupBy(*keys).agg(F.max("l_extendedprice").alias("max_price"))
    return _round(J.merge(qty, price, on=keys, how="inner"))


@query
def outer_merge_n(spark: SparkSession, d: str) -> DataFrame:
    """O-38: five indicator tables, full outer fold on the common key."""
    return _round(J.merge_all(FR.indicators(spark, d), how="full"))


@query
def outer_merge_union(spark: SparkSession, d: str) -> DataFrame:
    """O-38: the same result from one union + one aggregate (keys unique per table)."""
    return _round(J.merge_all_union(FR.indicators(spark, d), ["user_id"]))


@query
def outer_merge_stored(spark: SparkSession, d: str) -> DataFrame:
    """O-4/O-38: the indicator tables stored by key, merged without moving a row."""
    mark = uuid.uuid4().hex[:12]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows without a user are no row of any table.
    tables = [(t, FR.indicator(spark, d, t).filter("user_id is not null")) for t in FR.EVENT_TYPES]
    names = [store_keyed(df, f"ind_{t}_{mark}", ["user_id"], buckets) for t, df in tables]
    spine = store_spine(spark, names, f"ind_{mark}", ["user_id"], buckets)
    return _round(merge_stored(spark, names, ["user_id"], spine))


@query
def prepare_indicators(spark: SparkSession, d: str) -> DataFrame:
    """O-78: merge -> valid keys -> casts -> fill -> omit -> z-score, one lazy plan."""
    m = J.merge_all_union(FR.indicators(spark, d), ["user_id"])
    m = m.filter(F.col("user_id").isNotNull())
    m = m.select(
        S.to_text("user_id").alias("user_id"),
        *[F.col(c).cast("double").alias(c) for c in IND_NUMERIC],
        F.col("tier").cast("string").alias("tier"),
    )
    m = CL.drop_incomplete(CL.fill_missing(m))
    return _round(ST.zscore(m, IND_NUMERIC))


# ---------------------------------------------------------------- statistics


@query
def zscore(spark: SparkSession, d: str) -> DataFrame:
    """O-58/O-39: z-score measures in place (sample sd), keys untouched."""
    li = read_table(spark, d, "lineitem").select(*FR.LKEY, "l_quantity", "l_discount", "l_tax")
    return _round(ST.zscore(li, ["l_quantity", "l_discount", "l_tax"]))


@query
def zscore_two_period(spark: SparkSession, d: str) -> DataFrame:
    """O-58: early and late periods each standardised on their own statistics
    (one statistics row per period, one pass over the rows)."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    # A null ship date belongs to neither period, as with the two filters it replaces.
    li = read_table(spark, d, "lineitem").filter(F.col("l_shipdate").isNotNull())
    cut = F.lit(FR.PERIOD_CUT).cast("timestamp_ntz")
    li = li.select(
        *FR.LKEY, *cols, F.when(F.col("l_shipdate") < cut, F.lit("early")).otherwise(F.lit("late")).alias("period")
    )
    return _round(ST.zscore_by(li, cols, ["period"]))


@query
def trend_smooth(spark: SparkSession, d: str) -> DataFrame:
    """O-57/O-26: loess trend of price on size, 80 grid points, span 0.75."""
    part = read_table(spark, d, "part")
    return _round(ST.loess_trend(part, "p_size", "p_retailprice", span=0.75, points=80, xlim=(5, 45)))


@query
def trend_interpolate(spark: SparkSession, d: str) -> DataFrame:
    """O-57/O-26: the same trend on the interpolated surface, with limits on both axes."""
    part = read_table(spark, d, "part")
    return _round(ST.loess_trend(part, "p_size", "p_retailprice", xlim=(5, 45), ylim=(950, 1900), surface="interpolate"))


# ---------------------------------------------------------------- windows, ranking, evaluation


@query
def decile_assign(spark: SparkSession, d: str) -> DataFrame:
    """O-45: ntile(10) by descending score per model, unique five-column tie key."""
    s = FR.score(spark, d).select("model", *FR.LKEY, "p1")
    return EV.decile_assign(s, "p1", FR.LKEY).select("model", *FR.LKEY, "bin")


@query
def running_share(spark: SparkSession, d: str) -> DataFrame:
    """O-46/O-47: share of positives per probability bin and its running total."""
    s = FR.score(spark, d).withColumn("bin", S.fixed_bin("p1", 0.1, 0.0, top_bin=9))
    per_bin = s.groupBy("model", "bin").agg(F.sum("y").cast("long").alias("positives"))
    shared = W.share_of_total(per_bin, "positives", "share", ["model"])
    return _round(W.running_sum(shared, "share", "bin", "cum_share", ["model"]))


@query
def lift_deciles(spark: SparkSession, d: str) -> DataFrame:
    """O-75/O-56: cumulative gain per model plus the base line."""
    return _round(EV.lift_table(FR.score(spark, d), "y", "p1", FR.LKEY))


@query
def top_scored(spark: SparkSession, d: str) -> DataFrame:
    """O-48: top 100 scored rows (limit is the feature), unique tie order."""
    s = FR.score(spark, d).select("model", *FR.LKEY, "p1")
    order = [F.col("p1").desc(), *[F.col(k).asc() for k in FR.LKEY], F.col("model").asc()]
    return _round(SO.top_k(s, order, 100))


@query
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    """O-52: distinct (model, class, status) keys."""
    return SO.distinct_rows(FR.score(spark, d), ["model", "prediction", "l_linestatus"])


@query
def reorder_by_mean(spark: SparkSession, d: str) -> DataFrame:
    """O-50: order priorities by mean order value."""
    o = read_table(spark, d, "orders")
    return _round(SO.reorder_by_mean(o, "o_orderpriority", "o_totalprice"))


@query
def melt_default(spark: SparkSession, d: str) -> DataFrame:
    """O-53: wide aggregate to long; ids default to the non-numeric columns."""
    li = read_table(spark, d, "lineitem")
    wide = li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.avg("l_discount").alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )
    return _round(P.to_long(wide))


@query
def melt_ids(spark: SparkSession, d: str) -> DataFrame:
    """O-54: wide aggregate to long with explicit ids."""
    a = FR.area(spark, d)
    wide = a.groupBy("Metro").agg(
        F.avg("c_acctbal").alias("mean_balance"),
        F.sum("flag").cast("long").alias("negatives"),
        F.count(F.lit(1)).alias("customers"),
    )
    return _round(P.to_long(wide, ids=["Metro"]))


def _cohort_input(spark: SparkSession, d: str) -> DataFrame:
    return FR.years(spark, d).join(FR.area(spark, d).select("custkey", "flag"), "custkey", "inner")


@query
def cohort_change(spark: SparkSession, d: str) -> DataFrame:
    """O-60/O-51: cohorts by sign of pop2000 - pop1996 x flag, every customer tallied once.

    Order rows repeat their customer, so the de-duplication has work to do.
    """
    orders = read_table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    rows = _cohort_input(spark, d).join(orders, "custkey", "inner")
    return SO.cohort_change(rows, "pop2000", "pop1996", "flag", keys=["custkey"])


@query
def cohort_change_legacy(spark: SparkSession, d: str) -> DataFrame:
    """O-60 quirk: the no-flag loss cohort filters ``net > 0`` as in the reference."""
    return SO.cohort_change(_cohort_input(spark, d), "pop2000", "pop1996", "flag", legacy_labels=True)


@query
def auc_hard(spark: SparkSession, d: str) -> DataFrame:
    """O-73: AUC of hard predictions, x100."""
    return _round(EV.auc_hard(FR.score(spark, d), "y", "prediction"))


@query
def auc_ranked(spark: SparkSession, d: str) -> DataFrame:
    """O-73: exact AUC of the scores with tie-averaged ranks, x100."""
    return _round(EV.auc_ranked(FR.score(spark, d), "y", "p1"))


@query
def accuracy_cutpoint(spark: SparkSession, d: str) -> DataFrame:
    """O-74/O-14: accuracy at cutpoint 0.5, x100."""
    return _round(EV.accuracy(FR.score(spark, d), "y", "p1", 0.5))


@query
def metrics_long(spark: SparkSession, d: str) -> DataFrame:
    """O-76: model x (AUC, Accuracy), long."""
    return _round(EV.metrics_long(FR.score(spark, d), "y", "prediction"))


@query
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """O-62: deterministic 75/25 split from the line key, counts per part."""
    li = read_table(spark, d, "lineitem")
    split = ML.hash_split(li, FR.LKEY, 0.25)
    return split.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query
def scored_export(spark: SparkSession, d: str) -> DataFrame:
    """O-6: scored rows joined with their order, with a global row index F1."""
    s = _qty_scores(spark, d)
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = s.join(o, s.l_orderkey == o.o_orderkey, "inner").select(
        *FR.LKEY, "o_custkey", "o_orderpriority", "y", "p1", "prediction"
    )
    path = f"{checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex[:12]}"
    export_committed(j, path, FR.LKEY)
    return _round(read_export(spark, path, StructType([StructField("F1", LongType()), *j.schema.fields])))


# How often the written characteristics hold a bad income, a short record and a quoted name.
BAD_INCOME, SHORT_RECORD, QUOTED_NAME = 41, 53, 7


@query
def csv_checked(spark: SparkSession, d: str) -> DataFrame:
    """O-1/O-2: a 61-column table written as CSV lines, some of them bad, and read back with a reject side."""
    a = FR.area(spark, d)
    k = F.col("custkey")
    known = {
        "F1": k, "FIPS": k + 1000, "State": F.col("State"),
        "County": F.when(k % QUOTED_NAME == 0, F.concat(F.lit('"'), "County", F.lit(', Co."'))).otherwise(F.col("County")),
        "prediction": (F.col("c_acctbal") > 0).cast("int"), "Metro2013": F.col("Metro"),
        "Med.Income": F.when(k % BAD_INCOME == 0, F.lit("n/a")).otherwise((k * 32 % 1000).cast("string")),
    }
    fields = []
    for i, f in enumerate(SCORED_SCHEMA.fields):
        number = (k * (i + 1)) % 1000
        value = known.get(f.name, number if isinstance(f.dataType, IntegerType) else number / F.lit(8.0))
        fields.append(value.cast("string"))
    record = F.when(k % SHORT_RECORD == 0, F.concat_ws(",", *fields[:-2])).otherwise(F.concat_ws(",", *fields))
    path = f"{checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex[:12]}"
    a.select(record.alias("value")).write.text(path)
    rows, rejects = read_csv_checked(spark, path, SCORED_SCHEMA, header=False)
    none = F.lit(0).cast("long")
    kept = rows.agg(F.count(F.lit(1)).alias("n"), none.alias("places"), F.sum("Med_Income").alias("income"), F.sum("Pov_All").alias("poverty"), F.sum("F1").alias("keys"))
    thrown = rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file", "line").alias("places"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("income", "long"), ("poverty", "double"), ("keys", "long"))]
    return _round(
        kept.select(F.lit("kept").alias("side"), F.lit("").alias("reason"), *kept.columns).unionByName(
            thrown.select(F.lit("rejected").alias("side"), "reason", "n", "places", *empty)
        )
    )


# ---------------------------------------------------------------- machine learning

ML_SPEC = ML.FeatureSpec(
    label="y",
    numeric=["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    categorical=["l_linestatus"],
)


# The bar that a line's charge must pass to count as costly, by return flag.
RETURNED_BAR, OTHER_BAR = 30000.0, 60000.0


def _costly() -> Column:
    """Model label: the charge (price less discount, plus tax) is above the bar.

    The charge follows from the features, the return flag does not: the label
    can be learned, but no model can separate it.
    """
    charge = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) * (F.lit(1.0) + F.col("l_tax"))
    bar = F.when(F.col("l_returnflag") == "R", F.lit(RETURNED_BAR)).otherwise(F.lit(OTHER_BAR))
    return F.coalesce(charge > bar, F.lit(False)).cast("int").alias("y")


def _ml_table(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    return li.select(*FR.LKEY, *[c for c in ML_SPEC.columns if c not in FR.LKEY], _costly())


def _ml_split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hash split of the model table, checkpointed once for both sides."""
    # One scan, one rebalancing shuffle, one checkpoint for both sides: the
    # training rows feed many passes and the hold-out rows are scored by
    # several models (and permuted copies).
    t = ML.materialize(ML.hash_split(_ml_table(spark, d), FR.LKEY, 0.25), FR.LKEY)
    train = t.filter(F.col("part") == "training").drop("part")
    test = t.filter(F.col("part") == "test").drop("part")
    return train, test


def _one_model(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        train, test = _ml_split(spark, d)
        model = ML.fit(ML.estimators()[name], train, ML_SPEC)
        return _round(ML.score(model, test, ML_SPEC, FR.LKEY, name))

    return run


QUERIES["model_logistic"] = _one_model("Logistic")
QUERIES["model_tree"] = _one_model("Decision Tree")
QUERIES["model_forest"] = _one_model("Random Forest")
QUERIES["model_gbt"] = _one_model("Gradient Boosted Trees")


@query
def score_table(spark: SparkSession, d: str) -> DataFrame:
    """O-67/O-48: logistic scores of the hold-out rows, most likely positives first."""
    train, test = _ml_split(spark, d)
    model = ML.fit(ML.estimators()["Logistic"], train, ML_SPEC)
    scored = ML.score(model, test, ML_SPEC, [*FR.LKEY, "l_linestatus"], "Logistic")
    return _round(scored.orderBy(F.col("probability_1").desc(), *FR.LKEY))


@query
def model_scores_long(spark: SparkSession, d: str) -> DataFrame:
    """O-68/O-88: all four models scored on the hold-out rows, one long table."""
    train, test = _ml_split(spark, d)
    models = ML.fit_all(train, ML_SPEC)
    return _round(ML.score_all(models, test, ML_SPEC, FR.LKEY))


@query
def model_checks(spark: SparkSession, d: str) -> DataFrame:
    """O-62…O-68: what holds for every classifier on the hold-out rows.

    Each model scores every hold-out row; the two probabilities of a row sum
    to 1; the prediction is the class above 0.5; the accuracy beats the more
    frequent class.
    """
    train, test = _ml_split(spark, d)
    s = ML.score_all(ML.fit_all(train, ML_SPEC), test, ML_SPEC, FR.LKEY)
    p0, p1 = F.col("probability_0"), F.col("probability_1")
    found = s.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").cast("long").alias("positives"),
        F.count_if(F.abs(p0 + p1 - 1.0) > 1e-9).alias("bad_probability"),
        F.count_if(F.col("prediction") != (p1 > 0.5).cast("double")).alias("bad_prediction"),
        F.count_if(F.col("prediction") == F.col("y")).alias("_hits"),
    )
    base = F.greatest(F.col("positives"), F.col("n") - F.col("positives"))
    return found.withColumn("beats_base", (F.col("_hits") > base).cast("int")).drop("_hits")


@query
def model_moments(spark: SparkSession, d: str) -> DataFrame:
    """O-61/O-63/O-64: fitted shares on the training rows.

    At its optimum the unregularised logistic model satisfies sum(x * p) =
    sum(x * y) for the intercept and every feature; the leaves of a tree hold
    the shares of their rows, so sum(p) = sum(y). Given as a share of sum(x).
    """
    train, _ = _ml_split(spark, d)
    models = ML.fit_all(train, ML_SPEC, ["Logistic", "Decision Tree"])
    keep = [*FR.LKEY, *[c for c in ML_SPEC.numeric if c not in FR.LKEY]]
    s = ML.score_all(models, train, ML_SPEC, keep)
    terms = {"intercept": F.lit(1.0), **{c: F.col(c) for c in ML_SPEC.numeric}}
    wide = s.groupBy("model").agg(*[(F.sum(x * F.col("probability_1")) / F.sum(x)).alias(t) for t, x in terms.items()])
    rows = [F.struct(F.lit(t).alias("term"), F.col(t).alias("share")) for t in terms]
    return _round(wide.select("model", F.inline(F.array(*rows))).filter("model = 'Logistic' or term = 'intercept'"))


@query
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """O-69/O-49/O-21: decision-tree importances per source column, ranked, with cumulative share."""
    train, _ = _ml_split(spark, d)
    model = ML.fit(ML.estimators()["Decision Tree"], train, ML_SPEC)
    return _round(ML.importance_frame(spark, ML.feature_importance(model, train, ML_SPEC)))


@query
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """O-70: forest importances — mean decrease in impurity (Gini) next to the
    hold-out accuracy drop when the feature is permuted."""
    train, test = _ml_split(spark, d)
    model = ML.fit(ML.estimators()["Random Forest"], train, ML_SPEC)
    gini = spark.createDataFrame(ML.feature_importance(model, train, ML_SPEC), "feature string, gini double")
    perm = ML.permutation_importance(model, test, ML_SPEC, FR.LKEY)
    return _round(gini.join(perm, "feature", "inner"))


@query
def forest_error_curve(spark: SparkSession, d: str) -> DataFrame:
    """O-71: hold-out error for 1 … 100 trees."""
    train, test = _ml_split(spark, d)
    return _round(ML.forest_error_curve(train, test, ML_SPEC))


def _binned(spark: SparkSession, d: str) -> FO.Binned:
    return FO.bin_features(_ml_table(spark, d), ML_SPEC, FR.LKEY)


@query
def feature_cuts(spark: SparkSession, d: str) -> DataFrame:
    """O-64…O-66: the exact 1/32 quantiles at which trees may cut each numeric feature."""
    cuts = FO.quantile_cuts(_ml_table(spark, d), ML_SPEC.numeric)
    rows = [(c, float(v)) for c, values in cuts.items() for v in values]
    return spark.createDataFrame(rows, "feature string, cut double")


@query
def root_gains(spark: SparkSession, d: str) -> DataFrame:
    """O-64/O-69: what the best cut of all rows by each feature gains, the first split of a tree."""
    return _round(FO.root_gains(_binned(spark, d)))


@query
def feature_ranking(spark: SparkSession, d: str) -> DataFrame:
    """O-49/O-72/O-21: source columns by the gain of their best cut, cumulative share, the first three selected."""
    return _round(FO.rank_features(_binned(spark, d), 3))


@query
def forest_bags(spark: SparkSession, d: str) -> DataFrame:
    """O-65/O-71: rows inside and outside the bag of each of the forest's 100 trees."""
    return FO.bags(_binned(spark, d).rows)


@query
def oob_error_curve(spark: SparkSession, d: str) -> DataFrame:
    """O-71: out-of-bag error, overall and by class, of the first 1 … 100 trees of a forest on all rows."""
    binned = _binned(spark, d)
    return _round(FO.oob_error_curve(binned, FO.grow(binned)))


@query
def oob_importance(spark: SparkSession, d: str) -> DataFrame:
    """O-70: mean decrease in out-of-bag accuracy with its standard error, and mean decrease in Gini."""
    binned = _binned(spark, d)
    return _round(FO.oob_importance(binned, FO.grow(binned)))


@query
def refit_top_features(spark: SparkSession, d: str) -> DataFrame:
    """O-72/O-76: keep the top-3 tree features, refit all four models, metrics long."""
    train, test = _ml_split(spark, d)
    tree = ML.fit(ML.estimators()["Decision Tree"], train, ML_SPEC)
    top = ML.select_features(ML.feature_importance(tree, train, ML_SPEC), 3)
    spec = ML_SPEC.only(top)
    scored = ML.score_all(ML.fit_all(train, spec), test, spec, FR.LKEY)
    return _round(EV.metrics_long(scored, "y", "prediction"))


@query
def two_period_score(spark: SparkSession, d: str) -> DataFrame:
    """O-77: fit on the whole early period, score the late period."""
    cols = [*FR.LKEY, *[c for c in ML_SPEC.columns if c not in FR.LKEY]]
    early = FR.lineitem_period(spark, d, "early").select(*cols, _costly())
    late = FR.lineitem_period(spark, d, "late").select(*cols, _costly())
    model = ML.fit(ML.estimators()["Logistic"], ML.materialize(early, FR.LKEY), ML_SPEC)
    return _round(ML.score(model, late, ML_SPEC, FR.LKEY, "Logistic"))


@query
def two_period_checks(spark: SparkSession, d: str) -> DataFrame:
    """O-77/O-67: what holds for a model fitted on the whole early period, by period.

    Every row of both periods is scored, probabilities sum to 1 and decide the
    prediction; on the rows it was fitted on, the mean probability is the share
    of positives.
    """
    cols = [*FR.LKEY, *[c for c in ML_SPEC.columns if c not in FR.LKEY]]
    early = ML.materialize(FR.lineitem_period(spark, d, "early").select(*cols, _costly()), FR.LKEY)
    late = FR.lineitem_period(spark, d, "late").select(*cols, _costly())
    model = ML.fit(ML.estimators()["Logistic"], early, ML_SPEC)
    s = SO.union_all(
        [ML.score(model, rows, ML_SPEC, FR.LKEY, "Logistic").withColumn("period", F.lit(name)) for name, rows in (("early", early), ("late", late))]
    )
    p0, p1 = F.col("probability_0"), F.col("probability_1")
    found = s.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").cast("long").alias("positives"),
        F.count_if((F.abs(p0 + p1 - 1.0) > 1e-9) | (F.col("prediction") != (p1 > 0.5).cast("double"))).alias("bad"),
        F.avg("probability_1").alias("share"),
    )
    return _round(found.withColumn("share", F.when(F.col("period") == "early", F.col("share"))))


@query
def predicted_class_profile(spark: SparkSession, d: str) -> DataFrame:
    """O-77 -> O-84/O-85 end to end: fit on the early period, score the late
    period, then publish mean measures by predicted class x line status
    (composite ``class-status`` key, long form) — the results-chart dataset."""
    cols = [*FR.LKEY, *[c for c in ML_SPEC.columns if c not in FR.LKEY]]
    early = FR.lineitem_period(spark, d, "early").select(*cols, _costly())
    late = FR.lineitem_period(spark, d, "late").select(*cols, _costly())
    model = ML.fit(ML.estimators()["Logistic"], ML.materialize(early, FR.LKEY), ML_SPEC)
    scored = ML.score(model, late, ML_SPEC, [*FR.LKEY, "l_quantity", "l_discount", "l_tax", "l_linestatus"], "Logistic")
    scored = scored.withColumn("pred", F.col("prediction").cast("int"))
    return _round(P.profile(scored, ["pred", "l_linestatus"], FR.LINE_MEASURES, how="mean", key="class"))
