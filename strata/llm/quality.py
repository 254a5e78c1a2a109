"""Quality by hierarchical empirical Bayes over documents, hosts and paths.

A document classifier (logistic regression on shape statistics of the whole
text, fitted on a bounded sample of labelled documents) gives the evidence of
the text. Labelled outcomes are summed by host and by host and leading path
segments; a host's rate shrinks toward the global rate, a path's toward its
host's, with prior strengths estimated by moments. The final log odds are the document's plus
how far its path's posterior lies from the global rate. A path without a label
takes its host's posterior. Sparse sites so say little, and unknown hosts
nothing; what a document's own label says of its site is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.store import materialize, ship, unused
from strata.llm.url_reputation import url_parts

SAMPLE_ROWS = 12_000
MIN_STRENGTH, MAX_STRENGTH = 2.0, 10_000.0
KEEP = 0.5
SHAPE = ("words", "mean_word", "upper", "digits", "marks", "marked_words", "distinct", "top_word", "short_line", "neighbours")


def shape(text: str | None) -> list[float]:
    """Statistics of the whole text; all zero for null texts or texts without words."""
    ws = (text or "").split()
    if not ws:
        return [0.0] * len(SHAPE)
    n, chars = len(ws), sum(map(len, ws))
    joined = "".join(ws)
    letters = sum(map(str.isalpha, joined))
    counts: dict[str, int] = {}
    for w in ws:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)),
        chars / n,
        sum(map(str.isupper, joined)) / max(1, letters),
        sum(map(str.isdigit, joined)) / chars,
        (chars - sum(map(str.isalnum, joined))) / chars,
        sum(not w[-1].isalnum() for w in ws) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(len(x) < 40 for x in lines) / len(lines),
        sum(map(str.__eq__, ws, ws[1:])) / n,
    ]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs = [shape(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(xs, pa.list_(pa.float64()))], names=["doc_id", "host", "path", "x"])


def _fold() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(centre: str) -> Column:
    """Moments: spread of member rates around ``centre`` against binomial noise."""
    p = F.col("good") / F.col("n")
    noise = F.sum(F.col("n") * F.col(centre) * (1 - F.col(centre))) / F.sum("n")
    spread = F.sum(F.col("n") * (p - F.col(centre)) * (p - F.col(centre))) / F.sum("n")
    share = F.count("*") / F.sum("n")
    k = (noise - spread) / (spread - noise * share)
    bounded = F.least(F.greatest(k, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH))
    return F.when(spread > noise * share, bounded).otherwise(F.lit(MAX_STRENGTH))


def path_level(path: Column) -> Column:
    """The leading segments of a path: what stands before its last one (``/en/123``: ``/en/``); other values as they are."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*/)", 1)).otherwise(path)


def posteriors(marked: DataFrame) -> DataFrame:
    """Rates of the sites of (host, path, label) rows, one row per host and path.

    (host, path, n, good, host_n, host_good, all_n, all_good, kh, kp, overall,
    host_posterior, path_posterior): outcomes counted, prior strengths, and the
    posteriors that follow from them.
    """
    paths = marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    paths = materialize(paths.withColumn("one", F.lit(1)), "sites")
    overall = paths.groupBy("one").agg((F.sum("good") / F.sum("n")).alias("overall"), F.sum("n").alias("all_n"), F.sum("good").alias("all_good"))
    hosts = paths.groupBy("one", "host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).join(F.broadcast(overall), "one")
    kh = hosts.groupBy("one").agg(_strength("overall").alias("kh"))
    hosts = hosts.join(F.broadcast(kh), "one")
    hosts = hosts.select(
        F.col("host").alias("of"), F.col("n").alias("host_n"), F.col("good").alias("host_good"), "all_n", "all_good", "kh", "overall",
        shrunk("good", "n", "kh", F.col("overall")).alias("host_posterior"),
    )
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    kp = both.groupBy("one").agg(_strength("host_posterior").alias("kp"))
    both = both.join(F.broadcast(kp), "one").drop("one")
    return both.withColumn("path_posterior", shrunk("good", "n", "kp", F.col("host_posterior")))


def shrunk(good: str, n: str, strength: str, prior: Column, own: Column | None = None, one: Column | None = None) -> Column:
    """Posterior rate; with ``own`` and ``one`` without one outcome of that value."""
    g, k = (F.col(good), F.col(n)) if own is None else (F.col(good) - own, F.col(n) - one)
    return (g + F.col(strength) * prior) / (k + F.col(strength))


def sites_of_pages(docs: DataFrame, pages: DataFrame, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """``docs`` with host and path of the page that shows the document, if there is one.

    The document is the number after the language in the page's path
    (``/en/123``). Of several pages the least (host, path) counts; documents
    without a page keep what they have.
    """
    host, path = url_parts(F.col("url"))
    doc = F.regexp_extract(path, r"^/[a-z]+/([0-9]{1,18})", 1)
    of, at = unused("page_doc", docs), unused("page_site", docs)
    shown = pages.filter(doc != "").groupBy(doc.cast("long").alias(of)).agg(F.min(F.struct(host.alias("host"), path.alias("path"))).alias(at))
    site = {host_col: "host", path_col: "path"}
    taken = [F.when(F.col(at).isNotNull(), F.col(f"{at}.{site[c]}")).otherwise(docs[c].cast("string")).alias(c) if c in site else docs[c] for c in docs.columns]
    return docs.join(shown, docs["doc_id"].cast("long") == F.col(of), "left").select(*taken)


def rate_quality(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, doc_score, site_posterior, score, kept), one row per input row.

    Labels of documents with crc32(doc_id as text) mod 4 = 2 are held out from
    both the classifier and the site rates. Several labels of one document
    count as good only if all say so, and a document counts once, at the least
    of the sites of its rows. A labelled document's own outcome is left out of
    the rates of its site. Sites are a host and the leading segments of a path;
    null hosts and paths are sites of their own. Without labelled documents
    every score is 0.5 and every row is kept. Null and empty texts have the
    shape of no words; other columns are ignored, whatever their names.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ship(docs.sparkSession)
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).filter("label is not null")
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), path_level(F.col(path_col).cast("string")).alias("path"))
    shaped = materialize(rows.mapInArrow(_shapes, "doc_id long, host string, path string, x array<double>"), "shapes")
    once = shaped.filter(~_fold()).groupBy("doc_id").agg(F.min(F.struct("host", "path", "x")).alias("at"))
    marked = materialize(once.join(marks, "doc_id").select("doc_id", "at.*", "label"), "marked")
    classes = {r.label for r in marked.select("label").distinct().collect()}
    if not classes:
        half = F.lit(0.5)
        return shaped.select("doc_id", _fold().alias("held_out"), half.alias("doc_score"), half.alias("site_posterior"), half.alias("score"), F.lit(True).alias("kept"))
    if len(classes) > 1:
        sample = marked.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), "doc_id").limit(sample_rows)
        ready = materialize(sample.select("x", "label"), "sample").repartition(4, "x").withColumn("features", array_to_vector("x"))
        model = LogisticRegression(regParam=1e-4, maxIter=40, featuresCol="features", labelCol="label").fit(ready)
        scored = model.transform(shaped.withColumn("features", array_to_vector("x"))).withColumn("doc_score", vector_to_array("probability")[1])
    else:
        scored = shaped.withColumn("doc_score", F.lit(float(classes.pop())))
    sites = materialize(posteriors(marked.select("host", "path", "label")).withColumnsRenamed({"host": "h", "path": "p"}), "posteriors")
    hosts = sites.groupBy(F.col("h").alias("hh")).agg(*[F.first(c).alias(f"of_{c}") for c in ("host_n", "host_good", "kh", "host_posterior")])
    overall = marked.agg(F.avg("label")).first()[0]
    own = marked.select(F.col("doc_id").alias("own_id"), F.col("host").alias("own_host"), F.col("path").alias("own_path"), F.col("label").alias("own_label"))
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    joined = joined.join(hosts, F.col("host").eqNullSafe(F.col("hh")), "left").join(own, F.col("doc_id") == F.col("own_id"), "left")
    # One outcome less where the document itself was counted.
    one_host = (F.col("own_id").isNotNull() & F.col("host").eqNullSafe(F.col("own_host"))).cast("int")
    one_path = F.col("path").eqNullSafe(F.col("own_path")).cast("int") * one_host
    label = F.coalesce("own_label", F.lit(0))
    one = F.col("own_id").isNotNull().cast("int")
    rest = F.coalesce(F.try_divide(F.col("all_good") - label * one, F.col("all_n") - one), F.lit(float(overall)))
    of_host = shrunk("of_host_good", "of_host_n", "kh", rest, label * one_host, one_host)
    of_path = shrunk("good", "n", "kp", of_host, label * one_path, one_path)
    alone = shrunk("of_host_good", "of_host_n", "of_kh", F.lit(float(overall)), label * one_host, one_host)
    site = F.coalesce(of_path, alone, F.lit(float(overall)))
    odds = _logit(F.col("doc_score")) + _logit(site) - _logit(F.lit(float(overall)))
    score = 1 / (1 + F.exp(-odds))
    return joined.select("doc_id", _fold().alias("held_out"), "doc_score", site.alias("site_posterior"), score.alias("score"), (score >= KEEP).alias("kept"))
