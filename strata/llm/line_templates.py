"""Line de-duplication with a log-template tree.

Native: DataFrame functions only. A line's tokens that hold a digit become
``<*>``. The tree has fixed depth: token count, then the first LEAD tokens; a
leaf holds the masked lines that share both. In a leaf, a position is fixed
if one token has FIXED_SHARE of its distinct lines there; where at least
SIMILARITY of the positions are fixed, the rest generalise to ``<*>`` as well
and the lines that agree in all fixed positions share that template.

Leaves with several templates, or with a template among other lines, are split
further: a token is frequent at its position if lines of enough texts have it
there. Lines with the same frequent tokens at the same positions form a group,
and a group with SIMILARITY of its positions frequent, one of them beyond the
first LEAD, is a template of its own, however many other lines the leaf holds.

A template recurs if enough different texts have it: MIN_DOCS for short lines,
which recur by chance, MID_DOCS from MID_TOKENS tokens and LONG_DOCS from
LONG_TOKENS tokens on. Its first line (least doc_id, then hash of the text,
then position) stays, all others are dropped. Copies of one text count as one:
whole-document copies are not this operator's business. Lines with fewer than
MIN_TOKENS tokens are judged by the masked line alone; such lines stay if they
are empty or hold no token without a digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.store import keep_keys, materialize, unused

MIN_DOCS, MIN_TOKENS, LEAD = 10, 3, 3
MID_TOKENS, MID_DOCS, LONG_TOKENS, LONG_DOCS = 8, 5, 50, 3
FIXED_SHARE, SIMILARITY = 0.8, 0.75
WILD = "<*>"


def _masked(line: Column) -> Column:
    # Plain searches first: most lines need neither replacement.
    odd = F.lit(False)
    for c in ("  ", "\t", "\r", "\f", "\x0b"):
        odd = odd | F.contains(line, F.lit(c))
    line = F.btrim(F.when(odd, F.regexp_replace(line, r"\s++", " ")).otherwise(line))
    # Anchored at token starts, so that the time stays linear in the text.
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", WILD)).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, line, n) of every line with a token to judge by, masked."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    rows = rows.withColumn("line", _masked(F.col("line")))
    return rows.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1).filter((F.col("n") >= MIN_TOKENS) | ~F.col("line").isin("", *(" ".join([WILD] * n) for n in range(1, MIN_TOKENS))))


def _leaf() -> Column:
    return F.xxhash64("n", F.substring_index("line", " ", LEAD))


def _enough(min_docs: int) -> Column:
    """Different texts that a template of ``n`` tokens must stand in."""
    n = F.col("n")
    return F.when(n >= LONG_TOKENS, F.lit(min(min_docs, LONG_DOCS))).when(n >= MID_TOKENS, F.lit(min(min_docs, MID_DOCS))).otherwise(F.lit(min_docs))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, at, template): the lines to drop, by position in their document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = _lines(docs).select("doc_id", "text_key", "at", "n", _leaf().alias("leaf"), F.xxhash64("n", "line").alias("key"))
    lines = materialize(lines, "lines")
    # Distinct texts per masked line; partial aggregation takes the hot ones.
    keys = materialize(
        lines.groupBy("leaf", "n", "key", "text_key").agg(F.min("at").alias("at")).groupBy("leaf", "n", "key").agg(F.count("*").alias("docs"), F.min(F.struct("text_key", "at")).alias("where")), "keys"
    )
    enough = _enough(min_docs)
    exact = keys.filter(F.col("docs") >= enough).select("key", F.col("key").alias("template"))
    # Leaves whose lines could only together reach the count.
    open_ = keys.groupBy("leaf", "n").agg(F.sum("docs").alias("docs"), F.count("*").alias("members")).filter((F.col("docs") >= enough) & (F.col("members") > 1))
    inside = materialize(keys.join(open_.select("leaf", "members"), "leaf").select("leaf", "n", "key", "members", "docs", "where.*"), "inside")
    # Each of their lines is read again in one place, without masking all the others.
    texts = docs.withColumn("text_key", F.xxhash64("text"))
    texts = keep_keys(texts, inside.select("text_key"), "text_key").groupBy("text_key").agg(F.first("text").alias("text"))
    texts = inside.join(texts, "text_key").select("leaf", "n", "key", "members", "docs", _masked(F.get(F.split("text", "\n", -1), F.col("at"))).alias("line"))
    tokens = materialize(texts.select("leaf", "n", "key", "members", "docs", F.posexplode(F.split("line", " ")).alias("at", "token")), "tokens")
    counted = materialize(tokens.groupBy("leaf", "n", "at", "token", "members").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs")), "counted")
    best = counted.groupBy("leaf", "at", "members").agg(F.max_by("token", F.struct("lines", "token")).alias("token"), F.max("lines").alias("lines"))
    shape = best.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if(F.col("lines") >= FIXED_SHARE * F.col("members")).alias("fixed"))
    shape = shape.filter((F.col("fixed") >= SIMILARITY * F.col("n")) & (F.col("fixed") < F.col("n")))
    fixed = best.filter(F.col("lines") >= FIXED_SHARE * F.col("members")).join(shape.select("leaf", "fixed"), "leaf").select("leaf", "at", "token", "fixed")
    agrees = tokens.join(fixed, ["leaf", "at", "token"]).groupBy("leaf", "n", "key", "docs", "fixed").agg(F.count("*").alias("hits")).filter("hits = fixed")
    wide = agrees.groupBy("leaf", "n").agg(F.sum("docs").alias("all_docs")).filter(F.col("all_docs") >= enough)
    general = agrees.join(wide.select("leaf"), "leaf").select("key", F.col("leaf").alias("template"))
    # Groups within a leaf: the frequent tokens of each line and their positions.
    often = counted.filter(F.col("docs") >= enough).select("leaf", "at", "token")
    signed = tokens.join(often, ["leaf", "at", "token"]).groupBy("leaf", "n", "key", "docs")
    signed = signed.agg(F.bit_xor(F.xxhash64("at", "token")).alias("signature"), F.count("*").alias("fixed"), F.count_if(F.col("at") >= LEAD).alias("beyond"))
    signed = materialize(signed.filter((F.col("fixed") >= SIMILARITY * F.col("n")) & (F.col("fixed") < F.col("n")) & (F.col("beyond") > 0)), "signed")
    groups = signed.groupBy("leaf", "n", "signature").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= enough)
    group = signed.join(groups.select("leaf", "signature"), ["leaf", "signature"]).select("key", F.xxhash64("leaf", "signature").alias("template"))
    # A line under several takes the leaf's template, then its group's.
    chosen = general.select("key", "template", F.lit(2).alias("g")).unionByName(group.select("key", "template", F.lit(1).alias("g"))).unionByName(exact.select("key", "template", F.lit(0).alias("g")))
    chosen = materialize(chosen.groupBy("key").agg(F.max_by("template", "g").alias("template")), "templates")
    hits = materialize(lines.select("doc_id", "text_key", "at", "key").join(chosen, "key").select("doc_id", "text_key", "at", "template"), "hits")
    first = hits.groupBy("template").agg(F.min(F.struct("doc_id", "text_key", "at")).alias("first"))
    same = F.col("first").eqNullSafe(F.struct("doc_id", "text_key", "at"))
    return hits.join(first, "template").filter(~same).select("doc_id", "text_key", "at", "template")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines taken out of the text, all rows and columns kept.

    A null text stays null, a text whose lines all recur becomes empty, other
    lines stay as they are, in order, joined by newlines. Rows that repeat id
    and text get the same result. An empty table stays empty.
    """
    lost = recurring_lines(docs, id_col, text_col, min_docs)
    own, key, at = (unused(c, docs) for c in ("lost_id", "lost_key", "lost_at"))
    lost = lost.groupBy(F.col("doc_id").alias(own), F.col("text_key").alias(key)).agg(F.collect_set("at").alias(at))
    on = docs[id_col].eqNullSafe(F.col(own)) & (F.xxhash64(docs[text_col]) == F.col(key))
    lines = F.split(docs[text_col], "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(at))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col(at).isNull(), docs[text_col]).otherwise(left)
    return docs.join(lost, on, "left").select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
