"""Removal of lines that many sites carry.

A line's spread is the number of distinct sites (values of `source`) that have it. Sketches
of the sites are merged for each line hash; where a sketch says that a line is near the
threshold, its distinct sites are counted exactly. Lines at or above the threshold are
boilerplate and go, from every document but those that have no other line with more than white
space: these are copies rather than pages with boilerplate, and are left whole to the
near-duplicate join. The query op10_line_dedup follows its SQL instead, which leaves documents
whole by the share of their characters in such lines.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table, written

#: A line on so many sites is boilerplate.
SITES = 10
#: Base-2 logarithm of the sketches' registers.
REGISTERS = 9
#: Estimates this far from SITES, as a share, are trusted.
TRUSTED = 0.25
#: The query leaves a document with more than this share of its characters in such lines whole, as its SQL does.
MOSTLY = 0.5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _without(lines: Column, gone: Column) -> Column:
    """`lines` but those at the places `gone`, which are in order; in time that grows with their number only."""

    def upto(i: Column) -> Column:
        between = F.get(gone, i) - F.coalesce(F.get(gone, i - 1), F.lit(-1)) - 1
        return F.concat(F.array_repeat(F.lit(False), between), F.array(F.lit(True)))

    goes = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone) - 1), upto))
    kept = F.filter(F.arrays_zip(lines.alias("line"), goes.alias("goes")), lambda x: ~F.coalesce(x["goes"], F.lit(False)))
    return F.transform(kept, lambda x: x["line"])


def boilerplate(docs: DataFrame, text: str = "text", source: str = "source", sites: int = SITES) -> DataFrame:
    """Hashes (`_line`) of the lines that `sites` distinct sites or more have.

    Lines are compared without the spaces around them; blank ones don't count. A null
    source is a site of its own. A null text has no lines.
    """
    site = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    lines = docs.select(F.explode(_lines(F.col(text))).alias("_text"), site.alias("_site")).where(F.trim("_text") != "").select(_key(F.col("_text")).alias("_line"), "_site")
    spread = lines.groupBy("_line").agg(F.hll_sketch_agg("_site", F.lit(REGISTERS)).alias("_sketch")).select("_line", F.hll_sketch_estimate("_sketch").alias("_spread"))
    wide = written(spread.where(F.col("_spread") >= sites * (1 - TRUSTED)), "line-spread")
    near = wide.where(F.col("_spread") <= sites * (1 + TRUSTED)).select("_line")
    exact = lines.join(near, "_line", "left_semi").distinct().groupBy("_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= sites).select("_line")
    return written(wide.where(F.col("_spread") > sites * (1 + TRUSTED)).select("_line").union(exact), "boilerplate")


def cleaned(docs: DataFrame, text: str = "text", source: str = "source", sites: int = SITES, counts: bool = False, mostly: float | None = None) -> DataFrame:
    """`docs` with boilerplate lines taken out of `text`; all columns and rows stay.

    A document is left whole only where no line with more than white space would stay; with
    `mostly`, instead, where more than this share of its characters are in boilerplate lines.
    With `counts`, the columns n_lines, n_boilerplate and kept_whole follow. A null text
    stays null with no lines, an empty one has one line. Repeated rows are treated alike.
    The lines that stay keep their order and their white space.
    """
    wide = boilerplate(docs, text, source, sites)
    # equal texts have equal lines, so a text is judged once, by its hash and length
    whole = docs.select(F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    by_text = [F.xxhash64("_text").alias("_hash"), F.length("_text").alias("_length")]
    at = whole.select(*by_text, F.posexplode(_lines(F.col("_text"))).alias("_at", "_one")).where(F.trim("_one") != "").select("_hash", "_length", "_at", F.length("_one").alias("_size"), _key(F.col("_one")).alias("_line"))
    hit = at.join(wide, "_line", "left_semi").groupBy("_hash", "_length").agg(F.collect_set(F.struct("_at", "_size")).alias("_hit"))
    hit = hit.withColumn("_size", F.aggregate("_hit", F.lit(0).cast("long"), lambda n, x: n + x["_size"])).withColumn("_gone", F.sort_array(F.transform("_hit", lambda x: x["_at"]))).drop("_hit")
    hit = written(hit, "line-hits")  # a table of its own, so that the join below may split the copies of one text
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")).select("_row", "_text", *by_text)
    # the hits grow with the input, so they are never broadcast: the plan is the same at every size
    both = own.join(hit.hint("merge"), ["_hash", "_length"], "left")
    both = both.withColumn("_rest", F.when(F.col("_gone").isNotNull(), F.array_join(_without(_lines(F.col("_text")), F.col("_gone")), "\n")))
    goes = F.coalesce(F.col("_rest").rlike(r"\S") if mostly is None else F.col("_size") <= mostly * F.col("_length"), F.lit(False))
    out = [F.when(goes, F.col("_rest")).otherwise(F.col("_text")).alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns]
    if counts:
        out += [
            F.coalesce(F.size(_lines(F.col("_text"))), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_boilerplate"),
            (F.col("_gone").isNotNull() & ~goes).alias("kept_whole"),
        ]
    return both.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = cleaned(docs, counts=True, mostly=MOSTLY)
    return out.select("doc_id", "n_lines", "n_boilerplate", "kept_whole", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, coalesce('=' || source, '') AS site, length(text) AS chars,
         unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), wide AS (
  SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT site) >= {SITES}
), judged AS (
  SELECT l.*, w.line IS NOT NULL AS hit FROM lines l LEFT JOIN wide w ON trim(l.line, ' ') = w.line
), per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_hit,
         coalesce(sum(length(line)) FILTER (hit), 0) > {MOSTLY} * any_value(chars) AS mostly,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS rest
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_hit, 0)::BIGINT AS n_boilerplate,
       coalesce(n_hit > 0 AND mostly, false) AS kept_whole,
       sha256(CASE WHEN n_hit > 0 AND NOT mostly THEN rest ELSE d.text END) AS text_sha256
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id
"""
