"""Cross-site boilerplate lines: distinct-site spread by HyperLogLog sketches, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, fresh

#: A line on this many distinct sites is boilerplate.
MIN_SITES = 6
#: lg of the sketch's buckets; its relative standard error is 1.04 / sqrt(2**LG).
LG = 12
#: A line's rows are dealt out to this many tasks when they meet the boilerplate: one line may hold a third of all.
SALTS = 32


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """One row for each line that isn't blank: the document's key, the line's place and its two hashes."""
    one = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return one.where(F.trim("line") != "").select("d", "t", "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def _meet(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """``lines`` joined with the (distinct) hashes of ``keys``; a line's rows are dealt out by their place as well."""
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.hash("d", "pos"), F.lit(SALTS))).join(salted, ["h", "g", "salt"])


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg: int = LG) -> DataFrame:
    """Hashes (h, g) of lines on ``min_sites`` sites or more, and the smallest id of a document that has the line."""
    lines = _lines(docs, site)
    margin = max(1.0, 4 * 1.04 / 2 ** (lg / 2) * min_sites)
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", lg).alias("sites"), F.count("*").alias("n"), F.min("d").alias("keeper"))
    # A line that stands fewer times than min_sites can't be on so many sites: no sketch is read for it.
    near = cut(spread.where(F.col("n") >= min_sites).withColumn("estimate", F.hll_sketch_estimate("sites")).where(F.col("estimate") >= min_sites - margin).drop("sites", "n"))
    open_ = near.where(F.col("estimate") <= min_sites + margin)
    exact = _meet(lines, open_.select("h", "g")).groupBy("h", "g").agg(F.count_distinct("site").alias("exact"))
    sure = near.where(F.col("estimate") > min_sites + margin).select("h", "g", "keeper")
    return sure.unionByName(open_.join(exact.where(F.col("exact") >= min_sites), ["h", "g"]).select("h", "g", "keeper"))


def _without(text: str, removed: str) -> Column:
    """The text without the lines at the places ``removed``: a mask in line order, zipped with the lines."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    mask = F.array_sort(F.concat(F.transform(removed, lambda p: F.struct(p.alias("p"), F.lit(False).alias("k"))), F.transform(kept, lambda p: F.struct(p.alias("p"), F.lit(True).alias("k")))))
    return F.array_join(F.filter(F.zip_with(lines, mask, lambda line, m: F.when(m["k"], line)), lambda line: line.isNotNull()), "\n")


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg: int = LG) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines and n_removed.

    The document with the smallest id that has a line keeps it, so no text is lost from the corpus. A null site counts
    as one site of its own; blank lines stay; a null text stays null with no lines; an empty text has one blank line.
    Rows with a null id keep nothing against rows with an id. Repeated rows are treated alike; an empty table gives no
    rows. Every other column is handed on as it is; one that is called n_lines or n_removed gives way to the result.
    """
    d, t, removed_ = fresh(docs, "d", "t", "removed")
    lines = _lines(docs, site)
    hit = _meet(lines, boilerplate(docs, site, min_sites, lg)).where(F.col("keeper").isNotNull() & ~F.col("d").eqNullSafe(F.col("keeper")))
    # Repeated rows give the same places; the key is null-safe and holds the text's hash.
    removed = hit.groupBy(F.coalesce(F.col("d").cast("string"), F.lit("null")).alias(d), F.col("t").alias(t)).agg(F.collect_set("pos").alias(removed_))
    keyed = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), t: F.xxhash64("text")})
    joined = keyed.join(removed, [d, t], "left")
    columns = [F.when(F.col(removed_).isNull(), F.col("text")).otherwise(_without("text", removed_)).alias("text") if x == "text" else F.col(f"`{x}`") for x in docs.columns if x.lower() not in ("n_lines", "n_removed")]
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return joined.select(*columns, count.cast("bigint").alias("n_lines"), F.coalesce(F.size(removed_), F.lit(0)).cast("bigint").alias("n_removed"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), b AS (
  SELECT line, min(doc_id) AS keeper FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), k AS (
  SELECT l.doc_id, count(b.line) FILTER (WHERE l.doc_id <> b.keeper) AS n_removed,
    string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.line IS NULL OR l.doc_id = b.keeper) AS kept
  FROM l LEFT JOIN b ON l.line = b.line GROUP BY l.doc_id
)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text,
  CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
