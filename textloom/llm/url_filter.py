"""URL filter: rules first, then the ratio of two smoothed variable-order Markov models over characters."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut

#: (verdict, host, path): a rule fits its host and all subdomains where the path begins with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Characters of context at most; size of the alphabet that the lowest order backs off to.
ORDER, ALPHABET = 4, 256
#: First digits of the MD5 sum of the ruled URLs that calibrate and teach nothing.
LEFT_OUT = ("0", "1", "2", "3")
#: What makes up this share of all rows at least is hot: at most 1/HOT keys, which may be sent to all tasks. Rows of a hot
#: URL are dealt out to SALTS tasks.
HOT, SALTS = 1e-3, 64


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    got = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(got(1), string.ascii_uppercase, string.ascii_lowercase), got(2)


def rule_for(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict; of rules alike in length the first one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == at) | F.col(host).endswith(f".{at}")) & F.col(path).startswith(under)
        rule, verdict = F.when(fits, F.lit(at + under)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _grams(texts: DataFrame, order: int, *kept: str) -> DataFrame:
    """``kept`` columns and each character of ``text`` with the ``order`` before it, ``^`` before the first; ``$`` ends the text.

    Characters are split once and taken by their place, so the time follows the length.
    """
    padded = F.concat(F.lit("^" * order), F.col("text"), F.lit("$"))
    from_ = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - order - 1), lambda i: F.concat(*(F.get(c, i + k) for k in range(order + 1))))
    # The split stands in a lambda's variable: it isn't made again for each character.
    return texts.select(*kept, F.explode(F.flatten(F.transform(F.array(F.split(padded, "")), from_))).alias("gram"))


def ratios(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """For each distinct gram of ``texts`` (text, accepted, rejected: counts) the log-ratio of its last character.

    Both models interpolate orders 0 to ``order`` by Witten-Bell: a context seen n times with t distinct followers
    gives (count + t * lower order) / (n + t); a context that a class lacks gives the lower order alone.
    """
    grams = cut(_grams(texts, order, "accepted", "rejected").groupBy("gram").agg(F.sum("accepted").cast("double").alias("a"), F.sum("rejected").cast("double").alias("r")))
    lower = None
    for k in range(order + 1):
        seen = grams.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("s")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        seen = seen.withColumn("ctx", F.substring("s", 1, k) if k else F.lit(""))
        contexts = seen.groupBy("ctx").agg(*(f(x) for x in "ar" for f in (lambda x: F.sum(x).alias(f"n{x}"), lambda x: F.sum((F.col(x) > 0).cast("double")).alias(f"t{x}"))))
        level = seen.join(contexts, "ctx")
        if lower is None:
            level = level.withColumns({"pa": F.lit(1.0 / ALPHABET), "pr": F.lit(1.0 / ALPHABET)})
        else:
            level = level.withColumn("l", F.substring("s", 2, k)).join(lower.select(F.col("s").alias("l"), "pa", "pr"), "l")
        smooth = lambda x: F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"p{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))).otherwise(F.col(f"p{x}"))
        lower = level.select("s", smooth("a").alias("pa"), smooth("r").alias("pr"))
    return lower.select(F.col("s").alias("gram"), (F.log("pa") - F.log("pr")).alias("ratio"))


def mean_ratios(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``texts`` (text, accepted, rejected, taught: whether it teaches the models) with the mean log-ratio of its characters.

    Grams that many texts share are looked up in a bounded table that all tasks have, so none gathers in one task. With
    each gram goes a key of its text (two hashes of 64 bits), not the text, and each text has a gram once, with its count.
    """
    texts = texts.withColumns({"k": F.xxhash64("text"), "l": F.xxhash64(F.lit(1), "text")})
    taught = lambda x: F.when(F.col("taught"), F.col(x)).otherwise(0).alias(x)
    table = cut(ratios(texts.select("text", taught("accepted"), taught("rejected")), order))
    grams = _grams(texts, order, "k", "l").groupBy("k", "l", "gram").agg(F.count("*").alias("n"))
    counted = cut(grams.groupBy("gram").agg(F.sum("n").alias("count")))
    every = counted.agg(F.sum("count").alias("n")).first()["n"] or 0
    hot = table.join(counted.where(F.col("count") >= HOT * every).select("gram"), "gram", "left_semi")
    known = grams.join(F.broadcast(hot), "gram", "left")
    summed = lambda x: x.groupBy("k", "l").agg(F.sum(F.col("ratio") * F.col("n")).alias("ratio"), F.sum("n").alias("n"))
    both = summed(known.where("ratio IS NOT NULL")).unionByName(summed(known.where("ratio IS NULL").drop("ratio").join(table, "gram")))
    means = both.groupBy("k", "l").agg((F.sum("ratio") / F.sum("n")).alias("score"))
    return texts.join(means, ["k", "l"]).drop("k", "l")


def calibration(scored: DataFrame) -> tuple[float, float] | None:
    """Intercept and slope of the log-odds of acceptance for a mean ratio: None without texts of both kinds.

    Mean ratios of either kind are taken as normal with one variance, of the ruled texts that taught nothing (of all
    ruled ones if those are of one kind), each counted as often as it occurs; the kinds' shares are their prior.
    """
    sums = lambda rule: [F.sum(F.when(rule, F.col(w) * x)) for w in ("accepted", "rejected") for x in (F.lit(1.0), F.col("score"), F.col("score") * F.col("score"))]
    for rule in (~F.col("taught"), F.lit(True)):
        na, sa, qa, nr, sr, qr = (float(x or 0) for x in scored.agg(*(x.alias(str(i)) for i, x in enumerate(sums(rule)))).first())
        if na and nr:
            ma, mr = sa / na, sr / nr
            slope = (ma - mr) / max((qa + qr - na * ma * ma - nr * mr * mr) / (na + nr), 1e-9)
            return math.log(na / nr) - slope * (ma + mr) / 2, slope
    return None


def judge(pages: DataFrame, url: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (the length-normalised log-likelihood difference).

    The models read whole URLs. Those that a rule decides teach them, but for a quarter, by which the score is calibrated;
    a URL without a rule is allowed where its log-odds of acceptance are 0 or more. Without URLs of both kinds every
    other URL is allowed. A null URL is judged as the empty text; a null URL, or one without ``://``, has an empty host
    and path. Repeated rows are judged alike; an empty table gives no rows; a column of ``pages`` that has the name of a
    result gives way to it, all others are handed on.
    """
    new = ("host", "path", "rule", "verdict", "score")
    kept = [x for x in pages.columns if x.lower() not in new]
    rows = pages.select(*(F.col(f"`{x}`").alias(f"key{i}") for i, x in enumerate(kept)), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("text"))
    ruled = rows.withColumns(dict(zip(("host", "path"), host_and_path("text"), strict=True)))
    ruled = ruled.withColumns(dict(zip(("rule", "ruled"), rule_for("host", "path", rules), strict=True)))
    texts = ruled.groupBy("text").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("accepted"), F.count_if(F.col("ruled") == "block").alias("rejected"))
    texts = cut(texts.withColumn("taught", ~F.substring(F.md5("text"), 1, 1).isin(*LEFT_OUT)))
    scored = cut(mean_ratios(texts, order))
    line = calibration(scored)
    said = F.coalesce(F.col("ruled"), F.lit("allow") if line is None else F.when(F.lit(line[0]) + F.lit(line[1]) * F.col("score") >= 0, "allow").otherwise("block"))
    # Rows of a hot URL are dealt out, and its score is sent to each of those tasks.
    every = scored.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.broadcast(scored.where(F.col("n") >= HOT * every).select("text", F.lit(True).alias("hot")))
    dealt = ruled.join(hot, "text", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    spread = scored.select("text", "score", F.explode(F.when(F.col("n") >= HOT * every, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return dealt.join(spread, ["text", "salt"]).select(*(F.col(f"key{i}").alias(x) for i, x in enumerate(kept)), "host", "path", "rule", said.alias("verdict"), "score")


def _oracle(rules=RULES, order: int = ORDER) -> str:
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{k(r)}'" for r in longest) + " END"
    parts = [
        f"""p AS (SELECT page_id, coalesce(url, '') AS text, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages)""",
        f"q AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS ruled FROM p)",
        f"""x AS (SELECT text, md5(text)[1] NOT IN ({", ".join(f"'{d}'" for d in LEFT_OUT)}) AS taught, count(*) FILTER (WHERE ruled = 'allow') AS a, count(*) FILTER (WHERE ruled = 'block') AS r FROM q GROUP BY text)""",
        f"g AS (SELECT *, substring('{'^' * order}' || text || '$', CAST(unnest(range(1, length(text) + 2)) AS BIGINT), {order + 1}) AS gram FROM x)",
        "d AS (SELECT gram, CAST(coalesce(sum(a) FILTER (WHERE taught), 0) AS DOUBLE) AS a, CAST(coalesce(sum(r) FILTER (WHERE taught), 0) AS DOUBLE) AS r FROM g GROUP BY gram)",
    ]
    for k in range(order + 1):
        parts.append(f"s{k} AS (SELECT substring(gram, {order + 1 - k}, {k + 1}) AS s, substring(gram, {order + 1 - k}, {k}) AS ctx, sum(a) AS a, sum(r) AS r FROM d GROUP BY ALL)")
        parts.append(f"c{k} AS (SELECT ctx, sum(a) AS na, sum(r) AS nr, CAST(count(*) FILTER (WHERE a > 0) AS DOUBLE) AS ta, CAST(count(*) FILTER (WHERE r > 0) AS DOUBLE) AS tr FROM s{k} GROUP BY ctx)")
        low = (lambda x: f"l.p{x}") if k else (lambda x: f"CAST(1.0 AS DOUBLE) / {ALPHABET}")
        prob = lambda x: f"CASE WHEN n{x} > 0 THEN (s.{x} + t{x} * {low(x)}) / (n{x} + t{x}) ELSE {low(x)} END AS p{x}"
        parts.append(f"m{k} AS (SELECT s.s, {prob('a')}, {prob('r')} FROM s{k} s JOIN c{k} USING (ctx)" + (f" JOIN m{k - 1} l ON substring(s.s, 2, {k}) = l.s" if k else "") + ")")
    parts += [
        f"t AS (SELECT text, taught, CAST(a AS DOUBLE) AS a, CAST(r AS DOUBLE) AS r, avg(ln(pa) - ln(pr)) AS score FROM g JOIN m{order} ON gram = s GROUP BY text, taught, a, r)",
        "f AS (SELECT taught, a, r, score FROM t WHERE NOT taught UNION ALL SELECT NULL, a, r, score FROM t)",
        "u AS (SELECT taught, sum(a) AS na, sum(r) AS nr, sum(a * score) / nullif(sum(a), 0) AS ma, sum(r * score) / nullif(sum(r), 0) AS mr, sum((a + r) * score * score) AS q FROM f GROUP BY taught)",
        "v AS (SELECT *, (ma - mr) / greatest((q - na * ma * ma - nr * mr * mr) / (na + nr), 1e-9) AS slope FROM u WHERE na > 0 AND nr > 0 ORDER BY taught NULLS LAST LIMIT 1)",
        "e AS (SELECT ln(na / nr) - slope * (ma + mr) / 2 AS base, slope FROM v)",
    ]
    verdict = "coalesce(ruled, CASE WHEN base IS NULL OR base + slope * score >= 0 THEN 'allow' ELSE 'block' END)"
    return "WITH " + ",\n".join(parts) + f"\nSELECT page_id, host, path, rule, {verdict} AS verdict FROM q JOIN t USING (text) LEFT JOIN e ON true"


ORACLE = _oracle()
