"""Arrays of numbers as rows of a table: embedding lookup, pooling, linear layers, losses and mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import bound

#: A token is hot if it is at more than this share of all places; at most 1 / HOT tokens are.
HOT = 1 / 256


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, in doubles and in order; null if their lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def log_sum_exp(logits: Column) -> Column:
    """log of the sum of exp, taken from the largest value, so that nothing overflows; null for an empty array."""
    top = F.array_max(logits).cast("double")
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top)))


def cross_entropy(logits: Column, target: Column, ignored: int = -100) -> Column:
    """The loss of one token: log-sum-exp of its logits less that of its target (from 0).

    Null where the target is null or ``ignored`` (padding). A target outside the logits is an error.
    """
    at = F.when(target != F.lit(ignored), target)
    outside = (at < 0) | (at >= F.size(logits))
    loss = log_sum_exp(logits) - F.get(logits, at.cast("int")).cast("double")
    return F.when(outside, F.raise_error(F.concat(F.lit("no such class: "), at.cast("string")))).when(at.isNotNull(), loss)


def sequence_loss(logits: Column, targets: Column, mask: Column | None = None, ignored: int = -100) -> Column:
    """(total, tokens) of a sequence, from an array of logits for each place and an array of targets.

    Places whose mask is 0, whose target is ``ignored`` or that have no logits don't count.
    """
    places = F.arrays_zip(logits.alias("l"), targets.alias("t")) if mask is None else F.arrays_zip(logits.alias("l"), targets.alias("t"), mask.alias("m"))
    # Fields by place, as their names follow the arguments.
    take = lambda x: x.getField("l"), lambda x: x.getField("t")
    shown = F.transform(places, lambda x: F.struct(take[0](x).alias("l"), F.when(F.lit(True) if mask is None else x.getField("m") != 0, take[1](x)).alias("t")))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("tokens"))

    def add(s: Column, x: Column) -> Column:
        loss = F.when(x.getField("l").isNotNull(), cross_entropy(x.getField("l"), x.getField("t"), ignored))
        return F.struct((s.getField("total") + F.coalesce(loss, F.lit(0.0))).alias("total"), (s.getField("tokens") + loss.isNotNull().cast("bigint")).alias("tokens"))

    return F.aggregate(shown, start, add)


def mean_loss(total: Column, tokens: Column) -> Column:
    """The mean over all tokens that count, whatever sequence they stand in; null if none does."""
    return F.try_divide(F.sum(total), F.sum(tokens))


def lookup(rows: DataFrame, table: DataFrame, key: str, ids: str = "ids", id_: str = "id", vector: str = "vector", hot: float = HOT, salts: int = 64) -> DataFrame:
    """(``key``, vectors): for each row the vectors of its ids, in order; an id that the table lacks gives null.

    Ids stand in the sequences as often as a language has them: a few are at a large share of all places. Those above the share
    ``hot`` (there are at most 1 / hot) get their vector ``salts`` times, and their places are dealt out to those, so that no task
    gathers a hot id. A row without ids gives no vectors; ``key`` has to be unique, and a table's id once.
    """
    places = rows.select(F.col(key).alias("k"), F.posexplode_outer(ids).alias("p", "i"))
    counts = places.where("i IS NOT NULL").groupBy("i").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = [x["i"] for x in counts.where(F.col("n") > total * hot).select("i").collect()]
    copies = lambda c: F.when(c.isin(often), F.lit(salts)).otherwise(F.lit(1)) if often else F.lit(1)
    dealt = places.withColumn("s", F.pmod(F.xxhash64("k", "p"), copies(F.col("i"))).cast("int"))
    held = table.select(F.col(id_).alias("i"), F.col(vector).alias("v")).withColumn("s", F.explode(F.sequence(F.lit(0), copies(F.col("i")) - 1)))
    found = dealt.join(held, ["i", "s"], "left")
    lists = found.groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "v")))).alias("x"))
    return lists.select(F.col("k").alias(key), F.col("x.v").alias("vectors"))


def mean_pool(rows: DataFrame, keys: list[str], vector: str, width: int, weight: Column | None = None) -> DataFrame:
    """(``keys``, n, pooled): the mean vector of each group, component by component, from sums that each task makes first.

    Vectors that are null or of another length than ``width`` don't count; ``weight`` says how often a row does.
    """
    usable = rows.where(F.size(F.coalesce(F.col(vector), F.array())) == width).withColumns({"__pooled": F.col(vector).cast("array<double>"), "__weight": F.lit(1) if weight is None else weight})
    n = F.sum("__weight")
    sums = usable.groupBy(*keys).agg(n.cast("bigint").alias("n"), *(F.sum(F.col("__pooled")[i] * F.col("__weight")).alias(f"__s{i}") for i in range(width)))
    return sums.select(*keys, "n", F.array(*(F.try_divide(F.col(f"__s{i}"), F.col("n").cast("double")) for i in range(width))).alias("pooled"))


def head(vector: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """Logits of a classification head: a product with each row of a small matrix, which the plan holds."""
    bias = bias or [0.0] * len(weights)
    return F.array(*(dot(vector, F.array(*map(F.lit, row))) + F.lit(float(b)) for row, b in zip(weights, bias, strict=True)))


def blocked(rows: DataFrame, key: str, vector: str, width: int, block: int) -> DataFrame:
    """(``key``, block, part): each vector in blocks of ``block`` components; a shorter vector is as if filled up with 0."""
    n = -(-width // block)
    return rows.select(F.col(key).alias(key), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.col(vector).alias("__v")).select(
        key, "block", F.slice("__v", F.col("block") * block + 1, F.lit(block)).cast("array<double>").alias("part")
    )


def product(rows: DataFrame, weights: DataFrame, key: str, vector: str, out: str, row: str = "row", values: str = "values", width: int = 64, block: int = 32, group: int = 32) -> DataFrame:
    """(``key``, ``out``): the product of each vector with a matrix, given by its rows (``row`` from 0, ``values``).

    Both sides are cut in blocks along the shared dimension, the matrix also in groups of its rows. A block of a vector meets the groups
    of the same block, which gives partial results for ``group`` rows at once; they are added up, so no task holds the matrix or
    a whole vector. Rows of the matrix that are missing give 0.
    """
    size = weights.agg(F.max(row)).first()[0]
    if size is None:
        return rows.select(key, F.array().cast("array<double>").alias(out))
    groups = -(-(size + 1) // group)
    zero = F.array_repeat(F.lit(0.0), F.lit(block))
    tiles = blocked(weights.select(F.col(row).alias("__r"), F.col(values).alias("__w")), "__r", "__w", width, block).groupBy("block", F.floor(F.col("__r") / group).alias("group"))
    tiles = tiles.agg(F.array_sort(F.collect_list(F.struct((F.col("__r") % group).alias("r"), "part"))).alias("t"))
    # A row's place among its group's; missing ones are empty.
    full = F.transform(F.sequence(F.lit(0), F.lit(group - 1)), lambda i: F.coalesce(F.get(F.filter("t", lambda x: x.getField("r") == i), F.lit(0)).getField("part"), zero))
    tiles = tiles.select("block", "group", full.alias("tile"))
    parts = blocked(rows, key, vector, width, block).join(tiles, "block").select(key, "group", F.transform("tile", lambda w: _partial(F.col("part"), w)).alias("p"))
    sums = parts.groupBy(key, "group").agg(*(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(group)))
    lists = sums.groupBy(key).agg(F.collect_list(F.struct("group", F.array(*(F.col(f"s{i}") for i in range(group))).alias("s"))).alias("g"))
    # A group without a row of the matrix has no tile.
    none = F.array_repeat(F.lit(0.0), F.lit(group))
    every = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: F.coalesce(F.get(F.filter("g", lambda x: x.getField("group") == i), F.lit(0)).getField("s"), none))
    return lists.select(key, F.slice(F.flatten(every), 1, size + 1).alias(out))


def _partial(a: Column, b: Column) -> Column:
    """The inner product up to where the shorter array ends."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def low_rank(rows: DataFrame, down: DataFrame, up: DataFrame, key: str, vector: str, out: str, scale: list[float], width: int, bias: list[float] | None = None, **sizes) -> DataFrame:
    """(``key``, ``out``): the vector through ``down`` (a matrix of as many rows as the rank), times ``scale``, through ``up``, plus ``bias``."""
    inner = product(rows, down, key, vector, "__inner", width=width, **sizes)
    scaled = inner.select(key, F.zip_with("__inner", F.array(*map(F.lit, scale)), lambda x, z: x * z).alias("__inner"))
    made = product(scaled, up, key, "__inner", out, width=len(scale), **sizes)
    return made if bias is None else made.select(key, F.zip_with(out, F.array(*map(F.lit, bias)), lambda x, b: x + b).alias(out))


def mixed(vector: Column, detectors: list[list[float]], experts: list[list[float]], tasks: list[str]) -> Column:
    """The task that a vector looks like and the experts' vectors mixed by its probabilities: a struct of task, share and mixed.

    Logits are products with each detector, probabilities their softmax; the task is that of the largest logit (the first, in a tie).
    All three tables have a row a task, some dozen, and stand in the plan. Vector, logits and probabilities are computed once a
    row, however often they are used.
    """
    if not len(detectors) == len(experts) == len(tasks) > 0:
        raise ValueError("there has to be a detector and an expert for each task")
    columns = F.array(*(F.array(*(F.lit(float(e[i])) for e in experts)) for i in range(len(experts[0]))))
    names = F.array(*map(F.lit, tasks))

    def told(logits: Column, shares: Column) -> Column:
        best = (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
        return F.struct(F.get(names, best).alias("task"), F.array_max(shares).alias("share"), F.transform(columns, lambda c: dot(shares, c)).alias("mixed"))

    softmax = lambda logits, scale: F.transform(logits, lambda x: F.exp(x - scale))
    by_logits = lambda logits: bound(log_sum_exp(logits), lambda scale: bound(softmax(logits, scale), lambda shares: told(logits, shares)))
    return bound(vector, lambda v: bound(head(v, detectors), by_logits))


def mixture(vector: Column, detectors: list[list[float]], experts: list[list[float]], tasks: list[str]) -> dict[str, Column]:
    """The fields of ``mixed``, each a column. Where more than one is taken, ``mixed`` itself costs less."""
    made = mixed(vector, detectors, experts, tasks)
    return {x: made.getField(x) for x in ("task", "share", "mixed")}
