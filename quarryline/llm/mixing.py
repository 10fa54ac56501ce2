"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

DataFrame and SQL functions only.  The steps:

1. ``sized``: words of every text, a key for every row, a random but repeatable
   order inside each source (xxhash64 of seed and key).
2. ``targets``: the share of each source by weight, no source above ``most``
   times its size, the excess going to the others by weight (closed form over
   the sources sorted by cap / weight).
3. Each source is a line of words in its random order; a draw takes it whole as
   often as the target needs and then a part, so a source's taken words equal
   its rounded target and no document is taken above ``most`` times.  The line
   is cut into blocks of about ``block_words``; the block quotas are exact.
4. ``tree``: the quotas of all sources go down a binary tree of output shards;
   at a node the left child's counts are a multivariate hypergeometric draw
   (source after source, conditioned on what is left), so the shards' counts
   add up to the quotas exactly whatever is drawn.
5. Every shard takes the next blocks of a keyed permutation of the source's
   blocks (swap-or-not rounds: each block is placed by arithmetic on its own
   number, whatever their count; disjoint as it is a permutation) and is shuffled
   locally by a hash order.

Prefix sums inside a source go over three levels of buckets, each of a few
thousand rows, so a source with a third of all rows is no large task.  The plan
is made of sizes and keys; ``mix`` moves each text once, to its plan.

Defined cases: null source is a source of its own (last); null or empty texts
have size 0, are in no block and are never taken; equal rows are told apart by
a number and drawn each; no rows give no targets and no draws; extra columns
are not read by the plan and are passed on by ``mix``, but for columns named as
those that it adds (mix_shard, mix_position, mix_copy, mix_words), which these
replace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Recipe:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    #: Words of the mix as a share of all words, and the most that a source or document repeats.
    share: float = 1.5
    most: float = 2.0
    block_words: int = 4096
    shard_words: int = 2_000_000
    seed: int = 17


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0)."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(plain, " ", -1), "")).cast("long"), F.lit(0).cast("long"))


def row_keys(id_col: str, source_col: str, text_col: str) -> dict[str, Column]:
    """Two hashes of a row: one to find it by, one to order rows that share the first."""
    parts = [F.col(c) for c in (id_col, source_col, text_col)]
    return {"row_key": F.xxhash64(*parts), "row_tie": F.xxhash64(F.lit(7), *parts)}


def _nth() -> Column:
    """Tells rows of one key apart; what rows of both hashes equal are drawn is the same whichever comes first."""
    return F.row_number().over(Window.partitionBy("row_key").orderBy("row_tie"))


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, row_key, nth; written once, as it is used many times."""
    keys = row_keys(id_col, source_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), *(c.alias(k) for k, c in keys.items()))
    return common.cut(rows.withColumn("nth", _nth()).drop("row_tie"))


def targets(sizes: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """source, rank, docs, source_size, target.  Windows here are over one row for each source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = by.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, recipe.weights)), (F.col("rank") % len(recipe.weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(1))
    w = ranked.withColumns({"weight": weight, "cap": F.lit(recipe.most) * F.col("source_size"), "total": recipe.share * F.sum("source_size").over(everything)})
    level = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "rank")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    w = w.withColumn("full", F.col("cap") / F.col("weight") <= left / rest)
    spare = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.try_divide(spare * F.col("weight"), open_weight))
    return w.withColumn("target", target).select("source", F.col("rank").cast("long").alias("rank"), "docs", "source_size", "target")


def _placed(sizes: DataFrame, goals: DataFrame, recipe: Recipe) -> DataFrame:
    """Each non-empty row with the number of words before it in its source's random line."""
    goal = goals.select("source", "rank", "docs", "source_size", F.round("target").cast("long").alias("quota"))
    rows = sizes.filter("size > 0").withColumn("order", F.xxhash64(F.lit(recipe.seed), "row_key", "nth"))
    # Sources are few against rows: Spark broadcasts the goals below its threshold, and splits a hot source's rows otherwise.
    rows = rows.join(goal, rows["source"].eqNullSafe(goal["source"]), "inner").drop(goal["source"])
    rows = rows.withColumn("low", F.pmod(F.shiftrightunsigned("order", 8), F.greatest(F.lit(1), F.col("docs") / 256).cast("long")))
    rows = rows.withColumn("high", F.pmod("low", F.greatest(F.lit(1), F.col("docs") / (256 * 2048)).cast("long")))
    sums = rows.groupBy("rank", "high", "low").agg(F.sum("size").alias("words"))
    tops = sums.groupBy("rank", "high").agg(F.sum("words").alias("words"))
    prior = (Window.unboundedPreceding, -1)

    def running(keys: tuple[str, ...], order: list[str], value: str) -> Column:
        return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*prior)), F.lit(0).cast("long"))

    tops = tops.select("rank", "high", running(("rank",), ["high"], "words").alias("high_at"))
    sums = sums.join(tops, ["rank", "high"]).select("rank", "high", "low", (F.col("high_at") + running(("rank", "high"), ["low"], "words")).alias("low_at"))
    rows = rows.join(sums, ["rank", "high", "low"])
    return rows.withColumn("at", F.col("low_at") + running(("rank", "high", "low"), ["order", "row_key", "nth"], "size"))


def _log_factorial(x: str) -> str:
    return f"(CASE WHEN {x} < 2 THEN 0.0D ELSE ({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1.0D / (12 * {x}) - 1.0D / (360.0D * {x} * {x} * {x}) END)"


def _choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"


def hypergeometric(good: str, total: str, draws: str, u: str) -> str:
    """SQL for a draw: successes among ``draws`` of ``total`` items with ``good`` good ones, by inverting the distribution within 10 deviations of the mean; always between the exact bounds."""
    mean = f"(({draws}) * (({good}) / greatest(1.0D, {total})))"
    wide = f"(10 * sqrt(1 + {mean} * (1 - ({good}) / greatest(1.0D, {total}))) + 10)"
    lo, hi = f"greatest(0L, {draws} - ({total} - {good}))", f"least({good}, {draws})"
    a, b = f"greatest({lo}, CAST(floor({mean} - {wide}) AS BIGINT))", f"least({hi}, CAST(ceil({mean} + {wide}) AS BIGINT))"
    odds = f"transform(sequence({a}, {b}), x -> named_struct('x', x, 'p', exp({_choose(good, 'x')} + {_choose(f'({total} - {good})', f'({draws} - x)')} - {_choose(total, draws)})))"
    pick = f"aggregate({odds}, named_struct('sum', 0.0D, 'x', {a}), (s, o) -> IF(s.sum >= {u}, s, named_struct('sum', s.sum + o.p, 'x', o.x)), s -> s.x)"
    return f"CASE WHEN {lo} >= {hi} THEN {lo} ELSE {pick} END"


def permuted(x: str, n: str, key: str, rounds: int = 96) -> str:
    """SQL for the place of ``x`` in a permutation of 0 to n - 1 drawn by ``key`` (columns or literals): swap-or-not rounds, each of which mirrors x at a keyed point or leaves it, by a bit that is the same for both places."""
    point = f"pmod(xxhash64({key}, i), {n})"
    return f"""aggregate(sequence(1, {rounds}), {x}, (x, i) -> IF(
        xxhash64({key}, -i, greatest(x, pmod({point} - x, {n}))) & 1L = 1L, pmod({point} - x, {n}), x))"""


def tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, blocks) of the root to (shard, rank, blocks) of 2^n >= ``shards`` leaves."""
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "rank", "blocks")
    depth = max(0, (shards - 1).bit_length())
    total, draws, good = "s.total", "s.draws", "q.blocks"
    step = f"""aggregate(quotas, named_struct('total', total, 'draws', half, 'got', CAST(array() AS ARRAY<STRUCT<rank: BIGINT, blocks: BIGINT, lhs: BIGINT>>)),
        (s, q) -> transform(array(CAST({hypergeometric(good, total, draws, f"((shiftrightunsigned(xxhash64({seed}L, level, node, q.rank), 11) + 0.5D) / 9007199254740992.0D)")} AS BIGINT)),
            d -> named_struct('total', s.total - q.blocks, 'draws', s.draws - d, 'got', concat(s.got, array(named_struct('rank', q.rank, 'blocks', q.blocks, 'lhs', d)))))[0],
        s -> s.got)"""
    for level in range(depth):
        grouped = nodes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "blocks"))).alias("quotas"), F.sum("blocks").alias("total"))
        drawn = grouped.withColumns({"level": F.lit(level), "half": F.expr("CAST(total DIV 2 AS BIGINT)")}).select("node", F.explode(F.expr(step)).alias("d"))
        nodes = drawn.select(F.explode(F.expr("array(named_struct('node', node * 2, 'rank', d.rank, 'blocks', d.lhs), named_struct('node', node * 2 + 1, 'rank', d.rank, 'blocks', d.blocks - d.lhs))")).alias("n")).select("n.*").filter("blocks > 0")
    return nodes.withColumnRenamed("node", "shard")


def draws(sizes: DataFrame, goals: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """The mix: shard, position, doc_id, row_key, nth, source, copy, words (the first so many of the document), block."""
    rows = _placed(sizes, goals, recipe)
    # Copies: whole passes over the line and then a part of it.
    full = F.expr("CAST(quota DIV greatest(1L, source_size) AS BIGINT)")
    copies = rows.withColumn("full", full).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    part = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("quota") - F.col("full") * F.col("source_size") - F.col("at")))
    copies = copies.withColumn("words", F.when(F.col("copy") < F.col("full"), F.col("size")).otherwise(part)).filter("words > 0")
    per_pass = F.expr(f"CAST((source_size - 1) DIV {recipe.block_words} + 1 AS BIGINT)")
    copies = copies.withColumn("block", F.col("copy") * per_pass + F.expr(f"CAST(at DIV {recipe.block_words} AS BIGINT)"))
    quotas = goals.filter("source_size > 0").select("rank", F.round("target").cast("long").alias("quota"), "source_size").withColumn("full", full)
    last = F.expr(f"CAST(ceil((quota - full * source_size) / {recipe.block_words}.0D) AS BIGINT)")
    quotas = common.cut(quotas.select("rank", (F.col("full") * per_pass + last).alias("blocks")).filter("blocks > 0"))
    blocks = quotas.agg(F.sum("blocks")).first()[0] or 0
    shards = max(1, -(-blocks * recipe.block_words // recipe.shard_words))
    leaves = common.cut(tree(quotas, shards, recipe.seed))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = leaves.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0).cast("long")))
    ordinals = spans.select("rank", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("ordinal"))
    placed = ordinals.join(quotas, "rank").select("rank", "shard", F.expr(permuted("ordinal", "blocks", f"{recipe.seed}L, rank")).alias("block"))
    mixed = copies.join(placed, ["rank", "block"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(recipe.seed), "copy", "order"), "row_key", "nth", "copy")
    return mixed.select("shard", F.row_number().over(local).alias("position"), "doc_id", "row_key", "nth", "source", "copy", "words", "block")


def mix(docs: DataFrame, recipe: Recipe = Recipe(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed rows themselves: all columns of ``docs``, the text cut to the words that the mix takes, and mix_shard, mix_position, mix_copy, mix_words."""
    sizes = sized(docs, id_col, source_col, text_col)
    plan = draws(sizes, targets(sizes, recipe), recipe)
    entry = F.struct("nth", F.col("shard").alias("mix_shard"), F.col("position").alias("mix_position"), F.col("copy").alias("mix_copy"), F.col("words").alias("mix_words"))
    # A document is drawn a few times at most (and rows of one key are few), so its entries are one short list.
    plan = common.cut(plan.groupBy("row_key").agg(F.collect_list(entry).alias("entries")))
    added = ("mix_shard", "mix_position", "mix_copy", "mix_words")
    columns = [c for c in docs.columns if c not in added]
    rows = docs.select(*(c.alias(k) for k, c in row_keys(id_col, source_col, text_col).items()), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")).join(plan, "row_key")
    # The join has dealt the rows by key, so numbering them moves nothing.
    taken = rows.withColumn("n", _nth()).select("row", F.explode(F.filter("entries", lambda e: e["nth"] == F.col("n"))).alias("e"))
    text, size = F.col(f"row.`{text_col}`"), word_count(F.col(f"row.`{text_col}`").cast("string"))
    pieces = F.split(text.cast("string"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)  # a word and the white space after it
    leading = text.cast("string").rlike(r"^[\x20\x09-\x0D]").cast("int")
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("e.mix_words").cast("int") + leading), "")
    cut = F.when(F.col("e.mix_words") < size, head).otherwise(text.cast("string"))
    return taken.select(*((cut if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in columns), *(F.col(f"e.{c}") for c in added))
