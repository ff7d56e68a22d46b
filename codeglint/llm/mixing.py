"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets an exponential key -ln(u) / w, with u from a hash of its id and w its quality weight; within a source the
documents of smallest key come first.  A source's target is met by complete epochs, then by a fractional selection: the prefix
in key order whose words come nearest to what is left.  Prefix sums run over blocks of key bins, then over the bins (about
BIN_ROWS rows each) of the block that holds the cut, and only the bin with the cut is sorted, so a source with a third of all
rows is never gathered in one task.  Rows alike in key, id and size count as one there; where the cut falls among them, it is found
in the same way by bins of a hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored
from .quality import ANY_SYMBOL, solid_characters

WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
SEED = "mix"
#: Rows that a key bin holds on average, and bins of a block: prefix sums run over a source's blocks, then over one block's bins.
BIN_ROWS, BLOCK_BINS = 1000, 1000
#: Up to so many sources, their table (under 100 bytes a row) is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.5 to 2: 2 for text without symbols, falling with their share of the characters that aren't space; 0.5 from a tenth on."""
    t = F.coalesce(text, F.lit(""))
    solid, symbols = solid_characters(t), F.regexp_count(t, F.lit(ANY_SYMBOL))
    share = F.when(solid > 0, symbols / solid).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.5), 2.0 - 15.0 * share)


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 from the md5 of seed and id: reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**48)


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_rows) with target: shares of the sum of sizes by weight, none above max_epochs of its size.

    Sources in code point order, null last, get the weights in turn.  The level at which the excess is reshared until none is
    above its cap comes from one pass over the sources by cap per weight.  One row a source is what the windows gather.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = sources.withColumn("weight", w).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    t = t.withColumn("level", (total - before) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    # levels fall in this order until the first that fits, which is the least of those that fit
    t = t.withColumn("pos", F.row_number().over(by)).withColumn("fit", fits)
    final = F.min_by("fit", F.when(F.col("fit").isNotNull(), F.col("pos"))).over(Window.partitionBy())
    return t.withColumn("target", F.least(F.col("cap"), F.coalesce(final, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "n_rows", "target")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> dict[str, Column]:
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    columns = {"_id": key, "_source": F.col(f"`{source_col}`"), "_size": word_count(text), "_key": -F.log(uniform(key, seed)) / quality_weight(text)}
    # which of the rows alike in key, id and size comes first; rows alike in text too are told apart by their number
    return columns | {"_text_hash": F.xxhash64(text), "_number": F.monotonically_increasing_id()}


def _bin() -> Column:
    # 1 - exp(-key) lies in (0, 1) and grows with the key
    return F.floor((1.0 - F.exp(-F.col("_key"))) * F.col("n_bins")).cast("long")


def _last_below(sums: DataFrame, place: str, base: Column) -> DataFrame:
    """Of rows (_source, place, sum, left), each source's last whose words before it are fewer than left; before counts from base."""
    earlier = Window.partitionBy("_source").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    below = sums.withColumn("before", base + F.coalesce(F.sum("sum").over(earlier), F.lit(0))).filter(F.col("before") < F.col("left"))
    return below.groupBy("_source").agg(F.max(place).alias(place), F.max_by("before", place).alias("before"))


def _place() -> Column:
    """A row's place in its source's order but for rows alike in key, id and size."""
    return F.struct(F.col("_key"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_size"))


def _tie() -> Column:
    """The place among rows alike in key, id and size: a number from 0 to 1, then the row's own."""
    bits = F.xxhash64(F.col("_text_hash"), F.col("_number")).bitwiseAND(F.lit(2**52 - 1))
    return F.struct((bits / F.lit(float(2**52))).alias("u"), F.col("_text_hash"), F.col("_number"))


def _cuts(binned: DataFrame, amount: Column, small: bool, name: str) -> DataFrame:
    """source, cut and cut_before: the bin of each source's rows (_source, _bin, left) in which left is used up, and what the bins
    before it have of the amount.  Sums run over blocks of bins, then over the bins of the block with the cut."""
    binned = binned.withColumn("_block", F.floor(F.col("_bin") / BLOCK_BINS).cast("long"))
    # the picks end in the last block, and there in the last bin, that begins below what is left
    blocks = _last_below(binned.groupBy("_source", "_block").agg(F.sum(amount).alias("sum"), F.first("left").alias("left")), "_block", F.lit(0))
    blocks = stored(blocks.select(F.col("_source").alias("source"), F.col("_block").alias("in_block"), F.col("before").alias("block_before")), f"{name}-blocks")
    inside = with_source(binned, blocks, small).filter(F.col("_block") == F.col("in_block"))
    bins = inside.groupBy("_source", "_bin").agg(F.sum(amount).alias("sum"), F.first("left").alias("left"), F.first("block_before").alias("block_before"))
    cuts = _last_below(bins, "_bin", F.col("block_before"))
    return stored(cuts.select(F.col("_source").alias("source"), F.col("_bin").alias("cut"), F.col("before").alias("cut_before")), f"{name}-cuts")


def with_source(df: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """df with the columns of its source's row; a table of few sources is broadcast."""
    side = sources.withColumnRenamed("source", "_of")
    return df.join(F.broadcast(side) if small else side, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")


def source_plan(rows: DataFrame, weights: Sequence[float], max_epochs: int) -> tuple[DataFrame, bool]:
    """Per source of rows from _keyed(): source_size, target, epochs, left (words beyond the epochs), n_bins, cut (the bin in which
    the picks end), last (the place there at which they end, or null), alike and take (rows of that place, and how many of them are
    picked) and last_tie (the last of these, where some are and some aren't); and whether the table is small."""
    sums = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = source_targets(sums, weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = stored(targets.withColumn("n_bins", F.ceil(F.col("n_rows") / BIN_ROWS)).drop("n_rows"), "mix-targets")
    small = targets.count() <= BROADCAST_SOURCES
    binned = with_source(rows, targets, small).withColumn("_bin", _bin())
    cuts = _cuts(binned, F.col("_size"), small, "mix")
    edge = with_source(binned, cuts, small).filter(F.col("_bin") == F.col("cut"))
    # rows alike are one before they meet in a window, so however many share an id, a bin stays small
    edge = edge.groupBy("_source", _place().alias("last"), "_size", "left", "cut_before").agg(F.count(F.lit(1)).alias("alike"))
    running = Window.partitionBy("_source").orderBy("last").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("start", F.col("cut_before") + F.coalesce(F.sum(F.col("_size") * F.col("alike")).over(running), F.lit(0)))
    fits = F.floor((F.col("left") - F.col("start")) / F.col("_size") + 0.5).cast("long")
    edge = edge.withColumn("take", F.when(F.col("_size") > 0, F.least(fits, F.col("alike"))).otherwise(F.col("alike")))
    ends = edge.filter(F.col("start") < F.col("left")).groupBy("_source").agg(F.max(F.struct("last", "alike", "take")).alias("end"))
    plan = with_source(targets.withColumn("_source", F.col("source")).drop("source"), cuts.select("source", "cut"), small)
    plan = with_source(plan, ends.select(F.col("_source").alias("source"), "end.*"), small)
    plan = stored(plan.withColumnRenamed("_source", "source"), "mix-plan")
    return _with_last_tie(rows, plan, small), small


def _with_last_tie(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """plan with last_tie, found among the rows of the place at which a source's picks end as the cut is among all: by bins."""
    split = plan.filter((F.col("take") > 0) & (F.col("take") < F.col("alike"))).select("source", "last", F.col("alike").alias("n"), F.col("take").alias("left"))
    if split.isEmpty():
        return plan.withColumn("last_tie", F.lit(None).cast("struct<u:double,_text_hash:bigint,_number:bigint>"))
    tied = with_source(rows, split, small).filter(_place() == F.col("last")).withColumn("_tie", _tie())
    tied = tied.withColumn("_bin", F.floor(F.col("_tie.u") * F.ceil(F.col("n") / BIN_ROWS)).cast("long"))
    cuts = _cuts(tied, F.lit(1), small, "mix-tie")
    edge = with_source(tied, cuts, small).filter(F.col("_bin") == F.col("cut"))
    at = F.row_number().over(Window.partitionBy("_source").orderBy("_tie")) + F.col("cut_before")
    last = edge.withColumn("_at", at).filter(F.col("_at") <= F.col("left")).groupBy("_source").agg(F.max("_tie").alias("last_tie"))
    return stored(with_source(plan.withColumnRenamed("source", "_source"), last.withColumnRenamed("_source", "source"), small).withColumnRenamed("_source", "source"), "mix-tied-plan")


def _with_plan(df: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    b, whole = _bin(), F.col("take") == F.col("alike")
    inside = (_place() < F.col("last")) | ((_place() == F.col("last")) & (whole | (_tie() <= F.col("last_tie"))))
    picked = (b < F.col("cut")) | ((b == F.col("cut")) & F.col("last").isNotNull() & inside)
    return with_source(df, plan, small).withColumn("picked", F.coalesce(picked, F.lit(False)))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, epochs, picked, taken.

    size: the text's words (null: 0).  taken = size * (epochs + picked).  The picks of a source are the prefix in key order
    whose end is nearest to what is left.  Null ids and equal ids draw the same u as their equals; of rows alike in key, id and size
    as many are picked as come nearest, told apart by hashes of their texts and, alike in these, of their numbers.  An empty table
    gives an empty result.  Texts are read once and never shuffled.
    """
    rows = stored(docs.select(*[c.alias(n) for n, c in _keyed(docs, id_col, text_col, source_col, seed).items()]), "mix-sizes")
    out = _with_plan(rows, *source_plan(rows, weights, max_epochs))
    taken = F.col("_size") * (F.col("epochs") + F.col("picked").cast("long"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "epochs", "picked", taken.cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs.

    A document of no words is taken as often as its place in the order says.  Nulls, repeated ids and rows, and an empty table as
    in mixed(); columns of docs may have any names.  Rows are written once with their sizes and keys, so texts are read once and
    not shuffled.
    """
    keyed = _keyed(docs, id_col, text_col, source_col, seed)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in keyed.items()])
    rows = stored(packed, "mix-rows")
    out = _with_plan(rows, *source_plan(rows.drop("_row"), weights, max_epochs))
    times = F.col("epochs").cast("int") + F.col("picked").cast("int")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), times))).select("_row.*")
