"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

Van der Corput points, mapped through the cumulative weights, say which source
fills a slot of the mix. A source's documents are shuffled and cut into blocks of
equal size; its k-th slot takes its k-th block, and a source that is wanted more
than once is shuffled anew for every further pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import numbered, text_of
from scanloom.plans.stage import stage

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
BLOCK = 2048
SEED = "mix-1"
_CHUNK = 4096


def _running(df: DataFrame, group: Sequence[str], chunk: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows of the group that come before.

    ``chunk`` cuts every group, however large, into short runs that follow each
    other in the order; only sums of chunks meet in one window per group.
    """
    group = list(group)
    df = df.withColumn("__value", value)
    sums = df.groupBy(*group, chunk).agg(F.sum("__value").alias("__sum"))
    chunks = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sums = sums.select(*group, chunk, (F.sum("__sum").over(chunks.orderBy(chunk)) - F.col("__sum")).alias("__before"))
    inside = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__inside", F.sum("__value").over(inside) - F.col("__value"))
    return df.join(sums, [*group, chunk]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__value", "__inside", "__before")


def _chunks_of(rows: int) -> int:
    """Bits of a digest that cut ``rows`` rows into chunks of some thousand."""
    return min(30, max(0, (rows // _CHUNK).bit_length()))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """source, source_no, source_size, target: how many words each source is to give.

    ``sizes`` has one row per source with its size. All sources together give
    ``share`` times the sum of sizes, in proportion to the weights, which repeat
    over the sources by code point, null last. What a source would give above
    ``passes`` times its size goes to the others by weight, until none is above.
    Every round is one aggregate that returns two numbers.
    """
    spark = sizes.sparkSession
    ordered = numbered(sizes.withColumn("__none", F.col("source").isNull()), ["__none", "source"], "source_no", label="mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    table = stage(ordered.select("source", "source_no", "source_size", weight.alias("weight")), "mix-weights")
    total, over_all = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return spark.createDataFrame([], "source string, source_no long, source_size long, target double")
    rate, full = share * total / over_all, -1
    while True:
        above = table.filter(F.col("weight") * F.lit(rate) > F.col("source_size") * passes)
        n, size, weighs = above.agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("weight")).first()
        if n <= full or weighs is None or weighs >= over_all:
            break
        rate, full = (share * total - passes * size) / (over_all - weighs), n
    target = F.least((F.col("source_size") * passes).cast("double"), F.col("weight") * F.lit(rate))
    return stage(table.select("source", "source_no", "source_size", target.alias("target")), "mix-targets")


def _slots(sources: DataFrame) -> DataFrame:
    """source_no, rank, slot: the schedule, cut to the ``n_slots`` first slots of every source.

    A source owns a range of points as wide as its slots. The range is cut at
    equal steps, and slots find their source by step, so a source with most of
    the mix is spread over as many keys as its share.
    """
    spark = sources.sparkSession
    wanted, n_sources = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(1, (wanted - 1).bit_length()) if wanted else 1
    shift = max(0, bits - max(10, n_sources.bit_length() + 4))
    chunked = sources.withColumn("__chunk", F.floor(F.col("source_no") / _CHUNK))
    ranged = _running(chunked, [], "__chunk", ["source_no"], F.col("n_slots"), "__from").filter("n_slots > 0")
    point = f"* CAST({1 << bits} AS DECIMAL(19, 0)) DIV CAST({max(1, wanted)} AS DECIMAL(19, 0))"
    owners = ranged.select(
        "source_no",
        "n_slots",
        F.expr(f"CAST(__from AS DECIMAL(19, 0)) {point}").alias("__low"),
        F.expr(f"CAST(__from + n_slots AS DECIMAL(19, 0)) {point}").alias("__high"),
    )
    step = F.explode(F.sequence(F.shiftright("__low", shift), F.shiftright(F.col("__high") - 1, shift)))
    owners = owners.withColumn("__step", step)
    points = spark.range(1 << bits).withColumn(
        "__point", F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long")
    )
    points = points.withColumn("__step", F.shiftright("__point", shift)).join(owners, "__step")
    points = points.filter("__point >= __low AND __point < __high").select("source_no", "n_slots", F.col("id").alias("slot"))
    points = points.withColumn("__chunk", F.floor(F.col("slot") / _CHUNK))
    ranked = _running(points, ["source_no"], "__chunk", ["slot"], F.lit(1).cast("long"), "rank")
    return ranked.filter("rank < n_slots").select("source_no", "rank", "slot")


def _prepare(docs, weights, share, passes, block, seed, id_col, text_col, source_col) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Narrow rows of the documents, sources with their targets, and the pieces of documents that the mix takes."""
    text = text_of(text_col)
    keys = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), F.md5(text.cast("binary")))).alias("digest"),
    )
    keys = stage(keys.withColumn("row", F.monotonically_increasing_id()), "mix-keys")
    sources = targets(keys.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, passes)
    words = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    sources = stage(
        sources.withColumn("words", words).withColumn("n_slots", F.expr(f"(words + {block - 1}) DIV {block}")), "mix-plan"
    )

    rows = keys.filter("size > 0").join(
        sources.select(F.col("source").alias("__source"), "source_no", "source_size", "words"),
        F.col("source").eqNullSafe(F.col("__source")),
    )
    again = F.explode(F.sequence(F.lit(0), F.expr("(words - 1) DIV source_size").cast("int")))
    rows = rows.filter("words > 0").select("row", "doc_id", "size", "source_no", "source_size", "words", "digest", again.alias("epoch"))
    order = F.when(F.col("epoch") == 0, F.col("digest")).otherwise(F.md5(F.concat_ws(":", "digest", F.col("epoch").cast("string"))))
    rows = rows.withColumn("digest", F.unhex(order))
    bits = _chunks_of(keys.count())
    rows = rows.withColumn("__chunk", F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - bits))
    rows = _running(rows, ["source_no", "epoch"], "__chunk", ["digest", "row"], F.col("size"), "__start")
    rows = rows.withColumn("__start", F.col("__start") + F.col("epoch") * F.col("source_size")).filter("__start < words")
    rows = rows.withColumn("__end", F.least(F.col("__start") + F.col("size"), F.col("words")))
    blocks = F.explode(F.expr(f"sequence(__start DIV {block}, (__end - 1) DIV {block})"))
    cut = rows.select("row", "doc_id", "source_no", "epoch", "__start", "__end", blocks.alias("rank"))
    first = F.greatest(F.col("__start"), F.col("rank") * block)
    cut = cut.select(
        "source_no",
        "rank",
        "epoch",
        "doc_id",
        "row",
        (first - F.col("__start")).alias("start"),
        (F.least(F.col("__end"), (F.col("rank") + 1) * block) - first).alias("length"),
        (first - F.col("rank") * block).alias("offset"),
    )
    pieces = cut.join(_slots(sources), ["source_no", "rank"]).drop("rank")
    return keys, sources, pieces


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    block: int = BLOCK,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix: which words of which document stand where.

    Returns one row per piece: slot (the place of a block in the mix), offset
    (words before the piece in the block), source, epoch (0 for the first pass
    over a source), doc_id, start (words of the document before the piece) and
    length. Blocks hold ``block`` words; the last of a source may hold fewer.

    A null text has no words, a null source is a source of its own and comes
    last, a null id stays null; repeated rows are taken one by one. An empty
    table, or one without words, gives no rows. The order hangs on ids, texts
    and the seed alone, so that reruns agree.
    """
    _, sources, pieces = _prepare(docs, weights, share, passes, block, seed, id_col, text_col, source_col)
    named = pieces.join(sources.select("source_no", "source"), "source_no")
    return named.select("slot", "offset", "source", "epoch", "doc_id", "start", "length")


def taken_words(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    block: int = BLOCK,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken and source, a row per document.

    ``taken`` sums the pieces of the mix over all passes, so it never exceeds
    ``passes`` times the size; summed over a source it is the target rounded to
    whole words. A document without words has taken 0. Awkward input as in
    ``mix_sources``.
    """
    keys, sources, pieces = _prepare(docs, weights, share, passes, block, seed, id_col, text_col, source_col)
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    sources = sources.select(F.col("source").alias("__source"), "source_size", "target")
    return (
        keys.join(taken, "row", "left")
        .join(sources, F.col("source").eqNullSafe(F.col("__source")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source")
    )
