"""Mixing sources to target weights: temperature shares realised as budgeted block permutations."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, land, text_or_empty

STEPS = 32       # sections of the exponent's interval in a round of the search
ROUNDS = 4       # 32 ** 4 points: the exponent is exact to one millionth
BLOCK_TOKENS = 200_000
PIECES = 4096    # parts of a source's permutation of blocks


def _tokens(text: str) -> Column:
    """White-space separated words, one at least: an empty text still takes its place."""
    words = F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.greatest(words, F.lit(1)).cast("long")


def _source_key(source: Column) -> Column:
    """The source as a text that is never null."""
    return F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source.cast("string"), F.lit("")))


def fit_exponent(sources: DataFrame, target_entropy: float | None = None,
                 max_repeat: float | None = None, budget_tokens: float | None = None) -> float:
    """The exponent a in [0, 1] for shares p ** a / sum(p ** a), by sectioning its interval.

    With ``target_entropy`` (a fraction of the largest possible) it is the
    largest a whose shares reach that entropy; with ``max_repeat`` the smallest
    a at which no source is repeated more often.  Both conditions change once
    along the interval, so sectioning finds the change.  A round is one
    aggregate over the sources (``source``, ``tokens``) that sends STEPS rows
    to the driver, however many sources there are.
    """
    if (target_entropy is None) == (max_repeat is None):
        raise ValueError("give either target_entropy or max_repeat")
    total = sources.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("most"),
                        F.count(F.lit(1)).alias("n"), F.min("tokens").alias("least")).first()
    if not total["t"]:
        return 1.0
    share = F.col("tokens") / F.lit(float(total["t"]))
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        width = (high - low) / STEPS
        points = F.array(*[F.lit(low + width * i) for i in range(STEPS + 1)])
        grid = (sources.select(share.alias("p"), F.explode(points).alias("a"))
                .groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"),
                                  F.sum(F.pow("p", "a") * F.col("a") * F.log("p")).alias("w")).collect())
        fits = []
        for row in sorted(grid, key=lambda r: r["a"]):
            if target_entropy is not None:
                entropy = log(row["z"]) - row["w"] / row["z"]
                fits.append((row["a"], entropy >= target_entropy * log(max(total["n"], 2)) - 1e-12))
            else:
                least, most = total["least"] / total["t"], total["most"] / total["t"]
                if budget_tokens is None:      # every source once at least: the largest source sets the budget
                    repeat = (least / most) ** (row["a"] - 1)
                else:
                    repeat = budget_tokens * least ** row["a"] / row["z"] / total["least"]
                fits.append((row["a"], repeat <= max_repeat + 1e-9))
        good = [a for a, ok in fits if ok]
        if target_entropy is not None:
            low = max(good) if good else low
            high = min(low + width, high)
        else:
            high = min(good) if good else high
            low = max(high - width, low)
    return low if target_entropy is not None else high


def plan(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None,
         budget_tokens: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """Per source: source, tokens, share, weight, repeats (weights' token budget over its tokens).

    Without ``budget_tokens`` the budget is the smallest that takes every source
    once at least, so mixing only repeats and loses no document.
    """
    sources = land(docs.select(F.col(source).alias("source"), _tokens(text).alias("tokens"))
                   .groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    a = fit_exponent(sources, target_entropy, max_repeat, budget_tokens)
    total = sources.agg(F.sum("tokens").alias("t")).first()["t"] or 1
    share = F.col("tokens") / F.lit(float(total))
    top = sources.select(share.alias("p")).agg(F.sum(F.pow("p", F.lit(a))).alias("z"),
                                               F.max(F.col("p")).alias("p")).first()
    z = top["z"] or 1.0
    weight = F.pow(share, F.lit(a)) / F.lit(z)
    budget = budget_tokens or total * (top["p"] or 1.0) * z / ((top["p"] or 1.0) ** a)
    repeats = F.round(weight * F.lit(float(budget)) / F.col("tokens"), 9)
    return sources.select("source", "tokens", share.alias("share"), weight.alias("weight"),
                          repeats.alias("repeats"), F.lit(a).alias("exponent"))


def _free(names: tuple[str, ...], taken: list[str]) -> list[str]:
    """The names, with underscores before them until none is taken (in any case of letters)."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
    return out


def _dealt(rows: DataFrame, spark) -> DataFrame:
    """``rows`` with ``copy``: 0, but a number of its own for each row of a repeated place.

    Rows of one place are landed with their numbers, so these stay the same
    whenever the rows are read again.
    """
    repeated = land(rows.groupBy("place").count().where("count > 1").select("place"), "mix-repeated")
    single = rows.withColumn("copy", F.lit(0).cast("long"))
    few = repeated.count()
    if not few:
        return single
    keys = F.broadcast(repeated) if few <= BROADCAST_ROWS else repeated
    copies = land(rows.join(keys, "place", "left_semi").withColumn("copy", F.monotonically_increasing_id()), "mix-copies")
    return single.join(keys, "place", "left_anti").unionByName(copies)


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None,
        budget_tokens: float | None = None, doc_id: str = "doc_id", source: str = "source",
        text: str = "text", block_tokens: int = BLOCK_TOKENS, seed: str = "mix") -> DataFrame:
    """The input's rows with ``_mix_epoch``, ``_mix_block`` and ``_mix_tokens``: one row per use of a document.

    A source with repeats r is used in floor(r) whole epochs; the rest of its
    budget takes whole blocks of a permutation and, of the block at the limit,
    documents in their order until the tokens before a document reach the
    budget.  Blocks hold about ``block_tokens`` tokens; a document's block and
    its place there come from a hash of its id and text, and for rows that
    share both also from a number of their own, so they spread over the blocks.

    Running sums are taken over a source's blocks, in PIECES parts, and inside
    each block: no source's documents or blocks pass through one task.  Null
    sources are one source.  Null or empty texts count one token.  An empty
    table gives an empty result.  Columns of the input keep their names and
    values; where one has a name of ours, ours gets underscores before it.
    """
    spark = docs.sparkSession
    p = plan(docs, target_entropy, max_repeat, budget_tokens, source, text).select(
        _source_key(F.col("source")).alias("source"), F.col("tokens").alias("total"), "repeats")
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"),
                           F.md5(text_or_empty(text).cast("binary"))).cast("binary"))
    rows = _dealt(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                              _source_key(F.col(source)).alias("source"), _tokens(text).alias("tokens"),
                              place.alias("place")), spark)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(block_tokens))).cast("long")
    spread = F.when(F.col("copy") == 0, F.conv(F.substring("place", 1, 12), 16, 10).cast("long")).otherwise(
        F.xxhash64("place", "copy"))
    rows = rows.join(p, "source").withColumn("block", F.pmod(spread, blocks))

    until = (Window.unboundedPreceding, -1)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("block").cast("string")).cast("binary"))
    each = (rows.groupBy("source", "block").agg(F.sum("tokens").alias("n")).withColumn("order", order)
            .withColumn("piece", F.conv(F.substring("order", 1, 6), 16, 10).cast("int") % PIECES))
    pieces = each.groupBy("source", "piece").agg(F.sum("n").alias("n")).select(
        "source", "piece", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("piece").rowsBetween(*until)),
                                      F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "piece").orderBy("order", "block").rowsBetween(*until)
    offsets = each.join(pieces, ["source", "piece"]).select(
        "source", "block", (F.col("ahead") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"))

    in_block = Window.partitionBy("source", "block").orderBy("place", "copy").rowsBetween(*until)
    run = F.col("before") + F.coalesce(F.sum("tokens").over(in_block), F.lit(0))
    part = (F.col("repeats") - F.floor("repeats")) * F.col("total")
    uses = (F.floor("repeats") + F.when(run < part, 1).otherwise(0)).cast("int")
    epoch, block, tokens = _free(("_mix_epoch", "_mix_block", "_mix_tokens"), docs.columns)
    return (rows.join(offsets, ["source", "block"]).withColumn("uses", uses).where("uses > 0")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
            .select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("epoch").alias(epoch),
                    F.col("block").alias(block), F.col("tokens").alias(tokens)))
