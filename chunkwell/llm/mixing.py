"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a in [0, 1] and normalised: w = p^a / sum(p^a). At a = 1
the corpus keeps its shares, towards 0 the sources become equal, so entropy rises and the rarest source repeats
more often as a falls. Bisection finds the largest a that reaches the target entropy, then raises it as far as
the repetition limit asks. The weights are realised within a token budget: each source gets whole passes over its
rows, and one last partial pass over seeded permuted blocks, cut within the one block where the budget ends.

Per-source token sums (one row a source) are read by the driver; rows never are. Prefix sums run over blocks of a
bounded size, so one source with a third of all rows is many blocks.

Results for the unusual cases: a null source is a source of its own; null and blank texts have no tokens, and such
rows ride along with whole passes and with the partial pass they fall into; rows that repeat are drawn one by one;
a budget that asks for more passes over all sources than the limit is an error; an empty table gives an empty result, one without tokens comes back with each row once; extra columns pass through ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Target entropy of the weights as a share of ln(number of sources).
ENTROPY_SHARE = 0.97
#: Passes over any source at most.
MAX_PASSES = 4.0
#: Budget in tokens as a share of the corpus's tokens.
BUDGET_SHARE = 1.0
SEED = 17
#: Rows of one block on average.
BLOCK_ROWS = 10_000
STEPS = 60
#: Rows of the plan's table (under 200 bytes each) up to which it is broadcast; beyond, rows are joined by block.
BROADCAST_ROWS = 50_000


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(n / total) ** exponent if n else 0.0 for n in tokens]
    scale = math.fsum(raised)
    return [x / scale for x in raised]


def entropy(w: list[float]) -> float:
    return -math.fsum(x * math.log(x) for x in w if x > 0)


def solve(tokens: list[int], entropy_share: float = ENTROPY_SHARE, max_passes: float = MAX_PASSES, budget: int | None = None) -> float:
    """The exponent. Entropy falls and the most passes fall as the exponent rises, so both bisect."""
    budget = sum(tokens) if budget is None else budget
    live = [n for n in tokens if n]
    if not live:
        return 1.0
    target = entropy_share * math.log(len(live)) if len(live) > 1 else 0.0

    def bisect(too_high) -> float:
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (low, middle) if too_high(middle) else (middle, high)
        return low

    exponent = 1.0 if entropy(weights(live, 1.0)) >= target else bisect(lambda a: entropy(weights(live, a)) < target)
    passes = lambda a: max(w * budget / n for w, n in zip(weights(live, a), live, strict=True))
    if passes(1.0) > max_passes + 1e-9:
        raise ValueError(f"a budget of {budget} tokens takes more than {max_passes} passes over {sum(live)} tokens")
    if passes(exponent) > max_passes:
        exponent = 1.0 - bisect(lambda b: passes(1.0 - b) > max_passes)
    return exponent


def _dealt(df: DataFrame, id_col: str, source_col: str, blocks: int, seed: int) -> DataFrame:
    """df with __source, __draw (a seeded hex digest of the id) and __block, into which its first digits deal the row."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    block = F.expr(f"cast((cast(conv(substr(__draw, 1, 8), 16, 10) as bigint) * {blocks}L) div 4294967296L as int)")
    return df.withColumn("__source", F.col(f"`{source_col}`")).withColumn("__draw", draw).withColumn("__block", block)


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy_share: float = ENTROPY_SHARE, max_passes: float = MAX_PASSES, budget_share: float = BUDGET_SHARE, seed: int = SEED) -> tuple[DataFrame, int, dict]:
    """(table, blocks, report): table has, per source and block, the whole passes and the digest up to which the
    partial pass takes the block's rows (all, none or up to a cut); report has each source's weight and target."""
    tokens = F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(r"\S+")).cast("long")
    blocks = max(1, df.count() // BLOCK_ROWS)
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), tokens.alias("n_tokens"))
    base = common.cut(_dealt(narrow, "id", "source", blocks, seed).select("__source", "__draw", "__block", "n_tokens"))
    sums = base.groupBy("__source", "__block").agg(F.sum("n_tokens").alias("tokens"))
    sums = common.cut(sums)
    per_source = sums.groupBy("__source").agg(F.sum("tokens").alias("tokens")).collect()
    per_source = sorted(per_source, key=lambda r: (r["__source"] is not None, r["__source"] or ""))
    held = [r.tokens for r in per_source]
    budget = int(sum(held) * budget_share)
    exponent = solve(held, entropy_share, max_passes, budget) if sum(held) else 1.0
    share = weights(held, exponent) if sum(held) else [0.0] * len(held)
    targets = [int(w * budget) for w in share]
    report = {"exponent": exponent, "sources": [{"source": r["__source"], "tokens": r.tokens, "weight": w, "target": t} for r, w, t in zip(per_source, share, targets, strict=True)]}
    kind = df.schema[source_col].dataType.simpleString()
    asked = df.sparkSession.createDataFrame([(r["__source"], t // n if n else 0, t % n if n else 0) for r, n, t in zip(per_source, held, targets, strict=True)], f"s {kind}, passes long, rest long")
    # the blocks of a source are taken in a permuted order of their own
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("__source").cast("string"), F.lit("")), "__block"))
    so_far = Window.partitionBy("__source").orderBy("turn", "__block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("turn", turn).withColumn("start", F.coalesce(F.sum("tokens").over(so_far), F.lit(0)))
    placed = placed.join(F.broadcast(asked), placed["__source"].eqNullSafe(asked["s"]))  # one row a source
    placed = common.cut(placed.select(F.col("__source").alias("ps"), F.col("__block").alias("pb"), "passes", F.expr("rest - start").alias("room"), F.expr("start + tokens <= rest").alias("whole")))
    # one block a source at most is cut within: its rows in the order of their digests, as far as there is room
    open_blocks = placed.where("not whole and room > 0")
    rows = base.join(F.broadcast(open_blocks), base["__source"].eqNullSafe(open_blocks["ps"]) & (base["__block"] == open_blocks["pb"]))
    upto = Window.partitionBy("ps", "pb").orderBy("__draw").rangeBetween(Window.unboundedPreceding, 0)
    cuts = rows.withColumn("upto", F.sum("n_tokens").over(upto)).where("upto <= room").groupBy(F.col("ps").alias("cs"), F.col("pb").alias("cb")).agg(F.max("__draw").alias("cut"))
    table = placed.join(cuts, placed["ps"].eqNullSafe(cuts["cs"]) & (placed["pb"] == cuts["cb"]), "left")
    table = table.select("ps", "pb", "passes", F.expr("case when whole then 'g' else coalesce(cut, '') end").alias("take"))
    return common.cut(table), blocks, report


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """(id, source, copies, row) for every row of df: how often the plan takes it; row is the whole row as a struct,
    so that no column name can clash. Texts are not shuffled while the plan's table is small."""
    table, blocks, _ = plan(df, id_col, text_col, source_col, seed=seed, **options)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    dealt = _dealt(rows, "id", "source", blocks, seed)
    held = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    joined = dealt.join(held, dealt["__source"].eqNullSafe(table["ps"]) & (dealt["__block"] == table["pb"]))
    # hex digests sort before 'g' and after ''
    return joined.select("id", "source", F.expr("passes + if(__draw <= take, 1, 0)").alias("copies"), "row")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of df, each as often as the plan says, with all their columns."""
    taken = copies(df, id_col, text_col, source_col, **options).where("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how often it is taken."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return copies(docs).select(F.col("id").alias("doc_id"), "source", "copies")
