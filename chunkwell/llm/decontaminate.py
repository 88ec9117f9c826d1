"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed in k-grams; of every window of w neighbouring k-grams the smallest hash is kept, on both sides.
Kept test k-grams and kept training k-grams are joined, and each hit is extended word by word to the span that
both texts share. With ``k + w - 1 = t`` every shared span of t words contains a k-gram that both sides keep, so
none is missed; words are compared, so no hash collision counts. Items of fewer than t words are one window of
their own length, winnowed with that length as t.

A bounded bitmap of the kept test k-grams is tested before the training side's winnowing, so that windows are
ranked only around k-grams that the test side has; that changes the work, not the result.

Results for the unusual cases: null and empty texts have no words and are clean; items without words match
nothing; a null item_id counts as one item and has no place in the list of ids; rows that repeat a doc_id are judged each by its own text; items repeated under one item_id count once;
an empty documents table gives an empty result, an empty benchmark a clean one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
KGRAM = 5
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(common.lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD), "")


def _gram(i: str, k: int) -> str:
    return f"xxhash64({', '.join(f'words[{i}+{j}]' for j in range(k))})"


def _kept(positions: str, k: int, w: int) -> str:
    """Of the positions, those whose k-gram hash is the smallest in some window of w k-grams; ties all stay."""
    low = f"array_min(transform(sequence(s, s + {w - 1}), j -> {_gram('j', k)}))"
    return f"filter({positions}, i -> exists(sequence(greatest(0, i - {w - 1}), least(i, n_words - {k + w - 1})), s -> {low} >= {_gram('i', k)}))"


def _seeds(kept: str, k: int, side: int) -> str:
    """Each position with its hash and the words within ``side`` of its k-gram."""
    low, high = f"greatest(0, p - {side})", f"least(n_words, p + {k + side})"
    return f"transform({kept}, p -> struct(p as pos, {_gram('p', k)} as fp, p - {low} as at, slice(words, {low} + 1, {high} - {low}) as around))"


def _shared(sign: str, limit: str, start: str, other: str) -> str:
    """How many neighbouring words agree, walking from the k-gram in one direction."""
    equal = f"transform(sequence(1, {limit}), d -> around[{start} {sign} d] = item_around[{other} {sign} d])"
    return f"case when {limit} <= 0 then 0 when array_position({equal}, false) = 0 then {limit} else array_position({equal}, false) - 1 end"


def find_windows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, kgram: int = KGRAM) -> tuple[DataFrame, DataFrame]:
    """(base, spans): base has id, text_hash and n_words of each row; spans has id, text_hash, item, low, high:
    the words low to high - 1 are a shared span that covers whole windows of that item."""
    bench = items.select(F.col(item_col).alias("item"), words_of(F.col(item_text)).alias("words")).withColumn("n_words", F.size("words")).where("n_words > 0")
    bench = common.cut(bench.distinct())
    classes = sorted({min(window, r[0]) for r in bench.select(F.least("n_words", F.lit(window))).distinct().collect()})  # at most `window` values

    frame = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), words_of(F.col(text_col)).alias("words")).withColumn("n_words", F.size("words"))
    columns, indexes = [], {}
    for t in classes:
        k = min(kgram, t)
        w = t - k + 1
        whole = bench.where(f"n_words >= {window}" if t == window else f"n_words = {t}")
        grams = _seeds(_kept(f"sequence(0, n_words - {k})", k, w), k, t - k)
        index = whole.select("item", F.explode(F.expr(grams)).alias("s")).select("item", F.col("s.fp").alias("fp"), F.col("s.at").alias("item_at"), F.col("s.around").alias("item_around"))
        indexes[t] = common.cut(index.distinct())
        words = common.LITERAL_WORDS
        literal = common.bitmap_literal(common.bitmap_words(indexes[t].select(F.col("fp").alias("h")), words), words)
        bits = f"transform(sequence(0, n_words - {k}), i -> pmod({_gram('i', k)}, {64 * words}L))"  # one hash each, for word and bit
        tested = f"filter(transform({bits}, (x, i) -> if((shiftrightunsigned(({literal})[cast(x div 64 as int)], cast(x % 64 as int)) & 1L) = 1L, i, -1)), i -> i >= 0)"
        frame = frame.withColumn(f"maybe{t}", F.expr(f"case when n_words >= {t} then {tested} else cast(array() as array<int>) end"))
        columns.append((t, k, w))
    for t, k, w in columns:
        frame = frame.withColumn(f"seeds{t}", F.expr(_seeds(_kept(f"maybe{t}", k, w), k, t - k)))
    base = common.cut(frame.select("id", "text_hash", "n_words", *[f"seeds{t}" for t, _, _ in columns]))
    spans = None
    for t, k, _ in columns:
        seeds = base.where(F.size(f"seeds{t}") > 0).select("id", "text_hash", F.explode(f"seeds{t}").alias("s")).select("id", "text_hash", "s.pos", "s.fp", "s.at", "s.around")
        hits = seeds.join(indexes[t], "fp").where(f"slice(around, at + 1, {k}) = slice(item_around, item_at + 1, {k})")
        left = _shared("-", "least(at, item_at)", "at", "item_at")
        right = _shared("+", f"least(size(around) - at, size(item_around) - item_at) - {k}", f"at + {k - 1}", f"item_at + {k - 1}")
        hits = hits.withColumn("l", F.expr(left)).withColumn("r", F.expr(right)).where(f"l + r + {k} >= {t}")
        part = hits.select("id", "text_hash", "item", F.expr("cast(pos - l as int)").alias("low"), F.expr(f"cast(pos + {k} + r as int)").alias("high"))
        spans = part if spans is None else spans.unionByName(part)
    base = base.select("id", "text_hash", "n_words")
    if spans is None:
        spans = base.where("false").select("id", "text_hash", F.lit(None).cast(items.schema[item_col].dataType).alias("item"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    return base, spans


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, kgram: int = KGRAM) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans, items."""
    base, spans = find_windows(docs, items, id_col, text_col, item_col, item_text, window, kgram)
    found = spans.groupBy(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(F.collect_set(F.struct("low", "high")).alias("hit_spans"), F.collect_set(F.struct("item")).alias("items"))
    found = found.withColumn("items", F.transform("items", lambda x: x["item"]))  # a null id is an item too
    found = found.withColumn("n_hit", F.expr("cast(size(array_distinct(flatten(transform(hit_spans, s -> sequence(s.low, s.high - 1))))) as long)"))
    joined = base.join(found, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    names = "array_join(array_sort(transform(items, x -> cast(x as string))), ',')"
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.expr("cast(if(items is null, 0, size(items)) as long)").alias("n_items"),
        F.expr(f"sha2(coalesce({names}, ''), 256)").alias("items_sha256"),
        F.expr("coalesce(n_hit, 0) > 0").alias("contaminated"),
        "hit_spans",
        "items",
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without any benchmark window, with all their columns; rows that share an id, or have none, are
    judged and dropped each by its own text."""
    keyed = common.keyed(docs, id_col, text_col)
    found = decontaminate(keyed.select("key", F.col("row")[text_col].alias("text")), items, "key", "text")
    gone = common.cut(found.where("contaminated").select(F.col("key").alias("gone")))
    kept = common.matched(keyed, gone, F.col("key") == F.col("gone"), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return out.drop("hit_spans", "items")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS t, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM bw WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT t FROM bwin),
dwin AS (
  SELECT doc_id, t, i, array_to_string(w[i:i + t - 1], ' ') AS g
  FROM (SELECT doc_id, t, w, unnest(generate_series(1, len(w) - t + 1)) AS i FROM dw, sizes WHERE len(w) >= t) x),
hit AS (SELECT d.doc_id, d.t, d.i, b.item_id FROM dwin d JOIN bwin b ON d.t = b.t AND d.g = b.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + t - 1)) AS p FROM hit) x GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) x GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
