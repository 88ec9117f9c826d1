"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its blank-separated words. Lines of equal sets are one class, represented by their first
line (by doc_id, then line number). Words are ordered by rarity, rarest first: their occurrences in all documents
are counted in a table of fixed size by hash, so that the order is one global order without a join per word (any
order is exact). Two sets of a Jaccard similarity of 0.8 or more share a word within their prefixes (the shorter set needs the shorter prefix), and sets of
that similarity are of about one size. Classes therefore meet on (word, size range): each files its short prefix under
its own size range and looks up its long prefix under every range that a smaller partner can be in. Pairs pass the
length filter, the positional filter and a parity-signature filter of 128 bits (none drops a true pair) before the
exact Jaccard of the words themselves. A line goes if an earlier line has a similarity of 0.8 or more with it.

One witness is enough for a line to go, so each class is first compared with the earliest class under a few pairs of
its prefix words, drawn by hash. Groups of near copies therefore cost their size, not its square: only pairs whose later line is
still without a witness are then tried, and those are all tried.

Results for the unusual cases: null text is one blank line; lines without words are never removed; ties between
equal lines go to the smaller doc_id, then line number; rows that share a doc_id, or have none, are rows of their own
in the order of doc_id and text digest, nulls first; an empty table gives an empty result; other columns are not read,
and pass through ``remove_repeated_lines`` whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIMILARITY = 0.8
#: Cells of the rarity table; one small number each travels in the plan.
CELLS = 1 << 19
#: Pairs of neighbouring words of its prefix, those of the smallest hashes, under which a line first looks for a witness.
FIRST_PAIRS = 3
#: Passes of the join over the words, by hash: the shuffle of one pass is gone before the next one's is written.
PASSES = 2
#: Sizes and positions from here on pass the filters unseen.
WIDE = (1 << 15) - 1


def _plain(text: Column) -> Column:
    """The text with every blank that separates words within a line as a space."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[\t\x0B\f\r]"), F.regexp_replace(text, r"[\t\x0B\f\r]", " ")).otherwise(text)


def _words(line: str) -> str:
    return f"array_remove(split({line}, ' '), '')"


def rarity_table(docs: DataFrame, text_col: str) -> str:
    """SQL text of an array literal: for each hash cell 1 to 127, growing with how often its words occur."""
    words = docs.select(F.explode(F.split(F.replace(_plain(F.col(text_col)), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(F.expr(f"cast(xxhash64(w) & {CELLS - 1}L as int)").alias("cell")).count()
    # at most CELLS cells reach the driver, as text in rows of 4096
    packed = counts.groupBy(F.expr("cell div 4096").alias("g")).agg(F.array_join(F.collect_list(F.concat_ws(":", "cell", "count")), ",").alias("t"))
    found = [(int(cell), int(n)) for row in packed.collect() for cell, _, n in (x.partition(":") for x in row.t.split(","))]
    levels = bytearray(b"\x01" * CELLS)
    for cell, n in found:
        levels[cell] = max(1, min(127, int(4 * math.log2(n + 1))))
    return f"cast(split('{','.join(map(str, levels))}', ',') as array<tinyint>)"


def _stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder; columns are read as needed."""
    path = f"{common.checkpoint_dir(df.sparkSession).rstrip('/')}/lines-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _needed(n: str, m: str, similarity: float) -> str:
    """Words that sets of n and m words must share."""
    return f"ceil({similarity / (1 + similarity)!r}D * ({n} + {m}) - 1e-9D)"


def _passes(similarity: float) -> str:
    """Length, positional and signature filters on two entries, prefixes a_ and b_."""
    shared = _needed("a_n", "b_n", similarity)
    length = f"least(a_n, b_n) >= {similarity!r}D * greatest(a_n, b_n) - 1e-9D"
    position = f"1 + least(a_n - a_pos, b_n - b_pos) >= {shared}"
    signature = f"bit_count(a_sig ^ b_sig) + bit_count(a_sig2 ^ b_sig2) <= a_n + b_n - 2 * {shared}"
    return f"(a_n >= {WIDE} or b_n >= {WIDE} or ({length} and {position} and {signature}))"


#: An entry's small numbers in one long: 1 bit for a class that has its witness, 15 for size, 15 for position, 32 for the line.
_N, _POS, _LINE, _DONE = "(shiftright({0}, 47) & 32767L)", "(shiftright({0}, 32) & 32767L)", "({0} & 4294967295L)", "(shiftright({0}, 62) & 1L)"
_EARLIER = "(a_id < b_id or (a_id = b_id and a_line < b_line))"


def _unpacked(text: str) -> str:
    """Names like a_n, b_pos and a_line as expressions on the packed columns a_x and b_x."""
    for side in "ab":
        for name, form in (("n", _N), ("pos", _POS), ("line", _LINE), ("done", _DONE)):
            text = re.sub(rf"\b{side}_{name}\b", form.format(f"{side}_x"), text)
    return text


def _short(n: str, similarity: float) -> str:
    """Words of the prefix that meets every partner of the same size or larger; n minus what they share, plus one."""
    return f"cast({n} - ceil({2 * similarity / (1 + similarity)!r}D * {n} - 1e-9D) + 1 as int)"


def _range(n: str, similarity: float) -> str:
    """The size range of a set of n words; ranges grow by 1 / similarity twice, so partners lie in two at most."""
    return f"cast(floor(ln({n}) * {0.5 / -math.log(similarity) if similarity < 1 else 1.0!r}D) as int)"


def _named() -> list[Column]:
    return [F.col("a_id"), F.expr(_unpacked("cast(a_line as int)")).alias("a_line"), F.col("b_id"), F.expr(_unpacked("cast(b_line as int)")).alias("b_line")]


def _entries(live: DataFrame, side: str, low: str, high: str, similarity: float, partners: bool = False, only: str = "true", at: str = "i + low") -> DataFrame:
    """(k, id, sig, sig2, x), but for k with the side's name, for the prefix words at positions low to high of each
    class (id, line_no, n, sig, sig2, prefix, done). k is a word with the class's own size range, or with each range that
    its smaller partners can be in; x is packed; only is a condition on the word t, at the position that is filed."""
    rows = live.select("id", "line_no", "n", "sig", "sig2", "done", F.expr(low).alias("low"), F.posexplode(F.expr(f"slice(prefix, {low}, {high} - {low} + 1)")).alias("i", "t"))
    rows = rows.where(only).withColumn("pos", F.expr(at))
    packed = f"shiftleft(done, 62) | shiftleft(least(cast(n as bigint), {WIDE}L), 47) | shiftleft(least(cast(pos as bigint), {WIDE}L), 32) | cast(line_no as bigint)"
    ranges = F.expr(_range("n", similarity))
    if partners:
        smallest = f"greatest(1, cast(ceil({similarity!r}D * n - 1e-9D) as int))"
        # a partner that shares its first word with this position has at most this size, or too few words are left
        largest = f"if(n >= {WIDE}, n, greatest({smallest}, least(n, cast(floor((1 + n - pos) * {(1 + similarity) / similarity!r}D - n + 1e-6D) as int))))"
        rows = rows.select("*", F.expr(_range(smallest, similarity)).alias("r0"), F.expr(_range(largest, similarity)).alias("r1"))
        ranges = F.explode(F.expr("case when r0 = r1 then array(r0) when r0 + 1 = r1 then array(r0, r1) else sequence(r0, r1) end"))
    rows = rows.select("t", "id", "sig", "sig2", F.expr(packed).alias("x"), ranges.alias("r"))
    return rows.select(F.expr("shiftleft(cast(t as bigint), 16) | r").alias("k"), *[F.col(c).alias(f"{side}_{c}") for c in ("id", "sig", "sig2", "x")])


def _verify(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Those of the checkpointed pairs (a_id, a_line, b_id, b_line) whose lines' word sets really are that similar."""
    wanted = pairs.select(F.col("a_id").alias("wid"), F.col("a_line").alias("wline")).unionByName(pairs.select(F.col("b_id").alias("wid"), F.col("b_line").alias("wline")))
    wanted = common.cut(wanted.groupBy("wid").agg(F.collect_set("wline").alias("wlines")))  # within a document
    held = common.matched(docs, wanted, F.col("id") == F.col("wid"), "inner")
    numbered = F.expr("filter(transform(t, (x, i) -> struct(cast(i as int) as no, x as line)), s -> array_contains(wlines, s.no))")
    lines = held.select("id", "wlines", F.split(_plain(F.col("text")), "\n").alias("t")).select("id", F.explode(numbered).alias("l")).select("id", "l.no", "l.line")
    texts = _stored(lines)
    # a line that many pairs share is one row on its side, so the engine may split the pairs
    a, b = (texts.select(F.col("id").alias(f"{s}i"), F.col("no").alias(f"{s}l"), F.expr(f"array_distinct({_words('line')})").alias(f"{s}w")) for s in "ab")
    both = pairs.join(a, F.expr("a_id = ai and a_line = al")).join(b, F.expr("b_id = bi and b_line = bl")).withColumn("o", F.size(F.array_intersect("aw", "bw")))
    return common.cut(both.where(f"o >= {similarity!r}D * (size(aw) + size(bw) - o) - 1e-9D").select("a_id", "a_line", "b_id", "b_line"))


def _repeated(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, equal, removed) of docs (id, text), whose ids are unique: every line as (id, line_no, n), the lines
    (id, line_no) of which an equal one stands earlier, and the witnesses as in ``repeated_lines``."""
    if not 0 < similarity <= 1:
        raise ValueError(f"similarity {similarity} is not above 0 and up to 1")
    spark, table = docs.sparkSession, rarity_table(docs, "text")
    hashes = f"transform({_words('line')}, w -> xxhash64(w) & 72057594037927935L)"
    # never null, which lets the engine sort plain longs
    keys = f"transform({hashes}, h -> coalesce(shiftleft(cast(({table})[cast(h & {CELLS - 1}L as int)] as bigint), 56) | h, h))"
    lines = docs.select("id", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("k", F.expr(f"sort_array(array_distinct({keys}))")).withColumn("n", F.size("k"))
    # smaller sets are similar enough only if equal
    least = math.ceil(similarity / (1 - similarity) - 1e-9) if similarity < 1 else 1 << 30
    signature = lambda half: f"if(n >= {least}, aggregate(k, 0L, (s, x) -> s ^ if((x & 64L) = {half}L, shiftleft(1L, cast(x & 63L as int)), 0L)), 0L)"
    prefix = f"transform(slice(k, 1, cast(n - ceil({similarity!r}D * n - 1e-9D) + 1 as int)), x -> hash(x))"
    lines = _stored(lines.select("id", "line_no", "n", F.xxhash64("k").alias("h1"), F.xxhash64("k", F.lit(1)).alias("h2"), F.expr(signature(0)).alias("sig"), F.expr(signature(64)).alias("sig2"), F.expr(f"if(n >= {least}, {prefix}, array())").alias("prefix")))

    # the first line of a class as one number, which aggregates by hash
    place = F.expr("cast(id as decimal(20, 0)) * cast(4294967296 as decimal(10, 0)) + line_no")
    classes = lines.where("n > 0").select("h1", "h2", place.alias("place")).groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("c"))
    classes = classes.where("c > 1").withColumn("cline", F.expr("pmod(first, 4294967296)"))
    classes = common.cut(classes.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.expr("(first - cline) div 4294967296").alias("cid"), F.col("cline").cast("int").alias("cline")))
    placed = common.matched(lines, classes, F.expr("h1 = c1 and h2 = c2 and n > 0"), "left").withColumn("leads", F.expr("cid is null or (id = cid and line_no = cline)"))
    equal = placed.where("not leads").select("id", "line_no")
    live = placed.where(f"leads and n >= {least}").select("id", "line_no", "n", "sig", "sig2", "prefix")

    # the earliest class under each of a few keys, by an aggregate that combines before the shuffle
    passes, earlier = F.expr(_unpacked(_passes(similarity))), F.expr(_unpacked(_EARLIER))
    short = _short("n", similarity)
    pairs = "transform(sequence(1, greatest(1, size(prefix) - 1)), i -> hash(prefix[i - 1], prefix[least(i, size(prefix) - 1)]))"
    near = _entries(live.withColumn("done", F.lit(0).cast("long")).withColumn("prefix", F.expr(f"slice(sort_array({pairs}), 1, {FIRST_PAIRS})")), "b", "1", "size(prefix)", similarity, at="1")
    leads = near.groupBy(F.col("k").alias("lk")).agg(F.min("b_id").alias("a_id"), F.min_by("b_sig", "b_id").alias("a_sig"), F.min_by("b_sig2", "b_id").alias("a_sig2"), F.min_by("b_x", "b_id").alias("a_x"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = near.join(leads, F.col("k") == F.col("lk")).where(earlier & passes).select(*_named())
    seen = _verify(common.cut(met.distinct()), docs, similarity)
    found = common.cut(seen.select(F.col("b_id").alias("fid"), F.col("b_line").alias("fline")).distinct())
    del near, leads, met
    common.release(spark)

    # every pair whose later line has no witness yet; a class that has one can still be one for others
    marked = common.matched(live, found, F.expr("id = fid and line_no = fline"), "left").withColumn("done", F.col("fline").isNotNull().cast("long")).drop("fid", "fline")
    waits = F.expr(_unpacked(f"not (a_id = b_id and a_line = b_line) and a_n <= b_n and (a_n < b_n or a_n >= {WIDE} or {_EARLIER}) and if({_EARLIER}, b_done, a_done) = 0"))
    a_id, a_line, b_id, b_line = _named()
    ordered = [F.when(earlier, a_id).otherwise(b_id).alias("a_id"), F.when(earlier, a_line).otherwise(b_line).alias("a_line"), F.when(earlier, b_id).otherwise(a_id).alias("b_id"), F.when(earlier, b_line).otherwise(a_line).alias("b_line")]
    more = None
    for number in range(PASSES):
        only = f"pmod(t, {PASSES}) = {number}"
        filed = _entries(marked, "a", "1", short, similarity, only=only)
        looked = _entries(marked, "b", "1", "size(prefix)", similarity, partners=True, only=only)
        part = common.cut(filed.join(looked, "k").where(waits & passes).select(*ordered).distinct())
        more = part if more is None else more.unionByName(part)
        del filed, looked, part
        common.release(spark)
    return lines, equal, seen.unionByName(_verify(common.cut(more.distinct()), docs, similarity))


def _gone(equal: DataFrame, removed: DataFrame) -> DataFrame:
    """(gid, gline): the lines that go, each once."""
    similar = removed.select(F.col("b_id").alias("gid"), F.col("b_line").alias("gline")).distinct()
    return common.cut(equal.select(F.col("id").alias("gid"), F.col("line_no").alias("gline")).unionByName(similar))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """docs as (key, row), and (id, text) with the keys as ids."""
    keyed = common.keyed(docs, id_col, text_col)
    return keyed, keyed.select(F.col("key").alias("id"), F.col("row")[text_col].alias("text"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(lines, removed): every line as (id, line_no, n, gone), n being its number of distinct words, and why lines that
    are first of their class go: (a_id, a_line, b_id, b_line) with line a the earlier witness of line b. Ids are the
    documents' own if these are unique integers, else row numbers in the order of id and text digest."""
    lines, equal, removed = _repeated(_texts(docs, id_col, text_col)[1], similarity)
    gone = _gone(equal, removed)
    told = common.matched(lines, gone, F.expr("id = gid and line_no = gline"), "left")
    return told.select("id", "line_no", "n", F.col("gline").isNotNull().alias("gone")), removed


def _numbers(texts: DataFrame, similarity: float) -> DataFrame:
    """(gid, numbers), checkpointed: of each of texts (id, text) with lines that go, their numbers, ascending."""
    _, equal, removed = _repeated(texts, similarity)
    found = common.cut(_gone(equal, removed).groupBy("gid").agg(F.array_sort(F.collect_list("gline")).alias("numbers")))
    del equal, removed
    common.release(texts.sparkSession)  # what comes next may move the texts
    return found


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with the repeated lines taken out of the text; all rows and columns stay."""
    keyed, texts = _texts(docs, id_col, text_col)
    joined = keyed.join(_numbers(texts, similarity), F.col("key") == F.col("gid"), "left").withColumn("t", F.col("row")[text_col])
    kept = F.expr("if(numbers is null, t, array_join(filter(split(t, '\\n'), (x, i) -> not array_contains(numbers, i)), '\\n'))")
    return joined.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines it has, how many go, and their numbers."""
    keyed, texts = _texts(common.read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    n_lines = F.size(F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n")).cast("long")
    # lines are counted before the join, which then moves no text
    counted = keyed.select("key", F.col("row.doc_id").alias("doc_id"), n_lines.alias("n_lines"))
    found = counted.join(_numbers(texts, SIMILARITY), F.col("key") == F.col("gid"), "left")
    told = F.coalesce(F.array_join(F.transform("numbers", lambda x: x.cast("string")), ","), F.lit(""))
    return found.select("doc_id", "n_lines", F.coalesce(F.size("numbers"), F.lit(0)).cast("long").alias("n_removed"), told.alias("removed_lines"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(t[i], '[ \t\x0B\f\r]+'), lambda x: x <> ''))) AS w
  FROM (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents) y) z),
f AS (SELECT *, len(w) AS n, row_number() OVER (PARTITION BY w ORDER BY doc_id, line_no) AS r FROM l),
c AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS cid, doc_id, line_no, w, n FROM f WHERE r = 1 AND n > 0),
t AS (SELECT cid, n, unnest(w) AS x FROM c),
df AS (SELECT x, count(*) AS k FROM t GROUP BY x),
p AS (SELECT * FROM (SELECT t.cid, t.n, t.x, row_number() OVER (PARTITION BY t.cid ORDER BY df.k, t.x) AS pos FROM t JOIN df USING (x)) q WHERE pos <= n - ceil(0.8 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.cid AS a, b.cid AS b FROM p a JOIN p b ON a.x = b.x AND a.cid < b.cid AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
sim AS (
  SELECT DISTINCT c2.doc_id, c2.line_no FROM cand JOIN c c1 ON c1.cid = cand.a JOIN c c2 ON c2.cid = cand.b
  WHERE len(list_intersect(c1.w, c2.w)) >= 0.8 * (c1.n + c2.n - len(list_intersect(c1.w, c2.w))) - 1e-9),
heads AS (SELECT c.w, s.doc_id IS NOT NULL AS similar FROM c LEFT JOIN sim s ON c.doc_id = s.doc_id AND c.line_no = s.line_no),
g AS (SELECT f.doc_id, f.line_no, f.n > 0 AND (f.r > 1 OR heads.similar) AS gone FROM f LEFT JOIN heads ON f.w = heads.w)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       coalesce(string_agg(CASE WHEN gone THEN CAST(line_no AS VARCHAR) END, ',' ORDER BY line_no), '') AS removed_lines
FROM g GROUP BY doc_id
"""
