"""Near-dedup by Order MinHash, verified by banded alignment.

A text is its sequence of lower-cased words. Every run of five words is a k-mer, labelled with its occurrence
number so that repeats count. For each of 24 hash functions the two smallest labelled k-mers are taken and put
back into text order; that ordered pair is one band, so both shared content and its order make texts meet.
A pair at the threshold shares few k-mers and may miss all those bands, so the smallest run of four words under
each hash function is a band of a second family.

Texts of equal words are one member from the start. The members of a band's bucket are compared with the smallest
one first; a pair is a link if the banded edit distance of the word sequences is at most a fifth of the longer one
(similarity of 0.8 or more). Then every pair of a bucket whose members still lie in two components is decided.

Before a pair's words are fetched, it must pass a filter that no two similar texts fail: each member has a bitmap of its
words with their occurrence numbers, two to four cells for each word, and the common bits (and what lies third or later
in a cell) bound the words that two texts share. Buckets of more than 16 members are compared by these bitmaps as blocks, each a
matrix product over members in order of length within one task, and only pairs that pass become rows. So no link within a bucket is
lost, and a frequent passage does not make its bucket emit its square; what grows with the square is the product of bits.
Where many pairs pass, those of each member's most similar partner are verified first, and then only pairs that still
lie in two components.

Results for the unusual cases: null, blank and word-less texts are equal to each other; texts of under five words
are one k-mer; of every class the smallest doc_id stays; rows that repeat a doc_id are one document; an empty
table gives an empty result; a null doc_id is its own class, is kept, and takes no part; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

KGRAM = 5
SKETCHES = 24
#: Words of a run in the second family of bands.
SHORT_KGRAM = 4
SIMILARITY = 0.8
#: Members of one bucket whose pairs are listed one by one; larger buckets are compared as blocks.
ALL_PAIRS = 16
#: Members in a block's side at most, about; a task compares two sides.
SLICE = 16_384
#: Cells of a bitmap, two bits each: the power of two from twice the words, within these.
FEWEST_BITS, MOST_BITS = 512, 1 << 17
#: Cells of a bit matrix that is unpacked at once.
UNPACKED = 1 << 21
#: Bytes of words that are broadcast at most, for many pairs of few texts.
BROADCAST_BYTES = 1 << 23
#: Bytes of pairs' words that are shuffled at once, about; or twice the words themselves, if these are more.
AT_ONCE = 1 << 28
#: Pairs above which those of each member's most similar partner are verified first; they only save work.
MANY_PAIRS = 10_000
#: Such rounds before all pairs left are verified.
ROUNDS = 1
#: Keys that are broadcast at most; each broadcast passes through the driver.
BROADCAST_KEYS = 200_000
#: Hash cells of the counts that order words by rarity, as a power of two; any order is exact.
CELL_BITS = 20
#: Rare runs of words that two texts must share to be verified, fewer only where a text is shorter; prefixes grow by as many.
SHARED = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as texts so far have needed them."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            size = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(_BASE, size, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(_INVERSE, size, 1 << 64))])
        return cls.up[:n], cls.down[:n]


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(_TABLE)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums over the whole text."""
    b = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate([[False], b != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _Powers.upto(len(b))
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def labelled(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words and its occurrence number."""
    n = len(words) - k + 1
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x5851F42D4C957F2D) + words[j : j + n]
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(n)
    occurrence = np.empty(n, dtype=np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return _mix(grams + occurrence * _ODD)


def sketch(words: np.ndarray, kgram: int = KGRAM, sketches: int = SKETCHES) -> np.ndarray:
    """One band key per hash function."""
    if not len(words):
        return np.empty(0, dtype=np.int64)
    labels = labelled(words, min(kgram, len(words)))
    n = len(labels)
    low, high = np.zeros(sketches, dtype=np.int64), np.zeros(sketches, dtype=np.int64)
    seeds = _seeds(sketches)
    for i in range(sketches):
        drawn = labels * seeds[i]
        drawn ^= drawn >> np.uint64(32)
        drawn *= _ODD
        one = two = int(drawn.argmin())
        if n > 1:
            drawn[one] = np.uint64(0xFFFFFFFFFFFFFFFF)
            two = int(drawn.argmin())
        low[i], high[i] = min(one, two), max(one, two)
    return _mix(labels[low] * np.uint64(0xD6E8FEB86659FD93) + labels[high] + seeds).view(np.int64)


def minima(words: np.ndarray, kgram: int = SHORT_KGRAM, sketches: int = SKETCHES) -> np.ndarray:
    """The second family: one band key per hash function, of its smallest labelled k-mer alone."""
    if not len(words):
        return np.empty(0, dtype=np.int64)
    labels, seeds = labelled(words, min(kgram, len(words))), _seeds(2 * sketches)[sketches:]
    out = np.empty(sketches, dtype=np.uint64)
    for i in range(sketches):
        drawn = labels * seeds[i]
        drawn ^= drawn >> np.uint64(32)
        drawn *= _ODD
        out[i] = labels[drawn.argmin()]
    return _mix(out + seeds).view(np.int64)


def bands(words: np.ndarray) -> list[int]:
    return sketch(words).tolist() + minima(words).tolist()


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else most + 1.

    Only the diagonals within ``most`` of the main one are computed, as bit vectors that slide along the band.
    """
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_a and start < end_b and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    most_here = min(most, len(a))
    width = 2 * most_here + 2
    ones = (1 << width) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    plus, minus = (ones << (width - most_here - 1)) & ones, 0
    distance, corner = most_here, 1 << (width - 1)
    bottom = 1 << (width - 2)
    for j, x in enumerate(b):
        shift = j + most_here + 1 - width
        match = where.get(x, 0)
        match = (match << -shift) & ones if shift < 0 else (match >> shift) & ones
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & ones
        across_plus = minus | (ones & ~(diagonal | plus))
        across_minus = diagonal & plus
        if j < len(a) - most_here:
            distance += not diagonal & corner
        else:
            distance += bool(across_plus & bottom) - bool(across_minus & bottom)
            bottom >>= 1
        plus = across_minus | (ones & ~((diagonal >> 1) | across_plus))
        minus = (diagonal >> 1) & across_plus
        if distance > 2 * most_here + len(b) - len(a):
            return most + 1
    return min(distance, most + 1)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    most = int((1 - similarity) * longest + 1e-9)
    _, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if np.minimum(np.bincount(at[: len(a)], minlength=len(at)), np.bincount(at[len(a) :], minlength=len(at))).sum() < longest - most:
        return False  # each word of the longer one that the other lacks is an edit
    return banded_distance(a.tolist(), b.tolist(), most) <= most


def bitmap(words: np.ndarray) -> bytes:
    """Which cells hold a word, then which hold two or more; a word with its occurrence number lies in its hash modulo
    their number."""
    size = min(MOST_BITS, max(FEWEST_BITS, 1 << max(0, 2 * len(words) - 1).bit_length()))
    held = np.zeros(size, dtype=np.int64)
    if len(words):
        held = np.bincount((labelled(words, 1) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(np.concatenate([held >= 1, held >= 2])).tobytes()


def _unpacked(bitmaps: list[bytes], size: int) -> np.ndarray:
    """The bitmaps as rows of twice ``size`` bits; longer ones are folded, which is taking the hash modulo fewer cells."""
    out = np.empty((len(bitmaps), 2 * size), dtype=np.uint8)
    for i, packed in enumerate(bitmaps):
        bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8))
        if len(bits) > 2 * size:
            held = bits.reshape(-1, size).sum(axis=0)
            bits = np.concatenate([held >= 1, held >= 2])
        out[i] = bits
    return out


def needed(n: np.ndarray, similarity: float) -> np.ndarray:
    """Words that a text of n words shares with any similar one of at most n."""
    return n - ((1 - similarity) * n + 1e-9).astype(np.int64)


def margin(n: np.ndarray, bits: list[bytes], m: np.ndarray, others: list[bytes], similarity: float) -> np.ndarray:
    """For each pair of texts of n and m words with these bitmaps, the most words that they can share above those needed:
    under 0 only if they cannot be similar."""
    out = np.zeros(len(n), dtype=np.int32)
    sizes = np.array([min(len(x), len(y)) * 4 for x, y in zip(bits, others, strict=True)], dtype=np.int64)
    for size in np.unique(sizes):
        chosen = np.flatnonzero(sizes == size)
        step = max(16, UNPACKED // int(size))
        for low in range(0, len(chosen), step):
            at = chosen[low : low + step]
            one, two = _unpacked([bits[i] for i in at], int(size)), _unpacked([others[i] for i in at], int(size))
            spare = np.minimum(n[at] - one.sum(axis=1, dtype=np.int64), m[at] - two.sum(axis=1, dtype=np.int64))
            out[at] = (one & two).sum(axis=1, dtype=np.int64) + spare - needed(np.maximum(n[at], m[at]), similarity)
    return out


def block_pairs(ids: np.ndarray, roots: np.ndarray, n: np.ndarray, bits: list[bytes], sides: np.ndarray | None, similarity: float, keys: np.ndarray | None = None, key: int = 0) -> tuple[np.ndarray, ...]:
    """The pairs (smaller id, larger id, margin) of a block that may be similar and have two roots; with sides given, also two
    sides; with each member's bands in keys, only pairs whose first common band is this bucket's key, as the other buckets
    that they share have them otherwise. Members go in order of length: each is compared with those that are longer, but
    short enough."""
    order = np.argsort(n, kind="stable")
    ids, roots, n, bits = ids[order], roots[order], n[order], [bits[i] for i in order]
    sides, keys = None if sides is None else sides[order], None if keys is None else keys[order]
    sizes = np.array([len(x) * 4 for x in bits], dtype=np.int64)
    need, found = needed(n, similarity), [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32))]
    low = 0
    while low < len(n):
        size = int(sizes[low])
        step = max(16, UNPACKED // size)
        high = min(low + min(step, 512), int(np.searchsorted(sizes, size, "right")))
        last = int(np.searchsorted(need, n[high - 1], "right"))
        if (roots[low:last] != roots[low]).any():
            rows = _unpacked(bits[low:high], size).astype(np.float32)
            spare = n[low:high] - rows.sum(axis=1).astype(np.int64)
            for start in range(low, last, step):
                end = min(start + step, last)
                columns = _unpacked(bits[start:end], size).astype(np.float32)
                least = need[start:end] - np.minimum(spare[:, None], (n[start:end] - columns.sum(axis=1).astype(np.int64))[None, :])
                above = rows @ columns.T - least
                x, y = np.nonzero(above >= 0)
                above, x, y = above[x, y].astype(np.int32), x + low, y + start
                keep = (x < y) & (roots[x] != roots[y]) & (ids[x] != ids[y])
                if sides is not None:
                    keep &= sides[x] != sides[y]
                above, x, y = above[keep], x[keep], y[keep]
                for part in range(0, len(x), 16_384):
                    p, q, a = (v[part : part + 16_384] for v in (x, y, above))
                    if keys is not None:
                        here = keys[p, (keys[p] == keys[q]).argmax(axis=1)] == key
                        p, q, a = p[here], q[here], a[here]
                    found.append((np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), a))
        low = high
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column(0), []
        for text in batch.column(1):
            data = normal(text.as_py())
            words = word_hashes(data)
            rows.append((hashlib.blake2b(b" ".join(data.split()), digest_size=16).digest(), len(words), bands(words), bitmap(words >> np.uint64(32))))
        kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], ["id", "same", "n_words", "keys", "bits"])


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [(word_hashes(normal(t.as_py())) >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["id", "words"])


def _verifier(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), dtype=np.uint32), np.frombuffer(y.as_py(), dtype=np.uint32), similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _matched(df: DataFrame, keys: DataFrame, on, how: str) -> DataFrame:
    return common.matched(df, keys, on, how, BROADCAST_KEYS)


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose bitmaps in sketches (id, n, bits, keys) allow that they are similar, with their margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            above = margin(n, batch.column(3).to_pylist(), m, batch.column(5).to_pylist(), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(above)], ["a", "b", "above"]).filter(pa.array(above >= 0))

    one, two = (sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "bitsa", "nb", "bitsb").mapInArrow(run, "a long, b long, above int")


def _verify(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The similar ones of the checkpointed pairs (a, b) of docs (id, text); their words are shuffled for a bounded number of
    pairs at a time. An id that several texts have is similar if one of them is."""
    wanted = common.cut(pairs.select(F.col("a").alias("want")).distinct().unionByName(pairs.select(F.col("b").alias("want")).distinct()).distinct())
    words = common.cut(_matched(docs, wanted, F.col("id") == F.col("want"), "left_semi").mapInArrow(_hash_rows, "id long, words binary"))
    rows, volume = words.agg(F.count("*"), F.sum(F.length("words"))).first()
    if rows > wanted.count():
        words = common.cut(words.distinct())
    n, volume, found = pairs.count(), volume or 0, None
    few = volume <= BROADCAST_BYTES
    passes = 1 if few else math.ceil(n * volume / rows / max(AT_ONCE, 2 * volume))
    if few:  # no shuffle of words would spread the pairs
        pairs = pairs.repartition(max(1, min(200, n // 500)), "a", "b")
    for number in range(passes):
        one, two = words.select(F.col("id").alias("a"), F.col("words").alias("wa")), words.select(F.col("id").alias("b"), F.col("words").alias("wb"))
        part = pairs if passes == 1 else pairs.where(f"pmod(hash(a, b), {passes}) = {number}")
        one, two = (F.broadcast(one), F.broadcast(two)) if few else (one, two)
        part = common.cut(part.join(one, "a").join(two, "b").select("a", "b", "wa", "wb").mapInArrow(_verifier(similarity), "a long, b long"))
        found = part if found is None else found.unionByName(part)
        del part, one, two
        common.release(pairs.sparkSession)
    return found


def run_words(similarity: float) -> int:
    """Words of a run in the prefix filter: pairs, or single words where similar texts need not share any pair."""
    return 2 if similarity >= 0.75 else 1


def least_shared(n: int, similarity: float) -> int:
    """Runs (with their occurrence numbers) that a text of n words shares at least with any similar one of other words:
    each edit takes at most as many runs from the longer text as a run has words."""
    k = run_words(similarity)
    return max(1, math.ceil((1 - k * (1 - similarity)) * n - k + 1 - 1e-6))


def prefix(words: np.ndarray, levels: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The rarest labelled runs of a text, as many as make any similar text share the returned number of them; runs
    are ordered by their rarest word, and those of a word that no other text has are left out."""
    k = run_words(similarity)
    if len(words) < k:
        return np.empty(0, dtype=np.uint64), 0
    labels, shared = labelled(words, k), least_shared(len(words), similarity)
    wanted, own = min(SHARED, shared), levels[_mix(words) >> np.uint64(64 - CELL_BITS)]
    rarest = own if k == 1 else np.minimum(own[:-1], own[1:])
    order = np.lexsort((labels, rarest))[: max(0, len(labels) - shared + wanted)]
    return labels[order[rarest[order] != 1]], wanted


def _blocks(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        ids, roots, n, sides, i, j = (table[c].to_numpy() for c in ("rep", "root", "n", "side", "i", "j"))
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        one, two, above = block_pairs(ids, roots, n.astype(np.int64), table["bits"].to_pylist(), None if i[0] == j[0] else sides, similarity, keys, table["key"][0].as_py())
        return pa.table({"a": one, "b": two, "above": above})

    return run


def _undecided(met: DataFrame, roots: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b, above): the pairs in the buckets met (key, rep, n_words) that may be similar and lie in two components."""
    placed = _matched(met, roots, F.col("rep") == F.col("v"), "left").select("key", "rep", "n_words", F.coalesce("root", "rep").alias("root"))
    split = common.cut(placed.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"), "c"))
    left = common.cut(_matched(placed, split, F.col("key") == F.col("k"), "inner").select("key", "rep", "n_words", "root", "c"))
    small = left.where(f"c <= {ALL_PAIRS}").groupBy("key").agg(F.collect_list(F.struct("rep", "n_words", "root")).alias("g"))
    pairs = small.select(F.explode(F.expr("flatten(transform(g, x -> transform(filter(g, y -> x.rep < y.rep and x.root <> y.root), y -> struct(x.rep as a, x.n_words as na, y.rep as b, y.n_words as nb))))")).alias("p")).select("p.*")
    pairs = common.cut(pairs.where(f"least(na, nb) >= {similarity!r}D * greatest(na, nb) - 1e-6D").select("a", "b").distinct())
    # a large bucket is dealt into slices, and each two slices (or one with itself) are a block
    sliced = left.where(f"c > {ALL_PAIRS}").withColumn("s", F.expr(f"cast(ceil(c / {SLICE}) as int)")).withColumn("side", F.expr("cast(pmod(xxhash64(rep), s) as int)"))
    sliced = sliced.join(sketches, F.col("rep") == F.col("id")).select("key", "rep", "root", "n", "bits", "keys", "side", F.explode(F.expr("sequence(0, s - 1)")).alias("o"))
    blocks = sliced.select("key", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "rep", "root", "n", "bits", "keys", "side")
    wide = blocks.groupBy("key", "i", "j").applyInArrow(_blocks(similarity), "a long, b long, above int")
    return _likely(pairs, sketches, similarity).unionByName(wide).groupBy("a", "b").agg(F.max("above").alias("above"))


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """roots (v, root) after the links found: these join whole components and are contracted to their roots first."""
    ra, rb = roots.select(F.col("v").alias("va"), F.col("root").alias("ra")), roots.select(F.col("v").alias("vb"), F.col("root").alias("rb"))
    lifted = _matched(_matched(found, ra, F.col("a") == F.col("va"), "left"), rb, F.col("b") == F.col("vb"), "left")
    over = components(lifted.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).select(F.col("v").alias("ov"), F.col("root").alias("oroot"))
    merged = _matched(roots, over, F.col("root") == F.col("ov"), "left").select("v", F.coalesce("oroot", "root").alias("root"))
    fresh = over.join(roots, F.col("ov") == F.col("v"), "left_anti").select(F.col("ov").alias("v"), F.col("oroot").alias("root"))
    return common.cut(merged.unionByName(fresh))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of df: id, class_id (smallest id of its class), kept."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = common.cut(docs.where("id is not null").mapInArrow(_sketch_rows, "id long, same binary, n_words long, keys array<long>, bits binary"))
    copies = common.cut(sketched.groupBy(F.col("same").alias("copy")).agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("copy", "rep"))
    held = _matched(sketched, copies, F.col("same") == F.col("copy"), "left").where("rep is null or id = rep")
    alone = held.where("rep is null").select("id", "n_words", "keys", "bits")
    leads = held.where("rep is not null").groupBy("same").agg(F.min("id").alias("id"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"), F.first("bits").alias("bits")).drop("same")
    members = common.cut(alone.unionByName(leads))
    sketches = members.select("id", F.col("n_words").alias("n"), "bits", "keys")
    # one exchange, which the buckets and their members both read
    banded = members.select(F.col("id").alias("rep"), "n_words", F.explode("keys").alias("key")).repartition("key")
    buckets = banded.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("c"), F.min(F.struct("rep", "n_words")).alias("lead")).where("c > 1").select("k", F.col("lead.rep").alias("lead"), F.col("lead.n_words").alias("lead_words"))
    shared = common.cut(banded.join(buckets, F.col("key") == F.col("k")).select("key", "rep", "n_words", "lead", "lead_words"))
    del banded, buckets
    common.release(df.sparkSession)
    near = f"rep <> lead and least(n_words, lead_words) >= {similarity!r}D * greatest(n_words, lead_words) - 1e-6D"
    stars = shared.where(near).select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    tried = common.cut(_likely(stars, sketches, similarity).select("a", "b"))
    common.release(df.sparkSession)
    roots = components(_verify(tried, docs, similarity))
    common.release(df.sparkSession)
    fresh = common.cut(_undecided(shared.select("key", "rep", "n_words"), roots, sketches, similarity).join(tried, ["a", "b"], "left_anti"))
    common.release(df.sparkSession)
    for number in range(ROUNDS + 1):
        n = fresh.count()
        if not n:
            break
        if last := number == ROUNDS or n <= MANY_PAIRS:
            now = fresh.select("a", "b")
        else:
            best = [fresh.groupBy(x).agg(F.max_by(y, F.struct("above", y)).alias(y)).select("a", "b") for x, y in ("ab", "ba")]
            now = common.cut(best[0].unionByName(best[1]).distinct())
        found = common.cut(_verify(now, docs, similarity))
        if not found.isEmpty():
            roots = _merged(roots, found)
        if last:
            break
        ra, rb = roots.select(F.col("v").alias("va"), F.col("root").alias("ra")), roots.select(F.col("v").alias("vb"), F.col("root").alias("rb"))
        left = _matched(_matched(fresh.join(now, ["a", "b"], "left_anti"), ra, F.col("a") == F.col("va"), "left"), rb, F.col("b") == F.col("vb"), "left")
        fresh = common.cut(left.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b", "above"))
    common.release(df.sparkSession)
    out = _matched(sketched.select("id", "same"), copies, F.col("same") == F.col("copy"), "left").select("id", F.coalesce("rep", "id").alias("rep"))
    out = _matched(out, roots, F.col("rep") == F.col("v"), "left").select("id", F.coalesce("root", "rep").alias("class_id"))
    out = out.select("id", "class_id", F.expr("id = class_id").alias("kept"))
    alone = docs.where("id is null").select("id", F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone).withColumnRenamed("id", id_col)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df that stay, with all their columns."""
    found = classes(df, id_col, text_col, similarity)
    stay = common.drop_ids(df, found.where("not kept").select(id_col), id_col)
    repeated = found.where("kept").groupBy(id_col).count().where(f"count > 1 and `{id_col}` is not null").isEmpty()
    return stay if repeated else common.one_per_text(stay, id_col, text_col)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.read(spark, sf_dir, "documents"))
