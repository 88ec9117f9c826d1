"""The operators against brute force and on the unusual cases: nulls, empty and long texts, ties, repeated rows,
empty tables and clashing column names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwell.llm import chat, decontaminate, exact_dedup, line_dedup, mixing, near_dedup, quality, sharding, url_rules, warc
from chunkwell.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(7)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(3, 8))) for _ in range(4000)]


def prose(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls, blanks, repeats, a very long text, and columns named as the operators' own."""
    r = random.Random(3)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "x", "b"), (4, "x", "b"), (5, prose(r, 30000), "a"), (6, "été\u00a0où 😀 <|im_end|>", "c"), (None, "x", "a"), (7, "\n\n\n", "a")]
    return docs_of(spark, rows).withColumn("id", F.lit("clash")).withColumn("sha", F.lit(1)).withColumn("__copies", F.lit(9)).withColumn("a.b", F.lit(2))


def empty(df):
    return df.where("false")


# ---- exact dedup


def test_exact_dedup_cases(messy):
    rows = exact_dedup.exact_dedup(messy).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[1].keep_id == by[2].keep_id == by[3].keep_id == by[7].keep_id == 3 and by[1].group_size == 4  # the longest stays
    assert by[4].keep_id == 4 and by[4].group_size == 3 and by[None].keep_id == 4 and not by[None].kept
    assert by[5].kept and by[5].group_size == 1
    assert by[2].text_sha256 == hashlib.sha256(b"").hexdigest()
    kept = exact_dedup.deduplicate(messy).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [3, 4, 5, 6]
    assert exact_dedup.exact_dedup(empty(messy)).count() == 0


def test_exact_dedup_slices_agree(spark):
    r = random.Random(1)
    texts = [prose(r, 3) for _ in range(300)]
    df = docs_of(spark, [(i, r.choice(texts), "s") for i in range(900)])
    whole = {tuple(x) for x in exact_dedup.exact_dedup(df).collect()}
    assert whole == {tuple(x) for x in exact_dedup.exact_dedup(df, max_slice_bits=1 << 12).collect()}


# ---- near dedup


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 8))
def test_banded_distance_is_the_edit_distance_within_its_band(a, b, most):
    assert near_dedup.banded_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def test_near_dedup_against_brute_force(spark):
    r = random.Random(5)
    texts = [prose(r, r.randint(40, 200)) for _ in range(60)]
    for t in list(texts[:20]):
        for _ in range(r.randint(1, 6)):
            words = t.split()
            for _ in range(max(1, len(words) // 50)):
                words[r.randrange(len(words))] = r.choice(VOCAB)
            texts.append(" ".join(words))
    texts += texts[:5]
    r.shuffle(texts)
    found = {x.doc_id: x.class_id for x in near_dedup.classes(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    words = [near_dedup.word_hashes(near_dedup.normal(t)) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.similar(words[i], words[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert found == {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("operator", [exact_dedup, near_dedup])
def test_dedup_keeps_null_ids_and_clashing_texts(spark, operator):
    r = random.Random(24)
    texts = [prose(r, 40) for _ in range(4)]
    rows = [(None, texts[0], "s"), (None, texts[1], "s"), (1, texts[2], "s"), (1, texts[3], "s"), (2, "x", "s"), (2, "x", "s")]
    out = operator.deduplicate(docs_of(spark, rows))
    assert sorted(x.text for x in out.collect()) == sorted([*texts, "x"])


def near_classes(spark, texts):
    return len({x.class_id for x in near_dedup.classes(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()})


def all_pairs_classes(texts):
    words = [near_dedup.word_hashes(near_dedup.normal(t)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and near_dedup.similar(words[i], words[j]):
                root = [root[j] if x == root[i] else x for x in root]
    return len(set(root))


def edited(r, text, share):
    words = text.split()
    for at in r.sample(range(len(words)), round(share * len(words))):
        words[at] = r.choice(VOCAB)
    return " ".join(words)


def test_near_dedup_pairs_with_one_shared_passage(spark):
    r = random.Random(21)
    passage, texts = prose(r, 150), []
    for _ in range(100):
        text = passage + " " + prose(r, 50)
        texts += [text, edited(r, text, 0.1)]
    order = r.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    assert near_classes(spark, texts) == all_pairs_classes(texts)


def test_near_dedup_chains_that_drift(spark):
    r, rows = random.Random(22), []
    for group in range(12):
        chain = [prose(r, 300).split()]
        for step in range(3):
            chain.append(chain[-1][: 33 * step] + prose(r, 33).split() + chain[-1][33 * step + 33 :])
        # the ends have the smallest ids of every bucket, only the middle links the halves
        rows += [(4 * group + i, " ".join(chain[at]), "s") for i, at in enumerate((0, 3, 1, 2))]
    found = {x.doc_id: x.class_id for x in near_dedup.classes(docs_of(spark, rows)).collect()}
    assert found == {i: i // 4 * 4 for i in range(48)}


def test_near_dedup_finds_pairs_at_the_threshold(spark):
    r, rows = random.Random(23), []
    for i in range(60):
        text = prose(r, (50, 200, 500)[i % 3])
        rows += [(2 * i, text, "s"), (2 * i + 1, edited(r, text, (0.15, 0.18, 0.2)[i // 3 % 3]), "s")]
    found = {x.doc_id: x.class_id for x in near_dedup.classes(docs_of(spark, rows)).collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in range(60)) >= 59


def test_prefixes_of_similar_texts_meet():
    r, counts = random.Random(5), np.zeros(1 << near_dedup.CELL_BITS, dtype=np.int64)
    for n in [2, 3, 4, 5, 6, 9, 10, 11, 40, 200] * 20:
        text = prose(r, n)
        other = edited(r, text, 0.2 * r.random()).split()
        for _ in range(r.randint(0, n // 10)):
            other.insert(r.randint(0, len(other)), r.choice(VOCAB))
        one, two = (near_dedup.word_hashes(near_dedup.normal(t)) for t in (text, " ".join(other)))
        if near_dedup.similar(one, two):
            (a, c), (b, d) = near_dedup.prefix(one, counts, 0.8), near_dedup.prefix(two, counts, 0.8)
            assert len(set(a.tolist()) & set(b.tolist())) >= min(c, d) >= 1


def test_near_dedup_cases(messy):
    rows = {r.doc_id: r for r in near_dedup.classes(messy).collect()}
    assert len(rows) == 8
    assert {rows[i].class_id for i in (1, 2, 3, 7)} == {1}
    assert rows[None].kept and rows[4].kept and rows[5].kept
    out = near_dedup.deduplicate(messy)
    assert out.columns == messy.columns
    assert Counter(r.doc_id for r in out.select("doc_id").collect())[4] == 1
    assert near_dedup.classes(empty(messy)).count() == 0


def test_large_groups_are_stars_not_squares(spark):
    r = random.Random(9)
    base = prose(r, 120).split()
    rows = []
    for i in range(400):
        words = list(base)
        words[i % 120] = VOCAB[i]
        rows.append((i, " ".join(words), "s"))
    assert {x.class_id for x in near_dedup.classes(docs_of(spark, rows)).collect()} == {0}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    found = {x.v: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for v in found:
        seen, todo = {v}, [v]
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        assert found[v] == min(seen)
    assert set(found) == set(near)


# ---- URL rules


def test_host_and_path_rules(spark):
    urls = [None, "no scheme", "http://A.Example.COM/en/x?y", "https://www.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://xnet/es/", "http://b.com", "http://b.com/q#f", "x://É.com:8/p"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in url_rules.judge(df, df.where("false").select("url", F.lit(True).alias("bad"))).collect()}
    assert (out[0].host, out[0].path, out[0].rule, out[0].verdict) == ("", "", None, "allow")
    assert (out[2].host, out[2].path, out[2].rule, out[2].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert (out[3].rule, out[3].verdict) == ("www.example.com/en/", "allow")
    assert (out[4].rule, out[5].rule, out[6].rule) == ("net/es/", "net/fr/", None)
    assert out[7].rule is None and out[8].rule == "com/" and out[9].host == "É.com:8"


def test_mined_rules_decide(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        bad_host, shop = r.random() < 0.3, r.random() < 0.5
        rows.append((i, f"http://{'spam' if bad_host else 'good'}{r.randint(0, 3)}.{'spam' if bad_host else 'fine'}.org/{'shop' if shop else 'news'}/{i}", bad_host and shop))
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    rules = url_rules.mine(df)
    found = {tuple(x.tokens): x for x in rules.where("label = 'block'").collect()}
    assert found[("h:spam", "p:shop")].confidence == 1.0
    out = url_rules.judge(df.select("page_id", "url"), df.select("url", "bad"), rules=()).collect()
    told = {x.page_id: x.verdict for x in out}
    assert all(told[i] == ("block" if bad else "allow") for i, _, bad in rows)
    # the same rules by counting all token sets
    counts, bad_counts = Counter(), Counter()
    from itertools import combinations

    for _, url, bad in rows:
        host, path = url.split("//")[1].split("/")[0], url.split("//")[1].split("/")[1:]
        tokens = sorted({f"h:{x}" for x in host.split(".")} | {"p:" + ("#" if x.isdigit() else x) for x in path})
        for k in range(1, len(tokens) + 1):
            for c in combinations(tokens, k):
                counts[c] += 1
                bad_counts[c] += bad
    want = {c for c in counts if bad_counts[c] >= url_rules.MIN_SUPPORT * 600 and bad_counts[c] / counts[c] >= url_rules.MIN_CONFIDENCE}
    assert set(found) == want


# ---- quality


def test_quality_on_held_out_labels(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(800):
        good = r.random() < 0.7
        text = prose(r, r.randint(20, 80))
        rows.append((i, text if good else " ".join(w + r.choice(["%%%", "$$$"]) for w in text.split()), f"s{i % 5}"))
        if i % 2:
            labels.append((i, int(good)))
    truth = dict((i, "%%%" not in t and "$$$" not in t) for i, t, _ in rows)
    df, lab = docs_of(spark, rows), spark.createDataFrame(labels + [(None, 1), (1, None), (99999, 0)], "doc_id long, quality int")
    out = quality.score_documents(df, lab).collect()
    assert sum(x.kept == truth[x.doc_id] for x in out if x.doc_id % 2 == 0) >= 396
    assert quality.filter_quality(df, lab).columns == df.columns
    assert all(x.kept and x.score is None for x in quality.score_documents(df, lab.where("false")).collect())
    assert quality.score_documents(empty(df), lab).count() == 0


def test_quality_cases(spark, messy):
    r = random.Random(8)
    base = docs_of(spark, [(100 + i, prose(r, 30) if i % 2 else "!! " * 40, "s") for i in range(200)])
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality.train(base, labels)
    assert messy.select(quality.scores(messy, model)["score"].alias("s")).where("s is null").count() == 0


# ---- decontamination


def brute_windows(text, items):
    words = lambda t: __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_against_brute_force(spark):
    r = random.Random(11)
    items = [(i, prose(r, r.choice([1, 2, 4, 5, 7, 9, 10, 11, 30]))) for i in range(40)] + [(40, None), (41, " .,"), (2, "a second text of item two"), (43, " ".join(["tick"] * 14))]
    rows = []
    for i in range(150):
        words = prose(r, r.randint(0, 80)).split()
        for _ in range(r.randint(0, 3)):
            b = (r.choice(items)[1] or "").split()
            low = r.randint(0, max(0, len(b) - 1))
            at = r.randint(0, len(words))
            words[at:at] = b[low : low + r.randint(1, 30)] if r.random() < 0.5 else b
        rows.append((i, r.choice([", ", " ", "\n"]).join(words).upper() if i % 3 else " ".join(words), "s"))
    rows += [(200, "Été " + items[20][1], "s"), (201, None, "s"), (201, items[3][1], "s"), (202, "", "s"), (203, " ".join(["tick"] * 40), "s")]
    out = decontaminate.decontaminate(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).drop("hit_spans", "items").collect()
    got = sorted((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256) for x in out)
    assert got == sorted((i, *brute_windows(t, items)) for i, t, _ in rows)
    assert all(x.contaminated == (x.n_hit > 0) for x in out)


def test_decontamination_cases(spark, messy):
    items = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert decontaminate.decontaminate(messy, items).where("contaminated").count() == 0
    assert decontaminate.decontaminate(messy, empty(items)).count() == 9
    assert decontaminate.decontaminate(empty(messy), items).count() == 0
    assert decontaminate.clean(messy, spark.createDataFrame([(1, "X")], "item_id long, text string")).columns == messy.columns


# ---- sharding


def test_shards_are_even_and_mixed(spark):
    rows = [(i, "t" * (i % 9), "big" if i % 3 == 0 else f"s{i % 7}") for i in range(1000)] + [(5, "dup", "big"), (5, "dup", "big"), (None, None, None)]
    df = docs_of(spark, rows)
    out = sharding.shard(df).collect()
    assert len(out) == len(rows)
    sizes = Counter(x.shard for x in out)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(x.slot for x in out if x.shard == s) == list(range(sizes[s]))
        assert abs(sum(x.source == "big" for x in out if x.shard == s) - 336 / 24) <= 1.5
    by = {i: t for i, t, _ in rows}
    assert all(x.text_crc32 == zlib.crc32((by[x.doc_id] or "").encode()) and x.size == len((by[x.doc_id] or "").encode()) + 8 for x in out if x.doc_id != 5)
    again = sharding.shard(df.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sharding.shard(empty(df)).count() == 0


def test_shard_rows_keep_every_column(spark, messy):
    import corpus_pipeline

    out = corpus_pipeline.sharding_stage(spark, messy.unionByName(messy), "")
    assert out.columns == [*messy.columns, "shard", "slot"]
    rows = Counter(tuple(x)[:-2] for x in out.collect())
    assert rows == Counter({k: 2 * n for k, n in Counter(map(tuple, messy.collect())).items()})
    # rows that share an id keep their own texts
    twice = docs_of(spark, [(1, "a", "s"), (1, "b", "s"), (None, "c", "s"), (None, "d", None)])
    assert sorted(x.text for x in sharding.shard_rows(twice).collect()) == ["a", "b", "c", "d"]


def test_shards_against_a_plain_sort(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 40)
    rows = [(i, "x", f"s{i % 3 if i % 2 else 0}") for i in range(500)]
    out = sharding.shard(docs_of(spark, rows), shards=7).collect()
    draw = lambda i: hashlib.md5(f"{sharding.SEED}:{i}".encode()).hexdigest()
    places = []
    for s in {x[2] for x in rows}:
        own = sorted((draw(i), i) for i, _, z in rows if z == s)
        places += [((2 * k + 1) / (2 * len(own)), s, d, i) for k, (d, i) in enumerate(own)]
    order = {i: k for k, (_, _, _, i) in enumerate(sorted(places))}
    bounds = np.cumsum([0] + [500 // 7 + (k < 500 % 7) for k in range(7)])
    for x in out:
        k = int(np.searchsorted(bounds, order[x.doc_id], "right")) - 1
        assert (x.shard, x.slot) == (k, order[x.doc_id] - bounds[k])


# ---- line dedup


def test_null_item_ids_count_as_one_item(spark):
    item = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(None, item), (3, item)], "item_id long, text string")
    row = decontaminate.decontaminate(docs_of(spark, [(1, item, "s")]), items).first()
    assert (row.n_hit, row.n_items, row.items_sha256) == (12, 2, hashlib.sha256(b"3").hexdigest())


def test_a_budget_beyond_the_repetition_limit_is_an_error():
    assert mixing.solve([10, 90], 1.0, 1.0, 100) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        mixing.solve([10, 90], 1.0, 4.0, 500)


def test_clean_drops_rows_not_ids(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"x {item} y", "s"), (1, "clean text of the same id", "s"), (None, item, "s"), (None, "no id", "s"), (None, None, "s"), (2, "other", "s")]
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    kept = decontaminate.clean(docs_of(spark, rows).withColumn("key", F.lit("clash")), items).collect()
    assert sorted((x.doc_id or 0, x.text or "", x.key) for x in kept) == [(0, "", "clash"), (0, "no id", "clash"), (1, "clean text of the same id", "clash"), (2, "other", "clash")]


def test_line_dedup_against_brute_force(spark):
    r = random.Random(13)
    pool = [prose(r, r.choice([1, 3, 5, 8, 20, 40])) for _ in range(60)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randint(0, 8)):
            words = r.choice(pool).split()
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                words[r.randrange(len(words))] = r.choice(VOCAB)
            lines.append((" " * r.randint(1, 2)).join(words))
        rows.append((i, "\n".join(lines), "s"))
    rows += [(None, pool[0], "s"), (500, None, "s"), (501, "", "s")]
    df = docs_of(spark, rows)
    lines, _ = line_dedup.repeated_lines(df)
    found = lines.collect()
    own = dict(zip(sorted({x.id for x in found}), sorted(-1 if i is None else i for i, _, _ in rows), strict=True))  # a null id: rows are numbered
    got = {(None if own[x.id] < 0 else own[x.id], x.line_no): x.gone for x in found}
    every = sorted(((-1 if i is None else i, k, frozenset(x.split()), i) for i, t, _ in rows for k, x in enumerate((t or "").split("\n"))), key=lambda x: x[:2])
    for n, (_, k, words, i) in enumerate(every):
        want = any(words and w and 5 * len(words & w) >= 4 * len(words | w) for _, _, w, _ in every[:n])
        assert got[(i, k)] == want
    clean = {x.doc_id: x.text for x in line_dedup.remove_repeated_lines(df).collect()}
    assert all((clean[i] or "") == "\n".join(x for k, x in enumerate((t or "").split("\n")) if not got[(i, k)]) for i, t, _ in rows)
    assert line_dedup.repeated_lines(empty(df))[0].count() == 0


def test_line_dedup_at_other_similarities_and_with_repeated_ids(spark):
    r, rows = random.Random(5), [(None, "x y z w v"), (None, "x y z w v"), (1, "a b c d e f\n\nq"), (1, "fresh words alone here now"), (2, "a b c d\na b c"), (2, None)]
    base = [f"w{i}" for i in range(30)]
    for i in range(25):
        words = base[: r.randint(4, 30)]
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"n{r.randrange(40)}"
        rows.append((10 + i % 20, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(3)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256((x[1] or "").encode()).hexdigest()))
    every = [(i, k, set(x.split())) for i, (_, t) in enumerate(order) for k, x in enumerate((t or "").split("\n"))]
    for similarity in (0.6, 0.7, 0.9, 1.0):
        want = {(i, k) for n, (i, k, w) in enumerate(every) if w and any(u and len(u & w) >= similarity * len(u | w) - 1e-9 for _, _, u in every[:n])}
        found = line_dedup.repeated_lines(df, similarity=similarity)[0].collect()
        at = {x: n for n, x in enumerate(sorted({x.id for x in found}))}
        assert {(at[x.id], x.line_no) for x in found if x.gone} == want
    assert "fresh words alone here now" in {x.text for x in line_dedup.remove_repeated_lines(df).collect()}


def test_line_dedup_query_moves_no_text(spark, tmp_path):
    rows = [(1, "a b c d e f\n\nq", "x"), (2, None, "y"), (3, "f e d c b a\nfresh words\nq", "z"), (4, "a b c d e g f", "z")]
    for name, found in (("known", rows), ("repeated", [*rows, (None, "q\n\nnew", "x"), (4, "only here", "x")])):
        spark.createDataFrame(found, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = line_dedup.op7_line_dedup(spark, f"{tmp_path}/{name}")
        plan, seen = [got._jdf.queryExecution().optimizedPlan()], []
        while plan:
            node = plan.pop()
            below = [node.children().apply(i) for i in range(node.children().size())]
            plan += below
            if node.nodeName() == "Join":
                seen += [(x.output().apply(i).name(), x.output().apply(i).dataType().simpleString()) for x in below for i in range(x.output().size())]
        assert seen and not [x for x in seen if "string" in x[1]]  # neither the text nor a row with it reaches the join
        want = {1: (3, 0, ""), 2: (1, 0, ""), 3: (3, 2, "0,2"), 4: (1, 1, "0")} if name == "known" else None
        assert want is None or {x.doc_id: (x.n_lines, x.n_removed, x.removed_lines) for x in got.collect()} == want
        assert want or sorted(((x.doc_id or 0), x.n_lines, x.n_removed) for x in got.collect()) == [(0, 3, 0), (1, 3, 1), (2, 1, 0), (3, 3, 2), (4, 1, 0), (4, 1, 1)]


# ---- WARC


def test_warc_round_trip(spark):
    r = random.Random(15)
    big = "".join(r.choice("añ😀z") for _ in range(200_000))
    rows = [(1, "http://a/ b\r\n", "x\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "u", ""), (4, "u", big), (5, "v", big), (6, "w", "x\r\n\r\nWARC/1.1\r\n"), (7, "z", "once")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    table = warc.read_archives(warc.write_archives(warc.plan_records(pages), chunk_bytes=1000), chunk_bytes=777).collect()
    whole = defaultdict(bytes)
    for x in sorted(table, key=lambda x: (x.page_id, x.chunk_no)):
        whole[x.page_id] += bytes(x.chunk)
        sha = hashlib.sha1(whole[x.page_id]).digest()
        if x.record_type == "response":
            assert x.digest_so_far == __import__("base64").b32encode(sha).decode()
    last = {x.page_id: x for x in table if x.is_last}
    assert set(last) == {i for i, _, _ in rows}
    for i, _, html in rows:
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        assert last[i].payload_bytes == len((html or "").encode())
        assert (last[i].record_type, last[i].refers_to) == (("response", None) if first == i else ("revisit", first))
        assert whole[i] == ((html or "").encode() if first == i else b"")
    assert len([x for x in table if x.page_id == 4]) > 100
    assert warc.read_archives(warc.write_archives(warc.plan_records(empty(pages)))).count() == 0


# ---- chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb\\", ""]), st.text(alphabet="<|\\>im_startend \nxé😀", max_size=40)), max_size=5))
def test_chat_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_chat_masks_cover_exactly_the_learned_text(spark):
    r = random.Random(17)
    rows = []
    for c in range(40):
        for k in range(r.randint(1, 5)):
            rows.append((c, k, r.choice(["user", "assistant"]), "".join(r.choice(["<|", "im_end|>", " ", "é", "😀", "word", "\n", "\\"]) for _ in range(r.randint(0, 30)))))
    rows += [(None, 0, None, None), (99, None, "assistant", "x"), (99, 1, "assistant", None), (99, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_conversations(df).collect()
    want = defaultdict(list)
    for c, k, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    for x in out:
        assert chat.parse(x.formatted) == want[x.conv_id]
        assert "".join(chat.unescape(x.formatted[s.low : s.high]) for s in x.loss_spans) == "".join(t for role, t in want[x.conv_id] if role == "assistant")
        for s in x.loss_tokens:
            assert 0 <= s.low < s.high <= len(x.token_ids)
    assert chat.format_conversations(empty(df)).count() == 0


def test_align_clips_tokens_that_cross_a_turn():
    starts, ends = np.array([0, 3, 3, 5, 9]), np.array([3, 4, 5, 9, 12])
    tokens, chars = chat.align([(2, 4), (4, 4), (6, 11)], starts, ends)
    assert tokens == [(0, 3), (3, 5)] and chars == [(2, 4), (6, 11)]


# ---- mixing


def test_mixing_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    r = random.Random(19)
    sizes = {"big": 600, "mid": 200, "small": 60, None: 20}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, prose(r, r.randint(1, 20)), s))
            i += 1
    df = docs_of(spark, rows)
    table = {x.id: x.copies for x in mixing.copies(df).collect()}
    _, _, report = mixing.plan(df)
    tokens = {i: len(t.split()) for i, t, _ in rows}
    total = sum(tokens.values())
    assert abs(mixing.entropy([s["weight"] for s in report["sources"]]) - mixing.ENTROPY_SHARE * np.log(4)) < 1e-6 or max(s["target"] / s["tokens"] for s in report["sources"]) <= mixing.MAX_PASSES + 1e-6
    for s in report["sources"]:
        own = [i for i, _, z in rows if z == s["source"]]
        got = sum(tokens[i] * table[i] for i in own)
        assert s["target"] - 60 <= got <= s["target"]
        assert s["target"] / s["tokens"] <= mixing.MAX_PASSES + 1e-6
        assert max(table[i] for i in own) - min(table[i] for i in own) <= 1
    assert sum(s["target"] for s in report["sources"]) <= total
    mixed = Counter(x.doc_id for x in mixing.mix(df).collect())
    assert mixed == Counter({i: n for i, n in table.items() if n})


def test_mixing_cases(messy, spark):
    out = mixing.mix(messy)
    assert out.columns == messy.columns and out.count() >= 1
    assert mixing.mix(empty(messy)).count() == 0
    blank = docs_of(spark, [(1, None, "a"), (2, " ", "b")])
    assert Counter(x.doc_id for x in mixing.mix(blank).collect()) == {1: 1, 2: 1}


def test_solve_bisects_both_limits():
    tokens = [1000, 100, 10]
    a = mixing.solve(tokens, 0.9, 1e9)
    assert abs(mixing.entropy(mixing.weights(tokens, a)) - 0.9 * np.log(3)) < 1e-9
    b = mixing.solve(tokens, 1.0, 3.0)
    w = mixing.weights(tokens, b)
    assert abs(max(x * 1110 / n for x, n in zip(w, tokens, strict=True)) - 3.0) < 1e-6
