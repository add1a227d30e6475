"""Sharding, duplicates, languages, URLs, contamination and the pipeline against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from pyspark.ml.feature import HashingTF
from tidemark.llm import contamination, exact, graph, language, queries, sharding, simhash, urls

WORDS = "and the of in with from over under light heavy river stone cloud tree paper glass iron gold salt field".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def edited(text, seed, edits):
    words = text.split(" ")
    for i in random.Random(seed).sample(range(len(words)), edits):
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


BASE = prose(1, 400)
ROWS = [
    (0, None), (1, ""), (2, " \t\n"), (3, BASE), (4, BASE + " "), (5, BASE.upper()), (6, edited(BASE, 1, 3)), (7, edited(BASE, 2, 3)),
    (8, prose(2, 300)), (8, prose(2, 300)), (9, "one two three"), (10, "one two  three"), (None, prose(3, 60)), (None, None), (11, prose(4, 20000)),
    (12, "short"), (13, "shor t"), (14, "x" * 50000), (15, prose(5, 50) + "\n" + prose(6, 40)), (16, "12 34 !!"),
]


@pytest.fixture(scope="module")
def small(spark):
    """Nulls, empty, long, repeated and similar texts; extra columns with names used inside."""
    rows = [(d, t, "en" if d and d % 2 else None, "s", 1, 2.0, "f") for d, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part double, fp string").repartition(4)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# -- SQL -----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir).toPandas()
    expected = db.execute(queries.SQL[name]).df()[list(found.columns)]
    rows = lambda frame: sorted(map(tuple, frame.astype(object).to_numpy().tolist()))
    assert rows(found) == rows(expected)


# -- sharding ------------------------------------------------------------------


def sharding_brute(counts, shards, nodes, cells):
    """Documents one by one: hop by hop, cell by cell."""
    orders = sharding.clockwise(shards, nodes, cells)
    total = sum(counts.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    place, waiting = {}, {c: list(range(n)) for c, n in counts.items()}
    for hop in range(shards):
        for cell in sorted(waiting):
            keep = []
            for rank in waiting[cell]:
                if free[orders[cell][hop]]:
                    free[orders[cell][hop]] -= 1
                    place[cell, rank] = orders[cell][hop]
                else:
                    keep.append(rank)
            waiting[cell] = keep
    return place


def test_allotment_against_one_by_one():
    rng = random.Random(3)
    counts = {c: rng.randrange(40) for c in rng.sample(range(64), 30)}
    found = {}
    for cell, segments in sharding.allot(counts, 5, 3, 64):
        start = 0
        for end, shard, _ in segments:
            found |= {(cell, rank): shard for rank in range(start, end)}
            start = end
    assert found == sharding_brute(counts, 5, 3, 64)


def test_shards_of_rows(spark, small, documents):
    for df in (small, documents):
        rows = sharding.shard(df).collect()
        expected = sorted((str(d), len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in pairs(df))
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == expected
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.law == "rows" and r.grown_shard is None
        sizes = [len(slots[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(documents.limit(0)).count() == 0


def test_few_documents_leave_their_shard(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'a' AS text")
    orders = sharding.clockwise(8, sharding.VIRTUAL_NODES, sharding.CELLS)
    per_cell = (1 << sharding.RING) // sharding.CELLS
    home = lambda d: orders[int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) // per_cell][0]
    rows = sharding.shard(docs).collect()
    excess = sum(max(0, n - 500) for n in np.bincount([home(r.doc_id) for r in rows], minlength=8))
    assert sum(r.shard != home(r.doc_id) for r in rows) == excess


# -- exact copies --------------------------------------------------------------


def exact_brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d is None, d or 0, d))
    out = []
    for norm, members in groups.items():
        keep = min(members)[3]
        out += [(str(m[3]), str(keep), len(members), m[3] == keep, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out)


@pytest.mark.parametrize("memory", [1000, exact.MEMORY_BYTES])
def test_exact_groups(small, documents, memory):
    for df in (small, documents):
        found = exact.exact_groups(df, memory).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in found) == exact_brute(pairs(df))
    assert exact.exact_groups(documents.limit(0)).count() == 0


def test_a_table_compares_contents():
    table = exact.OpenTable()
    assert [table.find(7, c) for c in (b"a", b"b", b"a", b"c")] == [0, 1, 0, 2]
    many = [b"%d" % i for i in range(5000)]
    assert [table.find(9, c) for c in many] == [table.find(9, c) for c in many]
    records = [(h, b"%d" % c, (i,)) for i, (h, c) in enumerate([(5, 1), (5, 2), (5, 1)] * 50)]
    buckets = list(exact.grace(iter(records), 200))
    assert sum(len(b[0]) for b in buckets) == 2 and sum(len(b[2]) for b in buckets) == 150


# -- languages -----------------------------------------------------------------


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(truth)
    assert language.keep_known(docs).count() >= 0.99 * len(truth)


def test_languages_of_edge_cases(spark, small):
    rows = language.identify(small).collect()
    texts = dict(pairs(small))
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not re.search(r"[A-Za-z]", texts[r.doc_id]))
    kept = language.keep_known(small)
    assert kept.columns == small.columns and kept.where("doc_id in (0, 1, 2, 16)").count() == 0
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(none).collect()] == [("und", 0.0)]
    assert language.identify(none.limit(0)).count() == 0


def test_gradients_through_time():
    rng = np.random.default_rng(0)
    net = language.Network.fresh(["a", "b", "c"], 1, hidden=3)
    for w in net.weights():
        w += 0.1 * rng.standard_normal(w.shape).astype(np.float32)
    codes = rng.integers(0, 20, (6, 4))
    codes[4:, 1] = language.PAD
    labels = np.array([0, 1, 2, 0])

    def loss():
        d = language._distributions(net, language._states(net, codes))
        real = codes != language.PAD
        return float(-(np.log(d[:, labels, np.arange(4)]) * real).sum() / real.sum())

    for w, g in zip(net.weights(), language._gradients(net, codes, labels), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, step = w[at], 1e-2
        w[at] = before + step
        up = loss()
        w[at] = before - step
        down = loss()
        w[at] = before
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.03, abs=1e-4)


def test_every_position_is_labelled():
    net = language.Network.fresh(["a", "b"], 1)
    text = "é" * 500
    runs = language.position_labels(net, text)
    assert runs[0][0] == 0 and runs[-1][1] == 1000 and all(x[1] == y[0] for x, y in zip(runs, runs[1:], strict=False))
    both = language.probabilities(net, [text, "", "abc"])
    assert both[0].sum() == pytest.approx(1) and both[1].sum() == 0
    assert np.allclose(both[2], language.probabilities(net, ["abc"])[0])


# -- URLs ----------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.ORG", "http://ORG/x", "http://xorg/", "http://a.example.org/es/1?x", "http://example.org/es", "x://example.org/en/12#a",
    "http://example.com/fr/1/de/", "http://b.com/de/", "http://b.com?/de/", "http://a://b.org/", "http://É.Org/\n/x", "https://casino-bonus.example/slots", "http://a.org/" + "p" * 5000,
]


def url_brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = host.encode().lower().decode()
    best = None
    for verdict, rule in urls.RULES:
        domain, rest = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_verdicts(spark, sf_dir):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    known = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = urls.fit(urls.labelled_urls(spark))
    weights, bias = model.coefficients.toArray(), model.intercept
    hashing = HashingTF(inputCol="g", outputCol="f", numFeatures=urls.FEATURES)
    for df in (pages, known):
        source = {r.page_id: r.url for r in df.collect()}
        rows = urls.judge(df).collect()
        assert len(rows) == len(source)
        for r in rows:
            host, path, best = url_brute(source[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, best and best[1])
            grams = {m + f"^{t}$"[i : i + n] for m, t in (("h", host), ("p", path)) for n in urls.GRAMS for i in range(len(t) + 3 - n)}
            score = 1 / (1 + np.exp(-bias - sum(weights[i] for i in {hashing.indexOf(g) for g in grams})))
            assert r.score == pytest.approx(score, abs=1e-8)
            assert r.verdict == (best[0] if best else "block" if score >= 0.5 else "allow")
    assert urls.judge(pages.limit(0)).count() == 0


def test_the_classifier_learns():
    assert not set(urls.BLOCKED_URLS) & set(urls.ALLOWED_URLS)


def test_labelled_urls_are_told_apart(spark):
    table = urls.labelled_urls(spark).selectExpr("monotonically_increasing_id() AS page_id", "url", "label").collect()
    pages = spark.createDataFrame([(i, r.url) for i, r in enumerate(table)], "page_id long, url string")
    scores = {r.page_id: r.score for r in urls.judge(pages, rules=()).collect()}
    assert all((scores[i] >= 0.5) == (r.label == 1) for i, r in enumerate(table))


# -- contamination -------------------------------------------------------------


def shingle_set(text, n):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_contained_items(spark, small):
    items = [
        (1, prose(6, 40)), (2, edited(prose(6, 40), 3, 1)), (3, edited(prose(6, 40), 4, 4)), (4, "ONE  two"), (5, "short"), (6, None), (7, " "), (7, ""),
        (8, prose(9, 30)), (9, " ".join(prose(4, 20000).split()[5000:5300])), (1, prose(6, 40)), (10, "two one"),
    ]
    table = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id long")
    expected = []
    for doc_id, text in pairs(small):
        for item_id, item in items:
            n = min(5, len((item or "").split()))
            own = shingle_set(item, n) if n else set()
            shared = len(own & shingle_set(text, n)) if n else 0
            if own and shared / len(own) >= 0.8:
                expected.append((str(doc_id), item_id, shared, len(own)))
    assert {"4", "9", "1", "2"} & {e[0] for e in expected} or expected
    for chars in (1 << 20, 50):
        found = contamination.contained_items(small, table, block_chars=chars).collect()
        assert sorted((str(r.doc_id), r.item_id, r.shared, r.item_shingles) for r in found) == sorted(expected)
    clean = contamination.decontaminate(small, table)
    assert clean.columns == small.columns and clean.where("doc_id = 15").count() == 0 and clean.where("doc_id = 3").count() == 1
    assert contamination.contained_items(small.limit(0), table).count() == 0 and contamination.contained_items(small, table.limit(0)).count() == 0


# -- near copies ---------------------------------------------------------------


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_masks_cover_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        bits = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(bits & (m % (1 << 64)) == 0 for m in masks)


def fingerprint_brute(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_brute(ids, linked):
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    smallest = {}
    for i, d in enumerate(ids):
        if d is not None:
            smallest[top(i)] = min(d, smallest.get(top(i), d))
    return [smallest.get(top(i)) for i in range(len(ids))]


def test_near_duplicates(small, documents):
    for df in (small, documents):
        rows = pairs(df)
        prints = [fingerprint_brute(t) for _, t in rows]
        groups = groups_brute([d for d, _ in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
        expected = sorted((str(d), f"{p:016x}", str(g)) for (d, _), p, g in zip(rows, prints, groups, strict=True))
        found = simhash.near_duplicates(df).collect()
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected
    assert simhash.near_duplicates(documents.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [2, 64])
@pytest.mark.parametrize("radius", [1, 2])
def test_links_connect_what_is_near(spark, monkeypatch, bucket, radius):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", bucket)
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(25):
            prints.add(center ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(4))))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    edges = simhash.links(spark.createDataFrame([(0, p, p) for p in signed], "s int, fp long, node long"), radius)
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    distance = lambda i, j: ((signed[i] ^ signed[j]) % (1 << 64)).bit_count()
    expected = groups_brute(signed, lambda i, j: distance(i, j) <= radius)
    assert [roots.get(p, p) for p in signed] == expected


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, 3), (3, 7)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1100)}


def test_rounds_write_files_by_links(spark, monkeypatch):
    written, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(df.rdd.getNumPartitions()) or cut(df))
    settings = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for links, files in ((1 << 18, 1), (10, 5)):
            monkeypatch.setattr(graph, "FILE_LINKS", links, raising=False)
            written.clear()
            found = graph.components(edges)
            assert written[0] == 12 and set(written[3:]) == {files}
            assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(41)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_of_each_group_stays(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_CHARS", 40_000)
    rows = [(i, prose(100 + i, 200)) for i in range(30)]
    rows += [(1000 + i, edited(prose(77, 300), i, 2)) for i in range(150)] + [(2000, prose(77, 300))]
    rows += [(3000, prose(88, 100)), (3001, prose(88, 100) + " more"), (3002, None), (3003, ""), (None, prose(88, 100))]
    docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, family string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    assert set(range(30)) <= set(left) and {3002, 3003, None} <= set(left) and 3001 in left and 3000 not in left
    own = [shingle_set(t, 5) for d, t in left.items() if d is not None and 1000 <= d <= 2000]
    assert 1 <= len(own) < 20
    assert all(len(a & b) / len(a | b) < 0.8 for i, a in enumerate(own) for b in own[:i])


def similar_brute(rows):
    """Document ids that stay when all pairs are compared."""
    sets = [shingle_set(t, min(5, len(t.split()))) if t.split() else set() for _, t in rows]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    groups = groups_brute(list(range(len(rows))), lambda i, j: bool(sets[i] and sets[j]) and alike(i, j))
    best = {}
    for g, (d, t) in zip(groups, rows, strict=True):
        best[g] = min(best.get(g, (1, 0)), (-len(t), d))
    return {d for _, d in best.values()}


def scattered(seed, length):
    """A text and a copy with words replaced at random places, as many as leave a similarity of 0.8."""
    base, out, rng = prose(seed, length), None, random.Random(seed)
    places = rng.sample(range(length), length)
    for k in range(1, length):
        words = base.split(" ")
        for i in places[:k]:
            words[i] = f"new{seed}x{i}"
        copy = " ".join(words)
        a, b = shingle_set(base, 5), shingle_set(copy, 5)
        if len(a & b) < 0.8 * len(a | b):
            break
        out = copy
    return [base, out] if out else [base]


@pytest.fixture(scope="module")
def edited_pairs():
    texts = [t for seed in range(500) for t in scattered(1000 + seed, 40 + seed % 120)]
    return list(enumerate(texts))


def test_near_copies_with_scattered_edits_are_found(spark, edited_pairs):
    docs = spark.createDataFrame(edited_pairs, "doc_id long, text string").repartition(4)
    expected = similar_brute(edited_pairs)
    assert len(expected) <= 510 < len(edited_pairs)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == expected


def test_near_copies_of_documents(documents):
    rows = pairs(documents)
    assert {r.doc_id for r in simhash.keep_one(documents).collect()} == similar_brute(rows)


@pytest.mark.parametrize("bounds", [(8 << 20, 256, 64), (3000, 2, 64), (3000, 2, 2)])
def test_chains_keep_one_at_every_size(spark, monkeypatch, bounds):
    """The ends of a chain are not similar to each other; splitting must not change which rows stay."""
    monkeypatch.setattr(simhash, "SHARD_CHARS", bounds[0])
    monkeypatch.setattr(simhash, "BLOCK_DOCS", bounds[1], raising=False)
    monkeypatch.setattr(simhash, "SMALL_GROUP", bounds[2], raising=False)
    rows, line = [], prose(900, 12)
    for g in range(12):
        words = prose(901 + g, 150).split(" ")
        for step in range(6):
            rows.append((len(rows), " ".join(words)))
            words[20 * step + 5] = words[20 * step + 12] = f"step{g}x{step}"
    rows += [(len(rows) + i, line + " " + prose(950 + i, 2 + i % 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = similar_brute(rows)
    assert len(expected & set(range(72))) == 12
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == expected


def test_large_buckets_are_split_into_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_DOCS", 50, raising=False)
    rooted = spark.range(1000).selectExpr("7L AS h", "id AS doc_id", "10L AS m", "id DIV 2 AS root")
    settled = spark.range(30).selectExpr("8L AS h", "id AS doc_id", "10L AS m", "0L AS root")
    groups = defaultdict(set)
    for r in simhash._met(rooted.unionAll(settled)).collect():
        assert r.h == 7
        groups[r.x, r.y].add(r.doc_id)
    assert max(map(len, groups.values())) <= 3 * 50
    assert len({frozenset((a, b)) for g in groups.values() for a in g for b in g}) == 1000 * 1001 // 2


def test_near_copies_come_from_simhash_first(spark, monkeypatch):
    """Components of SimHash are verified by texts; what they connect is not compared again."""
    rows = [(10 * g + i, edited(prose(700 + g, 2000), i, 1) if i else prose(700 + g, 2000)) for g in range(5) for i in range(3)]
    rows += [(100, ""), (101, None), (102, "   ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {(r.a, r.b) for r in simhash._near_links(docs, 5, 0.8).collect()}
    close = {(r.component_id, r.doc_id) for r in simhash.near_duplicates(docs).collect() if r.component_id < r.doc_id}
    assert near == {p for p in close if p[0] < 100} and len(near) >= 5 and close - near == {(100, 101), (100, 102)}
    stars, links_of_stars = [], simhash._links_of_stars
    monkeypatch.setattr(simhash, "_links_of_stars", lambda ours, pairs, *rest: stars.append(pairs) or links_of_stars(ours, pairs, *rest))
    groups = {r.doc_id: r.root for r in simhash.similar_groups(docs).collect()}
    assert groups == {d: d // 10 * 10 for d, _ in rows if d < 100}
    assert {(r.a, r.b) for r in stars[0].collect()} == close
    assert {(r.a, r.b) for r in stars[1].collect()}.isdisjoint(near)


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(3)
    for m in (1, 5, 200, 510, 514, 3000, 9000):
        whole = rng.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for gone in (0, m // 20, m // 5):
            a, b = np.unique(whole), np.unique(whole[gone:])
            x, y = simhash._parity(a), simhash._parity(b)
            assert len(x) in (len(y), 2 * len(y))
            x = x if len(x) == len(y) else x[: len(y)] ^ x[len(y) :]
            assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_unlike_documents_of_a_bucket_give_no_pairs(spark):
    """Documents that only share a line; one pair of them is alike, of sketches of two lengths."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64)) for _ in range(60)]
    sets.append(np.concatenate((sets[0], rng.integers(0, 1 << 63, 40, dtype=np.uint64))))
    rows = [(h, 1, i, len(x), i, simhash._parity(x).tolist()) for h in (7, 8) for i, x in enumerate(sets)]
    rooted = spark.createDataFrame(rows, "h long, k long, doc_id long, m int, root long, s array<long>")
    assert [(r.p.a.doc_id, r.p.b.doc_id) for r in simhash._pairs_within(rooted, 0.8).collect()] == [(0, 60)] * 2


def test_large_buckets_bring_only_fitting_documents(spark, monkeypatch):
    """Sketches tell which documents of a large bucket have a partner, in whichever blocks the two lie."""
    monkeypatch.setattr(simhash, "SKETCH_DOCS", 20)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 100 + 20 * (i % 30), dtype=np.uint64)) for i in range(200)]
    sets += [np.concatenate((sets[i], rng.integers(0, 1 << 63, 10, dtype=np.uint64))) for i in (3, 100)] + [sets[7]]
    roots = [*range(202), 7]  # the last one is connected already
    schema = "doc_id long, m int, s array<long>"
    sketches = spark.createDataFrame([(i, len(x), simhash._parity(x).tolist()) for i, x in enumerate(sets)], schema)
    rooted = spark.createDataFrame([(h, i, len(x), roots[i]) for h in (5, 6) for i, x in enumerate(sets)], "h long, doc_id long, m int, root long")
    found = {(r.h, r.doc_id) for r in simhash._fitting_members(rooted, sketches, 0.8).collect()}
    assert found == {(h, i) for h in (5, 6) for i in (3, 100, 200, 201)}


def test_texts_sought_by_id_are_few(spark):
    rows = spark.range(20000).selectExpr("id AS doc_id").unionAll(spark.createDataFrame([(None,)], "doc_id long"))
    for ids in ([], [5], list(range(0, 20000, 100))):
        sought = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        found = {r.doc_id for r in rows.where(simhash._perhaps(sought)).collect()}
        assert set(ids) <= found and len(found) <= len(ids) + 600


def test_copies_leave_no_tables_behind(spark):
    """Tables between the steps, contents of texts among them, go with the step."""
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/tidemark-llm"
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs = spark.createDataFrame([(i, prose(i // 3, 100)) for i in range(90)], "doc_id long, text string").repartition(4)
    names = tables()
    one, near = exact.keep_one(docs), simhash.keep_one(docs)
    assert tables() <= names
    assert one.count() == near.count() == 30


def test_same_words_in_other_order_stay(spark):
    words = prose(990, 80).split(" ")
    rows = [(i, " ".join(random.Random(i).sample(words, 80))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.similar_groups(docs).count() == 0 and simhash.keep_one(docs).count() == 300


# -- pipeline ------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "benchmark_passages", "pieces"]
    docs, before = documents, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == documents.columns
        assert before is None or docs.count() <= before
        before = docs.count()
    texts = [t for _, t in pairs(docs)]
    norms = [re.sub(r"[\x20\x09-\x0D]", "", t) for t in texts]
    assert len(set(norms)) == len(norms)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = [shingle_set(t, 5) for t in texts]
    assert not any(len(x & s) >= 0.8 * len(x) for x in map(lambda t: shingle_set(t, 5), items) for s in held)
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {d: t.replace("▁", " ") for d, t in pairs(docs)} == {d: r.text for d, r in result.items()}
    gone = {r.doc_id for r in documents.collect()} - set(result)
    exactly = {int(r[0]) for r in exact_brute(pairs(documents)) if not r[3]}
    dirty = {r.doc_id for r in contamination.contained_items(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert exactly <= gone and dirty <= gone


def test_exact_copies_that_share_their_id(spark):
    rows = [(8, "aaa"), (8, "bbb"), (3, "bbb"), (5, "ccc"), (5, "ccc"), (5, "c c c"), (None, "dd"), (None, "d d"), (None, "ee"), (9, None), (10, " ")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, sha string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in exact.keep_one(docs).collect()), key=str)
    assert kept == sorted([(8, "aaa"), (3, "bbb"), (5, "c c c"), (None, "d d"), (None, "ee"), (10, " ")], key=str)
    assert exact.keep_one(docs.limit(0)).collect() == [] and exact.keep_one(docs).columns == docs.columns


def test_every_language_is_learned(spark):
    rows = [(i * 70 + k, f"{chr(97 + i // 10)}{chr(97 + i % 10)} " * 30, f"l{i}") for i in range(70) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language._learned(docs, 2).languages) == 70
    assert len(language._learned(docs, 2, most_languages=5).languages) == 5
