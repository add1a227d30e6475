"""Packing, prefix tries and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, prefix_trie, queries, spelling

LONG = " ".join(f"word{i % 70}" for i in range(6000))
TEXTS = [
    (0, None), (1, ""), (2, " "), (3, "  \n \t x"), (4, "one two  three\n four \n\n five "), (5, LONG), (6, LONG), (6, LONG), (None, "no id"), (None, None),
    (7, "ends<|endoftext|>here <|endoftext|> and  <|endoftext|>"), (8, "éa Ġx  y 　 z\x1c w"), (9, "naïve 's it's  's 12 345"), (10, " lead"), (11, "x" * 30000),
]


@pytest.fixture(scope="module")
def small_docs(spark):
    rows = [(d, t, "l", 1, "r") for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, part int, rank string").repartition(3)


# -- packing ---------------------------------------------------------------------


def one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        insort(rooms, room - n)
    return rooms


@pytest.mark.parametrize("seed", range(60))
def test_best_fit_equals_one_piece_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 16, 50])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else max(1, capacity // 3) for _ in range(rng.randint(0, 200))]
    rows, made = packing.best_fit(Counter(lengths), capacity)
    inside, ranks = defaultdict(list), set()
    for length, rank, first, n, offset in rows.tolist():
        for k in range(n):
            ranks.add((length, rank + k))
            inside[first + k].append((offset, length))
    assert ranks == {(n, k) for n, c in Counter(lengths).items() for k in range(c)}
    for pieces in inside.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    assert sorted(capacity - sum(p[1] for p in s) for s in inside.values()) == one_by_one(lengths, capacity)
    assert made == len(inside)


def test_best_fit_of_very_many_pieces():
    rows, made = packing.best_fit({n: 10**12 + n for n in range(1, 1025)}, 1024)
    total = sum(n * (10**12 + n) for n in range(1, 1025))
    assert made < 1.01 * total / 1024 and len(rows) < 10_000


def test_words_have_the_ids_of_the_library(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), packing.ByteTokens(path)
    rng = random.Random(3)
    odd = ["".join(rng.choice(" \n\t ab.,'1é  Ġ<|endoftext|>") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    given = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = odd + given + [t or "" for _, t in TEXTS]
    for start in range(0, len(items), 500):
        got = encoder.encode_all(items[start : start + 500])
        want = library.encode_batch(items[start : start + 500], add_special_tokens=False)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_packing_of_documents(spark, small_docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(small_docs, keep_ids=True).collect()
    want = []
    for doc_id, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        ends = range(first, len(ids) + 1, 1024)
        for k, end in enumerate(ends):
            own = np.array(ids[max(0, end - 1024) if k else 0 : end], dtype="<u4").tobytes()
            want.append((doc_id, k, end - len(own) // 4, len(own) // 4, zlib.crc32(own), own))
    key = lambda r: tuple((v is not None, v) for v in r)
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    lengths = [w[3] for w in want]
    assert len({r.sequence_id for r in rows}) == len(one_by_one(lengths, 1024))
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    whole = {r.sequence_id: (r.length, bytes(r.ids)) for r in packing.sequences(spark.createDataFrame(rows)).collect()}
    for name, pieces in by_sequence.items():
        at, joined = 0, b""
        for offset, length, ids in sorted(pieces):
            assert offset == at
            at, joined = at + length, joined + ids
        assert at <= 1024 and whole[name] == (at, joined)


def test_packing_of_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing_query(spark, sf_dir):
    rows = queries.op11_best_fit_packing(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len({r.sequence_id for r in rows}) == len(one_by_one([r.length for r in rows], 1024))


# -- prefix trie -----------------------------------------------------------------


def brute_trie(turns, family, borrowed):
    known = defaultdict(list)
    for conv_id, turn, role, text in turns:
        if conv_id is not None:
            known[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [(r, t) for _, _, r, t in sorted(rows)] for c, rows in known.items()}
    built = {}
    for c, own in plain.items():
        h = borrowed(c) if borrowed else 0
        built[c] = plain.get(c - c % family, [])[:h] + own[h:] if borrowed else own
    members = defaultdict(set)
    for c, rows in built.items():
        for d in range(len(rows) + 1):
            members[tuple(rows[:d])].add(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [sums[c] for c in children[node]]
        sums[node] = (own + sum(b[0] for b in below), sum(b[1] for b in below) or 1)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), sums[node][1], sums[node][0],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: r[:2])


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(*TRIE).collect()), key=lambda r: r[:2])


def random_turns(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if rng.random() < 0.15:
            continue
        for t in range(rng.randint(1, 7)):
            text = rng.choice(["a", "ab", "", None, "ü", "a|b"])
            rows.append((c, rng.choice([t, t, t, None]) if t == 0 else t, rng.choice(["u", "a", None, ""]) if t % 3 == 0 else "u", text))
    rows += [(c, t, "user", "hot") for c in range(1000, 1200) for t in range(3)]
    return rows + [(None, 1, "u", "lost"), (5000, 0, "u", "x" * 40000), (5000, 0, "u", "x" * 40000), (5001, None, None, None)] + [(6000, t, "u", f"deep {t}") for t in range(400)]


@pytest.mark.parametrize("limits", [(4096, 1 << 16), (3, 1 << 16), (50, 40)])
@pytest.mark.parametrize("family", [1, 5])
def test_trie_against_brute_force(spark, monkeypatch, limits, family):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", limits[0])
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", limits[1])
    rows = random_turns(7)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "k", 1.0) for r in rows], "conv_id long, turn long, role string, text string, key string, depth double").repartition(3)
    borrowed = queries.first_turns if family > 1 else None
    assert trie_rows(prefix_trie.prefix_trie(df, family, borrowed)) == brute_trie(rows, family, borrowed)


def test_trie_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(queries.op12_prefix_trie(spark, sf_dir)) == brute_trie(rows, 5, queries.first_turns)


def test_trie_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(empty).collect() == []


def test_ids_at_the_ends_of_a_long(spark):
    ends = [(-(2**63), 0, "u", "a"), (2**63 - 1, 0, "u", "a"), (-1, 0, "u", "b"), (0, 0, "u", "b")]
    df = spark.createDataFrame(ends, "conv_id long, turn long, role string, text string")
    assert trie_rows(prefix_trie.prefix_trie(df, 5, queries.first_turns)) == brute_trie(ends, 5, queries.first_turns)


# -- spelling --------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(docs, least_length, slip):
    counts = Counter()
    for doc_id, text in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            counts[slip(doc_id, run) if slip else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= 2}
    near = defaultdict(list)
    by_deletion = defaultdict(set)
    for w in words:
        for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_deletion[key].add(w)
    for group in by_deletion.values():
        for a in group:
            near[a] += [b for b in group if one_edit(a, b)]
    out, forms = {}, {}
    for w, n in words.items():
        others = set(near[w])
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
        out[w] = (w, n, len(others), forms[w], words[forms[w]] if forms[w] else None)
    rows = []
    for w, row in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((*row, root))
    return sorted(rows)


FORMS = ["word", "n", "n_near", "form", "form_n", "root"]


def variant_rows(df):
    return sorted(tuple(r) for r in df.select(*FORMS).collect())


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all_words_with_one_error(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abÿ" if seed % 2 else "abcdefgh") for _ in range(rng.randint(4, 9))) for _ in range(300)} | {"a" * 400, "a" * 401, "a" * 200 + "b" + "a" * 199})
    index = spelling.Index(words)
    found = set()
    for side in "RL":
        for forward in (True, False):
            queries_ = [(i, *spelling.region(len(w), side)[:2]) for i, w in enumerate(words)]
            q, v = index.search(queries_, forward)
            found |= set(zip(q.tolist(), v.tolist()))
    assert found == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}


def generated_docs(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 10))) for _ in range(60)] + ["sharedhead" + "".join(rng.choice("xyz") for _ in range(5)) for _ in range(60)]
    docs = []
    for d in range(120):
        words = rng.choices(base, weights=[3 ** (i % 6) for i in range(len(base))], k=120)
        for i in range(0, 120, 9):
            w = words[i]
            k = rng.randrange(len(w))
            words[i] = rng.choice([w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + "b" + w[k + 1 :]])
        docs.append((d, " ".join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return docs + [(None, "abcdefgh " * 3), (500, None), (500, ""), (501, "×÷ÀÿA1" * 3), (502, "z" * 40 + " " + "z" * 41), (503, "z" * 40 + " " + "z" * 41), (503, "z" * 40 + " " + "z" * 41)]


@pytest.mark.parametrize("large, chars", [(4096, 1 << 16), (8, 300), (3, 1)])
def test_variants_against_brute_force(spark, monkeypatch, large, chars):
    monkeypatch.setattr(spelling, "BLOCK_CHARS", chars)
    monkeypatch.setattr(spelling, "TALLY", 50)
    docs = generated_docs(large)
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n long").repartition(4)
    got = variant_rows(spelling.variants(df, slip=queries.slip, large=large))
    want = brute_variants(docs, 7, queries.slip)
    assert got == want and any(r[3] for r in want)


def test_variants_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert variant_rows(queries.op13_spelling_variants(spark, sf_dir)) == brute_variants(docs, 7, queries.slip)


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
