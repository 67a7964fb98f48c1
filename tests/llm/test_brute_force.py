"""Each operator against brute force, an exact round trip, SQL or held-out accuracy."""

import codecs
import itertools
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from rillstone.llm import bpe, graphs, language, linkgraph, ngrams, packing, perspectives, quality, queries, simhash, textscan
from rillstone.llm.frames import shared_dir
from rillstone.llm.textscan import raw

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# -- 1


def test_near_duplicates_against_all_pairs(spark):
    table = pq.read_table(f"{MEDIUM}/documents.parquet")
    offsets, data = raw(table["text"])
    prints, _ = simhash.fingerprints(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    values = [int.from_bytes(p.tobytes(), "big") for p in prints]
    ids = table["doc_id"].to_pylist()
    near = {(a, b) for (a, x), (b, y) in itertools.combinations(zip(ids, values), 2) if (x ^ y).bit_count() <= simhash.RADIUS}
    group: dict = {i: i for i in ids}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in sorted(near):
        x, y = sorted((find(a), find(b)))
        group[y] = x
    want = {(i, find(i)) for i in ids if find(i) != i}
    found = {(r.doc_id, r.kept_id) for r in simhash.near_duplicates(spark.read.parquet(f"{MEDIUM}/documents.parquet")).collect()}
    assert found == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**16 - 1), min_size=1, max_size=60), st.lists(st.integers(0, 2**16 - 1), min_size=1, max_size=9), st.integers(0, 16))
def test_bk_tree(values, asked, radius):
    wide = lambda own: np.array([[0, v] for v in own], np.uint64)
    values = sorted(set(values))
    q, node = simhash.BKTree(wide(values)).near(wide(asked), radius)
    assert sorted(zip(q.tolist(), node.tolist())) == [(i, j) for i, a in enumerate(asked) for j, v in enumerate(values) if (a ^ v).bit_count() <= radius]
    shard = simhash.Shard(wide(values), radius)
    parent = {v: v for v in values}
    for _ in values:
        for a, b in itertools.product(values, repeat=2):
            if (a ^ b).bit_count() <= radius:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert [values[i] for i in shard.root] == [parent[v] for v in values]


@pytest.mark.parametrize("limit, most", [(4096, 64 << 20), (7, 64 << 20), (7, 1000)])
def test_hot_shards_in_parts_lose_nothing(spark, limit, most):
    """One shingle shared by all texts, chains of near copies, and trees broadcast in one round or many."""
    rnd = random.Random(4)
    values = []
    for _ in range(12):
        v = rnd.getrandbits(128)
        for _ in range(rnd.randrange(1, 9)):
            values.append(v)
            for _ in range(20):
                v ^= 1 << rnd.randrange(128)
    values = sorted(set(values))
    rows = [(i, v.to_bytes(16, "big"), [1, 100 + i]) for i, v in enumerate(values)] * 2
    root = {v: v for v in values}
    for _ in values:
        for a, b in itertools.combinations(values, 2):
            if (a ^ b).bit_count() <= simhash.RADIUS:
                root[a] = root[b] = min(root[a], root[b])
    signs = spark.createDataFrame(rows, "doc_id long, print binary, keys array<long>").repartition(3)
    found = {int.from_bytes(r["print"], "big"): int.from_bytes(r.root, "big") for r in simhash.groups(signs, limit=limit, most=most).collect()}
    assert {v: found.get(v, v) for v in values} == root


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {k: v for k, v in root.items() if k in {r.node for r in found}}
    assert {k for k, v in root.items() if k != v} <= {r.node for r in found}


# -- 3


def test_lm_against_counting(spark):
    texts, order = ["abab", "", "abcé", "ba" * 300, "abab"], 3
    found = ngrams.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), order=order)
    rows = [[b + 2 for b in t.encode()] + [ngrams.END] for t in texts]
    counts = {k: Counter() for k in range(1, order + 1)}
    for r in rows:
        whole = [ngrams.START] * (order - 1) + r
        for i in range(order - 1, len(whole)):
            for k in counts:
                counts[k][tuple(whole[i - k + 1 : i + 1])] += 1
    after = defaultdict(Counter)
    for c in counts.values():
        for g, n in c.items():
            after[g[:-1]][g[-1]] += n
    size = sum(counts[1].values()) + ngrams.SYMBOLS - 1

    def prob(h, s):
        if not h:
            return (counts[1][(s,)] + 1) / size
        lower = prob(h[1:], s)
        kinds, total = len(after[h]), sum(after[h].values())
        return (after[h][s] + kinds * lower) / (total + kinds) if total else lower

    for r in found.collect():
        whole = [ngrams.START] * (order - 1) + rows[r.doc_id]
        want = sum(math.log(prob(tuple(whole[i - order + 1 : i]), whole[i])) for i in range(order - 1, len(whole)))
        assert r.log_prob == pytest.approx(want, rel=1e-4)


# -- 4 and 7


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{MEDIUM}/{t}.parquet'")
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, MEDIUM)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_masks_cover_the_speaker(spark):
    rows = spark.createDataFrame([(1, 0, "ann", "hi"), (1, 1, "bob", "ho"), (1, 2, "ann", "he")], "conv_id long, turn long, role string, text string")
    for r in perspectives.rotate(rows).collect():
        spans = [tuple(map(int, x.split("-"))) for x in r["mask"].split(",")]
        assert [r.text[a:b] for a, b in spans] == [t + perspectives.TAIL for t in ({"ann": ["hi", "he"], "bob": ["ho"]}[r.speaker])]
    assert linkgraph.ROUNDS > 0


# -- 5


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_places_everything_once(histogram):
    made = packing.plan(histogram, 40)
    used = Counter()
    for pattern, n in made:
        assert n > 0 and sum(pattern) <= 40
        for x in pattern:
            used[x] += n
    assert used == Counter(histogram)
    bins, total = sum(n for _, n in made), sum(k * v for k, v in histogram.items())
    assert bins <= max(-(-total * 3 // (40 * 2)) + 1, sum(v for k, v in histogram.items() if k > 20) + -(-total // 40))


def packed_one_by_one(histogram, capacity):
    """By definition: pieces from the longest, each completed exactly by a single, pair or triple of the others if there is one, then best fit."""
    left, bins, rest = Counter({k: v for k, v in histogram.items() if v}), [], []
    for anchor in sorted(left, reverse=True):
        while left[anchor]:
            left[anchor] -= 1
            gap, found = capacity - anchor, None
            have = sorted((x for x in left if left[x]), reverse=True)
            if gap == 0:
                found = ()
            for size in (1, 2, 3):
                if found is None and gap:
                    found = next((c for c in itertools.combinations_with_replacement(have, size) if sum(c) == gap and all(left[x] >= c.count(x) for x in c)), None)
            if found is None:
                rest.append(anchor)
            else:
                left -= Counter(found)
                bins.append((anchor, *found))
    open_bins = []
    for x in rest:
        fits = [b for b in open_bins if capacity - sum(b) >= x]
        if fits:
            max(fits, key=sum).append(x)
        else:
            open_bins.append([x])
    return Counter(bins) + Counter(tuple(b) for b in open_bins)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 7), max_size=12), st.integers(30, 40))
def test_plan_against_one_by_one(histogram, capacity):
    want = packed_one_by_one(histogram, capacity)
    found = Counter()
    for pattern, n in packing.plan(histogram, capacity):
        found[pattern] += n
    assert found == want


def test_lengths_and_sequences(spark):
    rows = [(i, [i * 100 + j for j in range(n)]) for i, n in enumerate([0, 3, 7, 8, 25, 2, 2, 16])] + [(20, None), (None, [5, 5])]
    table = spark.createDataFrame(rows, "doc_id long, tokens array<int>")
    sizes = table.selectExpr("doc_id", "size(tokens) AS n", "'x' AS text", "1 AS bin_id")
    want = {(r.doc_id, r.piece): (r.length, r.bin_id, r.start) for r in packing.pack(sizes.where("n >= 0"), 8, length_column="n", ranked=2).collect()}
    got, texts = {}, defaultdict(list)
    for r in packing.sequences(table, -1, 8, ranked=2).collect():
        assert len(r.tokens) <= 8 and len(r.starts) == len(r.doc_ids)
        for doc, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], len(r.tokens)]):
            texts[doc].append((r.tokens[a:b], r.bin_id, a))
    for doc, own in rows:
        if own is not None:
            parts = sorted(texts[doc], key=lambda p: p[0][0] if p[0][0] >= 0 else 1 << 30)
            assert [t for p, _, _ in parts for t in p] == [*own, -1]
            got |= {(doc, i): (len(p), b, a) for i, (p, b, a) in enumerate(parts)}
    assert got == want and 20 not in texts


def test_packing_covers_each_document(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = packing.pack(docs).collect()
    want = {r.doc_id: len(r.text.split()) + 1 for r in docs.collect()}
    total, places = Counter(), defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.length
        places[r.bin_id].append((r.start, r.length))
    # Python's white space is a little wider than the pattern's
    assert set(total) == set(want) and sum(abs(total[k] - want[k]) for k in want) <= 0.001 * sum(want.values())
    for spots in places.values():
        ends = 0
        for start, length in sorted(spots):
            assert start >= ends
            ends = start + length
        assert ends <= packing.CAPACITY
    assert len(places) <= math.ceil(sum(total.values()) / packing.CAPACITY) * 1.02 + 1 and sorted(places) == list(range(len(places)))


# -- 6


@pytest.mark.parametrize("shard, block, every", [(16384, 64 << 20, 1), (700, 64 << 20, 1), (700, 2000, 100)])
def test_neighbours_recall(spark, shard, block, every):
    x = np.random.default_rng(5).normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    d = 2 - 2 * x @ x.T
    np.fill_diagonal(d, 9)
    want = np.argsort(d, axis=1)[:, :10]
    found = defaultdict(set)
    for r in graphs.nearest_neighbours(table, graphs.asked_every(table, every), shard=shard, block=block).collect():
        found[r.vec_id].add(r.neighbour_id)
    assert sorted(found) == list(range(0, 3000, every)) and all(len(v) == 10 for v in found.values())
    assert np.mean([len(found[i] & set(want[i].tolist())) / 10 for i in found]) >= 0.9


def test_neighbours_query_against_brute_force(spark):
    """op6 as registered, over the whole of a table, every query's list against all rows."""
    table = pq.read_table(f"{MEDIUM}/embeddings.parquet")
    ids = table["vec_id"].to_numpy()
    x = table["embedding"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(float)
    found = defaultdict(list)
    for r in queries.QUERIES["op6_nearest_neighbours"](spark, MEDIUM).collect():
        found[r.vec_id].append((r.rank, r.neighbour_id, r.distance))
    assert sorted(found) == sorted(i for i in ids.tolist() if i % 100 == 0)
    hits = []
    for i, rows in found.items():
        gap = np.sqrt(((x - x[ids == i]) ** 2).sum(axis=1))
        gap[ids == i] = np.inf
        best = np.lexsort((ids, gap))[:10]
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 11)) and all(abs(gap[ids == n][0] - d) < 1e-6 for _, n, d in rows)
        hits.append(len({n for _, n, _ in rows} & set(ids[best].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_neighbours_of_any_magnitude(spark):
    """Numbers whose squares leave 32 bits, great and small, a large common offset, and rows of several dimensions."""
    rng = np.random.default_rng(3)
    for scale, shift in ((1e19, 0), (1e-25, 0), (3e37, 0), (1.0, 1e4)):
        x = (rng.normal(size=(300, 8)) * scale + shift).astype(np.float32)
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()[:3]) for i, v in enumerate(x[:50])]
        found = defaultdict(set)
        for r in graphs.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), neighbours=5).collect():
            found[r.vec_id].add(r.neighbour_id)
        hits = []
        for base, y in ((0, x), (1000, x[:50, :3])):
            gap = ((y[:, None].astype(float) - y[None].astype(float)) ** 2).sum(axis=2)
            np.fill_diagonal(gap, np.inf)
            hits += [len(found[base + i] & {base + int(j) for j in np.argsort(gap[i])[:5]}) / 5 for i in range(len(y))]
        assert np.mean(hits) >= 0.9, (scale, shift)


# -- 8


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks())


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})


def test_tokens_are_those_of_merging(spark, docs, reference):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bpe.bpe_encode(docs)
    assert all(r.restored and r.tokens == reference.encode_ordinary(texts[r.doc_id]) for r in rows.collect())
    assert {r.doc_id: r.text for r in bpe.bpe_decode(rows).collect()} == texts


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abth e\n.1", max_size=80))
def test_any_text(encoder, reference, text):
    assert encoder.encode(text) == encoder.encode(text) == reference.encode_ordinary(text)


def test_output_lags_by_a_bounded_number_of_bytes(encoder):
    machine = encoder.transducer
    at, lag, most = 0, 0, max(map(len, machine.ranks))
    for i, b in enumerate(b"abthe" * 400):
        at, out = machine.arc(at, b)
        lag += 1 - sum(len(machine.token[t]) for t in out)
        assert lag <= 2 * most


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=5) | st.text(max_size=3).map(str.encode), max_size=12))
def test_streaming_decode(parts):
    stream, want = bpe.Utf8Stream(), codecs.getincrementaldecoder("utf-8")("replace")
    text = "".join(stream.feed(p) for p in parts) + stream.close()
    assert text == "".join(want.decode(p) for p in parts) + want.decode(b"", True)


# -- 9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=4), st.integers(1, 3), st.integers(1, 4), st.integers(0, 1000))
def test_viterbi(sizes, states, size, seed):
    first = np.concatenate(([0], np.cumsum(sizes)))
    scores = np.random.default_rng(seed).normal(size=(first[-1], states)).astype(np.float32)
    path = language.viterbi(scores, first, 0.7, size)
    value = lambda p, s: sum(s[i][x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
    for a, b in zip(first, first[1:]):
        if b - a:
            best = max(value(p, scores[a:b].astype(float)) for p in itertools.product(range(states), repeat=min(b - a, 6))) if b - a <= 6 else None
            if best is not None:
                assert value(path[a:b], scores[a:b].astype(float)) == pytest.approx(best, abs=1e-4)


def spelled(text):
    """Words as (start, end, text) in characters, one by one: letters and digits; scripts without spaces by the character."""
    out = []
    for i, c in enumerate(text):
        point = ord(c)
        alone = any(a <= point < b for a, b in textscan.UNSPACED)
        inside = c.isascii() and c.isalnum() or point > 127 and (unicodedata.category(c)[0] not in "PZ" or alone)
        if not inside:
            continue
        if out and out[-1][1] == i and not alone and not out[-1][3]:
            out[-1] = (out[-1][0], i + 1, out[-1][2] + c, False)
        else:
            out.append((i, i + 1, c, alone))
    return [(a, b, "".join(x.lower() if x.isascii() or 0xC0 <= ord(x) <= 0xDE and x != "×" else x for x in w)) for a, b, w, _ in out]


def gram_list(word):
    b = b" " + word.encode() + b" "
    return [1 << 16 | 32 << 8 | b[1], *(b[i - 2] << 16 | b[i - 1] << 8 | b[i] for i in range(2, len(b)))]


def script_of(word):
    return [name for start, name in language.SCRIPTS if start <= ord(word[0])][-1]


def test_language_spans_against_brute_force(spark):
    """Counts, scores, the best labelling by dynamic programming, spans and verdicts, all from their definitions."""
    train = [("en", "the cat and the dog went over the hill"), ("en", "“Water”, they said — and the dog drank"), ("fr", "le chat et le chien sont allés au marché"), ("uk", "кіт і собака пішли до лісу"), ("ru", "кот и собака пошли в лес"), ("ja", "猫と犬は森へ行った。日本語のテキスト")]
    texts = ["the dog et le chien", "“привет” кот и лес", "кіт пішли до the hill 42 лісу", "日本語のテキスト", "猫", "γάτα και σκύλος", "한국어 the cat", "qzx vvkj", "12 34", "", "!!", "le marché 犬は the森", "the cat " * 40 + "le chat et le chien " * 30]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(train)] + [(100 + i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.language_spans(docs).collect()}
    counts, used = defaultdict(Counter), defaultdict(Counter)
    for lang, t in train:
        for _, _, w in spelled(t):
            counts[lang].update(gram_list(w))
            if not w[0].isdigit():
                used[lang][script_of(w)] += len(w.encode())
    langs = sorted(counts)
    uses = {lang: {s for s, n in c.items() if n >= language.USES * sum(c.values())} for lang, c in used.items()}
    slot = lambda g: (g * 2654435761 % (1 << 32)) >> 15
    table = {}
    for lang in langs:
        context = Counter()
        for g, n in counts[lang].items():
            context[g // 256] += n
        for g, n in sorted(counts[lang].items(), key=lambda x: (x[1], x[0])):
            table[lang, slot(g)] = math.log((n + 0.05) / (context[g // 256] + 3.2))
    for i, t in enumerate(texts):
        spots = spelled(t)
        extra = {x for _, _, w in spots for x in language.COMMON.get(script_of(w), []) if not any(script_of(w) in u for u in uses.values())}
        names = [*sorted({*langs, *extra}), language.UND]
        rows = []
        for _, _, w in spots:
            script, size = script_of(w), len(w.encode())
            trained = [x for x in langs if script in uses[x]]
            row = dict.fromkeys(names, -language.BARRED)
            if script == "latin" or not trained:
                row[language.UND] = language.UNKNOWN * (size + 1)
            for x in trained:
                row[x] = sum(table.get((x, slot(g)), language.UNSEEN) for g in gram_list(w))
            if not trained:
                for k, x in enumerate(language.COMMON.get(script, [])):
                    row[x] = language.UNKNOWN * (size + 1) + language.COMMONLY - language.LESS * k
            rows.append(dict.fromkeys(names, 0.0) if w[0] in "0123456789" else row)
        best = dict.fromkeys(names, (0.0, ()))
        for row in rows:
            best = {x: max(((best[y][0] - language.SWITCH * (y != x) + row[x], best[y][1] + (x,)) for y in names), key=lambda v: v[0]) for x in names} if best[names[0]][1] else {x: (row[x], (x,)) for x in names}
        r = found[100 + i]
        path = [next(s.lang for s in r.spans if s.start <= a < s.end) for a, _, _ in spots]
        value = sum(row[x] for row, x in zip(rows, path)) - language.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
        assert value == pytest.approx(max(v for v, _ in best.values()), abs=1e-3 * (1 + len(rows))), t
        assert r.spans == [(a[0][0], a[-1][1], x) for x, g in itertools.groupby(zip(path, spots), key=lambda v: v[0]) for a in [[s for _, s in g]]]
        held = Counter()
        for x, (_, _, w) in zip(path, spots):
            held[x] += len(w.encode())
        top = min(held, key=lambda x: (-held[x], names.index(x)), default=language.UND)
        assert r.lang == top and r.share == pytest.approx(held[top] / sum(held.values()) if held else 0.0)
        assert r.keep == (bool(held) and held[language.UND] <= language.REJECT * sum(held.values()))
    spans = lambda i: [s.lang for s in found[100 + i].spans]
    assert spans(1) == ["ru"] and set(spans(2)) == {"uk", "en"} and spans(3) == spans(4) == ["ja"] and spans(5) == ["el"] and spans(6) == ["ko", "en"] and spans(7) == ["und"]


def test_scripts_of_untrained_languages(spark):
    rows = [(0, "привіт це українська мова", "uk"), (1, "این یک متن فارسی است", "fa"), (2, "some english words are here", "en")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = {0: "українська мова", 1: "متن فارسی", 2: "“some” words", 3: "漢字", 4: "かな漢字", 5: "文字 english words are here"}
    found = language.language_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang for r in found} == {0: "uk", 1: "fa", 2: "en", 3: "zh", 4: "ja", 5: "en"} and all(r.keep for r in found)


def test_sample_of_labelled_texts(spark):
    """At most ``sample`` different texts of each language, each once, however often rows repeat."""
    rows = [(i, f"word{i} " * 3, "aa") for i in range(50)] + [(i, "same text", "bb") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    assert language.fit(docs, sample=5).langs == ["aa", "bb"]
    one = language.fit(spark.createDataFrame([(1, "same text", "bb")], "doc_id long, text string, lang string"))
    assert (language.fit(docs, sample=5).scores[:, 1] == one.scores[:, 0]).all()


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    found = {r.doc_id: r for r in language.language_spans(docs.where("doc_id % 2 = 1"), model).collect()}
    truth = {r.doc_id: r.lang for r in docs.where("doc_id % 2 = 1 and n_chars > 40").collect()}
    assert np.mean([found[k].lang == v for k, v in truth.items()]) > 0.95
    assert np.mean([found[k].keep for k in truth]) > 0.99
    one = {l: next(r.text for r in docs.where(f"lang = '{l}' and n_chars between 300 and 900").orderBy("doc_id").collect()) for l in ("fr", "de")}
    mixed = spark.createDataFrame([(1, one["fr"] + "\n" + one["de"], None)], "doc_id long, text string, lang string")
    (row,) = language.language_spans(mixed, model).collect()
    long = [s for s in row.spans if s.end - s.start > 150]
    assert [s.lang for s in long] == ["fr", "de"] and abs(long[0].end - len(one["fr"])) < 60


# -- 10


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 5)), min_size=1, max_size=12))
def test_isotonic(pairs):
    n = np.array([b for _, b in pairs], float)
    y = np.array([min(a, b) for a, b in pairs], float)
    k = len(n)
    mean = lambda a, b: y[a : b + 1].sum() / n[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]
    assert quality.isotonic(y, n) == pytest.approx(want)


def test_quality_against_a_direct_solution(spark):
    """op10 as registered: statistics of each labelled text by plain Python, features, ridge weights by least squares, calibration and verdicts."""
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist() if r["doc_id"] in docs and r["quality"] is not None}

    def measured(text):
        data = text.encode()
        found = [x.lower() for x in re.findall(rb"[A-Za-z0-9\x80-\xff]+", data)]
        folded = ["".join(c.lower() if c.isascii() or 0xC0 <= ord(c) <= 0xDE and c != "×" else c for c in w.decode()) for w in found]
        length, n = [len(w) for w in found], max(len(found), 1)
        lines = re.findall(rb"[^\n]*\n|[^\n]+$", data)
        mean = sum(length) / n
        share = lambda chars: sum(b in chars for b in data) / max(len(data), 1)
        signs = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "!?|<>{}[]()")
        return [math.log1p(len(found)), mean, math.sqrt(max(sum(x * x for x in length) / n - mean**2, 0)), share(bytes(range(65, 91))), share(b"0123456789"), share(b"!?"), share(b"|"), share(b"<>{}[]()"), share(signs), share(b" \t\r\n"), share(bytes(range(128, 256))),
                len(set(folded)) / n, 1 - len({x.lower() for x in lines}) / max(len(lines), 1), math.log1p(len(data) / max(len(lines), 1)), sum(x <= 3 for x in length) / n, share(bytes([*range(9), 11, 12, *range(14, 32), 127]))]

    stats = {k: np.array(measured(t)) for k, t in docs.items()}
    for k, t in list(docs.items())[::7]:
        data = np.frombuffer(t.encode(), np.uint8)
        assert quality.statistics(data, np.array([0, len(data)]))[0] == pytest.approx(stats[k], abs=1e-9), k
    own = [quality.statistics(np.frombuffer(docs[k].encode(), np.uint8), np.array([0, len(docs[k].encode())]))[0].tolist() for k in labels]
    sides = {k: r.apart for k, r in zip(labels, spark.createDataFrame([(i, v) for i, v in enumerate(own)], "i long, stats array<double>").orderBy("i").selectExpr(f"pmod(xxhash64(stats), {quality.HELD}) = 0 AS apart").collect())}
    x = np.array([stats[k] for k in labels])
    spread = x.std(axis=0)
    rng = np.random.default_rng(quality.SEED)
    turn, shift = rng.normal(size=(len(quality.NAMES), quality.FEATURES)) / math.sqrt(len(quality.NAMES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = {k: np.append(np.cos(np.clip((s - x.mean(axis=0)) / np.where(spread > 1e-9, spread, 1.0), -8, 8) @ turn + shift) * math.sqrt(2 / quality.FEATURES), 1.0) for k, s in stats.items()}
    fitted = [k for k in labels if not sides[k]]
    root = np.sqrt(quality.RIDGE * len(fitted))
    a = np.concatenate(([z[k] for k in fitted], np.diag([*[root] * quality.FEATURES, 1e-9**0.5])))
    weights = np.linalg.lstsq(a, np.concatenate(([2.0 * labels[k] - 1 for k in fitted], np.zeros(quality.FEATURES + 1))), rcond=None)[0]
    score = {k: v @ weights for k, v in z.items()}
    found = {r.doc_id: r for r in queries.QUERIES["op10_quality_scores"](spark, SMALL).collect()}
    assert sorted(found) == sorted(docs) and all(found[k].score == pytest.approx(score[k], abs=1e-6) for k in docs)
    step = lambda k: min(max(math.floor(found[k].score * quality.STEP), -quality.GRID), quality.GRID)
    held = defaultdict(list)
    for k in labels:
        if sides[k]:
            held[step(k)].append(labels[k])
    at = sorted(held)
    pooled = lambda i, j: sum(sum(held[s]) for s in at[i : j + 1]) / sum(len(held[s]) for s in at[i : j + 1])
    level = [max(min(pooled(i, j) for j in range(m, len(at))) for i in range(m + 1)) for m in range(len(at))]
    for k in docs:
        want = np.interp(step(k), at, level) if stats[k][0] > 0 else 0.0
        assert found[k].quality == pytest.approx(want, abs=1e-9) and found[k].keep == (found[k].quality >= quality.KEEP)


def test_quality_of_held_out_texts(spark):
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    found = {r.doc_id: r for r in quality.quality_scores(docs, labels.where("doc_id % 2 = 0")).collect()}
    truth = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    good = [k for k, v in truth.items() if v == 1 and k in found]
    bad = [k for k, v in truth.items() if v == 0 and k in found]
    assert np.mean([found[k].keep for k in good]) > 0.96 and np.mean([found[k].keep for k in bad]) < 0.4


# -- the pipeline


def grouped(texts):
    """The lowest doc_id of the group of each text, from the fingerprints of all pairs."""
    ids = sorted(texts)
    prints = {}
    for i in ids:
        data = np.frombuffer(texts[i].encode(), np.uint8)
        prints[i] = int.from_bytes(simhash.fingerprints(data, np.array([0, len(data)]))[0].tobytes(), "big")
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_pipeline_against_brute_force(spark):
    """Each filter's decisions on what the one before has kept, one document at a time or over all pairs, and the bins that the plan for these lengths has."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    only = lambda keep: docs.where(docs.doc_id.isin(sorted(keep)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    languages, left = language.fit(docs), set()
    for k, t in texts.items():
        data = np.frombuffer(t.encode(), np.uint8)
        named = language.labelled(languages, data, np.array([0, len(data)]), language.SWITCH)
        if language.verdicts(*named, language.REJECT)[2][0]:
            left.add(k)
    assert left <= set(texts)
    model, good = quality.fit(only(left), labels), set()
    for k in left:
        data = np.frombuffer(texts[k].encode(), np.uint8)
        if quality.results(model, quality.statistics(data, np.array([0, len(data)])))[1][0] >= quality.KEEP:
            good.add(k)
    root = grouped({k: texts[k] for k in good})
    kept = {k for k in good if root[k] == k}
    assert kept < good < left
    rows, lengths, bins = corpus_pipeline.run(spark, SMALL).collect(), Counter(), defaultdict(list)
    for r in rows:
        lengths[r.doc_id] += r.length
        bins[r.bin_id].append((r.start, r.length))
    assert lengths == {k: len(re.findall(r"[^ \t\n\x0b\f\r]+", texts[k])) + 1 for k in kept}
    want = Counter()
    for pattern, n in packing.plan(Counter(r.length for r in rows), packing.CAPACITY):
        want[pattern] += n
    assert Counter(tuple(x for _, x in sorted(b)) for b in bins.values()) == want
    assert [len(list(Path(d).glob("pipeline-*/*.parquet"))) for d in [shared_dir(spark).removeprefix("file:")] if list(Path(d).glob("pipeline-*"))] == [1]  # of one run only the last stage's rows
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "packing"]
