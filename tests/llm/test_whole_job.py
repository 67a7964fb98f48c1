"""Cases in which an operator did less than its whole job."""

import itertools
import math
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from rillstone.llm import graphs, linkgraph, ngrams, simhash
from rillstone.llm.textscan import raw, words


def test_rare_ngrams_of_a_large_table_are_scored_by_their_counts(spark):
    """By default parameters, over more than 2 MB of text, so that an n-gram seen once is a share below 5e-7."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("aab", k=260_000)) for _ in range(10)] + ["quick zebra", "quick zephyr", "", "é"]
    order, rows = ngrams.ORDER, [chr(0) * (ngrams.ORDER - 1) + "".join(chr(b + 2) for b in t.encode()) + chr(ngrams.END) for t in texts]
    counts = {k: Counter(r[i - k + 1 : i + 1] for r in rows for i in range(order - 1, len(r))) for k in range(1, order + 1)}
    totals, kinds = Counter(), Counter()
    for c in counts.values():
        for g, n in c.items():
            totals[g[:-1]] += n
            kinds[g[:-1]] += 1

    @cache
    def prob(g):
        if len(g) == 1:
            return (counts[1][g] + 1) / (sum(counts[1].values()) + ngrams.SYMBOLS - 1)
        return (counts[len(g)][g] + kinds[g[:-1]] * prob(g[1:])) / (totals[g[:-1]] + kinds[g[:-1]])

    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in ngrams.lm_scores(table).collect()}
    assert sorted(found) == list(range(len(texts)))
    for i in range(9, len(texts)):  # a long one too, which is walked in many stretches
        assert found[i].log_prob == pytest.approx(sum(math.log(prob(rows[i][j - order + 1 : j + 1])) for j in range(order - 1, len(rows[i]))), rel=1e-6)
    small = {r.doc_id: r.log_prob for r in ngrams.lm_scores(table, block=5).collect()}
    assert small == pytest.approx({k: r.log_prob for k, r in found.items()})


def test_blocked_hosts_are_rejected_however_many_there_are(spark):
    rows = [(i, f"http://casino{i}.example/", "") for i in range(2000)] + [(2000, "http://friend.example/", '<a href="http://casino7.example/">'), (2001, "http://plain.example/", "")]
    found = {r.page_id: r.keep for r in linkgraph.url_trust(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [k for k, v in found.items() if v] == [2001]


def test_distrust_reaches_hosts_many_links_away(spark):
    rows = [(i, f"http://h{i}.example/", f'<a href="http://{"h" + str(i - 1) if i > 1 else "casino"}.example/">') for i in range(1, 16)]
    found = linkgraph.url_trust(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert not any(r.keep for r in found)
    assert {r.page_id: r.distrust for r in found} == pytest.approx({i: 150_000 * 0.85**i for i in range(1, 16)}, abs=2)


def test_equal_vectors_are_neighbours_lowest_ids_first(spark):
    x = np.random.default_rng(7).normal(size=(1500, 16)).astype(np.float32)
    groups = {0: range(100, 150), 1: range(400, 1400)}
    for first, ids in groups.items():
        x[list(ids)] = x[first]
    found = defaultdict(list)
    for r in graphs.nearest_neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect():
        found[r.vec_id].append((r.rank, r.neighbour_id, r.distance))
    for first, ids in groups.items():
        for i in (first, *ids):
            want = [j for j in (first, *ids) if j != i][:10]
            assert sorted(found[i]) == [(n + 1, j, 0.0) for n, j in enumerate(want)]
    assert len(found) == 1500 and all(len(v) == 10 for v in found.values())


def sharing(texts):
    """Pairs of texts within the radius, and how many of them have a shard in common."""
    offsets, data = raw(pa.array(texts))
    prints, keys = simhash.fingerprints(data, offsets)
    values = [int.from_bytes(p.tobytes(), "big") for p in prints]
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (values[i] ^ values[j]).bit_count() <= simhash.RADIUS]
    return near, sum(bool((keys[i] == keys[j]).any()) for i, j in near)


def test_near_duplicates_with_repeated_lines_meet():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    for times in ((200, 200), (200, 40)):
        near = met = 0
        for _ in range(20):
            line = " ".join(word() for _ in range(10))
            found, shared = sharing(["\n".join([line] * n) + "\n" + " ".join(word() for _ in range(n // 2)) for n in times * 3])
            near, met = near + len(found), met + shared
        assert near > 100 and met >= 0.9 * near


@pytest.mark.parametrize("letters", [(0x4E00, 0x9F00), (0x3041, 0x3096), (0xE01, 0xE2F)])
def test_near_copies_in_scripts_without_spaces(spark, letters):
    rnd = random.Random(9)
    texts = ["".join("。" if i % 23 == 22 else chr(rnd.randrange(*letters)) for i in range(400)) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 5, t[:200] + "a" + t[201:]) for i, t in enumerate(texts)]
    found = {(r.doc_id, r.kept_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(i + 5, i) for i in range(5)}


def test_words_of_characters():
    texts = ["", "été, «ça»—va…", "漢字、かな。ab 9ก", "한국어 нет"]
    offsets, data = raw(pa.array(texts))
    starts, ends, first = words(data, offsets, apart=True)
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert [found[a:b] for a, b in zip(first, first[1:])] == [[], ["été", "ça", "va"], ["漢", "字", "か", "な", "ab", "9", "ก"], ["한국어", "нет"]]
