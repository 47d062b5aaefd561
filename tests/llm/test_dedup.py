import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidegauge.llm import exact_dedup, simhash, suffixes
from tidegauge.llm.components import components


def brute_fingerprint(text, shingle):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(found[i:i + shingle]) for i in range(len(found) - shingle + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, shingle, distance):
    prints = [(d, brute_fingerprint(t, shingle)) for d, t in rows]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        least[find(i)].append(d)
    return sorted((d, f"{f:016x}", min(x for x in least[find(i)] if x is not None)) for i, (d, f) in enumerate(prints))


@pytest.mark.parametrize(
    "shingle,distance,segments,block",
    [(4, 4, 3, 20_000), (4, 4, 2, 5), (5, 7, None, 3), (5, 7, 5, 20_000), (2, 12, 4, 20_000), (4, 0, None, 20_000)]
)
def test_near_duplicates_match_brute_force(documents, corpus, monkeypatch, shingle, distance, segments, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    found = simhash.near_duplicates(documents, shingle, distance, segments)
    assert sorted(map(tuple, found.collect())) == brute_components(corpus, shingle, distance)


@pytest.mark.parametrize("distance", [0, 1, 4, 7])
def test_some_segment_is_within_its_radius(distance):
    for segments in range(2, 8):
        assert sum(r + 1 for r in simhash.radii(distance, segments)) == distance + 1
    # The more fingerprints there are, the wider the segments.
    chosen = [simhash.segments_for(10**k, distance) for k in range(3, 12)]
    assert chosen == sorted(chosen, reverse=True) and chosen[-1] == 2


def test_local_roots_link_everything_that_hangs_together():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    label = suffixes_free_roots(300, zip(a, b))
    got = simhash.local_roots(300, [(a[:90], b[:90]), (a[90:], b[90:])])
    assert got.tolist() == label


def suffixes_free_roots(n, pairs):
    label = list(range(n))
    for x, y in pairs:
        x, y = label[x], label[y]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (200, 201), (201, 200)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_duplicates_match_grouping(documents, corpus):
    groups = defaultdict(list)
    for d, t in corpus:
        groups[t or ""].append(d)
    want = sorted((d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in corpus)
    found = exact_dedup.exact_duplicates(*exact_dedup.halves(documents))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in found.collect()) == want


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_filters_know_all_their_keys_and_few_others(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    held = exact_dedup.build_filter(np.unique(keys))
    assert exact_dedup.may_contain(keys, *held).all()
    others = np.random.default_rng(n + 1).integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert exact_dedup.may_contain(others, *held).mean() < 0.02


def test_a_collision_of_digests_keeps_groups_apart(stored, monkeypatch):
    rows = stored([(i, t) for i, t in enumerate(["one", "two"] * 20)])
    monkeypatch.setattr(exact_dedup, "with_digests", lambda docs: docs.selectExpr("*", "unhex('00') AS digest", "3L AS n_bytes"))
    even = rows.where("text = 'one'")
    found = exact_dedup.exact_duplicates(rows.where("text = 'two'"), even)
    assert {(r.keep_id, r.group_size) for r in found.collect()} == {(38, 20), (39, 20)}


def test_the_filter_decides_what_meets_the_snapshot(stored, monkeypatch):
    rows = stored([(i, t) for i, t in enumerate(["one", "two", "three"] * 4)])
    old, new = rows.where("doc_id < 6"), rows.where("doc_id >= 6")
    found = exact_dedup.exact_duplicates(new, old)
    assert {(r.keep_id, r.group_size) for r in found.collect()} == {(9, 4), (10, 4), (11, 4)}
    # False negatives would show: without positives the batch and the snapshot stay apart.
    monkeypatch.setattr(exact_dedup, "screen", lambda groups, snapshot: groups.selectExpr("*", "false AS maybe"))
    found = exact_dedup.exact_duplicates(new, old)
    assert {(r.keep_id, r.group_size) for r in found.collect()} == {(i, 2) for i in (3, 4, 5, 9, 10, 11)}
    # False positives do not: they find no bucket.
    monkeypatch.setattr(exact_dedup, "screen", lambda groups, snapshot: groups.selectExpr("*", "true AS maybe"))
    found = exact_dedup.exact_duplicates(new.unionByName(stored([(20, "four")])), old)
    assert {(r.keep_id, r.group_size) for r in found.collect()} == {(9, 4), (10, 4), (11, 4), (20, 1)}


def test_one_row_stays_when_both_sides_have_it(stored):
    rows = stored([(1, "a"), (2, "a"), (None, "b")])
    found = exact_dedup.exact_duplicates(rows, rows).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in found) == [(0, 0, 2), (0, 0, 2), (1, 2, 4), (1, 2, 4), (2, 2, 4), (2, 2, 4)]
    assert sorted(r.doc_id or 0 for r in found if r.kept) == [0, 2]


def brute_cut(texts, length):
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] += 1
    out = []
    for t in texts:
        covered = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                covered[i:i + length] = [True] * length
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out.append((len(t), sum(covered), spans, bytes(b for b, c in zip(t, covered) if not c)))
    return out


@pytest.mark.parametrize("length,gram,group,part", [(200, 40, 50_000, 1 << 18), (50, 10, 3, 1 << 18), (50, 50, 50_000, 512), (64, 4, 5, 256)])
def test_cut_documents_match_brute_force(documents, corpus, monkeypatch, length, gram, group, part):
    monkeypatch.setattr(suffixes, "PART", part)
    suffixes._powers.cache_clear()
    found = suffixes.cut_documents(documents, length, gram, group).collect()
    got = {r.row.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, bytes(r.kept)) for r in found}
    suffixes._powers.cache_clear()
    assert got == dict(zip(range(len(corpus)), brute_cut([(t or "").encode() for _, t in corpus], length)))


def test_multikey_order_is_a_lexicographic_sort():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 4, 500), rng.integers(0, 4, 500), rng.integers(0, 4, 500)]
    order = suffixes.multikey_order(keys)
    rows = list(zip(*[k[order].tolist() for k in keys]))
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(500))


def test_odd_tables(odd, empty, corpus):
    n = odd.count()
    near = simhash.near_duplicates(odd)
    assert near.count() == n
    # The row without id or text has nothing to link to, so its component has no id either.
    assert sum(r.component_id is None for r in near.collect()) == 1
    exact = exact_dedup.exact_duplicates(*exact_dedup.halves(odd)).collect()
    assert len(exact) == n and sum(r.kept for r in exact) == len({t or "" for _, t in corpus[:80]} | {""})
    assert suffixes.cut_documents(odd).count() == n
    for op in (exact_dedup.without_duplicates, suffixes.without_repeats, lambda d: simhash.without_near_duplicates(d, 5, 7, 4)):
        assert op(odd).columns == odd.columns
        assert op(empty).count() == 0
    assert exact_dedup.without_duplicates(odd).count() == len({t or "" for _, t in corpus[:80]} | {""})
    assert simhash.near_duplicates(empty).count() == 0
