import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tidegauge.llm import codes, whitening
from tidegauge.llm.codes import Tree, cover_tree, vector_codes
from tidegauge.llm.whitening import whitened

VECTORS = "vec_id long, embedding array<float>, label int"


def made(rng, n, width, centres=5):
    middle = rng.normal(0, 0.3, (centres, width))
    return (middle[rng.integers(0, centres, n)] + rng.normal(0, 0.05, (n, width))).astype(np.float32)


def brute_codes(rows, parts, entries, rounds, scale):
    """Lloyd as the contract words it, one vector after the other."""
    kept = [(i, [math.floor(scale * float(v)) for v in x], label) for i, x, label in rows if x and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(x[p * width:(p + 1) * width]) for p in range(parts)] for _, x, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = defaultdict(list)
            for c in cut:
                held[nearest(c[p], book)[1]].append(c[p])
            for k, own in held.items():
                book[k] = [sum(v) // len(own) for v in zip(*own)]
    found, by_label = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut):
        best = [nearest(x, book) for x, book in zip(c, books)]
        found.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        by_label[label] += found[-1][2]
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return sorted(((i, code, error, by_label[label], digest) for i, code, error, label in found), key=repr)


@pytest.fixture(scope="module")
def vectors(stored):
    """Clusters, repeated rows and vectors, a hot label, and every kind of row that is dropped."""
    rng = np.random.default_rng(3)
    rows = [(int(i), x.tolist(), None if i % 7 == 0 else int(i % 3) * (i > 100)) for i, x in enumerate(made(rng, 300, 16))]
    rows += rows[40:60] + [(500 + i, rows[3][1], 1) for i in range(120)] + [(None, rows[9][1], None), (None, rows[8][1], 2)]
    bad = [(-1, None, 1), (-2, [], 1), (-3, [None] + [0.5] * 15, 1), (-4, [float("nan")] * 16, None), (-5, [float("-inf")] + [0.1] * 15, 2)]
    return rows, stored(rows + bad, VECTORS)


def points_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_nodes_cover_their_subtrees():
    rng = np.random.default_rng(4)
    for points in (rng.integers(-500, 500, (400, 3)), np.zeros((50, 2), np.int64), np.array([[7]]), rng.integers(0, 2, (200, 4))):
        tree = Tree.from_bytes(cover_tree(points, 4).to_bytes())
        assert sorted(tree.place.tolist()) == list(range(len(points))) and (tree.points == points[tree.place]).all()
        for v in range(len(tree.centre)):
            own = tree.points[tree.low[v]:tree.high[v]]
            assert np.sqrt(((own - tree.points[tree.centre[v]]) ** 2).sum(1)).max() <= tree.radius[v] + 1e-9
            children = range(tree.child_low[v], tree.child_high[v])
            if len(children):
                assert [tree.low[v], *(tree.high[c] for c in children)] == [*(tree.low[c] for c in children), tree.high[v]]
                assert max(tree.radius[c] for c in children) <= tree.radius[v] / 2
                middle = tree.points[tree.centre[list(children)]]
                apart = np.sqrt(((middle[:, None] - middle[None]) ** 2).sum(2)) + np.eye(len(middle)) * 1e9
                assert apart.min() > tree.radius[v] / 2


def test_subtrees_are_assigned_as_single_points_are():
    rng = np.random.default_rng(5)
    skipped = 0
    for spread in (3, 40, 400):
        points = rng.integers(-1000, 1000, (8, 3))[rng.integers(0, 8, 900)] + rng.integers(-spread, spread, (900, 3))
        tree, book = cover_tree(points), points[rng.integers(0, 900, 6)]
        book[5] = book[2]  # equal entries: the lower index
        want = codes.squares(points, book).argmin(1)
        code, error = codes.codes_of(tree, book)
        assert (code == want).all() and (error == codes.squares(points, book).min(1)).all()
        total, count = codes.sums_of(tree, book)
        assert (count == np.bincount(want, minlength=6)).all()
        assert (total == np.array([points[want == k].sum(0) for k in range(6)])).all()
        ranges = list(codes.regions(tree, book))
        skipped += sum(int((high - low > 1).sum()) for _, low, high in ranges)
        assert sorted(np.concatenate([codes._spread(low, high) for _, low, high in ranges]).tolist()) == list(range(900))
    assert skipped  # some subtrees were never opened


@pytest.mark.parametrize("parts,entries,rounds,block", [(8, 16, 6, 2048), (4, 5, 3, 37), (2, 44, 2, 64), (16, 1, 2, 50)])
def test_codes_match_brute_force(vectors, monkeypatch, parts, entries, rounds, block):
    rows, df = vectors
    monkeypatch.setattr(codes, "BLOCK", block)
    assert points_of(vector_codes(df, parts, entries, rounds)) == brute_codes(rows, parts, entries, rounds, 4096)


def test_codes_do_not_depend_on_how_rows_are_dealt(vectors):
    _, df = vectors
    assert points_of(vector_codes(df.repartition(9))) == points_of(vector_codes(df.coalesce(1)))


def test_codes_of_odd_tables(stored, vectors):
    rows, df = vectors
    few = rows[:3] + [rows[0]]
    assert points_of(vector_codes(stored(few, VECTORS))) == brute_codes(few, 8, 16, 6, 4096)
    same = [(i, rows[0][1], None) for i in range(40)]
    found = points_of(vector_codes(stored(same, VECTORS)))
    assert {r[1:4] for r in found} == {("00" * 8, 0, 0)} and len(found) == 40
    none = vector_codes(df.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes(stored([(1, None, 1), (2, [], None)], VECTORS)).count() == 0
    named = [(i, x, str(label), 1, "a", 2.0, 3) for i, x, label in rows[:50]]
    extra = stored(named, "vec_id long, embedding array<double>, label string, id int, code string, error double, x int")
    assert points_of(vector_codes(extra)) == brute_codes([(i, x, str(label)) for i, x, label in rows[:50]], 8, 16, 6, 4096)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes(stored([(1, [0.1] * 9, 1)], VECTORS))
    with pytest.raises(Exception, match="must have 16 entries"):
        vector_codes(stored([(1, [0.1] * 16, 1), (2, [0.1] * 8, 1)], VECTORS)).collect()
    with pytest.raises(Exception, match="too large"):
        vector_codes(stored([(1, [0.1] * 15 + [5000.0], 1)], VECTORS)).collect()


def brute_whitened(rows, used):
    kept = sorted(((i, x) for i, x, _ in rows if x and all(v is not None and math.isfinite(v) for v in x)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(64 * float(v)) + 1_000_000 for v in r[1]] for r in kept])
    n, sums = len(x), x.sum(0)
    middle = (n * x - sums) / n
    values, axes = np.linalg.eigh(middle.T @ middle / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, [r[0] for r in kept], ((n * x - sums) ** 2).sum(1), values, middle @ axes[:, :used]


def by_row(df, used):
    """Values per row and component, rows sorted as in brute_whitened up to equal ids."""
    table = defaultdict(list)
    for r in df.collect():
        table[r.vec_id].append(r)
    return table


@pytest.mark.parametrize("block,used", [(None, 32), (64, 32), (50, 5), (7, 16), (1000, 3)])
def test_whitened_match_brute_force(vectors, block, used):
    rows, df = vectors
    rows = [r for r in rows if r[0] is not None and r[0] < 300][:300]
    own = df.where("vec_id < 300 AND vec_id >= 0").dropDuplicates(["vec_id"])
    n, ids, deviation, values, turned = brute_whitened(rows, used)
    used = min(used, 16)
    found = sorted(whitened(own, used, block=block).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in found] == [(i, k + 1) for i in ids for k in range(used)]
    assert [r.deviation for r in found] == np.repeat(deviation, used).tolist() and {r.n for r in found} == {n}
    got, want = np.array([r.whitened for r in found]).reshape(n, used), turned[:, :used] / np.sqrt(values[:used])
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-9
    assert np.allclose([r.explained for r in found[:used]], values[:used] / values.sum(), rtol=1e-10)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


def test_whitened_counts_repeated_and_null_ids(vectors):
    rows, df = vectors
    n, ids, deviation, values, _ = brute_whitened(rows, 16)
    found = whitened(df, block=100).collect()
    assert len(found) == n * 16 and {r.n for r in found} == {n}
    assert sorted((repr(r.vec_id), r.deviation) for r in found if r.component == 1) == sorted((repr(i), d) for i, d in zip(ids, deviation.tolist()))
    matrix = defaultdict(list)
    for r in found:
        matrix[r.component].append(r.whitened)
    assert np.allclose([np.var(v) for v in matrix.values()], 1) and found[0].identity_error < 1e-6


def test_whitened_of_odd_tables(stored, vectors):
    rows, df = vectors
    assert whitened(df.limit(0)).count() == 0
    assert whitened(stored([(1, None, 1), (2, [], 2)], VECTORS)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitened(stored([(5, [0.25, 0.5], 1)], VECTORS)).collect()
    assert [tuple(r) for r in one] == [(5, 1, 1, 0, None, None, None), (5, 2, 1, 0, None, None, None)]
    # Two vectors vary in one direction only.
    two = sorted(whitened(stored([(1, [0.0, 0.0, 1.0], 1), (2, [1.0, 2.0, 1.0], None)], VECTORS)).collect())
    assert [(r.vec_id, r.component, r.whitened is None) for r in two] == [(i, k, k > 1) for i in (1, 2) for k in (1, 2, 3)]
    assert sorted(abs(r.whitened) for r in two if r.whitened) == pytest.approx([1, 1])
    assert [r.explained for r in two[:3]] == pytest.approx([1, 0, 0]) and two[0].identity_error < 1e-9
    extra = stored([(i, x, 1, 2, "a", 3) for i, x, _ in rows[:30]], "vec_id long, embedding array<double>, id int, number int, x string, block int")
    assert whitened(extra, 2).count() == 60
    with pytest.raises(ValueError, match="entries"):
        whitened(stored([(1, [0.1] * 3, 1), (2, [0.1] * 2, 1)], VECTORS))
    with pytest.raises(Exception, match="too large"):
        whitened(stored([(1, [0.1, 2.0**25], 1)], VECTORS)).collect()


def test_blocks_grow_with_the_table():
    sizes = [whitening.block_size(n) for n in (10, 10**6, 10**8, 10**12)]
    assert sizes == [1024, 1024, 5000, 32_768]
