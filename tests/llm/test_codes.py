"""Vector codes against plain loops over every entry."""

import hashlib
import math

import numpy as np
import pytest

from cohortline.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, points string, part int, length long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA)


def plain(rows, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """Codes, errors and digest of vectors of one length, entry by entry."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    border = codes.cuts(len(rows[0][1]), parts)
    vectors = [[math.floor(4096 * x) for x in v] for _, v, _ in rows]
    found, errors, numbers = [""] * len(rows), [0] * len(rows), []
    for low, high in zip(border, border[1:]):
        own = [v[low:high] for v in vectors]
        book = own[:entries]
        apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        for step in range(rounds + 1):
            nearest = [min(range(len(book)), key=lambda e: (apart(p, book[e]), e)) for p in own]
            if step < rounds:
                groups = [[p for p, e in zip(own, nearest) if e == i] for i in range(len(book))]
                book = [[sum(x) // len(g) for x in zip(*g)] if g else b for g, b in zip(groups, book)]
        for i, (p, e) in enumerate(zip(own, nearest)):
            found[i] += f"{e:02x}"
            errors[i] += apart(p, book[e])
        numbers += [str(x) for b in book for x in b]
    digest = hashlib.sha256(",".join(numbers).encode()).hexdigest()
    return sorted(((r[0], r[2], c, e, digest) for r, c, e in zip(rows, found, errors)), key=repr)


@pytest.mark.parametrize("length", [16, 13])
def test_codes_match_plain_loops(shipped, rows, length):
    rng = np.random.default_rng(length)
    vectors = rng.normal(size=(600, length)).round(2)
    vectors[100:300] = vectors[100]  # a third of all rows are copies
    vectors[300:330] *= 50  # far ones
    vectors[5] = vectors[3]  # an entry twice
    given = [(i, v.tolist(), i % 3 or None) for i, v in enumerate(vectors)]
    got = codes.vector_codes(frame(shipped, given).repartition(3))
    assert rows(got, "id", "label", "code", "error", "codebooks_sha256") == plain(given)


def test_ties_copies_and_grids(shipped, rows):
    given = [(i, [float(i // 4 % 3), float(i % 2)] * 8, 1) for i in range(200)]
    assert rows(codes.vector_codes(frame(shipped, given))) == plain(given)


def test_odd_vectors(shipped, rows):
    bad = [(1, None, 1), (2, [1.0, None] * 8, 1), (3, [math.nan] * 16, 1), (4, [math.inf] * 16, 1)]
    good = [(None, [1.0] * 16, None), (5, [0.5] * 16, None), (5, [0.5] * 16, 2), (5, [0.25] * 16, 2)]
    assert rows(codes.vector_codes(frame(shipped, bad + good))) == plain(good)
    assert codes.vector_codes(frame(shipped, bad)).count() == 0
    assert codes.vector_codes(frame(shipped, [])).count() == 0
    short, empty = [(6, [0.5, -3.0], 1), (7, [0.1, 9.0], 1)], [(8, [], 1)]
    assert rows(codes.vector_codes(frame(shipped, good + short + empty))) == sorted(
        plain(good) + plain(short) + plain(empty), key=repr
    )
    (far,) = codes.vector_codes(frame(shipped, [(1, [1e300] * 16, 1)])).collect()
    assert (far["code"], far["error"]) == ("00" * 8, 0)


@pytest.mark.parametrize("size", [1, 2, 25, 700])
def test_tree_covers_and_assigns_exactly(size):
    rng = np.random.default_rng(size)
    points = rng.integers(-50, 50, (size, 5))
    points[: size // 3] = points[0]
    tree = codes.CoverTree.unpacked(*codes.CoverTree.grow(points).packed())
    assert (tree.points == points[tree.order]).all()
    for start, end, radius2, child, children in zip(tree.start, tree.end, tree.radius2, tree.child, tree.children):
        assert codes.squared(tree.points[start:end], tree.points[start : start + 1]).max() == radius2
        if children:
            heads = tree.points[tree.start[child : child + children]]
            assert (4 * tree.radius2[child : child + children] <= radius2).all()
            apart = codes.squared(heads, heads)[~np.eye(children, dtype=bool)]
            assert (4 * apart > radius2).all()
    entries = np.concatenate((points[:3], rng.integers(-50, 50, (9, 5)), points[:2]))
    found, errors = tree.coded(entries)
    distance = codes.squared(points, entries)
    assert (found == distance.argmin(1)).all() and (errors == distance.min(1)).all()
    sums, counts = tree.totals(entries)
    assert counts.sum() == size and (counts == np.bincount(found, minlength=len(entries))).all()
    assert all((sums[e] == points[found == e].sum(0)).all() for e in range(len(entries)))


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-9, 9, (500, 4)) + 1000 * k for k in range(4)])
    tree = codes.CoverTree.grow(points)
    start, end, _ = tree.assigned(np.arange(4)[:, None] * np.full(4, 1000))
    assert len(start) < 20 and (end - start).sum() == len(points)
