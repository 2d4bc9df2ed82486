"""Pairs of nodes that a traversal opens, and its results wherever it begins."""

import numpy as np
import pytest

from dialoglens.llm import covertree


def tree(points, first=0):
    return covertree.Tree(np.arange(first, first + len(points)), np.ones(len(points), np.int64), points, np.array(covertree.build_tree(points)))


def vectors(seed, n, width, spread):
    """Random vectors, near copies of some, and a group within `spread` of one."""
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, width))
    near = base[: n // 8] + draw.normal(size=(n // 8, width)) * 0.1
    shared = np.random.default_rng(0).normal(size=width)
    return covertree.unit(np.concatenate([base, near, shared + draw.normal(size=(n // 8, width)) * spread]))


def test_random_vectors_are_not_opened_pair_by_pair(monkeypatch):
    left, right = tree(vectors(1, 800, 32, 0.5)), tree(vectors(2, 800, 32, 0.5), 5000)
    opened, plain = [], covertree.cosines
    monkeypatch.setattr(covertree, "cosines", lambda a, b, u, v: (opened.append(len(u)), plain(a, b, u, v))[1])
    for other in (None, right):
        opened.clear()
        covertree.traverse(left, other)
        assert sum(opened) < len(left.ids) ** 2 / 40


@pytest.mark.parametrize(("width", "spread"), [(2, 0.2), (8, 0.2), (64, 0.5), (64, 0.05)])
def test_any_beginning_finds_all_pairs(monkeypatch, width, spread):
    one, two = vectors(3, 400, width, spread), vectors(4, 300, width, spread)
    left, right = tree(one), tree(two, 5000)
    met = np.concatenate([one, two]) @ np.concatenate([one, two]).T >= covertree.COSINE
    inside = met[: len(one), : len(one)].sum(axis=1) - 1
    across = met[: len(one), len(one):]
    for level in range(len(covertree.LEVELS)):
        monkeypatch.setattr(covertree.Traversal, "top", lambda self, level=level: level)
        assert covertree.traverse(left, None).counts.tolist() == inside.tolist()
        assert covertree.traverse(left, right).counts.tolist() == [*across.sum(axis=1), *across.sum(axis=0)]
    monkeypatch.undo()
    assert covertree.traverse(left, right).counts.tolist() == [*across.sum(axis=1), *across.sum(axis=0)]
