"""Definitions computed by enumeration, for small inputs."""

from __future__ import annotations

from itertools import combinations, permutations


def min_hitting(edges: list[set]) -> int:
    nodes = sorted(set().union(*edges)) if edges else []
    for size in range(len(nodes) + 1):
        for chosen in combinations(nodes, size):
            if all(set(chosen) & e for e in edges):
                return size
    raise AssertionError("empty edge")


def gamma(edges: list[set]) -> dict:
    nodes = set().union(*edges)
    return {t: min_hitting([e for e in edges if t not in e]) for t in nodes}


def shapley(edges: list[set]) -> dict:
    nodes = sorted(set().union(*edges))
    hits = dict.fromkeys(nodes, 0)
    orders = 0
    for order in permutations(nodes):
        orders += 1
        seen: set = set()
        for node in order:
            seen.add(node)
            if all(seen & e for e in edges):
                hits[node] += 1
                break
    return {n: h / orders for n, h in hits.items()}
