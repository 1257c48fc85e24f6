"""Placement of data-fetching steps ('mods') in a small process graph, on the driver.

A graph is {node: [successors]}; needs are {node: {parameters}}; a mod is (name, inputs, outputs).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

Mod = tuple[str, frozenset, frozenset]


def mod(name: str, inputs: Iterable[str], outputs: Iterable[str]) -> Mod:
    return name, frozenset(inputs), frozenset(outputs)


def ordered(mods: Iterable[Mod], available: Iterable[str] = ()) -> list[str]:
    """B1, B2: mods in an order in which their inputs exist; inputs at hand don't count, cyclic mods come last as given."""
    left, made, out = list(mods), set(available), []
    outputs = {o for m in left for o in m[2]}
    while ready := [m for m in left if all(i in made or i not in outputs for i in m[1])]:
        out.append(ready[0][0])
        made |= ready[0][2]
        left.remove(ready[0])
    return out + [m[0] for m in left]


def required(params: Iterable[str], mods: Iterable[Mod], available: Iterable[str] = ()) -> list[str]:
    """The mods that give the parameters, directly or for another such mod, in order."""
    mods, have, todo, chosen = list(mods), set(available), list(params), {}
    while todo:
        p = todo.pop()
        m = next((m for m in mods if p in m[2]), None) if p not in have else None
        if m and m[0] not in chosen:
            chosen[m[0]] = m
            todo += m[1]
    return ordered([m for m in mods if m[0] in chosen], have)


def below(graph: dict[str, list[str]], node: str) -> set[str]:
    """A node and all that can follow it."""
    seen, todo = set(), [node]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += graph.get(n, [])
    return seen


def depths(graph: dict[str, list[str]], start: str) -> dict[str, int]:
    out, front = {start: 0}, [start]
    while front:
        front = [m for n in front for m in graph.get(n, []) if out.setdefault(m, out[n] + 1) == out[n] + 1 and m not in front]
        front = list(dict.fromkeys(front))
        if len(out) == len({*graph, *(m for v in graph.values() for m in v)}) and not any(m not in out for n in front for m in graph.get(n, [])):
            break
    return out


def common_ancestor(graph: dict[str, list[str]], start: str, nodes: Iterable[str]) -> str | None:
    """The deepest node from which all given ones can be reached; of a single node its first predecessor."""
    nodes = sorted(set(nodes))
    depth = depths(graph, start)
    if len(nodes) == 1:
        before = [n for n in sorted(graph, key=lambda n: (depth.get(n, 1 << 30), n)) if nodes[0] in graph[n]]
        return before[0] if before else None
    shared = [n for n in depth if all(x in below(graph, n) for x in nodes)]
    return max(shared, key=lambda n: (depth[n], n)) if shared else None


def simple_paths(graph: dict[str, list[str]], a: str, b: str) -> Iterator[list[str]]:
    """All paths without a repeated node."""
    stack = [[a]]
    while stack:
        path = stack.pop()
        if path[-1] == b:
            yield path
            continue
        stack += [[*path, n] for n in reversed(graph.get(path[-1], [])) if n not in path]


def branch_aware(graph: dict[str, list[str]], start: str, splits: set[str], needs: dict[str, set[str]], mods: list[Mod], available: Iterable[str] = ()) -> list[tuple[str, str]]:
    """(mod, node before which it runs): what all branches of a split need comes once before the split, the rest
    before the branches that need it, split by split; on a linear stretch a mod comes before the first node in need."""
    out: list[tuple[str, str]] = []

    def visit(node: str, have: frozenset, seen: frozenset) -> None:
        if node in seen:
            return
        following = graph.get(node, [])
        if node in splits and len(following) > 1:
            wanted = [set(required(set().union(*(needs.get(x, set()) for x in below(graph, b))), mods, have)) for b in following]
            now = set.intersection(*wanted) if wanted else set()
        else:
            now = set(required(needs.get(node, set()), mods, have))
        chosen = [m for m in mods if m[0] in now]
        for name in ordered(chosen, have):
            out.append((name, node))
        have = have.union(*(m[2] for m in chosen)) if chosen else have
        for n in following:
            visit(n, have, seen | {node})

    visit(start, frozenset(available), frozenset())
    return list(dict.fromkeys(out))


def nca_placement(graph: dict[str, list[str]], start: str, needs: dict[str, set[str]], mods: list[Mod], available: Iterable[str] = ()) -> list[tuple[str, str]]:
    """(mod, node after which it runs): each mod once, at the common ancestor of all nodes in need of it; the mods
    that it depends on come before it at the same place or above."""
    users: dict[str, set[str]] = {}
    for node, params in needs.items():
        for name in required(params, mods, available):
            users.setdefault(name, set()).add(node)
    depth = depths(graph, start)
    at = {name: common_ancestor(graph, start, nodes) or start for name, nodes in users.items()}
    by_name = {m[0]: m for m in mods}
    for name in reversed(ordered([by_name[n] for n in at], available)):
        for i in by_name[name][1]:
            for other in required({i}, mods, available):
                if other in at and depth.get(at[other], 0) > depth.get(at[name], 0):
                    at[other] = at[name]
    return [(n, at[n]) for n in ordered([by_name[n] for n in at], available)]


def placement_errors(graph: dict[str, list[str]], start: str, placed: list[tuple[str, str]], mods: list[Mod], available: Iterable[str] = ()) -> list[tuple[str, str]]:
    """(mod, missing input) where a mod runs before an input that some mod gives, in depth order."""
    depth, by_name = depths(graph, start), {m[0]: m for m in mods}
    have, out = set(available), []
    outputs = {o for m in mods for o in m[2]}
    for name, _ in sorted(placed, key=lambda p: depth.get(p[1], 0)):
        out += [(name, i) for i in sorted(by_name[name][1]) if i in outputs and i not in have]
        have |= by_name[name][2]
    return out
