"""Plain versions of what the operators compute."""

import re
from collections import defaultdict


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def components(nodes, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in sorted(nodes):
        if start in out:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


def jaccard_links(texts, n=5, percent=80):
    """(set sizes, linked pairs) by comparing every two documents."""
    sets = {}
    for i, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, links
