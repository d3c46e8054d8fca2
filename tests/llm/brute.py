"""Plain versions of the operators for small inputs."""

import collections
import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines(docs, least=40, docs_least=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(SMALL)
    held = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= least and len(v) >= docs_least}
    return {i: "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i) for i, t in docs}


def groups(docs, width, percent=80):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(SMALL))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width, 0) + 1)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def passages(docs, length=50):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in docs}
    for i, w in words.items():
        for k in range(len(w) - length + 1):
            first[tuple(w[k : k + length])] = min(i, first.get(tuple(w[k : k + length]), i))
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < i for j in range(k, k + length)}
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def simhash(docs, width, budget=4):
    """(fingerprint, component) of each (id, text); ids are distinct."""
    fp = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(SMALL))
        parts = [" ".join(w[k : k + width]) for k in range(max(len(w) - width, 0) + 1)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return {i: (format(fp[i], "016x"), c) for i, c in linked(fp, lambda a, b: (a ^ b).bit_count() <= budget).items()}


def linked(items, near):
    label = {i: i for i in items}
    for _ in items:
        before = dict(label)
        for a in items:
            for b in items:
                if near(items[a], items[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label
    return label


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes):
    """Root, and for each node the runs on its way with its place in them."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            ways[k].append((nodes[place - place % 3 : place - place % 3 + 3], place % 3))
        nodes, at = [_h(nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], ways


def merkle(rows, received):
    """rows: dicts of the fields; a list of (leaf, subroot, root, proof, folded root), in the order of sources, ids and leaves."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: _h([show(r["doc_id"]), show(r["source"]), show(r["lang"]), show(r["n_chars"]), show(t)])
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    sources = sorted({r["source"] for r in rows}, key=order)
    trees = []
    for s in sources:
        own = sorted(((order(r["doc_id"]), leaf(r, r["text"]), leaf(r, received(r))) for r in rows if r["source"] == s))
        trees.append((own, *_tree([x[1] for x in own])))
    root, tops = _tree([t[1] for t in trees])
    out = []
    for (own, subroot, ways), top in zip(trees, tops):
        for (_, first, folded), way in zip(own, ways):
            others = []
            for run, place in [*way, *top]:
                others += run[:place] + run[place + 1 :]
                folded = _h([*run[:place], folded, *run[place + 1 :]])
            out.append((first, subroot, root, _h(others), folded))
    return out


def near_words(words):
    """Pairs one edit apart."""
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    return {(a, b) for a in words for b in words if a != b and near(a, b)}
