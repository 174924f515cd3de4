"""Plain versions of the operators, to hold results against on small tables."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def near_duplicates(rows, percent, k=5):
    sets = {d: shingles(t, k) for d, t in rows}
    holds = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holds[x].append(d)
    links = set()
    for d, s in sets.items():
        for e in {e for x in s for e in holds[x] if e > d}:
            both = len(s & sets[e])
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                links.add((d, e))
    return sets, components(sets, links)


def without_repeats(rows, least):
    """[(id, words kept, words, removed)] where every window of ``least`` words that starts elsewhere too is cut."""
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = defaultdict(int)
    for w in texts:
        for i in range(len(w) - least + 1):
            seen[tuple(w[i : i + least])] += 1
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - least + 1):
            if seen[tuple(w[i : i + least])] > 1:
                gone |= set(range(i, i + least))
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


def url_templates(pages, labels, urls):
    """{(host, path): (template, rejected)} by a plain tree: wildcards, then merged branches, level by level."""
    marks = {}
    for i, bad in labels:
        if i is not None and bad in (0, 1):
            marks[i] = max(bad, marks.get(i, 0))
    rows = []
    for i, u in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        parts = [re.sub(r"[0-9]+", "*", re.sub(r"(?i)(?=[0-9a-f-]*[0-9])[0-9a-f]{8,}(?:-[0-9a-f]{4,})*", "*", x)) for x in path.split("/") if x]
        if len(parts) > urls.LEVELS:
            parts = [*parts[: urls.LEVELS - 1], "/".join(parts[urls.LEVELS - 1 :])]
        rows.append([host, path, parts or [""], marks.get(i)])
    known = [r[3] for r in rows if r[3] is not None]
    prior = sum(known) / len(known) if known else 0.0
    for level in range(urls.LEVELS):
        nodes = defaultdict(lambda: defaultdict(list))
        for r in rows:
            if len(r[2]) > level:
                nodes[r[0], tuple(r[2][:level])][r[2][level]].append(r)
        for children in nodes.values():
            if len(children) > urls.CHILDREN and sum(map(len, children.values())) < urls.REPEATS * len(children):
                every = [r for held in children.values() for r in held]
                for r in every:
                    r[2] = [*r[2][:level], "*", *r[2][level + 1 :]]
                children.clear()
                children["*"] = every
            count = {c: ([r[3] for r in held if r[3] is not None]) for c, held in children.items()}
            pool = [x for v in count.values() for x in v]
            share = sum(pool) / len(pool) if pool else None
            alike = [c for c, v in count.items() if not v or abs(sum(v) / len(v) - share) <= urls.Z * (share * (1 - share) / len(v)) ** 0.5 + 1e-12]
            if len(alike) > 1:
                for c in alike:
                    for r in children[c]:
                        r[2] = [*r[2][:level], None, *r[2][level + 1 :]]
    leaves = defaultdict(list)
    for r in rows:
        leaves[r[0], tuple(r[2])].append(r[3])
    out = {}
    for host, path, t, _ in rows:
        v = [x for x in leaves[host, tuple(t)] if x is not None]
        out[host, path] = ("/" + "/".join("+" if x is None else x for x in t), (sum(v) + urls.PRIOR * prior) / (len(v) + urls.PRIOR) > urls.CUTOFF)
    return out
