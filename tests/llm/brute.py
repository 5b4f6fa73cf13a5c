"""Plain versions of the operators, on lists in memory, to hold results against."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Forest:
    def __init__(self, nodes):
        self.top = {n: n for n in nodes}

    def find(self, x):
        while self.top[x] != x:
            x = self.top[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.top[max(a, b)] = min(a, b)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def jaccard_components(docs):
    """{id: (shingles, component)} of (id, text)."""
    sets = {i: shingles(t) for i, t in docs}
    lists = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    forest = Forest(sets)
    for i, s in sets.items():
        for j, both in collections.Counter(j for g in s for j in lists[g]).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                forest.link(i, j)
    return {i: (len(s), forest.find(i)) for i, s in sets.items()}


def substring_dedup(docs, size=50):
    """{id: (words, removed, kept)} of (id, text) with distinct ids."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    first: dict = {}
    for i, w in words.items():
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        stay = [True] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                stay[p : p + size] = [False] * size
        out[i] = len(w), stay.count(False), " ".join(x for x, s in zip(w, stay) if s)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def path_posteriors(rows):
    """(corpus mean, for each of the (host, path, risk) rows the posterior mean of its path without the row)."""
    corpus = sum(p for *_, p in rows) / len(rows)
    hosts, paths = {}, {}
    for host, path, p in rows:
        hosts.setdefault(host, []).append(p)
        paths.setdefault((host, path), []).append(p)

    def mean(values):
        return sum(values) / len(values)

    def strength(groups):
        """Of (values, the mean they are shrunk to): how many rows that mean counts for."""
        spread = sum(len(v) * (mean(v) - m) ** 2 - m * (1 - m) for v, m in groups)
        within = sum(len(v) * m * (1 - m) for v, m in groups)
        return min(max(within / spread, 1.0), 1e6) if spread > 0 else 1e6

    k_host = strength([(v, corpus) for v in hosts.values()])
    k_path = strength([(v, mean(hosts[h])) for (h, _), v in paths.items()])
    out = []
    for host, path, p in rows:
        h, v = hosts[host], paths[host, path]
        host_mean = (sum(h) - p + k_host * corpus) / (len(h) - 1 + k_host)
        out.append((sum(v) - p + k_path * host_mean) / (len(v) - 1 + k_path))
    return corpus, out


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def divergence(rows, least=3, top=200):
    """Sorted (lang, source, part, item, value, rank) of (lang, source, text) rows."""
    docs = [(g or "", s or "", TERM.findall((t or "").translate(LOWER))) for g, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == lang]
        df = collections.Counter(t for _, terms in own for t in set(terms))
        kept = sorted(t for t, n in df.items() if n >= least)
        count = collections.defaultdict(collections.Counter)
        for s, terms in own:
            count[s].update(t for t in terms if df[t] >= least)
        every = sum(count.values(), collections.Counter())

        def share(c):
            n = sum(c.values())
            return [1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept]

        shares, q = {s: share(c) for s, c in count.items()}, share(every)
        for s in count:
            pairs = [(r, sum((a - b) ** 2 // b for a, b in zip(shares[s], shares[r]))) for r in count if r != s]
            terms = [(t, (a - b) ** 2 // b) for t, a, b in zip(kept, shares[s], q) if count[s][t] and a > b]
            for part, found in ("pair", pairs), ("term", terms):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def filter_audit(docs, labels):
    """Sorted rows of the audit, each order run over the documents, of (doc_id, lang, text) and (doc_id, quality, toxic)."""
    import itertools

    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)

    def fails(i, t):
        w = WORD.findall(t)
        upper = sum("A" <= c <= "Z" for c in t)
        late = i is not None and i > least[t]
        return {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * upper > 3 * len(t), any(c in "#$%&*|" for c in t), late)) if x}

    good, toxic = ({x[0] for x in labels if x[0] is not None and x[k] == 1} for k in (1, 2))
    out = []
    for part in {g or "" for _, g, _ in docs}:
        own = [(i, fails(i, t or "")) for i, g, t in docs if (g or "") == part]
        rows, shapley = [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                hit = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(hit)
                redundant = sum(f in d[1] for d in own) - len(hit)
                rows.append(("".join(order), k + 1, f, len(left), len(hit), redundant, sum(d[1] == {f} for d in own), sum(d[0] in good for d in hit), sum(d[0] in toxic for d in hit)))
        out += [(part, o, k, *rest, shapley[f]) for o, k, f, *rest in rows]
    return sorted(out)
