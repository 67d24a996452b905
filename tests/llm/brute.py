"""Plain versions that the operators are held against."""

import hashlib
from collections import Counter


def byte_dedup(rows, length=200):
    data = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def word_dedup(rows, window=13):
    import re

    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[i : i + window])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def ngram_join(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, shingles(t))
    group = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                changed = True
    return [(d, len(sets[d]), group[d]) for d, _ in rows]


def decontaminate(rows, items, window=13):
    import re

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    wins = {}
    for name, t in items:
        w = find(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for d, t in rows:
        w = find(t)
        hit, names = set(), set()
        for key, who in wins.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i : i + len(key)]) == key:
                    hit |= set(range(i, i + len(key)))
                    names |= who
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def secrets_base(text):
    import re

    text = text or ""
    rules = (
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
        (r"AKIA[A-Z0-9]+", 0, 0, 20),
        (r"[0-9a-f]+", 0, 0, 24),
    )
    out = []
    for k, (rule, flags, part, least) in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule, text, flags) if len(m.group(part)) >= least]
    return sorted(out)


def linked(text, base, weak):
    """Base spans and those weak ones, overlapping no base span, that have each part they ask for in their block and beside them."""
    import re

    cuts = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    block = lambda at: sum(c <= at for c in cuts)
    free = [x for x in weak if not any(x[0] < e and s < x[2] for s, _, e in base)]
    asks = {3: [{0, 2, 4}], 4: [{1, 3}], 5: [{1, 3}, {0, 2, 4}]}

    def beside(x, kinds):
        return any(k in kinds and block(s) == block(x[0]) and (e <= x[0] or s >= x[2]) for s, k, e in [*base, *free])

    return sorted([*base, *(x for x in free if all(beside(x, kinds) for kinds in asks[x[1]]))])


class KneserNey:
    """Interpolated Kneser-Ney of one class, from dictionaries: pairs of words, words by continuations, stems, shared counts."""

    def __init__(self, texts, corpus, words_of, discount=1.5, stems=(7, 5)):
        self.d, self.stems = discount, stems
        self.pairs = Counter(p for t in texts for p in {(v, w) for v, w in zip([b"", *words_of(t)], words_of(t), strict=False)})
        self.follows = Counter(w for _, w in self.pairs)
        self.shared = Counter(w for t in corpus for w in set(words_of(t)))
        self.total = sum(self.shared.values())

    def interpolated(self, counts, key, below):
        total = max(sum(counts.values()), 1)
        spare = max(sum(min(c, self.d) for c in counts.values()) / total, 1e-6)
        return max(counts.get(key, 0) - self.d, 0) / total + spare * below

    def stem(self, s, k):
        corpus = Counter()
        for w, n in self.shared.items():
            corpus[w[:k]] += n
        known = Counter(x for x in {w: w[:k] for w in self.follows}.values())
        if k == min(self.stems):
            return self.interpolated(known, s, corpus[s] / self.total)
        shorter = min(self.stems)
        above = sum(n for w, n in self.shared.items() if w[:shorter] == s[:shorter])
        return self.interpolated(known, s, self.stem(s[:shorter], shorter) * corpus[s] / above)

    def word(self, w):
        longer = max(self.stems)
        above = sum(n for x, n in self.shared.items() if x[:longer] == w[:longer])
        return self.interpolated(self.follows, w, self.stem(w[:longer], longer) * self.shared[w] / above)

    def after(self, v, w):
        own = {b: n for (a, b), n in self.pairs.items() if a == v}
        if not own:
            return self.word(w)
        total = sum(own.values())
        return max(own.get(w, 0) - self.d, 0) / total + max(sum(min(c, self.d) for c in own.values()) / total, 1e-6) * self.word(w)


def redacted(text, kinds, weak_spans):
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names them all."""
    spans = linked(text, secrets_base(text), weak_spans(text))
    groups = []
    for s, k, e in spans:
        if groups and s < groups[-1][2]:
            groups[-1][2] = max(groups[-1][2], e)
        else:
            groups.append([s, k, e])
    for s, k, e in reversed(groups):
        text = text[:s] + f"[{kinds[k]}]" + text[e:]
    return text
