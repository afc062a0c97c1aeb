"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import sentencepiece
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(rows, window=13):
    """rows: (id, text) -> (id, n_words, n_removed, kept)"""
    least = {}
    big = float("inf")
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, big), big if i is None else i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < (big if i is None else i):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def encoded(texts, model):
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = [sp.encode(t or "") for t in texts]
    return [(x, sp.decode(x)) for x in ids]


def simhash(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(points, radius):
    """points -> smallest index reachable, all pairs compared."""
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(points))]


def unigram(rows):
    """rows: (id, text, train) -> (id, tokens, known, train_tokens, base)"""
    counts = Counter()
    tokens = []
    for i, t, train in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        tokens.append(words(low) + [None])
        if train:
            counts.update(tokens[-1])
    n, v = sum(counts.values()), len(counts)
    return [
        (i, len(ts), sum(counts[x] > 0 for x in ts), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts))
        for (i, _, _), ts in zip(rows, tokens)
    ]


def tree_score(rows, depth, min_share, min_gain, smoothing, discount):
    """The suffix tree by dictionaries."""

    def sequence(t):
        low = (t or "").encode().lower().split()
        return b"\n" * depth + b" ".join(low + [b""]) + b"\n"

    tables = [defaultdict(Counter) for _ in range(depth + 1)]
    for _, t, train in rows:
        if train:
            s = sequence(t)
            for p in range(depth, len(s)):
                for k in range(depth + 1):
                    tables[k][s[p - k : p]][s[p]] += 1
    total = sum(tables[0][b""].values()) if tables[0] else 0
    kept = {b""} if total else set()
    for k in range(depth, 0, -1):
        for c, nxt in tables[k].items():
            n = sum(nxt.values())
            up = tables[k - 1][c[1:]]
            m = sum(up.values())
            gain = sum(x * math.log(x / n * m / up[a]) for a, x in nxt.items())
            if n >= min_share * total and gain >= min_gain:
                kept |= {c[j:] for j in range(k)}

    def chance(c, a):
        if c not in kept:
            return 1 / 256 if not c else chance(c[1:], a)
        above = chance(c[1:], a) if c else 1 / 256
        return (tables[len(c)][c][a] + smoothing * above) / (sum(tables[len(c)][c].values()) + smoothing)

    def next_score(c, a):
        while c and c not in kept:
            c = c[1:]
        return math.log10(chance(c, a))

    counts = Counter()
    for _, t, train in rows:
        if train:
            counts.update((t or "").encode().lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    unseen = (sum(x == 1 for w, x in counts.items() if w is not None) + 1) / (n + 2)
    out = []
    for _, t, _ in rows:
        s, begin, score = sequence(t), depth, 0.0
        for token in (t or "").encode().lower().split() + [None]:
            end = begin + (1 if token is None else len(token) + 1)
            spelled = sum(next_score(s[p - depth : p], s[p]) for p in range(begin, end))
            begin = end
            share = (max(counts[token] - discount, 0) + discount * v * 10**spelled) / max(n, 1)
            score += math.log10((1 - unseen) * share if counts[token] else unseen)
        out.append(score)
    return out


def errors(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def least_errors(word, words, stems, allowed):
    """The fewest errors at which a word is one of the terms or begins with a stem, within those allowed; else None."""
    found = []
    for term, is_stem in [(w, False) for w in words] + [(s, True) for s in stems]:
        if is_stem:
            column, least = list(range(len(term) + 1)), len(term)
            for i, x in enumerate(word, 1):
                last, column[0] = column[0], i
                for j, y in enumerate(term, 1):
                    last, column[j] = column[j], min(column[j] + 1, column[j - 1] + 1, last + (x != y))
                least = min(least, column[-1])
        else:
            least = errors(word, term) if abs(len(word) - len(term)) <= allowed(len(term)) else len(term) + len(word)
        found += [least] if least <= allowed(len(term)) else []
    return min(found, default=None)
