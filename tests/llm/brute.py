"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def kept_words(texts, window):
    """(words, kept words) of each text, without words of windows that start twice anywhere."""
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((w, [x for i, x in enumerate(w) if i not in gone]))
    return out


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def leaks(text, items, window):
    """(number of words, hit places, item ids)."""
    w, hit, found = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(name)
    return len(w), hit, found


def shingle_set(text, width):
    w = words(lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def classes(docs, width, percent):
    """{id: least id of its component} by all pairs."""
    sets = [(i, shingle_set(t, width)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in docs}


def quality_base(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += line in seen
        if words(line):
            seen.add(line)
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    again = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again)


def mix_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """{source: target} by resharing until none is above its limit; None sorts last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * left / total > most * sizes[s]} if total else set()
        if not over:
            return out | {s: weight[s] * left / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
