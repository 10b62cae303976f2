"""Plain versions of the operators, straight from their definitions."""

import hashlib
import re
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def union(nodes, edges):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text, size):
    words = BLANK.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_duplicates(docs, size=3, percent=90):
    """{doc_id: (n_shingles, component)} of {doc_id: text}."""
    sets = {d: shingle_set(t, size) for d, t in docs.items()}
    edges = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    parts = union(sets, edges)
    return {d: (len(s), parts[d]) for d, s in sets.items()}


def cut_repeats(docs, window=20):
    """{doc_id: (words, removed, kept text)}."""
    words = {d: BLANK.findall(t or "") for d, t in docs.items()}
    seen, gone = set(), {d: set() for d in docs}
    for d in sorted(docs):
        for i in range(len(words[d]) - window + 1):
            w = tuple(words[d][i : i + window])
            if w in seen:
                gone[d].update(range(i, i + window))
            seen.add(w)
    return {d: (len(w), len(gone[d]), " ".join(x for i, x in enumerate(w) if i not in gone[d])) for d, w in words.items()}


def contamination(text, items, window=13):
    """(words, hit, sorted items) of a text; items: [(item_id, text)]."""
    words = ALNUM.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for name, item in items:
        w = ALNUM.findall((item or "").translate(LOWER))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[s : s + n]:
                    hit.update(range(i, i + n))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def toxicity_features(lexicon, text):
    """(hits, density, words) of a text without an automaton: at each word's beginning the longest pattern, unless a
    phrase covers it."""
    from fleetlane.llm import toxicity

    folded = f" {' '.join(toxicity.fold(text).split())} "
    phrases = {f" {' '.join(toxicity.fold(x).split())} " for x in lexicon.phrases}
    starts = [s for s, c in enumerate(folded) if c == " "]
    covered = [(s, s + n) for s in starts for n in {len(p) for p in phrases} if folded[s : s + n] in phrases]
    sizes = sorted({len(p) for p in lexicon.weights}, reverse=True)
    found = []
    for s in starts:
        best = next((folded[s : s + n] for n in sizes if folded[s : s + n] in lexicon.weights), None)
        if best and lexicon.weights[best] and not any(a <= s + 1 and s + len(best) <= b for a, b in covered):
            found.append(lexicon.weights[best])
    words = len(folded.split())
    return len(found), max(0.0, sum(found)) / (words + toxicity.EXTRA_WORDS), words
