"""Plain versions of what the operators compute."""

import hashlib
import itertools
import re
from collections import Counter

import xxhash


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """{id: smallest id reachable} from {id: fingerprint}."""
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def contamination(docs, items):
    windows = {}
    for i, t in items:
        w = terms(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = terms(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def repeats(docs):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + 200] for _, b in data for i in range(len(b) - 199))
    out = []
    for d, b in data:
        runs = []
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + 200
                else:
                    runs.append([i, i + 200])
        kept, at = b"", 0
        for x, y in runs:
            kept, at = kept + b[at:x], y
        out.append((d, len(b), sum(y - x for x, y in runs), len(runs), hashlib.sha256(kept + b[at:]).hexdigest()))
    return out


def groups(rows):
    """The smallest row number reachable from each of rows (texts): 3 fingerprint bits, or five-word shingle sets of Jaccard 0.8 or more."""
    sets = []
    for t in rows:
        w = lowered(t).split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    prints = [fingerprint(t) for t in rows]
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(range(len(rows)), 2):
        alike = bool(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
        if alike or (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(n) for n in range(len(rows))]


def quality(text):
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)"""
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(hit)


def accepted(text):
    n, chars, symbols, lines, dup, repeat = quality(text)
    return not (n < 10 or 100 * repeat > 20 * n or chars < 2 * n or chars > 20 * n or symbols > n or 2 * dup > lines)


def pieces(docs, encode, size):
    """{(doc_id, piece): (start, length, ids)} of unique doc_ids, each text ended by id 0."""
    out = {}
    for d, t in docs:
        ids = encode(t or "") + [0]
        for k in range(0, len(ids), size):
            out[d, k // size] = (k, len(ids[k : k + size]), ids[k : k + size])
    return out


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]
