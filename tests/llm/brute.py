"""Plain Python versions of the operators, for comparison on small tables."""

import hashlib
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def spaced(text):
    return SPACED.findall((text or "").translate(LOWER))


def license_base(text):
    words, places, labels = alnum(text), [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def license_verdict(text, phrases, passages, gram=4, slack=3, share=0.5, short=8):
    """Labels and score: every occurrence of every template, word by word, one diagonal after another."""
    words, shares = alnum(text), [(1.0, label) for phrase, label in phrases.items() if f" {phrase} " in f" {' '.join(alnum(text))} "]
    for passage, label in passages.items():
        p = passage.split()
        n = len(p) - gram + 1
        # (position - template position, template position) of every place where a whole gram stands
        hits = sorted((i - j, j) for j in range(n) for i in range(len(words) - gram + 1) if words[i : i + gram] == p[j : j + gram])
        spans = []
        for d, j in hits:
            if not spans or d - spans[-1][-1][0] > slack:
                spans.append([])
            spans[-1].append((d, j))
        for span in spans:
            length = max(d + j for d, j in span) - min(d + j for d, j in span) + 1
            part = len({j for _, j in span}) / n
            if 2 * length <= 3 * len(p) and part >= (1.0 if n <= short else share):
                shares.append((part, label))
    return ",".join(sorted({label for _, label in shares})), max((part for part, _ in shares), default=0.0)


def size_and_crc(text):
    raw = (text or "").encode()
    return len(raw) + 16, zlib.crc32(raw)


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_rule(host, path, rules):
    best = None
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best or (None, None)


def quality(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def hits(text, items, window=10):
    words = alnum(text)
    covered, found = set(), set()
    joined = {}
    for item_id, item in items:
        w = alnum(item)
        size = min(window, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            joined.setdefault((size, tuple(w[j : j + size])), set()).add(str(item_id))
    for size in {s for s, _ in joined}:
        for i in range(len(words) - size + 1):
            if who := joined.get((size, tuple(words[i : i + size]))):
                covered |= set(range(i, i + size))
                found |= who
    return len(words), len(covered), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def shingles(text, k):
    w = spaced(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(texts, k, percent):
    """texts: {id: text}. Shingle counts, and the smallest id that links reach."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        counts = {}
        for x in s:
            for j in where[x]:
                counts[j] = counts.get(j, 0) + 1
        for j, n in counts.items():
            if j > i and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def n_links(texts, k, percent):
    """Other documents that each one links with."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    close = lambda x, y: bool(x) and 100 * len(x & y) >= percent * len(x | y)
    return {i: sum(close(s, t) for j, t in sets.items() if j != i) for i, s in sets.items()}
