"""Plain Python versions of what the operators compute, for small tables."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter, defaultdict

SPACES = re.compile("[\x20\x09-\x0d]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def ascii_lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def license_base(text):
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text or "")) if x]
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def shingles(text, size):
    w = words(ascii_lower(text or ""))
    if not w:
        return frozenset()
    size = min(size, len(w))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def reach(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_components(texts, size, percent=80):
    """texts: id -> text. Returns id -> (set size, component)."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    common = Counter()
    for held in by.values():
        for n, a in enumerate(held):
            for b in held[n + 1:]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    found = reach(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def quality_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def cosine_links(rows, least):
    """rows: (id, vector, label). Returns id -> (links, component)."""
    good = [(i, [float(x) for x in v], lab) for i, v, lab in rows
            if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for n, (i, v, lab) in enumerate(good):
        for j, u, other in good[n + 1:]:
            if lab == other:
                dot = math.fsum(a * b for a, b in zip(v, u, strict=True))
                if dot / math.sqrt(math.fsum(a * a for a in v) * math.fsum(b * b for b in u)) >= least:
                    links.append((i, j))
    found = reach([r[0] for r in rows], links)
    counts = Counter(x for pair in links for x in pair)
    return {r[0]: (counts[r[0]], found[r[0]]) for r in rows}


def mix_targets(sizes, most=3.0):
    """sizes: source -> words. Resharing round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def binomial_tail(k, n, rate):
    from fractions import Fraction

    p = Fraction(rate).limit_denominator(10**6)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


TOKENS = re.compile("[0-9A-Za-z\x80-\u024f]{1,12}|[^\x20\x09-\x0d]")


def winnowed(text, k, w, prime, base):
    """(position, hash) of the rightmost smallest hash of every window."""
    tokens = [int(hashlib.md5(t.encode()).hexdigest()[:7], 16) for t in TOKENS.findall(text)]
    if not tokens:
        return []

    def value(run):
        h = 0
        for c in run:
            h = (h * base + c) % prime
        return h

    hashes = [value(tokens[i:i + k]) for i in range(max(1, len(tokens) - k + 1))]
    chosen = set()
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i:i + w]
        least = min(window)
        chosen.add((i + max(j for j, h in enumerate(window) if h == least), least))
    return sorted(chosen)


def alike(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def vector_rows(rows, least):
    """rows (id, vector, label), ids may repeat: one (id, number of linked rows, smallest id reached) per row."""
    able = []
    for i, v, label in rows:
        good = i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        able.append([x / math.sqrt(sum(y * y for y in v)) for x in v] if good else None)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if able[a] and able[b] and rows[a][2] == rows[b][2] and len(able[a]) == len(able[b])
             and sum(x * y for x, y in zip(able[a], able[b], strict=True)) >= least]
    root = reach(range(len(rows)), links)
    smallest = {}
    for a, r in root.items():
        if rows[a][0] is not None:
            smallest[r] = min(smallest.get(r, rows[a][0]), rows[a][0])
    count = Counter(x for pair in links for x in pair)
    return [(rows[a][0], count[a], smallest.get(root[a]) if rows[a][0] is not None else None) for a in range(len(rows))]


def feistel(key, tweak, a, b, m, n):
    """Ten rounds over Z_m x Z_n."""
    def bits(k, value):
        return int(hashlib.sha256(f"{key}|{tweak}|{k}|{value}".encode()).hexdigest()[:15], 16)

    for k in range(10):
        if k % 2 == 0:
            a = (a + bits(k, b)) % m
        else:
            b = (b + bits(k, a)) % n
    return a, b


def other_digits(key, kind, digits):
    left = len(digits) // 2
    right = len(digits) - left
    a, b = feistel(key, f"{kind}:{len(digits)}", int(digits[:left]), int(digits[left:]), 10**left, 10**right)
    return f"{a:0{left}d}{b:0{right}d}"


def other_card(key, digits):
    body = other_digits(key, "card", digits[:-1])
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def other_ssn(key, text):
    area, group, serial = map(int, text.split("-"))
    a, b = feistel(key, "ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def other_phone(key, text):
    """+1 numbers."""
    made = iter("1" + other_digits(key, "phone", re.sub(r"\D", "", text)[1:]))
    return "".join(next(made) if c.isdigit() else c for c in text)


def other_date(key, text):
    first = datetime.date(1900, 1, 1)
    given = at = datetime.date.fromisoformat(text)
    while True:
        n = (at - first).days
        a, b = feistel(key, "date", n // 4297, n % 4297, 17, 4297)
        at = first + datetime.timedelta(a * 4297 + b)
        if (at.day <= 12) == (given.day <= 12):
            return at.isoformat()


def other_ipv4(key, text):
    o = list(map(int, text.split(".")))
    a, b = feistel(key, "ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


PSEUDONYMS = {"card": other_card, "ssn": other_ssn, "phone": other_phone, "date": other_date, "ipv4": other_ipv4}
