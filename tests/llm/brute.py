"""Plain restatements that the operators are held against."""

from __future__ import annotations

import re


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_components(rows, k, percent):
    """{doc_id: (set size, smallest id reachable)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    counts = {}
    for ids in holders.values():
        for n, i in enumerate(ids):
            for j in ids[n + 1 :]:
                counts[i, j] = counts.get((i, j), 0) + 1
    for (i, j), both in counts.items():
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def exact_groups(rows):
    """{doc_id: (keep_id, size)} of texts equal without white space."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def spans(text):
    """Base spans of personal data, straight from the plain patterns."""
    text = text or ""

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def longest_phrases(text, trained):
    """Cross-parsing by plain search: phrases of text that occur in trained, each as long as can be."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in trained:
            j += 1
        n += 1
        i = max(i + 1, j - 1)
    return n


def repeated_lines(rows, least):
    """{doc_id: positions of lines in later copies of repeated runs of least characters}, by comparing all runs."""
    docs = {i: [(p, x.strip(" ")) for p, x in enumerate((t or "").split("\n")) if x.strip(" ")] for i, t in sorted(rows)}
    seen, gone = {}, {i: set() for i in docs}
    runs = [(i, s, e) for i, lines in docs.items() for s in range(len(lines)) for e in range(s + 1, len(lines) + 1)]
    for i, s, e in runs:
        run = tuple(x for _, x in docs[i][s:e])
        if sum(map(len, run)) >= least:
            if run in seen:
                gone[i] |= {p for p, _ in docs[i][s:e]}
            else:
                seen[run] = (i, s)
    return gone


def schedule(weights, total):
    """Slot by slot: the released block with the earliest deadline. weights: source -> slots of the period."""
    period = sum(weights.values())
    done, out = {s: 0 for s in weights}, []
    for t in range(total):
        free = [(-(-(done[s] + 1) * period // m), s) for s, m in weights.items() if done[s] * period // m <= t]
        s = min(free)[1]
        out.append((s, done[s]))
        done[s] += 1
    return out


def secret_candidates(text):
    """(start, end) of runs of key characters that are long with a digit, or follow an assignment or a secret word."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9_+/.~!@#$%^&*-]+", text):
        run, before = m[0], text[: m.start()]
        if before[-1:] in ("'", '"', "`") and before:
            before = before[:-1]
        word = re.sub(r"[ \t]is$", "", before.rstrip(" \t")) if before[-1:] in (" ", "\t") else None
        gap = len(before) - len(before.rstrip(" \t"))
        assigned = gap <= 2 and before.rstrip(" \t")[-1:] in ("=", ":") and before.rstrip(" \t") != ""
        secret = False
        if word is not None and gap <= 2:
            names = r"(token|secret|password|passwd|pwd|passphrase|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key)"
            plain = re.search(names + r"[ \t]{1,2}$", before, re.I)
            told = gap == 1 and re.search(names + r"[ \t]{1,2}is[ \t]$", before, re.I)
            secret = bool(plain or told)
        if len(run) >= 8 and ((len(run) >= 16 and re.search("[0-9]", run)) or assigned or secret):
            end = m.end()
            pad = re.match("={1,2}(?![A-Za-z0-9=])", text[end:])
            out.append((m.start(), end + (len(pad[0]) if pad else 0)))
    return out


def kneser_ney(trusted, texts, order=4):
    """Perplexities of texts by an interpolated modified Kneser-Ney model of the characters of trusted texts."""
    import math
    from collections import Counter, defaultdict

    plain = lambda t: " ".join((t or "").split())
    padded = lambda t: ["^"] * (order - 1) + [("c", x) for x in plain(t)]
    seqs = [padded(t) for t in trusted]
    counts = {order: Counter(tuple(s[i : i + order]) for s in seqs for i in range(len(s) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, total, taken = {}, {}, {}
    for n, table in counts.items():
        k = Counter(min(c, 5) for c in table.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else 0.5
        for i in (1, 2, 3):
            ratio = k[i + 1] / k[i] if k[i] else 0.5
            discount[n, i] = min(i, max(0.05 * i, i - (i + 1) * y * ratio))
        total[n], taken[n] = defaultdict(int), defaultdict(float)
        for g, c in table.items():
            total[n][g[:-1]] += c
            taken[n][g[:-1]] += discount[n, min(c, 3)]

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(counts[1]) + 1)
        below, c, ctx = p(g[1:]), counts[n].get(g, 0), g[:-1]
        if ctx not in total[n]:
            return below
        return max(0.0, c - discount[n, min(c, 3)] if c else 0.0) / total[n][ctx] + taken[n][ctx] / total[n][ctx] * below

    out = []
    for t in texts:
        s = padded(t)
        logs = [math.log(p(tuple(s[i : i + order]))) for i in range(len(s) - order + 1)]
        out.append(math.exp(-sum(logs) / len(logs)) if logs else None)
    return out
