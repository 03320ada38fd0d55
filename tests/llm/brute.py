"""Plain Python versions of what the operators promise, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW) if lower else text)


def rest(doc_id, modulus):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminate(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = set()
    for item, text in items:
        w = split(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            wins.add(("" if item is None else str(item), tuple(w[i : i + 10])))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def substrings(docs, n=35):
    seen = Counter()
    all_words = [words(t) for _, t in docs]
    for w in all_words:
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for (doc, _), w in zip(docs, all_words, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def near(docs, percent=85):
    sets = []
    for _, text in docs:
        w = words(text, True)
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(i)
    name = {i: min((docs[k][0] for k in g if docs[k][0] is not None), default=None) for g in groups.values() for i in g}
    return [(docs[i][0], len(sets[i]), docs[i][0] if not sets[i] else name[i], docs[i][0] == (docs[i][0] if not sets[i] else name[i])) for i in range(len(docs))]


def secrets_base(text):
    text = text or ""
    found = []
    stem = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""(?:{stem})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    kinds = ("assign", "access", "hex")
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)), [sum(x[1] == k for x in found) for k in range(3)]


def unigram(docs):
    count = Counter()
    for doc, text in docs:
        if rest(doc, 7) != 2:
            count.update([*words(text, True), None])
    n, v = sum(count.values()), len(count)
    out = []
    for doc, text in docs:
        t = [*words(text, True), None]
        out.append((doc, rest(doc, 7) == 2, len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)))
    return out


def quality(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            cover |= set(range(i, i + 5))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def targets(sizes):
    """Word targets by source, by resharing the excess until there is none."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s] * (1 + 1e-12)}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def line_verdict(text, marks):
    """Word characters lost to failing lines, and whether the text is kept, line by line. marks: closing marks beyond ASCII."""
    seen, lost, total = set(), 0, 0
    for line in (text or "").split("\n"):
        w = words(line)
        if not w:
            continue
        chars = sum(map(len, w))
        total += chars
        letters = [c for c in line if c.isascii() and c.isalpha()]
        found = re.findall(r"(?i)(?<![\w])(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|click here|subscribe (?:now|to our)|licensed under|sign (?:in|up)|javascript)(?![\w])", line.encode("utf-8").decode("latin-1").translate({k: "z" for k in range(128, 256)}))
        in_phrases = sum(m.count(" ") + 1 for m in found)
        fails = line in seen
        fails |= len(w) > 1 and line.count("|") > 0.25 * len(w)
        fails |= sum(line.count(c) for c in "#*$%&|<>") > max(2, 0.5 * len(w))
        fails |= len(w) > 3 and sum(c.isupper() for c in letters) > 0.7 * len(letters)
        fails |= len(w) <= 3 and w[-1][-1] not in ".!?:;\"')]}" + marks
        fails |= in_phrases > 0 and (in_phrases >= 0.25 * len(w) or len(w) < 10)
        seen.add(line)
        lost += chars if fails else 0
    return lost, not quality(text)[5] and lost <= 0.5 * total
