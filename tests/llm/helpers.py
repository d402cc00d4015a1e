"""Documents with every awkward case, and brute-force versions of the operators."""

import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, rank int"
LONG = "alpha beta gamma delta " * 6000


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 1, "x", 1),
        (2, "The  quick brown fox jumps over the lazy dog again and again.", "en", "a", 1, "x", 1),
        (2, "The  quick brown fox jumps over the lazy dog again and again.", "en", "a", 1, "x", 1),
        (3, None, None, None, None, None, None),
        (4, "", "en", None, 0, "", 0),
        (5, " \n\t", "en", "b", 0, "", 0),
        (None, "no id but words", "en", "b", 3, "z", 9),
        (None, None, None, None, None, None, None),
        (6, LONG, "en", "c", len(LONG), "y", 2),
        (7, LONG + "omega", "en", "c", len(LONG), "y", 2),
        (8, "same same", "en", "", 1, "q", 3),
        (9, "SAME same", "en", "", 1, "q", 3),
        (10, "é 漢字 😀 words é 漢字 😀 words", "de", "\U0001f600", 1, "q", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_classes(rows, n, num, den):
    """Class (by place) of each (id, text), by comparing every pair that shares a shingle."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j > i}:
            if den * len(s & sets[j]) >= num * len(s | sets[j]):
                parent[root(j)] = root(i)
    return [root(i) for i in range(len(rows))], sets


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    double = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
    return sum(double) % 10 == 0


def personal(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if name == "card" and not (14 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


__all__ = ["Counter", "awkward", "empty", "near_classes", "personal", "shingles", "words"]
