"""Brute-force versions that several tests use."""

import math
from collections import Counter


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else str(v)
    return sorted(tuple(plain(row[k]) for k in order) for row in rows)


def brute_lines(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})
    lines = [text.split("\n") for text in texts]
    counts = Counter(k for own in lines for k in {key(x) for x in own} if k)
    return ["\n".join(x for x in own if counts[key(x)] < least) for own in lines]


def brute_near(texts):
    """Ids of the documents that stay."""
    sets = {}
    for doc_id, text in texts.items():
        words = text.encode().lower().split()
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    group = {k: {k} for k in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                    merged = group[a] | group[b]
                    group.update({x: merged for x in merged})
    return {k for k in ids if min(group[k]) == k}
