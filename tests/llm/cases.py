"""Small tables with the awkward cases, and plain definitions to compare with."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def texts(seed=1, n=60):
    """Nulls, empty and blank texts, long ones, repeated rows, shared passages, near copies."""
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice("ab cd efg hi jkl mno pq é日 x, y. z").strip() or "o" for _ in range(k))
    shared = [say(40), say(90), say(36)]
    base = say(120)
    rows = [None, None, "", "", "   \n\t ", "one", "one", "two words", "same " * 400, "y" * 1000, base, base]
    for i in range(n):
        parts = [say(r.randint(1, 60))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, 1), r.choice(shared))
        rows.append(r.choice([" ", "\n", "  "]).join(parts))
        if i % 6 == 0:
            near = base.split(" ")
            near[r.randrange(len(near))] = "changed"
            rows.append(" ".join(near))
    rows.append(say(30_000))
    return rows


def documents(spark, rows=None, partitions=3):
    """With null and repeated ids and columns whose names clash with added ones."""
    rows = texts() if rows is None else rows
    made = [
        (None if i % 17 == 3 else (7 if i in (5, 6) else i), t, f"s{i % 4}" if i % 5 else None, f"own {i}", i)
        for i, t in enumerate(rows)
    ]
    schema = "doc_id long, text string, source string, n_words string, kept int"
    return spark.createDataFrame(made, schema).repartition(partitions)


def empty(spark):
    return documents(spark).limit(0)


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def covered(items, length):
    """Which places lie in a stretch of ``length`` items that is found twice or more."""
    seen = Counter(tuple(x[i : i + length]) for x in items for i in range(len(x) - length + 1))
    out = []
    for x in items:
        gone = [False] * len(x)
        reach = 0
        for i in range(len(x) - length + 1):
            if seen[tuple(x[i : i + length])] > 1:
                for j in range(max(i, reach), i + length):
                    gone[j] = True
                reach = i + length
        out.append(gone)
    return out
