"""Mixing row by row, in plain Python: what the operator should take."""

import math
from hashlib import md5


def unit(key, seed):
    return int(md5(f"{seed}:{key}".encode()).hexdigest()[:12], 16) / 2**48


def plain_targets(sizes, weights=(5, 2, 1), cap=3.0):
    """sizes: by source; the excess over the caps goes to the others by weight until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    targets, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            targets |= {s: left * weight[s] / total for s in free}
            break
        targets |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return targets


def plain_copies(rows, seed="mix-1"):
    """rows: (id, text, source); how often each is taken."""
    words = [len((text or "").encode().split()) for _, text, _ in rows]
    sizes = {}
    for (_, _, source), n in zip(rows, words, strict=True):
        sizes[source] = sizes.get(source, 0) + n
    targets = plain_targets(sizes)
    draws = [unit(i if i is not None else "text:" + md5((text or "").encode()).hexdigest(), seed) for i, text, _ in rows]
    copies = [0] * len(rows)
    for source, size in sizes.items():
        rate = targets[source] / size if size else 0.0
        whole, fraction = math.floor(rate), rate - math.floor(rate)
        offset = unit(source if source is not None else "\0", f"{seed}-source")
        own = [k for k, r in enumerate(rows) if r[2] == source]
        classes = {}
        for k in own:
            copies[k] = whole
            digits = f"{words[k]:b}"
            classes.setdefault((len(digits), (digits + "000")[1:4]), []).append(k)
        begin = 0
        for _, members in sorted(classes.items()):
            end = begin + len(members)
            take = math.floor(end * fraction + offset) - math.floor(begin * fraction + offset)
            members.sort(key=lambda k: draws[k])
            for k in members:
                copies[k] += bool(take) and draws[k] <= draws[members[take - 1]]
            begin = end
    return copies
