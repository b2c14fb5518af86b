from collections import defaultdict


def groups(rows, by, of):
    out = defaultdict(set)
    for r in rows:
        out[r[by]].add(r[of])
    return dict(out)
