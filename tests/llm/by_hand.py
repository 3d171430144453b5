"""Helpers of the brute-force checks."""

DATA = "/root/testdata/sf0.01"


def by_id(df, id_col="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[id_col], []).append(r)
    return out


def components(pairs, nodes):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}
