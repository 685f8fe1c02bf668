"""Plain single-machine versions of the general problems, written for clarity, to compare with."""

import json
import unicodedata
from collections import Counter, defaultdict
from fractions import Fraction

ORDER = ["array", "boolean", "number", "object", "string"]


def read(text):
    v = text
    try:
        while isinstance(v, str):
            v = json.loads(v)
    except ValueError:
        return None
    return v if isinstance(v, dict) else None


def same(a, b):
    """JSON equality: booleans are no numbers."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b


def kind(v):
    return "boolean" if isinstance(v, bool) else {dict: "object", list: "array", str: "string", int: "number", float: "number"}[type(v)]


def ancestors(trees, delivered):
    parent = {}
    for t in trees:
        if t["parent_oid"] is not None or t["tree_oid"] not in parent:
            parent[t["tree_oid"]] = t["parent_oid"]
    out = {}
    for t in delivered:
        p = parent.get(t)
        while p is not None and p not in delivered:
            p = parent.get(p)
        if p is not None:
            out[t] = p
    return out


def catalogs(ref_files):
    best = {}
    for r in ref_files:
        k = r["tree_oid"], unicodedata.normalize("NFC", r["path"])
        if k not in best or r["mtime"] > best[k][0]:
            best[k] = r["mtime"], r["frontmatter"]
    out = defaultdict(dict)
    for (t, p), (_, f) in best.items():
        out[t][p] = f
    return out


def p5(trees, ref_files):
    cats = catalogs(ref_files)
    rows = set()
    for t, a in ancestors(trees, set(cats)).items():
        old, new = cats[a], cats[t]
        rows |= {(t, p, "added") for p in new.keys() - old.keys()} | {(t, p, "removed") for p in old.keys() - new.keys()}
        for p in old.keys() & new.keys():
            x, y = read(old[p]), read(new[p])
            equal = same(x, y) if x is not None and y is not None else x is None and y is None and old[p] == new[p]
            if not equal:
                rows.add((t, p, "changed"))
    return rows


def p1(trees, ref_files, files):
    cats = catalogs(ref_files)
    work = defaultdict(dict)
    best = {}
    for f in files:
        p = unicodedata.normalize("NFC", f["path"])
        if p not in best or f["mtime"] > best[p][0]:
            best[p] = f["mtime"], f
    for p, (_, f) in best.items():
        work[f["base_oid"]][p] = f["frontmatter"]

    def groups(cat):
        g = defaultdict(dict)
        for p, text in cat.items():
            v = read(text)
            if v is not None and isinstance(v.get("okf_type"), str):
                g[v["okf_type"]][p] = {k: x for k, x in v.items() if x is not None}
        return g

    def fields(group):
        c = Counter(k for v in group.values() for k in v)
        out = {}
        for k, n in c.items():
            if n * 5 >= len(group):
                kinds = Counter(kind(v[k]) for v in group.values() if k in v)
                out[k] = min(kinds, key=lambda x: (-kinds[x], ORDER.index(x)))
        return out

    pairs = [(a, t, cats[a], cats[t]) for t, a in ancestors(trees, set(cats)).items()] + [(b, "working", cats[b], work[b]) for b in work if b in cats]
    rows = set()
    for a, t, x, y in pairs:
        gx, gy = groups(x), groups(y)
        for okf in gx.keys() & gy.keys():
            fx, fy = fields(gx[okf]), fields(gy[okf])
            cands = []
            for old in fx.keys() - fy.keys():
                held = [p for p in gx[okf].keys() & gy[okf].keys() if old in gx[okf][p]]
                for new in fy.keys() - fx.keys():
                    n = sum(new in gy[okf][p] and same(gx[okf][p][old], gy[okf][p][new]) for p in held)
                    if held and n * 5 >= len(held) * 4:
                        cands.append((-Fraction(n, len(held)), old, new))
            used = set()
            for _, old, new in sorted(cands):
                if ("o", old) not in used and ("n", new) not in used:
                    used |= {("o", old), ("n", new)}
                    rows.add((a, t, okf, "renamed", old, new))
            rows |= {(a, t, okf, "removed", k, "") for k in fx.keys() - fy.keys() if ("o", k) not in used}
            rows |= {(a, t, okf, "added", k, "") for k in fy.keys() - fx.keys() if ("n", k) not in used}
            rows |= {(a, t, okf, "retyped", k, "") for k in fx.keys() & fy.keys() if fx[k] != fy[k]}
    return rows


def p2(files):
    best = {}
    for f in files:
        if f["path"] not in best or f["mtime"] > best[f["path"]][0]:
            best[f["path"]] = f["mtime"], f["frontmatter"]
    rows = set()

    def walk(path, v, ptr, parent):
        if isinstance(v, dict):
            if ptr:
                rows.add((path, ptr, parent))
            parent = ptr
            items = [(k.replace("~", "~0").replace("/", "~1"), x) for k, x in v.items()]
        elif isinstance(v, list):
            items = [(str(i), x) for i, x in enumerate(v)]
        else:
            return
        for k, x in items:
            walk(path, x, f"{ptr}/{k}", parent)

    for path, (_, text) in best.items():
        v = read(text)
        if v is not None:
            walk(path, v, "", "")
    return rows
