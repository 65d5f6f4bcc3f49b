"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash


def lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_duplicates(rows):
    """rows of (doc_id, text) -> set-like list of (doc_id, fingerprint, component_id)."""
    fps = [simhash(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = root(i)
            least[r] = min(least.get(r, d), d)
    return [(d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)]


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def contamination(rows, items):
    wins = {}
    for item, t in items:
        w = bench_words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    lens = sorted({len(k) for k in wins})
    out = []
    for d, t in rows:
        w, hit, ids = bench_words(t), set(), set()
        for n in lens:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    ids |= wins[k]
        named = sorted({str(i) for i in ids if i is not None})
        out.append((d, len(w), len(hit), len(named), sha(",".join(named)), bool(hit)))
    return out


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A,
)


def base_secrets(rows):
    out = []
    for d, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        a = [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        h = [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        names = ["assign", "access", "hex"]
        text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans + a + h))
        out.append((d, len(spans), len(a), len(h), sha(text)))
    return out


def quality(rows):
    """Counts of every (doc_id, text), without the verdict of the method."""
    out = []
    for d, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen, hit = {}, set()
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                hit.update(j for i in at for j in range(i, i + 8))
        n = len(re.findall(r"[#*$%&|<>]", t))
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        out.append((d, len(w), sum(map(len, w)), n, len(lines) - len(set(lines)), len(hit), failed))
    return out


def url(u, rules):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    fits = [
        (len(h + p), len(h), h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def repeats(rows, length=200):
    seen = {}
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for i in range(len(raw) - length + 1):
            w = hashlib.md5(raw[i : i + length]).digest()
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (d, _), raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[hashlib.md5(raw[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def similar_groups(rows, size, percent):
    """rows of (doc_id, text) -> (doc_id, smallest doc_id of the group by similarity of word runs)."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, least[root(i)]) for i, (d, _) in enumerate(rows)]
