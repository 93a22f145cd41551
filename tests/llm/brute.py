"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def suffix(docs, length):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        off = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                off[i : i + length] = [True] * length
        spans = sum(x and not (i and off[i - 1]) for i, x in enumerate(off))
        out.append((d, len(b), sum(off), spans, sha(bytes(x for x, y in zip(b, off) if not y))))
    return out


def windows(docs, size):
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    last = float("inf")
    first = {}
    for d, w in words:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, last), last if d is None else d)
    out = []
    for d, w in words:
        off = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (last if d is None else d):
                off[i : i + size] = [True] * size
        out.append((d, len(w), sum(off), sha(" ".join(x for x, y in zip(w, off) if not y))))
    return out


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(docs, percent=80):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        groups[root(i)].append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


KINDS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def secrets(text):
    found = [(m.start(), k, m.end()) for k, (_, rule, group, least) in enumerate(KINDS) for m in rule.finditer(text or "") if len(m.group(group)) >= least]
    return [f"{KINDS[k][0]}:{i}:{j}" for i, k, j in sorted(found)]


def grams(text):
    """Counts of 1- to 4-grams of UTF-16 units, words between two edge marks, none across a mark."""
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        units = [int.from_bytes(u, "little") for u in zip(*[iter(f"_{word}_".encode("utf-16-le"))] * 2)]
        for n in range(1, 5):
            for i in range(len(units) - n + 1):
                if n > 1 or units[i] != ord("_"):
                    key = 0
                    for u in units[i : i + n]:
                        key = key << 16 | u
                    out[key - (1 << 64) if key >> 63 else key] += 1
    return out


def ranked(counts, length):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:length]]


def languages(learning, texts, length):
    """(language, score) of each text by out-of-place distance to the profiles of (lang, text) rows."""
    totals = defaultdict(Counter)
    for lang, text in learning:
        totals[lang].update(grams(text))
    profiles = {lang: {g: r for r, g in enumerate(ranked(c, length))} for lang, c in totals.items() if c}
    out = []
    for text in texts:
        own = ranked(grams(text), length)
        if not own or not profiles:
            out.append(("und", 0.0))
            continue
        apart = {lang: sum(abs(p[g] - r) if g in p else length for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        out.append((best, 1 - apart[best] / (length * len(own))))
    return out


def url_templates(pages, rules, many=16, kids=2, z=1.96, weight=4.0):
    """{(host, segments): (template, purity)} of rows of (host, path, verdict or None), a host and a level at a time."""
    hosts = defaultdict(lambda: defaultdict(list))
    for host, path, verdict in pages:
        raw = tuple("#" if re.search("[0-9]", s) else s for s in path.split("/") if s)
        hosts[host][raw].append(verdict)
    out = {}
    for host, raws in hosts.items():
        tree = {raw: raw for raw in raws}
        labels = {raw: [v == "block" for v in vs if v] for raw, vs in raws.items()}
        for level in range(max(map(len, raws))):
            nodes = defaultdict(lambda: defaultdict(list))
            for raw, t in tree.items():
                if len(t) > level:
                    nodes[t[:level]][t[level]].append(raw)
            for branches in nodes.values():
                members = sum(len(rs) for rs in branches.values())
                names = _branch_names({b: ([v for r in rs for v in labels[r]], sum(len(raws[r]) for r in rs), frozenset(tree[r][level + 1] for r in rs if len(tree[r]) > level + 1 and tree[r][level + 1][0] != "#")) for b, rs in branches.items()}, many, kids, z) if members > 1 else {}
                for b, name in names.items():
                    for raw in branches[b]:
                        tree[raw] = (*tree[raw][:level], name, *tree[raw][level + 1 :])
        count = defaultdict(list)
        for raw, t in tree.items():
            for d in range(len(t) + 1):
                count[t[:d]] += labels[raw]
        for raw, t in tree.items():
            prior = purity = 0.5
            for d in range(len(t) + 1):
                n, b = len(count[t[:d]]), sum(count[t[:d]])
                purity = (b + weight * prior) / (n + weight)
                prior = purity if 0 < b < n else 0.5
            out[host, raw] = ("/" + "/".join(t), purity)
    return out


def _branch_names(branches, many, kids, z):
    """New names of a node's branches {name: (labels, urls, named children)}."""
    once = [b for b, (_, urls, _) in branches.items() if urls == 1]
    varied = len(branches) >= many and 2 * len(once) >= len(branches)
    names = {b: "#" for b in once if varied and b[0] != "#"}
    rest = {b: x for b, x in branches.items() if b not in names and b[0] != "#"}
    side = {b: 2 * sum(x[0]) > len(x[0]) for b, x in rest.items() if x[0]}
    joined = {True: set(), False: set()}
    for b, s in side.items():
        n, k = len(rest[b][0]), sum(rest[b][0])
        others = [v for c, t in side.items() if c != b and t == s for v in rest[c][0]]
        if others:
            share, spread = (k + sum(others)) / (n + len(others)), 1 / n + 1 / len(others)
            if abs(k / n - sum(others) / len(others)) <= z * (share * (1 - share) * spread) ** 0.5 + spread / 2:
                joined[s].add(b)
    for b, x in rest.items():
        like = {c for c in side if rest[c][2] == x[2]} if not x[0] and len(x[2]) >= kids else set()
        if len({side[c] for c in like}) == 1:
            joined[side[min(like)]] |= {b, *like}
    for group in joined.values():
        if len(group) > 1:
            names |= dict.fromkeys(group, "#" + min(group))
    return names
