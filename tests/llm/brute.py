"""Plain restatements of the operators for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

UP = re.compile("[A-Z]")


def lower(text):
    return UP.sub(lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def exact(rows):
    """(id, keep, size, kept, sha) of each row."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for doc_id, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        keep = min(groups[norm], key=order)
        out.append((doc_id, keep, len(groups[norm]), doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def repeats(rows, n=50):
    """(id, bytes, removed, spans, sha) of each row."""
    first = {}
    for doc_id, text in sorted(rows, key=lambda r: order(r[0])):
        body = (text or "").encode()
        for k in range(len(body) - n + 1):
            first.setdefault(body[k : k + n], order(doc_id))
    out = []
    for doc_id, text in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for k in range(len(body) - n + 1):
            if first[body[k : k + n]] < order(doc_id):
                gone[k : k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(body, gone) if not g)
        spans = sum(1 for k in range(len(body)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text):
    ws = words(text)
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows):
    fps = [fingerprint(text) for _, text in rows]
    edges = [
        (i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3
    ]
    root = roots(range(len(fps)), edges)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[root[i]] = min(low.get(root[i], doc_id), doc_id, key=order)
    return [(doc_id, f"{fps[i]:016x}", low[root[i]]) for i, (doc_id, _) in enumerate(rows)]


def near_kept(rows, n=5, similarity=0.8):
    """Ids that stay when groups of similar texts keep their smallest id."""
    sets = []
    for _, text in rows:
        ws = words(text)
        sets.append({tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set())
    edges = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both >= similarity * (len(a) + len(b) - both):
                edges.append((i, j))
    root = roots(range(len(sets)), edges)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[root[i]] = min(low.get(root[i], doc_id), doc_id, key=order)
    return set(low.values())


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(rows, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        ws = item_words(text)
        for i in range(max(1, len(ws) - n + 1)) if ws else ():
            windows[tuple(ws[i : i + n])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        ws, hit, found = item_words(text), set(), set()
        for size in lengths:
            for i in range(len(ws) - size + 1):
                names = windows.get(tuple(ws[i : i + size]))
                if names:
                    found |= names
                    hit.update(range(i, i + size))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(ws), len(hit), len(found), sha, bool(hit)))
    return out


def katz(rows, trained, discounts):
    """(id, tokens, known, base, score) of each row, N and V."""
    import math

    texts = [[*words(text), None] for _, text in rows]
    uni, bi = Counter(), Counter()
    for ts, own in zip(texts, trained):
        if own:
            uni.update(ts)
            bi.update(zip(["\0begin", *ts], ts))
    n, v = sum(uni.values()), len(uni)
    d1, d2 = discounts(Counter(uni.values())), discounts(Counter(bi.values()))
    unknown = 1 - sum(d1[min(c, 6)] * c for c in uni.values()) / max(n, 1)
    p1 = lambda w: d1[min(uni[w], 6)] * uni[w] / n if uni[w] else unknown
    total, kept, mass = Counter(), Counter(), Counter()
    for (a, b), c in bi.items():
        total[a] += c
        kept[a] += d2[min(c, 6)] * c
        mass[a] += p1(b)

    def p(a, b):
        c = bi[a, b]
        if c:
            return d2[min(c, 6)] * c / total[a]
        return (1 - kept[a] / total[a]) / (1 - mass[a]) * p1(b) if total[a] else p1(b)

    out = []
    for (doc_id, _), ts in zip(rows, texts):
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ts)
        score = sum(math.log10(p(a, b)) for a, b in zip(["\0begin", *ts], ts))
        out.append((doc_id, len(ts), sum(uni[w] > 0 for w in ts), base, score))
    vocabulary = [*uni, "\0unknown"]
    sums = {a: sum(p(a, b) for b in vocabulary) for a in [*list(total)[:30], "\0unseen context"]}
    return out, n, v, sums


def ascii_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def figures(text):
    """words, characters in words, symbols, repeated lines, repeated words."""
    text = text or ""
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(tokens[i : i + 8]) for i in range(len(tokens) - 7))
    hit = {p for i in range(len(tokens) - 7) if windows[tuple(tokens[i : i + 8])] > 1 for p in range(i, i + 8)}
    return (
        len(tokens),
        sum(map(len, tokens)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
    )


def ballots(text):
    """The votes of the eight rules, in their order."""
    n, chars, symbols, dup, rep = figures(text)
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    letters = sum(ord(c) > 127 or c.isalpha() for c in "".join(tokens))
    capitals = len(re.findall("[A-Z]", text or ""))
    echoes = sum(a == b for a, b in zip(tokens, tokens[1:]))
    top = max(Counter(tokens).values(), default=0)
    rules = [
        (symbols > 0.1 * n, n and symbols <= 0.01 * n),
        (letters * 10 < chars * 7, n and letters * 10 >= chars * 9),
        (capitals * 10 > letters * 3, letters and capitals * 10 <= letters),
        (dup >= 2 and dup * 10 > len(lines) * 3, len(lines) >= 3 and not dup),
        (rep * 5 > n, n >= 20 and not rep),
        (echoes * 5 > n, n >= 20 and echoes * 50 <= n),
        (n >= 20 and top * 10 > n * 3, n >= 20 and top * 25 <= n * 3),
        (chars < 2 * n or chars > 12 * n, n and 3 * n <= chars <= 8 * n),
    ]
    return [-1 if bad else 1 if good else 0 for bad, good in rules]


def posteriors(cast, rounds):
    """Expectation-maximisation document by document."""
    q = [(v.count(1) + 0.5) / (v.count(1) + v.count(-1) + 1) for v in cast]
    for _ in range(rounds):
        prior = (sum(q) + 1) / (len(q) + 2)
        good, bad = [], []
        for j in range(8):
            good.append(
                (sum(p for p, v in zip(q, cast) if v[j] == 1) + 4) / (sum(p for p, v in zip(q, cast) if v[j]) + 5)
            )
            bad.append(
                (sum(1 - p for p, v in zip(q, cast) if v[j] == -1) + 4) / (sum(1 - p for p, v in zip(q, cast) if v[j]) + 5)
            )
        new = []
        for v in cast:
            yes, no = prior, 1 - prior
            for j, vote in enumerate(v):
                if vote:
                    yes *= good[j] if vote == 1 else 1 - good[j]
                    no *= bad[j] if vote == -1 else 1 - bad[j]
            new.append(yes / (yes + no))
        q = new
    return q


def quality(rows, rounds):
    cast = [ballots(text) for _, text in rows]
    out = []
    for (doc_id, text), p in zip(rows, posteriors(cast, rounds)):
        own = figures(text)
        failed = own[0] < 20 or 100 * own[4] > 30 * own[0]
        out.append((doc_id, *own, failed, not failed and p >= 0.5, p))
    return out


def importance(rows, items, buckets=10_000, percent=25, min_words=20, seed=7):
    """(id, features, weight, score, rank) of each row; rank None where not drawn."""

    def features(text):
        tokens = ascii_words(text)
        both = tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]
        return tokens, [zlib.crc32(f.encode()) % buckets for f in both]

    cut = [features(text) for _, text in rows]
    s = Counter(b for _, fs in cut for b in fs)
    t = Counter(b for text in items for b in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for (doc_id, _), (tokens, fs) in zip(rows, cut):
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in fs]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(tokens)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], order(r[0])))
    for place, row in enumerate(able[: len(able) * percent // 100]):
        row[4] = place + 1
    return [tuple(r[:5]) for r in out]


def _hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_hash(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def _sides(levels, place):
    for nodes in levels[:-1]:
        begin = place // 16 * 16
        yield nodes[begin:place], nodes[place + 1 : begin + 16]
        place //= 16


def manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); the report's tuples."""

    def leaf(values):
        return _hash("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row, leaf(row)))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for key in keys:
        groups[key].sort(key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))
        trees[key] = _tree([own for _, own in groups[key]])
    upper = _tree([trees[key][-1][0] for key in keys])
    out = []
    for at, key in enumerate(keys):
        for place, (row, own) in enumerate(groups[key]):
            sides = [*_sides(trees[key], place), *_sides(upper, at)]
            proof = _hash(x for left, right in sides for x in (*left, *right))
            doc_id, text = row[0], row[4]
            folded = own
            if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0:
                folded = leaf((*row[:4], None if text is None else lower(text)))
            for left, right in sides:
                folded = _hash([*left, folded, *right])
            root = upper[-1][0]
            out.append((doc_id, own, trees[key][-1][0], root, proof, folded, folded == root))
    return out
