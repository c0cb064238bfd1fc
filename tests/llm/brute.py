"""Plain restatements of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

from tidemill.llm import secrets

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return (text or "").translate(LOWER)


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def fingerprint(text, n=4):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs, n=4, distance=4):
    prints = [(i, fingerprint(t, n)) for i, t in docs]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        least[root(i)].append(d)
    return sorted((d, f"{f:016x}", min(x for x in least[root(i)] if x is not None)) for i, (d, f) in enumerate(prints) if d is not None)


def decontaminate(docs, items):
    part = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    index = defaultdict(set)
    for item, text in items:
        w = part.findall(lower(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            index[tuple(w[i : i + n])].add(item)
    sizes = {len(k) for k in index}
    out = []
    for doc, text in docs:
        w = part.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := index.get(tuple(w[i : i + n])):
                    found |= own
                    hit |= set(range(i, i + n))
        found = {str(x) for x in found if x is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def base_spans(text):
    text, out = text or "", []
    for kind, pattern, group, least in (
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return [x for *_, x in sorted(out)]


def pieces(docs, encode):
    out = []
    for doc, text in docs:
        ids = [*encode(text or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            out.append((doc, p, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    return sorted(out, key=repr)


def chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    told = "</s>[INST] ok [/INST]"
    by[-1] = [(0, "user", told), (1, "assistant", told)]
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def mixed(model, symbols):
    """Log2 probability of each symbol of one text under (trees, counters, weights, refinement), one decision at a time."""
    from tidemill.llm import mixing as m

    trees, tables, weights, refined = model
    own, tally, out = [0.0] * m.INPUTS, [[0.0, 0.0] for _ in range(m.OWN_BUCKETS)], []
    edges = m.lane_edges(len(symbols))
    for low, high in zip(edges, edges[1:]):
        slope, many, fresh = [0.0] * m.INPUTS, 0, [[0, 0] for _ in range(m.OWN_BUCKETS)]
        for i in range(low, high):
            b1, b2, b3, b4 = (symbols[i - k] if i >= k else 255 for k in (1, 2, 3, 4))
            word, k = [], i
            while k > 0 and symbols[k - 1] not in (32, 9, 10, 11, 12, 13):
                k -= 1
            word = sum((symbols[j] + 1) * pow(0x9E3779B97F4A7C15, j - k, 1 << 64) for j in range(k, i)) % (1 << 64)
            word = (word ^ word >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 32
            tree = int(trees.of_pair[b2 << 8 | b1])
            three = b3 << 16 | b2 << 8 | b1
            places = []
            for h, size in zip((three * 0x85EBCA6B, (three | b4 << 24) * 0xC2B2AE35, word + tree * 0x9E3779B1), m.SLOTS[1:]):
                h %= 1 << 32
                h = (h ^ h >> 15) * 0x2C1B3C6D % (1 << 32)
                places.append(h >> 33 - size.bit_length())
            code, gain = int(trees.code[tree << 8 | symbols[i]]), 0.0
            for step in trees.path[code >> 8 : (code >> 8) + (code & 255)].tolist():
                node, bit = step >> 1, step & 1
                seen = [int(trees.counter[node]), *(int(t[p ^ (node & 255)]) for t, p in zip(tables, places))]
                gate = (seen[2] & 3) << 2 | (seen[3] & 3)
                x = [(v >> 2) - 32 for v in seen]
                z = sum((float(weights[gate, k]) + own[k]) / m.STEP * x[k] for k in range(m.INPUTS))
                p = 1 / (1 + math.exp(-z))
                level = int(min(max(4 * z + m.BUCKETS / 2, 0), m.BUCKETS - 1))
                mine = level // (m.BUCKETS // m.OWN_BUCKETS)
                centre = 1 / (1 + math.exp(-(mine + 0.5 - m.OWN_BUCKETS / 2) * (m.BUCKETS / m.OWN_BUCKETS) / 4))
                n, ones = tally[mine]
                final = (2 * p + float(refined[(node >> 8) * m.BUCKETS + level]) + (ones + m.OWN_PRIOR * centre) / (n + m.OWN_PRIOR)) / 4
                final = min(max(final, 1e-6), 1 - 1e-6)
                gain += math.log2(final if bit else 1 - final)
                slope = [s + v * (bit - p) for s, v in zip(slope, x)]
                many += 1
                fresh[mine][0] += 1
                fresh[mine][1] += bit
            out.append(gain)
        own = [o + m.OWN_RATE / m.STEP * s / many for o, s in zip(own, slope)]
        tally = [[a + c, b + d] for (a, b), (c, d) in zip(tally, fresh)]
    return out


def poly(data, base=0x9E3779B97F4A7C15):
    return finalised(sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(data)) % (1 << 64))


def finalised(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    h = (h ^ h >> 27) * 0x94D049BB133111EB % (1 << 64)
    return h ^ h >> 31


def classified(text, slope, bias):
    from tidemill.llm import classifier as c

    words = [w.encode() for w in WORD.findall(lower(text))]
    ended = (text or "").encode()[-1:] not in (b"", *(bytes([x]) for x in (32, 9, 10, 11, 12, 13)))
    found = [poly(w) for w in words]
    for near in ((1,), (2, 3, 4)):
        found += [c.AGAIN + near[0]] * c.AGAIN_TIMES * sum(any(i >= k and words[i - k] == w for k in near) for i, w in enumerate(words))
    for i, w in enumerate(words):
        marked = [*w, *([] if ended and i == len(words) - 1 else [c._CLOSE])]
        for n in c.GRAMS:
            for j in range(len(marked) - n + 1):
                h = 0
                for b in marked[j : j + n]:
                    h = (h * 0x100000001B3 + b + 1) % (1 << 64)
                found.append(finalised((h + (n << 56)) % (1 << 64)))
    total = sum(float(slope[f % c.BUCKETS]) for f in found)
    return 1 / (1 + math.exp(-(total / max(1, len(found)) + bias)))


def secret_spans(text, model):
    """All spans (kind, start, stop) of a text, those that the models add too, in the operator's order."""
    text = text or ""
    base = secret_bases_only(text)
    size, at = len(secrets.ALPHABET) + 1, {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}
    out = list(base)
    for m in re.finditer(secrets.CANDIDATE, text):
        v, (a, b) = m.group(), m.span()
        codes = [at.get(c, 0) for c in v]
        ratio = sum(model[x * size + y] for x, y in zip(codes, codes[1:])) / (len(v) - 1)
        if re.search("[0-9]", v) and ratio >= secrets.LEAST_RATIO and not any(s < b and a < e for s, e, _ in base):
            out.append((a, b, "markov"))
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2]), x[1]))


def secret_bases_only(text):
    return [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base_spans(text))]


def redacted(text, spans, mark="[SECRET]"):
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
