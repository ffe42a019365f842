"""Plain, slow versions of the corpus operators, row by row and without Spark."""

import hashlib
import math
import re
from collections import defaultdict
from fractions import Fraction

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def spark_hash(*parts):
    """Spark's xxhash64 of texts, unsigned."""
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, linked):
    """The group number of each value, by comparing all pairs."""
    group = list(range(len(values)))
    for a in range(len(values)):
        for b in range(a):
            if group[a] != group[b] and linked(values[a], values[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return group


def shard(key, tree):
    """Down the tree: at each level the child with the smallest -ln(u) / weight."""
    for level in ("region", "rack", "shard"):
        draws = []
        for name in sorted({str(getattr(x, level)) for x in tree}):
            own = [x for x in tree if str(getattr(x, level)) == name]
            u = ((spark_hash("" if key is None else str(key), f"{level}:{name}") >> 12) + 0.5) / (1 << 52)
            draws.append((-math.log(u) / sum(x.weight for x in own), own))
        if len(draws) > 1:
            tree = min(draws, key=lambda d: d[0])[1]
    return tree[0].shard


def crc_mpeg(data):
    crc = 0xFFFFFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = crc >> 31 ^ byte >> bit & 1
            crc = crc << 1 & 0xFFFFFFFF
            if top:
                crc ^= 0x04C11DB7
    return crc


def transport_stream(payload):
    """One program, one private stream; whole units of 22 + 1 packets; tables before every eighth."""
    out, counter = bytearray(), defaultdict(int)

    def packet(pid, start, body, extra=None):
        room = 184 - len(body)
        field = b""
        if extra is not None or room:
            own = extra or b""
            left = room - 1 - len(own)
            if extra is None and left >= 0 and room > 1:
                own, left = b"\0", room - 2
            field = bytes([len(own) + left]) + own + b"\xff" * left
        flags = (0x20 if field else 0) | 0x10 | counter[pid]
        counter[pid] = (counter[pid] + 1) % 16
        made = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, flags]) + field + body
        assert len(made) == 188
        out.extend(made)

    def table(pid, kind, rest):
        head = bytes([kind, 0xB0, len(rest) + 4]) + rest
        section = b"\0" + head + crc_mpeg(head).to_bytes(4, "big")
        packet(pid, True, section.ljust(184, b"\xff"))

    unit = 162 + 22 * 184
    for n, at in enumerate(range(0, len(payload), unit)):
        data = payload[at : at + unit]
        if n % 8 == 0:
            table(0, 0, bytes([0, 1, 0xC1, 0, 0, 0, 1, 0xF0, 0]))
            table(0x1000, 2, bytes([0, 1, 0xC1, 0, 0, 0xE1, 0, 0xF0, 0, 6, 0xE1, 0, 0xF0, 0]))
        pts = 90_000 + 3600 * n
        clock = pts - 3600
        five = bytes([0x21 | pts >> 30 << 1, pts >> 22 & 255, pts >> 15 << 1 & 255 | 1, pts >> 7 & 255, pts << 1 & 255 | 1])
        head = b"\0\0\1\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\5" + five
        pcr = bytes([0x50 if n % 8 == 0 else 0x10]) + (clock << 15 | 0x7E00).to_bytes(6, "big")
        packet(0x100, True, head + data[:162], pcr)
        for k in range(162, len(data), 184):
            packet(0x100, False, data[k : k + 184])
    return bytes(out)


def grams(text, orders=(3, 4, 5), bits=20):
    raw = b" " + " ".join((text or "").lower().split()).encode("utf-8", "replace") + b" "
    found = set()
    for k in orders:
        for i in range(len(raw) - k + 1):
            h = 0
            for byte in raw[i : i + k]:
                h = (h * 16777619 + byte + 1) % (1 << 32)
            found.add((h * 2654435761 % (1 << 32)) >> (32 - bits))
    return found - {0}


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        weights = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / weights for s in order}
        above = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def taken(rows, block_words=64, slots_at_least=1 << 18):
    """Words taken of each (id, text, source) in ``rows``, in their order, by walking the schedule slot by slot."""
    size = [len(WORDS.findall(t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    target = targets(sizes)
    whole = sum(sizes.values())
    out = [0] * len(rows)
    if not whole:
        return out
    block = max(1, min(block_words, whole // slots_at_least))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    edge, edges = Fraction(0), []
    for s in order:
        edge += Fraction(target[s])
        if target[s] > 0:
            edges.append((edge, s))
    golden = Fraction(11400714819323198485, 1 << 64)
    served = defaultdict(int)
    for t in range(-(-whole // block)):
        u = (Fraction(2 * t + 1, 2) * golden % 1) * edge
        served[next(s for e, s in edges if u < e)] += 1
    for s in order:
        own = [k for k, r in enumerate(rows) if r[2] == s]
        key = lambda k: hashlib.md5(f"{'null' if rows[k][0] is None else rows[k][0]}:{signed(spark_hash(rows[k][1]))}".encode()).hexdigest()
        stream = [k for k in sorted(own, key=lambda k: (key(k), size[k])) for _ in range(size[k])]
        blocks = [stream[k : k + block] for k in range(0, len(stream), block)]
        for rank in range(min(served[s], 3 * len(blocks))):
            for k in blocks[rank % len(blocks)]:
                out[k] += 1
    return out


def tree_score(model, x):
    """Probability of one candidate, walking each tree from its root."""
    total = 0.0
    for (feature, cut_at, left, right, value), w in zip(model.trees, model.weights):
        node = 0
        while feature[node] >= 0:
            node = int(left[node] if x[feature[node]] <= cut_at[node] else right[node])
        total += w * value[node]
    return 1 / (1 + math.exp(-2 * total))


def selected(text, model, base, candidates):
    """Candidates that pass their kind's threshold, best first, none over a base span or a better one."""
    scored = sorted(((-tree_score(model, f), s) for s, f in candidates(text)))
    out = []
    for p, s in scored:
        if -p >= model.thresholds[s[1]] and all(s[2] <= t[0] or t[2] <= s[0] for t in base + out):
            out.append(s)
    return out
