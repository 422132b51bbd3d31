"""What the operators say, in plain Python over lists: nothing is hashed, joined or shared out."""

import hashlib
import math
import re
from collections import defaultdict

from dossier.llm import decontam

MARKS = str.maketrans(dict.fromkeys(".,;:!?\"'()[]{}«»“”„*_\t\n\v\f\r", " "))
N, U, A = decontam.NUMBER, decontam.UNIT, decontam.NAME


def tokens(text):
    """(lower-cased words, templates)."""
    raw = re.sub(r"([0-9])[.,](?=[0-9])", r"\1", text or "").translate(MARKS).split(" ")
    raw = [w for w in raw if w]
    made = []
    for w in raw:
        if re.fullmatch(r"[$€£¥₹+-]?[0-9][0-9/]*", w):
            made.append(N)
        elif re.fullmatch(rf"[$€£¥₹+-]?[0-9][0-9/]*(?:{decontam.UNITS})", w, re.I):
            made.append(N + U)
        elif made and made[-1] == N and re.fullmatch(decontam.UNITS, w, re.I):
            made.append(U)
        elif w[0].isupper() and all(c.islower() for c in w[1:]):
            made.append(A)
        else:
            made.append(w.lower())
    return [w.lower() for w in raw], made


def windows(words, size):
    return [tuple(words[i : i + size]) for i in range(max(len(words) - size, 0) + 1)] if words else []


def is_slot(t):
    return t[0] in (N, U, A)


def template_leak(doc, item, size=5):
    """(windows held, windows of the item, whether values differ) of a pair of texts, or nothing."""
    (plain, made), (item_plain, item_made) = tokens(doc), tokens(item)
    wanted = {i: w for i, w in enumerate(windows(item_made, size)) if 2 * sum(not is_slot(t) for t in w) >= min(size, len(item_made))}
    here = windows(made, size)
    places = defaultdict(list)
    for at, w in wanted.items():
        for doc_at, v in enumerate(here):
            if v == w:
                places[doc_at - at].append(at)
    held, changed = set(), False
    for shift, ats in places.items():
        pairs = {(item_made[p], item_plain[p], plain[p + shift]) for at in ats for p in range(at, at + len(wanted[at])) if is_slot(item_made[p])}
        if len({p[1] for p in pairs}) == len(pairs):
            held |= set(ats)
            changed |= any(a != b for _, a, b in pairs)
    return (len(held), len(wanted), changed) if wanted and len(held) >= 0.8 * len(wanted) else None


def plain_leak(doc, item, size=5):
    words, wanted = tokens(doc)[0], tokens(item)[0]
    width = min(size, len(wanted))
    wanted = windows(wanted, width) if wanted else []
    have = set(windows(words, width)) if len(words) >= width else set()
    n = sum(w in have for w in wanted)
    return (n, len(wanted)) if wanted and n >= 0.8 * len(wanted) else None


def grams(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)) if words)


def size_of(text):
    return len((text or "").encode().split())


def targets(rows, budget=1.5):
    """rows: (source, words)."""
    sizes = defaultdict(int)
    for s, n in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        stop = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        for s in stop:
            target[s] = float(2 * sizes[s])
            left -= 2 * sizes[s]
        free -= stop
        if not stop:
            return sizes, target | {s: weight[s] * level for s in free}


def queue(rows, packet=256, seed=42):
    """rows: (id, source, text). The words taken of each row in each of its two turns, by one sorted queue."""
    sizes, target = targets([(s, size_of(t)) for _, s, t in rows])
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    placed = sorted((("n" if s is None else "s" + s), md5(f"{seed}:{'' if i is None else i}:{md5(t or '')}"), size_of(t), k) for k, (i, s, t) in enumerate(rows))
    before, line = defaultdict(int), []
    for key, digest, size, k in placed:
        s = rows[k][1]
        for turn in (0, 1):
            for p in range(-(-size // packet)):
                words = min(packet, size - p * packet)
                line.append(((before[key] + turn * sizes[s] + p * packet + words) / target[s], key, digest, before[key], turn, p, words, k))
        before[key] += size
    left, taken = math.floor(sum(target.values()) + 0.001), defaultdict(int)
    for *_, turn, _, words, k in sorted(line):
        taken[k, turn] += min(words, left)
        left -= min(words, left)
    return taken


def shard(key, tree):
    """The shard that a key reaches."""

    def weight(node):
        return sum(map(weight, node.values())) if isinstance(node, dict) else node

    while isinstance(tree, dict):
        wait = {n: -math.log((int(hashlib.md5(f"{key}/{n}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / weight(c) for n, c in tree.items()}
        name = min(wait, key=lambda n: (wait[n], str(n)))
        tree = tree[name]
    return name
