"""Plain versions of the operators on lists of rows, for comparison: no Spark, no index, no blocks."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = (1 << 21) - 1


def words(text):
    return WORD.findall(text or "")


# ---- languages


def grams(text):
    out: Counter = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = f"_{w}_"
        out.update(w)
        out.update(padded[k : k + 2] for k in range(len(padded) - 1))
        out.update(padded[k : k + 3] for k in range(len(padded) - 2))
    return out


def code(gram):
    """Grams in order of their characters, a shorter one before those that it begins, the edge of a word last."""
    return tuple(EDGE if c == "_" else ord(c) for c in gram)


def ranks(counts, size):
    return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:size])}


def profiles(rows, size=300):
    """Of (text, lang): lang to gram to rank."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(grams(text))
    return {lang: ranks(c, size) for lang, c in counts.items() if c}


def language(text, known, size=300):
    own = ranks(grams(text), size)
    if not own or not known:
        return "und", 0.0
    best = min(sorted(known), key=lambda lang: sum(abs(known[lang][g] - k) if g in known[lang] else size for g, k in own.items()))
    apart = sum(abs(known[best][g] - k) if g in known[best] else size for g, k in own.items())
    return best, min(1.0, max(0.0, 1 - apart / (size * len(own))))


# ---- mixing


def apportioned(base, shares, house, limits=None, most=None):
    """Highest quotients: base seats mended until they add up to the house; shares by place."""
    due = house - sum(base)
    tried = []
    for place, b in enumerate(base):
        for j in range(abs(due) if most is None else min(abs(due), most)):
            seat = b + j if due > 0 else b - 1 - j
            if seat >= 0 and (due < 0 or limits is None or seat < limits[place]):
                q = shares[place] / (seat * 2 + 1)
                tried.append((-q if due > 0 else q, place, j))
    seats = list(base)
    for _, place, _ in sorted(tried)[: abs(due)]:
        seats[place] += 1 if due > 0 else -1
    return seats


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Of source sizes in order: targets by resharing what caps leave, one round after the other."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    left, fixed = share * sum(sizes), {}
    while len(fixed) < len(sizes):
        open_ = [k for k in range(len(sizes)) if k not in fixed]
        level = left / sum(w[k] for k in open_)
        over = [k for k in open_ if w[k] * level > cap * sizes[k]]
        if not over:
            return [fixed.get(k, w[k] * level) for k in range(len(sizes))]
        for k in over:
            fixed[k] = float(cap * sizes[k])
            left -= fixed[k]
    return [fixed[k] for k in range(len(sizes))]


def mix(rows, block=16, per_shard=1024, cap=2):
    """Of (doc_id, text, source): (doc_id, size, source_size, target, taken)."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    mine = [[(r[0], len(words(r[1]))) for r in rows if r[2] == s] for s in sources]
    sizes = [sum(n for _, n in m) for m in mine]
    goal = targets(sizes)
    seats = apportioned([math.floor(t / block + 0.5) for t in goal], goal, math.floor(sum(goal) / block + 0.5))
    out = []
    for m, size, target, seat in zip(mine, sizes, goal, seats, strict=True):
        n = -(-len(m) // per_shard)
        shards = [[] for _ in range(n)]
        for i, own in m:
            h = hashlib.md5(f"0:{'' if i is None else i}".encode()).hexdigest()
            shards[int(h[:8], 16) % n].append((h, i, own))
        lengths = [sum(x[2] for x in s) for s in shards]
        blocks = [max(1, -(-x // block)) for x in lengths]
        filled = [k for k in range(n) if shards[k]]
        base = [min(math.floor(seat * lengths[k] / max(size, 1) + 0.5), blocks[k] * cap) for k in filled]
        quotas = apportioned(base, [lengths[k] for k in filled], seat, [blocks[k] * cap for k in filled], 3)
        for k, quota in zip(filled, quotas, strict=True):
            start = 0
            for _, i, own in sorted(shards[k], key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
                part = max(0, min(start + own, quota % blocks[k] * block) - start)
                out.append((i, own, size, target, quota // blocks[k] * own + part))
                start += own
    return out


# ---- sharding


def shards(rows, n=16, group_share=0.05):
    """Of (doc_id, text): (doc_id, size, crc, shard, slot) by byte positions in the order of keys."""
    low = (1 << 31) - 1
    keyed = []
    for i, t in rows:
        crc = None if t is None else zlib.crc32(t.encode())
        h = 42 if i is None else xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), seed=42)
        keyed.append(((crc or 0) * (1 << 31) + (h & low), i, len((t or "").encode()) + 1, crc))
    keyed.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2]))
    total = sum(x[2] for x in keyed) or 1
    group = defaultdict(lambda: [0, 0])
    stop = 0
    for _, _, size, crc in keyed:
        stop += size
        group[crc][0] += size
        group[crc][1] = stop
    out, stop, slots = [], 0, Counter()
    for _, i, size, crc in keyed:
        stop += size
        own, last = group[crc]
        middle = last - own / 2 if own <= group_share * total / n else stop - size / 2
        shard = min(n - 1, math.floor(middle * n / total))
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return out


# ---- near duplicates

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = words((text or "").translate(_LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def first_of_groups(rows, k=5, percent=80):
    """Of (doc_id, text) with distinct ids: the ids that are the least of their component."""
    sets = {i: shingles(t, k) for i, t in rows}
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b <= a or not sets[a]:
                continue
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {i for i in ids if find(i) == i}


# ---- decontamination


def template_tokens(text, units):
    """(value, slot) of each word: slot is None, 'number', 'unit' or 'name'."""
    out = []
    before, end = None, 0
    for m in WORD.finditer(text or ""):
        raw = m.group()
        opening = before is None or before[-1] in ".!?:;" or "\n" in text[end : m.start()]
        core = re.sub(r"^[\x00-/:-@\[-`{-\x7f]+|[\x00-/:-@\[-`{-\x7f]+$", "", raw)
        before, end = raw, m.end()
        if not core:
            continue
        digits = sum(c in "0123456789" for c in core)
        letters = sum(len(c.encode()) if ord(c) > 127 else c.isalpha() for c in core)
        upper = [c for c in core if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×"]
        lower = "".join(c.lower() if c in upper else c for c in core)
        number = digits > 0 and (letters == 0 or core[0] in "0123456789")
        name = not number and not opening and core[0] in upper and len(upper) == 1 and letters > 1
        unit = not number and bool(out) and out[-1][1] == "number" and lower in units
        out.append((lower, "number" if number else "unit" if unit else "name" if name else None))
    return out


def leaks(docs, items, units, window=8, coverage=0.5, run=6):
    """Of (id, text) and (id, text): (doc, item) to (matched, windows, reworded)."""
    found = {}
    for item_id, item_text in items:
        item = template_tokens(item_text, units)
        size = min(window, len(item))
        if item_id is None or not size:
            continue
        spots = range(len(item) - size + 1)
        literals = [sum(s is None for _, s in item[p : p + size]) for p in spots]
        rich = {p for p in spots if literals[p] * 8 >= size * 5}
        needed = {p for p in spots if literals[p]}
        for doc_id, doc_text in docs:
            doc = template_tokens(doc_text, units)
            if doc_id is None:
                continue
            matched, matched_rich, longest, reworded = set(), set(), 0, False
            for shift in range(-len(item) + 1, len(doc)):
                hits, exact, alike = [], set(), []
                for p in spots:
                    q = p + shift
                    if q < 0 or q + size > len(doc):
                        continue
                    a, b = item[p : p + size], doc[q : q + size]
                    if [v for v, _ in a] == [v for v, _ in b]:
                        exact.add(p)
                    masked = lambda ts: [s or ("=", v) for v, s in ts]
                    if size >= 4 and 0 < literals[p] < size and masked(a) == masked(b):
                        alike.append(p)
                hits = exact | set(alike)
                if not hits:
                    continue
                slots = {p + k: (item[p + k], doc[p + k + shift]) for p in alike for k in range(size) if item[p + k][1]}
                votes = defaultdict(Counter)
                for (v, _), (d, _) in slots.values():
                    votes[v][d] += 1
                best = {v: {d for d, n in c.items() if n == max(c.values())} for v, c in votes.items()}
                best = {v: {v} if v in ds else ds for v, ds in best.items()}
                names = Counter(d for v in {v for (v, s), _ in slots.values() if s == "name"} for d in best[v])
                good = {k for k, ((v, s), (d, _)) in slots.items() if best[v] == {d} and (s != "name" or names[d] == 1)}
                fit = {p for p in alike if all(p + k in good for k in range(size) if item[p + k][1])}
                literal = {p for p in hits if literals[p]}
                whole = len(literal) >= len(needed) > 0
                places = exact | fit if whole or exact or fit & rich else set()
                if whole and places >= literal:
                    places |= set(spots)
                if places:
                    matched |= places
                    matched_rich |= places & rich & hits
                    longest = max(longest, len(places))
                    reworded |= any(a[0] != b[0] for a, b in slots.values())
            share = max(len(matched) / len(spots), len(matched_rich) / len(rich) if rich else 0)
            if matched and (share >= coverage or longest >= run):
                found[doc_id, item_id] = (len(matched), len(spots), reworded)
    return found


def conversation_nodes(rows: list[tuple], every: int = 20) -> list[tuple]:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the rebuilt conversations' trie, from (conv_id, turn, role, text); ties by a hash of role and text."""
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(str(len(role.encode())).encode() + b":" + role.encode() + text.encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = turns.get(c - int(math.fmod(c, every)), [])[:h] + mine[h:]
    members: dict[tuple, list[int]] = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children: dict[tuple, list[tuple]] = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    totals: dict[tuple, tuple[int, int]] = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children[p]]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        totals[p] = sum(x for x, _ in below) or 1, sum(x for _, x in below) + (len(members[p]) - 1) * words
    found = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(p))
        found.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return found


def collocations(rows: list[tuple], least: int, top: int) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows, from all counts of up to five words."""
    counts: dict[str, Counter] = defaultdict(Counter)
    sizes: Counter = Counter()
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            sizes[lang or "und"] += len(w)
            counts[lang or "und"].update(w[i : i + m] for m in range(1, 6) for i in range(len(w) - m + 1))
    found = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + m] for p, a in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 100 * often.get(p[i : i + m], 1 << 60)}
        n = sizes[lang]
        scored = []
        for p, a in often.items():
            if p not in inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found += [(lang, i, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return found


# ---- pages


class _Reader(HTMLParser):
    """Blocks of a page by the standard library's parser: (text, inside an article or main, inside a container that never is)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.open = [], [], []

    def end(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.out.append((text, any(t in ("article", "main") for t, _ in self.open), any(never for _, never in self.open)))

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.held.append(" ")
        elif tag in ("p", "h1", "h2", "li", "ul", "div", "nav", "footer", "article", "body", "aside", "form", "header", "section", "main"):
            self.end()
            if tag != "p" and tag != "h1" and tag != "h2" and tag != "li":
                self.open.append((tag, tag in ("nav", "footer", "aside", "form") or dict(attrs).get("class") in ("ad", "comments", "cookie-notice", "sidebar")))
        elif tag in ("head", "script", "style"):
            self.open.append((tag, True))

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "li", "ul", "div", "nav", "footer", "article", "body", "aside", "form", "header", "section", "main", "head", "script", "style"):
            if tag in ("head", "script", "style"):
                self.held = [] if tag == "head" else self.held
            self.end()
            at = max((i for i, (t, _) in enumerate(self.open) if t == tag), default=None)
            if at is not None:
                del self.open[at:]

    def handle_data(self, data):
        if not any(t in ("head", "script", "style") for t, _ in self.open):
            self.held.append(data)


def _common(a: list, b: list) -> list[list[int]]:
    """Indices of a in each longest common subsequence's first choice, by the full table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    taken = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            taken.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return taken


def main_texts(rows: list[tuple]) -> list[tuple]:
    """(page_id, text, n_lines, n_shared) of (page_id, url, html); the nearest page of a host by trying all of it. Repeated lines in one page can be told apart only by count."""
    read = []
    for page_id, url, html in rows:
        reader = _Reader()
        reader.feed(html or "")
        reader.close()
        reader.end()
        m = re.match(r"(?s)[^:]*?://([^/?#]*)([^?#]*)", url or "") if "://" in (url or "") else None
        read.append((page_id, m[1].translate({i: i + 32 for i in range(65, 91)}) if m else "", m[2] if m else "", url or "", reader.out))
    order = sorted(range(len(read)), key=lambda i: (read[i][1], read[i][2], read[i][0] is not None, read[i][0] or 0, read[i][3]))
    found = []
    for at, i in enumerate(order):
        page_id, host, path, _, lines = read[i]
        near = [read[order[x]] for x in (at - 1, at + 1) if 0 <= x < len(order) and read[order[x]][1] == host and host]

        def alike(other, path=path):
            n = next((k for k, (x, y) in enumerate(zip(path, other[2], strict=False)) if x != y), min(len(path), len(other[2])))
            return path[:n].count("/") + (path == other[2]), n

        all_alike = [alike(x) for x in read if x[1] == host and x is not read[i]]
        assert not near or max(alike(x) for x in near) == max(all_alike)  # a neighbour in order is as near as any page
        shared: list[int] = []
        for other in sorted(near, key=alike, reverse=True):
            taken = _common([t for t, *_ in lines], [t for t, *_ in other[4]])
            if sum(len(lines[k][0]) for k in taken) <= 0.8 * sum(len(t) for t, *_ in lines):
                shared = taken
                break
        main = [t for t, inside, never in lines if inside and not never] or [t for k, (t, _, never) in enumerate(lines) if not never and k not in shared]
        found.append((page_id, "\n".join(main), len(lines), len(shared)))
    return found
