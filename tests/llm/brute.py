"""Plain Python versions of the corpus operators, straight from their definitions."""

import hashlib
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def components(rows, n=5):
    """{id: (set size, component)} by comparing every pair that shares a token."""
    sets = {}
    for i, text in rows:
        w = SPACED.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({("", *w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    posts = {}
    for i, s in sets.items():
        for t in s:
            posts.setdefault(t, []).append(i)
    for i, s in sets.items():
        for j, both in Counter(j for t in s for j in posts[t] if j < i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contaminated(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = WORDS.findall((text or "").translate(LOWER))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for k in lengths:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in windows:
                    hit.update(range(p, p + k))
                    found |= windows[g]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def base_secrets(text):
    text = text or ""
    # (?i) of this pattern must not reach past ASCII
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6 and m[0].isascii()]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def quality(text, most_covered, most_lines):
    text = text or ""
    w = [(m[0], m.start()) for m in SPACED.finditer(text)]
    chars = sum(len(x) for x, _ in w)
    covered = {}
    for n in {5, *most_covered}:
        grams = Counter(tuple(x for x, _ in w[i : i + n]) for i in range(len(w) - n + 1))
        covered[n] = {i + j for i in range(len(w) - n + 1) if grams[tuple(x for x, _ in w[i : i + n])] > 1 for j in range(n)}
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if SPACED.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(len(x) for x in SPACED.findall(line))
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered[5]) > 20 * len(w)
    over = 100 * dup_chars > most_lines * chars or any(100 * sum(len(w[i][0]) for i in covered[n]) > most * chars for n, most in most_covered.items())
    return len(w), chars, sum(c in "#*$%&|<>" for c in text), dup, len(covered[5]), failed, not failed and not over


def base_licenses(text, phrases):
    w = WORDS.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in phrases:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def url(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def cut_lines(rows, least_words, least_lines):
    """{id: (text, removed, runs, longest)} by comparing every suffix of lines with every earlier one of the same first line."""
    docs = {i: (text or "").split("\n") for i, text in rows}
    full = {i: [k for k, x in enumerate(lines) if SPACED.search(x)] for i, lines in docs.items()}
    place = {}
    out = {}
    for i in sorted(docs):
        lines, at = docs[i], full[i]
        gone, end, runs = set(), 0, []
        for p, k in enumerate(at):
            best = 0
            for j, q in place.get(lines[k], []):
                n = 0
                while p + n < len(at) and q + n < len(full[j]) and lines[at[p + n]] == docs[j][full[j][q + n]]:
                    n += 1
                best = max(best, n)
            place.setdefault(lines[k], []).append((i, p))
            if best and p + best > end:
                end = p + best
                if best >= least_lines or sum(len(SPACED.findall(lines[x])) for x in at[p:end]) >= least_words:
                    gone.update(at[p:end])
                    runs.append(best)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone), len(runs), max(runs, default=0))
    return out


def token_rows(rows, path, end=1):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(path), 0, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out
