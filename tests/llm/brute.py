"""Plain versions of the corpus operators' contracts, to hold the Spark ones against."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[::-1]]
    return sum(d if n % 2 == 0 else sum(divmod(2 * d, 10)) for n, d in enumerate(odd)) % 10 == 0


def pii_base(text: str | None) -> list[tuple[str, int, int]]:
    text, found = text or "", []
    found += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def secrets_base(text: str | None) -> list[tuple[str, int, int]]:
    text, found = text or "", []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def simhash(text: str | None) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = SPACES.findall(lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_rows(docs):
    """docs: (doc_id, text) with ids."""
    fps = [simhash(t) for _, t in docs]
    links = [(docs[i][0], docs[j][0]) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = components({d for d, _ in docs}, links)
    return sorted((d, f"{f:016x}", root[d]) for (d, _), f in zip(docs, fps))


def removed_rows(docs):
    """docs: (doc_id, text), ids unique."""
    where = defaultdict(list)
    split = {d: SPACES.findall(t or "") for d, t in docs}
    for d in sorted(split):
        for i in range(len(split[d]) - 19):
            where[tuple(split[d][i : i + 20])].append((d, i))
    gone = defaultdict(set)
    for places in where.values():
        for d, i in places[1:]:
            gone[d].update(range(i, i + 20))
    return sorted((d, len(w), len(gone[d]), sha(" ".join(x for n, x in enumerate(w) if n not in gone[d]))) for d, w in split.items())


def linked_vectors(rows, least=0.9):
    """rows: (vec_id, vector); (vec_id, n_links, component_id, kept)."""
    fit = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for n, (a, x) in enumerate(fit) for b, y in fit[:n] if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least]
    degree = Counter(i for link in links for i in link)
    root = components({i for i, _ in rows if i is not None}, links)
    return sorted(((i, degree[i], root[i], root[i] == i) for i, _ in rows if i is not None))


def weighted_jaccard(a: str | None, b: str | None, width=5) -> float:
    def terms(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
        parts = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
        return {t: 1 + np.log(n) for t, n in Counter(parts).items()}

    x, y = terms(a), terms(b)
    if not x and not y:
        return 1.0
    top = {t: max(x.get(t, 0), y.get(t, 0)) for t in x.keys() | y.keys()}
    return sum(min(x.get(t, 0), y.get(t, 0)) for t in top) / sum(top.values())


def token_count(score, longest, word: bytes) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[s][0] + score[word[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in score))
    return -best[-1][1]
