"""Plain brute-force versions of the training-data operators."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    found = words(lowered(text))
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def similar(a, b, percent=75):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def components(docs):
    """(n_shingles, component_id) in row order of (doc_id, text) pairs."""
    sets = [shingles(text) for _, text in docs]
    group = list(range(len(docs)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if similar(sets[a], sets[b]):
                group[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return [(len(sets[k]), least[find(k)]) for k in range(len(docs))]


def removed_lines(docs):
    """Places of lines with an earlier similar line, of documents with unique ids."""
    seen, out = [], {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        out[doc_id] = []
        for place, line in enumerate((text or "").split("\n")):
            if len(words(line)) < 5:
                continue
            mine = shingles(line)
            if any(similar(mine, other) for other in seen):
                out[doc_id].append(place)
            seen.append(mine)
    return out


def base_figures(text):
    text = text or ""
    found = words(text)
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    counts = collections.Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = set()
    for i in range(len(found) - 4):
        if counts[tuple(found[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def chat_row(turns):
    """turns: (role, text) in order."""
    whole = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
    loss = "".join(text or "" for role, text in turns if role == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(whole), len(loss), sha(loss)
