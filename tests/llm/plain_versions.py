"""Plain versions of the operators' contracts."""

import collections
import re
import string

import xxhash

SPACED = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def repeats(texts, window):
    cut = [re.findall(SPACED, text or "") for text in texts]
    counts = collections.Counter(tuple(w[i : i + window]) for w in cut for i in range(len(w) - window + 1))
    out = []
    for w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def fingerprint(text):
    words = re.findall(SPACED, (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(gram.encode(), 42) for gram in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def grouped(prints):
    """Component number of each print, by search."""

    number, k = {}, 0
    for start in prints:
        if start in number:
            continue
        queue = [start]
        number[start] = k
        while queue:
            a = queue.pop()
            for b in prints:
                if b not in number and (a ^ b).bit_count() <= 2:
                    number[b] = k
                    queue.append(b)
        k += 1
    return number


def contaminated(awkward, items, window=10):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    owners = collections.defaultdict(set)
    for name, text in items:
        w = re.findall(word, (text or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners[tuple(w[i : i + window])].add("" if name is None else str(name))
    sizes = {len(k) for k in owners}
    out = []
    for i, text in awkward:
        w = re.findall(word, (text or "").translate(LOWER))
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in owners:
                    hit.update(range(k, k + n))
                    names |= owners[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def base_counts(text):
    words = re.findall(SPACED, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(SPACED, x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(grams)
    twice = {i + j for i, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(twice)


def shingles(text):
    words = re.findall(SPACED, (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept_by_pairs(rows):
    sets = {i: shingles(text) for i, text in rows}
    left, kept = set(sets), []
    while left:
        group, queue = set(), [min(left)]
        while queue:
            a = queue.pop()
            if a in left:
                left.remove(a)
                group.add(a)
                queue += [b for b in left if similar(sets[a], sets[b])]
        kept.append(min(group))
    return sorted(kept)
