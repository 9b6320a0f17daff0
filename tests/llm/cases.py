"""One table with every awkward row, and brute-force forms of the operators."""

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row long, h string, n_words long, "
          "kept string, component_id string, score string, rep long, key string, position long, slot long, n long, "
          "token_ids string, decoded string, __label string, quality int")


def corpus(seed=3):
    """(doc_id, text): near copies, exact copies, shared passages, short, empty, null and very long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def words(count):
        return [rng.choice(vocabulary) for _ in range(count)]

    passage = words(60)
    made = [" ".join(words(rng.randint(30, 120))) for _ in range(40)]
    base = words(150)
    for edits in (0, 1, 1, 2, 3, 5, 8, 12, 20):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        made.append(" ".join(copy))
    made += [" ".join(words(20) + passage + words(15)), " ".join(words(3) + passage[5:50]), " ".join(passage)]
    made += ["same  text\tas another " * 9] * 3 + ["A b C d e", "a B c D e", "one", "one two", "", " \n ", None, None]
    made += ["\n".join(" ".join(words(8)) for _ in range(500)), "zz " * 3000, "x" * 20000, "a\nb\n\na\nb c\n"]
    made += ["!!! ### 123", "<|endoftext|> it's we'll", "naïve façade 日本語 😀"]
    return list(enumerate(made))


def awkward(spark):
    rows = [(i, t, None if i % 7 == 0 else "ab"[i % 2], None if i % 5 == 0 else f"s{i % 3}", len(t or ""))
            for i, t in corpus()]
    rows += [rows[3], rows[3], rows[45], (None, "no key at all, but words", None, None, None), (None, None, None, None, None)]
    filler = (7, "clash", 9, "clash", "clash", "clash", 5, "clash", 4, 3, 2, "clash", "clash", "clash", 1)
    return spark.createDataFrame([r + filler for r in rows], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_components(rows, width, percent):
    """Smallest reachable key for each distinct (key, text)."""
    sets = []
    for _, text in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return [(len(sets[i]), least.get(top(i))) for i in range(len(rows))]


def without_repeats(texts, length):
    """(kept text, removed words) of each text of the list."""
    split = [words_of(t) for t in texts]
    seen = {}
    for w in split:
        for i in range(len(w) - length + 1):
            seen[tuple(w[i:i + length])] = seen.get(tuple(w[i:i + length]), 0) + 1
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((" ".join(x for i, x in enumerate(w) if i not in gone), len(gone)))
    return out
