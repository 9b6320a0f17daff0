"""Masses of near copies that are no one component."""

import random

from lexispark.llm import chosen_path


def test_a_mass_of_many_blocks_moves_each_set_once(spark, monkeypatch):
    """One base with so many changes that few copies are linked; the rows compared in blocks do not grow with the blocks."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(150):
        words = list(base)
        for place in rng.sample(range(80), 2 if i < 60 else 8):
            words[place] = f"x{rng.randrange(10**6)}"
        texts.append(words)
    texts += [[*words[:70], *(f"y{i}x{j}" for j in range(10))] for i, words in enumerate(texts[60:75])]
    texts += [words[:-1] for words in texts[-15:]]      # linked with their like alone
    sets = [{tuple(t[i:i + 3]) for i in range(len(t) - 2)} for t in texts]
    group = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    compared, in_cells = [], chosen_path._in_cells

    def counted(cells, *rest):
        compared.append((cells.count(), cells.select("rep").distinct().count()))
        return in_cells(cells, *rest)

    monkeypatch.setattr(chosen_path, "_in_cells", counted)
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    monkeypatch.setattr(chosen_path, "BLOCK", 8)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in chosen_path.near_groups(docs, width=3, percent=85).collect()}
    assert got == dict(enumerate(group)) and 20 < len(set(group)) < 170
    # in the first tree a document is in a mass on each of two branches
    assert len(compared) == 1 and compared[0][0] <= 2 * chosen_path.BRANCH * compared[0][1]
