"""Pipeline stages on rows that must go, rows that must stay, and columns that are called like their results."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from lexispark.llm import langid
from tests.conftest import SMALL

CLASH = ("score", "lang_pred", "bits_per_byte", "kept", "component_id", "n_shingles", "kept_text", "n_words", "n_removed",
         "repeat_bounds", "position", "block", "slot")


def junk():
    rng = random.Random(9)
    keys = "qwertyuiopasdfghjklzxcvbnm;',./[]-=0987654321"
    return [(10**6, "".join(rng.choice(keys) for _ in range(900))), (10**6 + 1, "".join(rng.choice("0123456789abcdef") for _ in range(900))),
            (10**6 + 2, "Съешь же ещё этих мягких французских булок да выпей чаю. " * 8), (10**6 + 3, "いろはにほへとちりぬるを わかよたれそつねならむ。" * 12),
            (10**6 + 4, "3141 5926 !!"), (10**6 + 5, None)]


def test_unknown_languages_go_and_clean_texts_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    strange = spark.createDataFrame([(k, t, None, "odd", 0) for k, t in junk()], docs.schema)
    left = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(strange), SMALL).select("doc_id").collect()}
    letters = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull()).select("doc_id").collect()}
    assert left.isdisjoint(k for k, _ in junk())
    assert left >= letters


def test_stages_keep_columns_named_like_their_results(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).withColumns({c: F.lit(-7) for c in CLASH})
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert out.count() > 0 and out.where(" or ".join(f"{c} <> -7" for c in CLASH)).count() == 0, name


def test_every_language_of_many_is_learned(spark):
    rng = random.Random(4)
    rows = []
    for k in range(100):
        signs = [chr(0x4E00 + 64 * k + j) for j in range(40)]
        for _ in range(1 if k else 200):        # one language has most of the text
            rows.append((f"l{k:03d}", " ".join("".join(rng.choice(signs) for _ in range(5)) for _ in range(60))))
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = langid.train(docs, grams=20_000)
    assert len(model.langs) == 100
    got = langid.identify(docs, model).select("lang", "lang_pred").distinct().collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_training_against_a_tree_of_dictionaries(spark):
    """Counts, contexts, escapes and the choice of a language, by a plain tree on small texts."""
    import math

    rng = random.Random(6)
    texts = {"a": ["the cat sat on the mat", "a cat, a hat"], "b": ["der hund sitzt", "ein hund und noch ein hund"], "c": ["xyzzy plugh"]}
    docs = spark.createDataFrame([(lang, t) for lang, ts in texts.items() for t in ts], "lang string, text string")
    model = langid.train(docs)

    def tree(ts):
        seen = {}
        for t in ts:
            data = b"\n\n\n" + t.lower().encode()
            for i in range(3, len(data)):
                for order in range(4):
                    seen.setdefault(data[i - order:i], {}).setdefault(data[i], 0)
                    seen[data[i - order:i]][data[i]] += 1
        return seen

    trees = {lang: tree(ts) for lang, ts in texts.items()}

    def bits(seen, text):
        data, spent = b"\n\n\n" + text.lower().encode(), 0.0
        for i in range(3, len(data)):
            for order in (3, 2, 1, 0):
                found = seen.get(data[i - order:i])
                if found is None:
                    continue
                whole = sum(found.values()) + len(found)
                if data[i] in found:
                    spent -= math.log2(found[data[i]] / whole)
                    break
                spent -= math.log2(len(found) / whole)
            else:
                spent += 8
        return spent

    asked = ["the hat", "hund", "plugh the", "Zebra", "noch eine katze"] + [
        "".join(rng.choice("abcdehinorstuxyz ") for _ in range(rng.randint(1, 30))) + "a" for _ in range(40)]
    rows = langid.identify(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()
    for r in rows:
        cost = {lang: bits(seen, r.text) for lang, seen in trees.items()}
        best = min(cost, key=lambda lang: (cost[lang], lang))
        size = len(r.text.encode())
        assert r.lang_pred == best and abs(r.bits_per_byte - cost[best] / size) < 1e-4
        own = sum(bits(trees[best], t) for t in texts[best]) / sum(len(t.encode()) for t in texts[best])
        share = 1 / sum(2 ** (cost[best] - c) for c in cost.values())
        allowed = langid.SLACK * own + 1 + langid.SHORT / math.sqrt(size)
        assert abs(r.score - share * 2 ** -max(cost[best] / size - allowed, 0)) < 1e-3


def test_a_small_model_judges_as_the_whole_trees(spark):
    """What the bounded model leaves out is looked up, so code lengths, languages and scores are those of all nodes."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = [(t,) for _, t in junk()] + [("",), ("Zebra qxq", ), ("Zebra qxq",)]
    asked = docs.where("doc_id % 3 = 0").select("text").unionByName(spark.createDataFrame(more, "text string"))
    whole, small = langid.train(docs), langid.train(docs, grams=2_000)
    assert whole.left_out is None and small.left_out is not None and len(small.four) <= 2_000 < len(whole.four)
    assert max(abs(whole.own - small.own)) < 1e-9
    got, want = [sorted(langid.identify(asked, m).collect(), key=lambda r: r.text or "") for m in (small, whole)]
    assert [(r.text, r.lang_pred, r.bits_per_byte is None) for r in got] == [(r.text, r.lang_pred, r.bits_per_byte is None) for r in want]
    assert all(abs(g.score - w.score) < 1e-5 and abs((g.bits_per_byte or 0) - (w.bits_per_byte or 0)) < 1e-5 for g, w in zip(got, want))


def test_judging_by_parts_stores_a_row_per_text(spark, monkeypatch):
    """However small the parts of the trees, what is stored to judge texts grows with the texts, not with their grams."""
    rng = random.Random(9)
    rows = [(lang, " ".join("".join(rng.choice(signs) for _ in range(6)) for _ in range(80)))
            for lang, signs in (("a", "abcdefgh"), ("b", "efghijkl"), ("c", "éèêëabcd")) for _ in range(6)]
    docs = spark.createDataFrame(rows + rows[:2], "lang string, text string")
    model, settled = langid.train(docs, grams=1_000), []
    others = list(model.others())
    assert len(others) > 1 and all(len(m.four) <= 1_000 for m in [model, *others])
    assert (sum(~m.left_out for m in [model, *others]) == 1).all()
    assert sum(len(m.four) for m in [model, *others]) == len(langid.train(docs).four)

    def settle(df, stored=langid.settle):
        settled.append(stored(df))
        return settled[-1]

    monkeypatch.setattr(langid, "settle", settle)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows) + 2 and all(r.lang == r.lang_pred for r in got)
    assert all(df.count() <= len(rows) for df in settled)
    widths = [len(v) for df in settled for r in df.collect() for v in r if isinstance(v, list)]
    assert widths and max(widths) == len(model.langs)
