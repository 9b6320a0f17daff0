"""Each operator on awkward rows against brute force, a library, an exact round trip or held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexispark.llm import bpe, chosen_path, ftrl, iblt, langid, ordinal, pfair, substring_dedup, target_ratio, token_files
from tests.conftest import SMALL
from tests.llm.cases import SCHEMA, awkward, corpus, near_components, without_repeats, words_of

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 substring dedup -------------------------------------------------------------------------

@pytest.mark.parametrize("length", [8, 35])
def test_repeats(odd, length):
    got = substring_dedup.remove_repeats(odd, length=length).select(
        "doc_id", "text", "kept_text", "n_removed", "repeat_bounds", "source").collect()
    expected = without_repeats([r.text for r in got], length)
    assert [(r.kept_text, r.n_removed) for r in got] == expected
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(
        map(str, ((r.doc_id, r.text) for r in odd.select("doc_id", "text").collect())))
    for r in got:
        bounds = r.repeat_bounds
        assert sum(b - a for a, b in zip(bounds[0::2], bounds[1::2])) == r.n_removed


def test_repeats_of_nothing(none):
    assert substring_dedup.remove_repeats(none).count() == 0


# ---- 2 token files -----------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 999, dtype=np.uint64).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), bits, 999) == ids).all()
    if bits < 32:
        with pytest.raises(ValueError):
            token_files.pack(np.array([1 << bits], np.uint32), bits)


@pytest.mark.parametrize("vocabulary", [50257, 50257 * 3])
def test_token_files(spark, odd, tmp_path, vocabulary):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    path = f"file://{tmp_path}/set"
    token_files.write_token_files(odd, path, file, vocabulary, end_id=2)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(file)
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    before = 0
    assert len(got) == len(rows)
    for r, (key, text) in zip(got, rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (key, before, len(ids))
        assert np.frombuffer(bytes(r.ids_le32), "<u4").tolist() == ids
        before += len(ids)


def test_token_files_of_nothing(spark, none, tmp_path):
    path = f"file://{tmp_path}/set"
    token_files.write_token_files(none, path, public_tokenizers.path("byte_bpe_50k.json"), 50257, end_id=2)
    assert token_files.read_token_files(spark, path).count() == 0


def test_random_access(spark, odd, tmp_path):
    path = f"{tmp_path}/set"
    token_files.write_token_files(odd.coalesce(1), path, public_tokenizers.path("byte_bpe_50k.json"), 70000, end_id=2)
    import glob

    for name in glob.glob(f"{path}/*.tok"):
        shard = token_files.Shard(name)
        every = shard.ids(0, shard.n_ids)
        for low, high in ((0, 1), (3, 3), (7, 50), (shard.n_ids - 5, shard.n_ids)):
            assert (shard.ids(max(low, 0), high) == every[max(low, 0):high]).all()


# ---- 3 byte-level BPE --------------------------------------------------------------------------

def test_merges_equal_the_library():
    import tiktoken

    ranks = bpe.load_ranks(MULTI)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
    rng = random.Random(2)
    for _ in range(3000):
        piece = "".join(rng.choice("aabcdeenst'é日 \n0") for _ in range(rng.randint(1, 30))).encode()
        assert ranks.encode_piece(piece) == library._encode_single_piece(piece)
    assert ranks.encode_piece(b"a" * 3000) == library._encode_single_piece(b"a" * 3000)


def test_bpe(odd):
    import tiktoken

    ranks = bpe.load_ranks(MULTI)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
    got = bpe.decode(bpe.encode(odd, MULTI), MULTI).select("text", "token_ids", "decoded").collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.token_ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    both = bpe.encode(odd, MULTI, decoded=True).select("text", "decoded").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both)


def test_bpe_of_nothing_and_unknown_ids(spark, none):
    assert bpe.encode(none, MULTI, decoded=True).count() == 0
    ids = spark.createDataFrame([(1, [10**6]), (2, None), (3, []), (4, [-1]), (5, [None])], "i int, token_ids array<int>")
    assert [r.decoded for r in bpe.decode(ids, MULTI).orderBy("i").collect()] == [None, None, bytearray(), None, None]


# ---- 4 language identification -----------------------------------------------------------------

def test_code_lengths_are_those_of_the_trees():
    """Every probability of a small model, by walking the contexts one by one."""
    texts = {"a": "abracadabra abba", "b": "bcbcbd bcd dcb"}
    model_input = []
    for lang in sorted(texts):
        codes, starts, ends = langid._grams([texts[lang]])
        found, counts = np.unique(codes[starts[0]:ends[0]], return_counts=True)
        model_input.append((found, counts))
    model = langid.Model(sorted(texts), [m[0] for m in model_input], [m[1] for m in model_input])

    def trees(text):
        data, out = b"\n\n\n" + text.encode(), {}
        for i in range(3, len(data)):
            for order in range(4):
                out.setdefault(data[i - order:i], {}).setdefault(data[i], 0)
                out[data[i - order:i]][data[i]] += 1
        return out

    def cost(tree, context, symbol):
        if context is None:
            return -np.log(256.0)
        shorter = context[1:] if context else None
        if context not in tree:
            return cost(tree, shorter, symbol)
        seen = tree[context]
        total = sum(seen.values()) + len(seen)
        if symbol in seen:
            return np.log(seen[symbol] / total)
        return np.log(len(seen) / total) + cost(tree, shorter, symbol)

    probe = "abcd dabé zab"
    codes, starts, ends = langid._grams([probe])
    got = model.log_probability(codes[starts[0]:ends[0]])
    data = b"\n\n\n" + probe.encode()
    for k, lang in enumerate(sorted(texts)):
        tree = trees(texts[lang])
        expected = [cost(tree, data[i - 3:i], data[i]) for i in range(3, len(data))]
        assert np.allclose(got[:, k], expected, atol=1e-4)


def test_language_accuracy_on_held_out_documents(spark):
    from lexispark.llm.queries import QUERIES

    found = QUERIES["op4_language_id"](spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(truth, "doc_id").collect()
    assert len(held) > 20 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97


def test_language_of_awkward_rows(odd, none):
    model = langid.train(odd)
    got = langid.identify(odd, model).select("text", "lang_pred", "score", "bits_per_byte", "source").collect()
    assert len(got) == odd.count()
    for r in got:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.bits_per_byte) == ("und", 0.0, None)
        else:
            assert r.lang_pred in ("a", "b") and 0 < r.score <= 1
    assert langid.identify(none, model).count() == 0
    empty = langid.train(none)
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, empty).collect()} == {("und", 0.0)}


def test_model_stays_within_its_bound(odd):
    model = langid.train(odd, grams=300)
    assert len(model.four) <= 300


# ---- 5 quality rules ---------------------------------------------------------------------------

def brute_base(text):
    w = words_of(text)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def spark_hash(*parts):
    import xxhash

    seed = 42
    for part in parts:
        seed = xxhash.xxh64_intdigest(part.encode(), seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_grams(text, buckets):
    w = words_of(text)
    return [spark_hash(x) % buckets for x in w] + [spark_hash(x, y) % buckets for x, y in zip(w, w[1:])]


def test_quality_rules(spark, odd):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 60)] + [(None, 1), (5, 1)], "doc_id long, good int")
    ratios = target_ratio.train(odd, labels, F.col("good") == 1, buckets=512)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    raw, target = np.zeros(512), np.zeros(512)
    for key, text in rows:
        for g in brute_grams(text, 512):
            raw[g] += 1
            target[g] += key is not None and key < 60 and (key % 3 > 0 or key == 5)
    expected = np.round(10_000 * (np.log((target + .5) / (target.sum() + 256)) - np.log((raw + .5) / (raw.sum() + 256))))
    assert np.abs(np.array(ratios) - expected).max() <= 1
    got = target_ratio.judge(odd, ratios, buckets=512, threshold=0.05).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(r.text)
        grams = brute_grams(r.text, 512)
        assert r.score == pytest.approx(sum(ratios[g] for g in grams) / 10_000 / max(len(grams), 1), abs=1e-9)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed and r.score >= 0.05)


def test_quality_rules_of_nothing(spark, none, odd):
    labels = spark.createDataFrame([], "doc_id long, good int")
    ratios = target_ratio.train(none, labels, F.col("good") == 1, buckets=64)
    assert ratios == [0] * 64
    assert target_ratio.judge(none, ratios, buckets=64).count() == 0
    assert target_ratio.judge(odd, target_ratio.train(odd, labels, F.col("good") == 1)).count() == odd.count()


# ---- 6 fingerprints ----------------------------------------------------------------------------

def test_fingerprints(odd):
    got = iblt.fingerprints(odd).collect()
    rows = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    shown = {}
    for key, text in rows:
        h = spark_hash(text)
        if key not in shown or h < shown[key][0]:
            shown[key] = (h, text)
    order = sorted(shown, key=lambda k: (k is not None, k or 0), reverse=True)
    following = {k: shown[order[(i + 1) % len(order)]][1] for i, k in enumerate(order)}
    halves = {k: max(len(t) for q, t in rows if q == k) // 2 for k in shown}

    def paragraphs(text):
        return {x for x in text.split("\n") if re.search(r"[^ \t\n\x0b\f\r]", x)}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    left = {}
    for key, text in rows:
        edited = text[:len(text) - len(text) // 2] + following[key][:halves[key]][:len(text) // 2]
        p = paragraphs(text)
        left.setdefault((key, len(text), hashlib.sha256(edited.encode()).hexdigest()), []).append(
            (like(p, paragraphs(edited)), like(p, paragraphs(following[key]))))
    for r in got:
        near = left[(r.doc_id, r.n_chars, r.edited_sha256)].pop()
        assert (r.d.edited.near, r.d.next.near) == pytest.approx(near)


def test_peeling_recovers_the_difference_and_retries(spark):
    rng = random.Random(4)
    rows = []
    for size in (0, 1, 5, 40, 400):
        common = [rng.getrandbits(60) for _ in range(size)]
        rows.append((common + [rng.getrandbits(60) for _ in range(size // 2)], common + [rng.getrandbits(60) for _ in range(size)]))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").select(
        "a", "b", iblt.difference(F.col("a"), F.col("b")).alias("d"),
        iblt.difference(F.col("a"), F.col("b"), (2,)).alias("tiny"))
    for r in df.collect():
        for d in (r.d, r.tiny):
            assert (set(d.mine), set(d.theirs)) == (set(r.a) - set(r.b), set(r.b) - set(r.a))
    sizes = [r.d.size for r in df.collect()]
    assert sizes[0] == 8 and sizes[-1] > 128
    assert df.collect()[-1].tiny.size is None


def test_fingerprints_of_little(spark, none):
    assert iblt.fingerprints(none).count() == 0
    one = iblt.fingerprints(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")).collect()
    assert one[0].d.next.near == 1.0


# ---- 7 ordinal grades, 10 toxicity -------------------------------------------------------------

def test_grades(spark, odd, none):
    from lexispark.llm.queries import QUERIES

    found = QUERIES["op7_quality_grade"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.95
    assert sum(r.p_good for r in good) / len(good) > sum(r.p_good for r in bad) / len(bad) + 0.2
    assert all(0 <= r.p_best <= r.p_good <= 1 and abs(r.expected_grade - r.p_good - r.p_best) < 1e-9 for r in rows)
    model = ordinal.train(odd, labels, F.col("quality"), top=1)
    graded = ordinal.grade(odd, model, top=1).collect()
    assert len(graded) == odd.count()
    assert ordinal.grade(none, model, top=1).count() == 0
    unfitted = ordinal.train(none, labels, F.col("quality"), top=2)
    assert {tuple(r.tail) for r in ordinal.grade(odd, unfitted, top=2).collect()} == {(0.5, 0.5)}


def test_toxicity(spark, odd, none):
    from lexispark.llm.queries import QUERIES

    found = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.85 and hit / sum(r.predicted for r in rows) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    model = ftrl.train(odd, labels, F.col("toxic"))
    scored = ftrl.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert ftrl.score(none, model).count() == 0
    assert ftrl.train(none, labels, F.col("toxic")) == []
    assert {r.score for r in ftrl.score(odd, []).collect()} == {0.5}


# ---- 8 near-dedup ------------------------------------------------------------------------------

@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80), (3, 50)])
def test_near_groups(odd, width, percent):
    got = chosen_path.near_groups(odd, width=width, percent=percent).select(
        "doc_id", "text", "n_shingles", "component_id", "kept", "source").collect()
    expected = near_components([(r.doc_id, r.text) for r in got], width, percent)
    assert [(r.n_shingles, r.component_id) for r in got] == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == odd.count()


def test_near_groups_of_nothing(none):
    assert chosen_path.near_groups(none).count() == 0


def test_a_mass_of_near_copies(spark, monkeypatch):
    """More near copies than a small node holds, around the threshold, with small blocks."""
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
        rows.append((i, " ".join(copy)))
    got = chosen_path.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    by_key = {r.doc_id: r.component_id for r in got}
    assert [by_key[i] for i in range(150)] == [c for _, c in near_components(rows, 3, 85)]
    assert len(set(by_key.values())) > 1


# ---- 9 mixing ----------------------------------------------------------------------------------

def test_mix_keeps_rows_and_shares(spark, odd, none):
    rows = [(i, f"s{min(i % 10, 6)}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = pfair.mix_sources(docs, block=4, frame=64).orderBy("position").collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(rows)
    assert [r.position for r in got] == list(range(1, 2001))
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    share = {r.source: r.quanta / 64 for r in pfair.quanta(counts, 64).collect()}
    assert sum(share.values()) == pytest.approx(1)
    blocks = {}
    for r in got:
        blocks[(r.source, r.block)] = r.slot
    ends = {s: max(slot for (q, _), slot in blocks.items() if q == s) for s in share}
    taken = dict.fromkeys(share, 0)
    by_slot = {slot: s for (s, _), slot in blocks.items()}
    assert len(by_slot) == len(blocks)
    for slot in range(min(ends.values()) + 1):
        taken[by_slot[slot]] += 1
        assert all(abs(taken[s] - share[s] * (slot + 1)) < 1 for s in share)
    assert pfair.mix_sources(odd).count() == odd.count()
    mixed = pfair.in_mixed_order(odd)
    assert mixed.columns == odd.columns and mixed.count() == odd.count()
    assert pfair.mix_sources(none).count() == 0


# ---- the pipeline ------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    """Every stage by brute force on what the one before it left."""
    import corpus_pipeline as pipeline
    from lexispark.session import settle

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "123 !!!", None, "src0", 7), (10**6 + 1, None, "en", None, None)], docs.schema)
    before, after = docs.unionByName(extra), {}
    columns = docs.columns
    tables = [settle(before)]
    for name, stage in pipeline.STAGES:
        tables.append(settle(stage(spark, tables[-1], SMALL)))
        after[name] = [r.asDict() for r in tables[-1].collect()]
    assert all(t.columns == columns for t in tables[:-1])
    start = [r.asDict() for r in before.collect()]
    assert {r["doc_id"] for r in start} - {r["doc_id"] for r in after["language_id"]} == {10**6, 10**6 + 1}
    kept = [(r["doc_id"], r["text"]) for r in after["language_id"]]
    groups = near_components(kept, 5, 80)
    assert {r["doc_id"] for r in after["near_dedup"]} == {c for _, c in groups}
    texts = [r["text"] for r in after["near_dedup"]]
    struck = dict(zip((r["doc_id"] for r in after["near_dedup"]), without_repeats(texts, 35)))
    old = {r["doc_id"]: r for r in after["near_dedup"]}
    assert len(after["substring_dedup"]) == len(old)
    for r in after["substring_dedup"]:
        text, gone = struck[r["doc_id"]]
        assert r["text"] == (text if gone else old[r["doc_id"]]["text"])
        assert r["n_chars"] == (len(text) if gone else old[r["doc_id"]]["n_chars"])
    assert sorted(map(str, after["source_mix"])) == sorted(map(str, after["substring_dedup"]))
    texts = {r["doc_id"]: r["text"] for r in after["source_mix"]}
    assert len(after["byte_bpe"]) == len(texts)
    ranks = bpe.load_ranks(MULTI)
    for r in after["byte_bpe"]:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert ranks.decode(np.array(r["token_ids"], np.int64))[0].tobytes() == texts[r["doc_id"]].encode()


def test_pipeline_on_no_rows_and_repeated_rows(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    for given, least in ((docs.limit(0), 0), (docs.unionByName(docs), 1)):
        for _, stage in pipeline.STAGES:
            given = stage(spark, given, SMALL)
        assert given.count() >= least
