"""Ids and equality where hashes, Unicode tables or table sizes could go wrong."""

import numpy as np
import public_tokenizers
import pytest

from lexispark.llm import bpe, chosen_path, substring_dedup, textkit, token_files
from tests.llm.cases import without_repeats

FILE = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def alternating(size, first="a", second="b"):
    """The Thue-Morse word: it and its complement have one hash under any polynomial modulo a power of two."""
    return [second if i.bit_count() % 2 else first for i in range(size)]


def tokenizers_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def tiktoken_library():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_made_to_collide(spark, size):
    one, other = alternating(size), alternating(size, "b", "a")
    assert len(set(textkit.window_hashes(np.array([ord(c) for c in one + other], np.uint64), size).tolist())) == size + 1
    texts = ["".join(one), "".join(other), " ".join(one), " ".join(other), "".join(one) + " and " + "".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    encoded = {r.doc_id: (r.token_ids, bytes(r.decoded)) for r in bpe.encode(docs, MULTI, decoded=True).collect()}
    library = tiktoken_library()
    for i, text in enumerate(texts):
        assert encoded[i] == (library.encode_ordinary(text), text.encode())
    plain = tokenizers_library()
    ids = {r.doc_id: r.ids for r in token_files.encode_texts(docs, FILE, 2).collect()}
    for i, text in enumerate(texts):
        assert ids[i] == [*plain.encode(text, add_special_tokens=False).ids, 2]
    groups = {r.doc_id: r.component_id for r in chosen_path.near_groups(docs, width=size, percent=85).collect()}
    assert groups == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    split = spark.createDataFrame([(0, " ".join(one)), (1, " ".join(other))], "doc_id long, text string")
    got = [(r.kept_text, r.n_removed) for r in substring_dedup.remove_repeats(split, length=size).orderBy("doc_id").collect()]
    assert got == without_repeats([" ".join(one), " ".join(other)], size) == [(" ".join(one), 0), (" ".join(other), 0)]


def test_products_modulo_the_prime():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, textkit.PRIME, 5000, dtype=np.uint64) for _ in range(2))
    a[:3], b[:3] = [0, textkit.PRIME - 1, textkit.PRIME - 1], [5, textkit.PRIME - 1, 1]
    assert textkit.times(a, b).tolist() == [int(x) * int(y) % textkit.PRIME for x, y in zip(a, b)]
    values = rng.integers(0, 2**64 - 1, 300, dtype=np.uint64)
    same = textkit.span_hashes(np.concatenate((values, values)), np.array([7, 307]), np.array([200, 500]))
    assert same[0] == same[1]


def probe_texts(template):
    codes = [*range(0xD800), *range(0xE000, 0x110000)]
    return ["\n".join(template.format(chr(c), chr(c)) for c in codes[low:low + 8192]) for low in range(0, len(codes), 8192)]


@pytest.mark.parametrize("template", ["{}'s", ".{}", " {}1", "a{}1{}."])
def test_every_code_point_as_the_libraries_do(template):
    texts = probe_texts(template)
    encoder = token_files._encoder(FILE, token_files.classes(FILE))
    ids, bounds = encoder(texts)
    library = tokenizers_library()
    for i, e in enumerate(library.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == e.ids
    if template in (".{}", " {}1"):
        return
    encoder = bpe._encoder(MULTI, bpe.classes())
    ids, bounds = encoder(texts)
    for i, expected in enumerate(tiktoken_library().encode_ordinary_batch(texts)):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == expected


def test_packed_classes_are_the_same():
    classes = textkit.char_classes()
    assert (textkit.unpacked_classes(textkit.packed_classes(classes)) == classes).all()


def test_slots_grow_and_searches_end():
    slots = textkit.HashSlots(4)
    keys = textkit.mix(np.arange(5000, dtype=np.uint64))
    for part in np.array_split(keys, 37):
        slots.add(part, np.arange(slots.count, slots.count + len(part)))
        assert 3 * slots.count <= 2 << slots.bits
    assert slots.find(keys).tolist() == list(range(5000))
    assert (slots.find(textkit.mix(np.arange(5000, 9000, dtype=np.uint64))) == -1).all()


def test_more_distinct_pre_tokens_than_are_remembered():
    encoder = textkit.PieceEncoder(lambda pieces: [list(p.encode()) for p in pieces], limit=100)
    texts = [" ".join(f"{i}x{i * 7}" for i in range(k * 300, k * 300 + 700)) for k in range(4)] + ["y" * 60 + " " + "z" * 60]
    for _ in range(2):
        for text in texts:
            ids, bounds = encoder([text, None, text])
            assert ids.tolist() == list(text.encode()) * 2 and bounds.tolist() == [0, len(text), len(text), 2 * len(text)]
