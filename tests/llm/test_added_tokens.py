"""Token files against the library as it comes, on texts that hold its added tokens."""

import numpy as np
import public_tokenizers

from lexispark.llm import queries, token_files
from tests.llm.cases import awkward

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>it's", "x<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext",
         "plain words", None, "", "two\n<|endoftext|>\n\nlines <|endoftext|>  ", "last 日本語<|endoftext|> 😀"]


def _check(got, rows):
    from tokenizers import Tokenizer

    library, before = Tokenizer.from_file(FILE), 0
    assert len(got) == len(rows)
    for r, (key, text) in zip(got, rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (key, before, len(ids))
        assert np.frombuffer(bytes(r.ids_le32), "<u4").tolist() == ids
        before += len(ids)


def test_added_tokens_have_their_own_ids(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    path = f"file://{tmp_path}/set"
    token_files.write_token_files(
        spark.createDataFrame(rows, "doc_id long, text string"), path, FILE, 50257, end_id=2)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    _check(got, rows)
    assert got[0].n_tokens == 5 and 50256 in np.frombuffer(bytes(got[0].ids_le32), "<u4")


def test_awkward_rows_as_the_library_does(spark, tmp_path):
    docs = awkward(spark)
    path = f"file://{tmp_path}/set"
    token_files.write_token_files(docs, path, FILE, 50257, end_id=2)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    _check(token_files.read_token_files(spark, path).orderBy("start").collect(), rows)


def test_the_query_knows_added_tokens(spark, tmp_path):
    import zlib

    from tokenizers import Tokenizer

    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library, before = Tokenizer.from_file(FILE), 0
    for r in queries.QUERIES["op2_token_files"](spark, str(tmp_path)).orderBy("doc_id").collect():
        ids = [*library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
