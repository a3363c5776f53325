import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspan.llm import bpe
from veilspan.llm._text import string_bytes
from veilspan.llm.queries import tokenizer_path

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def voc():
    return bpe.vocabulary(tokenizer_path())


@pytest.fixture(scope="module")
def theirs():
    with open(tokenizer_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(voc, theirs, texts):
    data, offsets = string_bytes(pa.array(texts, pa.large_string()))
    ids, at = voc.encode(data, offsets)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == theirs.encode_ordinary(t), t
    back, back_at = voc.decode(ids, at)
    assert back.tobytes() == data.tobytes()
    assert np.array_equal(back_at, offsets)


def test_like_the_library(voc, theirs):
    check(voc, theirs, ["", "a", " ", "\n", "it's we'll I'd you've they're I'm don't", " 's 'S ''s", "a  b \n\n c\t", "x" * 300, "ab" * 2000, " " * 600, "naïve 漢字 😀!! ½ Ⅷ", "end  "])


PARTS = [*"aeortsLV'  \n\t1½é漢😀.!-", "'s", "'re", "'ll", " the", "\r\n", "\u00a0", "\x1c", "\u0301"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), max_size=6))
def test_any_text(voc, theirs, texts):
    check(voc, theirs, texts)


def test_pieces_are_the_patterns(voc):
    text = "A line's  end,\n 12 more…  x'y 'tis"
    data, offsets = string_bytes(pa.array([text]))
    starts = bpe.pieces(data, offsets)
    assert [len(text[: m.start()].encode()) for m in regex.finditer(public_tokenizers.PATTERN, text)] == starts.tolist()


def test_query_columns_and_odd_rows(spark, theirs):
    rows = [(1, "hello world", "x"), (1, "hello world", "y"), (None, None, None), (3, "", "z"), (4, "long " * 50000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted(bpe.encode(df, tokenizer_path(), keep_ids=True).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert len(out) == 5
    for r in out:
        text = {1: "hello world", None: "", 3: "", 4: "long " * 50000}[r.doc_id]
        ids = theirs.encode_ordinary(text)
        assert (r.n_tokens, r.decoded, list(r.ids)) == (len(ids), text, ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(df.limit(0), tokenizer_path()).count() == 0
