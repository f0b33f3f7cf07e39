import ast
import hashlib
import random
import subprocess
import sys
import time

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from marginalia.llm import bpe

from .helpers import awkward_rows, frame

ARGS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def library():
    return tiktoken.Encoding("ranks", pat_str=ARGS[1], mergeable_ranks=load_tiktoken_bpe(ARGS[0]), special_tokens={})


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 8)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 2)
    monkeypatch.setattr(bpe, "LEAF_IDS", 2)
    monkeypatch.setattr(bpe, "MEMO_CHARS", 3)
    monkeypatch.setattr(bpe, "MEMO_SIZE", 50)
    return bpe.BytePairCodec(*ARGS)


def test_tree_equals_the_library(small_leaves):
    c, rng, want = small_leaves, random.Random(5), library().encode_ordinary
    alphabet = ["a", "b", "the ", " ", "\n", "'", "'s", "1", "23", "é", "漢字", "!!", "\t", "  ", "ab" * 5, "'ll", "😀", "ing"]
    for _ in range(4000):
        some = rng.sample(alphabet, rng.choice([1, 2, 4, 10]))
        text = "".join(rng.choice(some) for _ in range(rng.choice([0, 3, 10, 60, 300])))
        ids = c.encode(text)
        assert ids == want(text), text
        assert c.decode(ids) == text.encode()


def test_documents_equal_the_library():
    c, want = bpe.BytePairCodec(*ARGS), library().encode_ordinary
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist():
        assert c.encode(text or "") == want(text or "")


@pytest.mark.parametrize("text", ["a" * 20000, " " * 20000 + "x", "=" * 9000 + "x" + " " * 999 + "y", "漢字" * 9000, "ab" * 9000 + "'" * 5000 + "s", "1" * 9999], ids=lambda t: t[:2])
def test_long_pre_tokens(text):
    c = bpe.BytePairCodec(*ARGS)
    began = time.perf_counter()
    ids = c.encode(text)
    assert time.perf_counter() - began < 10
    assert ids == library().encode_ordinary(text) and c.decode(ids) == text.encode()


def test_no_library_on_the_main_path():
    names = {a.name for node in ast.walk(ast.parse(open(bpe.__file__).read())) if isinstance(node, ast.Import | ast.ImportFrom) for a in node.names}
    assert not names & {"tiktoken", "tokenizers", "sentencepiece"}
    code = f"import sys; from marginalia.llm import bpe; c = bpe.BytePairCodec({ARGS[0]!r}, {ARGS[1]!r}); c.encode('some text'); assert 'tiktoken' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=bpe.__file__.rsplit("/marginalia/", 1)[0])


def test_rows(spark):
    rows, want_ids = awkward_rows(), library().encode_ordinary
    got = bpe.encode_documents(frame(spark, rows), *ARGS, ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()
    want = []
    for r in rows:
        ids, data = want_ids(r[1] or ""), (r[1] or "").encode()
        want.append((str(r[0]), ids, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), data, hashlib.sha256(data).hexdigest()))
    assert sorted((str(r[0]), list(r[1]), r[2], r[3], bytes(r[4]), r[5]) for r in got) == sorted(want)
    assert bpe.encode_documents(frame(spark, []), *ARGS).count() == 0
