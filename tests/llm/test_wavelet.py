import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casewright.llm import wavelet
from casewright.llm.queries import vocabulary


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500))
def test_access_rank_and_select(values):
    ids = np.array(values, np.uint16)
    matrix = wavelet.WaveletMatrix.build(ids, 6)
    assert (matrix.decode() == ids).all()
    for at in range(0, len(ids), 97):
        assert matrix.access(at) == ids[at]
    for token in (0, 3, 40, 63, 64):
        places = np.flatnonzero(ids == token)
        assert matrix.rank(token, len(ids)) == len(places)
        assert matrix.count(token, len(ids) // 3, len(ids)) == (places >= len(ids) // 3).sum()
        for k in {0, len(places) // 2, len(places) - 1, len(places)}:
            assert matrix.select(token, k) == (places[k] if 0 <= k < len(places) else -1)


@pytest.fixture(scope="module")
def encoder():
    return wavelet.Encoder(vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aZéÉß'’0 \n<|>s.,end")), max_size=60))
def test_encoder_equals_the_library(encoder, text):
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text.encode()), encoder.dtype).tolist() == want


def test_round_trip(spark, documents, edges, tmp_path):
    path, tokenizer = str(tmp_path / "shards"), wavelet._tokenizer(vocabulary())
    rows = [*edges, (12, "don't <|endoftext|> WE'LL " * 30)]
    wavelet.write(documents(rows), path, vocabulary(), shard_tokens=500)
    got = sorted(wavelet.documents(spark, path).collect(), key=lambda r: r["start"])
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows}
    crc = {t: zlib.crc32(np.array(v, "<u4").tobytes()) for t, v in ids.items()}
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(ids[t]), crc[t]) for i, t in rows)
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    shards = wavelet.shards(spark, path)
    assert shards.count() == len(list((tmp_path / "shards").glob("*.parquet"))) > 3, "one file for each shard"
    found = wavelet.find(spark, path, wavelet.END).collect()
    assert sum(r["n"] for r in found) == sum(v.count(1) for t, v in ((t, ids[t]) for _, t in rows))


def test_empty_table(spark, documents, tmp_path):
    wavelet.write(documents([]), str(tmp_path / "none"), vocabulary())
    assert wavelet.documents(spark, str(tmp_path / "none")).count() == 0
