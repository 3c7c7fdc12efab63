import zlib

import numpy as np
import pytest

from relgrid.llm import token_store
from relgrid.llm.runtime import tokenizer_file

from .conftest import corpus, prose

VOCABULARY = "word_bpe_49k.json"


def plain(text):
    from tokenizers import Tokenizer

    global _T
    try:
        _T
    except NameError:
        _T = Tokenizer.from_file(tokenizer_file(VOCABULARY))
    return [*_T.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", ["it's don't I'LL'd", "a'sb's", "é́ éa ≠x", "x<|endoftext|>y <|ENDOFTEXT|>", "1234 a1b2 ½ ٣", "ÀÉ×÷ ß…ok", "  wide\x85x\x1cy", "ﬁ ǅ İstanbul ΑΣ", "tab\tnl\n\x0b", "a.b,c--d__e", "", "東京ABC"])
def test_encoder_equals_whole_texts(text):
    enc = token_store.Encoder(tokenizer_file(VOCABULARY))
    raw = text.encode()
    ids = enc.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    assert [*ids.tolist(), 2] == plain(text)


def test_round_trip(spark, docs, empty, tmp_path):
    got = token_store.token_files(spark, docs, tokenizer_file(VOCABULARY)).collect()
    rows = sorted(((r[0] if r[0] is not None else -(2**63), (r[1] or "").encode() if r[1] is not None else b"", r) for r in corpus()), key=lambda x: x[:2])
    at, want = 0, []
    for _, _, r in rows:
        ids = plain(r[1])
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    # texts of one id may be stored in either order where one is null and the other empty
    assert sorted(map(str, ((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, want))
    assert token_store.token_files(spark, empty, tokenizer_file(VOCABULARY)).count() == 0


def test_random_access_reads_wanted_frames_only(tmp_path):
    path = str(tmp_path / "shard.zst")
    w = token_store.ShardWriter(path, 2)
    rng, docs = np.random.default_rng(0), {}
    for i in range(40):
        docs[i] = rng.integers(0, 40000, 20000 if i != 7 else 400000)
        w.add(i, docs[i])
    w.add(None, np.array([5]))
    w.close()
    r = token_store.ShardReader(path)
    assert (r.ids(7) == docs[7]).all() and r.n_read <= 4
    assert r.ids(40).tolist() == [5] and r.docs["doc_id"][40] == token_store.NO_ID
    assert {i: x.tolist() for i, x in token_store.read_documents([path], [3, 39])} == {3: docs[3].tolist(), 39: docs[39].tolist()}
    raw = bytearray(open(path, "rb").read())
    raw[10] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="damaged"):
        token_store.ShardReader(path).ids(0)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    from relgrid.llm.minhash import brute_force

    def text(i):
        return " ".join(w + "***" for w in prose(60, i).split()) if i % 3 == 0 else prose(60, i)

    rows = [(i, text(i), "en", "hot" if i % 2 else "a", 1) for i in range(200)] + [(1000 + i, text(1 + 3 * i), "en", "hot", 1) for i in range(10)] + [(1000, text(1), "en", "hot", 1), (1020, None, None, None, None), (1021, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, text(190)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), f"test-{name}")
        ids.append(sorted(r.doc_id for r in docs.collect()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {i for i in ids[0]}
    assert not any(i % 3 == 0 for i in good if i < 200) and {i for i in range(200) if i % 3} <= good
    kept = brute_force([(r[0], r[1]) for r in rows if r[0] in good], 5, 80)
    assert set(ids[1]) == {k for k, v in kept.items() if k == v[1]} and len(set(ids[1])) == len(ids[1])
    assert 190 not in ids[2] and set(ids[1]) - set(ids[2]) == {190}
    assert set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids[4]
