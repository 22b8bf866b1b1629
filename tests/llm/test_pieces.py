import hashlib
import random

import pytest

from tidemark.llm import pieces
from tidemark.llm.queries import tokenizer_model

WEIRD = [None, "", " ", "  ", "\n", "▁", "a▁b", "\x00x", "1234 5,678.90", "e\u0301 ﬁ ½ 中文字符", "<0x0A> <s> </s> <unk>", "\t\t a \r\n", "😀👨‍👩‍👧 ok", " lead", "trail ", "a  b   c" + " " * 40 + "d", "x" * 5000, "abc " * 3000, "中" * 2000, "Éaia.\nThe end.\n\n\nNew"]


@pytest.fixture(scope="module")
def model():
    return tokenizer_model()


def test_equal_to_the_library(spark, model):
    rnd = random.Random(1)
    texts = WEIRD + ["".join(rnd.choices(["the", "tion", " ", "  ", "é", "\n", "7", "Qz", ".", "▁", "ß", "日", "'s"], k=rnd.randrange(120))) for _ in range(300)]
    lib = pieces.Agenda(model).library
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    full = {r.doc_id: r for r in pieces.encode_decode(d, model, digests=True).collect()}
    slim = {r.doc_id: r for r in pieces.encode_decode(d, model, lists=False, digests=True).collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t or "")
        r = full[i]
        assert r["ids"] == want and r.n_tokens == len(want) and r.decoded == lib.decode(want)
        assert r.ids_sha256 == slim[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == slim[i].decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()
    assert pieces.encode_decode(d.limit(0), model).collect() == []


def test_matrix_and_heap_agendas_agree(model):
    import numpy as np

    a = pieces.Agenda(model)
    rnd = random.Random(2)
    parts = ["▁" + "".join(rnd.choices("etaoinshrdluéßи日\x00😀.'", k=rnd.randrange(0, 47))) for _ in range(3000)] + ["▁▁▁", "\n", "7", "aaaaaaaaaaaaaaaa", "x"]
    assert [np.frombuffer(x, np.int32).tolist() for x in a.rows_merged(parts)] == [a.merged(p) for p in parts]


def test_pairs_survive_clashes():
    import numpy as np

    rnd = np.random.default_rng(3)
    keys = np.unique(rnd.integers(0, 1 << 40, 5000))
    table = pieces.Pairs(keys[::2], np.arange(len(keys[::2]), dtype=np.int32))
    table2 = pieces.Pairs(keys[:3], np.arange(3, dtype=np.int32))  # a small table, where most keys want the same slots
    assert (table.get(keys[::2]) == np.arange(len(keys[::2]))).all() and (table.get(keys[1::2]) == -1).all()
    assert (table2.get(keys[:3]) == np.arange(3)).all() and (table2.get(keys[3:]) == -1).all()


def test_tables_stay_bounded_and_texts_in_any_order(model):
    rnd = random.Random(2)
    texts = [" ".join("".join(rnd.choices("abcde\n1", k=rnd.randrange(1, 6))) for _ in range(50)) for _ in range(40)]
    b = pieces.Agenda(model, remembered=40)
    for t in texts:
        assert b.text_ids(t) == b.library.encode(t)
        assert len(b.words) <= 40 + 51 and len(b.old) <= 40 + 51
    assert list(b.encode(texts)) == b.library.encode(texts)


def test_a_difference_stops(model):
    import numpy as np

    a = pieces.Agenda(model)
    wrong = lambda part: np.array([5], np.int32).tobytes()
    a.rows_merged = lambda parts: [wrong(p) for p in parts]
    with pytest.raises(AssertionError):
        list(a.encode(["something new"]))
    a = pieces.Agenda(model)
    a.merged = lambda part: [5]
    with pytest.raises(AssertionError):
        list(a.encode(["long" * 50]))
    a = pieces.Agenda(model)
    ids = a.text_ids("one two three")
    assert a.decoded(["one two three"], [ids]) == ["one two three"]
    with pytest.raises(AssertionError):  # right parts, but not all of them
        a.decoded(["one two three"], [ids[:-1]])


def test_the_query_carries_digests_of_every_text(spark, model, tmp_path):
    from tidemark.llm.queries import op10_sentencepiece

    texts = WEIRD + ["Long " * 20_000]
    spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    lib = pieces.Agenda(model).library
    got = {r.doc_id: r for r in op10_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
