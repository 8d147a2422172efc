import zlib

import numpy as np
import pytest

from rooftally.llm.packing import WordEncoder, pack, place
from rooftally.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, length long, bin string"
TEXTS = ["", None, "a", "word " * 3000, "one  two  three\n\n four", " lead", "trail ", "a\tb \n c", "Ünïcode — ‘quotes’ 123 456!!",
         "x  y", "  ", "\n", "end\x1c next", "<|endoftext|> said", "a b c " * 400,
         "don't stop, won't; Élan,\nvital über... x!'s ²½ ª ab² naïve—word (see) 日本語 дом, a.b 3,4 l'été ÷× end.'ll Ǆ ǅ,ɐ."]


def whole(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("remembered", [1, 1000])
def test_remembered_words_give_the_tokenizer_ids(remembered):
    texts = [t or "" for t in TEXTS]
    got = [np.frombuffer(b, "<u4").tolist() for b in WordEncoder(tokenizer_path(), remembered).encode(texts)]
    assert got == whole(texts)


def test_every_id_lies_in_one_piece_of_a_sequence(table):
    rows = [(i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, None), (3, "word " * 3000, 7, "x")]
    out = pack(table(rows, SCHEMA), tokenizer_path(), group_rows=4).toPandas()
    assert list(out.columns) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for i, ids in enumerate(whole([t or "" for t in TEXTS])):
        ids = np.array(ids + [0], "<u4")
        got = out[out.doc_id == i].sort_values("start")
        times = 2 if i == 3 else 1
        assert got.length.sum() == times * len(ids) and set(got.doc_tokens) == {len(ids)}
        for p in got.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 1024
    assert out.doc_id.isna().sum() == 1


def test_limits_hold_together(table):
    rows = [(i, "w " * (i % 40), 0, "") for i in range(300)]
    out = pack(table(rows, SCHEMA), tokenizer_path(), length=64, most_segments=3, most_loss=50).toPandas()
    grouped = out.groupby("sequence_id").agg(n=("length", "size"), tokens=("length", "sum"))
    assert grouped.n.max() <= 3 and grouped.tokens.max() <= 64
    assert (out.length.sum() - len(out)) <= 50 * len(grouped)


def test_place_fills_bins():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1024, 5000)
    demand = np.stack([sizes, np.ones_like(sizes), sizes - 1], axis=1)
    bins, order = place(demand, np.array([1024, 64, 1024]))
    loads = np.bincount(bins, sizes)
    assert loads.max() <= 1024 and sizes.sum() / (1024 * len(loads)) > 0.97
    assert sorted(order) == list(range(5000))


def test_empty_table(table):
    assert pack(table([], SCHEMA), tokenizer_path()).count() == 0
