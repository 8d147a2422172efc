"""A worker keeps its encoder, and a word that repeats among texts that are encoded together is looked up once."""

import numpy as np
import pyarrow as pa
import pytest

from rooftally.llm import packing as K
from rooftally.llm.queries import tokenizer_path
from test_packing import TEXTS, whole

MORE = [*(t or "" for t in TEXTS), "no_space", "tab\tonly", "ends in a line\n", "ends in a space ", " ", "\n x", "a \n b", "same same same, same", "日本 語 日本"]


class Counted(dict):
    """A dictionary that counts how often words are read."""

    reads = 0

    def __getitem__(self, word):
        Counted.reads += 1
        return super().__getitem__(word)


@pytest.mark.parametrize("letters", [0, 1 << 24])
@pytest.mark.parametrize("remembered", [1, 1000])
def test_ids_are_those_of_whole_texts(monkeypatch, remembered, letters):
    monkeypatch.setattr(K, "REMEMBERED_LETTERS", letters)
    encoder = K.WordEncoder(tokenizer_path(), remembered)
    for texts in (MORE, MORE[::-1], MORE[3:5], [], [""], ["word"]):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == whole(texts)


def test_repeated_words_are_looked_up_once():
    encoder = K.WordEncoder(tokenizer_path())
    encoder.words = Counted()
    texts = ["first the same few words again and again " + "the same few words " * 50] * 20
    Counted.reads = 0
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == whole(texts)
    assert Counted.reads < 20


def test_worker_keeps_its_encoder(monkeypatch):
    made = []
    monkeypatch.setattr(K.WordEncoder, "__init__", (lambda old: lambda self, *a, **k: (made.append(a), old(self, *a, **k))[1])(K.WordEncoder.__init__))
    batch = pa.RecordBatch.from_arrays([pa.array(MORE), pa.array(range(len(MORE))), pa.array(range(len(MORE)))], ["text", "doc_id", "mix"])
    one = pa.Table.from_batches(K._pieces(tokenizer_path(), 0, 1024)([batch]))
    monkeypatch.setattr(K, "PORTION", 20)
    many = list(K._pieces(tokenizer_path(), 0, 1024)([batch, batch.slice(0, 0)]))
    assert len(many) > 5 and pa.Table.from_batches(many).equals(one)
    assert len(made) <= 1


def test_words_at_hand_stay_when_the_memory_is_full(monkeypatch):
    encoder = K.WordEncoder(tokenizer_path(), 4)
    encoder.encode(["x often other third"])
    learned = []
    monkeypatch.setattr(encoder, "_learn", lambda missing, old=encoder._learn: (learned.append(set(missing)), old(missing)))
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(["x often new newer"])] == whole(["x often new newer"])
    assert learned == [{"new", "newer"}] and "other" not in encoder.words


def test_placing_takes_the_best_of_all_kinds_that_fit():
    rng = np.random.default_rng(2)
    demand, limits = np.stack([rng.integers(1, 64, 400), np.ones(400, int), rng.integers(0, 50, 400)], axis=1), np.array([64, 3, 50])
    kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)
    bins, order = K.place(demand, limits)
    left, room, used = np.bincount(kind_of.reshape(-1)), limits.astype(float), 0
    for item in np.argsort(order):
        fits = np.flatnonzero((kinds <= room).all(axis=1) & (left > 0))
        if not len(fits):
            room, used = limits.astype(float), used + 1
            fits = np.flatnonzero(left > 0)
        weight = np.ones(3) if (room == limits).all() else room / limits
        values = (kinds[fits] / limits) @ weight
        kind = kind_of.reshape(-1)[item]
        assert bins[item] == used and kind in fits and values[fits == kind][0] == pytest.approx(values.max())
        left[kind] -= 1
        room = room - kinds[kind]
