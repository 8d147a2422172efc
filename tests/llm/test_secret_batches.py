"""Texts are searched together, by distinct words: no token is looked at by itself, and no text sees its neighbours."""

import random

import numpy as np
import pytest

from rooftally.llm import secret_scan as S, secret_tagger as G
from rooftally.llm.common import distinct_words

WORDS = ["key:", "Zx81kQ92mm", "plain", "x.y-z", "Énergie", "naïve,", "İstanbul", "Kelvin", "日本語", "of.\nThen", "\x1c", "\ud800", "", "a b", "--", "k" * 5000,
         "DEADbeef01", "+/._-", "²½", "ſecret=abcdef"]


def made_up(rng):
    tagger = G.Tagger(rng.normal(size=(G.SHAPES, 3)) * 0.5, rng.normal(size=(len(G.OFFSETS), G.BUCKETS, 3)) * 0.5, rng.normal(size=(G.FILES, 3)), rng.normal(size=(3, 3)))
    tagger.file[:, G.OUTSIDE] += 1.0
    return tagger


def one_by_one(tagger, text):
    """The tags by Viterbi over the whole text, as spans."""
    places = [m.span() for m in G.TOKEN.finditer(text)]
    if not places:
        return []
    words, base = [text[a:b] for a, b in places], tagger.file[G.file_features(text)].sum(axis=0)
    out, old = [], G.OUTSIDE
    for tag, (a, b) in zip(tagger.best(np.array([tagger.scores(words, k, base) for k in range(len(words))])), places):
        if tag == G.INSIDE and old != G.OUTSIDE:
            out[-1] = (out[-1][0], b)
        elif tag != G.OUTSIDE:
            out.append((a, b))
        old = tag
    return out


@pytest.mark.parametrize("kept", [1 << 19, 3])
def test_texts_together_are_as_each_by_itself(monkeypatch, kept):
    monkeypatch.setattr(G, "KEPT_WORDS", kept)
    pick = random.Random(4)
    texts = ["", " ", "key", *(" ".join(pick.choices(WORDS, k=pick.randint(1, 30))) for _ in range(60)), ""]
    found = 0
    for seed in range(3):
        tagger = made_up(np.random.default_rng(seed))
        want = [one_by_one(tagger, t) for t in texts]
        found += sum(map(len, want))
        looked_at = []
        with monkeypatch.context() as m:
            m.setattr(G, "shape_features", lambda word: looked_at.append(word) or [0] * 10)
            assert [tagger.spans(t) for t in texts] == want
            assert [s for part in S.portions(texts, 300) for s in tagger.spans_of(part)] == want
        assert not looked_at
    assert found > 100


def test_shapes_of_many_tokens():
    pick = random.Random(9)
    letters = "abcXYZ019+/._-éÉßñİKǅ日ʼ²\U0001f600\ud800"
    words = sorted({w for t in WORDS for w in G.TOKEN.findall(t)} | {"".join(pick.choices(letters, k=pick.randint(1, 50))) for _ in range(3000)} | {"a" * 4096, "ab" * 2049})
    assert G.shapes_of(words).tolist() == [G.shape_features(w) for w in words]
    assert G.shapes_of([]).shape == (0, 10)
    assert {chr(c) for c in range(128, 0x110000) if set(chr(c).lower()) & set("aeiou")} == {chr(G._DOTTED_I)}


def test_gap_is_as_wide_as_neighbours_reach():
    assert max(map(abs, G.OFFSETS)) == G.GAP


def test_portions_hold_every_text():
    texts = ["abc", None, "", "d" * 50, "e", "f" * 9, "g"]
    for letters in (1, 10, 100):
        parts = list(S.portions(texts, letters))
        assert [t for p in parts for t in p] == texts and all(len(p) == 1 or sum(len(t or "") for t in p) <= letters for p in parts)
    assert list(S.portions([])) == []


def test_distinct_words():
    sizes, which, words = distinct_words(["a b a", "", " b"])
    assert sizes.tolist() == [3, 1, 2] and [words[k] for k in which] == ["a", "b", "a", "", "", "b"] and len(words) == 3


def test_hex_is_told_from_bytes():
    for text in ["é0123456789abcde", "0123456789abcdef", "x" + "a" * 15 + "é" + "b" * 17, "ABCDEF0123456789AB", "f" * 15 + " f", "\ud800" + "0" * 16]:
        assert S.base_spans(text) == [("hex", *m.span()) for m in S.HEX.finditer(text)]
