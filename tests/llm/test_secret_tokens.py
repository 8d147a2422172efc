"""Every token of a text may be part of a secret: short ones, numbers and plain words too."""

import numpy as np
import pytest

from rooftally.llm import secret_tagger as G


def learned():
    rng = np.random.default_rng(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    def name(n):
        return "".join(rng.choice(list(letters), n))
    out = []
    for k in range(400):
        secret = [name(6), name(11), str(rng.integers(100_000, 999_999)), name(7).title()][k % 4]
        words = [name(int(rng.integers(2, 9))) for _ in range(8)] + ["passphrase", "is", secret, "and"] + [name(int(rng.integers(2, 9))) for _ in range(4)]
        tags = [G.BEGIN if w is secret else G.OUTSIDE for w in words]
        out.append((words, tags, " ".join(words)))
    return G.train(out)


@pytest.mark.parametrize("secret", ["tulips", "windowframe", "493817", "Bridget"])
def test_plain_words_and_numbers_can_be_secrets(secret):
    text = f"the old note says passphrase is {secret} and nothing more of that"
    assert [text[a:b] for a, b in learned().spans(text)] == [secret]


def test_cuts_do_not_change_the_best_path():
    rng, cut = np.random.default_rng(8), 0
    for _ in range(40):
        tagger = G.Tagger(rng.normal(size=(G.SHAPES, 3)) * 0.5, rng.normal(size=(len(G.OFFSETS), G.BUCKETS, 3)) * 0.5, np.zeros((G.FILES, 3)), rng.normal(size=(3, 3)))
        tagger.file[:, G.OUTSIDE] = 1.0
        words = [w for w in rng.choice(["a", "=", "k3y", "plain", "9", "Zx81kQ92mm", "token", "x.y-z"], 60)]
        scores = tagger.all_scores(words, tagger.file[G.file_features(" ".join(words))].sum(axis=0))
        base = tagger.file[G.file_features(" ".join(words))].sum(axis=0)
        assert np.allclose(scores, [tagger.scores(words, k, base) for k in range(len(words))])
        tags, found = tagger.best(scores), []
        for k, tag in enumerate(tags):
            if tag == G.INSIDE and k and tags[k - 1] != G.OUTSIDE:
                found[-1][1] = k
            elif tag != G.OUTSIDE:
                found.append([k, k])
        text = " ".join(words)
        places = [m.span() for m in G.TOKEN.finditer(text)]
        assert tagger.spans(text) == [(places[a][0], places[b][1]) for a, b in found]
        cut += (~tagger.undecided(scores)).sum()
    assert cut > 0
