import numpy as np

from rooftally.llm import toxicity as X


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.filter("doc_id % 3 <> 0")
    chain = X.fit_chain(docs, fitted, X.label_categories())
    judged = X.toxicity(docs, chain).select("doc_id", "toxic", "p_junk").join(labels, "doc_id")
    seen = docs.join(fitted, "doc_id").select("text").distinct()  # copies of what was learnt don't count
    fresh = docs.join(seen, "text", "left_anti").select("doc_id")
    rows = judged.filter("doc_id % 3 = 0").join(fresh, "doc_id").collect()
    bad, good = [r.toxic for r in rows if r[4]], [r.toxic for r in rows if not r[4]]
    # of the labelled documents about one in twenty has no word that any other toxic one has
    assert len(bad) > 50 and np.mean(bad) > 0.87 and np.mean(good) < 0.005
    assert np.mean([(r.p_junk > 0.5) == (r.quality == 0) for r in rows]) > 0.97


def test_chain_feeds_earlier_probabilities():
    docs = [{"a"} if k % 2 else {"b"} for k in range(200)]
    first = np.array([k % 2 for k in range(200)])
    chain = X.train_chain(docs, {"one": first, "two": first}, np.arange(200) % 5)
    assert len(chain[0].earlier) == 0 and len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0
    assert X.predict(chain, "a")[1] > 0.9 > 0.1 > X.predict(chain, "b")[1]


def test_out_of_fold_predictions_do_not_see_their_rows():
    # a word of its own for each document would give the label away to a model that had seen it
    rng = np.random.default_rng(0)
    docs = [{f"w{k // 4}"} for k in range(400)]
    y = rng.integers(0, 2, 100).repeat(4)
    chain = X.train_chain(docs, {"noise": y, "next": rng.integers(0, 2, 400)}, np.arange(400) // 4 % 5)
    assert abs(chain[1].earlier[0]) < 2


def test_awkward_rows(table):
    schema = "doc_id long, text string, p_toxic string, junk int, key int"
    docs = table([(i, t, "c", 0, 0) for i, t in enumerate([None, "", "bad bad", "fine words", "bad thing", "nice", "x " * 50_000])]
                 + [(None, "bad", "c", 0, 0), (2, "bad bad", "c", 0, 0)], schema)
    labels = table([(2, 1, 1), (3, 1, 0), (4, 1, 1), (5, 1, 0), (99, 1, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    chain = X.fit_chain(docs, labels, X.label_categories())
    out = X.toxicity(docs, chain)
    assert out.count() == 9 and all(r.toxic is not None for r in out.collect())
    kept = X.drop_toxic(docs, chain)
    assert kept.columns == docs.columns
    none = X.fit_chain(docs, labels.limit(0), X.label_categories())
    assert none == [] and X.toxicity(docs, none).filter("toxic").count() == 0 and X.drop_toxic(docs, none).count() == 9
    assert X.toxicity(docs.limit(0), chain).count() == 0


def test_traits_of_whole_texts():
    assert X.traits_of("", []) == set()
    def traits(text):
        return X.traits_of(text, text.split())
    assert traits("a plain text of some words\nand another line") == set()
    assert traits("HA HA HA HA HA HA HA HA HA HA") == {"~echoes0", "~echoes1", "~repeats0", "~repeats1", "~repeats2", "~capitals0", "~capitals1"}
    assert traits("one### two### three### four###") == {"~marks0", "~marks1"}
    assert traits("same line\nsame line\nother words here\nsame line") >= {"~lines0"}


def test_repeated_labelled_rows_count_once(spark):
    rows = [(k, f"{'bad' if k % 4 == 0 else 'fine'} word{k % 7} text{k}", k) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int")
    labels = spark.createDataFrame([(k, 1 - (k % 4 == 0), int(k % 8 == 0)) for k in range(200)], "doc_id long, quality int, toxic int")
    once = X.fit_chain(docs, labels, X.label_categories())
    assert X.fit_chain(docs.union(docs).union(docs.where("doc_id < 50")), labels, X.label_categories()) == once
