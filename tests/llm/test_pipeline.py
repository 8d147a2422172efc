"""Each stage of the pipeline against a plain version of itself, on its own input."""

import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from rooftally.llm import toxicity as X
from rooftally.llm.common import table as read
from rooftally.llm.line_dedup import LEAST_SITES
from rooftally.llm.packing import WordEncoder
from rooftally.llm.queries import tokenizer_path
from test_line_dedup import brute as brute_lines
from test_near_copies import brute as brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each, and the columns."""
    folder = tmp_path_factory.mktemp("stages")
    docs = read(spark, SF, "documents")
    kept = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        kept.append((name, docs))
    return {name: (df.columns, df.collect()) for name, df in kept}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    first = stages["documents"][0]
    assert all(stages[n][0] == first for n in ("toxicity", "line_dedup", "simhash", "mixing"))


def test_toxicity_keeps_what_the_chain_does_not_reject(spark, stages):
    chain = X.fit_chain(read(spark, SF, "documents"), read(spark, SF, "labels"), X.label_categories())
    want = [r for r in stages["documents"][1] if X.predict(chain, r.text)[-1] <= chain[-1].limit]
    assert Counter(stages["toxicity"][1]) == Counter(want) and 0 < len(want) < len(stages["documents"][1])


def test_lines(stages):
    before = stages["toxicity"][1]
    want = {(repr(r.doc_id)): r for r in before}
    texts = {d: t for d, _, _, t in brute_lines([(r.doc_id, r.source, r.text) for r in before], LEAST_SITES)}
    after = stages["line_dedup"][1]
    assert len(after) == len(before)
    for r in after:
        old = want[repr(r.doc_id)]
        assert r.text == texts[repr(r.doc_id)] and r.n_chars == len(r.text) and (r.lang, r.source) == (old.lang, old.source)


def test_one_document_of_each_group(stages):
    """Groups of five-word shingles with a similarity of 0.8 or more, by all pairs; the smallest doc_id of each stays."""
    before = sorted(stages["line_dedup"][1], key=lambda r: r.doc_id)
    assert Counter(stages["simhash"][1]) == Counter(brute_groups([tuple(r) for r in before]))


def test_mixing_repeats_whole_documents_towards_the_weights(stages):
    before, after = Counter(stages["simhash"][1]), Counter(stages["mixing"][1])
    assert before.keys() == after.keys() and all(1 <= after[r] <= 2 * n for r, n in before.items())
    tokens, mixed = defaultdict(int), defaultdict(int)
    for r, n in before.items():
        tokens[r.source] += n * len(r.text.split())
    for r, n in after.items():
        mixed[r.source] += n * len(r.text.split())
    ratio = {s: mixed[s] / tokens[s] for s in tokens}
    assert ratio[max(tokens, key=tokens.get)] == 1.0 and max(ratio.values()) <= 2.0
    assert min(tokens, key=tokens.get) in sorted(ratio, key=ratio.get)[-5:]


def test_pieces_hold_all_ids(stages):
    encoder = WordEncoder(tokenizer_path())
    want = Counter()
    for r in stages["mixing"][1]:
        ids = encoder.encode([r.text])[0] + bytes(4)
        for start in range(0, len(ids), 4096):
            want[r.doc_id, start // 4, zlib.crc32(ids[start:start + 4096])] += 1
    pieces = stages["packing"][1]
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in pieces) == want
    used = defaultdict(list)
    for r in pieces:
        used[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 1024 and sorted(s)[0][0] == 0 for s in used.values())


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages["packing"][0] and got.count() == len(stages["packing"][1])
