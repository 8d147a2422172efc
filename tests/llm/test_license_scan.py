from collections import Counter

from rooftally.llm.license_scan import TEMPLATES, Templates, bigrams, license_scan, segments, words_of


def brute(text, least=0.8):
    out = []
    for kind, a, b, words in segments(text):
        mine = Counter(zip(words, words[1:]))
        for name, versions in TEMPLATES.items():
            for k, v in enumerate(versions):
                theirs = bigrams(words_of(v))
                size = sum(mine.values()) + sum(theirs.values())
                if mine and size and 2 * sum((mine & theirs).values()) / size >= least:
                    out.append((name, k, kind, a, b))
    return sorted(out)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = Counter((r.doc_id, r.license, r.template, r.segment, r.first_line, r.last_line) for r in license_scan(docs).collect())
    want = Counter((r.doc_id, *m) for r in docs.collect() for m in brute(r.text))
    assert got == want and want


def test_awkward_rows(table):
    mit = TEMPLATES["MIT"][2]
    broken = mit.replace(". ", ".\n").replace("Software", "SOFTWARE").replace("KIND", "SORT")
    texts = [None, "", "mit", "x\n\n" + broken + "\n\ny", "Released  under, the MIT license!", "É " * 50_000, "released under the mit\nlicense"]
    df = table([(i, t, "", 0.0) for i, t in enumerate(texts)], "doc_id long, text string, license string, dice double")
    rows = license_scan(df).collect()
    assert {(r.doc_id, r.license) for r in rows} >= {(3, "MIT"), (4, "MIT"), (6, "MIT")}
    assert {r.segment for r in rows if r.doc_id == 3} == {"paragraph", "text"}
    assert Counter((r.doc_id, r.license, r.template, r.segment, r.first_line, r.last_line) for r in rows) == Counter(
        (i, *m) for i, t in enumerate(texts) if t for m in brute(t))
    assert license_scan(df.limit(0)).count() == 0


def test_every_template_finds_itself():
    known = Templates(TEMPLATES, 0.8)
    for name, versions in TEMPLATES.items():
        for k, v in enumerate(versions):
            assert (name, k, 1.0) in known.matches(words_of(v))
