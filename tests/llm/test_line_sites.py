from collections import Counter, defaultdict

from rooftally.llm.line_dedup import strip_boilerplate

SCHEMA = "doc_id long, source string, text string, n_chars long"


def brute(rows, least):
    """Lines on so many sites, of all copies, that stand in two different texts at least are taken out."""
    sites, texts = defaultdict(set), defaultdict(set)
    for _, s, t, _ in rows:
        for line in (t or "").split("\n"):
            sites[line.strip()].add(s or "")
            texts[line.strip()].add(t)
    gone = {x for x in sites if x and len(sites[x]) >= least and len(texts[x]) > 1}
    new = [None if t is None else "\n".join(x for x in t.split("\n") if x.strip() not in gone) for _, _, t, _ in rows]
    return Counter((d, s, t, None if t is None else len(t)) for (d, s, _, _), t in zip(rows, new))


def test_copies_of_texts_count_on_all_their_sites(table):
    texts = [f"own {k}\n copied footer\nrare {k % 2}" for k in range(3)]  # 3 texts on 12 sites; each text has a copy on the first site
    rows = [(k, f"s{k % 12:02}", texts[k % 3]) for k in range(36)] + [(50 + k, "s00", t) for k, t in enumerate(texts)]
    rows += [(100 + k, f"s{k:02}", "a page\nmirrored everywhere") for k in range(15)]
    rows += [(200 + k, f"s{k:02}", f"text {k}\nplain footer\ncopied footer") for k in range(10)] + [(300, None, None), (301, "s01", "")]
    rows = [(d, s, t, len(t or "")) for d, s, t in rows]
    for least in (2, 10, 12, 13):
        for log_k in (4, 10):
            got = strip_boilerplate(table(rows, SCHEMA), least_sites=least, log_k=log_k)
            want = brute(rows, least)
            assert Counter((r.doc_id, r.source, r.text, r.n_chars if r.text is not None else None) for r in got.collect()) == want
