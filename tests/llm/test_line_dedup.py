from collections import defaultdict

from rooftally.llm.line_dedup import line_dedup, strip_boilerplate

SCHEMA = "doc_id long, source string, text string, n_chars long, places string, line string"
BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, least):
    """Lines on so many sites, of all copies of a text, that stand in two different texts at least are taken out."""
    sites, texts = defaultdict(set), defaultdict(set)
    for _, s, t in rows:
        for line in [] if t is None else t.split("\n"):
            sites[line.strip(BLANKS)].add(s or "")
            texts[line.strip(BLANKS)].add(t)
    common = {x for x, s in sites.items() if x and len(s) >= least and len(texts[x]) > 1}
    out = []
    for d, _, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if x.strip(BLANKS) not in common]
        out.append((repr(d), len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def some_rows():
    rows = []
    for i in range(120):
        lines = [f"own line {i}", "footer", f"shared by few {i % 40}", "", "  menu\t" if i % 3 else "menu"]
        rows.append((i, f"s{i % 13}", "\n".join(lines[i % 3:] + lines[:i % 2])))
    copy = "a page\nmirrored everywhere"
    rows += [(200 + i, f"s{i}", copy) for i in range(13)]
    rows += [(300, None, "footer"), (301, "s1", None), (302, "s2", ""), (None, "s3", "menu\nx"), (0, "s0", rows[0][2])]
    return rows


def frame(table, rows):
    return table([(d, s, t, len(t or ""), "p", "l") for d, s, t in rows], SCHEMA)


def test_against_brute_force(table):
    rows = some_rows()
    for least in (2, 10, 13, 14):
        got = sorted(((repr(r.doc_id), r.n_lines, r.n_removed, r.text) for r in
                      line_dedup(frame(table, rows), least_sites=least).collect()), key=repr)
        assert got == brute(rows, least)


def test_small_sketches_fall_back_to_exact_counts(table):
    rows = [(i, f"site{i % 97}", f"common\nonly {i}") for i in range(300)] + [(500 + i, f"site{i}", f"near\nown {i}") for i in range(40)]
    got = sorted(((repr(r.doc_id), r.n_lines, r.n_removed, r.text) for r in
                  line_dedup(frame(table, rows), least_sites=40, log_k=4).collect()), key=repr)
    assert got == brute(rows, 40)


def test_stage_keeps_columns_and_rows(table):
    df = frame(table, some_rows())
    out = strip_boilerplate(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert strip_boilerplate(table([], SCHEMA)).count() == 0
