from rooftally.llm.license_scan import TEMPLATES, Templates, license_scan, words_of

MIT = TEMPLATES["MIT"][2].replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
OTHER = "\n\n".join(f"A paragraph with some other words, number {k}, about nothing that has to do with it." for k in range(60))


def test_licences_inside_longer_texts(table):
    texts = [OTHER + "\n\nCopyright (c) 2020 Somebody\n\n" + MIT + "\n\n" + OTHER,
             "This text is released under the MIT License by its author.",
             "word " * 300 + "licensed under CC BY-NC 4.0. " + "other " * 300 + "Licensed under the Apache License, Version 2.0, too",
             OTHER + "\nReleased under the MIT License.\n" + OTHER, OTHER, "the MIT license"]
    rows = license_scan(table(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.license, r.template, r.segment, r.first_line, r.last_line) for r in rows)
    assert got == [(0, "MIT", 2, "window", 122, 126), (1, "MIT", 0, "window", 0, 0),
                   (2, "Apache-2.0", 0, "window", 0, 0), (2, "CC-BY-NC-4.0", 0, "window", 0, 0), (3, "MIT", 0, "line", 119, 119)]
    assert all(r.dice == 1.0 for r in rows)


def test_every_text_is_found_among_others():
    known = Templates(TEMPLATES, 0.8)
    for name, versions in TEMPLATES.items():
        for k, v in enumerate(versions):
            words = words_of(OTHER + " " + v + " " + OTHER)
            assert (name, k, 1.0) in [w[:3] for w in known.windows(words)]
