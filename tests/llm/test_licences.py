from tests.llm import cases
from tidemark.llm import licence_digest as ld

MIT = next(t for k, t in ld.KNOWN if k == "MIT")


def test_variants_of_a_text_match(spark):
    texts = {1: MIT, 2: "Copyright (c) 2020 Someone\n\n" + MIT, 3: MIT.upper().replace("\n", "   ").replace('"', "“"),
             4: MIT.replace("sublicense", "sub-license").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS"),
             5: MIT + " and more", 6: MIT.replace("without restriction", "with restriction"),
             7: "Prose here.\nreleased under the MIT licence\nMore.\nLicensed under CC BY-NC 4.0.", 8: "© 2021 X. All rights reserved\n" + MIT}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["licence"], r["notices"], r["n_notice_lines"]) for r in ld.scan(docs).collect()}
    assert [got[i][0] for i in range(1, 9)] == ["MIT"] * 4 + [None, None, None, "MIT"]
    assert got[7][1:] == ("CC-BY-NC-4.0,MIT", 2) and got[5][1:] == ("", 0)


def test_edges_and_empty(spark):
    docs = cases.documents(spark)
    rows = ld.scan(docs).collect()
    assert len(rows) == docs.count() and all(r["licence"] is None and r["n_notice_lines"] == 0 for r in rows)
    assert ld.scan(cases.no_documents(spark)).count() == 0


def test_known_notices_hold_the_trigger():
    assert all(ld._NOTICE in text.lower() for _, text in ld.KNOWN if "\n" not in text)


def _scan(spark, texts, **kw):
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    return {r["doc_id"]: (r["licence"], r["notices"]) for r in ld.scan(docs, **kw).collect()}


def test_titled_and_commented_files_match(spark):
    isc = next(t for k, t in ld.KNOWN if k == "ISC")
    hashed = "\n".join("# " + x for x in f"Copyright (c) 2020 Someone\n\n{MIT}".split("\n"))
    starred = "/*\n" + "\n".join(" * " + x for x in f"MIT License\n\n(c) Acme\n© 2021 Other\nAll rights reserved.\n\n{MIT}".split("\n")) + "\n */"
    got = _scan(spark, {1: "MIT License\n\nCopyright (c) 2020 Someone\n\n" + MIT, 2: "ISC License\n\nCopyright 2020 X\n\n" + isc,
                        3: hashed, 4: starred, 5: "Prose.\n## MIT License\nMore.", 6: "// SPDX-License-Identifier: GPL-2.0-or-later\ncode"})
    assert got == {1: ("MIT", "MIT"), 2: ("ISC", "ISC"), 3: ("MIT", ""), 4: ("MIT", "MIT"), 5: (None, "MIT"), 6: (None, "GPL-2.0")}


def test_full_public_texts_match_in_any_wrapping(spark):
    texts, want = {}, {}
    for i, (name, titles, text) in enumerate(ld.TEXTS):
        # all on one line but the copyright line: list items (c) stay wherever a line breaks
        flat = "\n".join(f"\n{x}\n" if x.strip().startswith("Copyright [") else x + " " for x in text.split("\n")).replace(" \n", " ") \
            if name in ("Apache-2.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Zlib") else text
        texts |= {3 * i: text, 3 * i + 1: f"{titles[0]}\n\nCopyright (c) 2020 Someone\n\n{text}", 3 * i + 2: flat}
        want |= dict.fromkeys(range(3 * i, 3 * i + 3), name)
    got = _scan(spark, texts)
    assert {i: got[i][0] for i in got} == want
    assert {"BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "Apache-2.0"} <= set(want.values())


def test_line_filter_follows_the_given_list(spark):
    known = [("X", "Public domain work."), ("Y", "For non-commercial use"), ("Z", "Our licence")]
    assert _scan(spark, {1: "a\npublic DOMAIN work\nfor noncommercial use", 2: "a\n# our license"}, known=known) == {1: (None, "X,Y"), 2: (None, "Z")}
    assert ld.triggers(ld.KNOWN) == [ld._NOTICE] == ["licen"]
