"""License scans: base phrases against plain Python, templates by wording that must and must not match."""

import re

import pytest
from cases import edge_docs, edge_rows, no_docs

from hopweave.llm import licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"


def words(text):
    return licenses.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    at = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_equals_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in licenses.op4_licenses(spark, sf).collect()}
    assert len(got) == len(docs)
    assert any(r["n_base"] for r in got.values())
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(d["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (MIT, "mit"),
        (MIT.replace("(the \"Software\")", ""), "mit"),
        (MIT.replace("this software", "the font software and its parts"), "mit"),
        (MIT.replace("free of charge", "free from charge"), ""),
        (MIT.replace("this software", "one two three four five six seven eight nine"), ""),
        ("Copyright (c) Someone. " + MIT + " more", "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
        ("Redistribution and use of this software in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
        ("Redistribution and use in source forms are permitted provided that the following conditions are met", ""),
        ("Licensed under the Apache License, Version 2.0", "apache-2"),
        ("under the MIT license", "mit"),
        ("under the mit licenses", ""),
        ("released under the terms of the MIT License", "mit"),
        ("CC-BY-NC and under the MIT license", "cc-by-nc,mit"),
        ("licensed under the GNU Affero General Public License version 3", "agpl-3"),
        ("licensed under the GNU Lesser General Public License version 3", "lgpl-3"),
        ("licensed under the GNU General Public License, version 3", "gpl-3"),
        ("licensed under the GNU General Public License version 2", "gpl-2"),
        ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
        ("is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3"),
        ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3", "agpl-3"),
        ("licensed under the GNU Great General Public License version 3", ""),
        ("licensed under the GNU General Public License version 4", ""),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
        ("subject to the terms of the Mozilla Public License, v. 1.1.", ""),
        ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
        ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
        ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
        ("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
        ("licensed under the Creative Commons Attribution-Non-Commercial-NoDerivs 3.0 Unported License", "cc-by-nc-nd"),
        ("under a Creative Commons Attribution NoDerivatives License", "cc-by-nd"),
        ("Attribution NonCommercial ShareAlike 4.0", "cc-by-nc-sa"),
        ("Attribution 4.0 International", "cc-by"),
        ("attribution 4.0 of the quote", ""),
        ("CC BY 4.0", "cc-by"),
        ("CC BY-SA 4.0", "cc-by-sa"),
        ("CC-BY-ND-3.0", "cc-by-nd"),
        ("CC BY-NC-ND 4.0", "cc-by-nc,cc-by-nc-nd"),
        ("CC BY-NC-SA 2.5", "cc-by-nc,cc-by-nc-sa"),
        ("CC BY-NC 4.0", "cc-by-nc"),
        ("under a Creative Commons Attribution Nothing 4.0 License", ""),
        ("To the extent possible under law, A. Person has waived all copyright and related or neighboring rights to this work", "cc0-1"),
    ],
)
def test_templates(spark, text, labels):
    (r,) = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["labels"] == labels
    assert (r["score"] > 0) == bool(labels)
    for m in r["matches"]:
        assert 0 <= m["start"] < m["end"] <= r["n_words"]


def expand(template):
    """The pattern of a template over words joined by spaces."""
    out = ""
    for part in re.split(r"(<<.*?>>)", template):
        if part == "<<beginOptional>>":
            out += "(?:"
        elif part == "<<endOptional>>":
            out += ")?"
        elif part.startswith("<<var"):
            out += r"(?:\S+ ){0,%s}" % re.search(r"max=(\d+)", part)[1]
        else:
            out += "".join(re.escape(w) + " " for w in words(part))
    return re.compile(out)


@pytest.mark.parametrize("template", [*licenses.TEMPLATES[:25], *licenses.TEMPLATES[25::17]], ids=lambda t: t[0])
def test_automaton_equals_regular_expression(template):
    import random

    r, t, pattern = random.Random(7), licenses.Template(*template), expand(template[2])
    from hopweave.llm.common import hash_word

    body = [w for p in re.split(r"<<.*?>>", template[2]) for w in words(p)]
    for _ in range(300):
        w = list(body)
        for _ in range(r.randrange(4)):
            i = r.randrange(len(w))
            w[i : i + r.randrange(3)] = r.choice([[], ["x"], ["x", "y"], [r.choice(body)]])
        assert (t.match([hash_word(x) for x in w]) is not None) == (pattern.match(" ".join(w) + " ") is not None), w


def test_edge_rows(spark):
    got = licenses.scan_licenses(edge_docs(spark, wide=True)).collect()
    assert sorted((r["n_words"], r["n_base"], r["base_labels"]) for r in got) == sorted((x := brute(r[1]))[:2] + (x[4],) for r in edge_rows())
    assert licenses.scan_licenses(no_docs(spark)).count() == 0


def whole(label):
    """A whole text of a template: its names filled in, its optional regions kept."""
    (text, *_) = [t for k, score, t in licenses.TEMPLATES if k == label and score == 1.0]
    return re.sub(r"<<var.*?>>", "the authors", re.sub(r"<<(begin|end)Optional>>", "", text))


@pytest.mark.parametrize("label", ["mit", "isc", "bsd-2-clause", "bsd-3-clause", "zlib", "bsl-1", "unlicense"])
def test_only_whole_texts_score_one(spark, label):
    text = whole(label)
    w = text.split()
    altered = [
        text.replace("AS IS", "AS IT STANDS").replace("as-is", "as it stands"),
        " ".join(w[:-1]),
        " ".join(w[: len(w) * 2 // 3] + ["for", "non-commercial", "use", "only"] + w[len(w) * 2 // 3 :]),
        text.replace("THE SOFTWARE IS PROVIDED", "The Software shall not be used for gain. THE SOFTWARE IS PROVIDED").replace("THIS SOFTWARE IS PROVIDED", "It shall not be used for gain. THIS SOFTWARE IS PROVIDED").replace("In no event", "It shall not be used for gain. In no event"),
    ]
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate([text, "Copyright (c) Someone. " + text + " more", *altered])), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r for r in rows}
    assert got[0]["score"] == got[1]["score"] == 1.0 and label in got[0]["labels"].split(",")
    assert all(0 < got[i]["score"] < 0.8 for i in range(2, len(rows)))
    variants = {"bsd-2-clause", "bsd-3-clause"}
    assert {m["label"] for m in got[0]["matches"]} & variants == {label} & variants
    assert not any({m["label"] for m in got[i]["matches"]} & variants for i in range(2, len(rows)))


def test_openings_score_low(spark):
    (r,) = licenses.scan_licenses(spark.createDataFrame([(1, MIT + " The Software shall not be sold.")], "doc_id long, text string")).collect()
    assert (r["labels"], r["score"]) == ("mit", 0.5)


def test_no_notice_stands_in_anothers():
    """The words of each generated notice, alone, give its own label and no other template's."""
    from hopweave.llm.common import hash_word

    made = licenses.GNU_NOTICES + licenses.cc_notices()
    compiled = [(t[0], licenses.Template(*t)) for t in licenses.TEMPLATES]
    assert len({label for label, *_ in made}) == len(licenses.GNU) + len(licenses.CC_LICENSES)
    for label, _, text in made:
        h = [hash_word(w) for w in words(re.sub(r"<<.*?>>", "", text))]
        found = {k for k, t in compiled for i in range(len(h) - licenses.LEAD + 1) if t.match(h[i:]) is not None}
        assert found == {label}, (text, found)


def test_whole_notices_score_higher_than_their_beginnings(spark):
    notice = re.sub(r"<<var.*?>>", "http://www.apache.org/licenses/LICENSE-2.0", next(t for k, score, t in licenses.TEMPLATES if k == "apache-2" and score == 0.95))
    rows = [(1, notice), (2, notice.replace("ANY KIND", "SOME KINDS"))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("apache-2", 0.95), 2: ("apache-2", 0.9)}
