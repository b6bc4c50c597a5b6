import re
import textwrap

import pytest

from surveyalign.llm.licence_texts import LICENCE_TEXTS
from surveyalign.llm.licences import scan_licences

MIT = LICENCE_TEXTS["MIT"][0]


def scanned(spark, rows, **kwargs):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    return {r.doc_id: (r.licence, r.notices, r.n_notices) for r in scan_licences(docs, **kwargs).collect()}


def test_texts_match_up_to_canonical_form(spark):
    found = scanned(spark, [
        MIT, MIT.upper().replace(",", " ;"), "Copyright (c) 2020 Some One\n(c) Other\nAll rights reserved.\n\n" + MIT.replace("License", "Licence"),
        MIT + "\nand one more word", MIT.replace("\n", "\r\n\t"), "# Copyright 2001\n" + LICENCE_TEXTS["BSD-3-Clause"][1]])
    assert [found[i][0] for i in range(6)] == ["MIT", "MIT", "MIT", None, "MIT", "BSD-3-Clause"]
    assert len(set(map(str, (found[0], found[1])))) == 1


def test_notices_inside_other_text(spark):
    found = scanned(spark, [
        "some words\nLicenced under the Apache Licence, version 2.0\nmore", "Released under the MIT License.\nreleased under the mit licence\nLicensed under CC BY-NC 4.0.",
        "Released under the MIT License. Not alone in its line", None, "", "\n\n", "Copyright 2020"])
    assert found[0] == (None, ["Apache-2.0"], 1)
    assert found[1] == (None, ["CC-BY-NC-4.0", "MIT"], 3)
    assert all(found[i] == (None, [], 0) for i in range(2, 7))


def test_own_list_of_licences(spark):
    texts = spark.createDataFrame([("B", "Do as you like"), ("A", "do as you LIKE!"), ("C", "Copyright only")], "licence string, text string")
    assert scanned(spark, ["Do, as you like.", MIT], texts=texts) == {0: ("A", ["A"], 1), 1: (None, [], 0)}
    assert scanned(spark, ["Do, as you like."], texts=texts.limit(0)) == {0: (None, [], 0)}


def test_edge_documents(edge_docs, no_docs):
    found = scan_licences(edge_docs)
    assert found.columns == ["doc_id", "licence", "notices", "n_notices"] and found.count() == edge_docs.count()
    assert scan_licences(no_docs).count() == 0


def test_plan_has_no_python(edge_docs):
    plan = scan_licences(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_every_whole_text_is_known(spark):
    texts = [(name, text) for name, variants in LICENCE_TEXTS.items() for text in variants]
    assert {"Apache-2.0", "Artistic-1.0-Perl", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0",
            "MPL-1.1", "MPL-2.0"} <= {name for name, text in texts if len(text) > 4000}
    found = scanned(spark, [text for _, text in texts])
    assert [found[i][0] for i in range(len(texts))] == [name for name, _ in texts]


@pytest.mark.parametrize("width", [30, 50, 61, 72, 100, 100_000])
def test_wrapping_does_not_matter(spark, width):
    known = [(name, text) for name, variants in LICENCE_TEXTS.items() for text in variants]
    wrapped = ["\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n\s*\n", text)) for _, text in known]
    short = [i for i, (name, text) in enumerate(known) if name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause") and "\n" in text]
    headed = ["Copyright (c) 2020 Some One\n\n" + wrapped[i] for i in short if not known[i][1].startswith("Copyright")]
    names = [known[i][0] for i in short if not known[i][1].startswith("Copyright")]
    found = scanned(spark, wrapped + headed)
    assert [found[i][0] for i in range(len(found))] == [name for name, _ in known] + names


def test_lines_that_begin_with_the_word_only(spark):
    isc = LICENCE_TEXTS["ISC"][1]
    found = scanned(spark, [
        isc.replace("provided that the above\ncopyright", "provided that the above copyright"), isc.replace("copyright notice and", "copyright banner and"),
        "Copyright Some One and others\n\n" + MIT, MIT.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS"), "(c) Other\n" + isc])
    assert [found[i][0] for i in range(5)] == ["ISC", "ISC", "MIT", "MIT", "ISC"]
