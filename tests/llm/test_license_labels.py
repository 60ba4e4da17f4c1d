"""The full labels of texts that were labelled by hand."""

import pytest

from quillon.llm import license_scan

LABELLED = [
    ("Copyright 2020 Example. All rights reserved.", "reserved"),
    ("All right reserved", "reserved"),
    ("No rights reserved", "cc0"),
    ("all rights reserved; no rights reserved", "cc0,reserved"),
    ("Some rights reserved", ""),
    ("small rights are reserved", ""),
    ("Released under the MIT License.", "mit"),
    ("Relesed under the MIT licence", "mit"),
    ("Released under the MPL license", ""),
    ("Licensed under the BSD license", "bsd"),
    ("Mozilla Public License, version 2.0", "mpl"),
    ("Eclipse Public Licence", "epl"),
    ("GNU General Public License", "gpl"),
    ("the general publik license", "gpl"),
    ("GNU Lesser General Public Licence", "lgpl"),
    ("GNU Leser General Public License", "gpl,lgpl"),
    ("GNU Affero General Public License", "agpl,gpl"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"),
    ("Creative Commons Attribution 4.0, short CC BY", "cc-by"),
    ("Permission is herby granted, free of charge, to any person obtaining a copy", "mit"),
    ("Redistribution and use in source and binary forms, with or without modifications, are permitted", "bsd"),
    ("This software is provided 'as-is', without any express or implied warranty", "zlib"),
    ("Dedicated to the public domain", "public-domain"),
    ("the house by the river", ""),
    ("the autistic license", ""),
    ("the artistic licence", "artistic"),
    ("CC BY-SA 4.0", "cc-by,cc-by-sa"),
    ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"),
    ("CC-BY-NC 3.0, CC BY ND", "cc-by,cc-by-nc,cc-by-nd"),
    ("cc by 4.0", "cc-by"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifer: LGPL-2.1-only", "lgpl"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by,cc-by-sa"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("SPDX-License-Identifier: none", ""),
    ("Creative Commons Attribution-NonCommercial-ShareAlike", "cc-by-nc-sa"),
    ("Creative Commons Attribution Non Commercial Share Alike", "cc-by-nc-sa"),
    ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "cc-by-nc-nd"),
    ("attribution non commercial sharealike", "cc-by-nc-sa"),
    ("Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc"),
    ("", ""),
]


@pytest.mark.parametrize("again", [1, 3])
def test_labels(spark, again):
    """Also when notices stand several times, in one word of many letters before, and at both ends of the text."""
    rows = [(i, (" " + "x" * 500 + " ").join([t] * again)) for i, (t, _) in enumerate(LABELLED)]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(t, got[i].labels) for i, (t, _) in enumerate(LABELLED)] == LABELLED
    assert all(len(r.spans) == 0 or r.spans[0].start == 0 or i in (13,) for i, r in got.items() if LABELLED[i][0].lower().startswith(("all", "no ", "mozilla", "eclipse")))


def test_reserved_is_not_public_domain(spark):
    """On the given tables no document with reserved rights is called cc0 unless it says so."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = license_scan.license_scan(docs).join(docs.select("doc_id", "text"), "doc_id")
    assert got.filter("contains(base_labels, 'reserved')").count() > 0
    assert got.filter("contains(labels, 'cc0') AND NOT contains(lower(text), 'no rights reserved')").count() == 0


def test_dense_candidates_stay_fast():
    import time

    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES, 5)
    began = time.process_time()
    assert len(scanner.fuzzy("all rights reservd " * 5000)) == 5000
    assert time.process_time() - began < 30
