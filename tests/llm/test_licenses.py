from riskloom.llm import licenses
from riskloom.llm.queries import QUERIES, SQL
from tests.llm.oracle import assert_same


def test_query_against_sql(spark):
    columns = ["digest", "doc_id", "license", "notice_lines", "notices"]
    rows = assert_same(spark, QUERIES["op3_licenses"], SQL["op3_licenses"], "/root/testdata/sf0.01")
    assert any(dict(zip(columns, r))["notices"] for r in rows)


def test_whole_texts_and_edges(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    spelled = "  Copyright (c) 2020 Some One\n" + mit.upper().replace("LICENSE", "LICENCE").replace("sublicense", "sub-license") + "\n(c) 2021\ncopyright 2022"
    docs = [(1, mit), (2, spelled), (3, mit + " and more"), (4, None), (5, ""), (6, "text\nreleased under the MIT Licence\nmore"), (6, "text\nreleased under the MIT Licence\nmore"), (7, "Licensed under CC BY-NC 4.0.\r\nspdx-licence-identifier mit\nLicensed under “CC BY NC 4.0”"), (8, "x " * 200_000 + "\n" + "Released under the MIT License."), (None, mit)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, license string, row int")
    out = licenses.scan(frame).collect()
    got = sorted((r.doc_id or 0, r.license or "", ",".join(r.notices), r.notice_lines) for r in out)
    assert got == [(0, "MIT", "", 0), (1, "MIT", "", 0), (2, "MIT", "", 0), (3, "", "", 0), (4, "", "", 0), (5, "", "", 0), (6, "", "MIT", 1), (6, "", "MIT", 1), (7, "", "CC-BY-NC-4.0,MIT", 3), (8, "", "MIT", 1)]
    assert licenses.scan(frame.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op3_licenses"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_long_licences_and_their_notices(spark):
    texts = dict(licenses.LONG_TEXTS)
    docs = [(i, texts[name]) for i, name in enumerate(sorted(texts))] + [(100, "// SPDX-License-Identifier: GPL-3.0-or-later\ncode"), (101, "# SPDX-License-Identifier: MPL-2.0"), (102, "This work is licensed under the GNU Lesser General Public Licence, version 2.1.")]
    out = licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    got = {r.doc_id: (r.license, r.notices) for r in out}
    assert [got[i][0] for i in range(len(texts))] == sorted(texts) and {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    assert [got[i][1] for i in (100, 101, 102)] == [["GPL-3.0"], ["MPL-2.0"], ["LGPL-2.1"]]
