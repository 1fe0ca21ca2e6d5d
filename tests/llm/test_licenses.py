from checks.run import compare, connect

from promptsieve.llm import licenses, queries


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.01"
    ours = queries.op1_license_scan(spark, sf).toPandas()
    theirs = connect(sf).sql(queries.ORACLES["op1_license_scan"]).df()
    assert len(ours) > 0 and compare(ours, theirs) == ""


def test_edited_and_embedded_notices(spark):
    mit = licenses.TEMPLATES["mit-full"]
    rows = [(1, mit), (2, "Copyright 2020 Some One\n\n" + mit.replace("sublicense", "sub-license").upper() + "\n\nmore text"),
            (3, "prose " * 300 + "\nReleased under the MIT License!\n" + "prose " * 300), (4, mit[:400]),
            (5, "released under the new license of the town")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.unit, r.license) for r in got} == {
        (1, "line", "mit-full"), (1, "paragraph", "mit-full"), (1, "text", "mit-full"), (2, "line", "mit-full"),
        (2, "paragraph", "mit-full"), (2, "text", "mit-full"), (3, "line", "mit")}
    assert {r.dice for r in got if r.doc_id == 1} == {1.0}


def test_odd_rows(spark, odd, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    twice = spark.createDataFrame([(1, "All rights reserved."), (1, "All rights reserved."), (None, "all rights reserved")],
                                  "doc_id long, text string")
    assert licenses.scan(twice).filter("unit = 'text'").count() == 3
