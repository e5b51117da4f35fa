"""Metadata documents are read twice, whatever the number of their fields."""

from pyspark.sql import functions as F

from fluvia.functions import text
from fluvia.plans import registry

SF = "/root/testdata/sf0.001"


def test_documents_are_read_twice(spark):
    plan = registry.queries()["metadata_records"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("XPathStringEvaluator") == 1 and plan.count("XPath") == 2


def test_parts_of_odd_documents(spark):
    docs = [
        "<m><citeinfo><title> A &amp; <b>B</b> </title><onlink>u</onlink><onlink/><onlink>v</onlink></citeinfo><rngdates><begdate>20200229</begdate><enddate>20210229</enddate></rngdates><bounding><westbc> -1.5 </westbc><eastbc>x</eastbc></bounding><bounding><westbc>7</westbc><northbc>3</northbc></bounding></m>",
        "<m/>",
        "<m><citeinfo><title>  </title></citeinfo><x><bounding><southbc>2e1</southbc></bounding></x></m>",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, xml string").select("i", text.metadata_record(F.col("xml")).alias("m")).select("i", "m.*")
    got = [tuple(r)[1:] for r in rows.orderBy("i").collect()]
    none = (None,) * 5
    assert got[0] == ("A & B", -1.5, None, None, 3.0, "2020-02-29", None, ["u", "v"])
    assert got[1] == (*none, None, None, []) and got[2] == (None, None, 20.0, None, None, None, None, [])
    assert got[3] == (*none, None, None, None)
