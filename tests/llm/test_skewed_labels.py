"""URL rules where nearly all labelled pages are bad."""

from corpusloom.llm import url_rules as U


def test_rules_of_a_class_of_nine_tenths(spark):
    kinds = ["spam"] * 27 + ["junk"] * 27 + ["fine"] * 6
    urls = [f"http://site.net/{kinds[i % 60]}/{chr(97 + i % 7)}" for i in range(600)]
    new = ["http://site.net/spam/new", "http://site.net/fine/new", "http://site.net/other/new"]
    pages = spark.createDataFrame(list(enumerate(urls + new)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(kinds[i % 60] != "fine")) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.matched) for r in U.judge_urls(pages, labels).collect()}
    assert got[600] == ("block", "spam block") and got[601] == ("allow", "fine allow") and got[602] == ("allow", None)
    assert all(got[i][0] == ("allow" if kinds[i % 60] == "fine" else "block") for i in range(600))
