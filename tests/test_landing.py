"""Landed files with empty, refused and broken ones among them."""

import json

from tidemark.operators import cleaning
from tidemark.sources import tables as S

HEADER = "Date,Open,High,Low,Close,Volume\n"


def names(rows):
    return {(r.file.rsplit("/", 1)[-1], r.reason) for r in rows.collect()}


def test_price_files(spark, tmp_path):
    texts = {
        "good.csv": HEADER + "2024-01-02,1,2,0.5,1.5,100\n2024-01-03,1,2,0.5,N/D,100\n", "empty.csv": "", "none.csv": "No data", "header.csv": HEADER, "page.csv": "<html>\n<body>busy</body>\n</html>\n",
        "other.csv": HEADER + "bad,1,1,1,1,1\n2024-01-05,1,2,0.5,2.5,7\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows, bad = S.landed_prices(spark, str(tmp_path))
    assert names(bad) == {("empty.csv", "empty"), ("none.csv", "no usable row"), ("header.csv", "no usable row"), ("page.csv", "no usable row")}
    assert rows.count() == 4
    got = cleaning.standard_prices(rows.drop("file"), ["open"]).collect()
    assert sorted((r.ticker, str(r.date), r.close) for r in got) == [("GOOD", "2024-01-02", 1.5), ("OTHER", "2024-01-05", 2.5)]


def test_submission_files(spark, tmp_path):
    lists = {"form": ["8-K", "4", "10-Q"], "accessionNumber": ["a", "b", "c"], "acceptanceDateTime": ["20240103100000", "nan", "2024-01-03T10:00:00.000Z"]}
    texts = {
        "full.json": json.dumps({"cik": "7", "filings": {"recent": lists}}), "number.json": json.dumps({"cik": 8, "filings": {"recent": {**lists, "other": [{"x": 1}]}}}), "short.json": json.dumps({"cik": "9", "filings": {"recent": {**lists, "form": "8-K"}}}),
        "bare.json": json.dumps({"cik": "10"}), "list.json": "[1, 2]", "cut.json": '{"cik": "11", "filings": {', "empty.json": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    docs, bad = S.landed_submissions(spark, str(tmp_path))
    assert names(bad) == {("list.json", "no JSON object"), ("cut.json", "no JSON object"), ("empty.json", "empty")}
    assert sorted(r.cik for r in docs.collect()) == ["10", "7", "8", "9"]
    got = cleaning.filings_of(docs, 2000, ["8-K", "10-Q"]).select("cik", "form", "accession").collect()
    assert sorted(map(tuple, got)) == [("7", "10-Q", "c"), ("7", "8-K", "a"), ("8", "10-Q", "c"), ("8", "8-K", "a")]
    plain = S.submissions_json(spark, str(tmp_path / "full.json"))
    assert plain.select("filings").collect() == docs.where("cik = '7'").select("filings").collect()
