from datetime import date

from gridloom.llm import url_filter as U


def test_entries_hold_while_valid(spark):
    d = lambda n: date(2024, 1, n)
    events = spark.createDataFrame([("Bad.org", d(5), "add"), ("bad.org", d(10), "remove"), ("bad.org", d(20), "add"), ("x.bad.org", d(8), "add"), ("same.org", d(3), "add"), ("same.org", d(3), "remove"), (None, d(1), "add"), ("ok.org", None, "add")], "entry string, day date, action string")
    rows = [("http://bad.org/a", d(4), None), ("https://BAD.org:80/", d(5), "bad.org"), ("http://y.bad.org", d(9), "bad.org"), ("http://z.x.bad.org?q", d(9), "x.bad.org"), ("http://bad.org", d(10), None), ("http://bad.org", d(25), "bad.org"), ("http://u@bad.org/", d(25), "bad.org"), ("http://notbad.org", d(25), None), ("http://same.org", d(4), None), ("http://ok.org", d(9), None), ("nonsense", d(9), None), (None, d(9), None), ("http://bad.org", None, None)] * 2
    df = spark.createDataFrame([(i, u, f, "x") for i, (u, f, _) in enumerate(rows)], "id long, url string, fetched date, blocked string")
    out = {r.id: r for r in U.evaluate(df, events).collect()}
    assert len(out) == len(rows)
    assert [out[i].matched_entry for i in range(len(rows))] == [m for _, _, m in rows]
    assert all(r.blocked == (r.matched_entry is not None) for r in out.values())
    assert U.evaluate(df.limit(0), events).count() == 0
    assert not any(r.blocked for r in U.evaluate(df, events.limit(0)).collect())


def test_entries_of_one_label_cover_hosts_below(spark):
    events = spark.createDataFrame([("zip", date(2024, 1, 1), "add"), ("localhost", date(2024, 1, 1), "add"), ("b.zip", date(2024, 1, 1), "add")], "entry string, day date, action string")
    want = {"http://a.zip/": "zip", "http://zip": "zip", "http://x.b.zip": "b.zip", "http://a.b.localhost": "localhost", "http://localhost": "localhost", "http://azip": None, "http://zip.org": None}
    df = spark.createDataFrame([(u, date(2024, 1, 2)) for u in want], "url string, fetched date")
    assert {r.url: r.matched_entry for r in U.evaluate(df, events).collect()} == want
