import re

import pytest
from basketry.llm import urlfilter


def brute(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
    own = re.sub(r"\A(www|m)\.", "", re.sub(r":(80|443)\Z", "", host))
    found = own + path.rstrip("/") in listed or any(own == x or own.endswith("." + x) for x in listed)
    return host, path, rule, found, verdict or ("block" if found else "allow")


@pytest.mark.parametrize("blocks", [1, 1 << 10])
def test_verdicts_match_brute_force(spark, blocks):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [None, "", "no scheme", "http://", "https://NET/", "https://net", "x://a.NET/?q://b/", "http://example.net/en", "http://EXAMPLE.com:80/de/x", "http://xexample.com/de/", "a://b.org/fr/#://c", "://h/p", "http://h\n/a\nb", "http://www.h/p/", "http://h/p", "http://h/p", "http://a.b.bad.host/x", "http://bad.host", "http://notbad.host/", "http://m.BAD.host:443?q"]
    pages = pages.unionByName(spark.createDataFrame([(-i, u) for i, u in enumerate(odd)], pages.schema))
    urls = [r.url for r in pages.collect()]
    listed = [u for u in urls if u and "spam" in u] + ["https://h/p?x", None, "nothing", "http://h/p", "http://www.bad.host/"]
    canon = {re.sub(r"\A(www|m)\.", "", re.sub(r":(80|443)\Z", "", brute(u, ())[0])) + brute(u, ())[1].rstrip("/") for u in listed} - {""}
    got = urlfilter.judge(pages, spark.createDataFrame([(u,) for u in listed], "url string"), blocks=blocks).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.listed, r.verdict) == brute(r.url, canon), r.url


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, verdict int, host string")
    some = spark.createDataFrame([(1, "http://a/b", 3, "q")], none.schema)
    assert urlfilter.judge(none, some).count() == 0
    assert [(r.verdict, r.host) for r in urlfilter.judge(some, none).collect()] == [("allow", "a")]
