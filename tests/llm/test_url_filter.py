from priorframe.llm import url_filter as U
from priorframe.llm.queries import RULES


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(r), v, r) for v, r in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if not fits:
        return host, path, None, None
    _, verdict, rule = max(fits)
    return host, path, rule, verdict


def check(rows):
    for r in rows:
        host, path, rule, verdict = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = U.judge(pages, RULES)
    check(out.join(pages.select("page_id", "url"), "page_id").collect())
    assert out.count() == pages.count()


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "x://A.EXAMPLE.com/en/7?q=://z", "http://com/en/", "http://mycom/en/1", "http://example.net/de/8", "http://a.b.example.net/de/9#f", "http://n.org/es", "http://n.org/es/", "http://É.com/en/x\ny", "http://a.com?x/en/", "http://a.com/en/" + "é" * 5000]
    df = spark.createDataFrame([(k, u, "v") for k, u in enumerate(urls)] + [(0, None, "v")], "page_id long, url string, verdict string")
    rows = {r.page_id: r for r in U.judge(df, RULES).collect()}
    check([type("R", (), r.asDict() | {"url": urls[k]}) for k, r in rows.items()])
    assert U.judge(df, RULES).count() == len(urls) + 1
    assert U.judge(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in U.judge(df, []).collect()} == {"allow"}


def test_trees_learn_what_the_rules_say(spark):
    rows = [(k, f"http://h{k % 7}.{'com' if k % 2 else 'net'}/{'en' if k % 2 else 'de'}/{k}") for k in range(400)]
    rows += [(1000 + k, f"http://h{k}.com/xx/{k}") for k in range(20)] + [(2000 + k, f"http://h{k}.net/xx/{k}") for k in range(20)]
    out = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert all(out[1000 + k] == "block" and out[2000 + k] == "allow" for k in range(20))
