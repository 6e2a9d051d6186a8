from sparkwarden.llm.url_filter import RULES, judge_urls, rules_table


def brute(rows, rules):
    out = []
    for i, u in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
            path = rest[n:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((i, host, path, *(max(fit)[3:] if fit else (None, "allow"))))
    return sorted(out, key=str)


def run(spark, rows, rules=RULES):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, rule string")
    return sorted(map(tuple, judge_urls(df, rules_table(spark, rules)).collect()), key=str)


URLS = [
    "http://a.Example.ORG/es/1?x", "https://example.org/es", "http://example.org/en/12#t", "http://example.org/en/2", "http://badexample.org/es/", "x://b.com/fr/", "x://com/de/", "x://b.com/de", "http://com.net/de/",
    "no scheme", "", None, "a://", "a://x.org", "a://x.org?/", "a://.org/", "a://x..org/\n/b", "a://x.org:80/", "HTTP://U@É.COM/fr/é", "a://b://c.org/", "a://x.org/" + "y" * 5000, "a://" + "s." * 60 + "com/de/",
]


def test_matches_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (3, URLS[3]), (None, URLS[0])]
    assert run(spark, rows) == brute(rows, RULES)
    more = [*RULES, ("b.com", "/de", "allow"), ("org", "/", "block"), ("com", "/de", "block")]
    assert run(spark, rows, more) == brute(rows, more)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a://b.org/")], []) == [(1, "b.org", "/", None, "allow")]
