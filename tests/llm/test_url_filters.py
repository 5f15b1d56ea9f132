import datetime as dt
import random

from cladespark.llm.url_filters import filter_captures

DAY = dt.datetime(2024, 1, 1)
STRENGTH = ["remove", "allow", "block"]


def covers(pattern, url):
    rest = url.split("://", 1)[1].split("?")[0]
    host, _, path = rest.partition("/")
    host = host.lower().split("@")[-1].split(":")[0]
    if "/" not in pattern:
        return host == pattern or (host.endswith("." + pattern) and "." in pattern)
    segments = [s for s in path.split("/") if s]
    return any(pattern == host + "/" + "/".join(segments[:k]) for k in range(1, len(segments) + 1))


def brute(captures, entries):
    out = []
    for page_id, url, at, *_ in captures:
        active = []
        for pattern in {e[0] for e in entries if e[0]} if url and "://" in url and at else ():
            past = [(d, STRENGTH.index(a), a) for p, a, d in entries if p == pattern and d and a in STRENGTH and dt.datetime(d.year, d.month, d.day) <= at]
            if past and max(past)[2] != "remove" and covers(pattern, url):
                active.append((len(pattern), pattern, max(past)[2]))
        best = max(active, default=(0, None, None))
        out.append((page_id, url, at, best[1], best[2], best[2] == "block"))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(7)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.example.org", "solo"]
    entries = [(rng.choice([*hosts, "y.example.org", "example.org", "com", "a.example.com/p", "a.example.com/p/q", None]), rng.choice([*STRENGTH, "odd"]), (DAY + dt.timedelta(rng.randrange(200))).date()) for _ in range(60)] + [("solo", "block", None)]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'u:p@'])}{h.upper() if rng.random() < 0.3 else h}{rng.choice(['', ':81'])}{p}" for h in hosts for p in ("", "/", "/p", "/p/q/r?x=/p", "//p", "/z/p")]
    captures = [(k, rng.choice([*urls, None, "", "nothing", "://x"]), DAY + dt.timedelta(minutes=rng.randrange(300 * 1440)), 1) for k in range(300)] + [(1, urls[0], None, 1)]
    captures += captures[:5] + [(500 + k, urls[1], DAY + dt.timedelta(k), 1) for k in range(100)] + [(900, "http://a.example.com/" + "p/" * 3000, DAY, 1)]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp, pattern int")
    listed = spark.createDataFrame(entries, "pattern string, action string, listed_on date")
    assert sorted(map(tuple, filter_captures(frame, listed).collect()), key=str) == brute(captures, entries)
    assert filter_captures(frame.limit(0), listed).count() == 0
    assert filter_captures(frame, listed.limit(0)).where("blocked or pattern is not null").count() == 0
