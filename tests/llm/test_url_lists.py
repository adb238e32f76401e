import datetime as dt
import random

from innings_engine.llm import url_lists as ul

DAY = dt.date(2024, 1, 1)
ENTRIES, CAPTURES = "list string, pattern string, action string, day date, host string", "capture_id long, url string, day date, pattern string, row string"


def slow(captures, entries):
    out = []
    for cid, url, day in captures:
        host = ul_host(url)
        names = host.split(".")
        patterns = [".".join(names[i:]) for i in range(max(1, len(names) - 1))] if host else []
        active = []
        for p in patterns if day else []:
            for name in {e[0] for e in entries if e[0]}:
                own = {}
                for lst, pattern, action, when in entries:
                    if lst == name and pattern and pattern.lower() == p and action in ("add", "remove") and when and when <= day:
                        own[when] = own.get(when, False) or action == "remove"
                if own and not own[max(own)]:
                    active.append((name, p))
        longest = max((p for _, p in active), key=lambda p: (len(p), p), default="")
        out.append((cid, host, day, len(active), ",".join(sorted({n for n, _ in active})), longest))
    return out


def ul_host(url):
    import re
    m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", url or "")
    host = re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", m[1].lower())) if m else ""
    return re.sub(r"^www\.", "", re.sub(r"\.$", "", host))


def run(spark, captures, entries):
    rows = ul.judged(spark.createDataFrame([(*c, "x", "y") for c in captures], CAPTURES), spark.createDataFrame([(*e, "x") for e in entries], ENTRIES)).collect()
    return sorted(map(tuple, rows), key=str)


def test_against_a_loop(spark):
    rng = random.Random(13)
    hosts = ["a.com", "b.a.com", "x.b.a.com", "c.org", "localhost", "A.com"]
    urls = [f"http://{h}/p" for h in hosts] + ["https://user:pw@www.B.a.com:8080/?q", "ftp://a.com.", "mailto:x", "", None, "http://?x", "http://com"]
    entries = [(rng.choice(["l1", "l2"]), rng.choice(hosts), rng.choice(["add", "add", "remove"]), DAY + dt.timedelta(rng.randrange(100))) for _ in range(160)]
    entries += [("l1", "com", "add", DAY), (None, "a.com", "add", DAY), ("l1", None, "add", DAY), ("l1", "a.com", "other", DAY), ("l1", "a.com", "add", None)] + entries[:5]
    captures = [(i % 150, rng.choice(urls), DAY + dt.timedelta(rng.randrange(-5, 120)) if rng.random() < 0.95 else None) for i in range(300)]
    assert run(spark, captures, entries) == sorted(slow(captures, entries), key=str)


def test_borders_of_an_interval(spark):
    entries = [("l", "a.com", "add", DAY), ("l", "a.com", "add", DAY + dt.timedelta(3)), ("l", "a.com", "remove", DAY + dt.timedelta(5)), ("l", "a.com", "add", DAY + dt.timedelta(5))]
    captures = [(k, "http://a.com/", DAY + dt.timedelta(k)) for k in (-1, 0, 4, 5, 60)]
    assert [(r[0], r[3]) for r in run(spark, captures, entries)] == [(-1, 0), (0, 1), (4, 1), (5, 0), (60, 0)]
    assert [r[3] for r in run(spark, captures, [])] == [0] * 5 and run(spark, [], entries) == []
