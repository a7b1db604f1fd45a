"""op8 against a plain computation of the same tree."""

import random
from collections import defaultdict
from math import sqrt

import pytest

from wattloom.llm import common, url_templates as u
from wattloom.llm.queries import RULES
from wattloom.llm.url_templates import Rule, url_verdicts


def typed(s):
    import re

    for pattern, name in (("[0-9]+", "{num}"), (r"[0-9]+\.[A-Za-z]+", "{num}.ext"), ("(?=.*[0-9])[0-9a-fA-F-]{8,}", "{hex}"), ("[0-9]{4}-[0-9]{2}(-[0-9]{2})?", "{date}")):
        if re.fullmatch(pattern, s):
            return name
    return s


def brute(urls, rules):
    """(host, path) -> (rule, verdict, template), one segment after another, by recursion."""
    count = defaultdict(int)
    for url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        count[host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]] += 1
    by_rule = {}
    for host, path in count:
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        by_rule[host, path] = max(fits, key=lambda r: len(r.name), default=None)
    out = {}

    def apart(x, n, all_x, all_n):
        if not n or not all_n - n:
            return False
        p = (all_x + 0.5) / (all_n + 1)
        return abs(x / n - (all_x - x) / (all_n - n)) > u.APART * sqrt(p * (1 - p) * (1 / n + 1 / (all_n - n)))

    def grow(template, members):  # members: (key, segments left)
        left = defaultdict(list)
        for key, rest in members:
            if rest:
                left[rest[0]].append((key, rest[1:]))
            else:
                out[key] = template

        def stats(group):
            verdicts = [(by_rule[k].verdict if by_rule[k] else None, count[k], rest) for k, rest in group]
            return {"n": sum(c for _, c, _ in verdicts), "blocked": sum(c for v, c, _ in verdicts if v == "block"), "labelled": sum(c for v, c, _ in verdicts if v), "ending": sum(c for _, c, r in verdicts if not r), "typed": sum(c for _, c, r in verdicts if r and r[0].startswith("{"))}

        own = {s: stats(g) for s, g in left.items()}
        sums = {k: sum(x[k] for x in own.values()) for k in ("n", "blocked", "labelled", "ending", "typed")}
        below = defaultdict(list)
        for s, g in left.items():
            x = own[s]
            differs = any(apart(x[a], x[b], sums[a], sums[b]) for a, b in (("blocked", "labelled"), ("ending", "n"), ("typed", "n")))
            merged = len(left) >= u.MANY and x["n"] <= u.RARE * sums["n"] and not differs and not s.startswith("{")
            below["*" if merged else s] += g
        for s, g in below.items():
            grow(f"{template}/{s}", g)

    hosts = defaultdict(list)
    for host, path in count:
        hosts[host].append(((host, path), [typed(s) for s in path.removeprefix("/").split("/")]))
    for members in hosts.values():
        grow("", members)
    score = defaultdict(lambda: [0, 0])
    for (host, path), t in out.items():
        r = by_rule[host, path]
        score[host, t][0] += count[host, path] * bool(r and r.verdict == "block")
        score[host, t][1] += count[host, path] * bool(r)
    verdict = {}
    for (host, path), t in out.items():
        r, (b, n) = by_rule[host, path], score[host, t]
        s = (b + u.PRIOR / 2) / (n + u.PRIOR)
        verdict[host, path] = (r.name if r else None, r.verdict if r else "block" if s >= u.REJECT else "allow", t)
    return verdict


def urls(rnd):
    out = [None, "no scheme", "http://b.org", "http://b.org/", "http://b.org//x"]
    for k in range(400):
        host = rnd.choice(["a.example.com", "news.example.net", "x.org", "big.example.com"])
        deep = "/a/b/c/d/e/f/g" if k % 5 == 0 else ""
        kind = rnd.choice(["ads", "news", f"w{rnd.randrange(30)}", "en", "de", "es"])
        tail = rnd.choice([str(k), f"{k:08x}a1", f"t{rnd.randrange(40)}", f"2024-0{1 + k % 9}", f"{k}.html", f"s{k % 7}/{k}"])
        out.append(f"http://{host}{deep}/{kind}/{tail}" + rnd.choice(["", "?q=1", "#f"]))
    return out + rnd.choices(out, k=100) + ["http://big.example.com/en/7"] * 300


@pytest.mark.parametrize("hot", [1, 10_000])
def test_tree_against_plain_recursion(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_SHARE", hot)  # 1: nothing is hot
    found = urls(random.Random(3))
    docs = spark.createDataFrame([(k, x, "z") for k, x in enumerate(found)], "page_id long, url string, template string")
    rows = url_verdicts(docs, RULES).collect()
    got = {(r.host, r.path): (r.rule, r.verdict, r.template) for r in rows}
    assert got == brute(found, RULES) and sorted(r.page_id for r in rows) == list(range(len(found)))
    assert any("*" in t for *_, t in got.values()) and any(t.count("/") > 7 for *_, t in got.values())


def test_deep_paths_differ_below_six_segments(spark):
    rows = [(k, f"http://h.org/a/b/c/d/e/f/{'ads' if k % 2 else 'news'}/{k}") for k in range(40)] + [(100, "http://h.org/" + "x/" * 5000)]
    rules = [Rule("block", "h.org", f"/a/b/c/d/e/f/ads/{k}") for k in range(11, 30, 2)]
    out = {r.page_id: r for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert out[39].rule is None and out[39].verdict == "block" and out[38].verdict == "allow"
    assert out[39].template == "/a/b/c/d/e/f/ads/{num}" and out[100].template.count("/x") == 5000


def test_rules_of_one_length_and_repeats(spark):
    rows = spark.createDataFrame([(1, "http://x.ab/c/"), (1, "http://x.ab/c/"), (None, "http://x.ab/c/")], "page_id long, url string")
    out = url_verdicts(rows, [Rule("block", "ab", "/c/"), Rule("allow", "x.ab", "/c")]).collect()
    assert [(r.rule, r.verdict) for r in out] == [("x.ab/c", "allow")] * 3
