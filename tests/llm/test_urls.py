"""Rules, segmentation and naive Bayes against plain versions."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palaver.llm import urls

URLS = ["http://Spam-Farm.EXAMPLE.net/en/1?x=/a#b", "https://a.example.org/fr/2#t", "x://example.com/de/", "example.com/de/", None, "", "://", "a://b://c/d?e", "http://net/", "http://anet/",
        "http://user@host.net:80/é?q", "h://x.example.com?/de/", "h://example.com#/x", "h://ÀB.org/fr/\nx", "h://example.com/de"]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, _ in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_hosts_paths_rules(spark):
    df = spark.createDataFrame([(i, u, "<p>a word</p>", "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r["id"]: tuple(r)[1:] for r in urls.judge(df).collect()}
    verdicts = dict(urls.RULES)
    for i, u in enumerate(URLS):
        assert got[i][:3] == plain(u)
        assert got[i][3] == verdicts[got[i][2]] if got[i][2] else got[i][3] in ("allow", "block")


def test_cheapest_split():
    rng = random.Random(3)
    counts = {"cheap": 50, "pills": 20, "pill": 30, "s": 5, "a": 500, "ap": 2, "che": 7}
    total = sum(counts.values())
    cost = lambda w: math.log(total + 1) - math.log(counts[w]) if w in counts else math.log(total + 1) + math.log(10) * len(w)
    for label in ["cheappills", "apills", "xcheap", "", "ssss", *["".join(rng.choice("cheapils") for _ in range(9)) for _ in range(20)]]:
        best = min((sum(map(cost, s)) for s in splits(label)), default=0)
        got = urls.cheapest_split(label, counts, total)
        assert "".join(got) == label and sum(map(cost, got)) == pytest.approx(best)
    assert urls.cheapest_split("cheappills", counts, total) == ["cheap", "pills"]


def splits(label):
    for cut in itertools.product([0, 1], repeat=max(0, len(label) - 1)):
        out, start = [], 0
        for i, c in enumerate(cut, 1):
            if c:
                out.append(label[start:i])
                start = i
        yield [*out, label[start:]] if label else []


def pages(spark):
    rng = random.Random(7)
    good, bad = ["garden", "river", "stone", "letter"], ["cheap", "pills", "casino", "bonus"]
    rows = []
    for i in range(400):
        spam = rng.random() < 0.3
        host = "".join(rng.sample(bad if spam else good, 2)) + ".example.com"
        path = "/" + rng.choice(["win", "buy"] if spam else ["en", "fr"]) + f"/{i}.html"
        rows.append((i, rng.choice(["http://www.", "https://"]) + host + path, "<p>" + " ".join(rng.choice(good + bad) for _ in range(30)) + "</p>"))
    return rows


def test_naive_bayes(spark):
    rows = pages(spark)
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, word int")
    got = {r["id"]: r for r in urls.judge(df).collect()}
    texts = Counter(w for _, _, h in rows for w in re.findall("[a-z]+", re.sub("<[^<>]*>", " ", h)) if 2 <= len(w) <= urls.LONGEST)
    total = sum(texts.values())
    words = {}
    for i, u, _ in rows:
        host, path, _ = plain(u)
        names = [x for x in re.split("[^a-z]+", host.rsplit(".", 1)[0]) if x]
        hw = [w for n in names for w in urls.cheapest_split(n, texts, total)]
        pw = [x for x in re.split("[^a-z#]+", re.sub("[0-9]+", " # ", path)) if x]
        words[i] = (["h:" + w for w in hw] + ["p:" + w for w in pw], any(w in urls.SEEDS for w in hw))
    count = {y: Counter(w for ws, z in words.values() if z == y for w in ws) for y in (True, False)}
    vocab = count[True].keys() | count[False].keys()
    size = {y: sum(c.values()) for y, c in count.items()}
    n = Counter(z for _, z in words.values())
    weight = {w: round(urls.UNIT * (math.log((count[True][w] + 1) / (size[True] + len(vocab))) - math.log((count[False][w] + 1) / (size[False] + len(vocab))))) for w in vocab}
    for i, (ws, _) in words.items():
        odds = sum(weight[w] for w in ws) + round(urls.UNIT * math.log(n[True] / n[False]))
        assert abs(got[i]["odds"] - odds) <= 20
    blocked = {i for i, r in got.items() if r["verdict"] == "block"}
    assert {i for i, u, _ in rows if "bonus" in u} <= blocked and not any("garden" in rows[i][1] for i in blocked)


def test_edges(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(df).collect() == []
    one = spark.createDataFrame([(None, "h://" + "a" * 3000 + ".b/" + "c" * 100_000, None), (None, None, None), (None, None, None)], "page_id long, url string, html string")
    assert [r["verdict"] for r in urls.judge(one).collect()] == ["allow"] * 3
    assert urls.judge(df.withColumn("x", F.lit(1))).columns == ["id", "host", "path", "rule", "verdict", "odds"]


def test_inflected_seeds(spark):
    words = ["bets", "betting", "casinos", "loans", "pill", "lotteries", "gamble", "cracked", "sexes", "better", "alphabet", "bed", "stone", "garden", "cashmere"]
    df = spark.createDataFrame([(w,) for w in words + urls.SEEDS], "w string").select("w", urls.stem(F.col("w")).alias("s"))
    stems = dict(df.collect())
    seeds = {stems[s] for s in urls.SEEDS}
    assert [w for w in words if stems[w] in seeds] == words[:9]


def test_hosts_without_seed_words(spark):
    """An inflected seed blocks, and so does a host that only shares words with such hosts."""
    hosts = ["free-bets", "free-bets-bonus", "free-bonus", "garden-river", "river-stone", "stone-letter", "letter-garden"]
    rows = [(i, f"http://{hosts[i % 7]}.example.com/en/{i}", "<p>free bets bonus garden river stone letter</p>") for i in range(350)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["host"].split(".")[0] for r in got if r["verdict"] == "block"} == set(hosts[:3]) and len(got) == 350
