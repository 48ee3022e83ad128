"""URL filters: rules on hosts and paths, and for the rest a naive Bayes over segmented host words and path words.

Names in hosts are written together. A unigram model of the words in all pages splits each distinct host label by the
cheapest path (Viterbi). The words a label may be made of are found by joining its substrings with the word counts, so
neither the counts nor the labels have to fit in one task. Multinomial naive Bayes is trained on all pages. Hosts that
hold a seed word in any inflected form are the class to block; the others are unlabelled: they start as good, and
those whose words speak for blocking change sides before the next round of training. Its weights are joined to distinct
hosts and paths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, stored

# Words of hosts from which the class to block is learnt.
SEEDS = [
    "bet", "cash", "casino", "cheap", "crack", "escort", "gambling", "jackpot", "loan", "lottery", "malware", "phishing",
    "pharmacy", "pills", "poker", "porn", "replica", "sex", "spam", "torrent", "viagra", "warez", "xxx",
]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LONGEST = 63  # letters of a word of the unigram model: a label of a host has no more
UNIT = 1_000_000  # weights are whole millionths, so that sums do not depend on their order
BLOCK_ODDS = 0.0  # log odds above which a page is blocked
ROUNDS = 5  # of training, at most; ends when no host changes sides
LETTERS = r"[^\p{L}]+"


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(rest) + 4)).otherwise(F.lit(""))
    host = F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(rest) + 4)).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule whose host is the url's or a domain above it and whose path starts the url's; null without any."""
    fits = None
    for text, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, below = text.partition("/")
        fit = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        fits = F.when(fit, text) if fits is None else fits.when(fit, text)
    return fits if fits is not None else F.lit(None).cast("string")


def verdict_of(rule: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    return F.coalesce(*[F.when(rule == text, verdict) for text, verdict in rules], F.lit(None).cast("string"))


def word_counts(texts: DataFrame, col: str) -> DataFrame:
    """(word, n): words of two to LONGEST letters in all texts, without markup."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"<[^<>]*>", " "))
    words = texts.select(F.explode(F.split(plain, LETTERS)).alias("word"))
    return words.filter(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def labels_of(host: Column) -> Column:
    """Runs of letters in a host, its last label left out when there are several."""
    name = F.when(F.contains(host, F.lit(".")), F.regexp_extract(host, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(host)
    return F.filter(F.split(F.lower(name), LETTERS), lambda x: x != "")


def cheapest_split(label: str, counts: dict[str, int], total: int) -> list[str]:
    """Viterbi path of a label under the unigram model; an unknown run costs more the longer it is."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    top = math.log(total + 1)
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(label[start:end])
            cost = top - math.log(n) if n else top + math.log(10.0) * (end - start)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    out, end = [], len(label)
    while end:
        out.append(label[best[end][1]:end])
        end = best[end][1]
    return out[::-1]


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for distinct labels: each with the counts of those of its substrings that are words."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = F.length("label")
    starts = labels.select("label", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - F.col("start") + 1))
    parts = starts.select("label", F.col("start"), F.explode(lengths).alias("len")).filter("len > 1")
    parts = parts.select("label", F.substr("label", F.col("start"), F.col("len")).alias("word")).distinct()
    known = parts.join(counts, "word").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))

    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for label, found in batches:
            yield pd.Series([cheapest_split(x, dict(f) if f is not None else {}, total) for x, f in zip(label, found)])

    split.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    cut = F.pandas_udf(split, "array<string>")
    return labels.join(known, "label", "left").select("label", cut("label", "known").alias("words"))


def stem(word: Column) -> Column:
    """The word without plural endings, -ing, -ed (and the letter doubled before them) and, of longer words, a last e."""
    out = F.regexp_replace(word, r"(?<=\p{L}{2})ies$", "y")
    out = F.regexp_replace(out, r"(?<=ss|sh|ch|x|z|o)es$", "")
    out = F.regexp_replace(out, r"(?<=\p{L}[^sui])s$", "")
    out = F.regexp_replace(out, r"^(\p{L}*[aeiouy]\p{L}*?)([^aeiouylsz])\2(?:ing|ed)$", "$1$2")
    out = F.regexp_replace(out, r"^(\p{L}*[aeiouy]\p{L}*)(?:ing|ed)$", "$1")
    return F.regexp_replace(out, r"(?<=\p{L}{4})e$", "")


def path_words(path: Column) -> Column:
    """Words of a path; a run of digits is one word whatever its value."""
    marked = F.regexp_replace(F.lower(path), r"[0-9]+", " # ")
    return F.filter(F.split(F.regexp_replace(marked, r"[^\p{L}#]+", " "), " "), lambda x: x != "")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str]] = RULES,
          seeds: list[str] = SEEDS) -> DataFrame:
    """(id, host, path, rule, verdict, odds) for every row of pages.

    A url without :// (null or empty too) has an empty host and path, no words and the odds of the classes alone. The
    longest fitting rule decides; without one the page is blocked if the log odds (in millionths) exceed
    BLOCK_ODDS. Ties go to allow. Where no host, or every host, holds a seed word all odds are null and pages that no
    rule decides are allowed.
    Repeated rows are judged alike; other columns are not read. No rows give no rows.
    """
    base = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    base = stored(base)
    hosts = stored(base.groupBy("host").agg(F.count("*").alias("pages")))
    named = hosts.select("host", labels_of(F.col("host")).alias("labels"))
    every = named.select("host", F.posexplode("labels").alias("pos", "label"))
    counts = stored(word_counts(pages, html_col))  # read twice below
    words = stored(segmented(stored(every.select("label").distinct()), counts))
    spelled = every.join(checked_broadcast(words), "label").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("pos", "words"))).alias("w"))
    spelled = named.select("host").join(spelled, "host", "left")
    host_words = F.coalesce(F.flatten(F.transform("w", lambda x: x["words"])), F.array().cast("array<string>"))
    hosts = stored(hosts.join(spelled.select("host", host_words.alias("words")), "host"))
    seeded = F.arrays_overlap(F.transform("words", stem), F.array(*[stem(F.lit(s)) for s in seeds]))
    hosts = stored(hosts.withColumn("seeded", seeded.cast("int")).withColumn("y", F.col("seeded")))

    sizes = {r["y"]: r["n"] for r in hosts.groupBy("y").agg(F.sum("pages").alias("n")).collect()}
    if len(sizes) < 2:
        rule = rule_for(F.col("host"), F.col("path"), rules)
        out = base.withColumn("rule", rule)
        return out.select("id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), F.lit("allow")).alias("verdict"), F.lit(None).cast("long").alias("odds"))
    n = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    paths = stored(base.groupBy("host", "path").agg(F.count("*").alias("n")))

    def scored(rows: DataFrame, key: str, prefix: str, words: Column) -> DataFrame:
        each = rows.select(key, F.explode(words).alias("w")).select(key, F.concat(F.lit(prefix), "w").alias("word"))
        return checked_broadcast(stored(each.join(weights, "word").groupBy(key).agg(F.sum("weight").alias(f"{key}_score"))))

    for step in range(ROUNDS):
        # words of both kinds, apart by a prefix, counted over all pages
        from_hosts = hosts.select("y", F.col("pages").alias("n"), F.explode("words").alias("word")).select("y", "n", F.concat(F.lit("h:"), "word").alias("word"))
        sided = paths.join(checked_broadcast(hosts.select("host", "y")), "host")
        from_paths = sided.select("y", "n", F.explode(path_words(F.col("path"))).alias("word")).select("y", "n", F.concat(F.lit("p:"), "word").alias("word"))
        counts = stored(from_hosts.union(from_paths).groupBy("word").agg(n(1).alias("bad"), n(0).alias("good")))
        total = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("words")).first()
        weight = F.log((F.col("bad") + 1) / (total["bad"] + total["words"])) - F.log((F.col("good") + 1) / (total["good"] + total["words"]))
        weights = checked_broadcast(stored(counts.select("word", F.round(weight * UNIT).cast("long").alias("weight"))))
        prior = round(UNIT * math.log(sizes[1] / sizes[0]))
        by_host = scored(hosts, "host", "h:", F.col("words"))
        speaks = (F.coalesce("host_score", F.lit(0)) + prior > BLOCK_ODDS * UNIT).cast("int")
        moved = stored(hosts.join(by_host, "host", "left").withColumn("to", F.greatest("seeded", speaks)))
        after = {r["to"]: r["n"] for r in moved.groupBy("to").agg(F.sum("pages").alias("n")).collect()}
        if step == ROUNDS - 1 or len(after) < 2 or moved.filter("y <> to").isEmpty():
            break
        sizes, hosts = after, moved.select("host", "pages", "words", "seeded", F.col("to").alias("y"))

    by_path = scored(base.select("path").distinct(), "path", "p:", path_words(F.col("path")))
    out = base.join(by_host, "host", "left").join(by_path, "path", "left")
    odds = F.coalesce("host_score", F.lit(0)) + F.coalesce("path_score", F.lit(0)) + prior
    out = out.withColumn("odds", odds.cast("long")).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("odds") > BLOCK_ODDS * UNIT, "block").otherwise("allow")
    return out.select("id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), method).alias("verdict"), "odds")
