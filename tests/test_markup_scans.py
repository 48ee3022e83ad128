"""Texts without markup or links are not put through every pattern, and come out the same."""

import time

from pyspark.sql import functions as F

from palaver.functions import markup as mk
from palaver.functions import text as tx

MARKED = [
    "a &gt; b", "&gt; said\nb", "> said\nb", "```x\ny``` b", "    code\nb", "\tcode\nb", "a `x` b", "![i](http://x.y/z) b", "[t](u) b", "**a** b", "__a__ b", "*a* b",
    "_a_ b", "a _b_ c", "## a", "a\n---\nb", "a\n***\nb", "- a", "a\n  + b", "a\n12. b", "\u2028- a", "a\r1. b", "a &lt; b", "a &quot;b&quot;", "a&#39;b", "a&#x27;b", "a&apos;b",
    "a&nbsp;b", "a &amp; b", "a &#x200B; b", "see https://www.x.y/z", "see http://x.y", "[deleted]", "", " ", "peut-\u00eatre 1.5, 2+2 (non)",
]
LINKED = ["x.y/z", "a b.c-d.e/f?g=1 h", "http://x.y/z", "et/ou 1/2 a. b/c", "a./b", ".a/b", "x.y/", "[t](http://a.b/c) d.e/f", "[t](http://a.b/c) d", "\u00e9.\u00e8/\u00e0", "a..b/c", None]


def test_same_as_all_steps(spark):
    df = spark.createDataFrame([(t,) for t in MARKED + LINKED], "t string")
    body = tx.non_empty_md(F.col("t"))
    for quotes in (True, False):
        for code in (True, False):
            whole = mk.apply_steps(body, mk.raw_text_steps(quotes, code))
            assert df.filter(~mk.raw_text(F.col("t"), quotes, code).eqNullSafe(whole)).collect() == []
    rest = F.regexp_replace(body, mk.MD_LINK_WHOLE, " ")
    links = F.concat(tx.matches(body, mk.MD_LINK, 1), tx.matches(rest, mk.BARE_URL))
    assert df.filter(~mk.hyperlinks(F.col("t")).eqNullSafe(links)).collect() == []
    assert df.filter(F.size(links) > 0).count() == 8


def test_a_very_long_word(spark):
    """Looking for a URL from each letter of a word to its end takes time with the square of its length."""
    df = spark.range(1).select(F.expr("repeat('a', 600000)").alias("t")).cache()
    assert df.count() == 1
    start = time.perf_counter()
    assert df.select(F.size(mk.hyperlinks(F.col("t")))).first()[0] == 0
    assert time.perf_counter() - start < 20
