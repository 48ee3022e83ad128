"""Markdown and HTML measures as chains of regular expressions over whole columns.

Patterns stay inside the syntax that Java and RE2 share, so that the same text gives the
same result in any engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

# Unix-lines + multiline, the meaning RE2 gives to (?m).
M = "(?dm)"

ENTITY_GT = ("&gt;", ">")
# Entities that cannot start a quote are decoded in the text, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&quot;", '"'), ("&(?:#39|#x27|apos);", "'"), ("&nbsp;", " "), ("&amp;", "&")]
# What stands in the parentheses of a link, which may hold one pair of its own.
IN_LINK = r"[^()]*(?:\([^()]*\)[^()]*)*"
DROP_QUOTES = (M + r"^[ \t]*>[^\n]*$", "")
DROP_FENCES = (r"(?s)```.*?```", "")
DROP_INDENTED = (M + r"^(    |\t)[^\n]*$", "")
DROP_SPANS = (r"`[^`\n]*`", "")
TO_TEXT = [
    (r"!\[[^\]]*\]\(" + IN_LINK + r"\)", ""),
    (r"\[([^\]]*)\]\(" + IN_LINK + r"\)", "$1 "),
    (r"\*\*([^*\n]+)\*\*", "$1 "),
    (r"__([^_\n]+)__", "$1 "),
    (r"\*([^*\n]+)\*", "$1 "),
    (r"(^|[\s(])_([^_\n]+)_", "$1$2 "),
    (M + r"^#{1,6}[ \t]+", ""),
    (M + r"^(-{3,}|\*{3,})$", ""),
    (M + r"^[ \t]*([-*+]|[0-9]+\.)[ \t]+", ""),
    *ENTITIES,
    (tx.SPECIAL_CHARACTERS, ""),
]
# Every step from Markdown to text needs one of these; a text without them is raw as it stands.
MARKS = M + r"[&>`\[*_#\t]|    |https?://|^[ \t]*(?:[-+]|[0-9]+\.)"

MD_LINK = r"\]\(([^()\s]+(?:\([^()\s]*\)[^()\s]*)*)[^)]*\)"
MD_LINK_WHOLE = r"\[[^\]]*\]\(" + IN_LINK + r"\)"
# Fixed value: a URL in running text needs a slash.
BARE_URL = r"(https?://)?[\w\-]+(\.[\w\-]+)+/[-a-zA-Z0-9+&@#/%?=~_|!:,;.]*[-a-zA-Z0-9+&@#/%=~_|]"
# What each such URL holds; found in one scan, where the whole pattern tries every letter of every word.
URL_CORE = r"\.[\w\-]+/"
QUOTE_RUN = M + r"(?:^[ \t]*(?:>|&gt;)[^\n]*\n?)+"
QUOTE_START = r"^\s*(>|&gt;)"
FORMATTING = [
    r"(?s)```.*?```",
    r"`[^`\n]+`",
    M + r"^#{1,6}[ \t]+",
    M + r"(?:^[ \t]*[-*+][ \t]+[^\n]*\n?)+",
    M + r"(?:^[ \t]*[0-9]+\.[ \t]+[^\n]*\n?)+",
    M + r"^(?:-{3,}|\*{3,})$",
    MD_LINK_WHOLE,
    r"\*\*[^*\n]+\*\*|\*[^*\n]+\*",
    r"__[^_\n]+__",
    r"(?:^|[\s(])_[^_\n]+_",
]

# Tags that count as formatting.
FORMATTING_TAGS = ["code", "h1", "h2", "h3", "h4", "h5", "h6", "ol", "ul", "hr", "a", "i", "em", "strong"]

HTML_NOISE = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
OPEN_TAG = r"<([a-zA-Z][a-zA-Z0-9]*)"
HREF = r"<a\s[^>]*href=\"([^\"]+)\""
HTML_TO_MD = [
    (HTML_NOISE, ""),
    (r"(?i)<title>[^<]*</title>", ""),
    (r"(?is)<a\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)"),
    (r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**"),
    (r"(?i)</?(?:i|em)(?:\s[^>]*)?>", "*"),
    (r"(?i)</?code(?:\s[^>]*)?>", "`"),
    (r"(?i)<h[1-6](?:\s[^>]*)?>", "\n\n# "),
    (r"(?i)<li(?:\s[^>]*)?>", "\n- "),
    (r"(?i)<(?:blockquote|footer)(?:\s[^>]*)?>", "\n\n> "),
    (r"(?i)<(?:p|br|hr|/h[1-6]|/ul|/ol|div|article)(?:\s[^>]*)?/?>", "\n\n"),
    (r"<[^>]*>", ""),
]


def apply_steps(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, s: F.regexp_replace(acc, s[0], s[1]), steps, c)


def raw_text_steps(remove_quotes: bool, remove_code: bool) -> list[tuple[str, str]]:
    steps = [ENTITY_GT]
    if remove_quotes:
        steps.append(DROP_QUOTES)
    if remove_code:
        steps += [DROP_FENCES, DROP_INDENTED, DROP_SPANS]
    return steps + TO_TEXT


def raw_text(md: Column, remove_quotes: bool = True, remove_code: bool = True) -> Column:
    """Readable text of a Markdown body; sentinel and blank bodies are null."""
    body = tx.non_empty_md(md)
    return F.when(body.rlike(MARKS), apply_steps(body, raw_text_steps(remove_quotes, remove_code))).otherwise(body)


def trim_markdown(md: Column, remove_quotes: bool = False, remove_code: bool = False) -> Column:
    """As raw_text, but only "[deleted]" (and null) is null; other empty bodies give ""."""
    text = F.coalesce(raw_text(md, remove_quotes, remove_code), F.lit(""))
    return F.when(md != "[deleted]", text)


def hyperlinks(md: Column) -> Column:
    """Link targets, then bare URLs outside of links."""
    body = tx.non_empty_md(md)
    rest = F.regexp_replace(body, MD_LINK_WHOLE, " ")
    bare = F.when(~rest.rlike(URL_CORE), F.array().cast("array<string>")).otherwise(tx.matches(rest, BARE_URL))
    return F.concat(tx.matches(body, MD_LINK, 1), bare)


def n_hyperlinks(links: Column) -> Column:
    return F.coalesce(F.size(F.coalesce(links, F.array().cast("array<string>"))), F.lit(0)).cast("long")


def count_quotes(md: Column) -> Column:
    """Outermost quote blocks."""
    return F.coalesce(F.regexp_count(tx.non_empty_md(md), F.lit(QUOTE_RUN)), F.lit(0)).cast("long")


def formatting_count(md: Column) -> Column:
    """Markdown constructs; null for "no text"."""
    body = tx.non_empty_md(md)
    return reduce(lambda a, b: a + b, [F.regexp_count(body, F.lit(p)).cast("long") for p in FORMATTING])


def is_quote_paragraph(block: Column) -> Column:
    return F.coalesce(block.rlike(QUOTE_START), F.lit(False))


def blocks(md: Column) -> Column:
    return F.filter(F.split(md, r"\n{2,}"), lambda b: b != "")


def html_clean(html: Column) -> Column:
    return F.regexp_replace(html, HTML_NOISE, "")


def html_tags(html: Column) -> Column:
    return tx.matches(html_clean(html), OPEN_TAG, 1)


def html_hrefs(html: Column) -> Column:
    return tx.matches(html_clean(html), HREF, 1)


def html_formatting_count(html: Column) -> Column:
    return F.size(F.filter(html_tags(html), lambda t: t.isin(FORMATTING_TAGS))).cast("long")


def html_elements(html: Column, tag: str) -> Column:
    """Contents of each element of one tag."""
    return tx.matches(html_clean(html), rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def html_to_markdown(html: Column) -> Column:
    return apply_steps(html, HTML_TO_MD)


def with_text_features(df: DataFrame, md: str, outputs: list[str], reuse: tuple[str, ...] = ()) -> DataFrame:
    """Add the named measures of a Markdown column.

    Columns listed in `reuse` are already there and are built upon instead of recomputed.
    The raw text and the links are staged, so that each is evaluated once; whatever is not
    requested is pruned from the plan.
    """
    staged = {"dgms_body_raw": raw_text(F.col(md)), "dgms_hyperlinks": hyperlinks(F.col(md))}
    measures = {
        "dgms_n_sentences": tx.n_sentences(F.col("dgms_body_raw")),
        "dgms_n_words": tx.n_words(F.col("dgms_body_raw")),
        "dgms_n_hyperlinks": n_hyperlinks(F.col("dgms_hyperlinks")),
        "dgms_n_quotes": count_quotes(F.col(md)),
        "dgms_n_formatting": formatting_count(F.col(md)),
    }
    kept = [c for c in df.columns if c not in outputs or c in reuse]
    out = df.withColumns({k: c for k, c in staged.items() if k not in reuse})
    out = out.withColumns({k: c for k, c in measures.items() if k in outputs and k not in reuse})
    return out.select(*kept, *[o for o in outputs if o not in kept])
