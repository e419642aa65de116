"""Notice web pages: fields by tag patterns, links, unseen urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.text import col, let, strip, tender_id

# Labels and block ids on a notice page. Each entry gives the output column and what
# it holds when the page lacks it.
LABELLED_TEXT = {
    "notice_id": ("Notice identifier:", ""),
    "published_date": ("Published", ""),
    "reference": ("Reference", ""),
    "description": ("Description", ""),
    "award_decision_date": ("Award decision date", "Unknown"),
}
LABELLED_LISTS = {"contract_value": "Contract value", "contract_dates": "Contract dates (estimated)"}
BLOCKS = {"supplier": "supplier_or_tenderer_0", "authority": "contracting_authority_0"}


def inner_text(fragment) -> Column:
    """Text of an HTML fragment: tags dropped, basic entities decoded, trimmed."""
    bare = F.regexp_replace(col(fragment), "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return strip(bare)


def _quote(text: str) -> str:
    return "".join("\\" + ch if ch in "().[]+*?" else ch for ch in text)


def first_match(html, pattern: str, default: str | None) -> Column:
    """Text of the first capture of ``pattern``; ``default`` when the page has no match.

    A page is searched once, then only the match: ``pattern`` takes at least one character and does not look beyond its match.
    """
    found = F.regexp_extract(col(html), pattern, 0)
    return let(found, lambda m: F.when(F.length(m) > 0, inner_text(F.regexp_extract(m, pattern, 1))).otherwise(F.lit(default)))


def all_matches(fragment, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(col(fragment), F.lit(pattern), F.lit(1)), inner_text)


def _heading(label: str) -> str:
    return rf"(?s)<h3[^>]*>[^<]*{_quote(label)}[^<]*</h3>\s*"


def notice_fields(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The record of a notice page."""
    heading = r"(?s)<h1[^>]*class=\"[^\"]*govuk-heading-l[^\"]*\"[^>]*>(.*?)</h1>"
    publisher = r"(?s)govuk-grid-column-three-quarters[^>]*>.*?<ul[^>]*govuk-list[^>]*>\s*<li[^>]*>(.*?)</li>"
    out = [
        F.col(url).alias("url"),
        tender_id(url).alias("tender_id"),
        first_match(html, heading, "Untitled").alias("title"),
        first_match(html, publisher, "Unknown").alias("publishing_authority"),
    ]
    for name, (label, default) in LABELLED_TEXT.items():
        out.append(first_match(html, _heading(label) + r"<(?:p|div)[^>]*>(.*?)</(?:p|div)>", default).alias(name))
    for name, label in LABELLED_LISTS.items():
        block = F.regexp_extract(F.col(html), _heading(label) + r"<ul[^>]*>(.*?)</ul>", 1)
        out.append(all_matches(block, r"(?s)<li[^>]*>(.*?)</li>").alias(name))
    # Blocks are cut out once, then searched.
    bodies = {}
    for name, block_id in BLOCKS.items():
        title = rf"(?s)<h3[^>]*id=\"{block_id}\"[^>]*>(.*?)</h3>"
        body = f"_{name}_body"
        bodies[body] = F.regexp_extract(F.col(html), title + r"\s*<div[^>]*govuk-body[^>]*>(.*?)</div>", 2)
        address = all_matches(body, r"(?s)<p[^>]*>(.*?)</p>")
        given = let(address, lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit("Unknown"))))
        out += [
            first_match(html, title, "Unknown").alias(f"{name}_name"),
            given.alias(f"{name}_address"),
            first_match(body, r"href=\"mailto:([^\"]*)\"", "Unknown").alias(f"{name}_email"),
        ]
    out.append(first_match("_authority_body", r"href=\"(http[^\"]*)\"", "Unknown").alias("authority_website"))
    return pages.withColumns(bodies).select(*out)


def page_links(pages: DataFrame, pattern: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Distinct links matching ``pattern`` per page, one row each."""
    links = F.regexp_extract_all(F.col(html), F.lit(rf'href="({pattern})"'), F.lit(1))
    return pages.select(key, F.explode(F.array_sort(F.array_distinct(links))).alias("link"))


def distinct_links(links: DataFrame, link: str = "link") -> DataFrame:
    """Each link once, however many pages hold it."""
    return links.select(link).distinct()


def unseen_urls(links: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    return links.join(known.select(url), url, "left_anti")
