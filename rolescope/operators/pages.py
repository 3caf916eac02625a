"""Careers pages: platform, company, posting links, descriptions, visible text.

A page is one row. Links are found, counted, deduplicated and filtered inside that row's arrays, so a
page with very many links is never gathered again by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.functions.html import (
    attr, below, class_contains, decoded, element_texts, first_or_null, has_class, inner_text,
    marked_around, next_sibling, parse_html,
)
from rolescope.functions.normalize import job_id
from rolescope.functions.urls import absolute_url, host, url_base
from rolescope.functions.words import any_of, blank_to_null, contains_any, let, or_empty, strip, unfold
from rolescope.operators.dedup import new_by_key
from rolescope.operators.filters import excluded_company, keep_all_when_none, title_passes
from rolescope.rules import Rules
from rolescope.session import bound_batches, settle

# Platforms in order, with the host parts that name them.
PLATFORM_HOSTS = (
    ("greenhouse", ("greenhouse.io", "boards.greenhouse")),
    ("lever", ("lever.co", "jobs.lever")),
    ("workday", ("myworkday", "workday")),
    ("ashby", ("ashbyhq.com",)),
    ("smartrecruiters", ("smartrecruiters",)),
    ("jobvite", ("jobvite",)),
    ("icims", ("icims",)),
)
# Platforms also recognised by name near the start of the page.
PLATFORM_MENTIONS = ("greenhouse", "lever")
MENTION_WINDOW = 2000
# Page titles that carry the company name.
TITLE_PATTERNS = (
    r"(?i)(?:jobs?\s+at|careers?\s+at)\s+(.+?)(?:\s*[-|]|$)",
    r"(?i)^(.+?)\s+(?:careers?|jobs?|openings?)",
    r"(?i)^(.+?)\s*[-|]",
)
# Link texts that are navigation.
SKIP_WORDS = ("sign in", "log in", "about", "contact", "privacy", "terms", "cookie", "home", "back to")
SKIP_WORDS_LISTED = (*SKIP_WORDS, "see all", "load more", "menu")
# Containers of generic listings in order: a tag, a class or a class part.
LISTED_ORDER = (
    ("tag", "li"), ("class", "job"), ("class", "position"), ("tag", "tr"), ("class", "card"),
    ("class", "listing"), ("part", "job"), ("part", "position"), ("part", "career"), ("part", "opening"),
    ("part", "posting"), ("part", "vacancy"),
)
# Class of a posting's head, and of the block with its place.
POSTING_TITLE, POSTING_CATEGORIES = "posting-title", "posting-categories"
# What an element may be asked to stand inside of; the listing containers come first.
MARKS = (*LISTED_ORDER, ("class", POSTING_TITLE), ("class", POSTING_CATEGORIES))
# Patterns over links and the text near them.
JOB_PATH = r"(?i)/jobs?/|/careers?/|/positions?/|/openings?/|/posting|/role|/apply"
WORKPLACE = r"(?i)remote|hybrid|onsite|office"
PLACE = r"(?i)remote|hybrid|on-?site|(?:san|new|los|seattle|austin|chicago)"
# A container counts as a listing from this many links on.
MIN_LISTED = 3
MIN_LINKS = 3
MAX_DESCRIPTION = 5000

_LINK = "array<struct<title: string, url: string, location: string>>"


def platform(url: Column, html: Column) -> Column:
    """Job board platform: host rules in order, then names near the page start, else generic."""
    name, head = host(url), F.lower(F.substring(html, 1, MENTION_WINDOW))
    result = F.when(F.lit(False), "")
    for label, parts in PLATFORM_HOSTS:
        result = result.when(contains_any(name, parts), label)
    for label in PLATFORM_MENTIONS:
        result = result.when(head.contains(label), label)
    return result.otherwise("generic")


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def site_name(html: Column) -> Column:
    tag = F.regexp_extract(html, r"""(?i)(<meta\b[^>]*property=["']og:site_name["'][^>]*>)""", 1)
    return F.concat(*[F.regexp_extract(tag, rf"(?i)content={quote}([^{quote}]*){quote}", 1) for quote in ('"', "'")])


def capitalised(label: Column) -> Column:
    """Every run of letters with a capital, the rest of it small: 3m-paints gives 3M-Paints."""
    runs = F.regexp_extract_all(label, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def company_name(url: Column, html: Column, override: Column | None = None) -> Column:
    """Given name, site-name meta, title patterns, else the host's first label with capitals."""
    title = strip(decoded(page_title(html)))
    choices = [blank_to_null(strip(decoded(site_name(html))))]
    choices += [blank_to_null(strip(F.regexp_extract(title, pattern, 1))) for pattern in TITLE_PATTERNS]
    choices.append(capitalised(F.element_at(F.split(host(url), r"\."), 1)))
    if override is not None:
        choices.insert(0, blank_to_null(override))
    return F.coalesce(*choices)


def unescaped(text: Column) -> Column:
    """The five escapes every HTML writer uses, and the non-breaking blank, with or without semicolon."""
    for escape, plain in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"),
                          ("&nbsp;?", "\u00a0"), ("&amp;?", "&")):
        text = F.regexp_replace(text, escape, plain)
    return text


def visible_text(parsed: Column) -> Column:
    """Page text without script, style, nav and footer, one text per line."""
    hidden = F.filter(parsed["elements"], lambda element: element["tag"].isin("nav", "footer"))
    return let(hidden, lambda ranges: F.array_join(F.filter(
        parsed["texts"],
        lambda text, at: ~F.exists(ranges, lambda element: (element["first_text"] <= at)
                                   & (at < element["next_text"])),
    ), "\n"))


def visible_text_native(html: Column) -> Column:
    """The same for regular pages, as regex replacements only (no Python)."""
    for tag in ("script", "style", "nav", "footer"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", "<>")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "<>")
    return strip(unescaped(F.regexp_replace(html, r"\s*(?:<[^>]*>\s*)+", "\n")))


def parsed_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Replace the HTML by its parsed form ``page``, with ``base`` for its links; the raw text goes no
    further. Pages go to the workers in small batches, see ``bound_batches``."""
    bound_batches(pages.sparkSession)
    parsed = pages.withColumn("page", parse_html(F.col(html), MARKS)).drop(html)
    return parsed.withColumn("base", url_base(F.col(url))) if url in parsed.columns else parsed


def _container(kind: str, name: str):
    if kind == "tag":
        return lambda element: element["tag"] == name
    if kind == "class":
        return lambda element: has_class(element, name)
    return lambda element: class_contains(element, name)


def _anchors(elements: Column, *parts: str) -> Column:
    """Links whose href contains one of the parts; any href when none is given."""
    def test(element: Column) -> Column:
        href = element["attrs"]["href"]
        wanted = any_of(href.contains(part) for part in parts) if parts else href.isNotNull()
        return (element["tag"] == "a") & wanted
    return F.filter(elements, test)


def _link(title: Column, url: Column, location: Column) -> Column:
    return F.struct(title.alias("title"), url.alias("url"), or_empty(location).alias("location"))


def _near_text(link: Column, page: Column, pattern: str) -> Column:
    """The first text inside the link's parent that matches."""
    texts = element_texts(F.get(page["elements"], link["parent"]), page["texts"])
    return first_or_null(F.filter(texts, lambda text: text.rlike(pattern)))


def board_links(page: Column, base: Column) -> Column:
    """Layout with one link per posting and its place in a span beside it or in the next element."""
    elements, texts = page["elements"], page["texts"]

    def place(parent: Column) -> Column:
        span = first_or_null(F.filter(below(parent, elements), lambda element: (element["tag"] == "span")
                                      & F.lower(attr(element, "class")).contains("location")))
        return let(F.coalesce(span, next_sibling(parent, elements)), lambda found: inner_text(found, texts))

    def one(link: Column) -> Column:
        return _link(inner_text(link, texts), absolute_url(base, attr(link, "href")),
                     let(F.get(elements, link["parent"]), place))
    links = F.transform(_anchors(elements, "/jobs/"), one)
    return F.filter(links, lambda link: (F.length(link["title"]) > 3) & link["url"].contains("/jobs/"))


def block_links(page: Column, base: Column) -> Column:
    """Layout with one block per posting: title, link and place are looked up inside the block."""
    elements, texts = page["elements"], page["texts"]

    def is_title(element: Column) -> Column:
        heading = (element["tag"] == "h5") & marked_around(element, MARKS.index(("class", POSTING_TITLE)))
        return heading | ((element["tag"] == "a") & has_class(element, POSTING_TITLE))

    def is_link(element: Column) -> Column:
        return (element["tag"] == "a") & (
            has_class(element, POSTING_TITLE) | attr(element, "href").contains("/jobs/"))

    def is_place(element: Column) -> Column:
        listed = has_class(element, "location") & marked_around(
            element, MARKS.index(("class", POSTING_CATEGORIES)))
        return listed | has_class(element, "workplaceTypes")

    def one(inner: Column) -> Column:
        link = F.coalesce(first_or_null(F.filter(inner, is_link)),
                          first_or_null(F.filter(inner, lambda element: element["tag"] == "a")))
        return _link(
            or_empty(let(first_or_null(F.filter(inner, is_title)), lambda title: inner_text(title, texts))),
            let(link, lambda found: F.when(found.isNotNull(), absolute_url(base, attr(found, "href"))).otherwise("")),
            let(first_or_null(F.filter(inner, is_place)), lambda place: inner_text(place, texts)),
        )
    blocks = F.filter(elements, lambda element: has_class(element, "posting"))
    links = F.transform(blocks, lambda block: let(below(block, elements), one))
    return F.filter(links, lambda link: (link["title"] != "") & (link["url"] != ""))


def workplace_links(page: Column, base: Column) -> Column:
    """Layout with posting links and a workplace word near each."""
    links = F.transform(
        _anchors(page["elements"], "/jobs/", "/posting/"),
        lambda link: _link(inner_text(link, page["texts"]), absolute_url(base, attr(link, "href")),
                           _near_text(link, page, WORKPLACE)),
    )
    return F.filter(links, lambda link: F.length(link["title"]) > 3)


def _first_per(links: Column, key) -> Column:
    """First link per key inside one page, order kept: sorted by key and place, so that equal keys are neighbours."""
    def pick(found: Column) -> Column:
        places = F.array_sort(F.transform(found, lambda link, at: F.struct(key(link).alias("key"), at.alias("at"))))
        return let(places, lambda ordered: F.transform(F.array_sort(F.transform(
            F.filter(ordered, lambda place, at: (at == 0) | ~place["key"].eqNullSafe(F.get(ordered, at - 1)["key"])),
            lambda place: place["at"])), lambda at: F.get(found, at)))
    return let(links, pick)


def first_per_url(links: Column) -> Column:
    return _first_per(links, lambda link: link["url"])


def _usable_title(title: Column, skip: tuple[str, ...]) -> Column:
    return F.length(title).between(5, 200) & ~contains_any(F.lower(title), skip)


def listed_links(page: Column, base: Column) -> Column:
    """Links inside repeated containers. A container kind counts from three links on."""
    kinds = F.array(*[F.lit(bit) for bit in range(len(LISTED_ORDER))])

    def in_container(anchors: Column, bit: Column) -> Column:
        hits = F.filter(anchors, lambda link: marked_around(link, bit))
        return let(hits, lambda found: F.when(F.size(found) >= MIN_LISTED, found).otherwise(F.slice(found, 1, 0)))
    listed = let(_anchors(page["elements"]), lambda anchors: F.flatten(
        F.transform(kinds, lambda bit: in_container(anchors, bit))))
    links = F.transform(
        listed,
        lambda link: _link(inner_text(link, page["texts"]), absolute_url(base, attr(link, "href")),
                           F.substring(_near_text(link, page, PLACE), 1, 100)),
    )
    return first_per_url(F.filter(links, lambda link: _usable_title(link["title"], SKIP_WORDS_LISTED)))


def path_links(page: Column, base: Column) -> Column:
    """Any link whose URL looks like a posting; used when listings gave too few."""
    links = F.transform(
        _anchors(page["elements"]),
        lambda link: _link(inner_text(link, page["texts"]), absolute_url(base, attr(link, "href")), F.lit("")),
    )
    return first_per_url(F.filter(
        links, lambda link: link["url"].rlike(JOB_PATH) & _usable_title(link["title"], SKIP_WORDS)))


# Class parts of posting cards, of their titles and of their places.
CARD_CLASS_PARTS = ("PositionCard", "position-card")
CARD_LIST_PARTS = ("careers-list", "job-list")
CARD_TITLE_PARTS = ("title", "Title")
CARD_PLACE_PARTS = ("location", "Location")
CARD_LINKS = ("pid=", "/careers/", "/jobs/")


def _class_any(element: Column, parts) -> Column:
    return any_of(class_contains(element, part) for part in parts)


def card_links(page: Column, base: Column) -> Column:
    """Layout with posting cards; links of posting paths when there are no cards."""
    elements, texts = page["elements"], page["texts"]

    def is_card(element: Column) -> Column:
        parent = F.get(elements, element["parent"])
        listed = (element["tag"] == "div") & (parent["tag"] == "div") & _class_any(parent, CARD_LIST_PARTS)
        return (
            (attr(element, "data-test-id") == "position-card") | _class_any(element, CARD_CLASS_PARTS)
            | (attr(element, "role") == "listitem")
            | ((element["tag"] == "article") & class_contains(element, "job"))
            | F.coalesce(listed, F.lit(False))
        )

    def is_title(element: Column) -> Column:
        return (element["tag"].isin("h3", "h4", "a") | _class_any(element, CARD_TITLE_PARTS)
                | (attr(element, "data-test-id") == "position-title"))

    def is_link(element: Column) -> Column:
        return (element["tag"] == "a") & any_of(attr(element, "href").contains(part) for part in CARD_LINKS)

    def is_place(element: Column) -> Column:
        return _class_any(element, CARD_PLACE_PARTS) | (attr(element, "data-test-id") == "position-location")

    def place(inner: Column) -> Column:
        return let(first_or_null(F.filter(inner, is_place)), lambda found: inner_text(found, texts, " "))

    def from_card(card: Column, inner: Column) -> Column:
        # The card itself or the nearest link around it, when it has no posting link inside.
        around = F.when(card["tag"] == "a", card).otherwise(F.get(elements, card["in_link"]))
        link = F.coalesce(first_or_null(F.filter(inner, is_link)), around)
        return _link(
            or_empty(let(first_or_null(F.filter(inner, is_title)), lambda found: inner_text(found, texts, " "))),
            let(link, lambda found: F.when(found.isNotNull(), absolute_url(base, attr(found, "href"))).otherwise("")),
            place(inner),
        )

    def from_link(link: Column) -> Column:
        inner = let(F.get(elements, link["in_box"]), lambda box: below(box, elements))
        return _link(inner_text(link, texts, " "), absolute_url(base, attr(link, "href")), let(inner, place))

    def unique(links: Column) -> Column:
        return _first_per(links, lambda link: F.concat(link["title"], link["url"]))

    cards = unique(F.filter(
        F.transform(F.filter(elements, is_card), lambda card: let(
            below(card, elements), lambda inner: from_card(card, inner))),
        lambda link: link["title"] != ""))
    plain = unique(F.filter(F.transform(F.filter(elements, is_link), from_link),
                            lambda link: F.length(link["title"]).between(6, 199)))
    return let(cards, lambda found: F.when(F.size(found) > 0, found).otherwise(plain))


def generic_links(page: Column, base: Column) -> Column:
    """Listed links; when they are fewer than three, also links with a posting path."""
    def complete(listed: Column) -> Column:
        def more(known: Column) -> Column:
            return F.concat(listed, F.filter(
                path_links(page, base), lambda link: ~F.array_contains(known, link["url"])))
        few = let(F.transform(listed, lambda link: link["url"]), more)
        return F.when(F.size(listed) < MIN_LINKS, few).otherwise(listed)
    return let(listed_links(page, base), complete)


def posting_links(pages: DataFrame) -> DataFrame:
    """Pages with ``platform``, ``company`` and ``links`` (first per URL); expects url and html."""
    page, base, board = F.col("page"), F.col("base"), F.col("platform")
    links = (
        F.when(board == "greenhouse", board_links(page, base).cast(_LINK))
        .when(board == "lever", block_links(page, base).cast(_LINK))
        .when(board == "ashby", workplace_links(page, base).cast(_LINK))
        .otherwise(generic_links(page, base).cast(_LINK))
    )
    named = pages.withColumns({
        "platform": platform(F.col("url"), F.col("html")),
        "company": company_name(F.col("url"), F.col("html")),
    })
    return parsed_pages(named).withColumn("links", first_per_url(links)).drop("page", "base")


def matching_links(pages: DataFrame, rules: Rules, keep_all: bool = True) -> DataFrame:
    """One row per link whose title passes. With ``keep_all`` a page where none passes keeps all."""
    def test(link: Column) -> Column:
        return title_passes(link["title"], rules)
    chosen = keep_all_when_none(F.col("links"), test) if keep_all else F.filter("links", test)
    rows = F.transform(chosen, lambda link, at: F.struct(
        at.alias("link_no"), link["title"].alias("title"), link["url"].alias("link_url"), link["location"].alias("location")))
    return unfold(pages, [name for name in pages.columns if name != "links"], rows, "link_no")


# Places of a description, best first: (attribute, value), a class part or a tag.
DESCRIPTION_PLACES = (
    ("id", "content"), ("class", "content-wrapper"),
    ("class", "posting-page"), ("class", "content"),
    ("data-testid", "job-description"), ("class", "ashby-job-posting-description"),
    ("data-automation-id", "jobPostingDescription"),
    ("class", "job-description"), ("class", "description"), ("id", "job-description"),
    ("part", "description"), ("part", "job-detail"),
    ("tag", "article"), ("class", "posting-requirements"),
    ("tag", "main"),
)
MIN_DESCRIPTION = 100


def _place_test(kind: str, name: str):
    if kind in ("tag", "class", "part"):
        return _container(kind, name)
    return lambda element: attr(element, kind) == name


def page_description(page: Column) -> Column:
    """Text of the first place with more than 100 characters, else of the last place tried if the page
    has it, else the start of the body."""
    elements, texts = page["elements"], page["texts"]
    candidates = F.array(*[first_or_null(F.filter(elements, _place_test(*place))) for place in DESCRIPTION_PLACES])

    def choose(found: Column) -> Column:
        long_enough = F.filter(found, lambda element: F.coalesce(
            F.length(inner_text(element, texts)) > MIN_DESCRIPTION, F.lit(False)))
        return F.coalesce(first_or_null(long_enough), F.element_at(found, len(DESCRIPTION_PLACES)))
    body = first_or_null(F.filter(elements, lambda element: element["tag"] == "body"))
    return F.coalesce(
        let(let(candidates, choose), lambda chosen: inner_text(chosen, texts, " ")),
        let(body, lambda found: F.substring(inner_text(found, texts, " "), 1, MAX_DESCRIPTION)),
        F.lit(""),
    )


def careers_links(boards: DataFrame, stored: DataFrame, rules: Rules) -> DataFrame:
    """Postings of careers pages that pass by title and company and are not stored, without descriptions."""
    links = matching_links(posting_links(boards), rules).drop("html")
    rows = links.filter(~excluded_company(F.col("company"), rules)).select(
        job_id(F.col("link_url"), F.col("company"), F.col("title")).alias("id"),
        "company", "title", F.lit("N/A").alias("salary"),
        F.col("link_url").alias("apply_link"), F.col("link_url").alias("job_link"),
        "location", "page_id", "link_no",
    )
    return new_by_key(rows, stored)


def careers_postings(boards: DataFrame, details: DataFrame, stored: DataFrame, rules: Rules) -> DataFrame:
    """New, unscored postings of careers pages: links that pass, joined with the crawled pages behind them.

    The links come first and are settled, narrow as they are, since two joins read them. Crawled pages are parsed
    above the join with them, so a page that no new posting links to is never parsed. A link whose page was not
    crawled keeps an empty description; of a page crawled twice the smallest page id counts.
    """
    links = settle(careers_links(boards, stored, rules), "careers-links")
    wanted = links.select(F.col("job_link").alias("url")).distinct()
    # The copies of a page are told apart on (url, page_id) alone.
    once = details.select("url", "page_id").join(wanted, "url", "left_semi").groupBy("url").agg(
        F.min("page_id").alias("page_id"))
    crawled = details.select("url", "page_id", "html").join(once, ["url", "page_id"], "left_semi")
    texts = parsed_pages(crawled).select(
        F.col("url").alias("job_link"), page_description(F.col("page")).alias("description"))
    return links.join(texts, "job_link", "left").withColumn("description", or_empty(F.col("description")))
