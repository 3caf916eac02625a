"""Queries: excerpts, typed lines, tags, and careers pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolescope.functions import text as tx
from rolescope.functions.normalize import company_key, logo_url, website
from rolescope.functions.words import unfold
from rolescope.operators import filters, pages as pg
from rolescope.operators.intake import import_careers
from rolescope.plans import fixtures as fx
from rolescope.plans.fixtures import RULES
from rolescope.plans.registry import query
from rolescope.plans.scores import tidy_sql
from rolescope.rules import Rules

# Some plain words of the documents become section headings, so that every branch is met.
_HEADED = "replace(replace(replace(text, ' that ', ' Responsibilities '), ' was ', '.  '), ' from ', ' Benefits ')"


@query("excerpt", f"""
WITH {tidy_sql(_HEADED, "doc_id", "documents")}
SELECT doc_id, CASE WHEN length(tidy) > 800 THEN regexp_replace(substr(tidy, 1, 800), ' [^ ]*$', '') || '...'
  ELSE tidy END AS excerpt FROM tidy""")
def excerpt(spark, sf):
    rows = fx.texts(spark, sf).selectExpr("doc_id", f"{_HEADED} AS body")
    return rows.select("doc_id", tx.excerpt(F.col("body"), tx.SHORT_EXCERPT).alias("excerpt"))


# Line marks are put in front of some words, so that every kind of line occurs.
_MARKED = ("replace(replace(replace(replace(replace(text, '. The ', '\\n\\n* The '), '. On ', '\\n## On '), ' the the ', '  '), "
           "' of of ', ':\\n'), '. And ', '\\n**And** ')")
_MARKED_SQL = _MARKED.replace("\\n", "' || chr(10) || '")
_HEADER_SQL = tx.HEADER_LINE.replace("'", "''")


def _plain_sql(text: str) -> str:
    """A description before it is split: quotes straightened, heading and emphasis marks replaced."""
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    translate({text}, '‘’“”', '''''""'),
    '(?m)^#{{1,4}}\s+(.+)$', '\1', 'g'), '(?m)^\*{{1,2}}([^*\n]+)\*{{1,2}}\s*$', '\1', 'g'),
    '\*\*([^*]+)\*\*', '<b>\1</b>', 'g'), '\*([^*]+)\*', '<i>\1</i>', 'g'), ' ' || chr(10))"""


_GLUED = r"regexp_replace(text, '\. (?:The|And|On) ', 'Build ', 'g')"


@query("segment_lines", rf"""
WITH b AS (SELECT doc_id, {_plain_sql(_MARKED_SQL)} AS body FROM documents),
c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(body, '  +|\n\n+|\n'), lambda x: trim(x)),
    lambda x: x <> '') AS chunks FROM b),
l AS (SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS line_no FROM c),
k AS (SELECT *, CASE WHEN regexp_matches(chunk, '^(?:[•\-\*]|\d+[.)]\s)\s*') THEN 'bullet'
    WHEN regexp_matches(chunk, '{_HEADER_SQL}') OR (length(chunk) < 60 AND chunk LIKE '%:')
      OR (length(chunk) < 50 AND chunk NOT LIKE '%.'
        AND NOT regexp_matches(chunk, '(?:^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}')
        AND NOT regexp_matches(chunk, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]\p{{Lu}}')) THEN 'header' ELSE 'text' END AS kind FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kind, CASE kind
    WHEN 'bullet' THEN regexp_replace(chunk, '^(?:[•\-\*]|\d+[.)]\s)\s*', '')
    WHEN 'header' THEN regexp_replace(chunk, ':+$', '') ELSE chunk END AS content FROM k""")
def segment_lines(spark, sf):
    rows = fx.texts(spark, sf).selectExpr("doc_id", f"{_MARKED} AS body")
    return tx.typed_lines(rows, "doc_id", "body", split_run_together=False).drop("part_no")


@query("run_together", rf"""
WITH b AS (SELECT doc_id, {_plain_sql(_GLUED)} AS body FROM documents),
c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(body, '  +|\n\n+|\n'), lambda x: trim(x)),
    lambda x: x <> '') AS chunks FROM b),
l AS (SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS line_no FROM c),
p AS (SELECT *, list_transform(string_split(regexp_replace(chunk, '{tx.GLUED_VERB}', '\1' || chr(1) || '\2', 'g'), chr(1)),
    lambda x: trim(x)) AS parts FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, len(parts) AS parts, md5(array_to_string(parts, chr(10))) AS text_md5
FROM p WHERE len(parts) > 2 AND len(list_filter(parts, lambda x: length(x) <= 15)) = 0
  AND NOT regexp_matches(chunk, '^(?:[•\-\*]|\d+[.)]\s)\s*')""")
def run_together(spark, sf):
    glued = F.regexp_replace("text", r"\. (?:The|And|On) ", "Build ")
    rows = fx.texts(spark, sf).select("doc_id", glued.alias("body"))
    lines = unfold(rows, ["doc_id"], tx.numbered(tx.description_chunks(F.col("body")), "line_no", "chunk"), "line_no")
    cut = lines.filter(~F.col("chunk").rlike(f"(?U){tx.LIST_MARK}")).select(
        "doc_id", "line_no", tx.run_together_parts(F.col("chunk")).alias("parts"))
    return cut.filter(F.col("parts").isNotNull()).select(
        "doc_id", "line_no", F.size("parts").alias("parts"), F.md5(F.array_join("parts", "\n")).alias("text_md5"))


@query("typed_lines", rf"""
WITH b AS (SELECT doc_id, {_plain_sql(_GLUED)} AS body FROM documents),
c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(body, '  +|\n\n+|\n'), lambda x: trim(x)),
    lambda x: x <> '') AS chunks FROM b),
l AS (SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS line_no FROM c),
k AS (SELECT *, CASE WHEN regexp_matches(chunk, '^(?:[•\-\*]|\d+[.)]\s)\s*') THEN 'bullet'
    WHEN regexp_matches(chunk, '{_HEADER_SQL}') OR (length(chunk) < 60 AND chunk LIKE '%:')
      OR (length(chunk) < 50 AND chunk NOT LIKE '%.'
        AND NOT regexp_matches(chunk, '(?:^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}')
        AND NOT regexp_matches(chunk, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]\p{{Lu}}')) THEN 'header' ELSE 'text' END AS kind,
    list_transform(string_split(regexp_replace(chunk, '{tx.GLUED_VERB}', '\1' || chr(1) || '\2', 'g'), chr(1)),
      lambda x: trim(x)) AS parts FROM l),
g AS (SELECT *, kind = 'text' AND len(parts) > 2 AND len(list_filter(parts, lambda x: length(x) <= 15)) = 0 AS glued FROM k),
e AS (SELECT doc_id, line_no, CASE WHEN glued THEN 'bullet' ELSE kind END AS kind, CASE WHEN glued THEN parts ELSE [CASE kind
    WHEN 'bullet' THEN regexp_replace(chunk, '^(?:[•\-\*]|\d+[.)]\s)\s*', '')
    WHEN 'header' THEN regexp_replace(chunk, ':+$', '') ELSE chunk END] END AS parts FROM g)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS part_no, kind,
  unnest(parts) AS content FROM e""")
def typed_lines(spark, sf):
    glued = F.regexp_replace("text", r"\. (?:The|And|On) ", "Build ")
    rows = fx.texts(spark, sf).select("doc_id", glued.alias("body"))
    return tx.typed_lines(rows, "doc_id", "body")


_TAGGED = "replace(replace(replace(text, ' with ', ' cloud '), ' by ', ' bank ing '), ' en ', ' medical ')"


def _tags_sql() -> str:
    cases = ",\n    ".join(
        "CASE WHEN " + " OR ".join(f"low LIKE '%{word}%'" for word in words) + f" THEN '{name}' END"
        for name, words in tx.INDUSTRIES)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query("industry_tags", f"""
WITH t AS (SELECT doc_id, {_TAGGED} AS body, lower({_TAGGED}) AS low FROM documents)
SELECT doc_id, array_to_string({_tags_sql()}[1:2], ', ') AS industry,
  rtrim(split_part(body, '. ', 1), '.') || '.' AS known_for FROM t""")
def industry_tags(spark, sf):
    rows = fx.texts(spark, sf).selectExpr("doc_id", f"{_TAGGED} AS body")
    return rows.select("doc_id", tx.industry_tags(F.col("body")).alias("industry"),
                       tx.first_sentence(F.col("body")).alias("known_for"))


@query("company_keys", r"""
SELECT s_suppkey, lower(trim(s_name)) AS key, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') || '.com' AS website,
  'https://logo.clearbit.com/' || regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') || '.com' AS logo_url FROM supplier""")
def company_keys(spark, sf):
    name = F.col("s_name")
    return fx.table(spark, sf, "supplier").select(
        "s_suppkey", company_key(name).alias("key"), website(name).alias("website"), logo_url(name).alias("logo_url"))


# ---- pages ----------------------------------------------------------------------------------------

_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def _platform_sql() -> str:
    whens = [f"WHEN {' OR '.join(f'''host LIKE '%{part}%' ''' for part in parts)} THEN '{name}'"
             for name, parts in pg.PLATFORM_HOSTS]
    whens += [f"WHEN lower(substr(html, 1, 2000)) LIKE '%{name}%' THEN '{name}'" for name in pg.PLATFORM_MENTIONS]
    return f"CASE {' '.join(whens)} ELSE 'generic' END"


# Hosts and page starts vary by page, so that several platforms occur.
_URL = ("CASE page_id % 8 WHEN 0 THEN replace(url, 'example', 'greenhouse') WHEN 1 THEN replace(url, 'example', 'myworkday') "
        "WHEN 2 THEN replace(url, 'example.com', 'lever.co') ELSE url END")


@query("page_platform", f"""
WITH p AS (SELECT page_id, {_URL} AS url, replace(html, 'margin', 'clever') AS html FROM pages),
h AS (SELECT *, {_HOST} AS host FROM p)
SELECT page_id, host, {_platform_sql()} AS platform FROM h""")
def page_platform(spark, sf):
    rows = fx.pages(spark, sf).selectExpr(
        "page_id", f"{_URL} AS url", "replace(html, 'margin', 'clever') AS html")
    return rows.select("page_id", pg.host(F.col("url")).alias("host"),
                       pg.platform(F.col("url"), F.col("html")).alias("platform"))


_TITLED = ("CASE page_id % 7 WHEN 0 THEN replace(html, '<title>', '<title>Jobs at ') "
           "WHEN 1 THEN replace(html, '</title>', ' Careers | home</title>') "
           "WHEN 2 THEN replace(html, '</title>', ' - home</title>') "
           "WHEN 3 THEN replace(html, '</head>', '<meta property=\"og:site_name\" content=\" Site ' || url || '\"></head>') "
           "WHEN 4 THEN replace(html, '</head>', '<meta property=\"og:site_name\" content=\"Lowe''s &amp; Caf&eacute;&#233;\"></head>') "
           "WHEN 5 THEN replace(html, '<title>', '<title>AT&amp;T &ndash; M&uuml;ller&rsquo;s Jobs ') "
           "ELSE html END")


def _unescape_sql(text: str) -> str:
    for escape, plain in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "''"), ("&nbsp;?", "\u00a0"), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{escape}', '{plain}', 'g')"
    return text


def _named_sql(text: str) -> str:
    for escape, plain in (("&eacute;", "é"), ("&#233;", "é"), ("&ndash;", "–"), ("&uuml;", "ü"), ("&rsquo;", "’")):
        text = f"replace({text}, '{escape}', '{plain}')"
    return _unescape_sql(text)


_SITE_TAG = r"""regexp_extract(html, '(?i)(<meta\b[^>]*property=["'']og:site_name["''][^>]*>)', 1)"""
_SITE = f"""CASE WHEN regexp_matches({_SITE_TAG}, '(?i)content="') THEN regexp_extract({_SITE_TAG}, '(?i)content="([^"]*)"', 1)
    ELSE regexp_extract({_SITE_TAG}, '(?i)content=''([^'']*)''', 1) END"""
_PAGE_COMPANY_SQL = rf"""p AS (SELECT page_id, url, {{html}} AS html FROM pages),
t AS (SELECT *, {_HOST} AS host, trim({_named_sql(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title,
  trim({_named_sql(_SITE)}) AS site FROM p),
companies AS (SELECT page_id, coalesce(nullif(site, ''),
  {", ".join("nullif(trim(regexp_extract(title, '" + pattern + "', 1)), '')" for pattern in pg.TITLE_PATTERNS)},
  array_to_string(list_transform(regexp_extract_all(split_part(host, '.', 1), '[a-z]+|[^a-z]+'),
    lambda run: upper(run[1]) || run[2:]), '')) AS company FROM t)"""


@query("page_company", f"WITH {_PAGE_COMPANY_SQL.format(html=_TITLED)} SELECT page_id, company FROM companies")
def page_company(spark, sf):
    rows = fx.pages(spark, sf).selectExpr("page_id", "url", f"{_TITLED} AS html")
    return rows.select("page_id", pg.company_name(F.col("url"), F.col("html")).alias("company"))


_SKIP = "|".join(pg.SKIP_WORDS_LISTED)
_ORIGIN = r"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)', 1)"
_ITEMS = r"""items AS (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs,
    regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS titles FROM {source})"""
_LISTED = rf"""links AS (SELECT page_id, unnest(hrefs) AS href, unnest(titles) AS title, url,
    generate_subscripts(hrefs, 1) AS n FROM items WHERE len(hrefs) >= 3),
usable AS (SELECT *, {_ORIGIN} || href AS link_url, {_unescape_sql("trim(title)")} AS t FROM links),
listed AS (SELECT page_id, link_url, t AS title, n,
    CASE WHEN regexp_matches(t, '(?i)remote|hybrid|on-?site|(?:san|new|los|seattle|austin|chicago)')
      THEN substr(t, 1, 100) ELSE '' END AS location
  FROM usable WHERE length(t) BETWEEN 5 AND 200 AND NOT regexp_matches(lower(t), '{_SKIP}')
  QUALIFY row_number() OVER (PARTITION BY page_id, link_url ORDER BY n) = 1)"""


@query("page_links", f"""
WITH {_ITEMS.format(source="pages")}, {_LISTED}
SELECT page_id, link_url AS url, title, location FROM listed""")
def page_links(spark, sf):
    return unfold(pg.parsed_pages(fx.pages(spark, sf)), ["page_id"],
                  pg.listed_links(F.col("page"), F.col("base")), "url")


@query("page_keep_all", rf"""
WITH {_ITEMS.format(source="pages")}, {_LISTED},
flagged AS (SELECT *, regexp_matches(lower(title), 'tion|ing') AND lower(title) NOT LIKE '%er%' AS ok FROM listed)
SELECT page_id, link_url AS url, title FROM flagged
QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY page_id)""")
def page_keep_all(spark, sf):
    rules = Rules(target_role="tion|ing", exclude_titles=("er",))
    rows = pg.parsed_pages(fx.pages(spark, sf))
    rows = rows.select("page_id", pg.listed_links(F.col("page"), F.col("base")).alias("links"))
    return pg.matching_links(rows, rules).select("page_id", F.col("link_url").alias("url"), "title")


_VISIBLE = r"html"
for _tag in ("script", "style", "nav", "footer"):
    _VISIBLE = rf"regexp_replace({_VISIBLE}, '(?is)<{_tag}\b.*?</{_tag}>', '<>', 'g')"
_VISIBLE = rf"regexp_replace({_VISIBLE}, '(?s)<!--.*?-->', '<>', 'g')"
_VISIBLE = rf"regexp_replace({_VISIBLE}, '\s*(?:<[^>]*>\s*)+', chr(10), 'g')"
_VISIBLE = f"trim({_unescape_sql(_VISIBLE)}, ' ' || chr(10))"


@query("page_text", f"""
WITH t AS (SELECT page_id, {_VISIBLE} AS page_text FROM pages)
SELECT page_id, substr(page_text, 1, 15000) AS page_text FROM t WHERE length(page_text) >= 100""")
def page_text(spark, sf):
    rows = pg.parsed_pages(fx.pages(spark, sf)).select("page_id", pg.visible_text(F.col("page")).alias("page_text"))
    return filters.usable_page_text(rows)


@query("page_text_native", f"SELECT page_id, {_VISIBLE} AS page_text FROM pages")
def page_text_native(spark, sf):
    return fx.pages(spark, sf).select("page_id", pg.visible_text_native(F.col("html")).alias("page_text"))


_PAGE_DESCRIPTION_SQL = rf"""WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS article,
    regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?is)<script\b.*?</script>', '<>', 'g'),
      '(?s)<!--.*?-->', '<>', 'g') AS body FROM pages),
x AS (SELECT page_id, {_unescape_sql(r"regexp_replace(article, '\s*(?:<[^>]*>\s*)+', ' ', 'g')")} AS a,
    {_unescape_sql(r"regexp_replace(article, '\s*(?:<[^>]*>\s*)+', '', 'g')")} AS tight,
    {_unescape_sql(r"regexp_replace(body, '\s*(?:<[^>]*>\s*)+', ' ', 'g')")} AS b FROM t)
SELECT page_id, CASE WHEN length(trim(tight)) > 100 THEN trim(a)
  ELSE substr(trim(replace(replace(b, '&copy;', '©'), '&middot;', '·')), 1, 5000) END AS description FROM x"""


@query("page_description", _PAGE_DESCRIPTION_SQL)
def page_description(spark, sf):
    rows = pg.parsed_pages(fx.pages(spark, sf))
    return rows.select("page_id", pg.page_description(F.col("page")).alias("description"))


# Navigation links become posting links of one of the board layouts.
_BOARD = ("replace(replace(html, '<li><a href=\"/', '<li><span class=\"Job-Location\">Remote ' || page_id || '</span><a href=\"/jobs/'), "
          "'margin', '{name}')")


@query("board_links", rf"""
WITH items AS (SELECT page_id, {_ORIGIN} AS origin,
    regexp_extract_all(replace(html, '<li><a href="/', '<li><a href="/jobs/'), '<li><a href="([^"]*)">', 1) AS hrefs,
    regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS titles FROM pages),
links AS (SELECT page_id, origin, unnest(hrefs) AS href, unnest(titles) AS title, generate_subscripts(hrefs, 1) AS n FROM items),
kept AS (SELECT page_id, origin || href AS url, {_unescape_sql("trim(title)")} AS title, n FROM links)
SELECT page_id, 'greenhouse' AS platform, url, title, 'Remote ' || CAST(page_id AS VARCHAR) AS location
FROM kept WHERE length(title) > 3 QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY n) = 1""")
def board_links(spark, sf):
    rows = fx.pages(spark, sf).selectExpr("page_id", "url", f"{_BOARD.format(name='greenhouse')} AS html")
    return unfold(pg.posting_links(rows), ["page_id", "platform"], F.col("links"), "url")


@query("workplace_links", rf"""
WITH items AS (SELECT page_id, {_ORIGIN} AS origin,
    regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs,
    regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS titles FROM pages),
links AS (SELECT page_id, origin, unnest(hrefs) AS href, unnest(titles) AS title, generate_subscripts(hrefs, 1) AS n FROM items),
kept AS (SELECT page_id, origin || '/posting' || href AS url, {_unescape_sql("trim(title)")} AS title, n FROM links)
SELECT page_id, url, title, 'Hybrid ' || CAST(page_id AS VARCHAR) AS location
FROM kept WHERE length(title) > 3 QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY n) = 1""")
def workplace_links(spark, sf):
    rows = fx.pages(spark, sf).selectExpr(
        "page_id", "url", "replace(html, '<li><a href=\"/', '<li><b>Hybrid ' || page_id || '</b><a href=\"/posting/') AS html")
    links = pg.parsed_pages(rows)
    found = pg.first_per_url(pg.workplace_links(F.col("page"), F.col("base")))
    return unfold(links, ["page_id"], found, "url")


@query("block_links", rf"""
WITH items AS (SELECT page_id, {_ORIGIN} AS origin,
    regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs,
    regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS titles FROM pages),
links AS (SELECT page_id, origin, unnest(hrefs) AS href, unnest(titles) AS title, generate_subscripts(hrefs, 1) AS n FROM items),
kept AS (SELECT page_id, origin || href AS url, {_unescape_sql("trim(title)")} AS title FROM links)
SELECT page_id, url, title, 'Oslo' AS location FROM kept WHERE title <> ''""")
def block_links(spark, sf):
    rows = fx.pages(spark, sf).selectExpr(
        "page_id", "url", "replace(replace(html, '<li>', '<li class=\"posting\"><div class=\"posting-categories\">"
        "<i class=\"location\">Oslo</i></div>'), '<a href', '<a class=\"posting-title\" href') AS html")
    links = pg.parsed_pages(rows)
    return unfold(links, ["page_id"], pg.block_links(F.col("page"), F.col("base")), "url")


@query("card_links", rf"""
WITH items AS (SELECT page_id, {_ORIGIN} AS origin,
    regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs,
    regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS titles FROM pages),
links AS (SELECT page_id, origin, unnest(hrefs) AS href, unnest(titles) AS title, generate_subscripts(hrefs, 1) AS n FROM items),
kept AS (SELECT page_id, origin || '/careers' || href AS url, {_unescape_sql("trim(title)")} AS title, n FROM links)
SELECT page_id, url, title, 'Oslo' AS location FROM kept WHERE title <> ''
QUALIFY row_number() OVER (PARTITION BY page_id, title || url ORDER BY n) = 1""")
def card_links(spark, sf):
    rows = fx.pages(spark, sf).selectExpr(
        "page_id", "url", "replace(replace(html, '<li>', '<li role=\"listitem\"><span class=\"card-location\">Oslo</span>'), "
        "'<a href=\"/', '<a href=\"/careers/') AS html")
    links = pg.parsed_pages(rows)
    return unfold(links, ["page_id"], pg.card_links(F.col("page"), F.col("base")), "url")


@query("path_links", rf"""
WITH items AS (SELECT page_id, {_ORIGIN} AS origin,
    regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs,
    regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS titles FROM pages),
links AS (SELECT page_id, origin, unnest(hrefs) AS href, unnest(titles) AS title, generate_subscripts(hrefs, 1) AS n FROM items),
kept AS (SELECT page_id, origin || '/role' || href AS url, {_unescape_sql("trim(title)")} AS title, n FROM links)
SELECT page_id, url, title FROM kept
WHERE length(title) BETWEEN 5 AND 200 AND NOT regexp_matches(lower(title), '{"|".join(pg.SKIP_WORDS)}')
QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY n) = 1""")
def path_links(spark, sf):
    # Links outside of any list, so that only their path speaks for them.
    rows = fx.pages(spark, sf).selectExpr(
        "page_id", "url", "replace(replace(replace(html, '<li>', '<em>'), '</li>', '</em>'), '<a href=\"/', '<a href=\"/role/') AS html")
    links = pg.parsed_pages(rows)
    return unfold(links, ["page_id"], pg.generic_links(F.col("page"), F.col("base")), "url").drop("location")


_CAREERS = Rules(keywords=RULES.keywords, target_role="the|and|tion", exclude_titles=("ing",),
                 exclude_companies=("spam",), strong=9, match=5)
_CAREERS_SCORE = " + ".join([
    fx.points(fx.hit("low", f"the{fx._END}"), 3), fx.points(fx.hit("low", f"tion{fx._END}"), 2),
    fx.points(fx.hit("low", f"est{fx._END}"), 2), fx.points(fx.hit("low", f"{fx._START}er"), 1),
    fx.points(fx.hit("low", "token|password"), 2), fx.points(fx.hit("low", "license|copyright"), 2),
    fx.points("low LIKE '%rest%' AND low LIKE '%api%'", 2), fx.points(fx.hit("low", "backend|back-end"), 1),
    fx.points(fx.hit("low", "full-stack|fullstack|full stack"), 1), fx.LEVEL,
])


@query("careers_import", rf"""
WITH {_PAGE_COMPANY_SQL.format(html="html")},
texts AS ({_PAGE_DESCRIPTION_SQL}),
items AS (SELECT page_id, {_ORIGIN} AS origin,
    regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs,
    regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS titles FROM pages),
links AS (SELECT page_id, origin, unnest(hrefs) AS href, unnest(titles) AS title, generate_subscripts(hrefs, 1) AS n FROM items),
named AS (SELECT page_id, origin || '/jobs' || href AS url, {_unescape_sql("trim(title)")} AS title, n FROM links),
once AS (SELECT * FROM named WHERE length(title) > 3 QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY n) = 1),
flagged AS (SELECT *, regexp_matches(lower(title), 'the|and|tion') AND lower(title) NOT LIKE '%ing%' AS ok FROM once),
chosen AS (SELECT * FROM flagged QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY page_id)),
crawled AS (SELECT {_ORIGIN} || '/jobs/the' AS url, page_id FROM pages
  QUALIFY row_number() OVER (PARTITION BY {_ORIGIN} ORDER BY page_id) = 1),
found AS (SELECT c.page_id, c.n, c.url, c.title, k.company, lower(coalesce(t.description, '')) AS low
  FROM chosen c JOIN companies k ON k.page_id = c.page_id
  LEFT JOIN crawled w ON w.url = c.url LEFT JOIN texts t ON t.page_id = w.page_id
  WHERE lower(k.company) NOT LIKE '%spam%'),
scored AS (SELECT *, {_CAREERS_SCORE} AS score, substr(md5(url), 1, 12) AS id FROM found)
SELECT id, company, title, url AS job_link, 'Remote ' || CAST(page_id AS VARCHAR) AS location, score,
  CASE WHEN score >= 9 THEN 'Strong Match' WHEN score >= 5 THEN 'Match' ELSE 'Weak Match' END AS tier, '2026-03-27' AS import_date
FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY page_id, n) = 1""")
def careers_import(spark, sf):
    # Every page is a board; its links lead to pages of the same crawl.
    pages = fx.pages(spark, sf)
    boards = pages.selectExpr("page_id", "url", f"{_BOARD.format(name='greenhouse')} AS html")
    details = pages.selectExpr("page_id", "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/jobs/the' AS url", "html")
    stored = spark.createDataFrame([], "id string, job_link string")
    jobs = import_careers(boards, details, stored, _CAREERS, F.lit("2026-03-27").cast("date"))
    return jobs.select("id", "company", "title", "job_link", "location", "score", "tier", "import_date")
