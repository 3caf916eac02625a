"""Expressions over descriptions: excerpts, typed lines, industry tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolescope.functions.words import contains_any, let, or_empty, strip, unfold

# Headings that open the relevant part of a description.
RELEVANT_HEADINGS = (
    r"what you'?ll do", r"what you'?ll work on", "what you will do", "your role", "the role",
    "responsibilities", "key responsibilities", "primary responsibilities", "core responsibilities",
    "requirements", "key requirements", "minimum requirements",
    "qualifications", "required qualifications", "minimum qualifications", "basic qualifications",
    "skills", "required skills", "technical skills", "tech stack",
    "who you are", "about the role", "about the team", "about this team", "team intro",
    "position description", "position summary", "job summary",
    r"what we'?re looking for", r"what you'?ll need", "what you bring",
    "in this role", r"as a .{5,30} you will",
    "day in the life", "a day in the life",
    "nice to have", "preferred qualifications",
)
# Headings that open boilerplate.
BOILERPLATE_HEADINGS = (
    "about us", "about the company", "who we are", "our mission",
    "benefits", "total rewards", "compensation", "salary range", "pay range", "pay transparency",
    "equal opportunity", "eeo ", "diversity", "accommodation",
    "privacy notice", "employee applicant", "disclaimer", "legal notice",
    "how to apply", "next steps", "interview process",
    "please note that", "note:",
)
# A line that is a section heading as a whole.
HEADER_LINE = (
    r"(?i)^(?:about (?:the |this )?(?:role|position|team|company|job|us|you)|"
    r"what you'?ll (?:do|bring|need|work on)|who you are|who we are|"
    r"(?:key |core |your )?responsibilities|"
    r"(?:minimum |preferred |basic |required |desired )?(?:qualifications|requirements|skills|experience)|"
    r"nice to have|bonus points|preferred skills|(?:what )?we (?:offer|provide|'re looking for)|"
    r"benefits(?: and perks)?|compensation|perks|why (?:join|work)|our (?:team|culture|mission)|"
    r"tech(?:nology)? stack|tools we use|job (?:description|details|summary|category)|"
    r"equal opportunity|eeo|diversity|"
    r"(?:location|pay|salary|base|total) (?:requirement|range|details)?|"
    r"how to apply|additional information|the (?:role|team|opportunity|impact)|"
    r"you(?:'ll| will) (?:have|be)|in this role)s?\s*:?\s*$"
)
# A list mark at the start of a line.
LIST_MARK = r"^(?:[•\-\*]|\d+[.)]\s)\s*"
# Verbs that open a bullet.
ACTION_VERBS = (
    "Design Build Develop Create Implement Ensure Collaborate Leverage Maintain Lead Drive Work Manage "
    "Write Test Deploy Configure Monitor Support Architect Define Integrate Evaluate Establish Own "
    "Partner Contribute Participate Apply Optimize Analyze Research Coordinate Deliver Provide Identify "
    "Review Conduct Troubleshoot Automate Mentor Scale Ship Debug Refactor Improve Reduce Increase "
    "Execute Perform Assist Help Communicate Report Document Plan Resolve Investigate Utilize Adopt Use "
    "Set Engage Serve Gather Operate Demonstrate Translate Navigate Enable Transform Propose Assess "
    "Craft Champion Facilitate Spearhead Streamline Oversee Prioritize"
).split()
# Industries in order, each with the substrings that name it.
INDUSTRIES = (
    ("technology", ("technology", "software", "tech", "computing", "saas", "cloud")),
    ("finance", ("financial", "banking", "finance", "investment", "insurance")),
    ("healthcare", ("health", "medical", "pharma", "biotech", "hospital")),
    ("e-commerce", ("e-commerce", "ecommerce", "retail", "marketplace", "shopping")),
    ("social media", ("social media", "social network")),
    ("automotive", ("automotive", "automobile", "car", "vehicle", "ev")),
    ("aerospace", ("aerospace", "space", "aviation", "defense")),
    ("consulting", ("consulting", "advisory", "professional services")),
    ("entertainment", ("entertainment", "media", "streaming", "gaming")),
    ("telecommunications", ("telecom", "telecommunications", "wireless")),
    ("energy", ("energy", "oil", "gas", "renewable", "solar")),
    ("food & beverage", ("food", "beverage", "restaurant")),
)

SHORT_EXCERPT = 800
PROMPT_EXCERPT = 2500

# (?d): a dot stops at \n only, (?U): Unicode classes.
_RELEVANT = f"(?id)({'|'.join(RELEVANT_HEADINGS)})"
_BOILERPLATE = f"(?i)({'|'.join(BOILERPLATE_HEADINGS)})"


def _may_have_heading(body: Column) -> Column:
    """False only where no heading can match. Substring tests cost far less than the heading regex, which
    would otherwise be tried at every position of a text without headings."""
    words = [heading.replace("'?", mark) for heading in RELEVANT_HEADINGS if "{" not in heading
             for mark in (("'", "") if "'?" in heading else ("",))]
    def test(low: Column) -> Column:
        return contains_any(low, words) | (
            low.contains("as a ") & low.contains(" you will"))
    return let(F.lower(body), test)


def _place(body: Column, pattern: str) -> Column:
    """The first match's place, from 1 and in characters (regexp_instr counts UTF-16 units); 0 without one."""
    return let(F.split(body, pattern, 2), lambda parts: F.when(
        F.size(parts) > 1, F.length(parts[0]) + 1).otherwise(0))


def _from_heading(body: Column, heading: Column) -> Column:
    """Text from the heading on, cut at the first boilerplate heading if that is not too near."""
    def cut(text: Column) -> Column:
        return let(_place(text, _BOILERPLATE) - 1, lambda at: F.when(
            at > 100, F.substr(text, F.lit(1), at)).otherwise(text))
    return let(F.substr(body, heading), cut)


def _after_introduction(body: Column) -> Column:
    """Without headings: skip at most a third of the text, on to a sentence end if one is near."""
    def cut(start: Column) -> Column:
        boundary = F.call_function("locate", F.lit(".  "), body, start + 1) - 1
        return let(boundary, lambda at: F.substr(body, F.when(
            (at > 0) & (at < start + 200), at + 4).otherwise(start + 1)))
    return let(F.least(F.floor(F.length(body) / 3).cast("int"), F.lit(500)), cut)


def excerpt(text: Column, limit: int) -> Column:
    """The relevant part of a description, cut at a blank near ``limit`` characters."""
    def relevant(body: Column) -> Column:
        heading = F.when(_may_have_heading(body), _place(body, _RELEVANT)).otherwise(0)
        return let(heading, lambda at: F.when(at > 0, _from_heading(body, at)).otherwise(_after_introduction(body)))

    def shorten(tidy: Column) -> Column:
        short = F.regexp_replace(F.substring(tidy, 1, limit), r" [^ ]*$", "")
        return F.when(F.length(tidy) > limit, F.concat(short, F.lit("..."))).otherwise(tidy)
    tidy = strip(F.regexp_replace(let(or_empty(text), relevant), r"(?U)\s{2,}", "  "))
    return let(tidy, shorten)


def is_title_case(text: Column) -> Column:
    """Every word starts upper case and goes on lower case, as far as its letters have case."""
    lower_start = text.rlike(r"(?:^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")
    upper_inside = text.rlike(r"[\p{Lu}\p{Ll}\p{Lt}]\p{Lu}")
    return ~lower_start & ~upper_inside


def description_chunks(text: Column) -> Column:
    """A description split at double blanks and line ends, markdown marks taken out."""
    plain = F.translate(text, "‘’“”", "''\"\"")
    plain = F.regexp_replace(plain, r"(?mdU)^#{1,4}\s+(.+)$", "$1")
    plain = F.regexp_replace(plain, r"(?mdU)^\*{1,2}([^*\n]+)\*{1,2}\s*$", "$1")
    plain = F.regexp_replace(plain, r"\*\*([^*]+)\*\*", "<b>$1</b>")
    plain = F.regexp_replace(plain, r"\*([^*]+)\*", "<i>$1</i>")
    parts = F.split(strip(plain), r"  +|\n\n+|\n")
    return F.filter(F.transform(parts, strip), lambda part: part != "")


# A character that no description carries marks the cuts.
CUT = "\u0001"
GLUED_VERB = rf"([a-zA-Z)])((?:{'|'.join(ACTION_VERBS)}) )"


def run_together_parts(chunk: Column) -> Column:
    """Bullets glued into one line, cut before each action verb; null where the line is no such list."""
    def parts_of(marked: Column) -> Column:
        return let(F.transform(F.split(marked, CUT), strip), lambda parts: F.when(
            (F.size(parts) > 2) & F.forall(parts, lambda part: F.length(part) > 15), parts))
    marked = F.regexp_replace(chunk, GLUED_VERB, f"$1{CUT}$2")
    # Most lines have no letter right before a capital, which is the cheaper test.
    return F.when(chunk.rlike(r"[a-zA-Z)][A-Z][a-z]"), let(marked, parts_of))


def numbered(items: Column, number: str, item: str) -> Column:
    return F.transform(items, lambda value, at: F.struct(at.alias(number), value.alias(item)))


def typed_lines(df: DataFrame, key: str, text: str, split_run_together: bool = True) -> DataFrame:
    """Rows (key, line_no, part_no, kind, content); kind is bullet, header or text.

    Every step stays inside the row, so a long description never meets a shuffle.
    """
    chunk = F.col("chunk")
    length = F.length(chunk)
    is_bullet = chunk.rlike(f"(?U){LIST_MARK}")
    is_header = (
        chunk.rlike(f"(?U){HEADER_LINE}")
        | ((length < 60) & chunk.endswith(":"))
        | ((length < 50) & is_title_case(chunk) & ~chunk.endswith("."))
    )
    kind = F.when(is_bullet, "bullet").when(is_header, "header").otherwise("text")
    lines = (
        unfold(df, [key], numbered(description_chunks(F.col(text)), "line_no", "chunk"), "line_no")
        .withColumn("kind", kind)
    )
    content = (
        F.when(F.col("kind") == "bullet", F.regexp_replace(chunk, f"(?U){LIST_MARK}", ""))
        .when(F.col("kind") == "header", F.regexp_replace(chunk, ":+$", ""))
        .otherwise(chunk)
    )
    if not split_run_together:
        return lines.select(key, "line_no", F.lit(0).alias("part_no"), "kind", content.alias("content"))
    parts = F.when(F.col("kind") == "text", run_together_parts(chunk))
    split = (
        lines.withColumn("parts", parts)
        .withColumn("kind", F.when(F.col("parts").isNotNull(), "bullet").otherwise(F.col("kind")))
    )
    pieces = numbered(F.coalesce("parts", F.array(content)), "part_no", "content")
    return unfold(split, [key, "line_no", "kind"], pieces, "part_no").select(
        key, "line_no", "part_no", "kind", "content")


def industry_tags(text: Column) -> Column:
    """The first two industries the text names, in list order, joined by a comma."""
    def named(low: Column) -> Column:
        return F.array(*[F.when(contains_any(low, words), F.lit(name)) for name, words in INDUSTRIES])
    tags = F.array_compact(let(F.lower(or_empty(text)), named))
    return F.array_join(F.slice(tags, 1, 2), ", ")


def first_sentence(text: Column) -> Column:
    """Text up to the first full stop followed by a blank, with exactly one full stop at its end."""
    sentence = F.regexp_replace(F.element_at(F.split(text, r"\. "), 1), r"\.+$", "")
    return F.when(or_empty(text) != "", F.concat(sentence, F.lit("."))).otherwise(F.lit(""))

