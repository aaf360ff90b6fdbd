"""Text functions as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a text that is really a system prompt begins.
PROMPT_STARTS = (
    "you are ", "you must ", "you should ", "you will ", "act as ", "speak in ", "respond in ", "base your communication",
    "you write ", "your role is", "as a ",
)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, where `value` is an expression that stands in the body several times: it is built and evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, lowercase hex; null stays null."""
    return F.sha2(text, 256)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one for a text that has any; null or empty: 0."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def prompt_tokens(texts: Column, *more: Column) -> Column:
    """A quarter of the characters of an array of texts and of further texts (names, arguments, tools) together, at least 1."""
    inside = F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.length(x), F.lit(0)))
    total = reduce(lambda a, b: a + F.coalesce(F.length(b), F.lit(0)), more, inside)
    return F.greatest(F.lit(1), F.floor(total / 4)).cast("long")


def looks_like_system_prompt(text: Column) -> Column:
    """Whether the collapsed, lower-cased first 120 characters begin like a system prompt; an empty text does."""
    head = F.lower(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 120))
    begins = reduce(lambda a, b: a | b, [head.startswith(p) for p in PROMPT_STARTS])
    return F.when(F.coalesce(text, F.lit("")) == "", True).otherwise(begins)


def scrub(text: Column, names: tuple[str, ...] = ()) -> Column:
    """Unwraps Markdown emphasis and code, redacts known names and snake_case identifiers, collapses blanks."""
    # Fixed patterns: what counts as emphasis and code.
    for pattern in (r"\*\*([^*]+?)\*\*", r"\b_([^_]+?)_\b", r"(?<!\*)\*([^*]+?)\*(?!\*)", r"`([^`]+?)`"):
        text = F.regexp_replace(text, pattern, "$1")
    for name in sorted({n for n in names if n}, key=lambda n: (-len(n), n)):
        text = F.regexp_replace(text, r"(?i)\b\Q" + name + r"\E\b", "[…]")
    text = F.regexp_replace(text, r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", "[…]")
    return F.regexp_replace(F.regexp_replace(text, r" {2,}", " "), r"(?U)^\s+|\s+$", "")


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """Fills `{{name}}` and `{{a.b}}`: lists are joined by a comma and a blank, unknown names become empty."""
    # Markers keep inserted values from being taken for templates.
    parts = F.split(template, r"\{\{\s*|\s*\}\}", -1)

    def fill(part: Column, i: Column) -> Column:
        value = F.lit("")
        for name, column in values.items():
            value = F.when(part == name, F.coalesce(column.cast("string"), F.lit(""))).otherwise(value)
        return F.when(i % 2 == 0, part).otherwise(value)

    return F.array_join(F.transform(parts, fill), "")


def tidy(text: Column) -> Column:
    """Line ends to \\n, no blanks before them, no more than one empty line, trimmed."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def truncate(text: Column, limit: int = 50_000, marker: str = "\n\n[truncated]") -> Column:
    """A struct (text, truncated)."""
    long = F.length(text) > limit
    return F.struct(F.when(long, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text).alias("text"), F.coalesce(long, F.lit(False)).alias("truncated"))


def html_title(html: Column) -> Column:
    """The first title's text with single blanks; empty where there is none."""
    # Fixed pattern: what counts as a title.
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(title, r"\s+", " "))


def html_text(html: Column) -> Column:
    """Text without scripts, styles, navigation, footers and images; block elements end lines.

    An element that is left out ends at the first closing tag of its name; of character references the six below are resolved.
    """
    for tag in ("script", "style", "nav", "footer", "head"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    html = F.regexp_replace(html, r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/section|/article)\b[^>]*>", "\n")
    html = F.regexp_replace(html, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    return tidy(F.regexp_replace(html, r"[ \t]+", " "))


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, without its `.` and `..` steps."""
    steps = F.split(F.substring(path, 2, 1 << 20), "/", -1)
    last = F.element_at(steps, -1)
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolve_link(link: Column, base: Column) -> Column:
    """A link as an absolute http(s) address, relative to its page's; null for other schemes. Fragments and default ports go."""
    link = F.regexp_replace(F.trim(link), r"#.*$", "")
    scheme, origin = F.regexp_extract(base, r"^(https?:)", 1), F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    page = F.regexp_extract(base, r"^https?://[^/?#]+(/[^?#]*)", 1)
    page = F.when(page == "", "/").otherwise(page)
    whole = (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, page, link))
        .when(link == "", F.concat(origin, page))
        .otherwise(F.concat(origin, F.regexp_extract(page, r"^(.*/)", 1), link))
    )
    head = F.regexp_extract(whole, r"(?i)^(https?://[^/?#]+)", 1)
    head = F.regexp_replace(F.regexp_replace(F.lower(head), r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path, asked = F.regexp_extract(whole, r"(?i)^https?://[^/?#]+([^?]*)", 1), F.regexp_extract(whole, r"(\?.*)$", 1)
    return F.when(head != "", F.concat(head, F.when(path == "", "/").otherwise(_without_dots(path)), asked))


def html_links(html: Column, base: Column) -> Column:
    """Distinct absolute http(s) links of the anchors, without fragments, resolved against the page's address, in order.

    Links count in quotes only, and only without a `#`; null html has none.
    """
    anchors = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\b([^>]*)>"), F.lit(1))
    # Fixed pattern: how a link has to be written.
    value = lambda x: F.regexp_extract(x, r"""(?i)\bhref\s*=\s*["']([^"'#]+)["']""", 1)
    found = F.filter(F.transform(anchors, value), lambda x: x != "")
    return F.array_distinct(F.filter(F.transform(found, lambda x: resolve_link(x, base)), F.isnotnull))


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*\z"), F.lit(False))


def last_integer(text: Column, low: int, high: int) -> Column:
    """The last run of digits in a text if it lies in the range, else null."""
    value = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("long")
    return F.when(value.between(low, high), value)


def transcript(messages: Column) -> Column:
    """`[ROLE] content` of an ordered array of (role, content), with empty lines between."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("] "), F.coalesce(m["content"], F.lit("")))), "\n\n")


def clean_arguments(text: Column) -> Column:
    """JSON arguments with control characters other than line ends as blanks; {} where that is no object."""
    cleaned = F.regexp_replace(text, r"[\x00-\x09\x0B\x0C\x0E-\x1F]", " ")
    parsed = F.try_parse_json(cleaned)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), cleaned).otherwise("{}")


# Verbs and stages that make a function a risk.
SENSITIVE_VERBS = (
    "apply", "approve", "execute", "run", "create", "update", "delete", "cancel", "refund", "waive", "reset", "issue",
    "transfer", "escalate", "grant", "revoke", "disable", "enable", "override", "submit", "confirm", "process",
    "initiate", "pay", "adjust", "modify", "remove", "assign", "close", "terminate", "suspend", "activate", "deploy",
    "rollback", "settle", "provision", "decommission", "release", "push", "send", "set", "add", "link", "restore",
    "retry", "topup", "book", "reserve", "swap", "publish", "enforce", "commit", "amend",
)
SENSITIVE_STAGES = (
    "approve", "approval", "execute", "escalate", "bulk", "delete", "cancel", "payment", "billing", "provision",
    "deploy", "rollback", "terminate", "settle", "remediation", "recover", "recovery", "execution", "change_execute",
    "decommission", "enforcement", "activation",
)
EXPORT_VERBS = (
    "export", "bulk", "list", "search", "download", "dump", "stream",
)
EXPORT_STAGES = (
    "export", "bulk", "report", "reporting", "snapshot", "audit", "search_reporting",
)


def risk_class(name: Column, stage: Column) -> Column:
    """sensitive, exfil or safe, by a function's first word and its stage."""
    verb = F.lower(F.split_part(F.coalesce(name, F.lit("")), F.lit("_"), F.lit(1)))
    stage = F.lower(F.coalesce(stage, F.lit("")))
    return F.when(verb.isin(*SENSITIVE_VERBS) | stage.isin(*SENSITIVE_STAGES), "sensitive").when(verb.isin(*EXPORT_VERBS) | stage.isin(*EXPORT_STAGES), "exfil").otherwise("safe")


def usage_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Dollars at prices per million tokens; an unknown price is 0."""
    zero = F.lit(0.0)
    return (tokens_in * F.coalesce(rate_in, zero) + tokens_out * F.coalesce(rate_out, zero)) / 1e6


def is_transient_error(status: Column, message: Column, markers: tuple[str, ...] = ("timeout", "timed out", "connection reset", "overloaded", "temporarily unavailable")) -> Column:
    """Whether a provider's failure is worth a retry, by its status code or, without one, by its message."""
    by_text = F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(markers))
    return F.when(status.isNotNull(), status.isin(408, 429, 500, 502, 503, 504)).otherwise(by_text)


def style_guide(register: Column, primary: Column, formal_malay: Column, particles: Column, loanwords: Column, allowed: Column) -> Column:
    """The sentences that tell a model how to write, from a language profile; sentences that do not apply are left out."""
    formal_ms = (register == "formal") & (primary == "ms")
    foreign = primary != "en"
    # The sentences themselves.
    return F.concat_ws(
        " ",
        F.when(formal_ms, "Respond in Formal Malay.")
        .when((register == "formal") & (primary == "en"), "Respond in formal English appropriate for enterprise customer support.")
        .when(register == "formal", "Respond in a formal register.")
        .when(register == "semi-formal", "Respond in a polite, professional tone with light contractions allowed.")
        .when(register == "colloquial", "Respond in a casual, conversational Malaysian register."),
        F.when(formal_ms & formal_malay, "Use full standard spelling (e.g. 'tidak' not 'tak', 'sahaja' not 'je', 'sudah' not 'dah'). Do not use SMS shortcuts."),
        F.when(~particles, "Do not use Manglish/Bahasa Rojak particles such as 'lah', 'lor', 'meh', 'kan', 'kot', 'wei', 'doh', 'eh', 'ah', 'ke', 'leh', 'mah'."),
        F.when((loanwords == "forbid") & foreign, "Do not use English loanwords. Translate all technical terms.")
        .when((loanwords == "allowlist") & foreign & (F.size(allowed) > 0), F.concat(F.lit("Only the following English loanwords are permitted: "), F.array_join(allowed, ", "), F.lit(". Avoid other English words.")))
        .when((loanwords == "allowlist") & foreign, "Avoid English loanwords unless strictly necessary for technical accuracy."),
    )
