"""Text, claim, page and instrument functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Claim patterns, matched without regard to case.
TOOLING_CLAIM = (r"volume\s+bot|boost(?:ing)?\s+(?:your\s+)?volume|volume\s+boost(?:ing|er)?|"
                 r"generat(?:e|ing|ion)\s+(?:trading\s+)?volume|wash\s+trad(?:e|ing)|buy\s+bot")
FEE_BUYBACK_CLAIM = (r"creator\s+fees.{0,100}(?:buy|buyback)|(?:auto|automat).{0,30}buyback|"
                     r"buyback.{0,30}(?:bot|automat)")
# Address and digest shapes.
ADDRESS = "^[1-9A-HJ-NP-Za-km-z]{32,44}$"
DIGEST = "^[0-9a-f]{64}$"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def tidy(c: Column, words: int = 25, limit: int = 240) -> Column:
    """Printable text with single spaces, its first ``words`` words, at most ``limit`` characters."""
    flat = F.regexp_replace(F.regexp_replace(c, SPACE, " "), r"\p{C}", "")
    flat = F.trim(F.regexp_replace(flat, " +", " "))
    return F.substring(F.array_join(F.slice(F.split(flat, " "), 1, words), " "), 1, limit)


def has_claim(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def claim_quote(c: Column, pattern: str, before: int = 40, after: int = 160) -> Column:
    """The first match with up to ``before`` and ``after`` characters around it; empty without a match."""
    hit = F.regexp_extract(c, f"(?i)({pattern})", 1)
    at = F.instr(c, hit)
    start = F.greatest(F.lit(1), at - before)
    return F.when(hit == "", "").otherwise(c.substr(start, at - start + F.length(hit) + after))


def is_address(c: Column) -> Column:
    return F.coalesce(c.rlike(ADDRESS), F.lit(False))


def is_digest(c: Column) -> Column:
    return F.coalesce(c.rlike(DIGEST), F.lit(False))


def public_url(c: Column) -> Column:
    """https with a host, no user part, default or 443 port, no blanks, at most 2048 characters."""
    shape = c.rlike(r"^https://[^/?#@:\s]+(:443)?([/?#][^\s]*)?$")
    host = F.regexp_extract(c, r"^https://([^/?#@:\s]+)", 1)
    return F.coalesce(shape & (F.length(c) <= 2048) & (host != "localhost") & ~host.endswith(".local"), F.lit(False))


def instrument(c: Column) -> Column:
    """``VENUE:PAIR[.P]`` as struct(venue, pair, kind); null when it has another shape."""
    u = F.upper(c)
    venue, pair = F.regexp_extract(u, r"^([^:]*):([^:]*)$", 1), F.regexp_extract(u, r"^([^:]*):([^:]*)$", 2)
    perp = pair.endswith(".P")
    base = F.regexp_replace(pair, r"\.P$", "")
    ok = u.rlike(r"^[^:]*:[^:]*$") & base.rlike("^[A-Z0-9]{2,40}$")
    return F.when(ok, F.struct(venue.alias("venue"), base.alias("pair"), F.when(perp, "perpetual").otherwise("spot").alias("kind")))


# What of a page is not shown, and the character references that are resolved.
HIDDEN = (r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<noscript\b.*?</noscript\s*>", r"(?s)<[^>]*>")
TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
META = r"""(?is)<meta\s(?:[^>"']|"[^"]*"|'[^']*')*>"""
DESCRIBES = r"""(?is)[\s"']name\s*=\s*["']?description["'\s/>]"""
CONTENT = r"""(?is)[\s"']content\s*=\s*(?:"([^"]*)"|'([^']*)')"""
NUMBERED = "&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))


def _letter(ref: Column) -> Column:
    """The character of a numeric reference, decimal or hexadecimal; that of & stays a reference until the last, so that nothing is resolved twice."""
    code = F.when(F.lower(F.substring(ref, 1, 1)) == "x", F.conv(F.substring(ref, 2, 7), 16, 10)).otherwise(ref).cast("long")
    real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(code == 38, "&amp;").when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def plain_text(c: Column) -> Column:
    """Character references resolved, numeric ones too, runs of white space as one space, trimmed."""
    refs = F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBERED), F.lit(1)))
    c = F.aggregate(refs, c, lambda text, r: F.replace(text, F.concat(F.lit("&#"), r, F.lit(";")), _letter(r)))
    for name, letter in REFERENCES:
        c = F.replace(c, F.lit(name), F.lit(letter))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def page_fields(c: Column) -> Column:
    """struct(title, description, visible) of an HTML page, by patterns alone.

    Comments, scripts, styles and noscript parts are taken out before the tags, so markup inside them is never
    seen; the title is part of the visible text. The description is the content of the last meta tag of that name, whatever the order of
    its attributes. A page without a title or description has empty ones. For the visible text a tag ends at its first >, even within quotes.
    """
    shown = page = F.coalesce(c, F.lit(""))
    for pattern in HIDDEN:
        shown = F.regexp_replace(shown, pattern, " ")
    tag = F.coalesce(F.try_element_at(F.filter(F.regexp_extract_all(page, F.lit(META), F.lit(0)), lambda t: t.rlike(DESCRIBES)), F.lit(-1)), F.lit(""))
    content = F.concat(F.regexp_extract(tag, CONTENT, 1), F.regexp_extract(tag, CONTENT, 2))
    return F.struct(plain_text(F.regexp_extract(page, TITLE, 1)).alias("title"), plain_text(content).alias("description"), plain_text(shown).alias("visible"))
