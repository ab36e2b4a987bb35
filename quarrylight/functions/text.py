"""Text functions: e-mail addresses, keyword tests, drawing and comment scoring, keys and escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight import rules
from quarrylight.functions.match import collapse, contains_any, keywords, let, literal, strip

__all__ = ["collapse", "strip"]


def emails(text: Column) -> Column:
    """Distinct addresses in lower case, sorted; names of files that look like addresses left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(rules.EMAIL), F.lit(0)), F.lower)
    return F.array_sort(F.array_distinct(F.filter(found, lambda e: ~F.substring_index(e, ".", -1).isin(*rules.FILE_EXT_FALSE_POSITIVES))))


def looks_like_code(text: Column) -> Column:
    """Markup or script that was commented out."""
    return text.rlike(r"<\w+[\s/>]") | text.contains("</") | text.rlike(r"\b(?:var|function|const|let)\b|=>|\)\s*;|\{\s*\}|\$\(")


def ascii_art(text: Column) -> Column:
    """A known face, or three lines and 45 % of all lines with 40 % drawing characters; markup never."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.trim(x) != "")
    art = "[" + "".join(map(literal, rules.ART_CHARS)) + "]"

    def artish(line: Column) -> Column:
        return let(strip(line), lambda core: (F.length(core) >= 4) & ((F.length(core) - F.length(F.regexp_replace(core, art, ""))) >= F.length(core) * 0.4))

    def drawn(own: Column) -> Column:
        n = F.size(own)
        return F.when(n < 3, F.lit(False)).otherwise(let(F.size(F.filter(own, artish)), lambda k: (k >= 3) & (k >= n * 0.45)))

    return contains_any(F.lower(text), rules.KAOMOJI) | (~text.rlike(r"</?\w+[\s/>]") & let(lines, drawn))


def keyword_count(low: Column, words) -> Column:
    """Occurrences of whole words or phrases in a lower-cased text, from the left, not overlapping."""
    return F.size(F.regexp_extract_all(low, F.lit(keywords(words)), F.lit(0)))


def has_emoji(text: Column) -> Column:
    return text.rlike(rules.EMOJI)


def has_emoticon(collapsed: Column) -> Column:
    return F.concat(F.lit(" "), collapsed, F.lit(" ")).rlike(rules.EMOTICON)


def classify_comment(raw: Column) -> Column:
    """STRUCT<kind, score, tags> of a comment worth keeping, else NULL.

    Drawings count before any filter. Then machine output is dropped, and what is left is scored
    by signals (5), turns of phrase (up to 6 and 2), faces (3), punctuation (up to 2) and the first
    person (1); 3 is enough.
    """
    none = F.array().cast("array<string>")
    make = lambda kind, n, t: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("score"), t.alias("tags"))

    def scored(text: Column, flat: Column, low: Column) -> Column:
        tags = F.filter(F.array(*(F.when(low.rlike(keywords(words)), F.lit(tag)) for tag, words in rules.STRONG_SIGNALS.items())), lambda t: t.isNotNull())
        parts = F.struct(tags.alias("tags"), keyword_count(low, rules.STRONG_DEV).alias("strong"), (has_emoticon(flat) | has_emoji(text)).alias("face"))

        def verdict(p: Column) -> Column:
            score = (F.when(F.size(p["tags"]) > 0, 5).otherwise(0) + F.least(p["strong"] * 3, F.lit(6)) + F.least(keyword_count(low, rules.WEAK_DEV), F.lit(2)) + F.when(p["face"], 3).otherwise(0)
                     + F.when(text.rlike(r"\?!|!\?|\?\?|!!"), 2).when(text.contains("!"), 1).otherwise(0) + F.when(low.rlike(r"\b(?:i|i'm|im|my|me|myself)\b"), 1).otherwise(0))
            every = F.concat(p["tags"], F.when(p["strong"] > 0, F.array(F.lit("dev-voice"))).otherwise(none), F.when(p["face"], F.array(F.lit("emoticon"))).otherwise(none))
            every = F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("note")))
            return let(score, lambda n: F.when(n >= rules.KEEP_THRESHOLD, make("html_comment", n, every)))

        return let(parts, verdict)

    def kept(text: Column, flat: Column, low: Column) -> Column:
        dropped = (F.length(low) < 10) | contains_any(low, rules.HARD_SKIP) | looks_like_code(text) | low.rlike(rules.LIBRARY_BANNER)
        return F.when(~dropped, scored(text, flat, low))

    return F.when(ascii_art(raw), make("ascii_art", F.lit(6), F.array(F.lit("ascii-art")))).otherwise(
        let(strip(raw), lambda text: let(collapse(text), lambda flat: let(F.lower(flat), lambda low: kept(text, flat, low)))))


def kept_comment(raw: Column) -> Column:
    """Columns kind, score and tags of the comments worth keeping, as a generator: judged once, where a test of the struct for NULL would judge again."""
    return F.inline(F.array_compact(F.array(classify_comment(raw))))


def find_key(kind: Column, text: Column, domain: Column) -> Column:
    """Identity of a find: kind and the first 300 characters of its text, or the domain for humans.txt."""
    return F.concat(kind, F.lit("\x00"), F.when(kind == "humans_txt", domain).otherwise(F.substring(F.lower(collapse(text)), 1, 300)))


def escape(text: Column, quotes: bool = True) -> Column:
    """HTML-escaped; with ``quotes``, both kinds of quotation marks too."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def body_signature(text: Column, url: Column) -> Column:
    """SHA-1 of a body in which the address's own path plays no part: equal for equal not-found pages."""
    from quarrylight.functions import urls

    p = F.lower(urls.path(url))
    out = F.lower(F.coalesce(text, F.lit("")))
    for needle in (p, F.substring_index(p, "/", -1)):
        out = F.when(F.length(needle) >= 3, F.replace(out, needle, F.lit(""))).otherwise(out)
    return F.sha1(F.substring(collapse(out), 1, 20000))


def console_message(message: Column) -> Column:
    """A console message worth keeping, without its format marks, else NULL."""
    built = message.rlike(r"\$\{|' \+|\" \+|`\+")

    def keep(clean: Column, low: Column) -> Column:
        greeting = message.contains("%c") & low.rlike(r"[a-z]{3,}\s+[a-z]{3,}") & contains_any(low, rules.CONSOLE_GREETINGS)
        return (F.length(clean) >= 8) & ~built & ~contains_any(low, rules.CONSOLE_NOISE) & (contains_any(low, rules.CONSOLE_EGG_WORDS) | has_emoji(clean) | greeting)

    return let(strip(F.regexp_replace(message, "%[a-z]", "")), lambda clean: F.when(let(F.lower(clean), lambda low: keep(clean, low)), clean))


def console_messages(script: Column) -> Column:
    """Quoted first arguments of console calls in a script."""
    return F.regexp_extract_all(script, F.lit(r"(?s)console\.(?:log|info|warn|error)\s*\(\s*(['\"`])(.*?)\1"), F.lit(2))


def html_comments(html: Column) -> Column:
    """Comments of raw source, in scripts too."""
    return F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))


def severity(category: Column) -> Column:
    base = F.substring_index(category, " (", 1)
    return F.when(base.isin(*rules.CRITICAL_CATEGORIES), "critical").when(base.isin(*rules.WARNING_CATEGORIES), "warning").otherwise("none")
