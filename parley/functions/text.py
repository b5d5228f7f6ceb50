"""Text expressions.  All of them are Column expressions evaluated in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Query characters that need a backslash.
QUERY_CHARS = r'[\\+\-!():^\[\]"{}~*?|&;/\s]'
# Fixed value: web address pattern, matched without case.
URL_PATTERN = r"(?i)\b(?:https?|ftp)://(?:-\.)?(?:[^\s/?\.#-]+\.?)+(?:/[^\s]*)?"
# Fixed value: punctuation at the ends of a token.
EDGE_PUNCTUATION = r"""(^[,;"'´`]+)|([!?.,;"'´`]+$)"""
CODE_FENCE = r"\s*`{3,}\s*"


def _folding() -> tuple[str, str]:
    """Accented Latin letters (Latin-1 to Extended-B) and the plain letter each decomposes to."""
    accented, plain = [], []
    for code in range(0x00C0, 0x0250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _folding()
# Letters without a decomposition.
LIGATURES = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D",
             "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ı": "i"}


def is_blank(text: Column) -> Column:
    """Null or only white space."""
    return text.isNull() | ~text.rlike(r"\S")


def has_letter_or_digit(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{L}\p{Nd}]"), F.lit(False))


def is_all_upper(text: Column) -> Column:
    """At least one letter and no letter that is not upper case."""
    return F.coalesce(text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]"), F.lit(False))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, even where ``use`` refers to it from inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_code_blocks(text: Column) -> Column:
    """Drop fenced code; close the sentence before a fence and separate what follows by a blank line."""

    def join(split: Column) -> Column:
        parts, last, begin = split["parts"], F.size(split["parts"]) - 1, split["begin"]

        def piece(part: Column, i: Column) -> Column:
            stop = F.when((i < last) & part.rlike(r"\p{IsAlphabetic}\z"), F.lit(".")).otherwise(F.lit(""))
            gap = F.when((i < last) & (i > begin), F.lit("\n\n")).otherwise(F.lit(""))
            return F.when(i % 2 == 0, F.concat(part, stop)).otherwise(gap)

        return F.array_join(F.transform(parts, piece), "")

    def begins(parts: Column) -> Column:
        # position of the first text outside code
        texts = F.transform(parts, lambda part, i: F.when((i % 2 == 0) & (part != ""), i))
        return F.struct(parts.alias("parts"), F.array_min(texts).alias("begin"))

    stripped = bind(bind(F.split(text, CODE_FENCE, -1), begins), join)
    return F.when(is_blank(text) | ~text.contains("```"), text).otherwise(stripped)


def strip_html(text: Column) -> Column:
    """Remove scripts, styles, comments and tags, then decode the basic entities."""
    out = F.regexp_replace(text, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)</?[a-zA-Z!][^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                         ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.when(text.rlike("[<&]"), out).otherwise(text)


def strip_punct(token: Column) -> Column:
    return F.regexp_replace(token, EDGE_PUNCTUATION, "")


def fold_accents(text: Column) -> Column:
    """Accented letters to their base letter, one character each."""
    return F.translate(text, ACCENTED, PLAIN)


def ascii_fold(text: Column) -> Column:
    out = fold_accents(text)
    for letter, plain in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.when(text.rlike(r"[^\x00-\x7f]"), out).otherwise(text)


def word_delimit(token: Column, split_case: bool = True, split_numbers: bool = True, catenate: bool = True,
                 possessive: bool = False, keep_original: bool = True) -> Column:
    """Variants of a white-space token: itself, its parts, and the parts joined again.

    Parts break at characters that are neither letter nor digit, with ``split_case`` between a lower and an upper case
    letter, and with ``split_numbers`` between letters and digits.
    """
    base = F.regexp_replace(token, r"['’][sS]$", "") if possessive else token
    lower = r"[\p{Ll}\p{Lo}\p{Lt}\p{Lm}]"
    if split_case and split_numbers:
        pattern = rf"\p{{Lu}}+{lower}*|{lower}+|\p{{N}}+"
    elif split_numbers:
        pattern = r"\p{L}+|\p{N}+"
    else:
        pattern = r"[\p{L}\p{N}]+"
    variants = [F.array(token)] if keep_original else []
    variants.append(F.regexp_extract_all(base, F.lit(pattern), F.lit(0)))
    if catenate:
        joined = F.regexp_replace(base, r"[^\p{L}\p{N}]", "")
        variants.append(F.regexp_extract_all(joined, F.lit(r"\p{L}+|\p{N}+"), F.lit(0)))
        variants.append(F.array(joined))
    simple = token.rlike(r"^(?:\p{Lu}?[\p{Ll}\p{Lo}]+|\p{Lu}+|\p{N}+)$")
    return F.when(simple, F.array(token)).otherwise(
        F.filter(F.array_distinct(F.concat(*variants)), lambda v: v != ""))


def escape_query(text: Column) -> Column:
    return F.regexp_replace(text, f"({QUERY_CHARS})", r"\\$1")


def search_tokens(text: Column) -> Column:
    """White-space tokens of a search text that contain a letter or digit."""
    return F.filter(F.split(text, r"\s+"), lambda t: has_letter_or_digit(t))


def search_word_terms(text: Column) -> Column:
    """Clauses of a search text: exact (boost 4), prefix (2) and infix (1) per token."""

    def clauses(token: Column) -> Column:
        numeric = token.rlike(r"^\p{Nd}+$")
        exact = F.struct(token.alias("term"), F.lit("exact").alias("mode"), F.lit(4).alias("boost"))
        prefix = F.struct(token.alias("term"), F.lit("prefix").alias("mode"), F.lit(2).alias("boost"))
        infix = F.struct(token.alias("term"), F.lit("infix").alias("mode"), F.lit(1).alias("boost"))
        none = F.filter(F.array(exact), lambda c: F.lit(False))
        return F.concat(
            F.array(exact),
            F.when(~numeric & token.rlike(r"[\p{L}\p{Nd}]$"), F.array(prefix)).otherwise(none),
            F.when(~numeric & token.rlike(r"^[\p{L}\p{Nd}]+$"), F.array(infix)).otherwise(none))

    return F.flatten(F.transform(search_tokens(text), clauses))


def search_word_query(text: Column) -> Column:
    """The clauses as one query string; null for a blank text, escaped whole when it has no letter or digit.

    The clauses are those of ``search_word_terms``, made for all tokens of the text at once.  Every token gets one space
    before it and no other white space is left, so a tab parts the clauses of a token that is done.
    """
    # as for $, one separator of lines may follow the last letter or digit
    plain, last, end = r"[\p{L}\p{Nd}]", r"[\x85\u2028\u2029]?+", r"(?![^ ])"
    word = rf" (?!\p{{Nd}}++{last}{end})"  # begins a token that is not a number
    out = F.regexp_replace(F.concat(F.lit(" "), text), r"(?: ?[\t\n\x0B\f\r]| {2})\s*+", " ")
    out = F.regexp_replace(out, rf" [^ \p{{L}}\p{{Nd}}]++{end}", "")
    out = F.regexp_replace(out, f"({QUERY_CHARS.replace(r'\s', '')})", r"\\$1")
    out = F.regexp_replace(out, rf"{word}({plain}++{last}){end}", " $1^4\t$1*^2\t*$1*")
    out = F.regexp_replace(out, rf"{word}([^ \t]*{plain}{last}){end}", " $1^4\t$1*^2")
    out = F.regexp_replace(out, rf" ([^ \t]++){end}", " $1^4")
    return (F.when(is_blank(text), F.lit(None).cast("string"))
            .when(~has_letter_or_digit(text), escape_query(text))
            .otherwise(F.trim(F.replace(out, F.lit("\t"), F.lit(" ")))))


def to_slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(fold_accents(F.regexp_replace(text, r"\s", "-")), r"[^A-Za-z0-9_-]", ""))


def sha256_hex(text: Column) -> Column:
    """Digest as a hexadecimal number, that is without leading zeros."""
    return F.regexp_replace(F.sha2(text, 256), "^0+(?=.)", "")


def extract_urls(text: Column) -> Column:
    """Web addresses with their character offsets."""

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda n, part: n + F.length(part))

    def entities(split: Column) -> Column:
        found, gaps = split["found"], split["gaps"]

        def entity(url: Column, i: Column) -> Column:
            start = total(F.slice(gaps, F.lit(1), i + 1)) + total(F.slice(found, F.lit(1), i))
            return F.struct(start.alias("start"), (start + F.length(url)).alias("end"), url.alias("text"),
                            F.lit("misc").alias("ner_type"), F.lit("url").alias("ner_tag"))

        return F.transform(found, entity)

    return bind(F.struct(F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0)).alias("found"),
                         F.split(text, URL_PATTERN, -1).alias("gaps")), entities)


def quote_terms(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(
        F.lit('"'), F.regexp_replace(t, r'[\\"]', ""), F.lit('"'))), " ")


def dedupe_terms(terms: Column) -> Column:
    """Lower-case words of all terms, each once, in order of first use."""
    return F.array_join(F.array_distinct(F.transform(F.split(F.array_join(terms, " "), " "), F.lower)), " ")


def context_text(messages: Column, with_skipped: bool = False) -> Column:
    """Contents of an ordered array of (content, skip) joined by a blank line."""
    kept = messages if with_skipped else F.filter(messages, lambda m: ~m["skip"])
    return F.array_join(F.transform(kept, lambda m: m["content"]), "\n\n")


def highlight(text: Column, terms: Column, opening: str = "<em>", closing: str = "</em>") -> Column:
    """Mark whole-word matches of any of ``terms`` regardless of case."""
    escaped = F.transform(terms, lambda t: F.regexp_replace(t, r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), F.array_join(escaped, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(terms) > 0, F.regexp_replace(
        text, pattern, F.lit(f"{opening}$1{closing}"))).otherwise(text)


def words(text: Column) -> Column:
    """Runs of letters and digits, in order; none of a null text."""
    return F.coalesce(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x != ""), F.array().cast("array<string>"))


def shortest_window(tokens: Column, terms: Column) -> Column:
    """Struct (first, last): positions from 0 of the shortest run of ``tokens`` that holds every one of ``terms`` which
    occurs at all; of equally short runs the first.  Null where no term occurs.

    One pass over the places of the terms: each term's last place is kept, and the least of them begins the run.
    """
    def walk(own: Column, asked: Column) -> Column:
        places = F.filter(F.transform(own, lambda t, i: F.struct(
            i.alias("at"), F.array_position(asked, t).cast("int").alias("of"))), lambda p: p["of"] > 0)
        none = F.lit(None).cast("int")
        start = F.struct(F.transform(asked, lambda _: F.lit(-1)).alias("seen"), none.alias("first"), none.alias("last"))

        def step(state: Column, place: Column) -> Column:
            seen = F.transform(state["seen"], lambda x, i: F.when(i + 1 == place["of"], place["at"]).otherwise(x))
            low = F.array_min(seen)
            better = (low >= 0) & (state["last"].isNull() | (place["at"] - low < state["last"] - state["first"]))
            return F.struct(seen.alias("seen"), F.when(better, low).otherwise(state["first"]).alias("first"),
                            F.when(better, place["at"]).otherwise(state["last"]).alias("last"))

        best = F.aggregate(places, start, step, lambda state: F.struct(state["first"].alias("first"), state["last"].alias("last")))
        return F.transform(F.array(best), lambda b: F.when(b["last"].isNotNull(), b))[0]

    # The terms that occur are found once, not for every token.
    asked = F.array_intersect(terms, tokens)
    return F.transform(F.array(F.struct(tokens.alias("own"), asked.alias("asked"))), lambda x: walk(x["own"], x["asked"]))[0]
