"""Stemmers and the term analysis of texts.

The suffix strippers that are a few alternatives long are regular expressions evaluated in the JVM.  The two published
multi-step stemmers run in Arrow batches over the term column; a worker remembers the stems of the words it met last.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parley.functions import text as tx
from parley.lookup import lookup_join


def light_stem_de(term: Column) -> Column:
    """Light stemming of German (Savoy): plural and case endings, then superlative endings."""
    out = tx.fold_accents(term)
    out = F.regexp_replace(out, r"^(.{3,}?)(?:ern|e[mnrs]|e)$|^(.{2,}[bdfghklmnt])s$", "$1$2")
    return F.regexp_replace(out, r"^(.{3,})(?:est|e[rn])$|^(.{2,}[bdfghklmnt])st$", "$1$2")


def minimal_stem_de(term: Column) -> Column:
    """Plural endings of German words with at least five letters."""
    stemmed = F.regexp_replace(F.translate(term, "äöü", "aou"),
                               r"^(.{4,})nen$|^(.{4,})(?:en|se|es|er)$|^(.{4,})[nesr]$", "$1$2$3")
    return F.when(F.length(term) < 5, term).otherwise(stemmed)


def german_normalize(term: Column) -> Column:
    """ß to ss, umlauts and their two-letter spellings to the plain vowel."""
    out = F.replace(term, F.lit("ß"), F.lit("ss"))
    out = F.regexp_replace(out, "([ao])e", "$1")
    out = F.regexp_replace(out, "(^|[^aeiouqyäöü])ue", "$1u")
    return F.translate(out, "äöü", "aou")


def possessive_en(term: Column) -> Column:
    return F.regexp_replace(term, r"['’＇][sS]$", "")


_VOWEL_DE = "aeiouyäöü"
STEMS = 1 << 18  # words whose stem a worker remembers from batch to batch


def _regions_de(word: str) -> tuple[int, int]:
    def after(start: int) -> int:
        match = re.compile(rf"[{_VOWEL_DE}][^{_VOWEL_DE}]").search(word, start)
        return match.end() if match else len(word)

    first = after(0)
    return max(first, 3), after(first)


@lru_cache(maxsize=STEMS)
def _snowball_de(word: str) -> str:
    """Snowball stemmer for German, in the variant that reads ae, oe, ue as umlauts."""
    word = re.sub(rf"(?<=[{_VOWEL_DE}])([uy])(?=[{_VOWEL_DE}])", lambda m: m[1].upper(), word.replace("ß", "ss"))
    word = re.sub("(?<!q)ue", "ü", word.replace("ae", "ä").replace("oe", "ö"))
    r1, r2 = _regions_de(word)

    def ends(pattern: str, region: int) -> re.Match | None:
        match = re.search(f"(?:{pattern})$", word)
        return match if match and match.start() >= region else None

    if match := re.search("(?:ern|em|er)$", word):
        word = word[:match.start()] if match.start() >= r1 else word
    elif match := re.search("(?:en|es|e)$", word):
        if match.start() >= r1:
            word = re.sub("niss$", "nis", word[:match.start()])
    elif (match := ends("s", r1)) and word[-2:-1] in tuple("bdfghklmnrt"):
        word = word[:-1]
    if match := re.search("(?:est|en|er)$", word):
        word = word[:match.start()] if match.start() >= r1 else word
    elif ends("st", r1) and len(word) >= 6 and word[-3] in "bdfghklmnt":
        word = word[:-2]
    if match := ends("end|ung", r2):
        word = word[:match.start()]
        if (match := ends("ig", r2)) and word[match.start() - 1] != "e":
            word = word[:match.start()]
    elif match := ends("isch|ig|ik", r2):
        word = word[:match.start()] if word[match.start() - 1] != "e" else word
    elif match := ends("lich|heit", r2):
        word = word[:match.start()]
        if match := ends("er|en", r1):
            word = word[:match.start()]
    elif match := ends("keit", r2):
        word = word[:match.start()]
        if match := ends("lich|ig", r2):
            word = word[:match.start()]
    return word.lower().translate(str.maketrans("äöü", "aou"))


_C, _V = "[^aeiou](?:[^aeiouy])*", "[aeiouy][aeiou]*"
_M_POSITIVE = re.compile(f"^(?:{_C})?{_V}{_C}")
_M_ONE = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_M_ABOVE_ONE = re.compile(f"^(?:{_C})?{_V}{_C}{_V}{_C}")
_HAS_VOWEL = re.compile(f"^(?:{_C})?[aeiouy]")
_SHORT = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
# Suffixes of steps 2 to 4 of the published algorithm.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
          "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
          "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
          "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate",
          "iti", "ous", "ive", "ize"]


def _replace_longest(word: str, suffixes: dict[str, str], condition: re.Pattern) -> str:
    for size in range(7, 1, -1):
        suffix = word[-size:]
        if len(word) >= size and suffix in suffixes:
            stem = word[:-size]
            return stem + suffixes[suffix] if condition.match(stem) else word
    return word


@lru_cache(maxsize=STEMS)
def _porter_en(word: str) -> str:
    """Porter stemmer."""
    if len(word) < 3 or not word.isascii():
        return word
    if word[0] == "y":
        return "y" + _porter_en("Y" + word[1:])[1:]
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _M_POSITIVE.match(word[:-3]) else word
    elif (match := re.search("(?:ed|ing)$", word)) and _HAS_VOWEL.match(word[:match.start()]):
        word = word[:match.start()]
        if re.search("(?:at|bl|iz)$", word):
            word += "e"
        elif re.search(r"([^aeiouylsz])\1$", word):
            word = word[:-1]
        elif _SHORT.match(word):
            word += "e"
    if word.endswith("y") and _HAS_VOWEL.match(word[:-1]):
        word = word[:-1] + "i"
    word = _replace_longest(word, _STEP2, _M_POSITIVE)
    word = _replace_longest(word, _STEP3, _M_POSITIVE)
    if re.search("[st]ion$", word):
        word = word[:-3] if _M_ABOVE_ONE.match(word[:-3]) else word
    else:
        word = _replace_longest(word, dict.fromkeys(_STEP4, ""), _M_ABOVE_ONE)
    if word.endswith("e"):
        stem = word[:-1]
        if _M_ABOVE_ONE.match(stem) or (_M_ONE.match(stem) and not _SHORT.match(stem)):
            word = stem
    if word.endswith("ll") and _M_ABOVE_ONE.match(word):
        word = word[:-1]
    return word


def _per_distinct(terms: pd.Series, stem) -> pd.Series:
    codes, distinct = pd.factorize(terms)
    stems = pd.Series([stem(term) for term in distinct] + [None], dtype=object)
    return stems.take(codes).reset_index(drop=True)


@F.pandas_udf(T.StringType())
def snowball_de(terms: pd.Series) -> pd.Series:
    return _per_distinct(terms, _snowball_de)


@F.pandas_udf(T.StringType())
def porter_en(terms: pd.Series) -> pd.Series:
    return _per_distinct(terms, _porter_en)


def _after(prepare, stem):
    return lambda c: stem(prepare(c))


# Per chain: how text is split, what is removed, and the final form of a term.
_GERMAN = lambda c: tx.bind(german_normalize(light_stem_de(c)), tx.ascii_fold)
CHAINS = {
    "standard": {},
    "text_ws_lower": {"split": "space", "html": True, "finish": tx.ascii_fold},
    "text_gen": {"split": "space", "html": True, "delimit": True, "possessive": True, "punct": True,
                 "distinct": True, "finish": tx.ascii_fold},
    "text_general": {"split": "space", "html": True, "delimit": True, "possessive": True, "stop": True,
                     "finish": tx.ascii_fold},
    "text_de": {"split": "space", "html": True, "delimit": True, "punct": True, "stop": True, "distinct": True,
                "finish": _GERMAN},
    "text_en": {"split": "space", "html": True, "delimit": True, "possessive": True, "stop": True,
                "finish": _after(possessive_en, porter_en)},
    "text_iterms_de": {"stop": True, "finish": snowball_de},
}


def analyze_text(df: DataFrame, text: str, chain: str = "standard", stop: list[str] | None = None,
                 query_side: bool = False, lengths: bool = False) -> DataFrame:
    """One row per term of ``text``: the other columns, ``pos``, ``word`` (as written) and ``term``.

    ``lengths`` adds the number of words of the text as ``len``.

    ``query_side`` splits tokens only at delimiters and does not join the parts again.
    """
    spec = CHAINS[chain]
    keep = [c for c in df.columns if c != text]
    source = tx.strip_html(F.col(text)) if spec.get("html") else F.col(text)
    breaks = r"\s+" if spec.get("split") == "space" else r"[^\p{L}\p{N}]+"
    split = df.select(*keep, F.split(source, breaks).alias("_words"))
    if lengths:
        split = split.withColumn("len", F.size(F.array_remove("_words", "")))
        keep = [*keep, "len"]
    words = split.select(*keep, F.posexplode("_words").alias("pos", "word")).filter(F.col("word") != "")
    stopped = [w.lower() for w in stop] if stop and spec.get("stop") else []

    def plain(value: Column) -> Column:
        return F.lower(tx.strip_punct(value) if spec.get("punct") else value)

    finish = spec.get("finish", lambda value: value)
    if not spec.get("delimit"):
        if stopped:
            words = words.filter(~F.lower("word").isin(*stopped))
        return words.withColumn("term", finish(plain(F.col("word")))).filter(F.col("term") != "")
    variants = F.transform(tx.word_delimit(
        F.col("word"), split_case=not query_side, split_numbers=not query_side, catenate=not query_side,
        possessive=bool(spec.get("possessive"))), plain)
    if stopped:
        variants = F.filter(variants, lambda v: ~v.isin(*stopped))
    if spec.get("distinct"):
        # a word that yields the same term twice counts once
        terms = words.withColumn("term", F.explode(F.array_distinct(F.transform(variants, finish))))
    else:
        terms = words.withColumn("_variant", F.explode(variants)).withColumn("term", finish(F.col("_variant")))
        terms = terms.drop("_variant")
    return terms.filter(F.col("term") != "")


def synonym_map(terms: DataFrame, synonyms: DataFrame, expand: bool = True) -> DataFrame:
    """Replace terms by their synonyms (``synonyms``: term, replacement).

    With ``expand`` a term becomes one row per replacement, otherwise the first replacement in order.
    """
    lists = synonyms.groupBy("term").agg(F.array_sort(F.collect_set("replacement")).alias("_to"))
    joined = lookup_join(terms, lists, ["term"], "left")
    targets = F.coalesce("_to", F.array("term"))
    chosen = targets if expand else F.slice(targets, 1, 1)
    kept = [c for c in terms.columns if c != "term"]
    return joined.select(*kept, F.explode(chosen).alias("term")).select(*terms.columns)
