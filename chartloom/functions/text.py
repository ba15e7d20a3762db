"""Text operators: column in, column out, no shuffle. Literal replacements and joined n-grams are Arrow functions."""

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, functions as F

from chartloom.functions import lexicon
from chartloom.functions.rewrite import apply_families, bind, replace_all

# Unicode white space, plus the four separators that str.split() also splits on
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
WORD = r"(?U)\w+"


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\d", "")


def strip_special(c: Column) -> Column:
    """Everything but ASCII letters, digits, blanks and line feeds becomes a blank. (Written with
    \\W: several times faster in the JVM than the same set as a negated list of ranges.)"""
    return F.regexp_replace(c, r"[\W_&&[^ \n]]", " ")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WHITESPACE, " "))


def dedupe_words(c: Column) -> Column:
    """`a a a b` -> `a b`: a word repeated in a row is kept once (case matters)."""
    return F.regexp_replace(c, r"(?U)\b(\w+)( \1\b)+", "$1")


def remove_site_tags(c: Column) -> Column:
    return replace_all(F.lower(c), [(tag, " ") for tag in lexicon.SITE_TAGS])


def typing_text(c: Column) -> Column:
    """The scratch text a note line is classified by; the stored text stays as it was."""
    cleaned = strip_special(strip_digits(F.coalesce(c, F.lit(""))))
    return collapse_whitespace(remove_site_tags(cleaned))


def normalise_negation(c: Column) -> Column:
    """Substring rules as observed: `slow output` does become `slowithoutput`."""
    return replace_all(F.lower(c), lexicon.NEGATION)


def expand_laterality(c: Column) -> Column:
    return replace_all(F.lower(c), lexicon.LATERALITY)


def spell_scale_items(c: Column) -> Column:
    """Coded scale items (`gaze 1 (0-2)`, `1a- 2`, `1 3 visual field`) to words. Most
    texts hold none and leave at the first test; before any rule has fired the text is the
    original, so that test is exact."""
    families = lexicon.scale_families()
    return bind(c, lambda text: F.when(text.rlike(lexicon.ANY_SCALE_ITEM), apply_families(text, families)).otherwise(text))


def remove_slash_l(c: Column) -> Column:
    return F.replace(c, F.lit("/l"), F.lit(" "))


def expand_abbreviations(c: Column) -> Column:
    """Blank-delimited, so the first and last words never match and two adjacent hits share a
    blank: only the first of them is expanded. As observed."""
    return replace_all(c, lexicon.ABBREVIATIONS)


def contract_phrases(c: Column) -> Column:
    return replace_all(c, lexicon.PHRASES + lexicon.LIMB_CODES)


def remove_leaks(c: Column) -> Column:
    return replace_all(c, [(phrase, " ") for phrase in lexicon.LEAKS])


def split_contractions(c: Column) -> Column:
    """The Treebank word forms that survive in letters-only text: `cannot` -> `can not`."""
    return F.regexp_replace(
        c, r"(?i)\b(can(?=not\b)|(?:gim|lem)(?=me\b)|gon(?=na\b)|got(?=ta\b)|wan(?=na\b))", "$1 ")


def tokenize(c: Column) -> Column:
    """Blank-separated tokens, contractions split; an empty text has no tokens."""
    return F.filter(F.split(split_contractions(c), r"\s+"), lambda t: t != "")


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of word characters: the tokens that n-grams are built from."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def token_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(WORD), 0))


def default_stop_words() -> list[str]:
    """Spark ML's English list as it is. A site's own list replaces it: pass
    `sources.tables.read_terms(...)` wherever a stop list is asked for."""
    return StopWordsRemover.loadDefaultStopWords("english")


def keep_tokens(tokens: Column, terms: list[str]) -> Column:
    """Order and repeats stay. The literal list becomes a hash-set test inside the filter."""
    return F.filter(tokens, lambda t: t.isin(terms))


def drop_tokens(tokens: Column, terms: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(terms))


def remove_stop_words(c: Column, stop_words: list[str]) -> Column:
    return F.array_join(drop_tokens(tokenize(c), stop_words), " ")


def keep_vocabulary(c: Column, terms: list[str]) -> Column:
    """Keep the listed words, then tidy the neighbours this brings together."""
    return collapse_whitespace(dedupe_words(F.array_join(keep_tokens(tokenize(c), terms), " ")))


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams of one document, in order, with repeats."""
    if n == 1:
        return tokens
    return bind(tokens, lambda words: F.when(
        F.size(words) >= n,
        F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(n - 1)),
                    lambda at: F.array_join(F.slice(words, at, F.lit(n)), " ")),
    ).otherwise(F.array().cast("array<string>")))


def joined_ngrams(tokens: Column, n: int, separator: str = "|") -> Column:
    """The n-grams of one document as one text; tokens hold no blanks. No array of n-grams is built per document."""
    @F.pandas_udf("string")
    def joined(texts: pd.Series) -> pd.Series:
        def grams(value: str) -> str:
            words = value.split(" ")
            return separator.join(map(" ".join, zip(*[words[k:] for k in range(n)])))
        return texts.map(grams)
    return joined(F.coalesce(F.array_join(tokens, " "), F.lit("")))


def ngram_range(tokens: Column, low: int = 1, high: int = 3) -> Column:
    return bind(tokens, lambda words: F.concat(*[ngrams(words, n) for n in range(low, high + 1)]))


def clean_note(c: Column) -> Column:
    """The note text up to, but without, stop words and stemming. The order of the steps is part
    of the result: moving one changes the text."""
    text = collapse_whitespace(c)
    text = expand_laterality(normalise_negation(text))
    text = collapse_whitespace(F.replace(text, F.lit(","), F.lit(" ")))
    text = spell_scale_items(text)
    text = strip_special(remove_slash_l(strip_digits(text)))
    text = dedupe_words(collapse_whitespace(text))
    return remove_leaks(contract_phrases(expand_abbreviations(F.lower(text))))


def normalise_note(c: Column, stop_words: list[str]) -> Column:
    """`clean_note`, then stop words out and neighbours tidied; stemming follows."""
    return dedupe_words(collapse_whitespace(remove_stop_words(clean_note(c), stop_words)))
