import re

import pytest
from pyspark.sql import functions as F

from chartloom.functions import lexicon, stem, text
from chartloom.operators import extract


@pytest.mark.parametrize("given, wanted", [
    ("a a a b", "a b"), ("a ab", "a ab"), ("é é", "é"), ("foo-bar bar", "foo-bar"), ("A a", "A a"), ("", ""),
])
def test_dedupe_words(one, given, wanted):
    assert one(text.dedupe_words, given) == wanted


def test_collapse_whitespace_is_unicode_and_idempotent(one):
    given = "  a\t b\n\x1cc  "
    assert one(text.collapse_whitespace, given) == " ".join(given.split()) == "a b c"
    assert one(lambda c: text.collapse_whitespace(text.collapse_whitespace(c)), given) == "a b c"


@pytest.mark.parametrize("given, wanted", [
    ("slow output", "slowithoutput"), ("he didn't w/ cane", "he did not with  cane"),
    ("neither sits nor walks", "not sits not walks"), ("x r/o mi h/o a-fib x", "x rule out mi history of afib x"),
])
def test_negation(one, given, wanted):
    assert one(text.normalise_negation, given) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("gaze 1 (0-2)", "partial gaze palsy"), ("1a- 2", "movements to pain"), ("1 3 visual field", "partial gaze palsy"),
    ("10 1b", "1alert keenly responsive"), ("2 sensory", "ataxia in two limbs"), ("no digits", "no digits"),
    ("0 5 visual field 3 (0-3)", "mlarm no driftilateral hemianopia"), ("0 2 gaze", "performs both tasks correctly"),
])
def test_scale_items(one, given, wanted):
    assert one(text.spell_scale_items, given) == wanted


def test_scale_items_equal_the_plain_chain(spark):
    """Gates only skip texts that no rule can change."""
    pieces = ["alert 0 (0-3)", "1b- 1", "2 1c", "commands 2 (0-2)", "0 2 best gaze", "visual 3- 2", "3 4 facial palsy",
              "2 5a", "1 5 b", "motor right arm 5b- 4", "4 6b", "motor left leg 3 (0-4)", "1 7 limb ataxia", "ataxia 7- 2",
              "1 8 sensory", "0 9 language", "language 9- 3", "3 10 dysarthria", "1 11 extinction", "inattention 11- 0",
              "extinction/inattention 2", "extinction 1", "plain words", "12 345", "0 5 bilateral", "1 (0-2)"]
    texts = [f"{a} {b} {c}" for a in pieces for b in pieces for c in (pieces[0], pieces[12], "0 5")]

    def plain(value):
        for pattern, new in lexicon.scale_rules():
            value = re.sub(pattern, new, value)
        return value
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(
        "v", text.spell_scale_items(F.col("v")).alias("o")).collect()
    assert [r for r in rows if r.o != plain(r.v)] == []


@pytest.mark.parametrize("given, wanted", [
    ("hx of htn and hx today", "hx of hypertension and history today"), ("a hx hx b", "a history hx b"),
    ("an abdomen", "an abdominal"),
])
def test_abbreviations(one, given, wanted):
    assert one(text.expand_abbreviations, given) == wanted


def test_phrases_in_order(one):
    assert one(text.contract_phrases, "systolic blood pressure") == "sbp"
    assert one(text.contract_phrases, "subarachnoid hemorrhage today") == "sahtoday"
    assert one(text.contract_phrases, "computed tomography angiography") == "cta"


def test_stop_words_and_tokens(one):
    assert one(lambda c: text.remove_stop_words(c, ["the", "not"]), "the man cannot walk not The") == "man can walk The"
    assert one(text.tokenize, "  ") == []
    assert "the" in text.default_stop_words()


def test_ngrams(one):
    assert one(lambda c: text.ngrams(text.word_tokens(c), 2), "A b, c") == ["a b", "b c"]
    assert one(lambda c: text.ngrams(text.word_tokens(c), 3), "a b") == []
    assert one(lambda c: text.ngram_range(text.word_tokens(c)), "a b c") == ["a", "b", "c", "a b", "b c", "a b c"]


@pytest.mark.parametrize("word, wanted", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"),
    ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"),
    ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"),
    ("radically", "radic"), ("vietnamization", "vietnam"), ("operator", "oper"), ("decisiveness", "decis"),
    ("hopefulness", "hope"), ("formaliti", "formal"), ("sensibiliti", "sensibl"), ("triplicate", "triplic"),
    ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("adjustable", "adjust"),
    ("replacement", "replac"), ("adoption", "adopt"), ("communism", "commun"), ("effective", "effect"), ("probate", "probat"),
    ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("dying", "die"), ("died", "die"),
    ("enjoy", "enjoy"), ("language", "languag"), ("healthcare", "healthcar"), ("analogy", "analog"), ("is", "is"),
])
def test_stem_word(word, wanted):
    assert stem.stem_word(word) == wanted


def test_stem_text(one):
    assert one(stem.stem_text, "discussed preferred languages") == "discuss prefer languag"
    assert one(stem.stem_text, None) is None


@pytest.mark.parametrize("given, death, wanted", [
    ("x] 3 moderate disability x] 1 no significant disability", 0, 1), ("[x] 4: moderately severe disability", 0, 4),
    ("x] 5 severe disability", 1, 6), ("x] 6 dead", 0, 6), ("[ ] 2 slight disability", 0, None), ("none", 1, 6),
])
def test_checkbox_score(one, given, death, wanted):
    assert one(lambda c: extract.checkbox_score(c, F.lit(death)), given) == wanted


@pytest.mark.parametrize("given, count, wanted", [
    ("rankin 1 and rankin 2 soon", 1, 2), ("rankin is 4 " + "x" * 60 + " rankin 1 today", 2, 4),
    ("rankin", 0, None), ("rankin unknown", 1, None),
])
def test_mentions(one, given, count, wanted):
    assert len(one(extract.mentions, given)) == count
    assert one(lambda c: extract.mention_score(extract.mentions(c)), given) == wanted


def test_mentions_equal_the_python_pattern(spark):
    """The pattern in its original spelling, where a bracket inside a class needs no escape."""
    original = re.compile(r"(rankin(:?\??[?)(\s?)([\w]).{1,50})")
    texts = ["rankin: 3 then " + "y" * 50 + " rankin? 2 z", "rankin[4 ab", "rankin-3 b", "rankin (0-6) is 3 ok", "a rankin"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", extract.mentions(F.col("v")).alias("m"))
    for row in rows.collect():
        assert row.m == [m.group(1) for m in original.finditer(row.v)]


def test_death_marks(one):
    assert one(extract.mark_deaths, "Patient jones quietly expired at noon") == "mrs 6 noon"
    assert one(extract.death_phrase, "The PATIENT DIED") == 1
    assert one(extract.death_phrase, None) == 0
