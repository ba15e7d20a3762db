"""Catalog: text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import lexicon, text
from chartloom.operators import stems
from chartloom.plans.registry import Tables, query

# words of letters and digits of any script, lower case: engines disagree about what else is in a word
PLAIN_SQL = r"trim(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{Nd} ]', ' ', 'g')), ' +', ' ', 'g'))"
WORDS_SQL = f"list_filter(string_split({PLAIN_SQL}, ' '), lambda w: w <> '')"


def plain(c="text"):
    return text.collapse_whitespace(F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd} ]", " ")))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def replace_sql(inner: str, pairs) -> str:
    for old, new in pairs:
        inner = f"replace({inner}, {quoted(old)}, {quoted(new)})"
    return inner


def regex_sql(inner: str, rules) -> str:
    for pattern, new in rules:
        inner = f"regexp_replace({inner}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return inner


def dedupe_sql(inner: str) -> str:
    """For blank-separated words: each word next to its predecessor, equal pairs dropped."""
    words = f"string_split({inner}, ' ')"
    return (f"array_to_string(list_transform(list_filter(list_zip({words}, list_prepend(NULL, {words})), "
            f"lambda p: p[1] IS NOT NULL AND p[1] IS DISTINCT FROM p[2]), lambda p: p[1]), ' ')")


def phrase_sql(phrases: list[str]) -> str:
    return f"list_extract({sql_list(phrases)}, CAST(doc_id % {len(phrases)} + 1 AS INTEGER))"


def phrase(phrases: list[str]):
    """A clinical phrase in front of each document, so that the rules have something to fire on."""
    return F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.col("doc_id") % len(phrases) + 1).cast("int"))


@query(r"SELECT doc_id, regexp_replace(text, '\p{Nd}', '', 'g') AS text FROM documents")
def strip_digits(t: Tables):
    return t.texts.select("doc_id", text.strip_digits(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9 \n]', ' ', 'g') AS text FROM documents")
def strip_special(t: Tables):
    return t.texts.select("doc_id", text.strip_special(F.col("text")).alias("text"))


@query(r"""
SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS text FROM documents""")
def collapse_ws(t: Tables):
    return t.texts.select("doc_id", text.collapse_whitespace(F.col("text")).alias("text"))


@query(f"WITH p AS (SELECT doc_id, {PLAIN_SQL} AS p FROM documents) SELECT doc_id, {dedupe_sql('p')} AS text FROM p")
def dedupe_words(t: Tables):
    return t.texts.select("doc_id", text.dedupe_words(plain()).alias("text"))


NEGATED = ["Discharged w/out fever w/ cane", "He doesn't walk, neither sits nor stands", "slow output r/o stroke h/o falls",
           "known a-fib a fib  w out help", "Can't move l arm or r leg", "w/ out r/o x"]


@query(f"""
WITH n AS (SELECT doc_id, ' ' || {phrase_sql(NEGATED)} || ' ' || {PLAIN_SQL} || ' ' AS s FROM documents)
SELECT doc_id, {replace_sql(replace_sql('lower(s)', lexicon.NEGATION), lexicon.LATERALITY)} AS text FROM n""")
def negation_norm(t: Tables):
    s = F.concat(F.lit(" "), phrase(NEGATED), F.lit(" "), plain(), F.lit(" "))
    return t.texts.select("doc_id", text.expand_laterality(text.normalise_negation(s)).alias("text"))


CODED = ["gaze 1 (0-2) noted", "1a- 2", "1 3 visual field", "10 1b", "2 sensory", "alert 0 (0-3)", "2 1 c",
         "motor left arm 3 (0-4)", "motor right leg 6b- 4", "3 7 limb ataxia", "0 9 best language", "2 9 language",
         "extinction/inattention 1", "extinction 2", "dysarthria 10- 1", "visual field 3- 2", "visual 3- 0",
         "facial palsy 4- 3 1 5 a", "4 6 b", "0 11 extinction inattention 11- 2", "1 2 best gaze 2 2 gaze", "no codes here"]


@query(f"""
WITH n AS (SELECT doc_id, {phrase_sql(CODED)} || ' ' || {PLAIN_SQL} AS s FROM documents)
SELECT doc_id, {regex_sql('s', lexicon.scale_rules())} AS text FROM n""")
def scale_items(t: Tables):
    s = F.concat(phrase(CODED), F.lit(" "), plain())
    return t.texts.select("doc_id", text.spell_scale_items(s).alias("text"))


SHORT = ["pt with hx hx htn and abd pain", "start iv meds max min neg", "lle rle lue weakness lkw ams",
         "medicines and medicine for dm ", "nad gen wt ekg etoh dx", "abdomen soft no cva tenderness ue le"]


@query(f"""
WITH n AS (SELECT doc_id, {phrase_sql(SHORT)} || ' ' || {PLAIN_SQL} AS s FROM documents)
SELECT doc_id, {replace_sql('s', lexicon.ABBREVIATIONS)} AS text FROM n""")
def abbrev_expand(t: Tables):
    s = F.concat(phrase(SHORT), F.lit(" "), plain())
    return t.texts.select("doc_id", text.expand_abbreviations(s).alias("text"))


LONG = ["systolic blood pressure and heart rate stable", "cranial nerves intact cranial nerve two",
        "computed tomography angiography head", "subarachnoid hemorrhage with shortness of breath",
        "ear nose throat head eyes ear nose and throat", "a mlarm drift mrleg no effort x", "modified rankin scale score vs vital signs",
        "past medical history of diabetes mellitus", "murmurs rubs or gallops mrg x ray x"]


@query(f"""
WITH n AS (SELECT doc_id, {phrase_sql(LONG)} || ' ' || {PLAIN_SQL} AS s FROM documents)
SELECT doc_id, {replace_sql(replace_sql('s', lexicon.PHRASES + lexicon.LIMB_CODES), [(x, ' ') for x in lexicon.LEAKS])} AS text
FROM n""")
def phrase_contract(t: Tables):
    s = F.concat(phrase(LONG), F.lit(" "), plain())
    return t.texts.select("doc_id", text.remove_leaks(text.contract_phrases(s)).alias("text"))


TREEBANK = [(r"\bcannot\b", "can not"), (r"\bgimme\b", "gim me"), (r"\blemme\b", "lem me"), (r"\bgonna\b", "gon na"),
            (r"\bgotta\b", "got ta"), (r"\bwanna\b", "wan na")]
SPOKEN = ["i cannot walk", "gonna fall", "wanna rest and gotta go", "lemme and gimme", "canned gonnas", "plain"]


@query(f"""
WITH n AS (SELECT doc_id, {phrase_sql(SPOKEN)} || ' ' || {PLAIN_SQL} AS s FROM documents)
SELECT doc_id, array_to_string(list_filter(string_split({regex_sql('s', TREEBANK)}, ' '), lambda w: w <> ''), '|') AS tokens FROM n""")
def tokenize(t: Tables):
    s = F.concat(phrase(SPOKEN), F.lit(" "), plain())
    return t.texts.select("doc_id", F.array_join(text.tokenize(s), "|").alias("tokens"))


def suffix_sql(table: str) -> str:
    """The longest suffix of the table that the word `w` ends with."""
    return f"(SELECT arg_max(suffix, length(suffix)) FROM {table} WHERE ends_with(w, suffix))"


def measure_sql(cut: str) -> str:
    """Vowel-consonant runs of the word without its last `cut` letters, from its shape `s`."""
    return f"len(regexp_extract_all(left(s, greatest(length(w) - ({cut}), 0)), 'v+c+'))"


def short_sql(word: str, shape: str) -> str:
    return f"({shape} = 'vc' OR (right({shape}, 3) = 'cvc' AND right({word}, 1) NOT IN ('w', 'x', 'y')))"


SHAPE_SQL = ("CASE WHEN w = '' THEN '' ELSE list_reduce(list_concat([''], string_split(w, '')), lambda s, x: s || CASE WHEN x IN "
             "('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND right(s, 1) = 'c') THEN 'v' ELSE 'c' END) END AS s")

# the published suffix rules, one step after the other, on the relation `words` (token); `stems` is the result
STEMS_SQL = f"""
irregular(token, stem) AS (VALUES ('sky', 'sky'), ('skies', 'sky'), ('dying', 'die'), ('lying', 'lie'), ('tying', 'tie'), ('news', 'news'),
    ('innings', 'inning'), ('inning', 'inning'), ('outings', 'outing'), ('outing', 'outing'), ('cannings', 'canning'),
    ('canning', 'canning'), ('howe', 'howe'), ('proceed', 'proceed'), ('exceed', 'exceed'), ('succeed', 'succeed')),
double(suffix, new) AS (VALUES ('ational', 'ate'), ('tional', 'tion'), ('enci', 'ence'), ('anci', 'ance'), ('izer', 'ize'), ('bli', 'ble'),
    ('alli', 'al'), ('entli', 'ent'), ('eli', 'e'), ('ousli', 'ous'), ('ization', 'ize'), ('ation', 'ate'), ('ator', 'ate'),
    ('alism', 'al'), ('iveness', 'ive'), ('fulness', 'ful'), ('ousness', 'ous'), ('aliti', 'al'), ('iviti', 'ive'),
    ('biliti', 'ble'), ('fulli', 'ful'), ('logi', 'log')),
inner_(suffix, new) AS (VALUES ('icate', 'ic'), ('ative', ''), ('alize', 'al'), ('iciti', 'ic'), ('ical', 'ic'), ('ful', ''), ('ness', '')),
bare(suffix) AS (VALUES ('al'), ('ance'), ('ence'), ('er'), ('ic'), ('able'), ('ible'), ('ant'), ('ement'), ('ment'), ('ent'),
    ('ion'), ('ou'), ('ism'), ('ate'), ('iti'), ('ous'), ('ive'), ('ize')),
plural AS (SELECT token, CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
    WHEN ends_with(w, 'ies') THEN left(w, length(w) - if(length(w) = 4, 1, 2))
    WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END AS w
    FROM (SELECT token, lower(token) AS w FROM words)),
past1 AS (SELECT *, CASE WHEN ends_with(w, 'ied') OR ends_with(w, 'eed') THEN 0
    WHEN ends_with(w, 'ed') AND contains(left(s, length(w) - 2), 'v') THEN 2
    WHEN ends_with(w, 'ing') AND contains(left(s, length(w) - 3), 'v') THEN 3 ELSE 0 END AS cut
    FROM (SELECT token, w, {SHAPE_SQL} FROM plural)),
past2 AS (SELECT *, left(w, length(w) - cut) AS t, left(s, length(w) - cut) AS ts FROM past1),
past AS (SELECT token, CASE WHEN ends_with(w, 'ied') THEN left(w, length(w) - if(length(w) = 4, 1, 2))
    WHEN ends_with(w, 'eed') THEN if({measure_sql('3')} > 0, left(w, length(w) - 1), w)
    WHEN cut = 0 THEN w
    WHEN ends_with(t, 'at') OR ends_with(t, 'bl') OR ends_with(t, 'iz') THEN t || 'e'
    WHEN length(t) > 1 AND right(t, 1) = left(right(t, 2), 1) AND right(ts, 1) = 'c'
        THEN if(right(t, 1) IN ('l', 's', 'z'), t, left(t, length(t) - 1))
    WHEN {measure_sql('cut')} = 1 AND {short_sql('t', 'ts')} THEN t || 'e' ELSE t END AS w FROM past2),
final_y AS (SELECT token, CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND right(left(s, length(w) - 1), 1) = 'c'
    THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM (SELECT token, w, {SHAPE_SQL} FROM past)),
double1 AS (SELECT token, w, {SHAPE_SQL}, {suffix_sql('double')} AS f FROM final_y),
double2 AS (SELECT token, CASE WHEN f IS NOT NULL AND {measure_sql("length(f) - if(f = 'logi', 1, 0)")} > 0
    THEN left(w, length(w) - length(f)) || (SELECT new FROM double WHERE suffix = f) ELSE w END AS w,
    f = 'alli' AND {measure_sql('4')} > 0 AS again FROM double1),
double3 AS (SELECT token, w, again, {SHAPE_SQL}, {suffix_sql('double')} AS f FROM double2),
double4 AS (SELECT token, CASE WHEN again AND f IS NOT NULL AND {measure_sql("length(f) - if(f = 'logi', 1, 0)")} > 0
    THEN left(w, length(w) - length(f)) || (SELECT new FROM double WHERE suffix = f) ELSE w END AS w FROM double3),
inner1 AS (SELECT token, w, {SHAPE_SQL}, {suffix_sql('inner_')} AS f FROM double4),
inner2 AS (SELECT token, CASE WHEN f IS NOT NULL AND {measure_sql('length(f)')} > 0
    THEN left(w, length(w) - length(f)) || (SELECT new FROM inner_ WHERE suffix = f) ELSE w END AS w FROM inner1),
bare1 AS (SELECT token, w, {SHAPE_SQL}, {suffix_sql('bare')} AS f FROM inner2),
bare2 AS (SELECT token, CASE WHEN f IS NOT NULL AND {measure_sql('length(f)')} > 1
        AND (f <> 'ion' OR right(left(w, length(w) - 3), 1) IN ('s', 't'))
    THEN left(w, length(w) - length(f)) ELSE w END AS w FROM bare1),
tidy1 AS (SELECT token, w, {SHAPE_SQL}, left(w, length(w) - 1) AS t FROM bare2),
tidy2 AS (SELECT token, s, CASE WHEN ends_with(w, 'e') AND ({measure_sql('1')} > 1
    OR ({measure_sql('1')} = 1 AND NOT {short_sql('t', 'left(s, length(w) - 1)')})) THEN t ELSE w END AS w FROM tidy1),
tidy3 AS (SELECT token, CASE WHEN ends_with(w, 'll') AND {measure_sql('1')} > 1 THEN left(w, length(w) - 1) ELSE w END AS w FROM tidy2),
stems AS (SELECT token, CASE WHEN i.stem IS NOT NULL THEN i.stem WHEN length(token) <= 2 THEN lower(token) ELSE w END AS stem
    FROM tidy3 LEFT JOIN irregular i USING (token))"""


@query(f"""
WITH words AS (SELECT DISTINCT unnest({WORDS_SQL}) AS token FROM documents), {STEMS_SQL},
placed AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {WORDS_SQL} AS ws FROM documents)),
rebuilt AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS text FROM placed JOIN stems USING (token) GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(r.text, '') END AS text FROM documents d LEFT JOIN rebuilt r USING (doc_id)""")
def stem_tokens(t: Tables):
    return stems.stem_by_vocabulary(t.texts.select("doc_id", plain().alias("text")), "text")


@query(f"""
WITH words AS (SELECT DISTINCT unnest({WORDS_SQL}) AS token FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)), {STEMS_SQL}
SELECT token, stem FROM stems""")
def stem_relation(t: Tables):
    """The benchmark adds only the words that no document has."""
    store = stems.StemStore(t.spark)
    for table in (t.texts, t.benchmark):
        store.learn(table.select(plain().alias("text")), "text")
    return store.read()


@query(rf"""
SELECT doc_id, CAST(len(regexp_extract_all({PLAIN_SQL}, '[\p{{L}}\p{{Nd}}]+')) AS INTEGER) AS tokens FROM documents""")
def token_count(t: Tables):
    return t.texts.select("doc_id", text.token_count(plain()).alias("tokens"))


@query(f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS bigrams,
  array_to_string(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), '|') AS trigrams
FROM w""")
def ngrams(t: Tables):
    tokens = text.word_tokens(plain())
    return t.texts.select("doc_id", text.joined_ngrams(tokens, 2).alias("bigrams"),
                              text.joined_ngrams(tokens, 3).alias("trigrams"))


NOTES = [a + "; " + b for a, b in zip(CODED, (NEGATED + SHORT + LONG) * 2)]


def clean_sql(s: str) -> tuple[str, str]:
    """The steps of the note clean-up as CTEs c1 .. c6 over n(doc_id, s), and the last one's name."""
    collapse = "trim(regexp_replace({}, '\\s+', ' ', 'g'))".format
    one = replace_sql(replace_sql(f"lower({collapse(s)})", lexicon.NEGATION), lexicon.LATERALITY)
    two = regex_sql(collapse("replace(s, ',', ' ')"), lexicon.scale_rules())
    three = collapse("regexp_replace(replace(regexp_replace(s, '\\d', '', 'g'), '/l', ' '), '[^a-zA-Z0-9 \\n]', ' ', 'g')")
    four = dedupe_sql("s")
    five = replace_sql("lower(s)", lexicon.ABBREVIATIONS)
    six = replace_sql(replace_sql("s", lexicon.PHRASES + lexicon.LIMB_CODES), [(x, " ") for x in lexicon.LEAKS])
    steps = [one, two, three, four, five, six]
    ctes = ", ".join(f"c{i} AS (SELECT doc_id, {e} AS s FROM {'n' if i == 1 else f'c{i - 1}'})"
                     for i, e in enumerate(steps, start=1))
    return ctes, "c6"


def normalise_sql(words: list[str]) -> str:
    ctes, last = clean_sql("s")
    kept = (f"array_to_string(list_filter(string_split({regex_sql('s', TREEBANK)}, ' '), "
            f"lambda w: w <> '' AND NOT list_contains({sql_list(words)}, w)), ' ')")
    return f"""
WITH n AS (SELECT doc_id, {phrase_sql(NOTES)} || ' ' || regexp_replace(text, '[^ -~]', ' ', 'g') AS s FROM documents),
{ctes}, c7 AS (SELECT doc_id, {kept} AS s FROM {last})
SELECT doc_id, {dedupe_sql('s')} AS text FROM c7"""


# a caller's list, in plain form
SITE_WORDS = ["the", "and", "of", "to", "a", "in", "is", "was", "with", "for", "patient", "note", "ros", "hr", "hx",
              "der", "die", "und", "le", "la", "de", "el", "du", "à"]


@query(f"""
WITH n AS (SELECT doc_id, string_split({regex_sql(PLAIN_SQL, TREEBANK)}, ' ') AS w FROM documents)
SELECT doc_id, array_to_string(list_filter(w, lambda x: x <> '' AND NOT list_contains({sql_list(SITE_WORDS)}, x)), ' ') AS text FROM n""")
def stopword_filter(t: Tables):
    return t.texts.select("doc_id", text.remove_stop_words(plain(), SITE_WORDS).alias("text"))


@query(normalise_sql(SITE_WORDS))
def normalise_text(t: Tables):
    s = F.concat(phrase(NOTES), F.lit(" "), F.regexp_replace("text", "[^ -~]", " "))
    return t.texts.select("doc_id", text.normalise_note(s, SITE_WORDS).alias("text"))
