"""Rule-based rewriting of English statements as Column -> Column: negation, questions, number, articles, tense."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lemmary.functions.text import strip, words

# What a negation puts in place of each verb in this order, words that are negative already, and irregular plurals.
NEGATED = {
    "is": "is not", "are": "are not", "was": "was not", "were": "were not", "am": "am not", "can": "cannot", "will": "will not",
    "would": "would not", "should": "should not", "could": "could not", "may": "may not", "might": "might not", "must": "must not",
    "have": "have not", "has": "has not", "had": "had not",
}
NEGATIVE = (
    "not no never nothing nobody nowhere neither none cannot can't don't doesn't didn't won't wouldn't shouldn't couldn't isn't aren't "
    "wasn't weren't haven't hasn't hadn't mustn't shan't mayn't mightn't"
).split()
IRREGULAR = {
    "child": "children", "foot": "feet", "tooth": "teeth", "goose": "geese", "man": "men", "woman": "women", "mouse": "mice", "louse": "lice",
    "ox": "oxen", "person": "people", "datum": "data", "phenomenon": "phenomena", "criterion": "criteria", "analysis": "analyses",
    "basis": "bases", "crisis": "crises", "thesis": "theses", "hypothesis": "hypotheses", "axis": "axes", "appendix": "appendices",
    "index": "indices", "matrix": "matrices", "vertex": "vertices", "radius": "radii", "nucleus": "nuclei", "stimulus": "stimuli",
    "cactus": "cacti", "focus": "foci", "fungus": "fungi", "alumnus": "alumni",
}
#: Nouns that are not counted, and the endings that speak for one, with their weights.
UNCOUNTABLE = (
    "information advice knowledge wisdom intelligence love happiness anger fear joy sadness peace freedom democracy justice truth beauty courage "
    "water air oxygen hydrogen oil gas electricity gold silver iron steel plastic glass wood paper cloth leather cotton wool silk "
    "bread butter cheese milk coffee tea wine beer rice flour sugar salt pepper meat "
    "homework research work progress development education training experience practice exercise "
    "weather climate traffic pollution noise silence darkness light heat cold "
    "music art literature poetry drama history mathematics physics chemistry biology geography "
    "money currency cash business trade commerce industry tourism advertising marketing "
    "furniture equipment machinery luggage baggage clothing jewelry makeup software hardware "
    "news media propaganda publicity fun luck help time space energy power"
).split()
ABSTRACT = r"(ness|ity|tion|sion|ment|ence|ance|ics|ology|ography)$|^.{3,}ing$"
SUBSTANCE = r"^[a-z]+(ium|ine)$|ware$|^(learning|teaching|training|reading|writing)$"
UNCOUNTABLE_WEIGHTS = (0.9, 0.6, 0.2)
#: Endings and what a plural makes of them, in this order.
FOREIGN = [("us", "i"), ("is", "es"), ("on", "a"), ("um", "a"), ("ex", "ices"), ("ix", "ices")]
WH_WORDS = ["what", "who", "whom", "whose", "which", "when", "where", "why", "how"]


def replace_first(x: Column, pattern: str, by: str) -> Column:
    """Replace the first match only: the text is cut after it."""
    at = F.regexp_instr(x, F.lit(pattern))
    found = F.regexp_substr(x, F.lit(pattern))
    return F.when(at > 0, F.concat(F.substr(x, F.lit(1), at - 1), F.regexp_replace(found, pattern, by), F.substr(x, at + F.length(found)))).otherwise(x)


def negate(x: Column) -> Column:
    """The first verb in list order that occurs made negative once; a text that holds a negative word stays; otherwise "It is not true that ..."."""
    t = strip(x)
    out = F.concat(F.lit("It is not true that "), F.lower(t))
    for verb, negative in reversed(NEGATED.items()):
        pattern = rf"(?i)\b{verb}\b"
        out = F.when(t.rlike(pattern), replace_first(t, pattern, negative)).otherwise(out)
    return F.when(F.exists(F.array(*[F.lit(n) for n in NEGATIVE]), lambda n: F.contains(F.lower(x), n)), x).otherwise(out)


def yes_no_question(x: Column) -> Column:
    """The verb of a statement "subject verb rest" moved to the front; a question stays; otherwise "Is it true that ...?"."""
    t = strip(x)
    asked = F.endswith(t, F.lit("?")) | F.get(words(F.lower(t)), F.lit(0)).isin("what", "who", "where", "when", "why", "how", "which")
    forms = [
        (r"(?i)^(\w+)\s+(is|are|was|were|am)\s+(.+)$", "$2 $1 $3?"),
        (r"(?i)^(\w+)\s+(can|could|will|would|shall|should|may|might|must)\s+(.+)$", "$2 $1 $3?"),
        (r"(?i)^(\w+)\s+(has|have|had)\s+(.+)$", "$2 $1 $3?"),
        (r"(?i)^(\w+)\s+(\w+s)\s+(.*)$", "Does $1 $2 $3?"),
        (r"(?i)^(\w+)\s+(\w+ed)\s+(.*)$", "Did $1 $2 $3?"),
    ]
    out = F.concat(F.lit("Is it true that "), F.lower(t), F.lit("?"))
    for pattern, by in reversed(forms):
        q = F.regexp_replace(F.regexp_replace(t, pattern, by), r"\s+", " ")
        out = F.when(t.rlike(pattern), F.concat(F.upper(F.substring(q, 1, 1)), F.substr(q, F.lit(2)))).otherwise(out)
    return F.when(asked, x).otherwise(out)


def plural(x: Column) -> Column:
    """Irregular words, then foreign endings, then s, y, f, fe and o."""
    cut = lambda n: F.substr(x, F.lit(1), F.length(x) - n)
    out = (
        F.when(x.rlike("(s|sh|ch|x|z)$"), F.concat(x, F.lit("es")))
        .when(x.rlike("[^aeiou]y$"), F.concat(cut(1), F.lit("ies")))
        .when(x.rlike("f$"), F.concat(cut(1), F.lit("ves")))
        .when(x.rlike("fe$"), F.concat(cut(2), F.lit("ves")))
        .when(x.rlike("[^aeiou]o$"), F.concat(x, F.lit("es")))
        .otherwise(F.concat(x, F.lit("s")))
    )
    for end, new in reversed(FOREIGN):
        out = F.when(F.endswith(x, F.lit(end)), F.concat(cut(len(end)), F.lit(new))).otherwise(out)
    return _irregular(x, IRREGULAR, out)


def singular(x: Column) -> Column:
    """Irregular words, then ies, ves, es and s."""
    cut = lambda n: F.substr(x, F.lit(1), F.length(x) - n)
    out = (
        F.when(x.rlike("ies$") & (F.length(x) > 3), F.concat(cut(3), F.lit("y")))
        .when(x.rlike("ves$"), F.concat(cut(3), F.lit("f")))
        .when(x.rlike("(s|sh|ch|x|z|o)es$"), cut(2))
        .when(x.rlike("s$") & (F.length(x) > 1), cut(1))
        .otherwise(x)
    )
    return _irregular(x, {many: one for one, many in IRREGULAR.items()}, out)


def _irregular(x: Column, table: dict[str, str], otherwise: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(k) for k in table]), x).cast("int")
    return F.when(at > 0, F.get(F.array(*[F.lit(v) for v in table.values()]), at - 1)).otherwise(otherwise)


def countability(x: Column) -> Column:
    """struct(uncountable, confidence): weights of the list, an ending of abstract nouns, subjects or activities and one of substances, summed up to 1.

    More than half is uncountable; an empty or null word is countable with confidence 0.
    """
    t = F.lower(strip(F.coalesce(x, F.lit(""))))
    signs = (t.isin(UNCOUNTABLE), t.rlike(ABSTRACT), t.rlike(SUBSTANCE))
    total = sum((F.when(sign, F.lit(weight)).otherwise(F.lit(0.0)) for sign, weight in zip(signs, UNCOUNTABLE_WEIGHTS, strict=True)), F.lit(0.0))
    return F.struct((total > 0.5).alias("uncountable"), F.round(F.least(total, F.lit(1.0)), 6).alias("confidence"))


def tense(x: Column) -> Column:
    """"time aspect": past, present, future or future-in-past by the auxiliary; simple, continuous, perfect or perfect continuous by what follows."""
    t = F.lower(strip(x))
    has = lambda p: t.rlike(p)
    time = (
        F.when(has(r"\b(would|should)\b"), F.lit("future-in-past"))
        .when(has(r"\b(will|shall)\b"), F.lit("future"))
        .when(has(r"\b(was|were|had|did)\b|^(?!.*\b(have|has)\b).*\b[a-z]{3,}ed\b"), F.lit("past"))
        .otherwise(F.lit("present"))
    )
    aspect = (
        F.when(has(r"\b(have|has|had)\s+been\s+\w+ing\b"), F.lit("perfect continuous"))
        .when(has(r"\b(have|has|had)\s+\w+(ed|en|n|t)\b"), F.lit("perfect"))
        .when(has(r"\b(am|is|are|was|were|be)\s+\w+ing\b"), F.lit("continuous"))
        .otherwise(F.lit("simple"))
    )
    return F.concat_ws(" ", time, aspect)


def sentence_kind(x: Column) -> Column:
    """tag, wh, choice, yes_no, exclamation, imperative-free statement: by punctuation and words."""
    t = F.lower(strip(x))
    first = F.get(words(t), F.lit(0))
    question = F.endswith(t, F.lit("?"))
    return (
        F.when(question & t.rlike(r",\s*(is|are|was|were|do|does|did|has|have|can|will|would)(n't)?\s+\w+\?$"), F.lit("tag"))
        .when(question & first.isin(WH_WORDS), F.lit("wh"))
        .when(question & F.contains(t, F.lit(" or ")), F.lit("choice"))
        .when(question, F.lit("yes_no"))
        .when(F.endswith(t, F.lit("!")), F.lit("exclamation"))
        .otherwise(F.lit("statement"))
    )


def polarity(x: Column) -> Column:
    return F.when(F.lower(x).rlike(r"\b(not|no|never|none|neither|nor|nothing|nobody)\b|n't\b"), F.lit("negative")).otherwise(F.lit("positive"))


def part_of_speech(w: Column) -> Column:
    """By suffix: adverb, verb, adjective, number or noun."""
    low = F.lower(w)
    return (
        F.when(low.rlike(r"^\d+([.,]\d+)*$"), F.lit("number"))
        .when(low.rlike("ly$"), F.lit("adverb"))
        .when(low.rlike("(ing|ed|ize|ise|ify)$"), F.lit("verb"))
        .when(low.rlike("(ous|ful|able|ible|ive|less|al|ic)$"), F.lit("adjective"))
        .otherwise(F.lit("noun"))
    )


def question_word(kind: Column, label: Column) -> Column:
    """when for a year, else by the entity's kind."""
    return (
        F.when(label.rlike(r"\b(1[0-9]{3}|20[0-9]{2})\b"), F.lit("when"))
        .when(kind == "person", F.lit("who"))
        .when(kind == "place", F.lit("where"))
        .when(kind == "organization", F.lit("which organization"))
        .otherwise(F.lit("what"))
    )


def wh_question(statement: Column, focus: Column, word: Column) -> Column:
    """The focus entity replaced by the question word, with a question mark."""
    t = F.regexp_replace(strip(statement), r"[.?!]+$", "")
    return F.concat(F.replace(t, focus, word), F.lit("?"))


def grammar_shape(x: Column) -> Column:
    """struct(verb, preposition, shape) of a relation's label: its first word if that is a verb form, its last word if that is a preposition."""
    n = words(F.lower(x))
    first, last = F.get(n, F.lit(0)), F.element_at(n, -1)
    verb = first.isin(*NEGATED) | first.rlike("(ed|ing|s)$")
    preposition = last.isin("of", "in", "by", "to", "at", "on", "for", "from", "with", "as")
    shape = (
        F.when(verb & preposition, F.lit("verb preposition")).when(verb, F.lit("verb")).when(preposition, F.lit("noun preposition")).otherwise(F.lit("noun"))
    )
    return F.struct(F.when(verb, first).alias("verb"), F.when(preposition, last).alias("preposition"), shape.alias("shape"))


def analysis(x: Column) -> Column:
    """struct(kind, polarity, tense, words) of a sentence."""
    return F.struct(sentence_kind(x).alias("kind"), polarity(x).alias("polarity"), tense(x).alias("tense"), F.size(words(x)).alias("words"))


#: Openings that a paraphrase exchanges.
PARAPHRASES = [("is it true that", "is it the case that"), ("given that", "assuming that"), ("which of the following", "which one of these"), ("based on", "according to")]


def paraphrase(x: Column) -> Column:
    """The first known opening exchanged for its equivalent; others stay."""
    out = x
    for a, b in reversed(PARAPHRASES):
        out = F.when(F.contains(F.lower(x), F.lit(a)), replace_first(x, rf"(?i){a}", b)).otherwise(out)
    return out


def statement_of(question: Column, answer: Column) -> Column:
    """A yes/no question "is X Y?" as "X is Y" (negated for the answer no); a WH question with its word replaced by the answer."""
    q = F.regexp_replace(strip(question), r"\?+$", "")
    yes_no = F.regexp_replace(q, r"(?i)^(is|are|was|were|can|will|does|do|did)\s+(\w+)\s+(.*)$", "$2 $1 $3")
    wh = F.regexp_replace(q, r"(?i)^(what|who|where|when|which \w+)\b", "WH")
    said = F.lower(strip(answer))
    return (
        F.when(F.startswith(said, F.lit("no")), negate(yes_no)).when(F.startswith(said, F.lit("yes")), yes_no)
        .when(F.startswith(wh, F.lit("WH")), F.concat(strip(answer), F.substr(wh, F.lit(3)))).otherwise(q)
    )
