"""Scalar text functions as Column -> Column. All run inside the JVM; none is a UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
SMALL_WORDS = ["a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "by", "from", "and", "or", "but"]
NAMESPACES = ["category", "template", "file", "user"]
YES_STARTS = ["yes", "yeah", "yep", "correct", "true", "right", "absolutely", "certainly", "indeed"]
NO_STARTS = ["no", "not", "false", "wrong", "incorrect", "never", "neither", "none"]
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall "
    "can of in to for with on at from by as into through during before after above below between under again further "
    "then once here there when where why how all each few more most other some such no nor not only own same so than too "
    "very just and but if or because until while this that these those it its"
).split()
OVERLAP_STOP_WORDS = "the a an is are was were be been of in at on to for".split()
UNSUITABLE = ["label", "description", "alias", "sameas", "wikidata", "wikipedia", "image", "url", "identifier"]
PLACE_WORDS = ["city", "country", "state", "province", "region", "town", "village", "island", "mountain", "river", "sea", "ocean", "continent", "港", "kong"]
GROUP_WORDS = ["company", "corporation", "inc", "ltd", "university", "institute", "organization", "association", "foundation", "group"]
BARE_WORDS = ["yes", "no", "true", "false", "maybe", "unknown", "uncertain", "correct", "incorrect", "none", "n/a", "na", "ok"]
CLAIM_WORDS = (
    "is are was were be been being has have had opposite located encoded adjacent child parent subordinate higher lower rank "
    "synonym basionym pronounced below above contributes married member part belongs derived studied coextensive coordinate "
    "instance described contains includes crossing level tier valid invalid follows means called yes no true false not cannot option"
).split()
DETERMINERS = (
    "a an the this that these those my your his her its our their some any many much few little several all most every each both either neither"
).split()
SINGULAR_S = ["bus", "class", "glass", "pass", "gas", "this", "yes"]
QUESTION_OPENINGS = [
    "is it true that", "is it correct that", "is it the case that", "what is", "where is", "when is", "who is", "which is", "how many",
    "how much", "how does", "why does",
]
DIFF_STOP = (
    "a an the of is are was were to in on at from and or that this it for with by as be been being has have had do does did not no yes "
    "next crossing upstream downstream first second"
).split()
PLACEHOLDER = (
    r"\b(?:Person|People|Place|City|Town|Organization|Organisation|Org|Company|Co|Corp|Corporation|Institute|Institution|Object|Item|Thing|Entity)"
    r"(?:_[A-Za-z]+|\d+)\b"
)
ANSWER_TOKENS = (
    "yes no true false correct incorrect right wrong unknown none sí si cierto falso verdadero ja nein nee neen richtig falsch wahr "
    "juist onjuist waar onwaar"
).split()
ENTAILMENT = "entailment entail entails yes same consistent paraphrase equivalent e".split()
CONTRADICTION = "contradiction contradict contradicts no opposite inconsistent conflict c".split()
NEUTRAL = "neutral neu unknown unrelated insufficient n".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(x: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def words(x: Column | str) -> Column:
    """Runs of non-space characters; an empty array for a null or blank text."""
    return F.filter(F.split(F.coalesce(_c(x), F.lit("")), r"\s+"), lambda w: w != "")


def any_of(x: Column, parts: Sequence[str]) -> Column:
    """Does the text contain one of the parts?"""
    return F.exists(literal_array(parts), lambda p: F.contains(x, p))


def starts_any(x: Column, parts: Sequence[str]) -> Column:
    return F.exists(literal_array(parts), lambda p: F.startswith(x, p))


def present(x: Column | str) -> Column:
    """The text, or null where it is missing: null, blank, 'nan' or 'None'."""
    t = strip(x)
    return F.when((t != "") & ~t.isin("nan", "None"), t)


def is_error(x: Column | str) -> Column:
    return F.startswith(F.coalesce(_c(x), F.lit("")), F.lit("ERROR:"))


def capitalize(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))


def standard_label(x: Column | str) -> Column:
    """A label in title case with small words low, its namespace capitalised, COVID-19 as it is."""
    t = strip(x)
    head = F.lower(F.substring_index(t, ":", 1))
    spaced = F.contains(t, F.lit(":")) & head.isin(NAMESPACES)
    rest = F.when(spaced, strip(F.substr(t, F.instr(t, ":") + 1))).otherwise(t)
    parts = words(rest)
    title = F.transform(
        parts,
        lambda w, i: F.when(F.lower(w) == "covid-19", F.lit("COVID-19"))
        .when((i > 0) & F.lower(w).isin(SMALL_WORDS), F.lower(w))
        .otherwise(capitalize(w)),
    )
    named = F.when(rest == "COVID-19", rest).when(F.size(parts) > 1, F.array_join(title, " ")).otherwise(capitalize(rest))
    return F.when(spaced, F.concat(capitalize(head), F.lit(":"), named)).otherwise(named)


def entry_labels(x: Column | str, least: int = 0) -> Column:
    """Labels of a JSON list of "id: label | description"; entries without a colon are skipped, labels under ``least`` characters too."""
    items = F.filter(F.coalesce(F.from_json(_c(x), "array<string>"), F.array().cast("array<string>")), lambda s: F.contains(s, F.lit(":")))
    labels = F.transform(items, lambda s: strip(F.substring_index(F.substr(s, F.instr(s, ":") + 1), "|", 1)))
    return F.filter(labels, lambda s: F.length(s) >= least)


def name_tokens(x: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit("([A-Za-z][A-Za-z0-9_]*)"), F.lit(1)))


def placeholders(original: Column | str, mutated: Column | str, stop: Sequence[str]) -> Column:
    """Words of the mutated text that the original lacks, without stop words and single letters, sorted."""
    new = F.array_except(name_tokens(mutated), name_tokens(original))
    return F.sort_array(F.filter(new, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(list(stop))))


def rename_map(original: Column | str, mutated: Column | str, labels: Column, stop: Sequence[str]) -> Column:
    """Placeholder -> label: new words paired by position with the labels that are gone."""
    new = placeholders(original, mutated, stop)
    gone = F.filter(labels, lambda v: F.contains(_c(original), v) & ~F.contains(_c(mutated), v))
    n = F.least(F.size(new), F.size(gone))
    return F.map_from_arrays(F.slice(new, F.lit(1), n), F.slice(gone, F.lit(1), n))


def unify_entities(x: Column | str, surfaces: Column, pattern: str | None = None, mark: str = "ENT") -> Column:
    """Replace pattern matches, then every surface form, longest first, by one mark."""
    t = F.regexp_replace(_c(x), pattern, mark) if pattern else _c(x)
    longest = F.array_sort(F.array_distinct(surfaces), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, t, lambda acc, s: F.when((s != "") & (s != mark), F.replace(acc, s, F.lit(mark))).otherwise(acc))


def strip_option(x: Column | str) -> Column:
    """Remove an option letter A-D at the beginning, at most twice."""
    pattern = r"(?i)^\s*\**\s*(?:option\s+)?[A-D]\s*[.):\-](?:\*+\s*|\s+)"
    return F.regexp_replace(F.regexp_replace(_c(x), pattern, ""), pattern, "")


def mutation_of_name(x: Column | str) -> Column:
    """The mutation that a file name holds, in a fixed order of preference."""
    name = F.lower(F.substring_index(_c(x), "/", -1))
    out = F.lit(None).cast("string")
    for m in ("body_permutation", "body_augmentation", "entity_rename"):
        out = F.when(F.contains(name, F.lit(m)), F.lit(m)).otherwise(out)
    return out


def rule_predicates(x: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"\b(P\d+)\b"), F.lit(1))


def rule_variables(x: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"(\?\w+)"), F.lit(1))


def rule_features(x: Column | str) -> dict[str, Column]:
    """Counts of atoms (words // 3), distinct variables and predicates, and uses of the most used variable."""
    x = F.coalesce(_c(x), F.lit(""))
    parts = F.split(x, "=>")
    two = F.size(parts) == 2
    body = F.when(two, F.get(parts, F.lit(0))).otherwise(x)
    head = F.when(two, F.get(parts, F.lit(1))).otherwise(F.lit(""))
    atoms = lambda c: F.floor(F.size(words(c)) / 3).cast("int")
    variables = rule_variables(x)
    reuse = F.array_max(F.transform(F.array_distinct(variables), lambda v: F.size(F.filter(variables, lambda w: w == v))))
    return {
        "body_atom_count": atoms(body),
        "head_atom_count": atoms(head),
        "total_atom_count": atoms(body) + atoms(head),
        "unique_variable_count": F.size(F.array_distinct(variables)),
        "unique_predicate_count": F.size(F.array_distinct(rule_predicates(x))),
        "max_variable_reuse": F.coalesce(reuse, F.lit(0)),
    }


def rule_pattern(x: Column | str) -> Column:
    """Variables renamed ?V1, ?V2 ... by first occurrence.

    The text is cut at its variables and put together again, so a name that is
    the beginning of another cannot be confused with it.
    """
    x = F.coalesce(_c(x), F.lit(""))
    variables = rule_variables(x)
    order = F.array_distinct(variables)
    between = F.split(x, r"\?\w+", -1)
    new = F.transform(variables, lambda v: F.concat(F.lit("?V"), F.array_position(order, v).cast("string")))
    return F.concat(F.get(between, F.lit(0)), F.array_join(F.transform(new, lambda v, i: F.concat(v, F.get(between, i + 1))), ""))


def entity_features(mapping: Column | str, instance: Column | str, labels: Column | str) -> dict[str, Column]:
    """Distinct entities of a mapping and an instance; mean length and words of labels; whether any has marks or digits."""
    values = F.map_values(F.from_json(_c(mapping), "map<string,string>"))
    ids = F.regexp_extract_all(F.coalesce(_c(instance), F.lit("")), F.lit(r"\b(Q\d+)\b"), F.lit(1))
    found = F.array_union(F.coalesce(values, F.array().cast("array<string>")), ids)
    own = entry_labels(labels)
    mean = lambda f: F.when(
        F.size(own) > 0, F.aggregate(F.transform(own, f), F.lit(0.0), lambda a, v: a + v) / F.size(own)
    ).otherwise(F.lit(0.0))
    return {
        "entity_count": F.size(found),
        "avg_label_length": mean(lambda s: F.length(s).cast("double")),
        "avg_word_count": mean(lambda s: F.size(words(s)).cast("double")),
        "has_special_chars": F.exists(own, lambda s: s.rlike("[-/_&]")),
        "has_numbers": F.exists(own, lambda s: s.rlike("[0-9]")),
    }


def question_type(x: Column | str) -> Column:
    t = F.lower(_c(x))
    return F.when(t.isin("yes_no", "true_false"), F.lit("yes_no")).when(t.isin("multiple_choice", "wh_question"), t).otherwise(F.lit("unknown"))


def count_of(x: Column, part: str) -> Column:
    """Non-overlapping occurrences of one character."""
    return F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))


def question_complexity(x: Column | str) -> dict[str, Column]:
    x = _c(x)
    low = F.lower(x)
    return {
        "length_chars": F.length(x),
        "length_words": F.size(words(x)),
        "num_commas": count_of(x, ","),
        "num_parentheses": count_of(x, "(") + count_of(x, ")"),
        "num_question_marks": count_of(x, "?"),
        "has_and": F.contains(low, F.lit(" and ")),
        "has_or": F.contains(low, F.lit(" or ")),
        "has_given_that": F.contains(low, F.lit("given that")),
        "num_sentences": count_of(x, ".") + count_of(x, "?"),
    }


def answer_complexity(x: Column | str) -> dict[str, Column]:
    x = _c(x)
    sentences = F.greatest(F.lit(1), count_of(x, ".") + count_of(x, "?"))
    paragraphs = (F.length(x) - F.length(F.replace(x, F.lit("\n\n"), F.lit("")))) / 2 + 1
    return {
        "answer_length_chars": F.length(x),
        "answer_length_words": F.size(words(x)),
        "answer_num_sentences": sentences,
        "answer_num_paragraphs": paragraphs.cast("int"),
        "answer_avg_sentence_length": F.size(words(x)) / sentences,
    }


def sentiment(x: Column | str) -> Column:
    """'yes', 'no' or null: by how the answer begins, else by words among its first ten."""
    t = F.lower(strip(x))
    first = F.slice(words(t), 1, 10)
    text = F.array_join(first, " ")
    return (
        F.when(starts_any(t, YES_STARTS), F.lit("yes"))
        .when(starts_any(t, NO_STARTS), F.lit("no"))
        .when(any_of(text, ["yes", "true", "correct", "right"]), F.lit("yes"))
        .when(F.array_contains(first, "no") | any_of(text, ["not ", "false", "wrong"]), F.lit("no"))
    )


def same_yes_no(a: Column | str, b: Column | str) -> Column:
    """Equal sentiments; equal texts where neither has one."""
    x, y = sentiment(a), sentiment(b)
    return (
        F.when(x.isNotNull() & y.isNotNull(), x == y)
        .when(x.isNotNull() | y.isNotNull(), F.lit(False))
        .otherwise(F.lower(strip(a)) == F.lower(strip(b)))
    )


def same_answer(a: Column | str, b: Column | str) -> Column:
    """Equal; 80 % of the shorter one's terms in the longer; half of all key words shared; or 60 % of the first one's."""
    x, y = F.lower(strip(a)), F.lower(strip(b))
    first = F.length(x) <= F.length(y)
    terms = lambda t: F.array_distinct(words(F.regexp_replace(t, r"[^\w\s]", "")))
    short, long = terms(F.when(first, x).otherwise(y)), terms(F.when(first, y).otherwise(x))
    keys = lambda t: F.array_distinct(F.filter(words(t), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))
    k, m = keys(x), keys(y)
    shared = F.size(F.array_intersect(k, m))
    return (
        F.when(x == y, F.lit(True))
        .when((F.size(short) > 0) & (F.size(F.array_intersect(short, long)) >= F.size(short) * 0.8), F.lit(True))
        .when((F.size(k) == 0) | (F.size(m) == 0), F.lit(False))
        .when(shared / F.size(F.array_union(k, m)) >= 0.5, F.lit(True))
        .otherwise(shared >= F.size(k) * 0.6)
    )


def bigrams(x: Column) -> Column:
    n = F.length(x)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(x, i, F.lit(2))))).otherwise(
        F.array().cast("array<string>")
    )


def expected_answer(answer: Column | str, expected: Column | str, threshold: float = 0.6) -> Column:
    """struct(consistent, similarity, method) of an answer against the expected one.

    An expected yes or no is looked for as such; otherwise containment, shared
    words, and finally shared pairs of characters decide.
    """
    a, e = F.lower(strip(answer)), F.lower(strip(expected))
    verdict = lambda ok, s, how: F.struct(F.lit(ok).alias("consistent"), F.lit(s).alias("similarity"), F.lit(how).alias("method"))
    begins = lambda *p: starts_any(F.substring(a, 1, 100), p)
    quoted = lambda w: begins(w, f'"{w}', f"'{w}")
    yes = (
        F.when(quoted("yes") | begins("correct. ", "true. ", "indeed. "), verdict(True, 1.0, "yes_no_detection"))
        .when(begins("no", "false", "incorrect"), verdict(False, 0.0, "yes_no_detection"))
        .when(any_of(a, ["yes", "indeed", "correct. ", "true. "]), verdict(True, 1.0, "yes_no_detection"))
        .otherwise(verdict(False, 0.5, "yes_no_detection"))
    )
    no = (
        F.when(quoted("no") | begins("false. ", "incorrect. "), verdict(True, 1.0, "yes_no_detection"))
        .when(begins("yes", "true", "correct"), verdict(False, 0.0, "yes_no_detection"))
        .when(any_of(a, ["no", "not ", "is not", "are not", "false", "incorrect"]), verdict(True, 1.0, "yes_no_detection"))
        .otherwise(verdict(False, 0.5, "yes_no_detection"))
    )
    content = lambda t: F.filter(F.array_distinct(words(t)), lambda w: ~w.isin(OVERLAP_STOP_WORDS))
    x, y = content(a), content(e)
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    some = F.size(y) > 0
    p, q = bigrams(e), bigrams(a)
    pairs = F.when((F.size(p) > 0) & (F.size(q) > 0), F.size(F.array_intersect(p, q)) / F.least(F.size(p), F.size(q))).otherwise(F.lit(0.0))
    scored = lambda ok, s, how: F.struct(ok.alias("consistent"), s.alias("similarity"), F.lit(how).alias("method"))
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(e, F.lit("")) == ""), verdict(False, 0.0, "missing_answer"))
        .when(e == "yes", yes)
        .when(e == "no", no)
        .when(F.contains(a, e) | F.contains(e, a), verdict(True, 1.0, "exact_match"))
        .when(some & (jaccard >= threshold), scored(F.lit(True), jaccard, "word_overlap"))
        .when(some & (F.size(F.array_except(y, x)) == 0), verdict(True, 0.8, "subset_match"))
        .otherwise(scored(pairs >= threshold * 0.8, pairs, "bigram_overlap"))
    )


def numbered_items(x: Column | str) -> Column:
    """Items of a list of lines without their numbers and bullets."""
    lines = F.transform(F.split(F.coalesce(_c(x), F.lit("")), "\n"), strip)
    plain = F.transform(lines, lambda v: strip(F.regexp_replace(F.regexp_replace(v, r"^\d+[.):\-]\s*", ""), r"^- ", "")))
    return F.filter(plain, lambda v: v != "")


def verification(x: Column | str) -> Column:
    """'Yes', 'No', 'Not Sure' or null: the exact label, then the first five words, then anywhere."""
    t = F.lower(strip(x))
    head = F.array_join(F.slice(words(t), 1, 5), " ")
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit(None))
        .when(t.isin("not sure", "not sure.", "unsure"), F.lit("Not Sure"))
        .when(F.startswith(head, F.lit("not sure")), F.lit("Not Sure"))
        .when(F.startswith(head, F.lit("yes")), F.lit("Yes"))
        .when(F.startswith(head, F.lit("no")) & ~F.contains(head, F.lit("not sure")), F.lit("No"))
        .when(F.contains(t, F.lit("not sure")), F.lit("Not Sure"))
        .when(F.contains(t, F.lit("yes")), F.lit("Yes"))
        .when(F.contains(t, F.lit("no")), F.lit("No"))
    )


def consistency_verdict(x: Column | str) -> Column:
    """True, False or null from a judge's text: its first word, then words anywhere."""
    t = F.lower(strip(x))
    first = F.get(words(t), F.lit(0))
    has = lambda p: F.contains(t, F.lit(p))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("boolean"))
        .when(first.isin("yes", "consistent", "right", "correct"), F.lit(True))
        .when(first.isin("no", "inconsistent", "wrong", "not"), F.lit(False))
        .when(has("not") & has("consistent"), F.lit(False))
        .when(has("consistent") | has("yes"), F.lit(True))
        .when(has("no") | has("wrong"), F.lit(False))
    )


def boolean_verdict(x: Column | str) -> Column:
    t = F.lower(strip(present(x)))
    first = F.get(F.split(t, r"[\s,.;:!?]+", 2), F.lit(0))
    has = lambda p: F.contains(t, F.lit(p))
    return (
        F.when(first.isin("true", "yes", "correct", "affirmative", "right"), F.lit(True))
        .when(first.isin("false", "no", "incorrect", "wrong", "negative"), F.lit(False))
        .when(t.rlike(r"\bnot (?:true|the case)\b") | has("is false"), F.lit(False))
        .when(has("is true"), F.lit(True))
        .when(has("false"), F.lit(False))
        .when(has("true"), F.lit(True))
    )


def proposition(x: Column | str) -> Column:
    """P of a question "... is it true that P?"; null without one."""
    found = F.regexp_extract(F.coalesce(_c(x), F.lit("")), r"(?is)\bis it (?:true|the case) that\s+(.+?)\?\s*$", 1)
    return F.when(found != "", strip(F.regexp_replace(strip(found), r"^\.+|\.+$", "")))


def option_index(x: Column | str, n: Column) -> Column:
    """0-based index of an answer that names an option letter A-D; null if it names none or none so far."""
    t = strip(present(x))
    letter = F.regexp_extract(t, r"^\(?([A-Da-d])\)?[.\):\s]", 1)
    letter = F.when(letter != "", letter).otherwise(F.regexp_extract(t, r"^([A-Da-d])$", 1))
    index = F.ascii(F.upper(letter)) - 65
    return F.when((letter != "") & (index < n), index)


def translation_valid(text: Column | str, source: Column | str, least: int = 8) -> Column:
    """Is a translation present, no answer token, no option, with Latin letters, still a question if it was one, and not too short?"""
    s = strip(text)
    token = r"(?i)^\s*(?:" + "|".join(ANSWER_TOKENS) + r"|[a-d1-9])\s*[.!]?\s*$"
    option = r"^\s*[A-Da-d]\s*[.):]\s+\S"
    bad = (
        (s == "") | F.startswith(F.upper(s), F.lit("ERROR:")) | s.rlike(token) | s.rlike(option) | ~s.rlike("[A-Za-zÀ-ÖØ-öø-ÿ]")
        | (F.endswith(F.rtrim(F.coalesce(_c(source), F.lit(""))), F.lit("?")) & ~F.endswith(s, F.lit("?"))) | (F.length(s) < least)
    )
    return F.coalesce(~bad, F.lit(False))


def nli_label(raw: Column | str) -> Column:
    """struct(label, confidence, entailment, contradiction, neutral) from a judge's text that holds a JSON object somewhere.

    Labels have aliases; an unknown one is neutral. Confidence is clamped to
    0..1, 0.9 where it is missing; the other labels share the rest.
    """
    body = F.regexp_extract(F.coalesce(_c(raw), F.lit("")), r"(?s)(\{.*\})", 1)
    found = F.from_json(body, "map<string,string>")
    field = F.coalesce(*[F.element_at(found, k) for k in ("label", "relation", "judgment", "result", "answer", "prediction")])
    word = F.regexp_replace(F.get(words(F.lower(field)), F.lit(0)), r"[.,;:!]+$", "")
    label = (
        F.when(word.isin(ENTAILMENT), F.lit("entailment")).when(word.isin(CONTRADICTION), F.lit("contradiction")).otherwise(F.lit("neutral"))
    )
    given = F.coalesce(*[F.element_at(found, k).try_cast("double") for k in ("confidence", "conf", "score")], F.lit(0.9))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), given))
    rest = (1 - conf) / 2
    of = lambda name: F.when(label == name, conf).otherwise(rest).alias(name)
    return F.struct(label.alias("label"), conf.alias("confidence"), of("entailment"), of("contradiction"), of("neutral"))


def clean_conclusion(x: Column | str) -> Column:
    """Without emphasis marks, a leading "conclusion:", paired quotes and runs of white space."""
    c = strip(x)
    for mark in (r"\*\*(.+?)\*\*", r"\*(.+?)\*", r"__(.+?)__"):
        c = F.regexp_replace(c, mark, "$1")
    c = F.regexp_replace(c, r"(?i)^(conclusion|final conclusion|最终结论|结论|answer)\s*[:：]?\s*", "")
    for a, b in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’")):
        c = F.when(F.startswith(c, F.lit(a)) & F.endswith(c, F.lit(b)) & (F.length(c) >= 2), strip(F.substr(c, F.lit(2), F.length(c) - 2))).otherwise(c)
    return F.regexp_replace(strip(c), r"\s+", " ")


def bare_conclusion(x: Column | str) -> Column:
    """Too short, a lone answer word, at most three words, or without any word that claims something."""
    t = strip(F.regexp_replace(strip(x), r"[.!?]+$", ""))
    tokens = F.regexp_extract_all(F.lower(t), F.lit("([a-z]+)"), F.lit(1))
    bare = (F.length(t) < 15) | F.lower(t).isin(BARE_WORDS) | (F.size(words(t)) <= 3) | ~F.arrays_overlap(tokens, literal_array(CLAIM_WORDS))
    return F.coalesce(bare, F.lit(True))


def last_sentence(x: Column | str, most: int = 300) -> Column:
    """The last sentence of 15 characters or more that is no question; else the last one."""
    parts = F.filter(F.split(strip(x), r"(?<=[.!?])\s+|\n+"), lambda p: strip(p) != "")
    parts = F.transform(parts, lambda p: strip(F.regexp_replace(strip(p), r"^\*+|\*+$", "")))
    good = F.filter(parts, lambda p: (F.length(p) >= 15) & ~F.endswith(p, F.lit("?")))
    pick = lambda a: F.substring(F.element_at(a, -1), 1, most)
    return F.when(F.size(good) > 0, pick(good)).when(F.size(parts) > 0, pick(parts)).otherwise(F.lit(""))


def tail_window(x: Column | str, size: int = 4000) -> Column:
    """The last ``size`` characters, from the first paragraph break in 200 or else sentence break in 150; short texts whole."""
    x = _c(x)
    begin = F.length(x) - size
    find = lambda part, reach: F.instr(F.substr(x, begin + 1, F.lit(reach)), part)
    paragraph, sentence = find("\n\n", 200), find(". ", 150)
    start = begin + F.when(paragraph > 0, paragraph + 1).when(sentence > 0, sentence + 1).otherwise(F.lit(0))
    return F.when(F.length(x) > size, strip(F.substr(x, start + 1))).otherwise(x)


def locate_conclusion(answer: Column | str, conclusion: Column | str) -> Column:
    """struct(start, end) of the conclusion, case aside; about the end of the answer if it is not there."""
    a, c = _c(answer), _c(conclusion)
    at = F.position(F.lower(c), F.lower(a))
    start = F.when(at > 0, at - 1).otherwise(F.greatest(F.lit(0), F.length(a) - 2 * F.length(c)))
    end = F.when(at > 0, at - 1 + F.length(c)).otherwise(F.length(a))
    return F.struct(start.alias("start"), end.alias("end"))


def nli_verdict(entailment: Column, contradiction: Column, neutral: Column, empty: Column) -> Column:
    """struct(label, consistent): the largest score, ties in this order; neutral counts as consistent, an empty text as inconsistent."""
    label = (
        F.when((entailment >= contradiction) & (entailment >= neutral), F.lit("entailment"))
        .when(contradiction >= neutral, F.lit("contradiction"))
        .otherwise(F.lit("neutral"))
    )
    return F.struct(F.when(empty, F.lit("empty")).otherwise(label).alias("label"), (~empty & (label != "contradiction")).alias("consistent"))


def join_premises(parts: Column) -> Column:
    """p; "p, and that q"; "p, that q, and that r"."""
    n = F.size(parts)
    last = F.element_at(parts, -1)
    front = F.array_join(F.slice(parts, F.lit(1), n - 1), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, last).otherwise(F.concat(front, F.lit(", and that "), last))


def plural_phrase(x: Column | str) -> Column:
    """Joined by "and" with three or more words, or ending in s, but for a few words."""
    n = words(x)
    last = F.lower(F.element_at(n, -1))
    return (F.array_contains(n, "and") & (F.size(n) >= 3)) | (F.endswith(last, F.lit("s")) & ~last.isin(SINGULAR_S))


def with_article(x: Column | str) -> Column:
    """The phrase with "a" or "an"; as it is after a determiner, for identifiers, names, phrases with a colon and plurals."""
    t = strip(x)
    first = F.lower(F.get(words(t), F.lit(0)))
    keep = (
        first.isin(DETERMINERS) | t.rlike(r"^(LOC\d+|[A-Za-z0-9]*\d[A-Za-z0-9]*_\w+|[A-Z]{2,}_\w*\d\w*)$")
        | t.rlike("^\\p{Lu}") | F.contains(t, F.lit(":")) | plural_phrase(t)
    )
    return F.when(t == "", t).when(keep, t).when(first.rlike("^[aeiou]"), F.concat(F.lit("an "), t)).otherwise(F.concat(F.lit("a "), t))


def judgement(x: Column | str) -> Column:
    """Y, N or U from the line "Validity judgment: ..."; E for an error."""
    said = F.upper(strip(F.regexp_extract(F.coalesce(_c(x), F.lit("")), r"(?m)^Validity judgment:(.*)$", 1)))
    return (
        F.when(is_error(x), F.lit("E")).when(said.isin("Y", "YES", "是", "合理", "VALID"), F.lit("Y"))
        .when(said.isin("N", "NO", "否", "不合理", "INVALID"), F.lit("N")).otherwise(F.lit("U"))
    )


def split_context(x: Column | str) -> Column:
    """struct(context, question): cut before the first opening in list order that occurs after the beginning."""
    x = _c(x)
    low = F.lower(x)
    out = F.lit(0)
    for p in reversed(QUESTION_OPENINGS):
        at = F.instr(low, p)
        out = F.when(at > 1, at).otherwise(out)
    context = F.when(out > 1, strip(F.substr(x, F.lit(1), out - 1))).otherwise(F.lit(""))
    return F.struct(context.alias("context"), F.when(out > 1, strip(F.substr(x, out))).otherwise(x).alias("question"))


def percent(rate: Column) -> Column:
    return F.when(rate.isNull(), F.lit("N/A")).otherwise(F.concat(F.regexp_replace(F.format_number(rate * 100, 2), ",", ""), F.lit("%")))


def training_answer(kind: Column, answer: Column, options: Column, reason: Column) -> Column:
    """Reasoning and answer by question type; a multiple choice answer becomes its letter."""
    at = F.array_position(F.transform(options, strip), strip(answer)).cast("int")
    said = (
        F.when(kind == "yes_no", F.when(answer == "true", F.lit("Yes")).when(answer == "false", F.lit("No")).otherwise(answer))
        .when(kind == "true_false", F.when(answer == "true", F.lit("True")).when(answer == "false", F.lit("False")).otherwise(answer))
        .when((kind == "multiple_choice") & (at > 0), F.char(F.lit(64) + at))
        .otherwise(answer)
    )
    because = F.when(strip(reason) != "", F.concat(F.lit("Reasoning: Based on the given rule '"), reason, F.lit("', I can determine the answer.\n\n"))).otherwise(F.lit(""))
    return F.concat(F.coalesce(because, F.lit("")), F.lit("Answer: "), said)


def smart_lower(x: Column | str) -> Column:
    """First letter low unless the first word is an acronym or holds digits; "Template: x" and "Category: x" without the space."""
    t = F.regexp_replace(_c(x), r"\b(Template|Category)\s*:\s+", "$1:")
    first = F.get(words(t), F.lit(0))
    keep = first.rlike(r"^[A-Z]{2,}|[0-9:]")
    return F.when(keep, t).otherwise(F.concat(F.lower(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))


def entity_kind(x: Column | str) -> Column:
    """place, organization, person (two or more capitalised words) or object, by keywords."""
    low = F.lower(_c(x))
    parts = words(x)
    person = (F.size(parts) >= 2) & F.forall(parts, lambda w: (F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1)) & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1)))
    return (
        F.when(any_of(low, PLACE_WORDS), F.lit("place")).when(any_of(low, GROUP_WORDS), F.lit("organization")).when(person, F.lit("person")).otherwise(F.lit("object"))
    )


def split_premise(x: Column | str, last: bool = True) -> Column:
    """struct(premise, main): cut at the last (or first) comma outside parentheses; no premise without one.

    Parts between commas are counted for open parentheses, so nothing walks the
    text character by character.
    """
    x = _c(x)
    parts = F.split(x, ",", -1)
    opened = lambda a: count_of(a, "(") - count_of(a, ")")
    before = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ","))
    cuts = F.filter(F.slice(before, F.lit(1), F.size(parts) - 1), lambda a: opened(a) == 0)
    at = F.length(F.element_at(cuts, -1 if last else 1))
    some = F.size(cuts) > 0
    return F.struct(
        F.when(some, strip(F.substr(x, F.lit(1), at))).otherwise(F.lit("")).alias("premise"),
        F.when(some, strip(F.substr(x, at + 2))).otherwise(x).alias("main"),
    )


def answer_spans(x: Column | str) -> Column:
    """Candidate answers of a text, each once: runs of capitalised words, quoted parts, parts in parentheses."""
    x = F.coalesce(_c(x), F.lit(""))
    runs = F.regexp_extract_all(x, F.lit(r"(\b\p{Lu}\w*(?:\s+\p{Lu}\w*)*)"), F.lit(1))
    quoted = F.regexp_extract_all(x, F.lit('"([^"]+)"'), F.lit(1))
    inside = F.regexp_extract_all(x, F.lit(r"\(([^)]+)\)"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(runs, quoted, inside), strip))
