"""Text kernel: column expressions for words, sentences, token estimates, identifiers and phrase tests.

Everything here is a built-in column expression, so it stays inside code generation; only byte lengths (``octet_length``) are
compared where the engine's limits are in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of retrieval, of snippets and of evaluation are three different lists.
RETRIEVAL_STOPS = sorted(set("a about an and are as at be been being between but by can could did do does for from had has have how if in into is may might must no nor not of on or shall should so than that the then these this those to was were what when where which who whom why will with would".split()))
SNIPPET_STOPS = sorted(set("about after also been before being between both could does each from have into just more most only other over same should some such than that their them then there these they this those very were what when where which will with would your".split()))
EVAL_STOPS = sorted(set("and are como con cuál cómo del desde dónde entre está for fue hay how las los más para pero por que qué ser sobre son sus también that the this tiene una was were what when where which who with".split()))
QUESTION_WORDS = ["describe", "how", "list", "name", "what", "when", "where", "which", "why"]
EXHAUSTIVE = sorted(["comprehensive", "complete list", "full list", "entire list", "enumerate", "every ", "every single", "each of", "all the", "all of the", "all references", "list all", "list each", "list every", "name all", "what are all"])
NOT_FOUND = sorted({f"not {x}" for x in "available present covered discussed addressed specified mentioned found".split()} | {f"does not {x}" for x in "include provide discuss address mention contain".split()} | {f"no {x}" for x in "evidence data relevant mention information".split()} | {"unable to determine", "unable to find", "cannot be determined", "cannot determine", "insufficient information"})
HEDGES = ["cannot determine", "might", "not enough information", "possibly", "unclear"]
EXTERNAL = ["it is commonly known", "based on my knowledge", "in general"]
OUTSIDE = sorted([*EXTERNAL, "usually", "typically", "from my understanding", "as everyone knows"])
NEGATIONS = ["the document says the opposite", "this contradicts", "contrary to", "however, the document states otherwise"]
CONTRADICTIONS = ["inconsistent", "contradicts", "on the other hand", "however, it also"]
UNCERTAIN = ["not enough context", "insufficient information", "cannot determine", "it's unclear", "i'm not sure"]
CITATION_WORDS = sorted("anexo article capítulo clause figura figure page paragraph página section sección tabla table".split())

BODIES = ["AS", "ASTM", "BS", "EN", "IEC", "IEEE", "ISO", "MIL-STD", "NIST"]
_NUMBERED = r"\s*-?\s*[0-9][0-9A-Za-z_.\-]*"
#: Identifier patterns; (?-i) parts are case-sensitive, word bounds are ASCII so that other engines agree.
B0, B1 = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
STANDARD = "(?i)(?:" + "|".join(sorted(BODIES, key=len, reverse=True)) + ")" + _NUMBERED
MORE_STANDARDS = "(?i)(?:ANSI|DIN|JIS|NF|NTP|UNE)" + _NUMBERED
PART = r"(?i)(?:P/?N[:\s]*)?[A-Z]{1,3}-?[0-9]{3,6}"
REVISION = r"(?i)rev\.?\s*[0-9A-Z]{1,5}"
ADDRESS = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
MODEL = "[A-Z]{2,4}-[A-Z]{1,4}"
VOLTAGE = r"(?i)[0-9]+(?:\.[0-9]+)?\s*v(?:ac|dc)?"
VOLTAGE_STRICT = r"(?i)[0-9]+(?:\.[0-9]+)?\s*v[ad]c"
MEASURE = r"[0-9]+(?:\.[0-9]+)?\s*(?:kHz|MHz|GHz|Hz|kPa|MPa|PSIG|psig|tokens?|dB|db|mm|cm|kg|lb|°C|°F|m)"
RATING = r"(?i)IP\s*[0-9]{2}"

#: Order matters: the first spelling of an identifier stays.
INGEST_PATTERNS = [STANDARD, PART, REVISION, B0 + ADDRESS + B1, B0 + MODEL + B1, VOLTAGE + B1, B0 + MEASURE + B1]
ANSWER_PATTERNS = [STANDARD, PART, REVISION, B0 + MODEL + B1, VOLTAGE + B1, RATING + B1, MORE_STANDARDS]
ROUTE_PATTERNS = [PART, STANDARD, B0 + ADDRESS + B1, B0 + MODEL + B1, REVISION, VOLTAGE_STRICT + B1]

#: Characters with a meaning in full-text queries.
SPECIALS = "\"*()+-^:?[]{}!.,;"
EDGE_MARKS = ".,;:!?\"'()[]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row. A column that a lambda names is computed anew for every element, and the optimizer puts columns of an
    earlier step back into the lambda; a variable of a lambda isn't."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(text: Column) -> Column:
    """Without white space at either end (all kinds, not spaces only). A regular expression would also cut before a final line separator such as U+2028."""
    return F.trim(text, F.lit(" \t\n\r\f"))


def fields(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda x: x != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")).cast("bigint")


def token_estimate(words: Column) -> Column:
    """Words times 1.3, rounded up, in double arithmetic."""
    return F.ceil(words.cast("double") * F.lit(1.3).cast("double")).cast("bigint")


def sentences(text: Column) -> Column:
    """Cut after . ? ! before a space, line break, tab or the end; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.?!])(?=[ \n\t]|$)"), trimmed), lambda x: x != "")


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(text, separator), trimmed), lambda x: x != "")


def without_specials(text: Column) -> Column:
    return F.translate(text, SPECIALS, "")


def any_of(text: Column, phrases: list[str]) -> Column:
    """Whether a lower-case text contains any phrase."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def count_of(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases a lower-case text contains."""
    out = F.lit(0)
    for p in phrases:
        out = out + F.contains(text, F.lit(p)).cast("int")
    return out


def literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def significant_terms(question: Column) -> Column:
    """Retrieval terms: without marks, lower case, over two bytes, no stop words, each once."""
    return F.array_distinct(F.filter(fields(F.lower(without_specials(question))), lambda w: (F.octet_length(w) > 2) & ~F.array_contains(literals(RETRIEVAL_STOPS), w)))


def full_text_query(question: Column) -> Column:
    """The phrase of all words, then each word that matters, joined by OR."""
    words = fields(without_specials(question))
    kept = F.filter(words, lambda w: (F.octet_length(w) > 2) & ~F.array_contains(literals(RETRIEVAL_STOPS), F.lower(w)))
    phrase = F.concat(F.lit('"'), F.concat_ws(" ", words), F.lit('"'))
    parts = F.when(F.size(words) > 1, F.concat(F.array(phrase), kept)).otherwise(kept)
    return F.when(F.size(words) == 0, question).when(F.size(parts) == 0, F.concat_ws(" OR ", words)).otherwise(F.concat_ws(" OR ", parts))


def has_identifier(text: Column) -> Column:
    out = F.lit(False)
    for p in ROUTE_PATTERNS:
        out = out | text.rlike(p)
    return out


def is_exhaustive(question: Column) -> Column:
    """A question for everything: a phrase that says so, or many words with two question words."""
    low = F.lower(question)
    words = fields(low)
    return any_of(low, EXHAUSTIVE) | ((F.size(words) >= 15) & (F.size(F.filter(words, lambda w: w.isin(QUESTION_WORDS))) >= 2))


def may_have_identifier(text: Column) -> Column:
    """Every pattern of identifiers needs a digit, ``rev`` or capitals around a hyphen; most texts have none of them, which is found sooner than that no pattern matches."""
    return text.rlike("[0-9]") | F.contains(F.lower(text), F.lit("rev")) | text.rlike("[A-Z]-[A-Z]")


def identifiers(text: Column, patterns: list[str] = INGEST_PATTERNS) -> Column:
    """All matches, pattern after pattern."""
    found = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(f"({p})") if not p.startswith("(?i)") else F.lit(f"(?i)({p[4:]})"), F.lit(1)), trimmed) for p in patterns])
    return F.when(may_have_identifier(text), found).when(text.isNotNull(), F.array().cast("array<string>"))


def answer_words(text: Column) -> Column:
    """Snippet words: letters and digits, at least four bytes, no stop words, each once."""
    words = F.split(F.lower(text), r"[^\p{L}\p{Nd}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 4) & ~F.array_contains(literals(SNIPPET_STOPS), w)))


def evaluation_words(text: Column) -> Column:
    """Evaluation words, repeats kept: lower case, edge marks off, over two bytes, no stop words."""
    edge = r"""^[.,;:!?"'()\[\]]+|[.,;:!?"'()\[\]]+$"""
    words = F.transform(fields(F.lower(text)), lambda w: F.regexp_replace(w, edge, ""))
    return F.filter(words, lambda w: (F.octet_length(w) > 2) & ~F.array_contains(literals(EVAL_STOPS), w))


def normal(text: Column) -> Column:
    """Model output normalised: kinds of spaces to a space, kinds of hyphens to a hyphen, zero-width characters off."""
    out = F.regexp_replace(text, "[\\u200B\\u200C\\u200D\\uFEFF]", "")
    out = F.regexp_replace(out, "[\\u2010-\\u2014]", "-")
    return F.regexp_replace(out, "[\\t\\n\\r\\f\\x0B\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]", " ")


def without_thoughts(text: Column) -> Column:
    """Without <think> blocks; an open one runs to the end."""
    return trimmed(F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|$)", ""))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
