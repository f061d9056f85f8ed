"""Language rules: detection, dictionary translation, romanising, clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinflow.functions.text import is_blank, let, strip
from clinflow.lookups import language as words

URDU_LETTER = r"[؀-ۿ]"


def tokens(text: Column) -> Column:
    """Lower-case words of the text; punctuation parts words."""
    return F.split(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+")


def detect_language(text: Column) -> Column:
    """english, urdu or roman_urdu."""
    roman = let(tokens(text), lambda found: (
        (F.size(F.array_intersect(found, F.lit(words.ROMAN_URDU_HINTS))) >= 2) | F.arrays_overlap(found, F.lit(words.STRONG_HINTS))
    ))
    return (
        F.when(is_blank(text), F.lit("english"))
        .when(F.rlike(text, F.lit(URDU_LETTER)), F.lit("urdu"))
        .when(roman, F.lit("roman_urdu"))
        .otherwise(F.lit("english"))
    )


def _replace_all(text: Column, pairs) -> Column:
    return reduce(lambda done, pair: F.replace(done, F.lit(pair[0]), F.lit(pair[1])), pairs, F.lower(text))


def translate_phrases(text: Column, phrases: dict[str, str] = words.PHRASES) -> Column:
    """lower case, then longer phrases first; equally long ones in listing order."""
    return _replace_all(text, sorted(phrases.items(), key=lambda pair: -len(pair[0])))


def normalise_wording(text: Column, synonyms: dict[str, str] = words.TERM_SYNONYMS) -> Column:
    """lower case, then the replacements in listing order."""
    return _replace_all(text, synonyms.items())


def translate_to_english(text: Column, language: Column, supplied: Column | None = None) -> Column:
    """text in English as far as the dictionary goes; `supplied` wins where a translation was given."""
    by_rule = F.when(language == "roman_urdu", translate_phrases(text)).otherwise(text)
    if supplied is None:
        return by_rule
    return F.when(language == "english", text).otherwise(F.coalesce(supplied, by_rule))


def needs_translation(language: Column) -> Column:
    return language == "urdu"


def romanise(text: Column) -> Column:
    """F8: Urdu letters to Latin ones; other non-ASCII characters vanish."""
    letters = F.create_map(*[F.lit(item) for pair in words.LETTERS.items() for item in pair])
    pair, latin = words.LETTER_PAIR
    spelled = F.replace(text, F.lit(pair), F.lit(latin))
    mapped = F.transform(
        F.split(spelled, ""),
        lambda ch: F.coalesce(F.try_element_at(letters, ch), F.when(F.ascii(ch) < 128, ch), F.lit("")),
    )
    return strip(F.regexp_replace(F.array_join(mapped, ""), " {2,}", " "))


def clean_reply_terms(text: Column) -> Column:
    """English medical words in a Roman Urdu reply to their Roman Urdu form."""
    done = reduce(
        lambda value, pair: F.regexp_replace(value, "(?iU)" + pair[0], pair[1]), words.REPLY_TERMS, text
    )
    return F.regexp_replace(done, " {2,}", " ")


def is_english(text: Column, language: Column) -> Column:
    """not (Roman) Urdu, and more than 85 % of the letters are ASCII."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    latin = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    mostly = F.when(letters == 0, F.lit(True)).otherwise(latin / letters > 0.85)
    return (language == "english") & mostly


def reply_verdict(asked: Column, reply: Column) -> Column:
    """what to do with a reply given the language asked in."""
    def verdict(answered: Column) -> Column:
        return (
            F.when((asked == "english") | (F.coalesce(reply, F.lit("")) == ""), F.lit("keep"))
            .when(asked == answered, F.lit("keep"))
            .when((asked == "roman_urdu") & (answered == "urdu"), F.lit("romanise"))
            .when(is_english(reply, answered), F.lit("translate"))
            .otherwise(F.lit("keep"))
        )

    return let(detect_language(reply), verdict)
