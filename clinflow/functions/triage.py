"""Chat triage expressions: greeting, emergency, medicine question, keyword."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinflow.functions.text import contains_any, let, strip
from clinflow.lookups import triage as words


def greeting_core(message: Column) -> Column:
    return F.rtrim(F.lower(strip(message)), F.lit("!?., "))


def is_greeting(message: Column) -> Column:
    """the whole message is a greeting, or an open greeting starts or ends it."""
    def matches(core: Column) -> Column:
        opened = F.exists(
            F.lit(words.OPEN_GREETINGS),
            lambda g: F.startswith(core, F.concat(g, F.lit(" "))) | F.endswith(core, F.concat(F.lit(" "), g)),
        )
        return core.isin(words.GREETINGS + words.OPEN_GREETINGS) | opened

    return let(greeting_core(message), matches)


def greeting_kind(message: Column, language: Column) -> Column:
    """Reply key of a greeting, null for other messages."""
    return F.when(is_greeting(message), F.concat(F.lit("greeting_"), language))


def spaced(message: Column) -> Column:
    return F.replace(F.lower(message), F.lit("_"), F.lit(" "))


def present_keywords(message: Column) -> Column:
    """Keywords that are part of the message, in listing order."""
    return let(spaced(message), lambda text: F.filter(F.lit(words.KEYWORDS), lambda word: F.contains(text, word)))


def _any_group_within(present: Column) -> Column:
    groups = F.array(*[F.lit(group) for group in words.EMERGENCY_GROUPS])
    return let(present, lambda held: F.exists(groups, lambda group: F.size(F.array_except(group, held)) == 0))


def is_emergency(message: Column) -> Column:
    """F13 as is: a group counts only when all its words are listed keywords."""
    return _any_group_within(present_keywords(message))


def is_emergency_all_words(message: Column) -> Column:
    """F13 with every word of the groups looked for in the text."""
    group_words = F.lit(sorted({word for group in words.EMERGENCY_GROUPS for word in group}))
    held = let(spaced(message), lambda text: F.filter(group_words, lambda word: F.contains(text, word)))
    return _any_group_within(held)


def asks_for_medicine(message: Column) -> Column:
    """F14."""
    return contains_any(F.lower(message), words.MEDICINE_WORDS)


def first_keyword(message: Column) -> Column:
    """first listed keyword in the message, spelled with blanks or underscores."""
    def hits(plain: Column) -> Column:
        blanks = F.replace(plain, F.lit("_"), F.lit(" "))
        return let(blanks, lambda text: F.filter(F.lit(words.KEYWORDS), lambda word: (
            F.contains(text, word) | F.contains(plain, F.replace(word, F.lit(" "), F.lit("_")))
        )))

    return F.get(let(F.lower(message), hits), F.lit(0))


def medicine_card(disease: Column, otc: Column, prescription: Column, notice: str = words.REPLIES["notice"]) -> Column:
    """headed lists of the medicines, with a notice."""
    def section(title: str, items: Column) -> Column:
        lines = F.transform(items, lambda name: F.concat(F.lit("  • "), name))
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(lines, "\n"), F.lit("\n")))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Recommended medications for "), disease, F.lit(":\n")),
        section("Over-the-counter", otc),
        section("Prescription", prescription),
        F.lit(notice),
    )
