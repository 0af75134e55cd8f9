"""Fixed values of receipt reading: keyword rules in their order, metadata patterns, and header words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Section, words that tell it, confidence in hundredths; the first that matches wins.
KEYWORDS = [
    ("subtotal", r"sub\s*total|food\s*total|net\s*amount|net\s*total|items?\s*total", 96),
    ("tax", r"tax(?:es)?|[csi]?gst|vat|service\s*tax", 96),
    ("service_charge", r"service\s*(?:charge|fee)|delivery\s*(?:charge|fee)|pack(?:ing|aging)\s*(?:charge|fee)?|container\s*charge", 96),
    ("discount", r"discount|promo(?:tion)?|coupon|less", 96),
    ("adjustment", r"round(?:ing)?\s*off|rounding|adjustment", 96),
    ("total", r"grand\s*total|amount\s*due|total\s*invoice(?:\s*value)?|final\s*total|net\s*payable|total", 92),
    ("payment", r"cash|card|visa|mastercard|upi|payment|paid|change|tender|balance", 90),
    ("footer", r"thank\s*you|visit\s*again|guest\s*check|comments?|feedback|terms|prices?\s*incl", 90),
]
SUMMARY_SECTIONS = ["subtotal", "tax", "service_charge", "discount", "adjustment", "total", "payment"]
# Fixed values. Patterns of lines that are never items: body, and whether words begin and end at its edges.
METADATA = [
    (r"table|tbl|cover|cvr|guest|server|waiter|waitress|cashier|steward|counter|host", True, True),
    (r"gstin|tin|fssai|cin|pan|vat\s*no", True, True),
    (r"phone|ph\.?\s*no|tel|mobile|contact|e-?mail|www|http", True, True),
    (r"address|street|road|floor|nagar|layout|opp\.?|near", True, True),
    (r"sequence|terminal|machine|m\/c|register|till|device", True, True),
    (r"date|dated|time", True, True),
    (r"(?:bill|invoice|order|token|receipt|check|kot|slip)\s*(?:no|num|number|#)", True, False),
    (r"(?:no|num|number)\s*[.:#]", True, False),
    (r"#\s*:?\s*[A-Za-z0-9_]", False, False),
    (r"\d{1,4}[-/]\d{1,2}[-/]\d{2,4}", True, True),
    (r"\d{1,2}:\d{2}(?::\d{2})?", True, True),
]
# Fixed values. Words of a header row: the subject with a column, or one of each pair; totals of quantities; payments that are totals.
SUBJECT, COLUMN = r"items?|descriptions?|particulars?|product", r"qty|quantity|rate|price|amount|amt|value"
PAIR_FIRST, PAIR_SECOND = r"qty|quantity|oty|qly", r"rate|price|amount|amt|value"
TOTAL_QTY = r"^\s*total\s+(?:qty|quantity)"
PAID = r"cash|paid|amount\s*due"
SYMBOLS = "₹$€£"

# A token with a run of six letters and digits, and both a letter and a digit; classes list their characters, as the JVM looks those up in a table.
EDGE, DIGITS, LETTERS = r" \t\n\x0B\f\r,;|()\[\]{}", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
IDENTIFIER = f"(?<![^{EDGE}])(?=[^{EDGE}{DIGITS}]*+[{DIGITS}])(?=[^{EDGE}{LETTERS}]*+[{LETTERS}])[^{EDGE}]*?[{DIGITS}{LETTERS}]{{6}}"
# Words are ASCII words, whatever stands beside them.
BEGIN, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def worded(body: str, begin: bool = True, end: bool = True) -> str:
    """The pattern for Spark's engine."""
    return f"(?i){BEGIN if begin else ''}(?:{body}){END if end else ''}"


def worded_sql(column: str, body: str, begin: bool = True, end: bool = True) -> str:
    """The test in an engine whose word boundaries are ASCII."""
    edge = "\\b"
    return f"regexp_matches({column}, '(?i){edge if begin else ''}(?:{body}){edge if end else ''}')"


def keyword(text: Column) -> Column:
    """section and confidence of the first rule that matches, or null."""
    found = F.lit(None).cast("struct<section: string, confidence: int>")
    for section, body, confidence in reversed(KEYWORDS):
        found = F.when(text.rlike(worded(body)), F.struct(F.lit(section).alias("section"), F.lit(confidence).alias("confidence"))).otherwise(found)
    return found


def looks_like_identifier(text: Column) -> Column:
    """A token with a run of six letters and digits, and both a letter and a digit."""
    return text.rlike(IDENTIFIER)


def by_first(*bodies: str) -> str:
    """One pattern of alternatives, of which those with the same first letter stand together: whether one matches stays the same, and
    only a few of them are tried anywhere."""
    parts: list[str] = [""]
    depth = 0
    for c in "|".join(bodies):
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    groups: dict[str, list[str]] = {}
    for part in parts:
        groups.setdefault(part[0] if re.match("[a-z](?![?*+{])", part) else part, []).append(part)
    return "|".join(f"{first}(?:{'|'.join(x[1:] for x in group)})" if len(group) > 1 else group[0] for first, group in groups.items())


#: All patterns of metadata in one: those that begin and end at a word's edges, those that only begin there, and the rest.
METADATA_PATTERN = "(?i){0}(?:(?:{2}){1}|{3})|{4}".format(BEGIN, END, *(by_first(*(body for body, *edges in METADATA if edges == kind)) for kind in ([True, True], [True, False], [False, False])))


def is_metadata(text: Column) -> Column:
    return text.rlike(METADATA_PATTERN) | looks_like_identifier(text)


PAIR = rf"(?i){BEGIN}(?:{PAIR_FIRST}){END}.*{BEGIN}(?:{PAIR_SECOND}){END}"


def is_item_header(text: Column) -> Column:
    # the second word of a pair is a column's too, and most lines have none
    return text.rlike(worded(COLUMN)) & (text.rlike(worded(SUBJECT)) | text.rlike(PAIR))


def has_name_word(text: Column) -> Column:
    return text.rlike("[A-Za-z]{3,}")


#: What a line can be, by code: section, confidence in hundredths. The header row that opens the items is code 1.
CLASSES = [("header", 86), ("header", 92), *((s, c) for s, _, c in KEYWORDS), ("header", 80), ("item", 62), ("footer", 50), ("unknown", 25)]
ITEM_HEADER = 1


#: The code of metadata, and of the first class that depends on what came above.
METADATA_CODE = 2 + len(KEYWORDS)
OPEN = METADATA_CODE + 1


def in_small(text: Column) -> Column:
    """The text with its ASCII letters small."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def reading(text: Column, small: Column | None = None) -> Column:
    """What a line says by itself: the code of its class by the strict order of the rules, OPEN if `seen` decides; whether it
    could be an item or, by its letters, a footer; and whether it has a word.

    The rules ignore the case of ASCII letters only. small is in_small(text), a column of its own where many lines are read: patterns are
    matched faster so.
    """
    small = in_small(text) if small is None else small
    has = lambda pattern: small.rlike(pattern.removeprefix("(?i)").replace(BEGIN, r"(?<!\w)").replace(END, r"(?!\w)"))
    word = F.lit(OPEN)
    for code, (_, body, _) in reversed(list(enumerate(KEYWORDS, 2))):
        word = F.when(has(worded(body)), code).otherwise(word)
    # most lines have no keyword: one pattern of all tells
    any_word = has(worded(by_first(*(body for _, body, _ in KEYWORDS))))
    header = has(worded(by_first(COLUMN))) & (has(worded(SUBJECT)) | has(PAIR))
    code = F.when(has(f"{TOTAL_QTY}{END}"), 0).when(header, ITEM_HEADER).when(any_word, word).when(has(METADATA_PATTERN) | looks_like_identifier(text), METADATA_CODE).otherwise(OPEN)
    named = has_name_word(text)
    # a word has the two letters that an item needs; a footer needs four
    return F.struct(code.alias("code"), (named & text.rlike("[0-9]")).alias("itemlike"), text.rlike("(?:[A-Za-z][^A-Za-z]*+){4}").alias("wordy"), named.alias("named"))


def settled(code: Column, itemlike: Column, wordy: Column, seen_summary: Column) -> Column:
    """The code of a line's class, knowing whether a summary row came above."""
    return F.when(code < OPEN, code).when(itemlike & ~seen_summary, OPEN).when(seen_summary & wordy, OPEN + 1).otherwise(OPEN + 2)


def section_of(code: Column) -> Column:
    return F.get(F.array(*(F.lit(s) for s, _ in CLASSES)), code)


def confidence_of(code: Column) -> Column:
    return F.get(F.array(*(F.lit(c) for _, c in CLASSES)), code)
