"""Amounts and quantities in text: whole minor units, with digit look-alikes corrected next to digits only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabsplit.functions.columns import let
from tabsplit.functions.rules import BEGIN, END, SYMBOLS

# The largest safe whole number, and below, numeric runs, currencies before an amount and the tails of names.
SAFE = 2**53 - 1
#: Stand-ins for a corrected zero and one until all neighbours have been looked at.
ZERO, ONE = "\ue000", "\ue001"
#: A numeric run of a line without geometry, with the currency before it.
RUN = r"(?i)(?:Rs\.?|INR|USD|EUR|GBP|[$])?\s*-?[0-9OIL]+(?:[,.']\s*[0-9OIL]+)?"

#: The runs of RUN again, as the first group those with a digit that touch no letter on either side (the space that a run may begin with
#: parts it from what stands before). The others are passed over whole, so that nothing begins inside them.
#: Classes list their characters, as the JVM looks those up in a table, and so does the guard before all.
DIGITS, SPACES, LETTERS = "0123456789", r" \t\n\x0B\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CURRENCY = r"(?:[Rr][Ss]\.?|[Ii][Nn][Rr]|[Uu][Ss][Dd]|[Ee][Uu][Rr]|[Gg][Bb][Pp]|[$])?"
RUN_LISTED = rf"(?>{CURRENCY}[{SPACES}]*-?[{DIGITS}OILoil]+(?:[,.'][{SPACES}]*[{DIGITS}OILoil]+)?)"
FREE = rf"(?=[{SPACES}{DIGITS}OILRUEGoilrueg$-])(?:(?:(?=[{SPACES}])|(?<![{LETTERS}]))(?={CURRENCY}[{SPACES}]*-?[OILoil]*(?:[{DIGITS}]|[,.'][{SPACES}]*[OILoil]*[{DIGITS}]))({RUN_LISTED})(?![{LETTERS}])|{RUN_LISTED})"
#: The plainest amounts: their cents are their digits.
PLAIN, WHOLE = r"^(?:Rs\. *|\$)?-?[0-9]{1,13}\.[0-9]{2}\z", r"^[0-9]{1,13}\z"
#: Runs that are all as plain, or whole, set apart by bars.
ALL_PLAIN = r"^(?: *(?:Rs\. *|\$)?-?[0-9]{1,13}(?:\.[0-9]{2})?(?:\||\z))+\z"
#: A token that looks like an amount, or like one whose decimals stand in the next token.
LIKE = rf"^(?:(?i:Rs\.?|INR|USD|EUR|GBP|[{SYMBOLS}])\s*)? *-?[0-9OoIl]+(?:[.,'][0-9OoIl]+)*"
AMOUNT_LIKE, OPEN_LIKE = (rf"{LIKE}{tail}%?(?:\r\n|[\n\r\x{{85}}\x{{2028}}\x{{2029}}])? *\z" for tail in ("", "[.,]?"))

#: What reading leaves at the ends of a name.
NAME_TAILS = (r"^[0-9]+\s+", r"\s+\[?[Ii]\s*=?\s*$", r"[\s:;\-=\[\]]+$", r"\s+[Ii](?:\s+[^A-Za-z0-9]+)*$", r"\s+[a-z]$")


def corrected(text: Column) -> Column:
    """O and I or l beside a digit, point or comma become 0 and 1."""
    beside = lambda letters: f"(?<=[0-9.,])[{letters}]|[{letters}](?=[0-9.,])"
    marked = F.regexp_replace(F.regexp_replace(text, beside("Oo"), ZERO), beside("Il"), ONE)
    return F.translate(marked, ZERO + ONE, "01")


def parse_money(text: Column) -> Column:
    """Minor units, or null. The last point or comma is decimal if one or two characters follow it.

    Each step's value is bound once: an expression that is used several times is otherwise copied into every use. Plain amounts
    take a short way.
    """

    def cents(parts: Column) -> Column:
        # more than 16 digits are beyond a safe whole number anyhow
        major = parts["major"]
        whole = F.expr("0L") + F.when(F.length(major) > 16, F.lit(None)).otherwise(F.when(major == "", F.lit("0")).otherwise(major)).cast("long")
        return F.try_add(F.try_multiply(whole, F.lit(100).cast("long")), F.rpad(parts["fraction"], 2, "0").cast("long"))

    def signed(trimmed: Column, value: Column) -> Column:
        fraction = F.regexp_extract(value, r"[.,]([0-9]{1,2})$", 1)
        parts = let(fraction, lambda f: F.struct(f.alias("fraction"), F.translate(F.when(f == "", value).otherwise(F.left(value, F.length(value) - F.length(f))), ",.", "").alias("major")))
        negative = trimmed.rlike(rf"(?i)\(|-|{BEGIN}(?:discount|less){END}")
        return let(parts, lambda p: let(cents(p), lambda c: F.when(c <= SAFE, F.when(negative, -c).otherwise(c))))

    read = lambda trimmed: let(F.regexp_replace(corrected(trimmed), r"[^0-9,.]", ""), lambda value: F.when(value.rlike("[0-9]"), signed(trimmed, value)))
    plain = lambda trimmed: F.when(trimmed.contains("-"), -F.translate(trimmed, "Rs. $-", "").cast("long")).otherwise(F.translate(trimmed, "Rs. $", "").cast("long"))
    return let(F.trim(text), lambda trimmed: F.when(trimmed.rlike(WHOLE), trimmed.cast("long") * 100).when(trimmed.rlike(PLAIN), plain(trimmed)).when(trimmed.rlike("[0-9OoIl]"), read(trimmed)))


def parse_quantity(text: Column) -> Column:
    """A whole count from 1 to 1000, or null; the first comma counts as a point."""
    whole = F.regexp_extract(F.regexp_replace(F.trim(text), "^([^,]*),", "$1."), r"^(\d+)(?:\.0+)?$", 1)
    number = lambda value: F.when((value != "") & (F.length(value) < 10), value).cast("long")
    return let(let(whole, number), lambda n: F.when((n > 0) & (n <= 1000), n))


def is_rate_annotation(text: Column) -> Column:
    return text.rlike(r"^@?[0-9]+(?:\.[0-9]+)?%$") & ~text.rlike(f"[{SYMBOLS}]")


def is_amount_like(text: Column) -> Column:
    return text.rlike(AMOUNT_LIKE)


def label_of(text: Column) -> Column:
    """A line without currency signs, numbers and separators."""
    label = F.regexp_replace(F.translate(text, SYMBOLS, ""), r"[-+]?[0-9.,]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(label, r"[:;|()\[\]{}-]+", " "), r"\s+", " "))


def clean_item_name(text: Column) -> Column:
    """A row's text without its numbers and the tails that reading leaves behind."""
    name = F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?:[{SYMBOLS}]\s*)?[0-9]+(?:[.,][0-9]+)?", " "), r"\s+", " "))
    for tail in NAME_TAILS:
        name = F.regexp_replace(name, tail, "")
    return F.trim(name)


def merged_tokens(tokens: Column) -> Column:
    """Tokens (text, x, width, confidence) with a decimal split over two of them joined: "650." and "00"; the first one's place stays."""
    opens = lambda i: F.get(tokens, i)["text"].rlike(r"[0-9][.,]$") & F.coalesce(F.get(tokens, i + 1)["text"].rlike(r"^[0-9]{2}$"), F.lit(False))
    taken = lambda i: (i > 0) & opens(i - 1)
    places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: ~taken(i))
    text = lambda i: F.when(opens(i), F.concat(F.get(tokens, i)["text"], F.get(tokens, i + 1)["text"])).otherwise(F.get(tokens, i)["text"])
    right = lambda i: (F.get(tokens, i)["x"] + F.get(tokens, i)["width"]).cast("double")
    one = lambda i: F.struct(text(i).alias("text"), right(i).alias("right"), F.get(tokens, i)["confidence"].cast("double").alias("confidence"), i.alias("place"))
    return F.when(F.size(tokens) > 0, F.transform(places, one)).otherwise(F.array().cast("array<struct<text: string, right: double, confidence: double, place: int>>"))


def token_amounts(tokens: Column) -> Column:
    """The amounts among a line's tokens, in order: text, cents, right edge, confidence and the token's place in the line.

    They are those of merged_tokens(), but found in one pass over the tokens: the next token is looked at only where one ends in a
    point or comma, the last one only where one could be its decimals.
    """
    text = lambda i: F.get(tokens, i)["text"]

    def amount(t: Column, i: Column) -> Column:
        own = t["text"]
        whole = F.when(own.rlike(r"[0-9][.,]$") & F.coalesce(text(i + 1).rlike(r"^[0-9]{2}$"), F.lit(False)), F.concat(own, text(i + 1)))
        taken = (i > 0) & own.rlike(r"^[0-9]{2}$") & F.coalesce(text(i - 1).rlike(r"[0-9][.,]$"), F.lit(False))
        value = F.when(own.rlike(r"[.,]\s*\z"), whole).when(~taken & ~is_rate_annotation(own), own)
        one = lambda v, c: F.struct(v.alias("text"), c.alias("cents"), (t["x"] + t["width"]).cast("double").alias("right"), t["confidence"].cast("double").alias("confidence"), i.alias("place"))
        return F.when(own.rlike(OPEN_LIKE), let(value, lambda v: let(parse_money(v), lambda c: F.when(c.isNotNull(), one(v, c)))))

    return F.filter(F.transform(tokens, amount), lambda a: a.isNotNull())


def text_runs(text: Column) -> Column:
    """The numeric runs with a digit that touch no letter on either side and are no larger than an amount can be."""
    found = F.array_remove(F.regexp_extract_all(text, F.lit(FREE), F.lit(1)), "")
    # a run too large has over 13 characters, so over 6 in one of its two parts
    return F.when(text.rlike(f"[{DIGITS}OILoil]{{7}}"), F.filter(found, lambda r: parse_money(r).isNotNull())).otherwise(found)


def run_cents(runs: Column) -> Column:
    """parse_money() of text_runs(). Where all are plain they are read together, without a function of arrays, which is interpreted."""
    bars = F.array_join(runs, "|")
    digits = F.translate(F.regexp_replace(bars, r"(?<![0-9.])([0-9]++)(?![.])", "$1.00"), "Rs. $", "")
    return F.when(F.size(runs) == 0, F.array().cast("array<long>")).when(bars.rlike(ALL_PLAIN), F.split(digits, r"\|").cast("array<long>")).otherwise(F.transform(runs, parse_money))


def text_amounts(text: Column) -> Column:
    """The amounts of a line without geometry, text and cents."""
    return F.transform(text_runs(text), lambda r: F.struct(r.alias("text"), parse_money(r).alias("cents")))
