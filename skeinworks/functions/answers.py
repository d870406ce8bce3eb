"""Answer normalisation: abstentions, yes/no, dates, numbers and plain words.

Plain ASCII answers without digits are decided in column expressions. What is left
(digits, other alphabets, answers with a lead-in) is read by small scanners on Arrow
batches: dates by the shape of their tokens, numbers part by part, abstentions by
membership in a finite set of phrases that a few slots span.
"""

from __future__ import annotations

import calendar
import datetime
import unicodedata
from collections.abc import Iterable
from decimal import Decimal
from itertools import product

import pandas as pd
import regex as re
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The label of an abstention, and phrases that mean the question cannot be answered.
ABSTAIN = "INSUFFICIENT_INFORMATION"
PHRASES = (
    "cannot answer", "cannot be answered", "cannot determine", "cannot be determined", "do not know", "i do not know", "i dont know", "insufficient context", "insufficient evidence",
    "insufficient info", "insufficient information", "not enough context", "not enough evidence", "not enough info", "not enough information", "unable to answer", "unable to determine", "unknown",
)
# Further phrases, one choice a slot; an empty choice leaves the slot out.
SLOTS = (
    (
        ("insufficient", "not enough"), ("information", "info", "context", "evidence"),
        ("", *(f"to {verb}{what}" for verb in ("answer", "determine", "resolve") for what in ("", " the question", " the answer"))),
    ),
    (
        ("", "i"), ("cannot", "cant", "unable to"), ("answer", "determine"),
        ("", *(f"{link}{the}{given} {what}" for link in ("in", "from", "based on") for the in ("", " the") for given in ("", " provided") for what in ("context", "information", "evidence"))),
    ),
)
# What may stand before an answer.
LEADS = ("answer is", "answer was", "answer to the question is", "answer to the question was")
# First words of a yes and of a no, and words left out of plain text.
YES = ("yes", "yeah", "yep", "true", "affirmative")
NO = ("no", "nope", "false", "negative")
ARTICLES = ("a", "an", "the")
# Scale words as powers of ten; percent signs, currency signs and currency words of numbers.
SCALES = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12, "mn": 6, "bn": 9, "tn": 12, "k": 3, "m": 6, "b": 9, "t": 12}
PERCENT = ("percentage points", "percentage point", "percent", "%")
SIGNS = "$€£¥"
MONEY = ("dollars", "dollar", "euros", "euro", "pounds", "pound", "usd", "eur", "gbp")
ORDINALS = ("st", "nd", "rd", "th")

ABSTENTIONS = frozenset(PHRASES) | {" ".join(filter(None, choice)) for slots in SLOTS for choice in product(*slots)}
MONTHS = {name.lower(): i for i in range(1, 13) for name in (calendar.month_name[i], calendar.month_abbr[i])}

# Which part each token of a date is, by the shape of the text: Y four digits, D one or two, M a month's name.
SHAPES = (
    {f"Y{a}D{b}D": "ymd" for a, b in (("-", "-"), *product("/.", repeat=2))}
    | {f"D{a}D{b}Y": "??y" for a, b in product("/.-", repeat=2)}
    | {f"M D{comma} Y": "mdy" for comma in ("", ",")}
    | {f"D M{comma} Y": "dmy" for comma in ("", ",")}
    | {"Y-D": "ym", "M Y": "my", "Y": "y"}
)
_PIECE = re.compile(r"\d+|[^\W\d]+|\s+|.")
_LEAD_WORD = re.compile(r"\s*(\w+)")
_MARK = re.compile(r"[\p{P}\p{S}]")


def without_lead(s: str | None) -> str:
    """The answer proper: without a lead-in such as "the answer is:"."""
    s = (s or "").strip()
    said, ends, at = [], [], 0
    while len(said) < 7 and (m := _LEAD_WORD.match(s, at)):
        at = m.end()
        said.append(m[1].lower())
        ends.append(at)
    skip = 1 if said[:1] == ["the"] else 0
    for lead in LEADS:
        words = lead.split()
        if said[skip : skip + len(words)] == words:
            rest = s[ends[skip + len(words) - 1] :].lstrip()
            return (rest[1:] if rest[:1] in (":", "-") else rest).lstrip()
    return s


def phrase(s: str) -> str:
    """Case-folded words joined by single spaces; apostrophes join what they stand between."""
    folded = unicodedata.normalize("NFKC", s).casefold().replace("’", "'").replace("'", "")
    return " ".join(re.findall(r"[^\W_]+", folded))


def abstains(s: str | None) -> bool:
    return phrase(without_lead(s)) in ABSTENTIONS


def yes_no(s: str | None) -> str | None:
    said = phrase(without_lead(s))
    first = said.partition(" ")[0]
    if said in ABSTENTIONS:
        return None
    return "yes" if first in YES else "no" if first in NO else None


def _shaped(text: str) -> tuple[str, list[int], bool]:
    """Shape of a text, the numbers its letters stand for, and whether it goes on after a full ISO day."""
    shape, values = "", []
    for piece in _PIECE.findall(text):
        if shape == "Y-D-D" and (piece.isspace() or piece.startswith("t")):
            return shape, values, True
        if piece.isdecimal():
            shape += {1: "D", 2: "D", 4: "Y"}.get(len(piece), "#")
            values.append(int(piece))
        elif piece in ORDINALS and shape[-1:] in ("D", "Y", "#"):
            continue
        elif piece in MONTHS:
            shape += "M"
            values.append(MONTHS[piece])
        else:
            shape += " " if piece.isspace() else piece
    return shape, values, False


def date_of(s: str | None, day_first: bool = False) -> str | None:
    """Date in ISO form at the precision given; month first where a numeric date is ambiguous, unless ``day_first``."""
    answer = without_lead(s)
    if phrase(answer) in ABSTENTIONS:
        return None
    shape, values, _ = _shaped(unicodedata.normalize("NFKC", answer).casefold().strip(" .,\t\r\n"))
    parts = SHAPES.get(shape.strip(" .,"))
    if parts is None:
        return None
    if parts == "??y":
        a, b, _ = values
        parts = "dmy" if a > 12 or b <= 12 and day_first else "mdy"
    got = dict(zip(parts, values))
    if "m" not in got:
        return f"{got['y']:04d}"
    try:
        whole = datetime.date(got["y"], got["m"], got.get("d", 1)).isoformat()
    except ValueError:
        return None
    return whole if "d" in got else whole[:7]


def _take(text: str, options: Iterable[str]) -> tuple[str, str | None]:
    """The first option that the text begins with after white space, and what follows it."""
    bare = text.lstrip()
    for option in options:
        if bare.startswith(option):
            return bare[len(option) :], option
    return text, None


def number_of(s: str | None) -> str | None:
    """Number in plain decimal form, with separators, scale words, currencies and accounting brackets undone."""
    answer = without_lead(s)
    if phrase(answer) in ABSTENTIONS:
        return None
    rest = " ".join(unicodedata.normalize("NFKC", answer).casefold().replace("−", "-").split())
    owed = len(rest) > 1 and rest[0] == "(" and rest[-1] == ")"
    rest, sign = _take((rest[1:-1] if owed else rest).lstrip(SIGNS + " "), "+-")
    rest = rest.lstrip()
    length = next((i for i, c in enumerate(rest) if not (c.isdecimal() or c == ",")), len(rest))
    groups, rest = rest[:length].split(","), rest[length:]
    if not groups[0] or len(groups) > 1 and (len(groups[0]) > 3 or any(len(g) != 3 for g in groups[1:])):
        return None
    digits = "".join(groups)
    if rest[:1] == "." and rest[1:2].isdecimal():
        length = next((i for i, c in enumerate(rest[1:], 1) if not c.isdecimal()), len(rest))
        digits, rest = digits + rest[:length], rest[length:]
    rest, scale = _take(rest, SCALES)
    rest, percent = _take(rest, PERCENT)
    rest, _ = _take(rest, MONEY)
    if rest.strip(" .!?"):
        return None
    value = Decimal(digits).scaleb(SCALES[scale] if scale else 0).normalize()
    minus = "-" if value and (owed or sign == "-") else ""
    return f"{minus}{value:f}{'%' if percent else ''}" if value else f"0{'%' if percent else ''}"


def plain_words(s: str | None) -> str:
    """Case-folded words without punctuation, symbols and articles."""
    spaced = _MARK.sub(" ", unicodedata.normalize("NFKC", s or "").casefold())
    return " ".join(w for w in spaced.split() if w not in ARTICLES)


def normalize(s: str | None) -> str:
    """First of abstention, yes/no, date, number and plain words that applies."""
    if abstains(s):
        return ABSTAIN
    return yes_no(s) or date_of(s) or number_of(s) or plain_words(s)


def _udf(f):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(None if x is None or x is pd.NA or isinstance(x, float) else x))

    return run


_normalize, _date, _number, _yes_no = map(_udf, (normalize, date_of, number_of, yes_no))
_abstention = _udf(lambda s: ABSTAIN if abstains(s) else None)


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _simple(c: Column) -> tuple[Column, Column]:
    """Whether column expressions alone can decide an answer (ASCII, no digit, no lead-in), and its phrase."""
    said = F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("'"), F.lit("")), "[^a-z0-9]+", " "))
    return c.rlike(r"^[\t\n\r -/:-~]*$") & ~said.rlike("^(?:the )?answer\\b"), said


def _only(simple: Column, c: Column) -> Column:
    """The answers left for Python; the others go there as null, which costs nothing."""
    return F.when(~simple, c)


def normalize_answer(c: Column | str) -> Column:
    """See :func:`normalize`; null gives an empty text."""
    c = _column(c)
    simple, said = _simple(c)
    first = F.substring_index(said, " ", 1)
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^a-z]+", " ")), " "), lambda w: ~w.isin(*ARTICLES))
    easy = F.when(said.isin(*sorted(ABSTENTIONS)), ABSTAIN).when(first.isin(*YES), "yes").when(first.isin(*NO), "no").otherwise(F.array_join(words, " "))
    return F.when(simple, easy).otherwise(_normalize(_only(simple, c)))


def normalize_yes_no(c: Column | str) -> Column:
    c = _column(c)
    simple, said = _simple(c)
    first = F.substring_index(said, " ", 1)
    easy = F.when(said.isin(*sorted(ABSTENTIONS)), None).when(first.isin(*YES), "yes").when(first.isin(*NO), "no")
    return F.when(simple, easy).otherwise(_yes_no(_only(simple, c)))


def canonicalize_unanswerable(c: Column | str) -> Column:
    c = _column(c)
    simple, said = _simple(c)
    return F.when(simple, F.when(said.isin(*sorted(ABSTENTIONS)), ABSTAIN)).otherwise(_abstention(_only(simple, c)))


def normalize_date(c: Column | str) -> Column:
    c = _column(c)
    return _date(_only(_simple(c)[0], c))


def normalize_number(c: Column | str) -> Column:
    c = _column(c)
    return _number(_only(_simple(c)[0], c))


def _match(read):
    def match(prediction: Column | str, gold: Column | str) -> Column:
        return F.coalesce(read(prediction) == read(gold), F.lit(False))

    return match


# whether both answers can be read that way and mean the same
date_match, numeric_match, yes_no_match = map(_match, (normalize_date, normalize_number, normalize_yes_no))
