"""Text functions as column expressions; Python only where Unicode folding needs it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Entity type aliases and their families.
TYPE_ALIASES = {
    "person": "person", "people": "person", "human": "person", "individual": "person",
    "organization": "organization", "organisation": "organization", "org": "organization", "company": "organization", "corporation": "organization",
    "business": "organization", "institution": "organization", "agency": "organization", "university": "organization",
    "location": "location", "place": "location", "city": "location", "country": "location", "region": "location", "facility": "location",
    "event": "event",
    "product": "product", "work": "product", "technology": "product",
    "natural": "natural", "fruit": "natural", "animal": "natural", "plant": "natural", "species": "natural",
}

# Stop words of the lexical tokens.
STOPWORDS = """
a about according after again against all also am an and any are as at be because been before being between both but by can concerning considering
could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in information
into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own regarding report
reported reports respectively same she should so some such than that the their theirs them themselves then there these they this those through to
too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves article single
related whether yes
""".split()

# Answers that cannot be looked up in a text.
GENERIC_ANSWERS = ("yes", "no", "insufficient information", "insufficient information.")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


@F.pandas_udf(StringType())
def _surface(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(x.casefold().split()))


def normalize_text(c: Column) -> Column:
    """Compatibility form, case-folded, white space collapsed; punctuation stays. ASCII never leaves the JVM."""
    ascii_ = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_, collapse(F.lower(c))).otherwise(_fold(F.when(~ascii_, c)))


def surface_key(c: Column) -> Column:
    """Case-folded, white space collapsed; compatibility forms stay apart. ASCII never leaves the JVM."""
    ascii_ = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_, collapse(F.lower(c))).otherwise(_surface(F.when(~ascii_, c)))


def lexical_view(normalized: Column) -> Column:
    """Words of normalised text with everything else as single spaces."""
    return collapse(F.regexp_replace(normalized, r"[^\p{L}\p{N}_]+", " "))


def normalize_label(c: Column) -> Column:
    return F.lower(collapse(c))


def name_tokens(lexical: Column) -> Column:
    return F.filter(F.split(lexical, " "), lambda t: t != "")


def acronym(lexical: Column) -> Column:
    """Initials of a name of two or more words, else null."""
    t = name_tokens(lexical)
    return F.when(F.size(t) >= 2, F.array_join(F.transform(t, lambda x: F.substring(x, 1, 1)), ""))


def type_family(label: Column) -> Column:
    """Family of a type label: of the whole label, else of its first known word, else the label itself."""
    lex = F.nullif(lexical_view(F.lower(label)), F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    known = F.filter(F.transform(F.split(lex, " "), lambda t: table[t]), lambda x: x.isNotNull())
    return F.coalesce(table[lex], F.get(known, F.lit(0)), lex)


def keywords_split(c: Column) -> Column:
    """Keywords between commas, semicolons and bars: cleaned, first spelling of each kept, in order."""
    items = F.filter(F.transform(F.split(c, r"[,;|]"), collapse), lambda x: x != "")

    def keep(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x))

    return F.aggregate(items, F.array().cast("array<string>"), keep)


def strip_wrappers(c: Column) -> Column:
    """Model output without thinking blocks and without a surrounding code fence."""
    plain = strip(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))
    return strip(F.regexp_replace(plain, r"(?s)^```[A-Za-z0-9_-]*\s*\n?(.*?)\n?```$", "$1"))


def bounded_text(c: Column, limit: int, marker: str = "…") -> Column:
    """Text of at most ``limit`` characters, cut with a marker."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - len(marker))), F.lit(marker))).otherwise(c)


def placeholder_fill(c: Column, placeholder: Column) -> Column:
    return F.coalesce(blank_to_null(c), placeholder)


def model_size(c: Column) -> Column:
    """Billions of parameters named in a model label such as ``qwen 0.8b`` or ``270M``."""
    n = F.regexp_extract(c, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*([BM])\b", 1)
    unit = F.upper(F.regexp_extract(c, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*([BM])\b", 2))
    return F.when(unit == "B", n.cast("double")).when(unit == "M", n.cast("double") / 1000)


def reuse_bin(n: Column) -> Column:
    return F.when(n <= 2, "1-2").when(n <= 9, "3-9").when(n <= 49, "10-49").otherwise("50+")


def depth_bucket(n: Column) -> Column:
    return F.when(n >= 6, "6+").otherwise(n.cast("int").cast("string"))


def rank_bucket(rank: Column) -> Column:
    return F.when(rank.isNull(), "Not found").when(rank >= 6, "6+").otherwise(rank.cast("int").cast("string"))


def json_string(c: Column) -> Column:
    """JSON literal of a string, with the escapes of a standard encoder."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)


def joined_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """Prefix and hash of the parts' JSON literals joined by the unit separator."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *[json_string(p) for p in parts]), 256), 1, length))


def array_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """Prefix and hash of the JSON array of the parts."""
    body = F.concat(F.lit("["), F.concat_ws(",", *[json_string(p) for p in parts]), F.lit("]"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, length))


def indexed_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """Prefix and hash of a JSON array of ``{"index", "value"}`` objects."""
    items = [F.concat(F.lit(f'{{"index":{i},"value":'), json_string(p), F.lit("}")) for i, p in enumerate(parts)]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]")), 256), 1, length))


def text_id(prefix: str, c: Column, length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, length))


def lexical_tokens(c: Column) -> Column:
    """Words of two or more characters that are no stop words."""
    t = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), 1)
    return F.filter(t, lambda x: (F.length(x) > 1) & ~x.isin(STOPWORDS))


def normalized_phrase(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether the words of ``phrase`` stand in ``text`` in a row; false for an empty phrase."""
    p = normalized_phrase(phrase)
    return (p != "") & F.contains(F.concat(F.lit(" "), normalized_phrase(text), F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))


def direct_answer_present(text: Column, answer: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(answer)).isin(*GENERIC_ANSWERS) & contains_phrase(text, answer), F.lit(False))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of two bags of words given as arrays; 1 if both are empty, 0 if one is."""
    common = F.aggregate(
        F.array_distinct(prediction),
        F.lit(0),
        lambda acc, t: acc + F.least(F.size(F.filter(prediction, lambda x: x == t)), F.size(F.filter(gold, lambda x: x == t))),
    )
    p, r = common / F.size(prediction), common / F.size(gold)
    return (
        F.when((F.size(prediction) == 0) & (F.size(gold) == 0), F.lit(1.0))
        .when((F.size(prediction) == 0) | (F.size(gold) == 0) | (common == 0), F.lit(0.0))
        .otherwise(2 * p * r / (p + r))
    )
