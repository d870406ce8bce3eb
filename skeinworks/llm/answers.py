"""Broken prompt and response pairs: ordered text rules, each emitting a defect type.

The rules run on Arrow batches where the rows are; nothing is shuffled but the
questions, which are joined by their id. As column expressions the same rules make
generated code too large to be compiled and ran some hundred times slower.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import pick

DEFECTS = ("empty", "refusal", "question_copy", "wrong_language", "truncated")

# Answers that are only a label or a null literal.
LABELS = ("answer", "antwort", "the answer is", "die antwort ist", "response", "réponse", "respuesta", "risposta", "null", "nan", "none", "n a")

# What a copied question may be introduced by.
COPY_LEADS = r"(?:question|frage|you asked|your question|the question is|the question was|sie fragten|q)"

# Phrases by which a speaker declines, by language.
REFUSALS = (
    r"\bi (?:can't|cannot|can not|won't|will not|could not|couldn't|may not) (?:help|assist|answer|share|provide|comply|discuss|respond|be able|fulfil|do that|continue|complete|give|engage|support|offer)",
    r"\bi(?: a|')m (?:unable|not able|not allowed|not permitted|not comfortable|not in a position) to\b",
    r"\bi(?: a|')m not comfortable\b",
    r"\bi (?:do not|don't) feel comfortable\b",
    r"\bi (?:have to|must|need to|will have to) (?:refuse|decline)\b",
    r"\bi (?:refuse|decline)\b",
    r"\b(?:go|goes|be|is) against my (?:guidelines|policy|policies|programming|rules)\b",
    r"\bas an? (?:ai|assistant|language model|ai language model|ai assistant)\b",
    r"\bich (?:kann|darf|möchte|werde) (?:ihnen |dir )?(?:das|dies|diese|dieser|dazu|darauf|dabei|hierzu|leider|keine)\b.*\b(?:nicht|keine)\b",
    r"\b(?:leider|es tut mir leid|entschuldigung|tut mir leid)\b.*\b(?:kann|darf|möchte) ich\b",
    r"\bich (?:muss|möchte) .*\bablehnen\b",
    r"\bals (?:ki|sprachmodell|ki-sprachmodell|ki-modell|assistent)\b",
    r"\bgegen meine (?:richtlinien|regeln)\b",
    r"\bje (?:ne )?(?:peux|suis) pas\b",
    r"\ben tant qu'(?:ia|assistant|intelligence|modèle)\b",
    r"\b(?:no puedo|no me es posible|lo siento, pero)\b",
    r"\bcomo (?:modelo|asistente|ia)\b",
    r"\b(?:non posso|mi dispiace, ma)\b",
    r"\bnie mogę\b",
    r"не могу|не в состоянии|как языковая модель",
    r"抱歉|我无法|不能回答|作为人工智能",
)

# The articles lack it, which is an answer.
LACKS = r"\b(?:articles?|context|sources?|reports?|documents?|text|passages?|artikel|kontext|texte?)\b.{0,40}\b(?:do not|does not|don't|doesn't|lack|lacks|contain no|nicht|keine)\b|\binsufficient information\b|\b(?:find|found|locate|determine) (?:this|that|the|any|such)?\b.{0,30}\b(?:in|from) the (?:articles?|context|sources?|text|documents?)\b"

# Function words (articles, pronouns, prepositions, conjunctions, auxiliaries, particles) by language.
FREQUENT = {
    "en": "the a an and or but not is are was were be been being has have had do does did can could will would shall should may might must it its he him his she her they them their we us our you your i my me this that these those there "
    "who whom whose which what when where why how of to in on at by for with from into onto about after before between during through against without within because since although while if than as so such no yes also only both each any some all other more most very just then here according",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine keinen ist sind war waren sein gewesen wird werden wurde wurden worden hat haben hatte hatten kann können konnte soll sollte muss er sie es ihn ihm ihr wir uns ihnen ich mich mir du man sich dieser diese dieses "
    "diesem diesen dieselbe wer was wann wo warum wie welche welcher welches von vom zu zum zur in im am an auf aus bei mit nach für über unter vor durch gegen ohne um seit laut weil denn da dass ob wenn als auch nur noch schon sehr beide beiden ja nein davon dort hier",
    "fr": "le la les l un une des du de d et ou mais ne pas n est sont était étaient été être avoir a ont avait avaient il elle ils elles on nous vous je tu se s ce cet cette ces c qui que qu quoi dont où quand comment pourquoi quel quelle à au aux en dans sur sous par pour avec sans entre chez vers depuis "
    "pendant avant après selon contre car parce comme si aussi encore déjà très plus moins tout tous deux oui non son sa ses leur leurs y",
    "es": "el la los las lo un una unos unas y e o u pero no ni es son era eran fue fueron ser sido está están estaba estado ha han había habían hay se le les me te nos su sus mi este esta estos estas ese esa eso que quien quién cuál cuando cuándo dónde cómo porque por para con sin sobre entre desde hasta "
    "hacia según contra durante de del al a en como si también todavía ya muy más menos todo todos nadie nada dos sí",
    "it": "il lo la i gli le l un uno una e ed o ma non né è sono era erano stato stata essere ha hanno aveva avevano si ci vi ne lui lei loro noi voi io che chi cui quale quando dove come perché per con senza su tra fra da dal dalla di del della dei delle degli a al alla ai alle in nel nella nei nelle sul "
    "secondo contro durante se anche ancora già molto più meno tutto tutti due sì questo questa",
    "pl": "i a oraz lub albo ale nie jest są był była było były być będzie ma mają miał to ten ta te tego tej tym tych on ona ono oni się go jej ich mu co kto kiedy gdzie dlaczego jak który która które że żeby ponieważ bo więc z ze w we na do od po przez przy dla bez o u pod nad przed za między według zgodnie "
    "także też jeszcze już bardzo więcej wcześniej tak oba obie",
    "pt": "o a os as um uma uns umas e ou mas não nem é são era eram foi foram ser sido está estão estava tem têm tinha há se lhe me nos seu sua seus suas ele ela eles elas este esta esse essa isso que quem qual quando onde como porque por para com sem sobre entre desde até segundo contra durante de do da dos "
    "das ao à em no na nos nas também ainda já muito mais menos tudo todos ambos dois sim",
    "nl": "de het een en of maar niet geen is zijn was waren wordt worden werd werden geweest heeft hebben had hadden kan kunnen zal zou moet hij zij ze wij we ik jij je u hem haar hun ons zich dit dat deze die wie wat wanneer waar waarom hoe welke van naar in op aan bij met voor uit over onder door tegen zonder "
    "om sinds volgens omdat want als dan ook nog al zeer meer beide ja nee er hier daar",
}

# Words that cannot end a sentence.
DANGLING = (
    "the a an of to in on at by for with from and or but as that which who whose while since although because if than into after before during between about over under without "
    "according is was were are had has have been be der die das den dem des ein eine einen und oder von vom im am mit für aus bei nach wie dass weil le la les un une et ou de du des que qui el los las y o del"
)

_WORDS = {k: frozenset(v.split()) for k, v in FREQUENT.items()}
_SCRIPTS = {"ru": r"\p{Cyrillic}", "zh": r"[\p{Han}\p{Hiragana}\p{Katakana}]", "ar": r"\p{Arabic}", "el": r"\p{Greek}", "ko": r"\p{Hangul}"}
_SCRIPTS = {k: re.compile(v) for k, v in _SCRIPTS.items()}
_NOT_WORD, _NOT_LETTER, _LETTER = re.compile(r"[^\p{L}\p{N}]+"), re.compile(r"[^\p{L}']+"), re.compile(r"\p{L}")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_LEAD = re.compile(rf"{COPY_LEADS} ")
_REFUSAL = re.compile("|".join(f"(?:{r})" for r in REFUSALS), re.S)
_LACKS = re.compile(LACKS, re.S)
_QUOTED = re.compile(r'"[^"]*"|“[^”]*”|„[^“”]*[“”]|«[^»]*»')
_NAME = re.compile(r"(?<=[\p{Ll},;:] )\p{Lu}[\p{L}'-]*(?: \p{Lu}[\p{L}'-]*)*")
_ENDED = re.compile(r'[.!?。!?]["”’»)\]*]*$')
_SENTENCES = re.compile(r'.*[.!?。!?…]["”’»)\]*]*\s+', re.S)
_HANGS = re.compile(r"[,;:(\[{–—-]$")
_CLAUSES = re.compile(r"[,;] \p{Ll}+")
_DANGLING = frozenset(DANGLING.split())


def plain(text: str) -> str:
    """Lower-cased words of letters and digits, joined by single spaces."""
    return _NOT_WORD.sub(" ", text.lower()).strip()


def language(text: str) -> tuple[str | None, dict[str, int]]:
    """Language of a text and what speaks for each: its script, else its distinct function words."""
    if not _LETTER.search(text):
        return None, {}
    if not text.isascii():
        letters = len(_LETTER.findall(text))
        for k, script in _SCRIPTS.items():
            if 3 * len(script.findall(text)) > letters:
                return k, {k: 9}
    words = set(_NOT_LETTER.split(text.lower()))
    counts = {k: len(words & v) for k, v in _WORDS.items()}
    best = max(counts, key=counts.get)
    return (best if counts[best] else None), counts


@functools.lru_cache(4096)
def _asked_in(question: str) -> str:
    """Language of a question, of which many answers have the same."""
    return language(question)[0] or "en"


def _without(text: str, part: str) -> str:
    """``text`` without ``part`` as whole words, repeated or not."""
    text = f" {text} "
    while f" {part} " in text:
        text = text.replace(f" {part} ", "  ")
    return text.strip()


def defects(question: str | None, answer: str | None, gold: str | None = None) -> list[str]:
    """All defect types of one pair, in rule order.

    * ``empty``: null, or no letter or digit but for a bare label or null literal.
    * ``refusal``: a declining phrase, and not merely that the articles lack the information.
    * ``question_copy``: nothing but the question, once or more, or at least half of it.
    * ``wrong_language``: its words (without quotations, names and the gold answer) are
      of another language than the question.
    * ``truncated``: an unclosed bracket, quotation or bold mark, an end that cannot end a
      sentence, or a last sentence without an end after whole sentences or clauses. Of a
      refusal or a copy the last does not count: they are often whole without a full stop (nor does
      "that" at the end, as in "respond to that").

    An answer that opens with a copy of the question and goes on is judged by the rest.
    A null question matches no copy and counts as English; a null gold is ignored.
    """
    q, a = question or "", _INVISIBLE.sub("", answer or "").strip()
    words = plain(a)
    if not words or words in LABELS:
        return ["empty"]
    asked = plain(q)
    bare = _LEAD.sub("", words, 1) if _LEAD.match(words) else words
    rest = _without(bare, asked) if asked else bare
    body = a
    if asked and rest and bare.startswith(asked) and a.lower().startswith(q.lower()):
        body = a[len(q) :].strip() or a
    out = []
    low = body.lower().replace("’", "'").replace("ʼ", "'")
    if _REFUSAL.search(low) and not _LACKS.search(low):
        out.append("refusal")
    n = len(asked.split())
    if asked and (not rest or n >= 4 and 2 * len(bare.split()) >= n and f" {bare} " in f" {asked} "):
        out.append("question_copy")
    declined_or_copied = bool(out)
    said = _QUOTED.sub(" ", body)
    if gold:
        said = said.replace(gold, " ")
    ours, theirs = _asked_in(q), language(_NAME.sub(" ", said))
    if theirs[0] and theirs[0] != ours and theirs[1][theirs[0]] >= 2 and theirs[1][theirs[0]] > theirs[1].get(ours, 0):
        out.append("wrong_language")
    before = _SENTENCES.match(body)
    tail = body[before.end() :] if before else body
    unclosed = body.count('"') % 2 or body.count("**") % 2 or body.count("(") > body.count(")") or body.count("[") > body.count("]") or body.count("“") > body.count("”")
    ended = bool(_ENDED.search(body))
    last = plain(tail).split()
    hangs = _HANGS.search(body) or not ended and len(last) > 1 and last[-1] in _DANGLING and not (declined_or_copied and last[-1] == "that")
    if unclosed or hangs or body.endswith(("...", "…")) or not ended and not declined_or_copied and (before or _CLAUSES.search(tail)):
        out.append("truncated")
    return out


def flag(pairs: DataFrame) -> DataFrame:
    """Adds ``defects`` to rows with ``question``, ``answer`` and ``gold``: see :func:`defects`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {name: b.schema.get_field_index(name) for name in ("question", "answer", "gold")}
            rows = zip(*(b.column(i).to_pylist() for i in at.values()))
            found = pa.array([defects(*r) for r in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "defects"])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("defects", T.ArrayType(T.StringType()))]))


def defective_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """``(answer_result_id, defect)`` of the successful answers that are defective.

    The outcome is read ignoring case and white space. Repeated rows count once;
    an answer whose question is unknown is judged without it. Null ids are left out.
    """
    a = pick(answers, answer_result_id="answer_result_id", question_id="question_id", answer="raw_answer", outcome="answer_outcome", gold="gold_answer")
    a = a.where(F.lower(F.regexp_replace("outcome", r"(?U)^\s+|\s+$", "")) == "success").where("answer_result_id is not null")
    q = pick(questions, question_id="question_id", question="question").dropDuplicates(["question_id"])
    flagged = flag(a.join(q, "question_id", "left"))
    return flagged.select("answer_result_id", F.explode("defects").alias("defect")).distinct()
