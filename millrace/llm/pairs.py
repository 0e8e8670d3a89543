"""Defective prompt and response pairs, by kind of defect.

Method: for every defect a few noisy labelling functions, each looking at another kind of evidence (words, characters,
order, marks, shape), vote for it, against it or not at all. A label model with one accuracy table per function and class
is fitted to the vote patterns of all pairs by expectation maximisation, without any labelled pair. A label is kept where
its posterior reaches the defect's cutoff; a pair may keep several. Cutoffs are validated: every pair without any vote for
a defect is damaged in known ways, once for each defect, and the cutoff with the best F1 on these and their sound originals
is taken. Votes are computed once and staged, for the damaged pairs too; what reaches the driver are the counts of distinct
vote patterns, whose number depends on the functions and not on the rows.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import stage

#: In order of precedence, where one label is wanted: what the later ones look for may follow from the earlier ones.
DEFECTS = ("empty_answer", "copies_question", "refusal", "other_language", "truncated_answer")

# Placeholders, lead-ins, refusal phrases and function words.
PLACEHOLDER = re.compile(r"^(?:n\.?/?\s?a\.?|none|null|nil|nan|undefined|empty|blank|missing|unknown|tb[dc]|to ?do|to be (?:done|defined|added|filled in)|pending|placeholder|not available|no (?:answer|text|content|data|value)|k\.?\s?a\.?|keine angaben?|sans objet|sin datos|x+|lorem ipsum)$", re.I)
FILLER = frozenset("na none null nil nan undefined empty blank missing unknown tbd tbc todo pending placeholder available content data value yet answer text here insert follows later".split())
LEAD_IN = re.compile(r"^(?:\W*(?:(?:final |short )?answer|response|reply|note|hint|remark|a|antwort|réponse|respuesta|hinweis|your question|you ask(?:ed)?|you are asking|the question (?:is|was|reads)|question|q|frage|die frage (?:ist|lautet)|sie fragen|pregunta|la question est)\s*[:：]\s*)+", re.I)
# a speaker and what the speaker can't or won't do
SPEAKER = re.compile(r"\b(?:i|we|me|my|our|language (?:model|assistant)|assistant|an ai|ich|wir|mir|uns|je|nous|moi|yo|nosotros)\b|['’]m\b|\bj['’]", re.I)
UNABLE = re.compile(r"\b(?:can ?not|can['’]?t|could ?n['’]?t|could not|unable|not able|impossible|not possible|do ?n['’]?t|do not|won['’]?t|will not|must decline|have to decline|decline|refuse|rather not|sorry|afraid|apologi[sz]e|apologies|beyond|outside)\b|\b(?:nicht|unmöglich|leider|kein\w*|ne|pas|aucune?|impossible|no|imposible|désolée?)\b", re.I)
SAYING = re.compile(r"\b(?:answer|help|know|assist|tell|say|provide|determine|find|comment|respond|comply|decline|infer|conclude|judge|scope|beantworte\w*|helfen|sagen|weiß|wissen|répondre|dire|sais|aider|responder|contestar|sé|decir|ayudar)\b", re.I)
NO_ANSWER = re.compile(r"\b(?:question|this|that|it|query|request)\b[^.]*\b(?:can ?not|can['’]?t|could not) be (?:answered|determined|derived|resolved)|\bno (?:answer|statement|conclusion)\b[^.]*\b(?:could|can|is|was|be)\b[^.]*\b(?:be (?:given|made|derived|drawn|found)|given|derived|possible|found|available)\b|\banswer (?:is|was|can|could)(?: not|n['’]?t) (?:given|contained|found|present|available|stated|be)|not[_ ]?answerable|unanswerable|\b(?:can ?not|can['’]?t) answer (?:this|that|the question|your)|\bplease rephrase|nicht beantworten|nicht beantwortet|keine (?:aussage|antwort) (?:möglich|treffen)|お答えできません|回答できません|わかりません|分かりません|申し訳", re.I)
NO_SOURCE = re.compile(r"\b(?:context|documents?|excerpts?|passages?|pages?|material|sources?|text|snippets?|information|basis)\b[^.]*\b(?:(?:do|does|did)(?: not|n['’]?t) (?:contain|mention|say|state|provide|include|cover|give|answer|address|specify|allow)|say(?:s)? nothing|contain(?:s)? no|offer(?:s)? no|(?:is|are) silent|only deal)|\b(?:not|no|n['’]t) (?:contain )?(?:enough|sufficient) (?:information|evidence|context|data|detail)|\bno (?:relevant )?information (?:on|about|is|was|in|could)|\bno (?:statement|conclusion)\b[^.]*\bbasis\b|keine (?:ausreichenden |genügenden )?(?:informationen|angaben)|(?:pas|aucune) (?:assez d['’])?information|ne permet(?:tent)? pas|no (?:hay|contiene) (?:suficiente )?información|情報がありません", re.I)
POLITE = re.compile(r"^\W*(?:hello|hi|hm+|well|thanks?(?: you)?(?: for [^.!?]*)?|note|sorry|my apologies|unfortunately|good (?:day|morning)|please rephrase your question|is there anything else|you may want to ask [^.!?]*|having read [^:.]*|based on the context|more (?:material|information) is needed|anything else[^.!?]*|let me know[^.!?]*)\W*$", re.I)
COURTESY = re.compile(r"\b(?:sorry|apologies|apologi[sz]e|unfortunately|regret|please (?:rephrase|consult|ask|contact)|you may want to|is there anything else|let me know|thank you|leider|entschuldig\w*|bedauer\w*|désolée?|malheureusement|lo siento|lamento)\b", re.I)
#: What any refusal has at least one of: most answers have none, and need no closer look.
HINT = re.compile(r"\b(?:i|we|me|my|our|assistant|question|answer|answered|answerable|not_answerable|unanswerable|context|documents?|excerpts?|passages?|pages?|material|sources?|snippets?|information|basis|evidence|ich|mir|wir|leider|je|nous|yo)\b|['’]m\b|\bj['’]|beantwort|répond|respond|[ぁ-ん]", re.I)
STOP = {
    "en": "the of to and in is that it for as with be are this by on not which or from at an has have before after only when if whenever every each does its must shall may been can other than how why what under into until while no both unless".split(),
    "de": "der die das und ist nicht ein eine den dem des mit von auf für zu sich im als auch bei nach wird werden nur wie oder aus zur zum kann muss wenn falls keine keinen über erst an dass vor ohne sobald während".split(),
    "fr": "le la les des et est un une du dans que qui pour par sur ne pas au aux avec ce cette sont être se si lorsque dont soit tant selon leur en avant après chaque toute ou il elle".split(),
    "es": "el los las y es una del que en por para con no se al lo como más su sus está son ser si cuando antes cada sólo hasta salvo entre sin tras también ha han o puede un".split(),
    "it": "il gli e è un una di che per con non si al come più della delle dei nel sono essere se quando ogni".split(),
    "pt": "o os as e é um uma do da que em por para com não se ao como mais seu são ser quando cada até".split(),
    "nl": "de het een en is niet van op voor met die dat te aan als bij wordt worden alleen wanneer geen over".split(),
}
# what marks a language's spelling, counted as letters; a word's end is a blank
MARKS = {
    "de": ("ä", "ö", "ü", "ß", "sch", "ung ", "keit ", "lich ", "isch", "ieren ", "icht", "zu"),
    "fr": ("ç", "œ", "ê", "è", "à", "ù", "â", "é", " l'", " d'", " qu", "eux ", "ment ", "ée"),
    "es": ("ñ", "¿", "¡", "ción ", "ado ", "ada ", "ones ", "á", "í", "ó", "ú", " el ", " los "),
    "en": ("ing ", "ed ", "ly ", "tion ", "ness ", "th", " wh", "ould"),
}
ENDS_OPEN = frozenset("the a an of to and or in is that for as with be are by on which from at has have its may must shall can into until while no unless if when der die das und ist ein eine den dem des mit von auf für zu im als bei nach wird oder le la les des et est un une du dans que qui pour par sur el los y una del en con se al su".split())
UNIT = frozenset("ms us µs s ns min h hz khz mhz kb mb gb byte bytes bit bits v mv a ma k % milliseconds microseconds seconds minutes hours times cycles".split())
_LANGS = tuple(STOP)
_BY_SCRIPT = ("ja", "zh", "ko", "ru")
#: What `language` can name.
LANGUAGES = (*_LANGS, *_BY_SCRIPT)
_SAYS: dict[str, tuple[int, ...]] = {}
for _i, _ws in enumerate(STOP.values()):
    for _w in _ws:
        _SAYS[_w] = (*_SAYS.get(_w, ()), _i)

_WORD = re.compile(r"[^\W_]+(?:['’_][^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_CODE = re.compile(r"^(?:0x[0-9a-f]+|\d+(?:[.,]\d+)*|\w*[a-z][A-Z]\w*|\w*_\w*|[A-Z][A-Z0-9]+)$")
_NAMED = re.compile(r"\b(?:\d[\w.]*|\w*[a-z][A-Z]\w*|\w+_\w+)\b")
_TERMINAL = re.compile(r"[.!?。！？…][\"'”’»)\]*_`]*\s*$")
_FENCED = re.compile(r"^\s*(?:```|\|.*\|)\s*$")
_MARKER = re.compile(r"(?:^|\n)\s*(?:\(?(?:\d{1,3}|[A-Za-z])[.)]|[-*•–])\s*$")
_ABBREVIATED = re.compile(r"\b(?:e\.g|i\.e|z\.\s?B|d\.\s?h|p\.\s?ej|cf|vs|approx|Fig|Sec|Nr)\.$")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’»)\]*_]*\s+|\n+")
_SQUEEZED = re.compile(r"[\W_]+")


def script(text: str) -> str | None:
    """The language that a text's script tells, where it does."""
    if text.isascii():
        return None
    kana, han = len(re.findall(r"[぀-ヿ]", text)), len(re.findall(r"[一-鿿]", text))
    hangul, cyr = len(re.findall(r"[가-힯]", text)), len(re.findall(r"[Ѐ-ӿ]", text))
    if not (kana or han or hangul or cyr):
        return None
    letters = sum(map(str.isalpha, text)) or 1
    for lang, n in zip(_BY_SCRIPT, (kana + (han if kana else 0), 0 if kana else han, hangul, cyr)):
        if n > 0.25 * letters or n > 12:
            return lang
    return None


# the last few texts are asked for again, by other functions and for the damaged pairs
@lru_cache(32)
def function_words(text: str) -> tuple[int, ...]:
    """How often a text has function words of each language."""
    hits = [0] * len(_LANGS)
    for w in _LETTERS.findall(text.lower()):
        for i in _SAYS.get(w, ()):
            hits[i] += 1
    return tuple(hits)


@lru_cache(32)
def language(text: str) -> tuple[str | None, float]:
    """The language of the script or of the most frequent function words, and its share of all hits; (None, 0) with too few."""
    if s := script(text):
        return s, 1.0
    hits = function_words(text)
    best = max(hits)
    return (None, 0.0) if best < 2 else (_LANGS[hits.index(best)], best / sum(hits))


def by_letters(text: str) -> str | None:
    """A second opinion from letters and endings that mark a language."""
    t = f" {_SQUEEZED.sub(' ', text.lower()) if '_' in text else text.lower()} ".replace("’", "'").replace(". ", " ").replace(", ", " ")
    marks = {lang: sum(map(t.count, ms)) for lang, ms in MARKS.items()}
    best = max(marks, key=lambda x: marks[x])
    second = sorted(marks.values())[-2]
    return best if marks[best] >= 3 and marks[best] > 1.5 * second else None


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words, with bits as cells."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, row = (1 << len(a)) - 1, 0
    for w in b:
        if m := where.get(w, 0):
            x = row | m
            row = x & ((x - (row << 1 | 1)) ^ x) & full
    return row.bit_count()


def _grams(words: list[str], n: int = 5) -> set[str]:
    s = "".join(words)
    return {s[i : i + n] for i in range(max(1, len(s) - n + 1))}


def _sign(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


def _empty_votes(core: str, words: list[str]) -> list[int]:
    nothing = not any(map(str.isalnum, core))
    lexicon = bool(PLACEHOLDER.match(core))
    fill = sum(w in FILLER for w in words)
    return [_sign(nothing, not nothing), _sign(nothing or lexicon, not lexicon), _sign(nothing or (0 < len(words) == fill), fill < len(words) and (len(words) >= 3 or any(w not in FILLER and (len(w) > 3 or w.isdigit()) for w in words)))]


def _copy_votes(q: list[str], a: list[str]) -> list[int]:
    """By the words as a bag, by their order, and by runs of characters."""
    if len(q) < 4 or not a:
        return [-1, -1, -1]
    qset = set(q)
    novel = sum(w not in qset for w in a) / len(a)
    if novel > 0.6:
        return [-1, -1, -1]
    told = len(qset & set(a)) / len(qset)
    bag = _sign(novel <= 0.25 and told >= 0.5, novel > 0.35 or told < 0.3)
    # repetitions of the question count once; more words than it has are new content
    times = max(1, round(len(a) / len(q)))
    order = _common(q, a) / len(q)
    seq = _sign(order >= 0.65 and len(a) <= times * len(q) * 1.25 + 4 and novel <= 0.3, order < 0.4 or novel > 0.4)
    ga = _grams(a)
    inside = len(ga & _grams(q)) / len(ga)
    return [bag, seq, _sign(inside >= 0.7, inside < 0.5)]


def _refusal_votes(question: str, answer: str, sentences: list[str]) -> list[int]:
    """By who speaks, by what is said of the question or the answer, by what is said of the sources, by the rest of the
    answer, and by courtesy against things that only an answer names."""
    if not HINT.search(answer):
        return [-1, -1, -1, -1, 0]
    kinds = []
    for s in sentences:
        kinds.append((bool(SPEAKER.search(s) and UNABLE.search(s) and SAYING.search(s)), bool(NO_ANSWER.search(s)), bool(NO_SOURCE.search(s))))
    refusing = [any(k) for k in kinds]
    other = sum(not r and not POLITE.match(s) for s, r in zip(sentences, refusing))
    said = [any(k[i] for k in kinds) and other <= 1 for i in range(3)]
    none = not any(refusing)
    named = set(_NAMED.findall(answer)) - set(_NAMED.findall(question)) - {"NOT_ANSWERABLE"}
    courteous = bool(COURTESY.search(answer))
    return [*(_sign(s, none) for s in said), _sign(not none and other == 0, none or other >= 2), _sign(courteous and len(named) <= 1, len(named) > 1)]


def _language_votes(asked: list[tuple[str | None, str | None]], core: str, n: int) -> list[list[int]]:
    """By function words or script, by letters and endings, and by whether the question's own function words occur; for
    each question of (its language, or else what its letters say)."""
    al, share = language(core)
    cjk = al in _BY_SCRIPT
    l2 = al if cjk else by_letters(core) if n >= 6 else None
    hits = function_words(core) if n >= 4 or cjk else ()
    out = []
    for ql, own in asked:
        both = ql is not None and al is not None and (n >= 4 or cjk)
        first = _sign(both and al != ql and (share >= 0.4 or cjk), both and al == ql)
        second = _sign(bool(l2 and own) and l2 != own, bool(l2 and own) and l2 == own)
        if n < 4 and not cjk:
            third = -1
        elif ql in STOP:
            mine = hits[_LANGS.index(ql)]
            third = _sign(cjk or (mine <= max(hits) // 3 and max(hits) >= 3), mine >= 2 and mine >= max(hits) // 2)
        else:
            third = _sign(both and al != ql, both and al == ql)
        out.append([first, second, third])
    return out


def _truncation_votes(answer: str, core: str, words: list[str], sentences: list[str], empty: bool) -> list[int]:
    """By the last mark, by the last word or sign, by what is left open, and by how the sentences before end."""
    tail = answer.rstrip()
    marker = bool(_MARKER.search(tail)) and len(words) > 3
    ended = not marker and not _ABBREVIATED.search(tail) and (bool(_TERMINAL.search(tail)) or bool(_FENCED.search(tail.rpartition("\n")[2])))
    raw = re.findall(r"[^\s()\[\]{}<>\"“”`*]+", core) if len(core) < 200 else [""] * 7
    bare = len(words) == 1 or (len(raw) <= 6 and all(_CODE.match(w.strip(".,;:")) or w.lower().strip(".") in UNIT for w in raw))
    if empty or (bare and not marker):
        return [-1, 0, 0, 0]
    last = _sign(not ended, ended)
    hanging = marker or tail[-1:] in ",;:([{-–—/&`=<" or (bool(words) and words[-1] in ENDS_OPEN)
    opened = any(tail.count(x) > tail.count(y) for x, y in ("()", "[]", "“”", "«»")) or tail.count("`") % 2 == 1
    before = [s for s in sentences[:-1] if _TERMINAL.search(s)]
    return [last, _sign(hanging and not ended, ended), _sign(opened or marker, False), _sign(bool(before) and not ended, ended)]


def _core(answer: str) -> tuple[str, list[str]]:
    """An answer without its lead-in and outer marks, and its words."""
    core = re.sub(r"^[\W_]+|[\W_]+$", "", LEAD_IN.sub("", answer.strip()))
    return core, [w.lower() for w in _WORD.findall(core)]


def _sentences(answer: str) -> list[str]:
    return [s for s in _SENTENCE.split(answer.strip()) if s and s.strip()]


def votes(question: str | None, answer: str | None, only: str | None = None) -> str:
    """One sign per labelling function: + for its defect, - against it, 0 neither; see FUNCTIONS for their order. only: of
    one defect's functions."""
    q, a = question or "", answer or ""
    core, words = _core(a)
    sentences = _sentences(a) if only in (None, "refusal", "truncated_answer") else []
    empty = _empty_votes(core, words)
    nothing = max(empty[:2]) > 0
    v: list[int] = []
    if only in (None, "empty_answer"):
        v += empty
    if only in (None, "copies_question"):
        v += [-1, -1, -1] if nothing else _copy_votes([w.lower() for w in _WORD.findall(LEAD_IN.sub("", q.strip()))], words)
    if only in (None, "refusal"):
        v += [-1, -1, -1, -1, 0] if nothing else _refusal_votes(q, a, sentences)
    if only in (None, "other_language"):
        ql = language(q)[0]
        v += [-1, 0, -1] if nothing else _language_votes([(ql, ql or by_letters(q))], core, len(words))[0]
    if only in (None, "truncated_answer"):
        v += _truncation_votes(a, core, words, sentences, nothing)
    return _signs(v)


def _signs(v: list[int]) -> str:
    return "".join("-0+"[x + 1] for x in v)


#: How many functions of `votes` speak of each defect, in its order.
FUNCTIONS = {"empty_answer": 3, "copies_question": 3, "refusal": 5, "other_language": 3, "truncated_answer": 4}


def fit(patterns: dict[str, int], rounds: int = 100, smoothing: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(prior, table of vote given class, function and vote) of one defect's functions, by expectation maximisation over
    the counts of vote patterns. Starts from the share of votes for the defect among those that speak, so the classes
    can't swap."""
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], float)
    code = np.array([["-0+".index(c) for c in k] for k in keys])
    up, down = (code == 2).sum(1), (code == 0).sum(1)
    post = np.clip((up + 0.02) / (up + down + 0.5), 0.02, 0.98)
    hot = np.eye(3)[code]  # pattern x function x vote
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        prior = (w.sum(1) + smoothing) / (n.sum() + 2 * smoothing)
        table = np.einsum("yp,pfv->yfv", w, hot) + smoothing
        table /= table.sum(2, keepdims=True)
        new = np.array([posterior(k, prior, table) for k in keys])
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return prior, table


def posterior(pattern: str, prior: np.ndarray, table: np.ndarray) -> float:
    """Of the defect, given its functions' votes; 0 if no function names it."""
    if "+" not in pattern:
        return 0.0
    code = ["-0+".index(c) for c in pattern]
    log = np.log(prior) + np.log(table[:, range(len(code)), code]).sum(1)
    return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))))


# What an empty or refused answer of the validation sample reads.
_EMPTIED = ("", " ", "N/A", "-", "TBD", "...")
_REFUSED = ("I cannot say.", "We are not able to respond to this question.", "The sources do not mention it.", "This question cannot be answered from the text.", "Unfortunately there is not enough information.", "I am afraid that I do not know.")


def damaged(sample: list[tuple[str, str]], seed: int = 5) -> dict[str, list[tuple[str, str]]]:
    """Some pairs, damaged in a known way for each defect; one that can't be damaged so is left out."""
    rng = random.Random(seed)
    by_language: dict[str, list[str]] = {}
    for _, a in sample:
        if (x := language(a)[0]) and len(a.split()) >= 6:
            by_language.setdefault(x, []).append(a)
    out: dict[str, list[tuple[str, str]]] = {d: [] for d in DEFECTS}
    for q, a in sample:
        out["empty_answer"].append((q, rng.choice(_EMPTIED)))
        out["refusal"].append((q, rng.choice(_REFUSED)))
        words = q.split()
        if len(words) >= 8:
            drop = rng.randrange(len(words))
            out["copies_question"].append((q, " ".join(w for i, w in enumerate(words) if i != drop)))
        ends = [m.end() for m in re.finditer(r"\S+", a)]
        if len(ends) >= 10:
            out["truncated_answer"].append((q, a[: ends[rng.randrange(len(ends) // 2, len(ends) - 2)]].rstrip(".!?")))
        lang = language(q)[0]
        if others := [x for x in by_language if x != lang]:
            if lang:
                out["other_language"].append((q, rng.choice(by_language[rng.choice(others)])))
    return out


def damage(question: str, answer: str) -> str:
    """What a sound pair adds to the damaged ones, as words: for each defect but another language its number in DEFECTS and
    its functions' votes on the pair, damaged so; q and the question's language; a, the answer's language and the votes on
    it under a question of each of LANGUAGES, as they depend on nothing else of the question."""
    bad = damaged([(question, answer)], zlib.crc32(f"{question}\0{answer}".encode()))
    out = [f"{i}{votes(*x, only=d)}" for i, d in enumerate(DEFECTS) for x in bad[d]]
    if lang := language(question)[0]:
        out.append(f"q{lang}")
    if (lang := language(answer)[0]) and len(answer.split()) >= 6:
        core, words = _core(answer)
        out.append(f"a{lang}:{','.join(map(_signs, _language_votes([(x, x) for x in LANGUAGES], core, len(words))))}")
    return " ".join(out)


def damages(counts: Mapping[str, int]) -> dict[str, dict[str, Fraction]]:
    """{defect: {votes of its functions: how many damaged pairs}} from the counts of the words of `damage`. A question of a
    known language counts once for another language, in equal parts for each that answers have, and there for each answer."""
    out: dict[str, dict[str, Fraction]] = {d: Counter() for d in DEFECTS}
    asked: dict[str, int] = {}
    said: dict[str, Counter] = {}
    for x, n in counts.items():
        if x[0] == "q":
            asked[x[1:]] = n
        elif x[0] == "a":
            lang, _, signs = x[1:].partition(":")
            said.setdefault(lang, Counter())[signs] += n
        else:
            out[DEFECTS[int(x[0])]][x[1:]] += Fraction(n)
    for lang, n in asked.items():
        others = [x for x in said if x != lang]
        for x in others:
            for signs, m in said[x].items():
                out["other_language"][signs.split(",")[LANGUAGES.index(lang)]] += Fraction(n * m, len(others) * said[x].total())
    return out


def cutoff(sound: list[float] | Mapping[float, Fraction], bad: list[float] | Mapping[float, Fraction], least: float = 0.5) -> float:
    """The posterior from which on a label is kept: the one with the best F1 between sound and damaged pairs, of equal
    ones the middle between it and the next that is lower; `least` if there is nothing to compare. Posteriors are given
    one by one or with their numbers."""
    sound, bad = Counter(sound), Counter(bad)
    if not bad:
        return least
    steps = sorted({p for p in (*sound, *bad) if p >= least}, reverse=True)
    best, at = -1.0, least
    for i, t in enumerate(steps):
        hit, wrong = (sum(n for p, n in x.items() if p >= t) for x in (bad, sound))
        f1 = Fraction(2 * hit, hit + wrong + bad.total())
        if f1 >= best:
            best, at = f1, max(least, (t + (steps[i + 1] if i + 1 < len(steps) else least)) / 2)
    return at


def defective_pairs(pairs: DataFrame, keep: tuple[str, ...] = ("row_table", "row_id"), question: str = "question", answer: str = "answer") -> DataFrame:
    """(keep, defects, posteriors): the labels each pair keeps, in order of DEFECTS, with their posteriors; pairs without
    any are left out.

    A null or blank answer is an empty one; a null question is an empty text, against which neither copy nor language
    is judged. Repeated deliveries of `keep` count once. Texts are read whole and never shuffled, other columns not read.
    Starts three jobs: writing the votes, with those on the damaged forms of each pair without any vote for a defect, and
    counting the patterns of both. An empty table gives no rows."""
    src = pairs.select(*keep, question, answer)
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("votes", T.StringType()), T.StructField("damage", T.StringType())])
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, a = batch.column(k).to_pylist(), batch.column(k + 1).to_pylist()
            v = [votes(x, y) for x, y in zip(q, a)]
            bad = [None if x is None or "+" in p else damage(x, y) for x, y, p in zip(q, a, v)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(v, pa.string()), pa.array(bad, pa.string())], names=[*keep, "votes", "damage"])

    # the votes of a key's deliveries are the same, so they are shuffled and not the texts
    voted = stage(src.mapInArrow(run, schema).groupBy(*keep).agg(F.min(F.struct("votes", "damage")).alias("x")).select(*keep, "x.*"), "votes")
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"), F.count("damage").alias("sound")).collect()
    counts = {r["votes"]: r["n"] for r in patterns}
    if not counts:
        return voted.select(*keep, F.array().cast("array<string>").alias("defects"), F.array().cast("array<double>").alias("posteriors")).where("false")
    models: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    part: dict[str, slice] = {}
    at = 0
    for d, n in FUNCTIONS.items():
        part[d] = slice(at, at + n)
        own: Counter = Counter()
        for p, c in counts.items():
            own[p[part[d]]] += c
        models[d] = fit(own)
        at += n
    words = voted.where("damage IS NOT NULL").select(F.explode(F.split("damage", " ")).alias("word")).groupBy("word").count().collect()
    least = {}
    for d, bad in damages({r["word"]: r["count"] for r in words}).items():
        score: tuple[Counter, Counter] = (Counter(), Counter())
        for r in patterns:
            if r["sound"]:
                score[0][posterior(r["votes"][part[d]], *models[d])] += r["sound"]
        for p, n in bad.items():
            score[1][posterior(p, *models[d])] += n
        least[d] = cutoff(*score)
    rows = []
    for p in counts:
        kept = [(d, x) for d in DEFECTS if (x := posterior(p[part[d]], *models[d])) >= least[d] and "+" in p[part[d]]]
        if kept:
            rows.append((p, [d for d, _ in kept], [round(x, 6) for _, x in kept]))
    known = voted.sparkSession.createDataFrame(rows, "votes string, defects array<string>, posteriors array<double>")
    return voted.join(F.broadcast(known), "votes").select(*keep, "defects", "posteriors")
