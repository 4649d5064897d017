r"""Template residue, filler, error pages and script notices in place of content.

A text is cut into messages: lines and, within lines, sentences. *Recurrence*: with numbers, dates, addresses, case and
punctuation masked, each message is hashed and counted over the origins of all documents; a message that ``LEAST_ORIGINS`` origins have
recurs, however many other origins there are. Messages with placeholders are counted with the placeholders
masked, which yields the sentences of the templates, each held by ``TEMPLATE_ORIGINS`` origins. *Rules*: phrases (filler, errors, access and script notices in English,
German, French and Spanish) and placeholder forms classify messages; a recurring message needs only a cue of a rule, one that
stands alone must match a rule as a whole. What is neither residue nor furniture (headings, menus, links, lists of titles,
document scaffolding, definitions of macros, colours and styles, sentences of a known template, recurring messages) is content. A document is residue if it
has some residue and no content.

The counts are the only large shuffle (hashes, aggregated before it); a hot message is one row for each task. Most documents hold a
message that is content whatever recurs, and are done with. The messages of the others are grouped by their normalised form and hash, each group
is classified once, with what is known of its recurrence, and the class is joined back to the documents; sentences meet
templates by a word that the template holds. No document is judged but by the classes of its groups; nothing is broadcast or collected.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.scan import BASE, blocks, mixed, powers, symbols
from inkmill.session import materialise

#: A message recurs if so many origins have it; a template sentence is learned from so many.
LEAST_ORIGINS = 4
TEMPLATE_ORIGINS = 2
#: A message of more words is taken for prose, whatever it mentions, unless it recurs.
LONGEST_RULE_WORDS = 26
#: The share of words that belong neither to a phrase nor to the language of notices, beyond which a message is prose.
FOREIGN_SHARE = 0.2
#: The share of words of the language of notices from which a message that recurs, but meets no rule, is furniture.
KNOWN_SHARE = 0.7
#: A message with a placeholder and so many other words is prose about placeholders, unless it is of a known template.
LONG_TEMPLATE_WORDS = 9

# The phrases of the rules (accents are folded before matching).
FILLER = r"""
lorem ipsum|ipsum dolor|dolor sit amet|consectetur adipiscing|sed do eiusmod|ut enim ad minim|quis nostrud|duis aute irure|excepteur sint|sunt in culpa
nam libero tempore|pellentesque habitant|morbi tristique|in voluptate velit|incididunt ut labore|cum soluta nobis|cupidatat non proident|deserunt mollit
asdf|qwer(?:ty)?|blah blah|(?:tbd|tba|xxx+|foo|bar|text|test|todo)(?: (?:tbd|tba|x+|foo|bar|text|test|todo)){2,}|x{2,}(?: x{2,})+
(?:your|ihr|votre|su) (?:own )?(?:text|title|description|caption|content|name|introduction|abstract|(?:tikz )?code|figure)\b.{0,20}\b(?:here|hier|ici|aqui)
(?:sample|dummy|placeholder|example|filler|some|more) text|this is a placeholder|content coming soon|coming soon|to be (?:added|written|completed|done|announced|filled in)(?: later| soon)?
click to edit|replace this (?:paragraph|text|section)|insert (?:figure |your |the )?(?:title|description|caption|text|figure|code|abstract)|add (?:some |your )?(?:text|description|caption|content)\b.{0,30}\bhere
hier (?:konnte|steht) ihr text|text (?:hier )?(?:einfugen|erganzen)|texte? a completer|texte ici|inserez (?:le|votre) |a completer|escriba (?:aqui|su) |texto de (?:ejemplo|relleno)|inserte (?:el|su|aqui) |beispieltext|blindtext|platzhalter
paper title|author name|caption text|a figure caption|write your|heading \d|lorem|first name last name|title of (?:the|your) |paste (?:your )?(?:drawing|code|text)
""".strip().replace("\n", "|")
ERROR = r"""
(?:http|error|fehler|erreur) ?(?:code )?[45]\d\d|[45]\d\d (?:not found|forbidden|unauthori[sz]ed|bad request|bad gateway|gone|internal server error|service (?:temporarily )?unavailable|gateway time-?out|too many requests|error)
(?:page|file|document|repository|figure|entry|question|paste|site|drawing|url|resource|thread|post|preview)\b.{0,40}\b(?:not (?:be )?found|does not exist|doesn't exist|no longer (?:exists|available)|(?:is |was )?unavailable|(?:has been|was) (?:removed|deleted|moved|renamed)|could not be (?:found|loaded|displayed)|cannot be (?:found|displayed|loaded))
may have been (?:moved|renamed|removed|deleted)|(?:something|etwas) (?:went wrong|ist schiefgelaufen)|oops|whoops|internal server error|(?:service|server|temporarily) (?:temporarily )?(?:is )?(?:unavailable|overloaded|busy)|under maintenance
(?:we )?(?:couldn't|could not|cannot|can't|unable to|failed to) (?:load|find|open|display|render|fetch|process|show)|timed? ?out|too many requests|rate limit|slow down and try|try again (?:later|in)|bad gateway|gateway timeout|request (?:id|failed|blocked)|connection (?:refused|reset)|too (?:large|big) to (?:display|show|render|load)
access (?:denied|restricted|forbidden)|permission denied|(?:do not|don't) have (?:the )?permission|not (?:authori[sz]ed|permitted)|session (?:has )?expired|(?:sign|log) ?in (?:again )?to (?:see|view|continue|access|read)|please (?:sign|log) ?in|you (?:must|need to) (?:be logged in|sign in|log in)
not (?:a )?robot|verify (?:that )?you are (?:a )?human|captcha|checking your browser|security check|unusual traffic
nicht gefunden|existiert nicht|nicht (?:mehr )?verfugbar|zugriff (?:verweigert|gesperrt)|zugang verweigert|melden sie sich an|anmeldung erforderlich|sitzung (?:ist )?abgelaufen|spater (?:noch einmal|erneut)|keine berechtigung|interner serverfehler|fehler beim (?:laden|rendern)
introuvable|n'existe (?:pas|plus)|acces (?:refuse|interdit|restreint)|veuillez vous (?:connecter|identifier)|connectez-vous|session (?:a )?expire|erreur interne|reessayez|n'est (?:pas|plus) disponible|une erreur (?:est survenue|s'est produite)
no (?:se )?(?:ha |pudo )?(?:sido )?(?:encontr|existe)\w*|acceso (?:restringido|denegado|prohibido)|inicie sesion|inicia sesion|sesion (?:ha )?(?:caducado|expirado)|error interno|intentelo (?:de nuevo|mas tarde)|no esta disponible|ha ocurrido un error
""".strip().replace("\n", "|")
SCRIPT = r"java ?script|no ?script|client-side scripts?|(?:execute|run|support|allow|enable|need|require|block|disable|activ)\w* scripts?|scripts? (?:and cookies )?(?:(?:are|is|be) )?(?:required|disabled|blocked|enabled|needed|switched|turned|off)|turn on scripting|scripting in your browser|cookies (?:are |be )?(?:required|disabled|blocked|enabled|switched on|turned on)|enable cookies|skripte? (?:aktivier|erforder)\w*|activ\w+ (?:los |les )?scripts?"
RULES = re.compile(rf"\b(?:{FILLER}|{ERROR}|{SCRIPT})")
# The words that notices are made of besides their phrases, what they speak of, and what they say of it.
COMMON = """allow enable enabled activate require requires required run running execute while rendering loads app a an the this that these our your my its all any some to of on in for by with and or so if is are was were be been being has have had it we you they not no please sorry unfortunately
before after again later now right just here there order see view viewing open opening load loading continue continuing show showing shown display read reach access use using get go back turn switch on off up must need needs needed can
could may might cannot will would at from as also only more new old moved renamed owner browser site app page web client side canvas preview editor host upstream connection server reference id code minutes seconds hours blank stays works best ce cette ces
le la les un une des du de d l votre vos ne pas plus sans et ou en est sont sur pour avec veuillez serveur navigateur tard active activez activer desactive der die das den dem ein eine einer dieser diese dieses ihr ihre ihren sie bitte nicht und oder ist sind auf mit fur zum zur um von im wird werden seite
el los las uno una su sus este esta estos es son para por con que se ha han y o del al lo en pagina navegador servidor solicitada angeforderte demandee benotigt fonctionne necesita zu wurde mas""".split()
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo
consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum nam libero tempore cum soluta
nobis pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas vestibulum""".split()
FILLING = "text texto texte paragraph caption description title figura figure own about add insert replace with sample dummy placeholder content coming soon later write edit click introduction abstract section word words example".split()
OBJECTS = "page file document repository figure entry gallery question paste site drawing url resource thread post preview picture image content archive project folder link account section seite datei bild zeichnung fichier dessin archivo dibujo".split()
STATES = "private withheld unavailable missing gone offline removed deleted protected expired blocked hidden restricted disabled shown displayed closed broken locked empty denied forbidden suspended archived privat geloscht gesperrt entfernt prive supprime bloque masque privado eliminado bloqueado oculto".split()
OBJECT_WORDS, STATE_WORDS = frozenset(OBJECTS), frozenset(STATES)
KNOWN = frozenset(COMMON) | OBJECT_WORDS | STATE_WORDS | frozenset(LATIN) | frozenset(FILLING)

NAME = r"[A-Za-z][A-Za-z0-9]*(?:[_ -][A-Za-z0-9]+){0,4}"
TAGS = "html|head|title|body|p|h[1-6]|pre|code|a|b|i|em|strong|ul|ol|li|div|span|br|hr|table|tr|td|th|img|script|style|noscript|blockquote|sub|sup|nav|header|footer|section|article|main|meta|link|form|input|button|label|small|tt|kbd"
TAG = re.compile(rf"</?(?:{TAGS})(?:\s[^<>\n]*)?/?>", re.I)
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{NAME}\s*\}}\}}|\{{%\s*{NAME}\s*%\}}|\[\[\s*{NAME}\s*\]\]|<<\s*{NAME}\s*>>|<%=?\s*{NAME}\s*%>|@@\s*{NAME}\s*@@|(?<![A-Za-z0-9])__\s*{NAME}\s*__(?![A-Za-z0-9])"
    rf"|\$\{{\s*{NAME}\s*\}}|%\({NAME}\)s|#{NAME}#|%{NAME}%|\${NAME}\$|(?<![\\\w\]}}])\[{NAME}\]|(?<![\\\w\]}}\^_])\{{{NAME}\}}|<{NAME}>"
)
HINT = re.compile(r"[{}\[\]<>@#%$]|__")
SPLIT = re.compile(r"[\n\r\u2028\u2029]+|(?<=[.!?;])[ \t\u00a0]+(?=\S)")
# Addresses and dates, in a form that Python and Arrow read alike. An address ends before tags and closing punctuation.
ADDRESS = r"""(?:\b[A-Za-z][A-Za-z0-9+.-]*://|\b[Ww][Ww][Ww]\.|\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}/)(?:[^\s<>"]*[^\s<>".,!?;:)\]}'])?|\b(?:mailto:)?[A-Za-z0-9_.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"""
MONTH = "(?:jan(?:uary|uar|vier)?|feb(?:ruary|ruar)?|f[ée]vr(?:ier)?|mar(?:ch|s|zo)?|m[äa]rz|apr(?:il)?|avr(?:il)?|ma[iy]|mayo|june?|juni|juin|july?|juli|juil(?:let)?|aug(?:ust)?|ao[uû]t|sept?(?:ember|embre)?|o[ck]t(?:ober|obre)?|nov(?:ember|embre)?|de[cz](?:ember)?|d[ée]c(?:embre)?|enero|ene|febrero|abr(?:il)?|junio|julio|ago(?:sto)?|sep?tiembre|octubre|noviembre|dic(?:iembre)?)"
DAY = "(?:mon|tues|wednes|thurs|fri|satur|sun)day|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|lunes|martes|mi[ée]rcoles|jueves|viernes|s[áa]bado|domingo"
NUMBER = r"\d+(?:st|nd|rd|th)?"
DATE = rf"\b(?:(?:{DAY}),? +)?(?:{NUMBER}\.?(?: +(?:of|de))? +{MONTH}\b\.?(?:,?(?: +de)? +\d{{4}}\b)?|{MONTH}\b\.? +{NUMBER}\b(?:,? +\d{{4}}\b)?)"
#: What message hashes leave out besides digits: of dates, the names of months and days, so that sentences end where they did.
UNHASHED = rf"{ADDRESS}|(?i:\b\d{{4}}-\d\d-\d\dt[\d:.]*\dz?\b|\b(?:{MONTH}|{DAY})\b|\b\d+(?:st|nd|rd|th)\b)"
ELSEWHERE = re.compile(rf"{ADDRESS}|(?i:{DATE})")
MASKED = re.compile(rf"(?i:{DATE})|(?:https?://|www\.)\S+|\S+@\S+\.\w+|\b" r"\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?)?\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d+(?:[.,:]\d+)*\b")
ERROR_CODE = re.compile(r"[45]\d\d")
LETTERS = re.compile(r"[^\W\d_]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
FURNITURE = re.compile(r"^(?:#{1,6} |[-*+>|] ?|\d+[.)] |©|\(c\) |%)|\||^\\(?:documentclass|usepackage|usetikzlibrary|begin|end|section|subsection|subsubsection|chapter|paragraph|title|author|date|maketitle|label|centering|includegraphics|tableofcontents|caption|item|bibliography\w*|ref|cite|input)\b")
# What draws, what is a formula, what fills a page, and what only defines (its arguments follow).
DRAWING = r"\\(?:draw|node|fill|filldraw|path|addplot|arrow|foreach|coordinate|matrix|shade|clip)\b"
CODE = re.compile(DRAWING + r"|\\(?:sum|frac|int|mathcal)\b|\S\s*&\s*\S.*\\\\")
FILLING_COMMAND = re.compile(r"\\(?:lipsum|blindtext|Blindtext|blinddocument|Blinddocument|kant)\*?(?![A-Za-z])(?:\[[^\]\n]*\])*")
DEFINITION = re.compile(r"\\(?:(?:re)?newcommand|providecommand|DeclareRobustCommand|DeclareMathOperator|[gex]?def|newenvironment|renewenvironment|newtheorem|definecolor|colorlet|tikzset|tikzstyle|pgfplotsset|pgfkeys|lstset|hypersetup|setlength|newlength)(?![A-Za-z])\*?")
DRAWS = re.compile(DRAWING)
BRACKET = re.compile(r"\\.|[{}\[\]]", re.S)
#: What stands between the arguments of a definition: blanks within a line, a name, parameters, an equals sign.
DEFINED = re.compile(r"[ \t]*(?:\\[A-Za-z@]+\*?)?(?:#\d)*[ \t]*=?[ \t]*(?:%?\n[ \t]*(?=[{\[]))?")
ARGUMENT = re.compile(r"^\\(?:title|author|section|subsection|subsubsection|caption|date|paragraph|chapter)\*?(?:\[[^\]]*\])?\{(.*?)\}?\s*(?:\\label\{[^}]*\})?$")
LABELLED = re.compile(r"^[A-Z]\w+: ")
BLANK = "\N{OBJECT REPLACEMENT CHARACTER}"


def folded(text: str) -> str:
    """Lower case without accents, white space collapsed, typographic apostrophes as plain ones."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.replace("\N{RIGHT SINGLE QUOTATION MARK}", "'")) if not unicodedata.combining(c))
    return " ".join(text.lower().split())


def _closes(text: str) -> dict[int, int]:
    """By place of each opening bracket that is closed: the place after the one that closes it."""
    opened, out = [], {}
    for m in BRACKET.finditer(text):
        c = m[0]
        if c in "{[":
            opened.append((c, m.start()))
        elif c == "}":
            while opened and opened[-1][0] == "[":
                opened.pop()
            if opened:
                out[opened.pop()[1]] = m.end()
        elif c == "]" and opened and opened[-1][0] == "[":
            out[opened.pop()[1]] = m.end()
    return out


def without_definitions(text: str) -> str:
    """A text without the definitions of macros, colours, styles and lengths."""
    found = list(DEFINITION.finditer(text)) if "\\" in text else []
    if not found:
        return text
    closes, kept, last = _closes(text), [], 0
    for m in found:
        if m.start() < last:
            continue
        end, at = m.end(), DEFINED.match(text, m.end()).end()
        while at in closes:
            end = closes[at]
            at = DEFINED.match(text, end).end()
        if end > m.end():
            kept.append(text[last : m.start()])
            last = end
    return "".join(kept) + text[last:]


def calculates_or_draws(text: str) -> bool:
    """Whether a text holds drawing statements, even in definitions (these may be all of a figure), or formulas outside of them."""
    return bool(DRAWS.search(text)) or bool(CODE.search(without_definitions(text)))


def messages(text: str) -> list[str]:
    """The lines and sentences of a text, without HTML tags."""
    # without a closing tag, <title> and the like are placeholders
    return [m for part in SPLIT.split(TAG.sub("\n", text) if "</" in text else text) if (m := part.strip())]


def skeleton(message: str) -> str | None:
    """A message with placeholders, these and its numbers masked; None if it has no placeholder."""
    if not HINT.search(message) or "\\" in message:
        return None
    masked, n = PLACEHOLDER.subn(BLANK, message)
    return MASKED.sub("0", folded(masked)) if n else None


def _message_hashes(column: pa.Array):
    """By block: row and hash of each message, letters only, which masks numbers, case and punctuation; addresses and dates are
    masked before. Messages of fewer than four letters are left out. Splits at line ends and at ends of sentences."""
    for block in blocks(pc.replace_substring_regex(column, UNHASHED, "0")):
        data, offsets = block.data, block.offsets
        if not len(data):
            continue
        symbol, kind = symbols(data)
        digit = (data >= 48) & (data <= 57)
        symbol[digit] = 0
        wide = np.unique(symbol[symbol >= 128])
        numerals = [c for c in wide.tolist() if chr(c).isdecimal()]
        if numerals:
            symbol[np.isin(symbol, numerals)] = 0
        space = (data == 10) | (data == 13) | (data == 32) | (data == 9)
        stop = (data == 46) | (data == 33) | (data == 63) | (data == 59)
        cut = (data == 10) | (data == 13) | (data == 60) | (data == 62)
        cut[1:] |= space[1:] & stop[:-1]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        first = np.flatnonzero(cut)
        first = np.concatenate(([0], first)) if not len(first) or first[0] else first
        letter = symbol > 0
        rank = np.concatenate(([0], np.cumsum(letter)))
        end = np.append(first[1:], len(data))
        n = rank[end] - rank[first]
        place = rank[:-1] - np.repeat(rank[first], end - first)
        value = np.add.reduceat(symbol.astype(np.uint64) * powers(BASE, int(n.max()) + 1)[np.minimum(place, int(n.max()))], first)
        good = n >= 4
        row = np.searchsorted(offsets, first[good], side="right") - 1
        yield block.first + row, mixed(value[good] + n[good].astype(np.uint64))


def hashes_of(parts: list[str]) -> np.ndarray:
    """The hashes that ``_message_hashes`` gives messages; 0 for those that it would cut further or leave out."""
    out, times = np.zeros(len(parts), np.uint64), np.zeros(len(parts), np.int64)
    for row, value in _message_hashes(pa.array(parts, pa.string())):
        out[row] = value
        times += np.bincount(row, minlength=len(parts))
    out[times != 1] = 0
    return out


def _counted(batches):
    """(hash, origin hash, skeleton): each message once for a row; template sentences bring their masked text along."""
    for batch in batches:
        texts, origins = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, value in _message_hashes(texts):
            joint = np.unique(np.stack([value, row.astype(np.uint64)]), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
            yield _count_rows(joint[0].view(np.int64), origins[joint[1].astype(np.int64)], None)
        values, rows, texts_of = [], [], []
        for i, text in enumerate(texts.to_pylist()):
            # a document that draws or calculates teaches no template
            if text and not calculates_or_draws(text) and PLACEHOLDER.search(text):
                for s in {s for m in messages(without_definitions(text)) if (s := skeleton(m)) and len(WORD.findall(s)) >= 2}:
                    values.append(hash_of(s))
                    rows.append(origins[i])
                    texts_of.append(s)
        if values:
            yield _count_rows(np.array(values, np.int64), np.array(rows, np.int64), texts_of)


def hash_of(text: str) -> int:
    """A stable 64-bit hash of a short string."""
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    return int(mixed((np.add.reduce((data + np.uint64(1)) * powers(BASE, len(data))) + np.uint64(len(data)))[None])[0].astype(np.int64))


def _count_rows(value, origin, text):
    return pa.RecordBatch.from_arrays([pa.array(value), pa.array(origin), pa.array(text if text is not None else [None] * len(value), pa.string())], names=["hash", "origin", "skeleton"])


def template_text(message: str) -> str:
    """A message as it is held against template sentences."""
    return MASKED.sub("0", folded(PLACEHOLDER.sub("it", message)))


@lru_cache(4096)
def pattern(sentence: str) -> re.Pattern:
    """What a template sentence gives when it is filled."""
    return re.compile(r"\S.{0,60}?".join(re.escape(part) for part in sentence.split(BLANK)) + r"\Z")


def template_key(sentence: str) -> str:
    """The longest word of a template sentence that touches no blank, so that each text it matches has it; "" if there is none."""
    whole = [m[0] for m in LETTERS.finditer(sentence) if sentence[m.start() - 1 : m.start()] != BLANK and sentence[m.end() : m.end() + 1] != BLANK]
    return max(whole, key=lambda w: (len(w), w), default="")


RESIDUE, FURNISHED, CONTENT, UNSURE = "residue", "furniture", "content", "unsure"


def classify(message: str, recurs: bool) -> str:
    """What a message is by the rules; UNSURE: a sentence that a template may hold."""
    inner = ARGUMENT.match(message)
    plain = folded(inner[1] if inner else message.lstrip("%# ") if message.startswith(("%", "#")) and not PLACEHOLDER.match(message) else message)
    # addresses and dates are words of no language
    words = WORD.findall(ELSEWHERE.sub(" ", plain))
    if skeleton(message):
        return RESIDUE
    if CODE.search(message):
        return CONTENT
    rest, n = FILLING_COMMAND.subn("", message)
    if n:
        kind = classify(rest.strip(), recurs) if rest.strip() else FURNISHED
        return RESIDUE if kind == FURNISHED else kind
    if RULES.search(plain):
        others = [w for w in WORD.findall(ELSEWHERE.sub(" ", RULES.sub(" ", plain))) if w not in KNOWN]
        if recurs or len(words) <= 4 or (len(words) <= LONGEST_RULE_WORDS and len(others) <= max(1, FOREIGN_SHARE * len(words))):
            return RESIDUE
        # prose that mentions a phrase
        if not FURNITURE.search(message):
            return CONTENT
    if len(words) <= LONGEST_RULE_WORDS and KNOWN.issuperset(words) and not STATE_WORDS.isdisjoint(words) and not OBJECT_WORDS.isdisjoint(words):
        return RESIDUE
    if FURNITURE.search(message) or not words:
        return FURNISHED
    if (recurs and sum(w in KNOWN for w in words) >= KNOWN_SHARE * len(words)) or len(words) < 4 or LABELLED.match(message) and len(words) <= 5:
        return FURNISHED
    if message[-1] not in ".!?:;" and len(words) <= 8:
        return FURNISHED
    return UNSURE


def talks_of_placeholders(message: str) -> bool:
    rest, n = PLACEHOLDER.subn(" ", message)
    return n > 0 and len(WORD.findall(rest)) >= LONG_TEMPLATE_WORDS


def masked(message: str) -> str:
    """A message with addresses, dates and numbers masked, but for error codes: messages that are alike in this are classified once."""
    return MASKED.sub(lambda m: m[0] if ERROR_CODE.fullmatch(m[0]) else "0", ELSEWHERE.sub("0", " ".join(message.split())))


def candidate(text: str) -> list[tuple[str, str, str | None, bool]]:
    """The messages of a text that may be residue, each as (message, what it is grouped by, itself as a sentence of a template, whether it
    talks of placeholders); none if some message is content whatever recurs, or if none can be residue."""
    if calculates_or_draws(text):
        return []
    text = without_definitions(text)
    placeholders = bool(PLACEHOLDER.search(text))
    found, out = False, []
    for message in messages(text):
        kind = classify(message, False)
        kinds = {kind} if kind == RESIDUE else {kind, classify(message, True)}
        if kinds == {CONTENT} or kinds == {UNSURE} and not placeholders:
            return []
        found |= RESIDUE in kinds
        if kinds != {FURNISHED}:
            out.append((message, masked(message), template_text(message) if placeholders else None, placeholders and talks_of_placeholders(message)))
    return out if found else []


PART = pa.struct([("hash", pa.int64()), ("form", pa.string()), ("sentence", pa.string()), ("talks", pa.bool_())])


def _candidates(batches):
    """(id, parts) of every row; of texts that may be residue, parts are the hash, form, sentence and talk of each message."""
    for batch in batches:
        found = [candidate(t) if t else [] for t in batch.column(1).to_pylist()]
        parts = [part for mine in found for part in mine]
        # a message that has no hash of its own stands alone
        hashes = hashes_of([m for m, *_ in parts]).view(np.int64) if parts else np.zeros(0, np.int64)
        forms, sentences, talks = ([p[k] for p in parts] for k in (1, 2, 3))
        values = pa.StructArray.from_arrays([pa.array(hashes), pa.array(forms, pa.string()), pa.array(sentences, pa.string()), pa.array(talks, pa.bool_())], fields=list(PART))
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(mine) for mine in found]))).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=["id", "parts"])


def _classified(batches):
    for batch in batches:
        forms = batch.column(0).to_pylist()
        kinds = [[classify(f, recurs) for f in forms] for recurs in (False, True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(k, pa.string()) for k in kinds)], names=["form", "alone", "recurring"])


def _sentence_keys(batches):
    for batch in batches:
        rows = [(s, k) for s in batch.column(0).to_pylist() for k in {"", *LETTERS.findall(s)}]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["sentence", "key"])


def _skeleton_keys(batches):
    for batch in batches:
        rows = [(s, template_key(s), s.split(BLANK)[0], s.split(BLANK)[-1]) for s in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["skeleton", "key", "head", "tail"])


def _fitting(batches):
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted({s for s, t in pairs if pattern(t).match(s)}), pa.string())], names=["sentence"])


def recurring(df: DataFrame, text_col: str = "text", origin_col: str = "origin", id_col: str = "doc_id") -> DataFrame:
    """(hash, skeleton, n_origins) of the messages that recur. A document without an origin is an origin of its own."""
    origin = F.when(F.col(origin_col).isNull(), F.xxhash64(F.lit("none"), F.col(id_col))).otherwise(F.xxhash64(F.col(origin_col)))
    text = df.select(F.col(text_col).alias("text"), origin.alias("origin_hash")).where("text is not null")
    rows = text.mapInArrow(_counted, "hash long, origin long, skeleton string")
    once = rows.groupBy("hash", "origin").agg(F.max("skeleton").alias("skeleton"))
    least = F.when(F.col("skeleton").isNotNull(), TEMPLATE_ORIGINS).otherwise(LEAST_ORIGINS)
    return once.groupBy("hash").agg(F.max("skeleton").alias("skeleton"), F.count("*").alias("n_origins")).where(F.col("n_origins") >= least)


def classes(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(hash, form, kind): the groups of messages that ``asked`` (hash, form) holds, each classified once, by the rules for messages that
    recur if its hash is among those of ``found``, and by the rules for those that stand alone if not."""
    groups = asked.select("hash", "form").distinct()
    kinds = groups.select("form").distinct().mapInArrow(_classified, "form string, alone string, recurring string")
    recur = found.where("skeleton is null").select("hash", F.lit(True).alias("recurs"))
    return groups.join(recur, "hash", "left").join(kinds, "form").select("hash", "form", F.when(F.col("recurs"), F.col("recurring")).otherwise(F.col("alone")).alias("kind"))


def residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", origin_col: str = "origin") -> DataFrame:
    """(id, residue) of every row: whether its text is residue only. Null and empty texts are not. Other columns are not read."""
    kind = df.schema[id_col].dataType.simpleString()
    parts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_candidates, f"id {kind}, parts array<struct<hash:long,form:string,sentence:string,talks:boolean>>")
    rows = materialise(parts.withColumn("row", F.monotonically_increasing_id()))
    asked = rows.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    found = materialise(recurring(df, text_col, origin_col, id_col))
    sentences = asked.where("sentence is not null").select("sentence").distinct()
    keyed = sentences.mapInArrow(_sentence_keys, "sentence string, key string")
    skeletons = found.where("skeleton is not null").select("skeleton").mapInArrow(_skeleton_keys, "skeleton string, key string, head string, tail string")
    pairs = keyed.join(skeletons, "key").where(F.startswith("sentence", "head") & F.endswith("sentence", "tail")).select("sentence", "skeleton")
    fitting = pairs.mapInArrow(_fitting, "sentence string").distinct().withColumn("fits", F.lit(True))
    joined = asked.join(classes(asked, found), ["hash", "form"]).join(fitting, "sentence", "left")
    doubtful = (F.col("kind") == UNSURE) | ((F.col("kind") == RESIDUE) & F.col("talks"))
    content = (F.col("kind") == CONTENT) | (doubtful & F.col("fits").isNull())
    judged = joined.groupBy("row").agg((F.bool_or(F.col("kind") == RESIDUE) & ~F.bool_or(content)).alias("residue"))
    none = rows.where(F.size("parts") == 0).select("id", F.lit(False).alias("residue"))
    return none.unionByName(rows.where(F.size("parts") > 0).select("row", "id").join(judged, "row").select("id", "residue"))


def p7_found(df: DataFrame) -> DataFrame:
    return residue(df).where("residue").select(F.col("id").alias("doc_id"))
