"""Sentences that stand for content without being any: error messages, notices that
scripts are needed, placeholders, filler, template fields left unfilled.

What a sentence is about and what went wrong are looked up as words, in any
order and wording; a sentence that tells a story (a year, names, quotation
marks around the words) is none.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick

# Stems of words, by what they say in a message, in English,
# German, French, Spanish, Russian and Japanese; names of HTTP states.
THINGS = """
page|site|website|url|address|document|content|resource|file|request|server|link|access|session|service|database|connection|gateway|permission|error
seite|inhalt|adresse|dokument|datei|anfrage|dienst|zugriff|sitzung|fehler|ressource|requête|serveur|lien|accès|erreur|contenu|document
página|enlace|contenido|documento|archivo|solicitud|servidor|acceso|sesión|servicio|error|страниц|доступ|сервер|ошибк|ページ|アクセス|サーバー
"""
FAILS = """
not found|can't find|cannot find|can’t find|couldn't find|could not be (?:located|found)|was not found|does not exist|doesn't exist|no longer (?:exists|available)|has (?:been )?(?:moved|removed|expired)|may have moved|mistyped
unavailable|denied|forbidden|unauthorized|blocked|expired|failed|timed out|time-?out|can't be reached|cannot be reached|don't have permission|do not have permission|not authorized|went wrong|reload to|retry in|under maintenance|down for maintenance|out of order|try again
nicht gefunden|existiert nicht|nicht mehr verfügbar|nicht verfügbar|verweigert|gesperrt|abgelaufen|fehlgeschlagen|introuvable|n'existe pas|n'existe plus|n’existe pas|indisponible|refusé|expiré|échoué|a rencontré un problème
no encontrad|no existe|no disponible|denegad|caducad|puede estar roto|ha fallado|не найден|запрещ|недоступ|見つかりません|拒否されました|存在しません
"""
STATES = """
bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|length required|precondition failed|too many requests
internal server error|not implemented|bad gateway|service unavailable|service temporarily unavailable|gateway timeout|gateway time-out
"""
COOKIES = r"(?:enable|allow|activate|aktivieren sie|activez|activer|active|habilite) (?:\w+ )?cookies|cookies (?:are |must be |need to be )?(?:disabled|required|enabled|turned off|deaktiviert|erforderlich)"
SCRIPTS = "javascript|scripts?|browser|navegador|navigateur|captcha|human|robot|scripting"
SWITCHES = """
enable|disabled|required|requires|needed|needs?|turn|switch|allow|activate|supported|checking|verify|verifying|aktivieren|deaktiviert|benötigt|erforderlich|activer|activez|désactivé|nécessaire|requis
active|activar|habilite|habilitar|desactivado|necesario|out of date|are you|i'm not|you are|one more step|prove
"""
FILLERS = """
placeholder|sample text|dummy text|text goes here|headline here|your (?:\\w+ )?here|insert [^.]* here|replace this|to be written|to be determined|tbd|coming soon|content pending|text to follow|sample page|example page
hello world|made by the installer|remove it when you write your own|text folgt|blindtext|beispieltext|platzhalter|texte à venir|texte d'exemple|texto pendiente|texto por venir|texto de ejemplo
"""
FIELDS = """
title headline subtitle summary body content text date time year month day name first_name last_name author email phone
city country state address zip street org organisation organization company unit station site site_name url link image
id user username page page.title author.name article_body report_year description category tag price amount total
""".split()
EXPLAINS = r"(?i)stands? for|such as|\bexplains?\b|field such|template may|\bsyntax\b|\bmanual\b|\bmeans\b|\bcalled\b|a set \{|an index \[|\bnotation\b|\bdocumentation\b|\bcode,"
# end of fixed values


def _any(text: str) -> str:
    return "(?:" + "|".join(x for line in text.strip().split("\n") for x in line.split("|")) + ")"


OPEN_FIELDS = re.compile(
    r"\{\{\{?\s*[\w.|:\- ]{1,40}\s*\}?\}\}|\{%\s*[\w.|:\- ]{1,40}\s*%\}|<%=?\s*[\w.|:\- ]{1,40}\s*%>|\$\{\s*[\w.]{1,40}\s*\}|\[\[\s*[\w.|:\- ]{1,40}\s*\]\]"
    r"|\$\$[\w.]{2,40}\$\$|@@[\w.]{2,40}@@|__[A-Za-z][\w.]{1,40}__|\[(?:INSERT|Insert|YOUR|Your|ENTER|Enter)\b[^\]\n]{1,40}\]"
)
NAMED_FIELDS = re.compile(r"%([A-Za-z][\w.]{1,40})%|#([A-Za-z][\w.]{1,40})#|«([A-Za-z][\w.]{1,40})»|<([A-Za-z][\w.]{1,40})>|\{([A-Za-z][\w.]{1,40})\}")
CUES = re.compile(r"[{}%$@<>\[\]#«]|__")
_EXPLAINS = re.compile(EXPLAINS)
_FAIL, _THING = re.compile(rf"(?<!\w){_any(FAILS)}"), re.compile(rf"(?<!\w){_any(THINGS)}")
_STATE = re.compile(rf"(?:(?:http|error|status|code|erreur|fehler|ошибка)\W*)*(?:[45]\d\d)?\W*{_any(STATES)}?\W*\Z")
_CODE = re.compile(r"(?:http(?:/[\d.]+)?|error|status|erreur|fehler|ошибка|エラー)\W{0,3}(?:code|status|error)?\W{0,3}[45]\d\d(?!\d)")
_SCRIPT, _SWITCH = re.compile(rf"(?<!\w)(?:{SCRIPTS})(?!\w)"), re.compile(rf"(?<!\w){_any(SWITCHES)}(?!\w)")
_FILLER = re.compile(rf"(?<!\w){_any(FILLERS)}(?!\w)")
_COOKIES, _STATUS = re.compile(COOKIES), re.compile(rf"\A[45]\d\d\W{{1,4}}{_any(STATES)}(?!\w)")
_CANNOT = re.compile(r"\Acannot (?:get|post|put|head) /")
_BREAK = re.compile(r"(?:fatal|parse|syntax|uncaught|unhandled|runtime)[ \w]{0,12}(?:error|exception)")
_STORY = re.compile(r"[“”\"«»]|(?<!\d)1\d{3}(?!\d)|(?<!\d)20\d\d(?!\d)")
_HAN = re.compile(r"[぀-ヿ㐀-鿿]")


def _tells(sentence: str, allowed: re.Pattern) -> bool:
    """Whether a sentence is a tale: quotation marks, a year, or a name (a capital within) beside the words themselves."""
    if _STORY.search(sentence):
        return True
    words = sentence.split()
    names = [w for w in words[1:] if w[:1].isupper() and not w.isupper()]
    if not names:
        return False
    known = [w for w in names if allowed.search(w.lower()) or w.lower().strip(".,;:!?") in ("javascript", "i", "i'm", "url", "http", "please")]
    german = re.search(r"(?i)(?<!\w)(?:der|die|das|nicht|diese|bitte|und|ist)(?!\w)", sentence)
    return len(known) < len(names) and not german and not sentence.istitle() and len(names) < len(words) - 1


@lru_cache(1 << 16)
def _message(x: str, raw: str) -> bool:
    if _STATE.match(x) and re.search(r"[a-z]{3}", x) or _CANNOT.match(x) or _BREAK.match(x):
        return True
    if _STATUS.match(x) and len(x.split()) <= 25 or _COOKIES.search(x) and not _STORY.search(raw):
        return True
    if _CODE.search(x) and not _STORY.search(raw) and len(x.split()) <= 25:
        return True
    if _FILLER.search(x) and not _STORY.search(raw) and len(x.split()) <= 12:
        return True
    asks = re.search(r"(?<!\w)(?:you|your|please|sie|bitte|vous|veuillez|usted)(?!\w)", x)
    if _SCRIPT.search(x) and _SWITCH.search(x) and not (_STORY.search(raw) if asks else _tells(raw, _SCRIPT)) and (asks or not re.search(r"(?<!\w)(?:was|were|had|who|which)(?!\w)", x)):
        return True
    fail = _FAIL.search(x)
    if fail and not _tells(raw, _THING):
        rest = x[: fail.start()] + " " + x[fail.end() :]
        about = _THING.search(rest) or re.search(r"(?<!\w)(?:we|you|your|please|sorry|oops|something|it|sie|ihr\w*|bitte|vous|votre|usted|su)(?!\w)", rest)
        return bool(about) and (len(x.split()) <= 14 or bool(re.search(r"(?<!\w)(?:you|your|we|sorry|please|sie|bitte|vous|usted)(?!\w)", x)))
    return False


def _triggers() -> ahocorasick.Automaton:
    """Literals of the cues: a line without any is no message."""
    a = ahocorasick.Automaton()
    for table in (FAILS, STATES, SCRIPTS, FILLERS, "cookies|error|erreur|fehler|ошибка|エラー|http|status|exception|cannot "):
        for cue in (c for line in table.strip().split("\n") for c in line.split("|")):
            words = [w for w in re.split(r"\W+", re.sub(r"\(\?:[^)]*\)\??|\\w\S?|\[\^\.\]\S?|.\?", " ", cue)) if w]
            a.add_word(max(words, key=len), 1)
    a.make_automaton()
    return a


TRIGGERS = _triggers()


def may_hold_message(text: str) -> bool:
    """A quick look that never misses: whether any cue's longest word stands in a text."""
    return next(TRIGGERS.iter(text.lower().replace("’", "'")), None) is not None


def message(sentence: str) -> bool:
    """A sentence or line that stands for content: an error, a notice about scripts or checks, a placeholder."""
    x = " ".join(sentence.replace("’", "'").split()).lower().strip(" \t*•–—-»›([)].!…")
    return bool(x) and _message(x, sentence.strip())


def _sentence(text: str, start: int, end: int) -> str:
    a = max(text.rfind("\n", 0, start), *(text.rfind(x, 0, start) for x in (". ", "! ", "? ")))
    b = [i for i in (text.find("\n", end), *(text.find(x, end) for x in (". ", "! ", "? "))) if i >= 0]
    return text[a + 1 : min(b, default=len(text))]


def open_fields(text: str) -> bool:
    """An unfilled template field that its sentence does not explain."""
    if not CUES.search(text):
        return False
    for m in OPEN_FIELDS.finditer(text):
        if not _EXPLAINS.search(_sentence(text, m.start(), m.end())):
            return True
    for m in NAMED_FIELDS.finditer(text):
        name = next(g for g in m.groups() if g)
        if (name.lower() in FIELDS or "_" in name or re.fullmatch(r"[a-z]+\.[a-z]+", name)) and not _EXPLAINS.search(_sentence(text, m.start(), m.end())):
            return True
    return False
