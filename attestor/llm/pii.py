"""Personal information in free text: found by anchors, replaced by placeholders.

One Aho-Corasick pass over a text finds anchors: at-signs and their spelt-out
forms, given names and titles, street and box words, postal marks, identifier
cues, digits.  Small deterministic parsers then read outward from each anchor
and decide the value's bounds and whether it is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.session import spread

# Words that anchor a search.  Lists are plain and can be extended.
GIVEN_NAMES = """
Amara Anselm Bruno Casper Dario Edda Elif Emeka Ewan Felix Freya Greta Hamid Hedda Idris Ilse Imre Ines Jarek Joris
Karin Kofi Leila Livia Lotte Lukas Maeve Mara Marek Milan Nadia Nils Noor Oskar Otto Pavel Petra Priya Rafa Rosa
Salma Signe Sunil Thea Tobin Tomas Vera Wanda Yara Zofia
Alice Andrea Anna Anton Carlos Carmen Chloe Clara Daniel David Elena Emily Emma Eric Erik Eva Fatima George Hannah
Hans Helen Hugo Ivan James Jan Jane Javier Jean John Jonas Jose Juan Julia Karl Klaus Laura Linda Lucia Luis Marie
Maria Mark Martin Mary Michael Miguel Mohammed Monika Olga Paul Pedro Peter Pierre Robert Sarah Simon Sofia Sophie
Stefan Susan Sven Thomas Ursula Walter William Yuki
""".split()
TITLES = "Dr Prof Mr Mrs Ms Mme Mlle Frau Herr Doña Don Sra Sr Señora Señor".split()
STREETS = "Street St Road Rd Lane Ln Avenue Ave Drive Terrace Row Close Way Court Crescent Square Gardens Place".split()
STREETS_DE = "weg straße strasse str. gasse allee platz damm ufer ring".split()
STREETS_DE_AT = "am|an der|an den|an dem|auf der|auf dem|im|in der|in den|zum|zur|unter den|hinter der|hinter dem|vor dem".split("|")
STREETS_FR = "rue quai place allée avenue boulevard chemin impasse cours".split()
STREETS_ES = "Calle Paseo Plaza Avenida Avda. Av. Pza. Camino Ronda Travesía Carretera".split()
ORGANISATIONS = """
Archive Authority Board College Cooperative Council Desk Field Guild Harbour Institute Journal Museum Observatory
Office Ports Registry Review Society Station Survey Trust University Water Weekly Street Road Lane Quay
""".split()
NO_SURNAMES = """
The This That These Those There Then They When Where What Who Why How In On At By For From If It Its Is As An And Or
But Not No Only After Before Between Without With According Some Each Every About More Prices Critics Officials See
Table Box To We You He She Der Die Das Ein Eine Le La Les El Los Las Un Une Une Desde Entre Selon Nach Zwischen
""".split()
# words of both lists that are surnames as well: after a given name or title they end a name
SURNAMES_TOO = "Lane Field Street Harbour Quay Road Desk Water Weekly More Prices Box Table See By You She To No Or An Le La Das Such".split()
BEFORE_PLACE = re.compile(r"(?:\d[a-z]?|(?i:\b(?:on|in|at|along|near|from|to|the|of|off|past|into|across)))[ ]$")
# given names and surname ends of Russian, by their stems; titles come in all cases
RU_GIVEN = """
Александр Алексей Анатолий Андрей Антон Аркадий Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир Вячеслав Геннадий Георгий
Григорий Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин Леонид Максим Михаил Никита Николай Олег Павел Пётр Петр Роман
Сергей Степан Тимофей Фёдор Федор Юрий Ярослав Анна Анастасия Валентина Вера Виктория Галина Дарья Евгения Екатерина Елена Елизавета
Зинаида Зоя Ирина Ксения Лариса Лидия Любовь Людмила Маргарита Марина Мария Надежда Наталья Нина Оксана Ольга Полина Раиса Светлана София Софья
Тамара Татьяна Юлия
""".split()
RU_TITLES = "господин|госпожа|г-н|г-жа|доктор|профессор|академик|доцент|д-р|проф\\.|директор|инженер|врач|гражданин|гражданка|товарищ"
RU_STOP = """
а в во и к ко на но не о об он она они оно от по под при с со то у это этот эта эти как что где когда кто для до за из или если мы вы я так там тут его её их
институт университет музей архив общество станция совет центр академия библиотека улица площадь набережная проспект завод порт газета журнал
""".split()
# surnames and honorifics of Japanese; a given name stands between them
JA_SURNAMES = """
佐藤 鈴木 高橋 田中 伊藤 渡辺 渡邊 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 斎藤 斉藤 林 清水 山崎 森 池田 橋本 阿部 石川 山下 中島 石井 小川 前田 岡田
長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本 福田 太田 西村 藤井 金子 岡本 藤原 三浦 中野 原田 松田 竹内 上田 中山 和田 森田 石田 柴田 酒井 宮崎 横山 高木 安藤 大野 工藤
""".split()
JA_HONORIFICS = "さん|様|さま|氏|先生|教授|准教授|博士|医師|記者|君|くん|ちゃん"
JA_CUES = "氏名|名前|お名前|担当|担当者|著者|作成者|連絡先|責任者|代表者|筆者"
JA_NOT_GIVEN = "市|町|村|区|県|駅|川|山|橋|港|校|社|店|家|部|課|局|市長|町長|村長|社長|部長|課長|所長|会長|知事|大臣|議員|委員|大学|教授|准教授|博士|先生|医師|記者|選手|監督|研究所|博物館|通り|夫妻|両".split("|")
# words beside a name that has no listed given name: labels and kin are enough,
# of the others two must stand there
NAME_LABELS = "name|full name|contact|contact person|author|attn|attention|dear|cc|signed|sincerely|kind regards|best regards|regards|patient|employee|applicant|tenant|recipient|ansprechpartner|kontakt|autor|auteur|contacto|nombre|nom"
KIN = "mother|father|brother|sister|wife|husband|son|daughter|uncle|aunt|widow|widower|colleague|neighbour|friend|engineer|nurse|teacher|editor|director|manager|professor|chairman|chairwoman|secretary|surveyor|librarian|mayor"
BEFORE_NAME = "by|with|to|from|and|met|told|asked|called|for|thanks|thank|von|mit|par|avec|por|con"
AFTER_NAME = "said|says|told|asked|wrote|writes|argued|argues|explained|explains|added|adds|replied|agreed|agrees|joined|resigned|retired|lives|lived|works|worked|signed|thinks|believes|recalls|recalled|sagte|schrieb|a dit|écrit|dijo|escribió"
NOT_IN_NAMES = """
monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
north south east west northern southern eastern western upper lower old new great little saint port mount lake river bay isle island point county
national royal general public central local annual first second third final chapter figure part section volume page board trust office
""".split()
STREETS_MORE = "Boulevard Blvd Parade Grove Hill Mews Walk Quay Wharf Rise Green Circus Embankment Parkway Alley Path Park View Bank Cliff Ct Dr Sq Pl".split()
ID_CUES = """
ssn|social security|sécurité|seguridad social|sozialversicherung|steuer-id|steuer|tax_id|tax id|tax no|dni|nie|nif|
national identity|identity number|id number|id card|payroll|personnel no|passport|passeport|pasaporte|reisepass|ni no|nino
""".replace("\n", "").split("|")
NOT_ID_CUES = "sample|grant|catalogue|shelf mark|isbn|issn|doi|gauge|fig.|table|version|package|position|rate|season|population".split("|")
PHONE_CUES = "tel|phone|mobile|m:|call|ring|number is|fax|unter|電話|тел".split("|")

U, L = "A-ZÀ-ÖØ-ÞŁŚŠŽČ", "a-zß-öø-ÿāăąćčďđēėęěğīįłńňōőœřśşšţťūůűźżž"
NAME = rf"[{U}][{L}'’]+|[{U}][{U}'’]+"
SURNAME = rf"(?:{NAME})(?:-(?:{NAME}))?"
PLACE_WORDS = {w.lower().rstrip(".") for w in STREETS + STREETS_MORE + ORGANISATIONS + NOT_IN_NAMES} | {w.lower() for w in NO_SURNAMES}
SEQUENCE = re.compile(rf"(?<![\w.'’@/-])((?:{NAME})(?:-(?:{NAME}))?(?:[ \u00a0](?:{NAME})(?:-(?:{NAME}))?){{1,3}})(?![\w@/-])")
BEFORE_LABELLED = re.compile(r"[ ]*[:,]?[ \n]+")
BEFORE_FOLLOWED = re.compile(rf"(?<![\w.'’@/-])((?:{NAME})(?:-(?:{NAME}))?(?:[ \u00a0](?:{NAME})(?:-(?:{NAME}))?){{1,3}}),?[ ]?$")
LABELLED = re.compile(rf"(?i)(?:(?<!\w)(?:{NAME_LABELS})[ ]*[:,]?[ \n]+)$")
RELATED = re.compile(rf"(?i)(?<!\w)(?:{KIN}),?[ ]$")
LED = re.compile(rf"(?<!\w)(?:{BEFORE_NAME})[ ]$")
FOLLOWED = re.compile(rf",?[ ](?:{AFTER_NAME})(?!\w)|,[ ](?:who|aged|\d\d,|the (?:{KIN})|an? (?:{KIN})|{KIN})(?!\w)")
SPOKE = re.compile(r",?[ ](?:said|told|asked|wrote|explained|recalled|replied|resigned|sagte|schrieb|dijo)(?!\w)")
FORWARD = re.compile(rf"[ \u00a0]+(?:[{U}]\.[ \u00a0]+){{0,2}}({SURNAME})(?![\w@])")
WRAPPED = re.compile(rf"[ ]*\n[ ]*(?:[{U}]\.[ ]+){{0,2}}({SURNAME})(?![\w@])")
BACKWARD = re.compile(rf"(?<![\w@.\-])({SURNAME}),[ ]+$")
INITIALS = re.compile(rf"(?<![\w.@])(?:[{U}]\.[ ]?){{1,2}}[ ]?({SURNAME})(?![\w@])")
AFTER_INITIAL = re.compile(rf"(?<![\w@.\-])({SURNAME}),[ ]+[{U}]\.(?!\w)")
TITLED = re.compile(rf"\.?[ ]+((?:{NAME})[ ]+(?:[{U}]\.[ ]+)?{SURNAME}|(?:[{U}]\.[ ]?){{1,2}}[ ]?{SURNAME}|{SURNAME},[ ]+(?:{NAME}))(?![\w@])")

RU_NAME = r"(?:[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?|[А-ЯЁ]{2,}(?:-[А-ЯЁ]{2,})?)"
RU_WORD = re.compile(rf"(?<![\w-]){RU_NAME}(?![\w-])")
RU_FATHER = re.compile(r"(?i)(?:ич(?:а|у|ем|е)?|(?:вн|чн)(?:а|ы|е|у|ой))\Z")
RU_ENDS = re.compile(r"(?i)(?:(?:[оеё]в|[иы]н)(?:а|у|ым|е|ой)?|(?:[сц]к)(?:ий|ого|ому|им|ом|ая|ой|ую)|енко|[уюа]к(?:а|у|ом|е)?|ич(?:а|у|ем|е)?|[ыи]х)\Z")
RU_INITIALS = re.compile(rf"(?<![\w.-])[А-ЯЁ]\.(?:[ ]?[А-ЯЁ]\.)?[ ]?({RU_NAME})(?![\w-])")
RU_AFTER = re.compile(rf"(?<![\w-])({RU_NAME}),?[ ][А-ЯЁ]\.([ ]?[А-ЯЁ]\.)?(?!\w|[ ]?[А-ЯЁ])")
RU_TITLED = re.compile(rf"(?<![\w-])(?i:(?:{RU_TITLES})(?:а|у|ом|е|я|ю|ем|и|ой)?)[ ]({RU_NAME}[ ]{RU_NAME}(?:[ ]{RU_NAME})?)(?![\w-])")
HAN, KANA = r"[\u3400-\u9fff々]", r"[ァ-ヺー]"
JA_GIVEN = rf"(?:{HAN}{{1,3}}?|[ぁ-ゖ]{{2,4}}?|[ァ-ヺー]{{2,6}}?)"
JA_LISTED = re.compile(rf"(?<!{HAN})(?:{'|'.join(sorted(JA_SURNAMES, key=len, reverse=True))})[ \u3000]?({JA_GIVEN})[ \u3000]?(?={JA_HONORIFICS})")
JA_SPACED = re.compile(rf"(?<!{HAN}){HAN}{{1,4}}[ \u3000]({JA_GIVEN})[ \u3000]?(?={JA_HONORIFICS})")
JA_CUED = re.compile(rf"(?:{JA_CUES})(?:は|[:：])[ \u3000]*((?:(?:{'|'.join(sorted(JA_SURNAMES, key=len, reverse=True))})[ \u3000]?|{HAN}{{1,4}}[ \u3000])(?:{HAN}{{1,3}}|[ぁ-ゖ]{{2,4}}|{KANA}{{2,6}}))(?![\w々])")
JA_FOREIGN = re.compile(rf"(?<!{KANA})({KANA}{{2,}}(?:[・＝]{KANA}+)+)[ \u3000]?(?={JA_HONORIFICS})")

LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
LOCAL = r"[A-Za-z0-9_%+\-]+(?:\.[A-Za-z0-9_%+\-]+)*"
LOCAL_CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-.")
LOCAL_PART = re.compile(rf"({LOCAL})\Z")
DOMAIN = re.compile(rf"({LABEL}(?:\.{LABEL})*\.[A-Za-z]{{2,}})(?![A-Za-z0-9\-]|\.[A-Za-z0-9])")
DOT = r"(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\})[ ]?|[ ]dot[ ]|\.)"
SPELT_DOMAIN = re.compile(rf"[ ]?({LABEL}(?:{DOT}{LABEL})*{DOT}[A-Za-z]{{2,}})(?![A-Za-z0-9\-])", re.I)

EXT = r"(?:[ ,]*(?:ext\.?|extension|x|#)[ ]?\d{1,6}(?!\d))?"
SEP = r"[ .\-\u00a0]?"
PHONES = [
    re.compile(rf"\+\d{{1,3}}{SEP}(?:\(\d{{1,4}}\){SEP})?\d(?:{SEP}\d){{5,12}}(?!\d){EXT}"),
    re.compile(rf"00[1-9]\d{SEP}(?:\(\d{{1,4}}\){SEP})?\d(?:{SEP}\d){{5,11}}(?!\d){EXT}"),
    re.compile(rf"(?:1[\-. ])?(?:\([2-9]\d\d\)[ ]?|[2-9]\d\d[\-. ])[2-9]\d\d[\-. ]\d{{4}}(?!\d){EXT}"),
    re.compile(rf"(?:\(0\d{{1,4}}\)|0[1-9]\d{{0,3}}){SEP}\d{{2,}}(?:{SEP}\d{{2,}}){{0,4}}(?!\d){EXT}"),
]
SCHEME_PHONE = re.compile(rf"\+?\d(?:{SEP}\(?\d\)?){{5,14}}(?!\d){EXT}")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"[3-6]\d{3}([ -])\d{4}\1\d{4}\1\d{4}(?!\d|\1\d)|[3-6]\d{12,18}(?!\d)")
TWELVE = re.compile(r"\d{4}[ -]?(?:[\dA-Z]{4}[ -]?){2}")
LOCAL_PHONE = re.compile(rf"\d{{3}}-\d{{4}}(?![\d\-]){EXT}")
STRONG_IDS = [
    re.compile(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w])"),  # national insurance
    re.compile(r"[XYZ]\d{7}-?[A-Z](?!\w)"),
    re.compile(r"\d{8}-?[A-Z](?!\w)"),
    re.compile(r"\d{6}[-+]\d{4}(?![\w\-])"),
    re.compile(r"\d{3}-\d{2}-\d{4}(?![\w\-])"),
    re.compile(r"\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}(?!\w)"),
]
CUED_IDS = [
    re.compile(r"\d{3} \d{2} \d{4}(?!\w)"),
    re.compile(r"\d{2} \d{3} \d{3} \d{3}(?!\w)"),
    re.compile(r"[A-Z]{1,2}\d{6,8}(?!\w)"),
    re.compile(r"[A-Z]\d[A-Z]\d{5}(?!\w)"),
    re.compile(r"[A-Z0-9]{2,4}(?:[ \-]?[A-Z0-9]{2,4}){1,5}(?!\w)"),
]
CUE_GAP = re.compile(r"\.?[\"'”]?[ ]?(?:no\.?|number|nr\.?|ref\.?|núm\.?|n°)?[\"'”]?[ ]*[:=#]?[ ]*[\"'“]?", re.I)

TOWN = rf"[{U}][{L}]+(?:[ \-][{U}][{L}]+)?"
BREAK = r"(?:,[ ]*\n?[ ]*|[ ]*\n[ ]*)"
ADDRESSES = {
    "en": re.compile(
        rf"(?:(?:Flat|Apt|Unit|Suite)\.?[ ]\d+[a-z]?{BREAK})?\d{{1,5}}[a-z]?[ ](?:[{U}][{L}'’]+[ ]){{1,3}}(?:{'|'.join(STREETS + STREETS_MORE)})\b\.?"
        rf"(?:{BREAK}(?:Flat|Apt|Unit|Suite|Floor)\.?[ ]\d+[a-z]?)?{BREAK}({TOWN}(?:,?[ ][A-Z]{{1,2}}\d[A-Z\d]?[ ]\d[A-Z]{{2}}|,?[ ][A-Z]{{2}}[ ]\d{{5}}(?:-\d{{4}})?)?)"
    ),
    "box": re.compile(
        rf"(?:P\.?[ ]?O\.?[ ]?Box|Postfach|Apartado|BP)[ ]\d+{BREAK}((?:\d{{5}}[ ])?{TOWN}(?:,?[ ][A-Z]{{1,2}}\d[A-Z\d]?[ ]\d[A-Z]{{2}}|,?[ ][A-Z]{{2}}[ ]\d{{5}})?)"
    ),
    "de": re.compile(rf"[{U}][{L}\-]*(?:{'|'.join(map(re.escape, STREETS_DE))})[ ]\d+[ ]?[a-z]?{BREAK}(\d{{5}}[ ]{TOWN})"),
    "de at": re.compile(
        rf"(?:{'|'.join(x.capitalize() for x in STREETS_DE_AT)})[ ][{U}][{L}\-]+(?:[ ][{U}][{L}\-]+)?[ ]\d+[ ]?[a-z]?{BREAK}(\d{{5}}[ ]{TOWN})"
    ),
    "fr": re.compile(
        rf"\d+(?:[ ](?:bis|ter))?,?[ ](?:{'|'.join(STREETS_FR)})[ ](?:de[ ]la[ ]|de[ ]l['’]|du[ ]|des[ ]|de[ ]|d['’])?[{U}{L}'’\-]+(?:[ ][{U}][{L}'’\-]+)*{BREAK}(\d{{5}}[ ]{TOWN})"
    ),
    "es": re.compile(
        rf"(?:{'|'.join(map(re.escape, STREETS_ES))}|C/)[ ](?:de[ ]la[ ]|del[ ]|de[ ]los[ ]|de[ ]las[ ]|de[ ])?[{U}][{L}]+(?:[ ][{U}][{L}]+)*,?[ ]\d+"
        rf"(?:,[ ](?:bajo|ático|\d+\.?[ºª](?:[ ]?[A-Z]\b)?))?{BREAK}(\d{{5}}[ ]{TOWN})"
    ),
    "ja": re.compile(r"〒\s?\d{3}-?\d{4}\s*[\u3040-\u30ff\u3400-\u9fff]+?[県都府道][\u3040-\u30ff\u3400-\u9fff]+\d+(?:[-−ー丁目番号\d])*"),
}
WORD_WINDOW = 80  # characters before an anchor in which its own street word or box begins
FIRST_NUMBER = re.compile(r"(?<![\w])(?:(?:Flat|Apt|Unit|Suite)(?=\W)|\d)")
FIRST_WORD = re.compile(r"(?<![\w])\S")
WINDOW = (120, 400)  # characters before and after an anchor in which an address must lie
POSTCODE = re.compile(r"(?<![\w])(?:[A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2}|[A-Z]{2}[ ]\d{5}(?:-\d{4})?)(?!\w)")
POSTED = re.compile(
    rf"(?:(?:Flat|Apt|Unit|Suite)\.?[ ]\d+[a-z]?{BREAK})?\d{{1,5}}[a-z]?[ ](?:[{U}][{L}'’]+[ ]){{0,3}}[{U}][{L}'’]+\.?(?:{BREAK}(?:Flat|Apt|Unit|Suite|Floor)\.?[ ]\d+[a-z]?)?{BREAK}{TOWN},?[ ]\Z"
)
CUE_WINDOW = 14  # characters before digits in which a word says that they are no identity number
BEFORE_TABLE = re.compile(r"(?:Table|Fig\.?|Figure|Chart)[ ]$")


def _ru_forms(name: str) -> set[str]:
    """A Russian given name in all its cases, in lower case."""
    x = name.lower()
    end, stem = x[-1], x[:-1]
    if end in "ая":
        return {stem + e for e in (("а", "ы", "и", "е", "у", "ой") if end == "а" else ("я", "и", "е", "ю", "ей"))}
    if end in "йь":
        return {x, *(stem + e for e in ("я", "ю", "ем", "е", "и", "ью"))}
    if x in ("павел", "пётр"):
        stem = {"павел": "павл", "пётр": "петр"}[x]
        return {x, *(stem + e for e in ("а", "у", "ом", "е"))}
    return {x, *(x + e for e in ("а", "у", "ом", "е"))}


def valid_iban(text: str) -> bool:
    """Whether letters and digits hold to the account number's check (remainder 1 by 97)."""
    x = text.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def valid_card(text: str) -> bool:
    """Whether digits hold to the card number's check (doubled every second from the right, remainder 0 by 10)."""
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in (
        [(w, "label") for w in f"{NAME_LABELS}|{KIN}".split("|")] + [(f" {w}", "follow") for w in f"{AFTER_NAME}|who|aged|an|a|the|{KIN}".split("|") if len(w) > 3 or w == "who"]
        + [("tel:", "scheme"), ("sms:", "scheme"), ("iban", "iban"), ("@", "at"), ("(at)", "spelt"), ("[at]", "spelt"), ("{at}", "spelt"), (" at ", "spelt words"), ("〒", "ja")]
        + [(n.lower(), "given") for n in GIVEN_NAMES] + [(t.lower(), "title") for t in TITLES]
        + [(f" {s.lower()}", "en") for s in STREETS + STREETS_MORE] + [("box ", "box"), ("postfach ", "box"), ("apartado ", "box")]
        + [(f"{s} ", "de") for s in STREETS_DE] + [(f"{s} ", "de at") for s in STREETS_DE_AT] + [(f" {s} ", "fr") for s in STREETS_FR] + [(f"{s.lower()} ", "es") for s in STREETS_ES]
        + [(c, "cue") for c in ID_CUES] + [(d, "digit") for d in "0123456789"] + [(". ", "initial")]
    ):
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


class Finder:
    def __init__(self) -> None:
        self.anchors = _anchors()
        self.given = {n.lower() for n in GIVEN_NAMES}
        self.not_surname = {w.lower() for w in NO_SURNAMES + ORGANISATIONS}
        self.surname_too = {w.lower() for w in SURNAMES_TOO}
        self.ru_given = {f for n in RU_GIVEN for f in _ru_forms(n)}
        self.ru_stop = set(RU_STOP)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, end, type)`` in code points, in order, not overlapping."""
        low = text.lower()
        if len(low) != len(text):  # a few letters change length in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits: dict[str, list[tuple[int, int]]] = {}
        for end, (kind, size) in self.anchors.iter(low):
            hits.setdefault(kind, []).append((end + 1 - size, end + 1))
        out: list[tuple[int, int, str]] = []
        taken = bytearray(len(text))

        def take(start: int, end: int, kind: str) -> bool:
            if start < 0 or end <= start or any(taken[start:end]):
                return False
            taken[start:end] = b"\1" * (end - start)
            out.append((start, end, kind))
            return True

        for start, end in hits.get("at", ()):
            self._email(text, start, end, DOMAIN, take)
        for start, end in hits.get("spelt", ()):
            self._email(text, start, end, SPELT_DOMAIN, take)
        for start, end in hits.get("spelt words", ()):
            m = SPELT_DOMAIN.match(text, end)
            if m and re.search(r"(?i)[ (\[{]dot[ )\]}]", m[1]):
                self._email(text, start, end, SPELT_DOMAIN, take)
        for kind in ("en", "box", "de", "de at", "fr", "es", "ja"):
            for start, end in hits.get(kind, ()):
                if kind != "en" or not text[end : end + 1].isalnum():
                    self._address(text, kind, start, take)
        if POSTCODE.search(text):
            self._posted(text, take)
        self._accounts(text, take)
        for start, end in hits.get("cue", ()):
            self._cued_id(text, start, end, take)
        for start, end in hits.get("scheme", ()):
            m = SCHEME_PHONE.match(text, end)
            if m and not (start and text[start - 1].isalnum()):
                take(m.start(), m.end(), "phone")
        self._digits(text, low, hits.get("digit", ()), take, taken)
        self._people(text, low, hits, take, taken)
        self._people_by_context(text, hits, take, taken)
        if not text.isascii():
            self._people_ru(text, take)
            self._people_ja(text, take)
        return sorted(out)

    @staticmethod
    def _email(text: str, start: int, end: int, domain: re.Pattern, take) -> None:
        start -= start > 0 and text[start - 1] == " "
        begin = start
        while begin and text[begin - 1] in LOCAL_CHARS:  # as far as an address can reach
            begin -= 1
        local, host = LOCAL_PART.search(text, begin, start), domain.match(text, end)
        if local and host:
            take(local.start(1), host.end(1), "email")

    @staticmethod
    def _posted(text: str, take) -> None:
        """Addresses by their postcode, whatever the street is called."""
        for p in POSTCODE.finditer(text):
            for m in re.finditer(r"(?<![\w.,/-])\d{1,5}[a-z]?[ ]|(?<!\w)(?:Flat|Apt|Unit|Suite)\.?[ ]\d", text[max(0, p.start() - WINDOW[0]) : p.start()]):
                begin = max(0, p.start() - WINDOW[0]) + m.start()
                if POSTED.match(text, begin, p.start()) and not BEFORE_TABLE.search(text, max(0, begin - 10), begin) and take(begin, p.end(), "address"):
                    break

    @staticmethod
    def _accounts(text: str, take) -> None:
        """Account and card numbers that hold to their check."""
        if not TWELVE.search(text):
            return
        for rule, valid in ((IBAN, valid_iban), (CARD, valid_card)):
            for m in rule.finditer(text):
                if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "-.+/")) and valid(m[0]):
                    take(m.start(), m.end(), "id_number")

    @staticmethod
    def _address(text: str, kind: str, anchor: int, take) -> None:
        if kind == "en" and not text[anchor + 1].isupper() or kind in ("es", "de at") and not text[anchor].isupper():
            return
        rule, end = ADDRESSES[kind], min(len(text), anchor + WINDOW[1])
        numbered = kind in ("en", "fr")  # the number stands before the street's word, else the word begins it
        for at in (FIRST_NUMBER if numbered else FIRST_WORD).finditer(text, max(0, anchor - WINDOW[0]) if numbered else max(0, anchor - WORD_WINDOW), min(len(text), anchor + 2)):
            m = rule.match(text, at.start(), end)
            if not m or m.end() <= anchor:
                continue
            if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "-.,/" and text[m.start() - 2 : m.start() - 1].isdigit()):
                continue
            if BEFORE_TABLE.search(text, max(0, m.start() - 10), m.start()):
                continue
            take(m.start(), m.end(), "address")
            return

    @staticmethod
    def _posted(text: str, take) -> None:
        """Addresses by their postcode, whatever the street is called."""
        for p in POSTCODE.finditer(text):
            for m in re.finditer(r"(?<![\w.,/-])\d{1,5}[a-z]?[ ]|(?<!\w)(?:Flat|Apt|Unit|Suite)\.?[ ]\d", text[max(0, p.start() - WINDOW[0]) : p.start()]):
                begin = max(0, p.start() - WINDOW[0]) + m.start()
                if POSTED.match(text, begin, p.start()) and not BEFORE_TABLE.search(text, max(0, begin - 10), begin) and take(begin, p.end(), "address"):
                    break

    @staticmethod
    def _accounts(text: str, take) -> None:
        """Account and card numbers that hold to their check."""
        if not TWELVE.search(text):
            return
        for rule, valid in ((IBAN, valid_iban), (CARD, valid_card)):
            for m in rule.finditer(text):
                if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "-.+/")) and valid(m[0]):
                    take(m.start(), m.end(), "id_number")

    @staticmethod
    def _address(text: str, kind: str, anchor: int, take) -> None:
        rule = ADDRESSES[kind]
        begin = max(0, anchor - WINDOW[0])
        for m in rule.finditer(text, begin, min(len(text), anchor + WINDOW[1])):
            if m.start() > anchor + 1:
                return
            if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "-.,/" and text[m.start() - 2 : m.start() - 1].isdigit()):
                continue
            if BEFORE_TABLE.search(text, max(0, m.start() - 10), m.start()):
                continue
            if m.end() > anchor:
                take(m.start(), m.end(), "address")
                return

    @staticmethod
    def _cued_id(text: str, start: int, end: int, take) -> None:
        if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
            return
        gap = CUE_GAP.match(text, end)
        at = gap.end() if gap else end
        for rule in STRONG_IDS + CUED_IDS:
            m = rule.match(text, at)
            if m and sum(c.isdigit() for c in m[0]) >= 5:
                take(m.start(), m.end(), "id_number")
                return

    @staticmethod
    def _digits(text: str, low: str, hits, take, taken: bytearray) -> None:
        last = -1
        for start, _ in hits:
            if start < last or taken[start]:
                continue
            prev = text[start - 1] if start else " "
            if prev.isdigit() or prev in ".,/:-" and start > 1 and text[start - 2].isdigit() or prev in "#@_=/\\":
                continue
            head = low[max(0, start - 24) : start]
            # the value may open with a sign, a bracket or letters
            begin = start
            while begin and text[begin - 1] in "+(":
                begin -= 1
            found = None
            for rule in PHONES:
                for at in range(begin, start + 1):
                    m = rule.match(text, at)
                    n = sum(c.isdigit() for c in re.split(r"[ ,]*(?:ext|x|#)", m[0])[0]) if m else 0
                    if m and 9 <= n <= 15:
                        found = m
                        break
                if found:
                    break
            if prev.isalpha() and prev.isascii():
                found = None
            if found and not any(c in head for c in ("isbn", "doi", "shelf mark")):
                if take(found.start(), found.end(), "phone"):
                    last = found.end()
                    continue
            m = LOCAL_PHONE.match(text, start)
            if m and not prev.isalpha() and (m[0].startswith("555") or any(c in head for c in PHONE_CUES)):
                if take(m.start(), m.end(), "phone"):
                    last = m.end()
                    continue
            at = start
            while at and start - at < 2 and text[at - 1].isascii() and text[at - 1].isupper():
                at -= 1
            if at == start and prev == " " and start > 2 and text[start - 3 : start - 1].isupper() and text[start - 3 : start - 1].isascii():
                at = start - 3  # letters set apart
            for at in dict.fromkeys((at, start)):
                if at and (text[at - 1].isalnum() or text[at - 1] in "-_/.@#"):
                    continue
                m = next((m for r in STRONG_IDS if (m := r.match(text, at))), None)
                if m and any(c in low[max(0, at - CUE_WINDOW) : at] for c in NOT_ID_CUES):
                    continue
                if m and take(m.start(), m.end(), "id_number"):
                    last = m.end()
                    break

    def _people(self, text: str, low: str, hits, take, taken: bytearray) -> None:
        ok = lambda s: s.lower().split("-")[0] not in self.not_surname

        def named(s: str, at: int) -> bool:
            """Whether a word after an anchor at ``at`` is a surname: a word of both kinds is, but for places and capitals."""
            return ok(s) or s.lower() in self.surname_too and not s.isupper() and not BEFORE_PLACE.search(text, max(0, at - 12), at)

        anchors = [(s, e, "given") for s, e in hits.get("given", ())] + [(s, e, "title") for s, e in hits.get("title", ())]
        anchors += [(s - 1, s, "initial") for s, e in hits.get("initial", ()) if s]
        for start, end, kind in sorted(anchors):
            if start and (text[start - 1].isalnum() or text[start - 1] in "@_") or not text[start].isupper() or taken[start]:
                continue
            if kind == "initial":
                if re.search(r"\d \d{1,2} $", text[max(0, start - 6) : start]):
                    continue  # a point of the compass
                m = INITIALS.match(text, start)
                if m and ok(m[1]) and m[1].lower() not in self.given:
                    if not self._organisation(text, m.end()):
                        take(m.start(), m.end(), "person")
                    continue
                head = text[max(0, start - 60) : start]
                b = BACKWARD.search(head)  # Surname, I.
                if b and ok(b[1]) and not re.match(rf"[{U}]\.[ ]*[{U}]", text[start : start + 5]):
                    take(start - len(head) + b.start(1), start + 2, "person")
                continue
            if end < len(text) and (text[end].isalnum() or text[end] in "@_"):
                continue
            if kind == "title":
                m = TITLED.match(text, end)
                if m and named(re.split(r"[ ,]+", m[1])[-1], 0) and named(re.split(r"[ ,]+", m[1])[0], 0):
                    s, e = m.span(1)
                    words = m[1].split()
                    if "," not in m[1] and words[0].lower() not in self.given and not words[0].endswith(".") and self._organisation(text, e):
                        continue
                    # of "Surname, Given Surname" only a listed given name turns the order
                    take(s, e, "person")
                continue
            m = FORWARD.match(text, end)
            if m and self._organisation(text, m.end()):
                m = None
            if m and ok(m[1]) and len(m[1]) > 2:
                take(start, m.end(), "person")
                continue
            head = text[max(0, start - 60) : start]
            b = BACKWARD.search(head)
            if b and ok(b[1]) and not taken[start - len(head) + b.start(1)]:
                take(start - len(head) + b.start(1), end, "person")
                continue
            if m and named(m[1], start):  # a short or twofold word, where no surname stands before
                take(start, m.end(), "person")
                continue
            m = WRAPPED.match(text, end)
            if m and len(m[1]) > 1 and ok(m[1]) and not self._organisation(text, m.end()):
                take(start, m.end(), "person")

    def _people_by_context(self, text: str, hits, take, taken: bytearray) -> None:
        """Two to four capitalised words that are no place, body or opening, beside words that speak of a person."""
        found: set[tuple[int, int]] = set()
        for start, end in hits.get("label", ()):  # Contact: X; her sister X
            gap = BEFORE_LABELLED.match(text, end)
            m = SEQUENCE.match(text, gap.end()) if gap else None
            head = text[max(0, start - 30) : gap.end()] if m else ""
            if m and (LABELLED.search(head) or RELATED.search(head)):
                found.add(m.span())
        for start, end in hits.get("follow", ()):  # X said; by X, who
            at = max(0, start - 100)
            m = BEFORE_FOLLOWED.search(text, at, start)
            if m and (m.start(1) > at or not at):
                tail = text[m.end(1) : end + 1]
                if len(m[1].split()) == 2 and SPOKE.match(tail) or FOLLOWED.match(tail) and LED.search(text, max(0, m.start(1) - 8), m.start(1)):
                    found.add(m.span(1))
        for start, end in sorted(found):
            words = re.split(r"[ \u00a0]", text[start:end])
            if any(w.lower().rstrip(".") in PLACE_WORDS or len(w) < 2 or w.isupper() for w in words) or self._organisation(text, end) or any(taken[start:end]):
                continue
            take(start, end, "person")

    def _people_ru(self, text: str, take) -> None:
        """Names in Cyrillic letters: by initials, by a title, by a listed given name with or without the father's."""
        ok = lambda s: s.lower() not in self.ru_stop
        words = list(RU_WORD.finditer(text))
        if not words:
            return
        for m in RU_INITIALS.finditer(text):
            if ok(m[1]):
                take(*m.span(), "person")
        for m in RU_AFTER.finditer(text):
            if ok(m[1]) and (m[2] or RU_ENDS.search(m[1])):
                take(*m.span(), "person")
        for m in RU_TITLED.finditer(text):
            parts = m[1].split(" ")
            if len(parts) == 3 and not (RU_FATHER.search(parts[1]) or RU_FATHER.search(parts[2])):
                parts = parts[:2]
            if all(map(ok, parts)):
                take(m.start(1), m.start(1) + len(" ".join(parts)), "person")
        near = lambda i, j: 0 <= i and j < len(words) and text[words[i].end() : words[j].start()] == " "
        for i, w in enumerate(words):
            if w[0].lower() not in self.ru_given:
                continue
            last = i + 1 if near(i, i + 1) and RU_FATHER.search(words[i + 1][0]) else i
            # Иван Петрович Сидоров; a surname may end like a father's name
            if near(last, last + 1) and ok(words[last + 1][0]):
                take(w.start(), words[last + 1].end(), "person")
            elif near(i - 1, i) and ok(words[i - 1][0]) and RU_ENDS.search(words[i - 1][0]):
                take(words[i - 1].start(), words[last].end(), "person")
            elif last > i:
                take(w.start(), words[last].end(), "person")

    @staticmethod
    def _people_ja(text: str, take) -> None:
        """Names in Japanese: before an honorific or after a cue."""
        for rule in (JA_LISTED, JA_SPACED):
            for m in rule.finditer(text):
                if m[1] not in JA_NOT_GIVEN:
                    take(m.start(), m.end(1), "person")
        for rule in (JA_FOREIGN, JA_CUED):
            for m in rule.finditer(text):
                take(*m.span(1), "person")

    def _organisation(self, text: str, end: int) -> bool:
        m = re.match(rf"[ ]([{U}][{L}]+)", text[end : end + 24])
        return bool(m) and m[1] in ORGANISATIONS


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, char_start, char_end, pii_type)``, one row an occurrence.

    Offsets are code points of the text, from 0, end exclusive; occurrences do
    not overlap (email before address before id_number before phone before
    person).  Null and empty texts have none; a row given twice gives its rows
    twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for i, t in zip(ids, texts):
                rows.extend((i, *x) for x in finder.find(t.as_py()))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())],
                names=["doc_id", "char_start", "char_end", "pii_type"],
            )

    some = documents.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).cast("long"), text_col)
    return spread(some).mapInArrow(run, "doc_id long, char_start int, char_end int, pii_type string")


def redact(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows with each occurrence replaced by ``[EMAIL]``, ``[PHONE]`` ...

    Null texts stay null; all other columns stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for t in batch.column(at).to_pylist():
                if t:
                    parts, last = [], 0
                    for s, e, kind in finder.find(t):
                        parts += [t[last:s], f"[{kind.upper()}]"]
                        last = e
                    t = "".join([*parts, t[last:]])
                out.append(t)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return documents.mapInArrow(run, documents.schema)
